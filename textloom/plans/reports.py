"""Reports of builds and programs: counts by operation, hints for patches that missed, one bundle of analyses, JSON and text."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textloom.plans import analytics, recover
from textloom.plans.build import statistics
from textloom.plans.planner import Program
from textloom.plans.preview import step, steps, takes


#: Why a document is rebuilt.
REASONS = ("new-file", "source-changed", "patches-changed")


def by_operation(corpus: DataFrame, patches: list[dict]) -> DataFrame:
    """op, documents, matches: what each kind of operation does when a program runs."""
    done = steps(corpus, patches).select("op", "path", "count")
    return done.groupBy("op").agg(F.countDistinct("path").alias("documents"), F.sum("count").alias("matches"))


class Counters:
    """Counts of a build, taken as its rows pass to the first action that reads them: no job of their own.

    Rows come from `build(..., tally=True)` or `incremental(..., tally=True)`. ms is the time that patches in Python took;
    seconds that of the whole write.
    """

    def __init__(self, program: Program) -> None:
        self.program, self.observation, self.seconds = program, Observation(f"build-{uuid.uuid4().hex}"), None

    def on(self, built: DataFrame) -> DataFrame:
        """The same rows, counted."""
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
        count = lambda k: F.coalesce(F.get("counts", F.lit(k)), F.lit(0))
        metrics = [
            F.count("*").alias("files"), zero((F.col("applied") > 0).cast("long")).alias("changed"), zero("applied").alias("applied"), zero("skipped").alias("skipped"),
            zero(F.size("warnings")).alias("warnings"), zero(F.size("errors")).alias("errors"), zero(F.octet_length("content")).alias("bytes"), zero("ms").cast("double").alias("ms"), F.coalesce(F.max("ms"), F.lit(0.0)).alias("slowest_ms"),
        ]
        if "rebuilt" in built.columns:
            metrics += [zero(F.col("rebuilt").cast("long")).alias("misses")] + [zero((F.col("reason") == r).cast("long")).alias(f"reason {r}") for r in REASONS]
        for op, places in self._by_op().items():
            some = reduce(lambda a, b: a | b, [count(k) > 0 for k in places])
            metrics += [zero(some.cast("long")).alias(f"documents {op}"), zero(reduce(lambda a, b: a + b, [count(k) for k in places])).alias(f"matches {op}")]
        return built.observe(self.observation, *metrics)

    def _by_op(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for k, p in enumerate(self.program.content):
            out.setdefault(p["op"], []).append(k)
        return out

    def write(self, built: DataFrame, folder: str) -> dict:
        """Write the rows, less what only the counts need, as Parquet; the statistics."""
        began = time.perf_counter()
        self.on(built).drop("counts", "ms").write.parquet(folder)
        self.seconds = time.perf_counter() - began
        return self.statistics()

    def statistics(self) -> dict:
        """Waits until the rows have passed."""
        told = self.observation.get
        out = {k: v for k, v in told.items() if " " not in k} | ({} if self.seconds is None else {"seconds": self.seconds})
        if "misses" in out:
            files, misses = out["files"], out["misses"]
            mean = out["ms"] / misses if misses else 0.0
            out |= {"hits": files - misses, "hit_percent": (files - misses) / files * 100 if files else 0.0, "mean_ms": mean, "saved_ms": mean * (files - misses)}
            out["reasons"] = {r: n for r in REASONS if (n := told[f"reason {r}"])}
        return out

    def by_operation(self) -> dict[str, tuple[int, int]]:
        """Documents and matches of each kind of operation that did something."""
        told = self.observation.get
        return {op: (told[f"documents {op}"], told[f"matches {op}"]) for op in self._by_op() if told[f"documents {op}"]}


def hints(corpus: DataFrame, patches: list[dict], most: int = 3) -> DataFrame:
    """path, step, op, hint, confidence: for each patch that matches nothing, what would make it match."""
    schema = "path string, step int, op string, hint string, confidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, patch in enumerate(patches if text is not None else []):
                    meant = takes(text, path, patch)
                    text, n = step(text, path, patch)
                    if meant and not n:
                        rows += [(path, k, patch["op"], f.why, float(f.confidence)) for f in recover.fixes(patch, text)[:most]]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["path", "step", "op", "hint", "confidence"])

    return corpus.select("path", "content").mapInArrow(run, schema)


def riskiest(patches: DataFrame, n: int = 10) -> DataFrame:
    """The patches with the highest risk."""
    return patches.select("ord", "op", "risk", "risk_level").orderBy(F.desc("risk"), "ord").limit(n)


def bundle(corpus: DataFrame, program: list[dict], top: int = 10) -> DataFrame:
    """section, body: coverage, impact, complexity, safety and the riskiest patches of a program, each as JSON.

    Impact has a row a patch and complexity its `top` documents; analytics.edges has every document of every patch.
    """
    spark = corpus.sparkSession
    patches = analytics.patch_table(spark, program)
    edge = analytics.edges(corpus, patches)
    rows = lambda df, order: df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in order))))).alias("body"))
    one = lambda df: df.select(F.to_json(F.struct(*df.columns)).alias("body"))
    complex_ = analytics.most_complex(edge, top).withColumn("order", -F.col("score"))
    parts = {
        "coverage": one(analytics.coverage(corpus, edge)), "impact": rows(analytics.impact(edge), ["ord"]), "complexity": rows(complex_, ["order", "path"]),
        "safety": one(analytics.safety(patches)), "riskiest": rows(riskiest(patches, top).withColumn("order", -F.col("risk")), ["order", "ord"]),
    }
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("section"), "body")
        out = part if out is None else out.unionByName(part)
    return out


def build_report(built: DataFrame) -> dict:
    """A build's counts as one map."""
    return {k: v or 0 for k, v in statistics(built).first().asDict().items()}


def as_text(report: dict) -> str:
    """A map as aligned lines, inner maps indented."""
    out = []

    def put(data: dict, pad: str) -> None:
        wide = max((len(str(k)) for k in data), default=0)
        for k, v in data.items():
            if isinstance(v, dict):
                out.append(f"{pad}{k}:")
                put(v, pad + "  ")
            else:
                out.append(f"{pad}{str(k).ljust(wide)}  {v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)}")

    put(report, "")
    return "\n".join(out) + "\n" * bool(out)


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False, default=str) + "\n"


def in_order(df: DataFrame) -> DataFrame:
    """Rows in order of their paths: by ranges, so that file names and listings follow it at any size."""
    return df.orderBy("path")


def write_rows(df: DataFrame, folder: str, form: str = "json") -> None:
    """A report's rows in order of their paths, as JSON lines or as text: one line a row, columns parted by tabs, line feeds
    and tabs within them escaped."""
    ordered = in_order(df)
    if form == "json":
        ordered.write.mode("overwrite").json(folder)
    else:
        plain = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
        show: Column = F.concat_ws("\t", *(plain(c) for c in df.columns))
        ordered.select(show.alias("value")).write.mode("overwrite").text(folder)


def word_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' words; 1 for two texts without any."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    both = F.size(F.array_union(words(a), words(b)))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / both)
