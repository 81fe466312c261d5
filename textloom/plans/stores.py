"""Builds over time: incremental rebuilds, snapshots, corpus diffs and build history, as joins of keyed tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import diff
from textloom.functions.values import canonical, content_hash
from textloom.plans.build import build, path_guard
from textloom.plans.planner import Program


class Versions:
    """A keyed table (path, ..., deleted, version) as one Parquet folder a version, compacted into a base now and then."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, compact: int = 10) -> None:
        self.spark, self.folder, self.schema, self.compact = spark, folder, schema, compact

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _parts(self) -> tuple[int, list[int]]:
        """The newest whole base, -1 for none, and all whole versions after it. Errors of the store are raised."""
        fs, path = self._fs()
        whole = lambda name: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS"))
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        numbers = lambda kind: sorted(int(x.split("=")[1]) for x in names if x.startswith(f"{kind}=") and whole(x))
        base = max(numbers("base"), default=-1)
        return base, [n for n in numbers("version") if n > base]

    def base(self) -> int:
        return self._parts()[0]

    def next(self) -> int:
        """The number after the newest version's, or 0."""
        base, versions = self._parts()
        return max([base, *versions]) + 1

    def read(self, before: int | None = None) -> DataFrame:
        """All versions since the newest base, the base with them; or those before a number."""
        base, versions = self._parts()
        paths = [f"{self.folder}/base={base}"] * (base >= 0) + [f"{self.folder}/version={n}" for n in versions if before is None or n < before]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def newest(self, before: int | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
        """The newest row of each path, with these columns or all: no others are read or shuffled."""
        rows = self.read(before)
        rest = [c for c in rows.columns if c != "path" and (not columns or c in columns)]
        return rows.groupBy("path").agg(F.max_by(F.struct(*rest), "version").alias("v")).select("path", *(F.col(f"v.{c}").alias(c) for c in rest))

    def version(self, number: int) -> DataFrame:
        """What one version wrote; what the base has of it once it is compacted."""
        base, versions = self._parts()
        if number in versions:
            return self.spark.read.schema(self.schema).parquet(f"{self.folder}/version={number}")
        return self.read().filter(F.col("version") == number)

    def write(self, rows: DataFrame, number: int) -> None:
        """Write a version; writing it again replaces it. Every `compact` versions the newest rows become the base.

        The base before and the versions since stay until the next time: a reader may be at them.
        """
        rows.write.mode("overwrite").parquet(f"{self.folder}/version={number}")
        base, versions = self._parts()
        if len(versions) < self.compact:
            return
        self.newest().write.mode("overwrite").parquet(f"{self.folder}/base={number}")
        fs, path = self._fs()
        for name in [x.getPath().getName() for x in fs.listStatus(path)]:
            kind, _, n = name.partition("=")
            if n.isdigit() and (kind == "base" and int(n) < base or kind == "version" and int(n) <= base):
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"), True)


def program_hash(program: Program) -> str:
    """Of canonical JSON, so any field that changes counts."""
    return hashlib.sha256(canonical([program.corpus, program.content, program.on_no_match, program.validators]).encode()).hexdigest()


def signature(program: Program, path: Column) -> Column:
    """Hash of what a program does to a document at a path: the patches that admit it, in order, and the program's rules.

    A patch that changes changes the signatures of the paths it admits or admitted, and of no others.
    """
    digest = lambda x: hashlib.sha256(canonical(x).encode()).hexdigest()
    own = [F.when(path_guard(p, path), F.lit(digest({k: v for k, v in p.items() if k not in ("include", "exclude", "group")}))) for p in program.content]
    return F.sha2(F.concat_ws(",", F.lit(digest([program.corpus, program.on_no_match, program.validators])), *own), 256)


def stale(corpus: DataFrame, cache: DataFrame, patches: str | Column) -> DataFrame:
    """corpus with the reason why a document must be rebuilt, null if its cached output stands. cache: path, source_hash,
    patch_hash, output; patches: the hash that a document's cached patches must have, one for all or of its path."""
    known = cache.select("path", F.col("source_hash").alias("_s"), F.col("patch_hash").alias("_p"), F.lit(True).alias("_had"))
    out = corpus.withColumn("source_hash", content_hash(F.col("content"))).join(known, "path", "left")
    reason = F.when(F.col("_had").isNull(), "new-file").when(~F.col("_s").eqNullSafe(F.col("source_hash")), "source-changed").when(F.col("_p") != patches, "patches-changed")
    return out.withColumn("reason", reason).drop("_s", "_p", "_had")


def incremental(corpus: DataFrame, cache: DataFrame, program: Program, *, tally: bool = False) -> DataFrame:
    """path, content (output), source_hash, patch_hash, output_hash, rebuilt: only stale documents run through the program.

    A document is stale if it changed or if a patch for its path did. Corpus patches rename and add paths, so a program with
    any rebuilds everything. tally: also reason (null where the cache was good), applied, skipped, counts and ms.
    """
    marked = stale(corpus, cache, signature(program, F.col("path")))
    old = marked.filter(F.col("reason").isNull()) if not program.corpus else marked.limit(0)
    todo = marked.filter(F.col("reason").isNotNull()) if not program.corpus else marked
    done = build(todo.select("path", "content", "source_hash", *(["reason"] if tally else [])), program, tally=tally)
    kept = old.select("path", "source_hash").join(cache.select("path", F.col("output").alias("content")), "path")
    more = ["reason", "applied", "skipped", "warnings", "errors", "counts", "ms"] if tally else []
    nothing = {"reason": F.lit(None).cast("string"), "applied": F.lit(0), "skipped": F.lit(0), "warnings": F.array().cast("array<string>"), "errors": F.array().cast("array<string>"), "counts": F.array().cast("array<int>"), "ms": F.lit(0.0)}
    out = done.select("path", "content", "source_hash", F.lit(True).alias("rebuilt"), *more).unionByName(kept.select("path", "content", "source_hash", F.lit(False).alias("rebuilt"), *(nothing[c].alias(c) for c in more)))
    return out.withColumn("patch_hash", signature(program, F.col("path"))).withColumn("output_hash", content_hash(F.col("content")))


def cache_statistics(incremental_: DataFrame) -> DataFrame:
    hits = F.sum((~F.col("rebuilt")).cast("long"))
    return incremental_.agg(F.count("*").alias("files"), hits.alias("hits"), (F.count("*") - hits).alias("misses"), (hits / F.count("*") * 100).alias("hit_percent"))


CACHE = "path string, source_hash string, patch_hash string, output_hash string, output string"


def cache_problems(cache: DataFrame) -> DataFrame:
    """path, problem of entries that can't be used: no hash, an output other than its hash says, or a path twice."""
    twice = cache.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select("path", F.lit("twice").alias("problem"))
    bad = F.when(F.col("path").isNull() | F.col("source_hash").isNull() | F.col("patch_hash").isNull(), "incomplete").when(~F.col("output_hash").eqNullSafe(content_hash(F.col("output"))), "damaged")
    return cache.select("path", bad.alias("problem")).filter(F.col("problem").isNotNull()).unionByName(twice)


def repaired(cache: DataFrame) -> DataFrame:
    """The entries without a problem: of a path that is there twice neither can be trusted, so it is built again."""
    return cache.join(cache_problems(cache).select("path").distinct(), "path", "left_anti").filter(F.col("path").isNotNull())


def cache_sizes(cache: DataFrame) -> DataFrame:
    """Entries, programs and bytes of outputs."""
    return cache.agg(F.count("*").alias("entries"), F.countDistinct("patch_hash").alias("programs"), F.coalesce(F.sum(F.octet_length("output")), F.lit(0)).alias("bytes"))


def write_cache(built: DataFrame, table: Versions, number: int) -> None:
    """Keep an incremental build's outputs as a version of a store; only rebuilt documents are written."""
    rows = built.filter("rebuilt").select("path", "source_hash", "patch_hash", "output_hash", F.col("content").alias("output"), F.lit(False).alias("deleted"), F.lit(number).cast("long").alias("version"))
    table.write(rows, number)


def cache_store(spark: SparkSession, folder: str) -> Versions:
    return Versions(spark, folder, CACHE + ", deleted boolean, version long")


def read_cache(table: Versions) -> DataFrame:
    return table.newest().filter(~F.col("deleted")).select("path", "source_hash", "patch_hash", "output_hash", "output")


def rolled_back(outputs: DataFrame, history: DataFrame, build_id: str) -> DataFrame:
    """path, output of every document as a build left it: its own and those that earlier builds wrote last.

    outputs: build_id, path, output (null where a build dropped the path).
    """
    at = history.filter(F.col("build_id") == build_id).select(F.col("ts").alias("_at"))  # one row
    before = history.filter("success").join(F.broadcast(at.limit(1)), F.col("ts") <= F.col("_at")).select("build_id", "ts")
    rows = outputs.join(before, "build_id").groupBy("path").agg(F.max_by(F.struct("output"), F.struct("ts", "build_id")).alias("o"))
    return rows.select("path", "o.output").filter(F.col("output").isNotNull())


def updated(old: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot of a corpus, and path, status of what it changes in the old one."""
    return snapshot(corpus), verify(old, corpus).filter(F.col("status") != "unchanged")


def snapshot(corpus: DataFrame) -> DataFrame:
    """path, sha256."""
    return corpus.select("path", content_hash(F.col("content")).alias("sha256"))


def status(before: Column, after: Column, had: Column | None = None, has: Column | None = None) -> Column:
    """How a document changed. had, has: whether there was one, where its hash can be null."""
    had, has = before.isNotNull() if had is None else had, after.isNotNull() if has is None else has
    return F.when(~had, "added").when(~has, "deleted").when(before.eqNullSafe(after), "unchanged").otherwise("modified")


def verify(old: DataFrame, corpus: DataFrame) -> DataFrame:
    """path, status of every path of a snapshot or a corpus. A null content is equal to itself alone."""
    a = old.select("path", "sha256", F.lit(True).alias("_had"))
    b = snapshot(corpus).select("path", F.col("sha256").alias("now"), F.lit(True).alias("_has"))
    there = lambda c: F.coalesce(F.col(c), F.lit(False))
    return a.join(b, "path", "full").select("path", status(F.col("sha256"), F.col("now"), there("_had"), there("_has")).alias("status"))


def unified(before: str | None, after: str | None, path: str, context: int = 3) -> str:
    """A unified diff of two texts by lines; a text that isn't there has none."""
    return diff.unified([] if before is None else before.split("\n"), [] if after is None else after.split("\n"), path, context)


def patched(before: str | None, text: str) -> str | None:
    """What a unified diff makes of a text. No lines are left where the text is gone."""
    lines = diff.applied([] if before is None else before.split("\n"), text)
    return "\n".join(lines) if lines else None


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, status of every document that differs. Hashes alone meet."""
    return verify(snapshot(before), after).filter(F.col("status") != "unchanged")


def corpus_diff(before: DataFrame, after: DataFrame, text: bool = True) -> DataFrame:
    """path, status and a unified diff of every document that differs. Only texts of such documents move."""
    some = changed(before, after)
    if not text:
        return some
    keys = some.select("path")
    a = before.select("path", F.col("content").alias("_a")).join(keys, "path", "left_semi")
    b = after.select("path", F.col("content").alias("_b")).join(keys, "path", "left_semi")

    @F.arrow_udf("string")
    def told(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y, p in batches:
            yield pa.array([unified(i, j, k) for i, j, k in zip(x.to_pylist(), y.to_pylist(), p.to_pylist(), strict=True)], pa.string())

    return some.join(a, "path", "left").join(b, "path", "left").select("path", "status", told("_a", "_b", "path").alias("diff"))


def patched_corpus(before: DataFrame, diffs: DataFrame) -> DataFrame:
    """path, content: a corpus with the diffs of `corpus_diff` applied. A diff that doesn't fit fails the job."""

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, d in batches:
            yield pa.array([patched(i, j) for i, j in zip(x.to_pylist(), d.to_pylist(), strict=True)], pa.string())

    untouched = before.select("path", "content").join(diffs.select("path"), "path", "left_anti")
    todo = diffs.filter("status <> 'deleted'").join(before.select("path", "content"), "path", "left")
    return untouched.unionByName(todo.select("path", run("content", "diff").alias("content")))


def line_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, removed, added: numbers of lines, as multisets. Lines of documents that don't differ never move."""
    keys = changed(before, after).select("path")
    side = lambda df, sign: df.join(keys, "path", "left_semi").select("path", F.explode(F.split("content", "\n")).alias("line"), F.lit(sign).alias("n"))
    counts = side(before, -1).unionByName(side(after, 1)).groupBy("path", "line").agg(F.sum("n").alias("n"))
    return counts.groupBy("path").agg(F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"), F.sum(F.greatest(F.col("n"), F.lit(0))).alias("added"))


# History: an append-only table of builds (build_id, ts, success, tags, files, output_bytes, duration_ms) and of their files.


def builds(history: DataFrame, *, success: bool | None = None, tag: str | None = None, after: str | None = None, before: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Newest first."""
    if success is not None:
        history = history.filter(F.col("success") == success)
    if tag is not None:
        history = history.filter(F.array_contains("tags", tag))
    if after is not None:
        history = history.filter(F.col("ts") >= F.lit(after).cast("timestamp"))
    if before is not None:
        history = history.filter(F.col("ts") <= F.lit(before).cast("timestamp"))
    out = history.orderBy(F.desc("ts"), F.desc("build_id")).offset(offset)
    return out if limit is None else out.limit(limit)


def pruned(history: DataFrame, keep_last: int | None = None, keep_after: str | None = None) -> DataFrame:
    """Builds that stay: the newest ones, by a top-k of each task merged, or those since a time."""
    since = history.filter(F.col("ts") >= F.lit(keep_after).cast("timestamp")) if keep_after is not None else None
    if keep_last is None:
        return history.limit(0) if since is None else since
    last = history.orderBy(F.desc("ts"), F.desc("build_id")).limit(keep_last)
    return last if since is None else since.unionByName(last.filter(F.coalesce(F.col("ts") < F.lit(keep_after).cast("timestamp"), F.lit(True))))


def history_statistics(history: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return history.agg(F.count("*").alias("builds"), zero(F.sum(F.col("success").cast("long"))).alias("succeeded"), zero(F.sum("output_bytes")).alias("output_bytes"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), zero(F.avg("files")).alias("mean_files"), zero(F.avg("output_bytes")).alias("mean_bytes"))


def compare_builds(files: DataFrame, a: str, b: str) -> DataFrame:
    """path, status, size_delta, patch_delta between two builds. files: build_id, path, sha256, size, patches."""
    old = files.filter(F.col("build_id") == a).select("path", F.col("sha256").alias("_a"), F.col("size").alias("_as"), F.col("patches").alias("_ap"))
    new = files.filter(F.col("build_id") == b).select("path", F.col("sha256").alias("_b"), F.col("size").alias("_bs"), F.col("patches").alias("_bp"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return old.join(new, "path", "full").select("path", status(F.col("_a"), F.col("_b")).alias("status"), (zero("_bs") - zero("_as")).alias("size_delta"), (zero("_bp") - zero("_ap")).alias("patch_delta"))


def benchmark_statistics(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median, nearest-rank p95 and p99, population deviation by group."""
    rank = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})")
    return samples.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.expr(f"percentile({value}, 0.5)").alias("median"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.stddev_pop(value).alias("stddev"), F.min(value).alias("least"), F.max(value).alias("most"))


def regressions(now: DataFrame, base: DataFrame, by: str = "name", value: str = "mean") -> DataFrame:
    """by, before, after, percent: change against a baseline."""
    a = base.select(by, F.col(value).alias("before"))
    return now.select(by, F.col(value).alias("after")).join(a, by).withColumn("percent", (F.col("after") - F.col("before")) / F.col("before") * 100)
