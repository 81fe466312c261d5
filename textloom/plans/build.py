"""Builds: a program folded over every document of a corpus, as columns where possible and in one fused UDF a run else.

A corpus is a table with `path` and `content`. The fold is narrow: documents never meet, nothing is shuffled. A null
content stays null: no condition holds for it, no patch matches it, no rule is broken by it, in columns and in Python alike.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.patterns import admitted, glob_regex
from textloom.operators import frontmatter, md, native
from textloom.operators.corpus import apply_corpus
from textloom.plans.checks import condition_column, failure_array, failures, first_failure, holds, reads_frontmatter
from textloom.plans.planner import Program, as_list, own, runs

STATE = "content string, applied int, skipped int, warnings array<string>, errors array<string>, counts array<int>, ms double"
STATE_FIELDS = [("content", pa.string()), ("applied", pa.int32()), ("skipped", pa.int32()), ("warnings", pa.list_(pa.string())), ("errors", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("ms", pa.float64())]


class BuildError(RuntimeError):
    """A strict build found errors."""


def path_guard(patch: dict, path: Column) -> Column:
    """Any include matches, or there is none; no exclude matches."""
    out = F.lit(True)
    include, exclude = as_list(patch.get("include")), as_list(patch.get("exclude"))
    if include:
        some = F.lit(False)
        for g in include:
            some = some | (path == g if not any(c in g for c in "*?[]{}!()+@") else path.rlike(glob_regex(g)))
        out = some
    for g in exclude:
        out = out & ~path.rlike(glob_regex(g))
    return out


def message(k: int, patch: dict, what: str) -> str:
    return f"patch {k} ({patch['op']}): {what}"


def fronted(df: DataFrame, content: Column, native_only: bool = False) -> DataFrame:
    """df with the content's frontmatter as VARIANT in _front. Each stage is fenced: what it is made of would else be written
    out into it wherever it is used, and again by the next patch with a condition."""
    state = [c for c in ("content", "applied", "skipped", "warnings", "errors", "counts", "ms") if c in df.columns]
    df = fenced(df, state)
    for name, column in frontmatter.stages(content, native_only):
        df = df.withColumn(name, column)
    return fenced(df, ["_json", "_front"])


def native_step(df: DataFrame, k: int, patch: dict, on_no_match: str, built: native.Pair, native_only: bool = False, hints: bool = False) -> DataFrame:
    """One patch as columns. The text is computed once, in a projection of its own."""
    text, n = built
    content = F.col("content")
    run = path_guard(patch, F.col("path"))
    rules = patch.get("validate") or {}
    if "when" in patch and reads_frontmatter(patch["when"]):
        df = fronted(df, content, native_only)
    when = F.coalesce(condition_column(patch["when"], content), F.lit(False)) if "when" in patch else F.lit(True)
    tally = "counts" in df.columns
    df = df.withColumn("_run", run & when).withColumn("_off", run & ~when)
    df = df.withColumn("_new", F.when(F.col("_run"), F.struct(text.alias("t"), n.cast("int").alias("n"))))
    hit = F.coalesce(F.col("_new.n") > 0, F.lit(False))
    missed = F.col("_run") & ~hit
    how = patch.get("onNoMatch", on_no_match)
    note = F.array(F.lit(message(k, patch, "no match")))
    if hints and how != "skip":
        df = df.withColumn("_hint", hint_column(patch, F.when(missed, content)))
        note = F.array(F.concat(F.lit(message(k, patch, "no match")), F.coalesce("_hint", F.lit(""))))
    columns = {
        "content": F.when(hit, F.col("_new.t")).otherwise(content),
        "applied": F.col("applied") + hit.cast("int"),
        "skipped": F.col("skipped") + F.col("_off").cast("int"),
        "warnings": F.when(missed, F.concat("warnings", note)).otherwise(F.col("warnings")) if how == "warn" else F.col("warnings"),
        "errors": F.when(missed, F.concat("errors", note)).otherwise(F.col("errors")) if how == "error" else F.col("errors"),
    }
    if rules:
        if "frontmatterRequired" in rules:
            df = fronted(df, F.col("_new.t"), native_only)
        broken = F.transform(failure_array(rules, F.col("_new.t")), lambda x: F.concat(F.lit(message(k, patch, "breaks ")), x))
        columns["errors"] = F.when(hit, F.concat(columns["errors"], broken)).otherwise(columns["errors"])
    if tally:
        columns["counts"] = F.concat("counts", F.array(F.when(hit, F.col("_new.n")).otherwise(0)))
    return df.withColumns(columns).drop("_run", "_off", "_new", "_hint", *frontmatter.STAGES)


def hint_of(patch: dict, text: str | None) -> str:
    """What would make a patch match, as the end of a warning; empty if nothing is known."""
    from textloom.plans import recover

    found = dict.fromkeys(f.why for f in recover.fixes(patch, text)[:3]) if text is not None else {}
    return f"; near: {', '.join(found)}" if found else ""


def hint_column(patch: dict, text: Column) -> Column:
    """The same of texts that aren't null, others null: only documents that a patch missed cross to Python."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else hint_of(patch, t) for t in texts.to_pylist()], pa.string())

    return run(text)


def fold(text: str | None, path: str, patches: list[tuple[int, dict]], on_no_match: str, counts: list[int] | None = None, hints: bool = False) -> tuple[str | None, int, int, list[str], list[str]]:
    """Patches on one document, in Python. counts: a list to which each patch's count is added;
    hints: whether warnings say what would match."""
    counts = [] if counts is None else counts
    applied = skipped = 0
    warnings: list[str] = []
    errors: list[str] = []
    for k, patch in patches:
        counts.append(0)
        if not admitted(path, as_list(patch.get("include")), as_list(patch.get("exclude"))):
            continue
        if "when" in patch and (text is None or not holds(patch["when"], text)):
            skipped += 1
            continue
        new, n = (None, 0) if text is None else md.apply(text, own(patch), path)
        if n:
            text, applied, counts[-1] = new, applied + 1, n
            errors += [message(k, patch, f"breaks {x}") for x in failures(patch.get("validate", {}), text)]
        else:
            how = patch.get("onNoMatch", on_no_match)
            if how != "skip":
                (warnings if how == "warn" else errors).append(message(k, patch, "no match") + (hint_of(patch, text) if hints else ""))
    return text, applied, skipped, warnings, errors


def python_run(df: DataFrame, patches: list[tuple[int, dict]], on_no_match: str, hints: bool = False) -> DataFrame:
    """A run of patches in one Arrow-batched UDF: the text crosses once, however many patches there are."""
    plugins = {p["plugin"]: md.PLUGINS[p["plugin"]] for _, p in patches if p["op"] == "plugin" and p["plugin"] in md.PLUGINS}
    transforms = dict(md.TRANSFORMS) if any(p["op"] == "ai-transform" for _, p in patches) else {}

    @F.arrow_udf(STATE)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        md.PLUGINS.update(plugins)
        md.TRANSFORMS.update(transforms)
        for content, path in batches:
            done = []
            for t, p in zip(content.to_pylist(), path.to_pylist(), strict=True):
                counts: list[int] = []
                began = time.perf_counter()
                done.append((*fold(t, p, patches, on_no_match, counts, hints), counts, 1000 * (time.perf_counter() - began)))
            yield pa.StructArray.from_arrays([pa.array([x[k] for x in done], kind) for k, (_, kind) in enumerate(STATE_FIELDS)], [name for name, _ in STATE_FIELDS])

    tally = {"counts": F.concat("counts", "_r.counts"), "ms": F.col("ms") + F.col("_r.ms")} if "counts" in df.columns else {}
    df = df.withColumn("_r", run("content", "path"))
    return df.withColumns(tally | {
        "content": F.col("_r.content"), "applied": F.col("applied") + F.col("_r.applied"), "skipped": F.col("skipped") + F.col("_r.skipped"),
        "warnings": F.concat("warnings", "_r.warnings"), "errors": F.concat("errors", "_r.errors"),
    }).drop("_r")


def validated(df: DataFrame, validators: list[dict]) -> DataFrame:
    """The first broken rule of each validator is an error."""
    if any("frontmatterRequired" in v for v in validators):
        df = fronted(df, F.col("content"))
    for v in validators:
        broken = F.when(F.col("content").isNotNull(), first_failure(v, F.col("content")))
        df = df.withColumn("_v", broken).withColumn("errors", F.when(F.col("_v").isNotNull(), F.concat("errors", F.array(F.concat(F.lit(f"validator {v['name']}: breaks "), F.col("_v"))))).otherwise(F.col("errors"))).drop("_v")
    return df.drop(*frontmatter.STAGES)


def apply_patches(df: DataFrame, patches: list[dict], on_no_match: str = "warn", *, native_only: bool = False, allow_exec: bool = False, tally: bool = False, hints: bool = False) -> DataFrame:
    """df (path, content) with content patched, and applied, skipped, warnings and errors by document.

    tally: also counts, each patch's matches, and ms, the time that patches in Python took. hints: warnings and errors of
    patches that match nothing say what would; documents they miss are looked at in Python.
    """
    if not allow_exec and any(p["op"] == "exec" for p in patches):
        raise PermissionError("exec patches run commands on executors; allow_exec permits them")
    empty = F.array().cast("array<string>")
    df = df.withColumns({"applied": F.lit(0), "skipped": F.lit(0), "warnings": empty, "errors": empty})
    if tally:
        df = df.withColumns({"counts": F.array().cast("array<int>"), "ms": F.lit(0.0)})
    k = 0
    for python, run in runs(patches, not native_only):
        numbered = list(enumerate(run, k))
        k += len(run)
        if python and native_only:
            raise ValueError(f"no native form: {', '.join(sorted({p['op'] for p in run}))}")
        if python:
            df = python_run(df, numbered, on_no_match, hints)
            continue
        for n, patch in numbered:
            staged, marked = native.staged(df, patch)
            built = native.build(marked, F.col("content"))
            df = native_step(staged, n, patch, on_no_match, built, native_only, hints).drop(*native.STAGES) if built else python_run(df, [(n, patch)], on_no_match, hints)
        df = fenced(df, ["content", "applied", "skipped", "warnings", "errors", *(["counts", "ms"] if tally else [])])
    return df


def fenced(df: DataFrame, columns: list[str]) -> DataFrame:
    """df as it is, with a generator of one row around these columns.

    Filters on them stop there. Pushed into the steps below, they would be written out step into step, and their size
    would grow as a power of the number of patches.
    """
    rest = [c for c in df.columns if c not in columns]
    out = df.select(*rest, F.inline(F.array(F.struct(*columns))))
    return out.select(*df.columns)


def build(df: DataFrame, program: Program, *, allow_exec: bool = False, tally: bool = False, hints: bool = False) -> DataFrame:
    """A whole program on a corpus: corpus patches, content patches, validators."""
    out = apply_corpus(df, program.corpus)
    return validated(apply_patches(out, program.content, program.on_no_match, allow_exec=allow_exec, tally=tally, hints=hints), program.validators)


def strict(df: DataFrame) -> DataFrame:
    """The build's rows; raises BuildError if any has errors."""
    bad = df.filter(F.size("errors") > 0).select("path", "errors").limit(20).collect()
    if bad:
        raise BuildError("; ".join(f"{r['path']}: {', '.join(r['errors'])}" for r in bad))
    return df


def statistics(built: DataFrame) -> DataFrame:
    """Documents, changed ones, patches applied and skipped, warnings, errors and bytes."""
    return built.agg(F.count("*").alias("files"), F.sum((F.col("applied") > 0).cast("int")).alias("changed"), F.sum("applied").alias("applied"), F.sum("skipped").alias("skipped"), F.sum(F.size("warnings")).alias("warnings"), F.sum(F.size("errors")).alias("errors"), F.sum(F.octet_length("content")).alias("bytes"))
