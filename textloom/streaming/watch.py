"""Continuous builds: a file stream whose new and changed documents run through a program, with state in a keyed table.

A batch costs what it brings and what the state holds of one folder's newest table: versions are compacted every COMPACT
batches, and older ones deleted. Versions have numbers of their own, and each row the stream's batch it came with: a sweep
between two batches is a version like any other, and a batch that is run again finds what it wrote. A row with a null
content says that its path is gone; file streams never say so, so `sweep` compares the state with a listing. Changes can be
held until a path has been quiet for a while: see debounce. A program with patches that copy, move or drop whole documents is built over all
sources with each batch, since any path may depend on any other; all others build only what changed.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from textloom.plans.build import build
from textloom.plans.planner import Program
from textloom.plans.stores import Versions, signature
from textloom.sources.files import relative_path
from textloom.streaming.debounce import debounced

SCHEMA = "path string, content string"
STATE = "path string, output string, source_hash string, patch_hash string, applied int, deleted boolean, version long, batch long, swept boolean"
SOURCES = "path string, content string, deleted boolean, version long"
COMPACT = 10
VARIABLE = re.compile(r"\{\{([A-Za-z_][A-Za-z0-9_]*)\}\}")


def interpolated(command: str, names: set[str]) -> str:
    """A shell command whose {{name}}s are references to variables HOOK_name, so that no value is ever read as shell."""
    out, at, single, double = [], 0, False, False
    for m in VARIABLE.finditer(command):
        for c in command[at : m.start()]:
            single, double = (not single if c == "'" and not double else single), (not double if c == '"' and not single else double)
        ref = f"${{HOOK_{m[1]}}}"
        out += [command[at : m.start()], m[0] if m[1] not in names else f"'\"{ref}\"'" if single else ref if double else f'"{ref}"']
        at = m.end()
    return "".join([*out, command[at:]])


def run_hooks(commands: list[str], context: dict[str, object], timeout: float = 30.0) -> bool:
    """Run shell commands one after the other; whether all succeeded. One that fails or takes too long doesn't stop the rest."""
    import os

    env = os.environ | {f"HOOK_{k}": str(v) for k, v in context.items() if v is not None}
    good = True
    for c in commands:
        try:
            good &= subprocess.run(["sh", "-c", interpolated(c, {k for k, v in context.items() if v is not None})], env=env, capture_output=True, timeout=timeout).returncode == 0
        except subprocess.TimeoutExpired:
            good = False
    return good


@dataclass
class Hooks:
    """Shell commands around builds; {{file}}, {{error}}, {{exitCode}} and {{timestamp}} stand for what happened."""

    on_change: list[str] = field(default_factory=list)
    on_build: list[str] = field(default_factory=list)
    on_error: list[str] = field(default_factory=list)
    timeout: float = 30.0

    def run(self, commands: list[str], **context: object) -> bool:
        return run_hooks(commands, context | {"timestamp": datetime.now(UTC).isoformat()}, self.timeout)


class Progress(StreamingQueryListener):
    """Hands each batch's progress to a function as it ends."""

    def __init__(self, tell: Callable[[dict], None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.tell({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.tell({"event": "progress", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.tell({"event": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell({"event": "ended", "id": str(event.id), "error": event.exception})


class Watch:
    """Output and cache of a watched corpus: versioned Parquet below one folder; readers take the newest of a path."""

    def __init__(self, spark: SparkSession, state: str, program: Program, on_build: Callable[[DataFrame, int], None] | None = None, hooks: Hooks | None = None, compact: int = COMPACT) -> None:
        self.spark, self.program, self.on_build, self.hooks = spark, program, on_build, hooks or Hooks()
        self.table = Versions(spark, f"{state}/output", STATE, compact)
        self.sources = Versions(spark, f"{state}/source", SOURCES, compact) if program.corpus else None

    def versions(self) -> DataFrame:
        return self.table.read()

    def current(self, columns: tuple[str, ...] = ("output", "source_hash", "patch_hash", "applied")) -> DataFrame:
        """path, output, source_hash, patch_hash, applied of every document, or path and some of these."""
        return self.table.newest(columns=("deleted", *columns)).filter(~F.col("deleted")).select("path", *columns)

    def _number(self, batch_id: int) -> int | None:
        """The version a batch is to be: of its own if it was built before and its version still stands, None if it doesn't."""
        last = self.table.read().agg(F.max("batch").alias("b"), F.min(F.when(F.col("batch") == batch_id, F.when(~F.col("swept"), F.col("version")))).alias("v")).first()
        if last["b"] is None or last["b"] < batch_id:
            return self.table.next()
        return last["v"] if last["b"] == batch_id and last["v"] is not None and last["v"] > self.table.base() else None

    def batch(self, df: DataFrame, batch_id: int) -> None:
        """Build what a batch brought and the state doesn't have. Running a batch again changes nothing more.

        Of several rows of a path the one with the latest `modified` counts, if there is such a column, else the greatest.
        """
        try:
            number = self._number(batch_id)
            if number is None:
                return
            order = F.struct("modified", "content") if "modified" in df.columns else F.struct("content")
            df = df.groupBy("path").agg(F.max_by(F.struct("content"), order).alias("c")).select("path", "c.content").withColumn("deleted", F.col("content").isNull())
            self._changed(df)
            self._write(df, number, batch_id)
            if self.on_build:
                self.on_build(self.table.version(number), batch_id)
        except Exception as e:
            self.hooks.run(self.hooks.on_error, error=e, exitCode=1)
            raise
        self.hooks.run(self.hooks.on_build, exitCode=0)

    def _write(self, df: DataFrame, number: int, batch_id: int, swept: bool = False) -> None:
        mark = lambda rows: rows.withColumn("batch", F.lit(batch_id).cast("long")).withColumn("swept", F.lit(swept))
        self.table.write(mark(self._rebuilt(df, number) if self.sources else self._fresh(df, number)), number)

    def _changed(self, df: DataFrame) -> None:
        """One call a batch, whatever its size: {{file}} is the first path, {{files}} their number."""
        if self.hooks.on_change:
            told = df.agg(F.min("path").alias("file"), F.count("*").alias("files")).first()
            if told["files"]:
                self.hooks.run(self.hooks.on_change, file=told["file"], files=told["files"])

    def _built(self, df: DataFrame, number: int) -> DataFrame:
        out = build(df.select("path", "content", F.sha2("content", 256).alias("source_hash")), self.program)
        return out.select("path", F.col("content").alias("output"), "source_hash", signature(self.program, F.col("path")).alias("patch_hash"), F.col("applied").cast("int").alias("applied"), F.lit(False).alias("deleted"), F.lit(number).cast("long").alias("version"))

    def _gone(self, paths: DataFrame, number: int) -> DataFrame:
        null = F.lit(None).cast("string")
        return paths.select("path", null.alias("output"), null.alias("source_hash"), null.alias("patch_hash"), F.lit(0).alias("applied"), F.lit(True).alias("deleted"), F.lit(number).cast("long").alias("version"))

    def _fresh(self, df: DataFrame, number: int) -> DataFrame:
        known = self.table.newest(before=number, columns=("source_hash", "patch_hash")).select("path", F.col("source_hash").alias("_s"), F.col("patch_hash").alias("_p"))
        fresh = df.filter(~F.col("deleted")).withColumn("_h", F.sha2("content", 256)).join(known, "path", "left")
        fresh = fresh.filter(F.col("_s").isNull() | (F.col("_s") != F.col("_h")) | (F.col("_p") != signature(self.program, F.col("path")))).select("path", "content")
        return self._built(fresh, number).unionByName(self._gone(df.filter("deleted"), number))

    def _rebuilt(self, df: DataFrame, number: int) -> DataFrame:
        self.sources.write(df.select("path", "content", "deleted", F.lit(number).cast("long").alias("version")), number)
        everything = self.sources.newest(columns=("content", "deleted")).filter(~F.col("deleted")).select("path", "content")
        done = self._built(everything, number)
        old = self.table.newest(before=number, columns=("deleted",)).filter(~F.col("deleted")).select("path").join(done.select("path"), "path", "left_anti")
        return done.unionByName(self._gone(old, number))

    def sweep(self, existing: DataFrame) -> DataFrame:
        """Drop what a listing (path) no longer has; the paths dropped. Call it between runs of the stream."""
        last = self.table.read().agg(F.max("batch")).first()[0]
        number = self.table.next()
        if last is not None:
            known = (self.sources or self.table).newest(columns=("deleted",)).filter(~F.col("deleted")).select("path")
            gone = known.join(existing.select("path"), "path", "left_anti").withColumn("content", F.lit(None).cast("string")).withColumn("deleted", F.lit(True))
            self._write(gone, number, last, swept=True)
        return self.table.version(number).filter("deleted").select("path")

    def start(self, source: DataFrame, checkpoint: str, every: str = "300 milliseconds", once: bool = False, quiet: int | None = None) -> StreamingQuery:
        """Changes that come within `every` make one batch. With `quiet`, a path's changes wait until none came for so many
        milliseconds, and the last one is built; not with `once`, which waits for nothing."""
        if quiet and not once:
            source = debounced(source, quiet)
        writer = source.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def stream_files(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """path (relative to the folder), content, modified of files as they come or change."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select(relative_path(folder).alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified"))


def stream_table(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """A corpus that arrives as Parquet files."""
    return spark.readStream.schema(schema).parquet(folder)
