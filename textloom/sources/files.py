"""Corpora in and out: scans, resource selection, overlays, and sinks."""

from __future__ import annotations

import contextlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.codecs import yaml_load
from textloom.functions.patterns import glob_regex, is_glob
from textloom.plans.spec import relative
from textloom.sources.shared import shared_folder

SKIPPED = ("node_modules", ".git", "output")
EXTENSIONS = ("md",)
CONFIG_NAMES = ("config.yaml", "kustomization.yaml")
DEPTH = 10
#: Names of a batch of a listing, files that a task reads, and characters of a batch of contents.
LISTED, TASK_FILES, BATCH = 10_000, 2000, 4 << 20


def relative_path(folder: str) -> Column:
    """Path of the file that a row was read from, relative to the folder that was scanned."""
    root = folder.rstrip("/").split("://", 1)[-1].lstrip("/")
    url = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    return F.regexp_replace(url, rf"^[a-z0-9]+:/*\Q{root}\E/", "")


def local_root(folder: str) -> str | None:
    """The path of a folder that all executors share as a local one, None of any other."""
    root = re.sub(r"^file:(//)?(?=/)", "", folder).rstrip("/")
    return root if "://" not in root and os.path.isdir(root or "/") else None


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path (relative) of the files with these extensions below a shared folder, by tasks: a folder is a row, and those of one
    depth are listed at once. No content is read, and neither names nor folders pass through the driver.

    Folders that are skipped, and hidden names as Spark's readers know them, aren't there.
    """
    endings = tuple("." + x for x in extensions)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                names, inner = [], []
                with os.scandir(f"{root}/{folder}") as found:
                    for x in found:
                        name, deeper = x.name, x.is_dir()
                        hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
                        if hidden or (name in SKIPPED if deeper else not name.endswith(endings)):
                            continue
                        names.append(f"{folder}/{name}" if folder else name)
                        inner.append(deeper)
                        if len(names) == LISTED:
                            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(inner)], ["path", "folder"])
                            names, inner = [], []
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(inner)], ["path", "folder"])

    where, schema = shared_folder(spark, "listing"), "path string, folder boolean"
    cores, levels = spark.sparkContext.defaultParallelism, []
    front = spark.createDataFrame([("",)], "path string")
    while not levels or not front.isEmpty():
        levels.append(f"{where}/{len(levels)}")
        front.mapInArrow(walk, schema).write.parquet(levels[-1])
        front = spark.read.schema(schema).parquet(levels[-1]).filter("folder").select("path").repartition(4 * cores)
    return spark.read.schema(schema).parquet(*levels).filter(~F.col("folder")).select("path")


def read_contents(rows: DataFrame, n: int) -> DataFrame:
    """n rows (path, root, content, ...) with content of the files that lie below a root, by tasks of TASK_FILES rows; rows
    without a root keep theirs."""
    fields = rows.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, began = [], 0, 0
            for k, (path, root, text) in enumerate(zip(*(batch.column(fields.index(c)).to_pylist() for c in ("path", "root", "content")), strict=True), 1):
                if root is not None:
                    with open(f"{root}/{path}", "rb") as f:
                        text = f.read().decode("utf-8", "replace")
                texts.append(text)
                size += len(text or "")
                if size >= BATCH or k == batch.num_rows:
                    part = batch.slice(began, k - began)
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "content" else part.column(i) for i, c in enumerate(fields)], fields)
                    texts, size, began = [], 0, k

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, n // TASK_FILES)
    return rows.repartition(tasks).mapInArrow(read, rows.schema)


def read_corpus(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path (relative), content of all files with these extensions, whatever file system the folder is on.

    Files of a shared local folder are listed and read by tasks, TASK_FILES each: Spark's reader counts every file as 4 MB, so
    it makes a task of each 32, and its driver holds the status of all.
    """
    root = local_root(folder)
    if root is not None:
        listing = list_files(spark, root, extensions)
        rows = listing.select("path", F.lit(root).alias("root"), F.lit(None).cast("string").alias("content"))
        return read_contents(rows, listing.count()).select("path", "content")
    glob = "*." + (extensions[0] if len(extensions) == 1 else "{" + ",".join(extensions) + "}")
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    path = relative_path(folder)
    out = files.select(path.alias("path"), F.col("value").alias("content"))
    return out.filter(~path.rlike(rf"(^|/)({'|'.join(x.replace('.', chr(92) + '.') for x in SKIPPED)})/"))


def dealt(df: DataFrame) -> DataFrame:
    """Rows over all cores where a scan has fewer tasks than those, as of a table in one row group; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def resource_test(resources: list[str], path: Column, base: str = "") -> Column:
    """Whether any resource selects a path and no negation takes it out."""
    some, none = F.lit(False), F.lit(False)
    for r in resources:
        r = r.strip()
        negated = r.startswith("!") and not r.startswith("!(")
        pattern = r.removeprefix("!") if negated else r
        full = f"{base}/{pattern}" if base else pattern
        hit = path.rlike(glob_regex(full, True)) if is_glob(full) else path == relative(full)
        some, none = (some, none | hit) if negated else (some | hit, none)
    return some & ~none


def select_resources(corpus: DataFrame, resources: list[str], base: str = "") -> DataFrame:
    return corpus.filter(resource_test(resources, F.col("path"), base))


def last_wins(df: DataFrame, order: str) -> DataFrame:
    """One row a path: the one with the highest order."""
    rest = [c for c in df.columns if c not in ("path", order)]
    best = df.groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select("path", *(F.col(f"_r.{c}").alias(c) for c in rest))


def overlay(spark: SparkSession, config_path: str, *, cache: str | None = None, lock: dict[str, dict] | None = None, chain: bool = False, contents: bool = True, **remote: object) -> DataFrame:
    """The corpus that a configuration's resources name: globs, exact paths, archives and repositories, and folders with
    configurations of their own.

    A base's patches never apply, only its resources. Of one path local files win over what bases and then remote resources
    have, and later ones of each over earlier ones. Remote resources are kept in `cache`, a folder that all executors share;
    `lock` pins them and takes their new entries. More options as in fetch.resolved. chain: also `chain`, the configurations
    through which each document came, from the one that names it to this one.

    Folders are listed, and only what wins of a path is read, once. contents: without, there is no `content`, and no local
    file is opened.
    """
    columns = ["path"] + ["content"] * contents + ["chain"] * chain
    out = named(spark, config_path, 0, (), cache, lock, remote)
    if out is None:
        return spark.createDataFrame([], NAMED).select(*columns)
    return (read_contents(out, out.count()) if contents else out).select(*columns)


#: A document by its name: the local folder that its file is in, or its content where it is none.
NAMED = "path string, root string, content string, chain array<string>"


def named(spark: SparkSession, config_path: str, depth: int, seen: tuple[str, ...], cache: str | None, lock: dict[str, dict] | None, remote: dict[str, object]) -> DataFrame | None:
    """The documents of a configuration as NAMED, one a path; None if it has no resources."""
    from textloom.sources import fetch
    from textloom.sources.remote import archive_url, git_url

    folder = str(Path(config_path).resolve().parent)
    if folder in seen or depth > DEPTH:
        raise ValueError(f"configurations refer to each other: {' -> '.join((*seen, folder))}")
    config = yaml_load(Path(config_path).read_text())
    plain, parts, far = [], [], []
    own, none = F.array(F.lit(str(Path(config_path).resolve()))), F.lit(None).cast("string")
    for entry in config["resources"]:
        name = entry["url"] if isinstance(entry, dict) else entry
        nested = next((str(p) for c in CONFIG_NAMES if (p := Path(folder, name, c)).exists()), None) if not is_glob(name) else None
        if nested:
            base = named(spark, nested, depth + 1, (*seen, folder), cache, lock, remote)
            parts += [base.withColumn("chain", F.concat("chain", own))] if base is not None else []
        elif not name.startswith("!") and (archive_url(name) or git_url(name)):
            far.append(entry)
        else:
            plain.append(name)
    if any(not x.startswith("!") for x in plain):
        parts.append(select_resources(list_files(spark, folder), plain).select("path", F.lit(folder).alias("root"), none.alias("content"), own.alias("chain")))
    out = None
    if far:
        if cache is None:
            raise ValueError("remote resources need a cache folder")
        fetched, entries = fetch.resolved(spark, far, cache, security=config.get("security"), lock=lock, **remote)
        if lock is not None:
            lock.update(entries)
        out = fetched.select("path", none.alias("root"), "content", own.alias("chain"), (F.col("place") - len(far)).alias("_k"))
    for k, part in enumerate(parts):
        part = part.withColumn("_k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return None
    out = last_wins(out, "_k")
    gone = [x for x in plain if x.startswith("!")]
    return out.filter(~resource_test([x[1:] for x in gone], F.col("path"))) if gone else out


def write_files(df: DataFrame, folder: str) -> None:
    """One file a row below a folder that all executors share. A retried task writes the same files again."""
    import pandas as pd

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: set[str] = set()  # folders of this task
        for frame in batches:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                target = os.path.join(folder, relative(path))
                if (parent := os.path.dirname(target)) not in made:
                    os.makedirs(parent, exist_ok=True)
                    made.add(parent)
                with open(target, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
            yield frame[["path"]]

    df.select("path", "content").mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()


def clean(folder: str, result: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, delete: bool = True) -> DataFrame:
    """Paths below an output folder that a build's result doesn't have; their files are deleted, unless only asked for.

    The folder is one that all executors share. A retried task finds its files gone, which is fine.
    """
    import pandas as pd

    root = local_root(folder)
    gone = leftovers(read_corpus(result.sparkSession, folder, extensions) if root is None else list_files(result.sparkSession, root, extensions), result)
    if not delete:
        return gone
    root = root or folder.removeprefix("file://")

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for path in frame["path"]:
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(os.path.join(root, relative(path)))
            yield frame

    listing = shared_folder(result.sparkSession, "cleaned")
    gone.write.parquet(listing)  # first the list, which a lost task finds again, then the files
    listed = result.sparkSession.read.schema("path string").parquet(listing)
    listed.mapInPandas(remove, "path string").write.format("noop").mode("overwrite").save()
    return listed


def leftovers(existing: DataFrame, result: DataFrame) -> DataFrame:
    """Paths that a clean build would delete."""
    return existing.select("path").join(result.select("path"), "path", "left_anti")


def write_table(df: DataFrame, path: str, buckets: int | None = None, key: str = "path") -> None:
    """A corpus as Parquet, dealt by path if asked."""
    (df.repartition(buckets, key) if buckets else df).write.mode("overwrite").parquet(path)
