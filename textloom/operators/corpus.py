"""Corpus operators: patches that add, move, rename, rewrite and drop documents by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.patterns import glob_regex, is_glob
from textloom.plans.spec import relative


def path_matches(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob)) if is_glob(glob) else path == glob


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def folder_of(path: Column) -> Column:
    """The folder with its slash, or nothing."""
    return F.regexp_extract(path, r"\A(.*/)?", 1)


def copy_file(df: DataFrame, src: str, dest: str) -> DataFrame:
    """The document at src also at dest, replacing what was there."""
    src, dest = relative(src), relative(dest)
    if src == dest:
        return df
    copies = df.filter(F.col("path") == src).withColumn("path", F.lit(dest))
    rest = df.join(copies.select("path").distinct(), "path", "left_anti").select(*df.columns)
    return rest.unionByName(copies)


def landed(df: DataFrame, hit: Column, to: Column, could: Column) -> DataFrame:
    """df with the documents that are hit at other paths, one document a path.

    Of those that land on one path the last in order of their old paths stays, instead of what was there. `could`: whether
    a document that stays put could be in the way; only such documents are compared with the new paths.
    """
    hit = F.coalesce(hit, F.lit(False))
    columns = df.columns
    moved = df.filter(hit).withColumn("_old", F.col("path")).withColumn("path", to)
    last = moved.groupBy("path").agg(F.max_by(F.struct(*(c for c in columns if c != "path")), "_old").alias("_d")).select(*(F.col("path") if c == "path" else F.col(f"_d.{c}").alias(c) for c in columns))
    rest = df.filter(~hit)
    near = F.coalesce(could, F.lit(False))
    clear = rest.filter(near).join(moved.select("path").distinct(), "path", "left_anti").select(*columns)
    return rest.filter(~near).unionByName(clear).unionByName(last)


def rename_file(df: DataFrame, match: str, rename: str) -> DataFrame:
    """Matching documents get another name in their folder."""
    if "/" in rename or "\\" in rename or ".." in rename:
        raise ValueError(f"not a file name: {rename}")
    path = F.col("path")
    return landed(df, path_matches(path, match), F.concat(folder_of(path), F.lit(rename)), name_of(path) == rename)


def delete_file(df: DataFrame, match: str) -> DataFrame:
    return df.filter(~path_matches(F.col("path"), match))


def move_file(df: DataFrame, match: str, dest: str) -> DataFrame:
    """Matching documents go to another folder under their name."""
    folder, path = relative(dest), F.col("path")
    prefix = folder + "/" if folder else ""
    return landed(df, path_matches(path, match), F.concat(F.lit(prefix), name_of(path)), folder_of(path) == prefix)


def write_file(df: DataFrame, path: str, content: str) -> DataFrame:
    """A document with this content, new or instead of what the path held."""
    path = relative(path)
    new = df.sparkSession.createDataFrame([(path, content)], "path string, content string")
    return df.filter(F.col("path") != path).unionByName(new, allowMissingColumns=True)


APPLY = {"copy-file": copy_file, "rename-file": rename_file, "delete-file": delete_file, "move-file": move_file, "write-file": write_file}


def apply_corpus(df: DataFrame, patches: list[dict]) -> DataFrame:
    """Corpus patches in order. Where two documents end on one path, the one renamed or moved there last stays."""
    fields = {"copy-file": ("src", "dest"), "rename-file": ("match", "rename"), "delete-file": ("match",), "move-file": ("match", "dest"), "write-file": ("path", "content")}
    for p in patches:
        df = APPLY[p["op"]](df, *(p[k] for k in fields[p["op"]]))
    return df
