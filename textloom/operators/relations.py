"""Documents as relations: lines, sections, tables, lists, links, code blocks and frontmatter, one row each.

Lines, sections, links and blocks are array expressions that explode; table, list and frontmatter parsing runs in Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.codecs import split_frontmatter
from textloom.operators import md, native


def lines(df: DataFrame) -> DataFrame:
    """path, line (0-based), text."""
    return df.select("path", F.posexplode(native.lines_of(F.col("content"))).alias("line", "text"))


def sections(df: DataFrame) -> DataFrame:
    """path, ord, id, level, start_line, end_line (exclusive), title."""
    df = df.select("path", native.lines_of(F.col("content")).alias("_lines"))
    df = df.withColumn("_heads", native.heads_of(F.col("_lines")))
    df = df.select("path", F.posexplode(native.sections_of(F.col("_lines"), F.col("_heads"))).alias("ord", "s"))
    return df.select("path", "ord", F.col("s.id").alias("id"), F.col("s.level").alias("level"), F.col("s.start").alias("start_line"), F.col("s.end").alias("end_line"), F.col("s.title").alias("title"))


def links(df: DataFrame) -> DataFrame:
    """path, ord, text, url."""
    pattern = r"\[([^\]]*)\]\(([^)]*)\)"
    found = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), 1).alias("text"), F.regexp_extract_all("content", F.lit(pattern), 2).alias("url"))
    return df.select("path", F.posexplode(found).alias("ord", "l")).select("path", "ord", F.col("l.text").alias("text"), F.col("l.url").alias("url"))


def code_blocks(df: DataFrame) -> DataFrame:
    """path, ord, language, body."""
    pattern = r"(?m)^(`{3,}|~{3,})([^\n]*)\n([\s\S]*?)\n?\1\s*$"
    found = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), 2).alias("language"), F.regexp_extract_all("content", F.lit(pattern), 3).alias("body"))
    return df.select("path", F.posexplode(found).alias("ord", "b")).select("path", "ord", F.trim("b.language").alias("language"), F.col("b.body").alias("body"))


def _parsed(df: DataFrame, function, schema: str) -> DataFrame:
    @F.pandas_udf(f"array<{schema}>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for content in batches:
            yield content.map(function)

    return df.select("path", F.posexplode(parse("content")).alias("ord", "x")).select("path", "ord", "x.*")


def tables(df: DataFrame) -> DataFrame:
    """path, ord, start_line, end_line (inclusive), headers, alignments, rows."""
    parse = lambda text: [{"start_line": t.start, "end_line": t.end, "headers": t.headers, "alignments": t.alignments, "rows": t.rows} for t in md.tables(text.split("\n"))]
    return _parsed(df, parse, "struct<start_line:int,end_line:int,headers:array<string>,alignments:array<string>,rows:array<array<string>>>")


def table_rows(df: DataFrame) -> DataFrame:
    """path, ord, row, cells."""
    return tables(df).select("path", "ord", F.posexplode("rows").alias("row", "cells"))


def table_cells(df: DataFrame) -> DataFrame:
    """path, ord, row, header, value."""
    rows = tables(df).select("path", "ord", "headers", F.posexplode("rows").alias("row", "cells"))
    return rows.select("path", "ord", "row", F.explode(F.arrays_zip(F.col("headers").alias("header"), F.col("cells").alias("value"))).alias("c")).select("path", "ord", "row", F.col("c.header").alias("header"), F.col("c.value").alias("value"))


def list_items(df: DataFrame) -> DataFrame:
    """path, ord (of the list), item, text, is_task, checked, start_line, end_line."""
    parse = lambda text: [{"ordered": x.ordered, "items": [i._asdict() for i in x.items]} for x in md.lists(text.split("\n"))]
    out = _parsed(df, parse, "struct<ordered:boolean,items:array<struct<text:string,is_task:boolean,checked:boolean,start:int,end:int>>>")
    return out.select("path", "ord", "ordered", F.posexplode("items").alias("item", "i")).select("path", "ord", "ordered", "item", F.col("i.text").alias("text"), F.col("i.is_task").alias("is_task"), F.col("i.checked").alias("checked"), F.col("i.start").alias("start_line"), F.col("i.end").alias("end_line"))


def frontmatter(df: DataFrame) -> DataFrame:
    """path, data (JSON text; null without a block)."""

    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            data, _, there = split_frontmatter(text)
            return json.dumps(data, ensure_ascii=False, default=str) if there else None

        return content.map(one)

    return df.select("path", read("content").alias("data"))
