"""Queries of the engine's own operators over the driver's tables, each with its SQL.

Structured operators need markdown, which the tables don't hold: every document's columns fill one template. The expected
result of an operator is then another template, written down line by line and so independent of any parser.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import values
from textloom.operators import corpus as corpus_ops
from textloom.operators import md, native, relations
from textloom.plans import analytics, build, checks, preview, recover, reports, stores, suggest
from textloom.plans.planner import program
from textloom.sources.files import dealt
from textloom.sources.shared import shared_folder

TEMPLATE = """---
title: Doc {id}
lang: {lang}
tags:
  - a
---
# Document {id}

## Summary

{n} characters of text.

### Detail

from {source}

## Data

| key | value |
| --- | --- |
| source | {source} |
| chars | {n} |
| lang | {lang} |
| lang | {lang} |

## Links

- [home](https://example.com/{id})
- plain
- [x] done
- plain

<!-- TOC -->
old
<!-- /TOC -->

```js
let x = {id};
```
""".split("\n")
COLUMNS = {"id": "doc_id", "lang": "lang", "source": "source", "n": "n_chars"}
TABLE, LIST = 18, 27  # lines of the template at which its table and its list begin


def filled(lines: list[str]) -> Column:
    """The lines' text as a column."""
    if not "".join(lines):
        return F.lit("\n" * (len(lines) - 1))
    parts: list[Column] = []
    for literal, name in _pieces("\n".join(lines)):
        parts += [F.lit(literal)] if literal else []
        parts += [F.col(COLUMNS[name]).cast("string")] if name else []
    return F.concat(*parts)


def filled_sql(lines: list[str]) -> str:
    """The same as SQL."""
    out = []
    for literal, name in _pieces("\n".join(lines)):
        if literal:
            out.append("'" + literal.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        if name:
            out.append(f"CAST({COLUMNS[name]} AS VARCHAR)")
    return " || ".join(out)


def _pieces(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        found = min(((text.find("{" + k + "}", at), k) for k in COLUMNS if text.find("{" + k + "}", at) >= 0), default=(len(text), ""))
        out.append((text[at : found[0]], found[1]))
        at = found[0] + len(found[1]) + 2
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, doc_id: one markdown document a row of documents."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"))
    return docs.select(path_column().alias("path"), filled(TEMPLATE).alias("content"), "doc_id")


def path_column() -> Column:
    return F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))


PATH_SQL = "lang || '/' || source || '/doc_' || CAST(doc_id AS VARCHAR) || '.md'"


def edit(start: int, end: int, *new: str) -> list[str]:
    """The template with lines start to end (exclusive) replaced."""
    return [*TEMPLATE[:start], *new, *TEMPLATE[end:]]


def rows(*order: str) -> list[str]:
    """The template with other table rows."""
    return edit(TABLE + 2, TABLE + 6, *order)


SOURCE, CHARS, LANG = "| source | {source} |", "| chars | {n} |", "| lang | {lang} |"
HOME, PLAIN, DONE = "- [home](https://example.com/{id})", "- plain", "- [x] done"
HEAD, RULE = "| key | value |", "| --- | --- |"
#: Name, patch, and the lines that it leaves.
PATCHES: list[tuple[str, dict[str, Any], list[str]]] = [
    ("replace", {"op": "replace", "old": "plain", "new": "simple"}, [x.replace("plain", "simple") for x in TEMPLATE]),
    ("replace_regex", {"op": "replace-regex", "pattern": r"^(#+) (\w)", "replacement": "$1 *$2", "flags": "gm"}, [x[: x.index(" ") + 1] + "*" + x[x.index(" ") + 1 :] if x.startswith("#") else x for x in TEMPLATE]),
    ("prepend_to_file", {"op": "prepend-to-file", "content": "top\n"}, ["top", *TEMPLATE]),
    ("append_to_file", {"op": "append-to-file", "content": "end"}, [*TEMPLATE[:-1], "end"]),
    ("replace_code_block", {"op": "replace-code-block", "index": 0, "content": "let y;\n", "language": "ts"}, edit(36, 40, "```ts", "let y;", "```")),
    ("modify_links", {"op": "modify-links", "textMatch": "home", "urlPattern": "^https://example\\.com/", "urlReplacement": "/d/"}, edit(27, 28, "- [home](/d/{id})")),
    ("replace_line", {"op": "replace-line", "match": "- plain", "replacement": "- line"}, [x.replace("- plain", "- line") for x in TEMPLATE]),
    ("insert_after_line", {"op": "insert-after-line", "match": "## Data", "content": "new"}, edit(17, 17, "new")),
    ("insert_before_line", {"op": "insert-before-line", "pattern": "^from ", "regex": True, "content": "new"}, edit(14, 14, "new")),
    ("delete_between", {"op": "delete-between", "start": "<!-- TOC", "end": "<!-- /TOC"}, edit(32, 35)),
    ("replace_between", {"op": "replace-between", "start": "<!-- TOC", "end": "<!-- /TOC", "content": "a\nb", "inclusive": False}, edit(33, 34, "a", "b")),
    ("remove_section", {"op": "remove-section", "id": "summary"}, edit(8, 16)),
    ("remove_section_only", {"op": "remove-section", "id": "summary", "includeChildren": False}, edit(8, 12)),
    ("replace_section", {"op": "replace-section", "id": "summary", "content": "short"}, edit(9, 16, "short")),
    ("prepend_to_section", {"op": "prepend-to-section", "id": "data", "content": "new"}, edit(17, 17, "new")),
    ("append_to_section", {"op": "append-to-section", "id": "summary", "content": "new"}, edit(16, 16, "new")),
    ("replace_in_section", {"op": "replace-in-section", "id": "links", "old": "plain", "new": "x"}, edit(27, 31, HOME, "- x", DONE, "- x")),
    ("rename_header", {"op": "rename-header", "id": "data", "new": "Facts"}, edit(16, 17, "## Facts")),
    ("move_section", {"op": "move-section", "id": "summary", "after": "data"}, [*TEMPLATE[:8], *TEMPLATE[16:25], *TEMPLATE[8:16], *TEMPLATE[25:]]),
    ("move_section_back", {"op": "move-section", "id": "links", "after": "summary"}, [*TEMPLATE[:16], *TEMPLATE[25:], *TEMPLATE[16:25]]),
    ("change_section_level", {"op": "change-section-level", "id": "detail", "delta": 9}, edit(12, 13, "###### Detail")),
    ("insert_section", {"op": "insert-section", "id": "data", "header": "## Notes", "content": "none\n", "position": "before"}, edit(16, 16, "## Notes", "", "none", "")),
    ("update_toc", {"op": "update-toc", "ordered": True}, edit(33, 34, "1. [Summary](#summary)", "  1. [Detail](#detail)", "2. [Data](#data)", "3. [Links](#links)")),
    ("set_frontmatter", {"op": "set-frontmatter", "key": "meta.kind", "value": "doc"}, edit(5, 5, "meta:", "  kind: doc")),
    ("remove_frontmatter", {"op": "remove-frontmatter", "key": "tags"}, edit(3, 5)),
    ("rename_frontmatter", {"op": "rename-frontmatter", "old": "title", "new": "name"}, edit(1, 5, *TEMPLATE[2:5], "name: Doc {id}")),
    ("merge_frontmatter", {"op": "merge-frontmatter", "values": {"lang": "xx", "draft": True}}, edit(2, 5, "lang: xx", *TEMPLATE[3:5], "draft: true")),
    ("replace_table_cell", {"op": "replace-table-cell", "table": "data", "row": {"column": "key", "value": "chars"}, "column": "value", "content": "0"}, rows(SOURCE, "| chars | 0 |", LANG, LANG)),
    ("add_table_row", {"op": "add-table-row", "table": "data", "values": ["new"], "position": 1}, rows(SOURCE, "| new |  |", CHARS, LANG, LANG)),
    ("remove_table_row", {"op": "remove-table-row", "table": TABLE, "row": 0}, rows(CHARS, LANG, LANG)),
    ("add_table_column", {"op": "add-table-column", "table": "data", "header": "unit", "defaultValue": "-"}, edit(TABLE, TABLE + 6, HEAD + " unit |", RULE + " --- |", *(x + " - |" for x in (SOURCE, CHARS, LANG, LANG)))),
    ("remove_table_column", {"op": "remove-table-column", "table": "data", "column": "value"}, edit(TABLE, TABLE + 6, "| key |", "| --- |", "| source |", "| chars |", "| lang |", "| lang |")),
    ("rename_table_column", {"op": "rename-table-column", "table": "data", "column": 1, "new": "what"}, edit(TABLE, TABLE + 1, "| key | what |")),
    ("reorder_table_columns", {"op": "reorder-table-columns", "table": "data", "columns": ["value", "key"]}, edit(TABLE, TABLE + 6, "| value | key |", RULE, "| {source} | source |", "| {n} | chars |", "| {lang} | lang |", "| {lang} | lang |")),
    ("sort_table", {"op": "sort-table", "table": "data", "column": "key", "direction": "desc"}, rows(SOURCE, LANG, LANG, CHARS)),
    ("filter_table_rows", {"op": "filter-table-rows", "table": "data", "column": "key", "pattern": "^l", "invert": True}, rows(SOURCE, CHARS)),
    ("deduplicate_table_rows", {"op": "deduplicate-table-rows", "table": "data", "keep": "last"}, rows(SOURCE, CHARS, LANG)),
    ("add_list_item", {"op": "add-list-item", "list": "links", "item": "new", "position": 1}, edit(28, 28, "- new")),
    ("remove_list_item", {"op": "remove-list-item", "list": "links", "item": "done"}, edit(29, 30)),
    ("set_list_item", {"op": "set-list-item", "list": "links", "item": "done", "new": "ready"}, edit(29, 30, "- [x] ready")),
    ("sort_list", {"op": "sort-list", "list": "links", "direction": "desc"}, edit(27, 31, PLAIN, PLAIN, DONE, HOME)),
    ("filter_list_items", {"op": "filter-list-items", "list": "links", "match": "plain"}, edit(27, 31, PLAIN, PLAIN)),
    ("deduplicate_list_items", {"op": "deduplicate-list-items", "list": "links"}, edit(30, 31)),
    ("reorder_list_items", {"op": "reorder-list-items", "list": "links", "order": [3, 2, 1, 0]}, edit(27, 31, PLAIN, DONE, PLAIN, HOME)),
]


#: Documents of other shapes: without structure; with carriage returns, so without any header, table or list that ends its
#: line; with fences that hold a header and a list, a header with an id of its own, an ordered list, a ragged table; empty.
BARE = ["# Note {id}", "", "plain words from {source}", ""]
RETURNS = ["---\r", "lang: {lang}\r", "---\r", "## Data\r", "\r", "| key | value |\r", "| --- | --- |\r", "| lang | {lang} |\r", "\r", "- plain\r", "- [x] done\r", ""]
FENCED = ["```md", "## Summary", "- plain", "| key |", "```", "", "## Links {#links}", "", "1. plain", "2. done", "   more {id}", "", "## Data", "", "| key | v |", "|:--|--:|", "| lang | a |", "| b | ", "~~~js", "let x;", "~~~", ""]
SHAPES = [TEMPLATE, BARE, RETURNS, FENCED, [""]]
KIND, MERGED = ("---", "meta:", "  kind: doc", "---"), ("---", "lang: xx", "draft: true", "---")
WRITTEN = "| :--- | ---: |"
#: What patches do to those shapes: edits (first line, line after the last, new lines), from the last line to the first. A
#: shape that isn't named has no match.
OTHERS: dict[str, dict[int, list[tuple]]] = {
    "replace": {1: [(2, 3, "simple words from {source}")], 2: [(9, 10, "- simple\r")], 3: [(8, 9, "1. simple"), (2, 3, "- simple")]},
    "replace_regex": {1: [(0, 1, "# *Note {id}")], 2: [(3, 4, "## *Data\r")], 3: [(12, 13, "## *Data"), (6, 7, "## *Links {#links}"), (1, 2, "## *Summary")]},
    "prepend_to_file": {k: [(0, 0, "top")] for k in (1, 2, 3, 4)},
    "append_to_file": {1: [(3, 4, "end")], 2: [(11, 12, "end")], 3: [(21, 22, "end")], 4: [(0, 1, "end")]},
    "replace_code_block": {3: [(0, 6, "```ts", "let y;", "```")]},
    "replace_line": {3: [(2, 3, "- line")]},
    "insert_after_line": {3: [(13, 13, "new")]},
    "remove_section": {3: [(1, 6)]},
    "remove_section_only": {3: [(1, 6)]},
    "replace_section": {3: [(2, 6, "short")]},
    "prepend_to_section": {3: [(13, 13, "new")]},
    "append_to_section": {3: [(6, 6, "new")]},
    "replace_in_section": {3: [(8, 9, "1. x")]},
    "rename_header": {3: [(12, 13, "## Facts")]},
    "move_section": {3: [(22, 22, "## Summary", "- plain", "| key |", "```", ""), (1, 6)]},
    "move_section_back": {3: []},
    "insert_section": {3: [(12, 12, "## Notes", "", "none", "")]},
    "set_frontmatter": {k: [(0, 0, *KIND)] for k in (1, 2, 3, 4)},
    "merge_frontmatter": {k: [(0, 0, *MERGED)] for k in (1, 2, 3, 4)},
    "add_table_row": {3: [(17, 17, "| new |  |"), (15, 16, WRITTEN)]},
    "add_table_column": {3: [(14, 17, "| key | v | unit |", WRITTEN + " --- |", "| lang | a | - |")]},
    "rename_table_column": {3: [(14, 16, "| key | what |", WRITTEN)]},
    "sort_table": {3: [(15, 16, WRITTEN)]},
    "filter_table_rows": {3: [(15, 17, WRITTEN)]},
    "add_list_item": {3: [(9, 9, "1. new")]},
    "remove_list_item": {3: [(9, 11)]},
    "set_list_item": {3: [(9, 10, "1. ready")]},
    "sort_list": {3: []},
    "filter_list_items": {3: [(9, 11)]},
}


def changed_shape(k: int, edits: list[tuple]) -> list[str]:
    out = list(SHAPES[k])
    for start, end, *new in edits:
        out[start:end] = new
    return out


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, doc_id: documents of all shapes, by their id."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"))
    content = filled(TEMPLATE)
    for k in range(1, len(SHAPES)):
        content = F.when(F.col("doc_id") % len(SHAPES) == k, filled(SHAPES[k])).otherwise(content)
    return docs.select(path_column().alias("path"), content.alias("content"), "doc_id")


def patch_query(patch: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build.apply_patches(shapes(spark, sf_dir), [patch])
        return out.select("doc_id", "content", F.col("applied").cast("long").alias("applied"), F.size("warnings").cast("long").alias("warnings"))

    return run


def patch_sql(name: str, lines: list[str]) -> str:
    some = OTHERS.get(name, {})
    cases = " ".join(f"WHEN {k} THEN {filled_sql(changed_shape(k, some.get(k, []))) or repr('')}" for k in range(1, len(SHAPES)))
    hit = f"doc_id % {len(SHAPES)} IN ({', '.join(map(str, [0, *some]))})"
    return f"SELECT doc_id, CASE doc_id % {len(SHAPES)} {cases} ELSE {filled_sql(lines)} END AS content, CAST(CASE WHEN {hit} THEN 1 ELSE 0 END AS BIGINT) AS applied, CAST(CASE WHEN {hit} THEN 0 ELSE 1 END AS BIGINT) AS warnings FROM documents"


# Text and line patches on the documents' own texts, with counts.


def text_query(patch: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
        new, n = native.build(patch, F.col("text"))
        return docs.select("doc_id", new.alias("content"), n.cast("long").alias("n"))

    return run


LINES_SQL = "string_split(text, chr(10))"
TEXT: list[tuple[str, dict, str]] = [
    ("text_replace", {"op": "replace", "old": "the", "new": "THE"}, "SELECT doc_id, replace(text, 'the', 'THE') AS content, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM documents"),
    ("text_replace_regex", {"op": "replace-regex", "pattern": "([a-z])ing\\b", "replacement": "$1<$&>"}, "SELECT doc_id, regexp_replace(text, '([a-z])ing\\b', '\\1<\\0>', 'g') AS content, CAST(len(regexp_extract_all(text, '[a-z]ing\\b')) AS BIGINT) AS n FROM documents"),
    ("text_insert_before_line", {"op": "insert-before-line", "pattern": "^The ", "regex": True, "content": "~"}, f"SELECT doc_id, array_to_string(list_transform({LINES_SQL}, lambda l: CASE WHEN starts_with(l, 'The ') THEN '~' || chr(10) || l ELSE l END), chr(10)) AS content, CAST(len(list_filter({LINES_SQL}, lambda l: starts_with(l, 'The '))) AS BIGINT) AS n FROM documents"),
    ("text_insert_after_line", {"op": "insert-after-line", "pattern": "\\.$", "regex": True, "content": "~"}, f"SELECT doc_id, array_to_string(list_transform({LINES_SQL}, lambda l: CASE WHEN ends_with(l, '.') THEN l || chr(10) || '~' ELSE l END), chr(10)) AS content, CAST(len(list_filter({LINES_SQL}, lambda l: ends_with(l, '.'))) AS BIGINT) AS n FROM documents"),
]


# Predicates, validators and scalar functions.


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    one = {"allOf": [{"fileContains": "the"}, {"not": {"fileMatches": "/TOKEN/i"}}, {"anyOf": [{"fileContains": "|"}, {"fileMatches": "^The"}]}]}
    return docs.select("doc_id", checks.condition_column(one, F.col("text")).alias("holds"))


def frontmatter_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = {"op": "append-to-file", "content": "x", "when": {"frontmatterEquals": {"key": "lang", "value": "en"}}}
    out = build.apply_patches(corpus(spark, sf_dir), [patch])
    return out.select("doc_id", F.col("applied").cast("long").alias("applied"), F.col("skipped").cast("long").alias("skipped"))


def front_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions on the frontmatter of documents of all shapes, read once."""
    docs = build.fronted(shapes(spark, sf_dir), F.col("content"))
    english, titled = {"frontmatterEquals": {"key": "lang", "value": "en"}}, {"frontmatterExists": "title"}
    test = lambda c: checks.condition_column(c, F.col("content"))
    return docs.select("doc_id", test(english).alias("english"), test({"allOf": [{"not": english}, titled]}).alias("foreign_title"), test({"anyOf": [{"frontmatterExists": "tags"}, {"fileContains": "## Links"}]}).alias("tagged"))


FRONT_SQL = "SELECT doc_id, doc_id % 5 IN (0, 2) AND lang = 'en' AS english, doc_id % 5 = 0 AND lang <> 'en' AS foreign_title, doc_id % 5 IN (0, 3) AS tagged FROM documents"


def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"notContains": "password", "matchesRegex": "[a-z]", "minWordCount": 20, "maxLineCount": 40}
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.coalesce(checks.first_failure(rules, F.col("text")), F.lit("")).alias("failed"), F.size(checks.failure_array(rules, F.col("text"))).cast("long").alias("n"))


WORDS_SQL = "len(regexp_extract_all(text, '[^\\s]+'))"
LINE_COUNT_SQL = "CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", values.word_count(F.col("text")).cast("long").alias("words"), values.line_count(F.col("text")).cast("long").alias("lines"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", values.slug_of(F.concat("p_name", F.lit(" -- "), "p_type")).alias("slug"))


def fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three part types nearest to a mistyped one."""
    target = "STANDERT"
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("value")).distinct()
    d = F.levenshtein("value", F.lit(target))
    return types.select("value", d.cast("long").alias("distance")).orderBy("distance", "value").limit(3)


# Corpus patches.

CONTENT = filled_sql(TEMPLATE)


def landed_sql(hit: str, to: str) -> str:
    """One row a path: documents that are hit go first, the last of them in order of old paths."""
    return f"SELECT path, doc_id, content FROM (SELECT CASE WHEN {hit} THEN {to} ELSE path END AS path, doc_id, content, {hit} AS hit, path AS old FROM c) QUALIFY row_number() OVER (PARTITION BY path ORDER BY hit DESC, old DESC) = 1"


FILES: list[tuple[str, dict, str]] = [
    ("copy_file", {"op": "copy-file", "src": "en/src1/doc_1.md", "dest": "copy.md"}, "SELECT path, doc_id, content FROM c UNION ALL SELECT 'copy.md', doc_id, content FROM c WHERE path = 'en/src1/doc_1.md'"),
    ("rename_file", {"op": "rename-file", "match": "de/*/doc_*1.md", "rename": "one.md"}, landed_sql("regexp_full_match(path, 'de/[^/]*/doc_[^/]*1\\.md')", "regexp_replace(path, '[^/]*$', 'one.md')")),
    ("delete_file", {"op": "delete-file", "match": "{en,fr}/**"}, "SELECT path, doc_id, content FROM c WHERE NOT (path LIKE 'en/%' OR path LIKE 'fr/%')"),
    ("move_file", {"op": "move-file", "match": "**/src1?/*.md", "dest": "moved/here"}, landed_sql("regexp_full_match(path, '[^/]*/src1[0-9]/[^/]*\\.md')", "'moved/here/' || regexp_extract(path, '[^/]*$')")),
    ("write_file", {"op": "write-file", "path": "en/src1/doc_1.md", "content": "new"}, "SELECT path, doc_id, content FROM c WHERE path <> 'en/src1/doc_1.md' UNION ALL SELECT 'en/src1/doc_1.md', NULL, 'new'"),
]
CORPUS_SQL = f"WITH c AS (SELECT doc_id, lang, source, n_chars, {PATH_SQL} AS path FROM documents) "


def file_query(patch: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: corpus_ops.apply_corpus(corpus(spark, sf_dir), [patch]).select("path", "doc_id", "content")


# Embedded relations.


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relations.sections(shapes(spark, sf_dir))
    return out.select("path", "id", "title", *(F.col(c).cast("long").alias(c) for c in ("level", "start_line", "end_line")))


#: Parts of documents by shape: {id}, {lang}, {source} and {n} stand for their columns.
BY_SHAPE = {
    "sections": [(0, "document-{id}", "Document {id}", 1, 6, 40), (0, "summary", "Summary", 2, 8, 16), (0, "detail", "Detail", 3, 12, 16), (0, "data", "Data", 2, 16, 25), (0, "links", "Links", 2, 25, 40), (1, "note-{id}", "Note {id}", 1, 0, 4), (3, "summary", "Summary", 2, 1, 6), (3, "links", "Links", 2, 6, 12), (3, "data", "Data", 2, 12, 22)],
    "links": [(0, "home", "https://example.com/{id}")],
    "table_cells": [(0, 0, "key", "source"), (0, 0, "value", "{source}"), (0, 1, "key", "chars"), (0, 1, "value", "{n}"), *((0, r, h, v) for r in (2, 3) for h, v in (("key", "lang"), ("value", "{lang}"))), (2, 0, "key", "lang"), (2, 0, "value", "{lang}"), (3, 0, "key", "lang"), (3, 0, "v", "a")],
    "list_items": [
        *((0, 0, k, 27 + k, 27 + k, False, t, k == 2, k == 2) for k, t in enumerate(("[home](https://example.com/{id})", "plain", "done", "plain"))), (2, 0, 0, 9, 9, False, "plain\r", False, False), (2, 0, 1, 10, 10, False, "done\r", True, True),
        (3, 0, 0, 2, 4, False, "plain", False, False), (3, 1, 0, 8, 8, True, "plain", False, False), (3, 1, 1, 9, 10, True, "done", False, False),
    ],
    "code_blocks": [(0, 0, "js", "let x = {id};"), (3, 0, "md", "## Summary\n- plain\n| key |"), (3, 1, "js", "let x;")],
    "frontmatter": [(0, '{"title": "Doc {id}", "lang": "{lang}", "tags": ["a"]}'), *((k, None) for k in (1, 2, 3, 4))],
}


def by_shape_sql(name: str, *columns: str) -> str:
    """Rows of BY_SHAPE for every document of their shape."""

    def one(x: object) -> str:
        if isinstance(x, bool) or x is None:
            return {True: "TRUE", False: "FALSE", None: "NULL"}[x]
        return f"CAST({x} AS BIGINT)" if isinstance(x, int) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'"

    rows_ = ", ".join(f"({', '.join(map(one, r))})" for r in BY_SHAPE[name])
    text = {c for c, x in zip(columns, BY_SHAPE[name][0][1:], strict=True) if isinstance(x, str)}
    fill = lambda c: f"replace(replace(replace(replace({c}, '{{id}}', CAST(doc_id AS VARCHAR)), '{{lang}}', lang), '{{source}}', source), '{{n}}', CAST(n_chars AS VARCHAR)) AS {c}" if c in text else c
    return CORPUS_SQL + f"SELECT path, {', '.join(map(fill, columns))} FROM c JOIN (VALUES {rows_}) AS t(shape, {', '.join(columns)}) ON shape = doc_id % 5"


def all_shapes_sql(change: Callable[[str], str]) -> str:
    """doc_id, content of documents of all shapes, changed."""
    cases = " ".join(f"WHEN {k} THEN {filled_sql(lines_) or repr('')}" for k, lines_ in enumerate(SHAPES))
    return f"SELECT doc_id, {change(f'(CASE doc_id % {len(SHAPES)} {cases} END)')} AS content FROM documents"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.links(shapes(spark, sf_dir)).select("path", "text", "url")


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.table_cells(shapes(spark, sf_dir)).select("path", F.col("row").cast("long").alias("row"), "header", "value")


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relations.list_items(shapes(spark, sf_dir))
    return out.select("path", *(F.col(c).cast("long").alias(c) for c in ("ord", "item", "start_line", "end_line")), "ordered", "text", "is_task", "checked")


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.code_blocks(shapes(spark, sf_dir)).select("path", F.col("ord").cast("long").alias("ord"), "language", "body")


def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.frontmatter(shapes(spark, sf_dir)).select("path", "data")


# Structured files.


#: Contents of structured files, by their number: nested values, an empty file, one whose root is no map.
NESTED = '{"id": {id}, "a": {"c": [1, "x"], "d": null}, "k": {k}}'
FILES_OF = [NESTED, "", "[1]"]


def put(text: str, number: Column, k: Column) -> Column:
    return F.replace(F.replace(F.lit(text), F.lit("{id}"), number), F.lit("{k}"), k)


def json_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, k = F.col("event_id").cast("string"), F.get_json_object("props", "$.k")
    content = put(NESTED, number, k)
    for n in (1, 2):
        content = F.when(F.col("event_id") % 3 == n, F.lit(FILES_OF[n])).otherwise(content)
    return table(spark, sf_dir, "events").select(F.concat(F.lit("e/"), number, F.lit(".json")).alias("path"), content.alias("content"))


def json_query(patch: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build.apply_patches(json_corpus(spark, sf_dir), [patch])
        return out.select("path", "content", F.col("applied").cast("long").alias("applied"))

    return run


def json_sql(full: str, empty: str | None) -> str:
    """Whole files: of nested values, and of an empty file if it changes. A file whose root is no map never does."""
    text = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    some = f"replace(replace({text(full)}, '{{id}}', CAST(event_id AS VARCHAR)), '{{k}}', props->>'$.k')"
    applied = "event_id % 3 = 0" if empty is None else "event_id % 3 < 2"
    return f"SELECT 'e/' || CAST(event_id AS VARCHAR) || '.json' AS path, CASE event_id % 3 WHEN 0 THEN {some} WHEN 1 THEN {text(empty or '')} ELSE '[1]' END AS content, CAST(CASE WHEN {applied} THEN 1 ELSE 0 END AS BIGINT) AS applied FROM events"


BEGIN = '{\n  "id": {id},\n  "a": {\n    "c": [\n      1,\n      "x"\n    ],\n    "d": null'
JSON: list[tuple[str, dict, str]] = [
    ("json_set", {"op": "json-set", "path": "a.b", "value": 1}, json_sql(BEGIN + ',\n    "b": 1\n  },\n  "k": {k}\n}', '{\n  "a": {\n    "b": 1\n  }\n}')),
    ("json_delete", {"op": "json-delete", "path": "k"}, json_sql(BEGIN + "\n  }\n}", None)),
    ("json_merge", {"op": "json-merge", "value": {"a": {"b": "x"}, "k": 0}}, json_sql(BEGIN + ',\n    "b": "x"\n  },\n  "k": 0\n}', '{\n  "a": {\n    "b": "x"\n  },\n  "k": 0\n}')),
]

# Patches by documents.

PROGRAM = [
    {"op": "replace", "old": "a", "new": "b"},
    {"op": "replace-regex", "pattern": "x", "replacement": "y", "include": "en/**"},
    {"op": "remove-section", "id": "links", "include": ["de/**", "fr/**"], "exclude": "**/doc_1*.md"},
    {"op": "set-frontmatter", "key": "k", "value": 1, "include": "es/src1/*.md"},
    {"op": "delete-file", "match": "zz", "include": "none/**"},
    {"op": "replace", "old": "a", "new": "b", "include": "en/**"},
]
EDGE_SQL = CORPUS_SQL.rstrip() + """, e AS (
 SELECT path, 0 AS ord, 'replace' AS op, 5 AS risk FROM c
 UNION ALL SELECT path, 1, 'replace-regex', 9 FROM c WHERE path LIKE 'en/%'
 UNION ALL SELECT path, 2, 'remove-section', 8 FROM c WHERE (path LIKE 'de/%' OR path LIKE 'fr/%') AND path NOT LIKE '%/doc\\_1%' ESCAPE '\\'
 UNION ALL SELECT path, 3, 'set-frontmatter', 2 FROM c WHERE path LIKE 'es/src1/%'
 UNION ALL SELECT path, 5, 'replace', 5 FROM c WHERE path LIKE 'en/%') """


#: The program's patches with their risk, and what they do.
PATCH_SQL = "WITH p AS (SELECT * FROM (VALUES (0, 'replace', 5, 'a>b'), (1, 'replace-regex', 9, 'x>y'), (2, 'remove-section', 8, 'links'), (3, 'set-frontmatter', 2, 'k'), (4, 'delete-file', 10, 'zz'), (5, 'replace', 5, 'a>b')) AS t(ord, op, risk, what)) "


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(path_column().alias("path"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.edges(paths(spark, sf_dir), analytics.patch_table(spark, PROGRAM))


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("path", F.col("ord").cast("long").alias("ord"), "op")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = analytics.edges(paths(spark, sf_dir), analytics.patch_table(spark, PROGRAM[1:5]))
    return analytics.coverage(paths(spark, sf_dir), some).withColumn("percent", F.round("percent", 6))


def unpatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.unpatched(paths(spark, sf_dir), analytics.edges(paths(spark, sf_dir), analytics.patch_table(spark, PROGRAM[1:5])))


def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.impact(edges(spark, sf_dir)).withColumn("ord", F.col("ord").cast("long"))


def shared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.shared_files(edges(spark, sf_dir))


def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.complexity(edges(spark, sf_dir)).withColumn("score", F.col("score").cast("double"))


def safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks of all that the program does to documents: a patch counts for each that it admits."""
    return analytics.safety(edges(spark, sf_dir)).withColumn("mean_risk", F.round("mean_risk", 6))


def impact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each patch, the first three of them by name."""
    return analytics.impact(edges(spark, sf_dir), listed=3).select(F.col("ord").cast("long").alias("ord"), "files", F.array_join("paths", ",").alias("paths"))


def unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.unreachable(analytics.patch_table(spark, PROGRAM), edges(spark, sf_dir)).select(F.col("ord").cast("long").alias("ord"), "op")


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.pairs_in_common(edges(spark, sf_dir))
    return out.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "files")


def redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.redundant(analytics.patch_table(spark, PROGRAM), edges(spark, sf_dir))
    return out.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "files")


# Stores.


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select(path_column().alias("path"), F.col("text").alias("content"), "doc_id"))


def changed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later: documents of src1 gone, those of src2 changed, those of src3 elsewhere."""
    c = text_corpus(spark, sf_dir).filter(~F.col("path").contains("/src1/"))
    c = c.withColumn("content", F.when(F.col("path").contains("/src2/"), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return c.withColumn("path", F.when(F.col("path").contains("/src3/"), F.concat(F.lit("new/"), "path")).otherwise(F.col("path")))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.snapshot(text_corpus(spark, sf_dir))


def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.verify(snapshot(spark, sf_dir), changed_corpus(spark, sf_dir))


STATUS_SQL = CORPUS_SQL + """SELECT CASE WHEN k = 1 THEN 'new/' || path ELSE path END AS path,
 CASE WHEN k = 1 THEN 'added' WHEN source IN ('src1', 'src3') THEN 'deleted' WHEN source = 'src2' THEN 'modified' ELSE 'unchanged' END AS status
 FROM c, (VALUES (0), (1)) AS t(k) WHERE k = 0 OR source = 'src3'"""


def corpus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.corpus_diff(text_corpus(spark, sf_dir), changed_corpus(spark, sf_dir), text=False)


def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.line_changes(text_corpus(spark, sf_dir), changed_corpus(spark, sf_dir))


def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = text_corpus(spark, sf_dir)
    cache = changed_corpus(spark, sf_dir).select("path", values.content_hash(F.col("content")).alias("source_hash"), F.when(F.col("path").contains("/src4/"), "old").otherwise("p").alias("patch_hash"))
    return stores.stale(now, cache, "p").select("path", F.coalesce("reason", F.lit("")).alias("reason"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as builds."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("build_id"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "F").alias("success"), F.array("o_orderpriority").alias("tags"), F.col("o_custkey").alias("files"), F.col("o_orderkey").alias("output_bytes"))


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.builds(history(spark, sf_dir), success=True, offset=5, limit=20).select("build_id", "files")


def history_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.history_statistics(history(spark, sf_dir)).select("builds", "succeeded", F.round("mean_files", 6).alias("mean_files"))


def benchmark_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stores.benchmark_statistics(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("p95", 6).alias("p95"), F.round("stddev", 6).alias("stddev"))


def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suggest.moved_files(text_corpus(spark, sf_dir), changed_corpus(spark, sf_dir))
    return out.select("path", "to_path")


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.sources import files

    both = text_corpus(spark, sf_dir).select("path", F.lit("old").alias("content"), F.lit(0).alias("ord")).unionByName(text_corpus(spark, sf_dir).filter(F.col("path").contains("/src1")).select("path", F.lit("new").alias("content"), F.lit(1).alias("ord")))
    return files.last_wins(both, "ord").select("path", "content")


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.sources import files

    return files.select_resources(paths(spark, sf_dir).withColumn("content", F.lit("")), ["{en,de}/**/*.md", "fr/src2/*", "!**/src1?/*"]).select("path")


# Escape hatches, suggestions, recovery, lineage and builds over time.


def plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    md.PLUGINS["upper"] = lambda text, params, context: text.upper() + params["end"]
    out = build.apply_patches(shapes(spark, sf_dir), [{"op": "plugin", "plugin": "upper", "params": {"end": "!"}}])
    return out.select("doc_id", "content")


def execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.apply_patches(shapes(spark, sf_dir), [{"op": "exec", "command": "tr d D"}], allow_exec=True).select("doc_id", "content")


def transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    md.TRANSFORMS["echo"] = lambda text, prompt, given: f"{text}{prompt}"
    out = build.apply_patches(shapes(spark, sf_dir), [{"op": "ai-transform", "prompt": "end", "provider": "echo"}, {"op": "ai-transform", "prompt": "x", "provider": "none", "onNoMatch": "skip"}])
    return out.select("doc_id", "content")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.lines(text_corpus(spark, sf_dir)).select("path", F.col("line").cast("long").alias("line"), "text")


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.explain(edges(spark, sf_dir))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = corpus(spark, sf_dir)
    target = source.withColumn("content", F.replace("content", F.lit("https://example.com/"), F.lit("/d/")))
    return suggest.suggestions(suggest.paired(source, target))


def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = corpus(spark, sf_dir)
    target = source.withColumn("content", F.concat("content", F.lit("end")))
    return suggest.consolidated(suggest.suggestions(suggest.paired(source, target))).select("patch", "score", "files", "include")


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame([("STANDERT",), ("promoo",), ("LARG",)], "target string")
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("value"))
    return recover.nearest(targets, types).withColumn("distance", F.col("distance").cast("long"))


def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three names nearest to each name of a part with its type and brand, of all of them."""
    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("value"))
    return recover.nearest(names.withColumnRenamed("value", "target"), names, 3).withColumn("distance", F.col("distance").cast("long"))


SIMILAR_SQL = """WITH n AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS v FROM part), d AS (
 SELECT x.v AS target, y.v AS value, least(levenshtein(x.v, y.v), levenshtein(lower(x.v), lower(y.v))) AS distance,
 CASE WHEN length(x.v) <= 5 THEN 2 WHEN length(x.v) <= 10 THEN 3 WHEN length(x.v) <= 20 THEN 5 ELSE 7 END AS most
 FROM n x, n y WHERE x.v <> y.v)
SELECT target, value, CAST(distance AS BIGINT) AS distance FROM d WHERE distance <= most QUALIFY row_number() OVER (PARTITION BY target ORDER BY distance, value) <= 3"""


def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section ids of each document nearest to a mistyped one."""
    found = relations.sections(shapes(spark, sf_dir)).select("path", F.col("id").alias("value"))
    return recover.nearest(paths(spark, sf_dir).withColumn("target", F.lit("sumary")), found, 1, "path").select("path", "value", F.col("distance").cast("long").alias("distance"))


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = program({"patches": [{"op": "replace", "old": "e", "new": "E"}]})
    old = changed_corpus(spark, sf_dir)
    cache = build.build(old, p).select("path", values.content_hash(F.col("content")).alias("_"), F.col("content").alias("output"))
    cache = cache.join(old.select("path", values.content_hash(F.col("content")).alias("source_hash")), "path").select("path", "source_hash", stores.signature(p, F.col("path")).alias("patch_hash"), "output")
    return stores.incremental(text_corpus(spark, sf_dir), cache, p).select("path", "content", "rebuilt")


#: Programs before and after one patch changed its text and another its paths; a document sees the patches for its path.
BEFORE = [{"op": "replace", "old": "e", "new": "E"}, {"op": "replace", "old": "a", "new": "A", "include": "en/**"}, {"op": "append-to-file", "content": "!", "include": ["de/**", "fr/**"]}]
AFTER = [BEFORE[0], BEFORE[1] | {"new": "@"}, BEFORE[2] | {"include": ["de/**", "es/**"]}]


def cached(spark: SparkSession, sf_dir: str, config: dict) -> DataFrame:
    """What a build of all documents by a program leaves in the cache."""
    p = program(config)
    docs = text_corpus(spark, sf_dir).select("path", "content", values.content_hash(F.col("content")).alias("source_hash"))
    return build.build(docs, p).select("path", "source_hash", stores.signature(p, F.col("path")).alias("patch_hash"), F.col("content").alias("output"))


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After two of three patches changed only documents that one of them admits or admitted are built again."""
    out = stores.incremental(text_corpus(spark, sf_dir), cached(spark, sf_dir, {"patches": BEFORE}), program({"patches": AFTER}))
    return out.select("path", "content", "rebuilt")


REBUILT_SQL = """SELECT path, CASE lang WHEN 'en' THEN replace(t, 'a', '@') WHEN 'de' THEN t || '!' WHEN 'es' THEN t || '!' ELSE t END AS content, lang IN ('en', 'fr', 'es') AS rebuilt FROM (SELECT *, replace(text, 'e', 'E') AS t FROM c)"""


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and matches by operation, counted while a build is written: no job of their own."""
    p = program({"patches": WORK})
    counters = reports.Counters(p)
    counters.write(build.build(shapes(spark, sf_dir), p, tally=True), shared_folder(spark, "counted"))
    return spark.createDataFrame([(op, *n) for op, n in counters.by_operation().items()], "op string, documents long, matches long")


def cache_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses and their reasons, and bytes, counted while an incremental build is written."""
    p = program({"patches": AFTER})
    old = cached(spark, sf_dir, {"patches": BEFORE}).filter("path NOT LIKE '%/src1/%'")
    counters = reports.Counters(p)
    told = counters.write(stores.incremental(text_corpus(spark, sf_dir), old, p, tally=True), shared_folder(spark, "cached"))
    row = (told["files"], told["hits"], told["misses"], round(told["hit_percent"], 6), told["reasons"].get("new-file", 0), told["reasons"].get("patches-changed", 0), told["bytes"])
    return spark.createDataFrame([row], "files long, hits long, misses long, hit_percent double, new_files long, patches_changed long, bytes long")


CACHE_SQL = """SELECT count(*) AS files, count(*) FILTER (NOT m) AS hits, count(*) FILTER (m) AS misses, round(count(*) FILTER (NOT m) * 100.0 / count(*), 6) AS hit_percent,
 count(*) FILTER (source = 'src1') AS new_files, count(*) FILTER (m AND source <> 'src1') AS patches_changed, CAST(sum(strlen(text) + CASE WHEN lang IN ('de', 'es') THEN 1 ELSE 0 END) AS BIGINT) AS bytes
FROM (SELECT *, source = 'src1' OR lang IN ('en', 'fr', 'es') AS m FROM c)"""


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.pruned(history(spark, sf_dir), keep_last=30).select("build_id")


def build_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files of two builds, by return flag."""
    item = table(spark, sf_dir, "lineitem").filter("l_returnflag IN ('A', 'R')")
    return item.groupBy(F.col("l_returnflag").alias("build_id"), F.col("l_partkey").cast("string").alias("path")).agg(F.max("l_linenumber").cast("string").alias("sha256"), F.count("*").alias("size"), F.max("l_linenumber").cast("long").alias("patches"))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.compare_builds(build_files(spark, sf_dir), "A", "R")


def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"))
    return stores.regressions(e.agg(F.max("value").alias("mean")), e.agg(F.avg("value").alias("mean"))).select("name", F.round("percent", 6).alias("percent"))


def corpus_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified diffs of documents that went, came, or have another last line."""
    return stores.corpus_diff(text_corpus(spark, sf_dir), changed_corpus(spark, sf_dir))


#: All lines of a document that went or came; of a changed one the last line and up to three before it.
DIFF_SQL = CORPUS_SQL.replace("n_chars,", "n_chars, text,") + """, l AS (
 SELECT *, string_split(text, chr(10)) AS t, len(t) AS n, least(n, 4) AS w, CASE WHEN k = 1 THEN 'new/' || path ELSE path END AS p, chr(10) AS nl
 FROM c, (VALUES (0), (1)) AS v(k) WHERE text IS NOT NULL AND (k = 0 AND source IN ('src1', 'src2', 'src3') OR k = 1 AND source = 'src3'))
SELECT p AS path, CASE WHEN k = 1 THEN 'added' WHEN source = 'src2' THEN 'modified' ELSE 'deleted' END AS status,
 '--- a/' || p || nl || '+++ b/' || p || nl || CASE WHEN k = 1 THEN '@@ -0,0 +1,' || n || ' @@' || nl || '+' || replace(text, nl, nl || '+')
 WHEN source <> 'src2' THEN '@@ -1,' || n || ' +0,0 @@' || nl || '-' || replace(text, nl, nl || '-')
 ELSE '@@ -' || (n - w + 1) || ',' || w || ' +' || (n - w + 1) || ',' || w || ' @@' || nl || array_to_string(list_transform(t[n - w + 1:n - 1], lambda x: ' ' || x || nl), '') || '-' || t[n] || nl || '+' || t[n] || '!' END AS diff FROM l"""


def patched_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus brought up to date by its diffs alone."""
    before = text_corpus(spark, sf_dir)
    return stores.patched_corpus(before, stores.corpus_diff(before, changed_corpus(spark, sf_dir)))


#: Sections that move within documents, by the rest of the id: their titles in order, before and after, and the moves.
ORDERS = [
    ("ABCDEF", "ABCDEF", []), ("ABCDEF", "BCDEFA", [("a", "f")]), ("ABCDEF", "AFBCDE", [("f", "a")]), ("ABCDEF", "ADEBCF", [("d", "a"), ("e", "d")]),
    ("ABCDEF", "ACBEDF", [("c", "a"), ("e", "b")]), ("ABCDEFGHIJ", "AJBCDHEFGI", [("j", "a"), ("h", "d")]), ("ABCD", "ADCB", [("d", "a"), ("c", "d")]),
]


def sectioned(order: str, source: Column) -> Column:
    return F.concat(F.lit("# Top\n"), *(x for c in order for x in (F.lit(f"\n## {c}\n\n{c} of "), source, F.lit("\n"))))


def moved_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moves that give each document its new order of sections, and whether they do so exactly."""
    docs = table(spark, sf_dir, "documents").select(path_column().alias("path"), "doc_id", "source")
    which = F.col("doc_id") % len(ORDERS)
    text = lambda side: F.coalesce(*(F.when(which == k, sectioned(x[side], F.coalesce("source", F.lit("none")))) for k, x in enumerate(ORDERS)))
    pairs = docs.select("path", text(0).alias("source"), text(1).alias("target"))
    found = suggest.suggestions(pairs)
    return found.select("path", F.get_json_object("patch", "$.op").alias("op"), F.get_json_object("patch", "$.id").alias("id"), F.get_json_object("patch", "$.after").alias("after"), "checked")


MOVED_SQL = CORPUS_SQL + f"SELECT path, 'move-section' AS op, id, after, CAST(1 AS DOUBLE) AS checked FROM c JOIN (VALUES {', '.join(f'({k}, {x!r}, {y!r})' for k, (_, _, m) in enumerate(ORDERS) for x, y in m)}) AS t(k, id, after) ON k = doc_id % {len(ORDERS)}"


def region_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One markdown table of nations a region, sorted and filtered as documents, read back as rows."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |")).alias("row"), "n_nationkey")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "row"))), lambda x: x["row"]), "\n")
    docs = n.groupBy("n_regionkey").agg(F.concat(F.lit("| name | key |\n| --- | --- |\n"), body).alias("content")).select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".md")).alias("path"), "content")
    out = build.apply_patches(docs, [{"op": "sort-table", "table": 0, "column": "key", "type": "number", "direction": "desc"}, {"op": "filter-table-rows", "table": 0, "column": "name", "pattern": "[13579]$"}])
    rows_ = relations.table_rows(out)
    return rows_.select("path", F.col("row").cast("long").alias("row"), F.get("cells", F.lit(0)).alias("name"))


#: Names of parts with marks, capitals, signs and digits, by the part's key.
SPELLINGS = ["p_name", "replace(p_name, 'e', 'é')", "upper(p_name)", "replace(p_name, 'o', 'Ö')", "'_' || p_name", "CAST(p_size AS VARCHAR(9)) || ' ' || p_name"]
SPELLED_SQL = f"SELECT DISTINCT p_brand, CASE p_partkey % {len(SPELLINGS)} {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(SPELLINGS))} END AS name FROM "


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPELLED_SQL + "{part}", part=table(spark, sf_dir, "part"))


def locale_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each brand in the order of the root locale, as rows."""
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.collate("name", "UNICODE")))
    return spelled(spark, sf_dir).select("p_brand", "name", place.cast("long").alias("place"))


def locale_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list and a table of each brand's names, put in the order of the root locale within its document."""
    names = spelled(spark, sf_dir).groupBy("p_brand").agg(F.array_sort(F.collect_list("name")).alias("names"))
    rows_ = F.array_join(F.transform("names", lambda x: F.concat(F.lit("| "), x, F.lit(" |"))), "\n")
    docs = names.select(F.col("p_brand").alias("path"), F.concat(F.lit("- "), F.array_join("names", "\n- "), F.lit("\n\n| name |\n| --- |\n"), rows_).alias("content"))
    patches = [{"op": "sort-list", "list": 0}, {"op": "sort-table", "table": 0, "column": "name", "direction": "desc"}]
    # the table's line number differs, so its section finds it
    patches[1]["table"] = "names"
    docs = docs.withColumn("content", F.regexp_replace("content", r"\n\n\| name", "\n\n# Names\n| name")).withColumn("content", F.concat("content", F.lit("\n")))
    return build.apply_patches(docs, patches, native_only=True).select("path", "content")


LOCALE_LISTS_SQL = f"""SELECT p_brand AS path, '- ' || string_agg(name, chr(10) || '- ' ORDER BY name COLLATE en) || chr(10) || chr(10) || '# Names' || chr(10) || '| name |' || chr(10) || '| --- |' || chr(10)
 || string_agg('| ' || name || ' |', chr(10) ORDER BY name COLLATE en DESC) || chr(10) AS content FROM ({SPELLED_SQL} part) GROUP BY p_brand"""


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two languages out of archives, of which there is one a source, by the archives' own directories."""
    from textloom.sources.archives import list_archives, read_archives, write_archives

    where = shared_folder(spark, "archives")
    docs = text_corpus(spark, sf_dir).withColumn("source", F.regexp_extract("path", "/(src[^/]*)/", 1))
    form = F.when(F.col("source") < "src2", "zip").when(F.col("source") < "src5", "tar").when(F.col("source") >= "src5", "tar.gz")
    write_archives(docs, where, "source", form)
    listing = list_archives(spark, where, most=1 << 62)  # they were just written: none is a bomb, however large a source is
    part = lambda lang: read_archives(spark, where, listing=listing, bytes=1 << 18).filter(F.col("path").startswith(f"{lang}/"))
    return part("en").unionByName(part("fr")).select(F.regexp_extract("archive", r"^(.*?)\.", 1).alias("archive"), "path", "size", "content")


#: Configurations that stand on each other, and the languages of the documents in each one's folder.
LEVELS = [("base", ("en", "de")), ("mid", ("fr", "de")), ("top", ("es",))]


def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of three configurations, each on the one before: the chain through which each came, and its patches."""
    from pathlib import Path

    from textloom.sources import files

    where = shared_folder(spark, "levels").removeprefix("file://")
    docs = table(spark, sf_dir, "documents").select(path_column().alias("path"), "lang", F.lit("x").alias("content"))
    for k, (name, languages) in enumerate(LEVELS):
        files.write_files(docs.filter(F.col("lang").isin(*languages)), f"{where}/{name}")
        Path(where, name).mkdir(parents=True, exist_ok=True)
        Path(where, name, "config.yaml").write_text(f"resources: [{f'../{LEVELS[k - 1][0]}, ' if k else ''}'**/*.md']")
    found = files.overlay(spark, f"{where}/top/config.yaml", chain=True, contents=False)
    edge = analytics.edges(found, analytics.patch_table(spark, PROGRAM))
    names = F.array_join(F.transform("chain", lambda c: F.regexp_extract(c, r"([^/]*)/config\.yaml$", 1)), ">")
    return analytics.explain(edge, found).select("path", names.alias("chain"), F.col("depth").cast("long").alias("depth"), "lineage")


CONFIGURED_SQL = """, l AS (SELECT path, string_agg(CAST(ord AS VARCHAR) || ':' || op, ',' ORDER BY ord) AS lineage FROM e GROUP BY path)
SELECT c.path, CASE lang WHEN 'en' THEN 'base>mid>top' WHEN 'es' THEN 'top' ELSE 'mid>top' END AS chain, CAST(CASE lang WHEN 'en' THEN 3 WHEN 'es' THEN 1 ELSE 2 END AS BIGINT) AS depth, l.lineage
FROM c JOIN l ON c.path = l.path WHERE lang IN ('en', 'de', 'fr', 'es')"""


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watched folder after two batches and a sweep between them: documents of src1 come with the second only, those of
    src2 don't change, and all others do in between; the sweep finds documents of src2, src3 and src4 with even ids gone,
    which the second batch brings back."""
    from textloom.streaming.watch import Watch, stream_table

    where = shared_folder(spark, "watch")
    docs = table(spark, sf_dir, "documents").select(path_column().alias("path"), "text")
    old = F.concat("text", F.lit("old"))
    for n, text in enumerate((old, F.when(F.col("path").contains("/src2/"), old).otherwise(F.col("text")))):
        part = docs.filter("path not like '%/src1/%'") if n == 0 else docs.filter("path not like '%/src2/%' OR path RLIKE '[02468].md$'")
        part.select("path", text.alias("content")).write.mode("append").parquet(f"{where}/in")
        watch = Watch(spark, f"{where}/state", program({"patches": [{"op": "replace", "old": "e", "new": "E"}]}))
        watch.start(stream_table(spark, f"{where}/in"), f"{where}/log", once=True).awaitTermination()
        if n == 0:
            watch.sweep(docs.filter("NOT (path RLIKE '/src[234]/' AND path RLIKE '[02468].md$')").select("path"))
    return watch.current(("output",))


def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each document once it was quiet: all change twice, those of src2 are gone the second time."""
    from textloom.streaming.debounce import drained
    from textloom.streaming.watch import stream_table

    where = shared_folder(spark, "quiet")
    docs = table(spark, sf_dir, "documents").select(path_column().alias("path"), F.col("text").alias("content"))
    for n in range(2):
        content = F.when(F.col("path").contains("/src2/"), F.lit(None).cast("string")).otherwise(F.col("content")) if n else F.concat("content", F.lit("old"))
        docs.select("path", content.alias("content"), F.timestamp_seconds(F.lit(n)).alias("modified")).write.mode("append").parquet(f"{where}/in")
    return drained(stream_table(spark, f"{where}/in", "path string, content string, modified timestamp"), 1000, f"{where}/out", f"{where}/log").select("path", "content", "events")


#: Structured files by their number: extension, content, and what setting `a` to x leaves.
FORMS = [
    ("yaml", "id: {id}\nk: {k}\n", "id: {id}\nk: {k}\na: x\n"), ("toml", "id = {id}\nk = {k}\n", 'id = {id}\nk = {k}\na = "x"\n'),
    ("env", "ID={id}\n# note\nK={k}\n", "ID={id}\nK={k}\na=x\n"), ("properties", "id={id}\nin.k={k}\n", "id={id}\nin.k={k}\na=x\n"),
]


def form_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four formats."""
    number, k = F.col("event_id").cast("string"), F.get_json_object("props", "$.k")
    path, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (form, text, _) in enumerate(FORMS):
        path = F.when(F.col("event_id") % len(FORMS) == n, F.concat(F.lit("f/"), number, F.lit("." + form))).otherwise(path)
        content = F.when(F.col("event_id") % len(FORMS) == n, put(text, number, k)).otherwise(content)
    return table(spark, sf_dir, "events").select(path.alias("path"), content.alias("content"))


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key set in files of four formats."""
    return build.apply_patches(form_corpus(spark, sf_dir), [{"op": "json-set", "path": "a", "value": "x"}]).select("path", "content")


def structured_sql(left: list[str], applied: str = "") -> str:
    text = lambda x: "'" + x.replace("\n", "' || chr(10) || '") + "'"
    some = lambda f: " ".join(f"WHEN {n} THEN {f(x)}" for n, x in enumerate(FORMS))
    put_ = lambda x: f"replace(replace({text(left[FORMS.index(x)])}, '{{id}}', CAST(event_id AS VARCHAR)), '{{k}}', props->>'$.k')"
    return f"SELECT 'f/' || CAST(event_id AS VARCHAR) || CASE event_id % {len(FORMS)} {some(lambda x: repr('.' + x[0]))} END AS path, CASE event_id % {len(FORMS)} {some(put_)} END AS content{applied} FROM events"


WORK = [{"op": "replace", "old": "plain", "new": "simple"}, {"op": "remove-section", "id": "data"}, {"op": "replace", "old": "simple", "new": "x", "include": "en/**"}]


def worked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each patch did to each document, in turn."""
    return preview.steps(shapes(spark, sf_dir), WORK).select("path", *(F.col(c).cast("long").alias(c) for c in ("step", "count")), "op")


#: How often "plain" is in each shape, and which shapes have a section `data`.
WORKED_SQL = CORPUS_SQL + "SELECT path, CAST(s AS BIGINT) AS step, CAST(n AS BIGINT) AS count, CASE s WHEN 1 THEN 'remove-section' ELSE 'replace' END AS op FROM c JOIN (VALUES (0, 0, 2), (0, 1, 1), (0, 2, 1), (0, 3, 2), (1, 0, 1), (1, 3, 1), (2, 0, 2), (2, 1, 1), (2, 2, 1), (2, 3, 2)) AS t(s, shape, n) ON shape = doc_id % 5 WHERE s < 2 OR lang = 'en'"


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each patch was for and matched; the times have no form in SQL."""
    out = preview.profile(shapes(spark, sf_dir), WORK)
    return out.select(*(F.col(c).cast("long").alias(c) for c in ("step", "tried", "documents", "matches")), "op")


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of debug sessions: all patches are applied to documents of even ids, the first is skipped elsewhere."""
    docs = shapes(spark, sf_dir)
    even = F.col("doc_id") % 2 == 0
    decisions = docs.select("path", F.explode(F.when(even, F.array(*(F.struct(F.lit(k).alias("step"), F.lit("apply").alias("action")) for k in range(len(WORK))))).otherwise(F.array(F.struct(F.lit(0).alias("step"), F.lit("skip").alias("action"))))).alias("d")).select("path", "d.*")
    return preview.replayed(docs, WORK, decisions).select("path", "content", F.col("applied").cast("long").alias("applied"), F.col("skipped").cast("long").alias("skipped"))


def replayed_sql() -> str:
    """Contents by shape, with and without the patches; the last one is for English documents."""
    def after(k: int, english: bool) -> list[str]:
        lines_ = [x.replace("plain", "simple") for x in SHAPES[k]]
        if k in (0, 3):
            start, end = (16, 25) if k == 0 else (12, 22)
            lines_ = lines_[:start] + lines_[end:]
        return [x.replace("simple", "x") for x in lines_] if english else lines_

    text = lambda lines_: filled_sql(lines_) or "''"
    cases = " ".join(f"WHEN {k} THEN CASE WHEN doc_id % 2 = 1 THEN {text(SHAPES[k])} WHEN lang = 'en' THEN {text(after(k, True))} ELSE {text(after(k, False))} END" for k in range(len(SHAPES)))
    done = "CASE doc_id % 5 WHEN 0 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 1 END + CASE WHEN lang = 'en' AND doc_id % 5 <> 4 THEN 1 ELSE 0 END"
    return CORPUS_SQL + f"SELECT path, CASE doc_id % 5 {cases} END AS content, CAST(CASE WHEN doc_id % 2 = 0 THEN {done} ELSE 0 END AS BIGINT) AS applied, doc_id % 2 AS skipped FROM c"


def by_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_operation(shapes(spark, sf_dir), WORK)


def missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints for a patch with a slip in its section's name: only where there is such a section."""
    return reports.hints(shapes(spark, sf_dir), [{"op": "remove-section", "id": "sumary"}]).select("path", "hint", "confidence")


#: A slip of each kind that recovery knows, and which shapes it finds what in.
SLIPS = [
    ({"op": "remove-section", "id": "sumary"}, "section 'summary'", 0.85, (0, 3)), ({"op": "replace", "old": "PLAIN", "new": "x"}, "letter case", 0.9, (0, 1, 2, 3)), ({"op": "replace", "old": "characters  of text", "new": "x"}, "white space", 0.88, (0,)),
    ({"op": "remove-frontmatter", "key": "titel"}, "key 'title'", 0.6, (0,)), ({"op": "delete-between", "start": "<!-- /TOC", "end": "<!-- TOC"}, "markers swapped", 0.95, (0,)),
]


def missed_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What patches with slips were meant to match, by all ways of recovery."""
    found = reports.hints(shapes(spark, sf_dir), [x[0] for x in SLIPS])
    return found.select("path", F.col("step").cast("long").alias("step"), "hint", F.round("confidence", 6).alias("confidence"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


MISSED_SQL = CORPUS_SQL + "SELECT path, CAST(k AS BIGINT) AS step, hint, CAST(confidence AS DOUBLE) AS confidence FROM c JOIN (VALUES " + ", ".join(f"({shape}, {k}, {quoted(hint)}, {least})" for k, (_, hint, least, found) in enumerate(SLIPS) for shape in found) + ") AS t(shape, k, hint, confidence) ON shape = doc_id % 5"


def hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of patches that match nothing, which say what would."""
    out = build.apply_patches(shapes(spark, sf_dir), [SLIPS[0][0], {"op": "append-to-file", "content": "x"}, SLIPS[3][0]], hints=True)
    return out.select("path", F.posexplode("warnings").alias("place", "warning")).select("path", F.col("place").cast("long").alias("place"), "warning")


HINTED_SQL = CORPUS_SQL + f"""SELECT path, CAST(0 AS BIGINT) AS place, 'patch 0 (remove-section): no match' || CASE WHEN doc_id % 5 IN (0, 3) THEN {quoted("; near: section 'summary'")} ELSE '' END AS warning FROM c
UNION ALL SELECT path, 1, 'patch 2 (remove-frontmatter): no match' || CASE WHEN doc_id % 5 = 0 THEN {quoted("; near: key 'title'")} ELSE '' END FROM c"""

#: Deletes and merges in files of four formats, and what they leave of FORMS.
EDITS = [
    {"op": "json-delete", "path": "k", "include": "**/*.{yaml,toml}"}, {"op": "json-delete", "path": "K", "include": "**/*.env"}, {"op": "json-delete", "path": "in.k", "include": "**/*.properties"},
    {"op": "json-merge", "value": {"note": {"by": "x"}}, "exclude": "**/*.env"}, {"op": "json-delete", "path": "none", "onNoMatch": "skip"},
]
EDITED = ["id: {id}\nnote:\n  by: x\n", 'id = {id}\n\n[note]\nby = "x"\n', "ID={id}\n", "id={id}\nnote.by=x\n"]


def structured_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys deleted and maps merged in files of four formats."""
    return build.apply_patches(form_corpus(spark, sf_dir), EDITS).select("path", "content", F.col("applied").cast("long").alias("applied"))


def previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines, with the characters that were added to them."""
    out = preview.preview(text_corpus(spark, sf_dir), changed_corpus(spark, sf_dir)).select("path", "status", F.explode("lines").alias("x"))
    added = F.array_join(F.transform(F.filter("x.parts", lambda p: p["kind"] == "added"), lambda p: p["text"]), "")
    return out.select("path", "status", "x.kind", F.coalesce("x.before", F.lit(0)).cast("long").alias("before"), F.coalesce("x.after", F.lit(0)).cast("long").alias("after"), added.alias("added"))


#: Of a changed document its last line, of one that came or went all lines.
PREVIEWED_SQL = CORPUS_SQL.replace("n_chars,", "n_chars, text,") + """, t AS (SELECT *, string_split(text, chr(10)) AS lines, len(lines) AS n FROM c WHERE text IS NOT NULL), u AS (SELECT *, unnest(range(1, n + 1)) AS k FROM t WHERE source IN ('src1', 'src3'))
SELECT path, 'modified' AS status, 'modified' AS kind, CAST(n AS BIGINT) AS before, CAST(n AS BIGINT) AS after, '!' AS added FROM t WHERE source = 'src2'
UNION ALL SELECT path, 'deleted', 'removed', CAST(k AS BIGINT), 0, '' FROM u UNION ALL SELECT 'new/' || path, 'added', 'added', 0, CAST(k AS BIGINT), lines[k] FROM u WHERE source = 'src3'"""


def rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the fourth of seven builds left them."""
    lines_ = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("string").alias("build_id"), F.col("l_partkey").cast("string").alias("path"))
    outputs = lines_.agg(F.max("l_orderkey").cast("string").alias("output"))
    history = spark.range(1, 8).select(F.col("id").cast("string").alias("build_id"), F.timestamp_seconds("id").alias("ts"), F.lit(True).alias("success"))
    return stores.rolled_back(outputs, history, "4")


def word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(reports.word_similarity(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_brand")), 6).alias("likeness"))


def versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of seven versions, compacted on its way: the newest row of each path that isn't deleted."""
    rows_ = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("version"), F.col("l_partkey").cast("string").alias("path")).agg(F.max("l_orderkey").alias("value"))
    rows_ = rows_.select("path", "value", (F.col("value") % 10 == 0).alias("deleted"), "version")
    store = stores.Versions(spark, shared_folder(spark, "versions"), "path string, value long, deleted boolean, version long", compact=3)
    for n in range(1, 8):
        store.write(rows_.filter(F.col("version") == n), n)
    return store.newest().filter(~F.col("deleted")).select("path", "value")


VERSIONED_SQL = "WITH v AS (SELECT l_linenumber AS version, CAST(l_partkey AS VARCHAR) AS path, max(l_orderkey) AS value FROM lineitem GROUP BY 1, 2) SELECT path, max_by(value, version) AS value FROM v GROUP BY path HAVING max_by(value, version) % 10 <> 0"


# Sources, sinks, programs, reports and stores, each read back or counted.


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, one each, and scanned again; files of other extensions and folders that are skipped aren't there."""
    from textloom.sources import files

    where = shared_folder(spark, "files").removeprefix("file://")
    docs = text_corpus(spark, sf_dir).select("path", "content")
    other = docs.withColumn("path", F.when(F.col("path").startswith("en/"), F.concat(F.lit("node_modules/"), "path")).otherwise(F.concat("path", F.lit(".txt"))))
    files.write_files(docs.unionByName(other).filter("content IS NOT NULL"), where)
    return files.read_corpus(spark, f"file://{where}")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an output folder that a later build no longer has, deleted; a second run finds none."""
    from textloom.sources import files

    where = shared_folder(spark, "output").removeprefix("file://")
    docs = paths(spark, sf_dir).withColumn("content", F.lit("x"))
    files.write_files(docs, where)
    kept = docs.filter("path NOT LIKE '%/src1/%'")
    gone = files.clean(f"file://{where}", kept)
    left = files.clean(f"file://{where}", kept).select(F.concat(F.lit("again: "), "path").alias("path"))
    return gone.unionByName(left)


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's rows, written as JSON lines in order of their paths and read again."""
    where = shared_folder(spark, "report")
    reports.write_rows(edge_rows(spark, sf_dir), where)
    return spark.read.schema("path string, ord long, op string").json(where)


def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources with what their lock entries resolved to."""
    from textloom.sources import remote

    url = F.concat(F.lit("https://h.com/"), "s_name", F.lit(".zip"))
    supplier = table(spark, sf_dir, "supplier").select(url.alias("url"), "s_suppkey")
    lock = supplier.filter("s_suppkey % 3 = 0").select("url", F.col("url").alias("resolved"), F.concat(F.lit("sha256-"), F.sha2("url", 256)).alias("integrity"))
    return remote.pinned(supplier, lock).select("url", "s_suppkey", "resolved", "integrity")


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program with variables, groups of which one is off, and a patch that extends another."""
    config = {
        "vars": {"word": "simple"},
        "patches": [
            {"op": "replace", "patchId": "base", "old": "plain", "new": "${word}", "include": "en/**"}, {"op": "append-to-file", "content": "${missing}", "group": "tail"},
            {"op": "append-to-file", "content": "never", "group": "off"}, {"extends": "base", "op": "replace", "new": "${word}r", "include": "de/**"},
        ],
    }
    return build.build(shapes(spark, sf_dir), program(config, disable=["off"])).select("path", "content")


def grouped_sql() -> str:
    """English documents lose the word to the first patch, German ones to the one that extends it; which takes both globs."""
    swap = lambda lines_, word: filled_sql([x.replace("plain", word) for x in lines_]) or "''"
    cases = " ".join(f"WHEN {k} THEN CASE lang WHEN 'en' THEN {swap(x, 'simple')} WHEN 'de' THEN {swap(x, 'simpler')} ELSE {filled_sql(x) or repr('')} END" for k, x in enumerate(SHAPES))
    return CORPUS_SQL + f"SELECT path, (CASE doc_id % 5 {cases} END) || '${{missing}}' AS content FROM c"


def nested_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested key that one patch sets, and conditions on it of later ones."""
    patches = [
        {"op": "set-frontmatter", "key": "meta.kind", "value": "doc", "include": "en/**"}, {"op": "append-to-file", "content": "A", "when": {"frontmatterEquals": {"key": "meta.kind", "value": "doc"}}},
        {"op": "append-to-file", "content": "B", "when": {"allOf": [{"frontmatterExists": "meta"}, {"not": {"frontmatterExists": "meta.none"}}]}}, {"op": "append-to-file", "content": "C", "when": {"frontmatterEquals": {"key": "meta.kind", "value": True}}},
    ]
    out = build.apply_patches(shapes(spark, sf_dir), patches)
    return out.select("path", F.regexp_extract("content", "[A-C]*$", 0).alias("tail"), F.col("applied").cast("long").alias("applied"), F.col("skipped").cast("long").alias("skipped"))


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of patches with one target that share documents."""
    out = analytics.overlapping(analytics.patch_table(spark, PROGRAM), edges(spark, sf_dir))
    return out.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "files")


def most_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.most_complex(edges(spark, sf_dir), 25).select("path", "patches", F.col("score").cast("double").alias("score"))


def bundled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of a report bundle: how many rows each has, and its sum of one field."""
    out = reports.bundle(paths(spark, sf_dir), PROGRAM, top=7)
    number = lambda field: F.aggregate(F.from_json("body", f"array<struct<{field}:double>>"), F.lit(0.0), lambda a, x: a + x[field])
    one = lambda field: F.get_json_object("body", f"$.{field}").cast("double")
    total = F.when(F.col("section") == "coverage", one("patched")).when(F.col("section") == "safety", one("high")).when(F.col("section") == "impact", number("files")).when(F.col("section") == "complexity", number("score")).otherwise(number("risk"))
    rows_ = F.when(F.startswith("body", F.lit("[")), F.json_array_length("body")).otherwise(1)
    return out.select("section", rows_.cast("long").alias("rows"), total.alias("total"))


BUNDLED_SQL = EDGE_SQL + ", " + PATCH_SQL.removeprefix("WITH ") + """, x AS (SELECT path, count(*) * 2 + count(DISTINCT op) * 1.5 + sum(CASE WHEN risk >= 8 THEN 1 ELSE 0 END) * 3 AS score FROM e GROUP BY path ORDER BY score DESC, path LIMIT 7)
SELECT 'coverage' AS section, CAST(1 AS BIGINT) AS rows, CAST((SELECT count(DISTINCT path) FROM e) AS DOUBLE) AS total UNION ALL SELECT 'impact', count(DISTINCT ord), CAST(count(*) AS DOUBLE) FROM e
UNION ALL SELECT 'complexity', count(*), CAST(sum(score) AS DOUBLE) FROM x UNION ALL SELECT 'safety', 1, CAST(count(*) FILTER (risk >= 8) AS DOUBLE) FROM p UNION ALL SELECT 'riskiest', count(*), CAST(sum(risk) AS DOUBLE) FROM p"""


def likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.round(values.similarity_of(F.lower("p_name"), F.lower("p_type")), 6).alias("likeness"), F.round(values.similarity_of(F.col("p_name"), F.lit("")), 6).alias("none"))


#: Dates as documents write them, by the order's key.
DATED = ["%Y-%m-%d", "%m/%d/%Y", "%B %d, %Y", "%Y/%m/%d"]
JAVA_DATES = ["yyyy-MM-dd", "MM/dd/yyyy", "MMMM dd, yyyy", "yyyy/MM/dd"]


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of each customer's order dates, in four spellings, sorted by date."""
    o = table(spark, sf_dir, "orders")
    day = F.coalesce(*(F.when(F.col("o_orderkey") % 4 == k, F.date_format("o_orderdate", x)) for k, x in enumerate(JAVA_DATES)))
    docs = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", day.alias("day")))).alias("days"))
    content = F.concat(F.lit("- "), F.array_join(F.transform("days", lambda x: x["day"]), "\n- "))
    docs = docs.select(F.col("o_custkey").cast("string").alias("path"), content.alias("content"))
    return build.apply_patches(docs, [{"op": "sort-list", "list": 0, "type": "date", "direction": "desc"}]).select("path", "content")


DATED_SQL = f"""SELECT CAST(o_custkey AS VARCHAR) AS path, '- ' || string_agg(CASE o_orderkey % 4 {' '.join(f"WHEN {k} THEN strftime(o_orderdate, '{x}')" for k, x in enumerate(DATED))} END, chr(10) || '- ' ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS content FROM orders GROUP BY 1"""


def broken_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache some of whose entries are damaged, incomplete, or there twice."""
    docs = text_corpus(spark, sf_dir)
    source, k = F.col("doc_id") % 10, F.col("doc_id")
    entry = docs.select("path", F.when(source == 1, F.lit(None).cast("string")).otherwise(values.content_hash(F.col("content"))).alias("source_hash"), F.lit("p").alias("patch_hash"), F.when(source == 2, F.lit("bad")).otherwise(values.content_hash(F.col("content"))).alias("output_hash"), F.col("content").alias("output"), k.alias("doc_id"))
    return entry.unionByName(entry.filter("doc_id % 10 = 3")).drop("doc_id")


def cache_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.cache_problems(broken_cache(spark, sf_dir))


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the cache, and its size."""
    left = stores.repaired(broken_cache(spark, sf_dir))
    return stores.cache_sizes(left).crossJoin(left.agg(F.countDistinct("path").alias("paths")))


def suited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of a test suite, one a document: input, patches, and what is expected, which is wrong for every seventh."""
    from textloom.plans import suites

    docs = shapes(spark, sf_dir)
    right = F.replace("content", F.lit("plain"), F.lit("simple"))
    cases = docs.select(F.col("path").alias("name"), F.col("content").alias("input"), F.lit('[{"op": "replace", "old": "plain", "new": "simple"}]').alias("patches"), F.when(F.col("doc_id") % 7 == 0, F.col("content")).otherwise(right).alias("expected"))
    return suites.run_table(cases).select("name", "passed", F.col("applied").cast("long").alias("applied"), (F.col("diff") == "").alias("same"))


def suggested_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, rows and items that changed between two versions of each document, as patches."""
    source = corpus(spark, sf_dir)
    n = F.regexp_extract("content", r"chars \| (\d+)", 1)
    target = source.withColumn("content", F.replace(F.replace("content", F.concat(F.lit("| chars | "), n, F.lit(" |")), F.lit("| chars | none |")), F.lit("- [x] done"), F.lit("- [x] ready")))
    found = suggest.suggestions(suggest.paired(source, target))
    field = lambda k: F.coalesce(F.get_json_object("patch", f"$.{k}"), F.lit(""))
    return found.select("path", field("op").alias("op"), field("row.value").alias("row"), field("column").alias("column"), F.coalesce(F.get_json_object("patch", "$.content"), F.get_json_object("patch", "$.new")).alias("new"), "score", "checked")


FLAGSHIP = [
    {"op": "replace-regex", "pattern": "plain", "replacement": "simple", "flags": "g"},
    {"op": "append-to-section", "id": "summary", "content": "more"},
    {"op": "rename-header", "id": "data", "new": "Facts", "include": "{en,de}/**"},
    {"op": "sort-table", "table": TABLE + 1, "column": "key"},
    {"op": "deduplicate-list-items", "list": "links"},
    {"op": "set-frontmatter", "key": "built", "value": True},
    {"op": "update-toc"},
    {"op": "remove-section", "id": "missing", "onNoMatch": "warn"},
]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole build: native patches, one fused Python run, validators."""
    config = {"patches": FLAGSHIP, "validators": [{"name": "words", "minWordCount": 5}]}
    out = build.build(corpus(spark, sf_dir), program(config))
    return out.select("doc_id", "path", "content", F.col("applied").cast("long").alias("applied"), F.size("warnings").cast("long").alias("warnings"), F.size("errors").cast("long").alias("errors"))


PLAIN_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "conditions": (conditions, "SELECT doc_id, contains(text, 'the') AND NOT regexp_matches(text, '(?i)token') AND (contains(text, '|') OR starts_with(text, 'The')) AS holds FROM documents"),
    "frontmatter_condition": (frontmatter_condition, "SELECT doc_id, CAST(CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS BIGINT) AS applied, CAST(CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS BIGINT) AS skipped FROM documents"),
    "front_conditions": (front_conditions, FRONT_SQL),
    "validators": (validators, f"SELECT doc_id, CASE WHEN a THEN 'notContains' WHEN b THEN 'matchesRegex' WHEN c THEN 'minWordCount' WHEN d THEN 'maxLineCount' ELSE '' END AS failed, CAST(CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) AS BIGINT) AS n FROM (SELECT doc_id, contains(text, 'password') AS a, NOT regexp_matches(text, '[a-z]') AS b, {WORDS_SQL} < 20 AS c, {LINE_COUNT_SQL} > 40 AS d FROM documents)"),
    "counts": (counts, f"SELECT doc_id, CAST({WORDS_SQL} AS BIGINT) AS words, CAST({LINE_COUNT_SQL} AS BIGINT) AS lines FROM documents"),
    "slugs": (slugs, "SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(p_name || ' -- ' || p_type)), '\\s+', '-', 'g'), '[^a-z0-9_-]', '', 'g'), '-+', '-', 'g'), '-') AS slug FROM part"),
    "fuzzy": (fuzzy, "SELECT value, CAST(levenshtein(value, 'STANDERT') AS BIGINT) AS distance FROM (SELECT DISTINCT p_type AS value FROM part) ORDER BY 2, 1 LIMIT 3"),
    "sections": (sections, by_shape_sql("sections", "id", "title", "level", "start_line", "end_line")),
    "links": (links, by_shape_sql("links", "text", "url")),
    "table_cells": (table_cells, by_shape_sql("table_cells", "row", "header", "value")),
    "list_items": (list_items, by_shape_sql("list_items", "ord", "item", "start_line", "end_line", "ordered", "text", "is_task", "checked")),
    "code_blocks": (code_blocks, by_shape_sql("code_blocks", "ord", "language", "body")),
    "frontmatter": (frontmatter, by_shape_sql("frontmatter", "data")),
    "edges": (edge_rows, EDGE_SQL + "SELECT path, CAST(ord AS BIGINT) AS ord, op FROM e"),
    "coverage": (coverage, EDGE_SQL + "SELECT count(*) AS total, count(h.path) AS patched, count(*) - count(h.path) AS unpatched, round(count(h.path) * 100.0 / count(*), 6) AS percent FROM c LEFT JOIN (SELECT DISTINCT path FROM e WHERE ord IN (1, 2, 3)) h ON c.path = h.path"),
    "unpatched": (unpatched, EDGE_SQL + "SELECT path FROM c WHERE path NOT IN (SELECT path FROM e WHERE ord IN (1, 2, 3))"),
    "impact": (impact, EDGE_SQL + "SELECT CAST(ord AS BIGINT) AS ord, op, count(*) AS files FROM e GROUP BY ord, op"),
    "shared_files": (shared_files, EDGE_SQL + "SELECT path, count(*) AS patches FROM e GROUP BY path HAVING count(*) > 1"),
    "complexity": (complexity, EDGE_SQL + "SELECT path, count(*) AS patches, count(DISTINCT op) AS ops, CAST(sum(CASE WHEN risk >= 8 THEN 1 ELSE 0 END) AS BIGINT) AS high_risk, CAST(count(*) * 2 + count(DISTINCT op) * 1.5 + sum(CASE WHEN risk >= 8 THEN 1 ELSE 0 END) * 3 AS DOUBLE) AS score FROM e GROUP BY path"),
    "safety": (safety, EDGE_SQL + "SELECT count(*) AS patches, count(*) FILTER (risk >= 8) AS high, count(*) FILTER (risk > 3 AND risk < 8) AS medium, count(*) FILTER (risk <= 3) AS low, round(avg(risk), 6) AS mean_risk FROM e"),
    "impact_paths": (impact_paths, EDGE_SQL + "SELECT CAST(ord AS BIGINT) AS ord, max(n) AS files, string_agg(path, ',' ORDER BY path) FILTER (k <= 3) AS paths FROM (SELECT ord, path, row_number() OVER (PARTITION BY ord ORDER BY path) AS k, count(*) OVER (PARTITION BY ord) AS n FROM e) GROUP BY ord"),
    "unreachable": (unreachable, EDGE_SQL + ", " + PATCH_SQL.removeprefix("WITH ") + "SELECT CAST(p.ord AS BIGINT) AS ord, p.op FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.ord = p.ord)"),
    "overlaps": (overlaps, EDGE_SQL + "SELECT CAST(p.ord AS BIGINT) AS a, CAST(q.ord AS BIGINT) AS b, count(*) AS files FROM e p JOIN e q ON p.path = q.path AND p.ord < q.ord GROUP BY p.ord, q.ord"),
    "redundant": (redundant, EDGE_SQL + ", " + PATCH_SQL.removeprefix("WITH ") + "SELECT CAST(x.ord AS BIGINT) AS a, CAST(y.ord AS BIGINT) AS b, count(*) AS files FROM e x JOIN e y ON x.path = y.path AND x.ord < y.ord JOIN p s ON s.ord = x.ord JOIN p t ON t.ord = y.ord WHERE s.op = t.op AND s.what = t.what GROUP BY 1, 2"),
    "snapshot": (snapshot, CORPUS_SQL.replace("n_chars,", "n_chars, text,") + "SELECT path, sha256(text) AS sha256 FROM c"),
    "verify": (verify, STATUS_SQL),
    "corpus_status": (corpus_status, f"SELECT * FROM ({STATUS_SQL}) WHERE status <> 'unchanged'"),
    "line_changes": (line_changes, CORPUS_SQL.replace("n_chars,", "n_chars, text,") + "SELECT CASE WHEN k = 1 THEN 'new/' || path ELSE path END AS path, CAST(CASE WHEN k = 1 THEN 0 WHEN source = 'src2' THEN 1 ELSE n END AS BIGINT) AS removed, CAST(CASE WHEN k = 1 THEN n WHEN source = 'src2' THEN 1 ELSE 0 END AS BIGINT) AS added FROM (SELECT *, len(string_split(text, chr(10))) AS n FROM c), (VALUES (0), (1)) AS v(k) WHERE k = 0 AND source IN ('src1', 'src2', 'src3') OR k = 1 AND source = 'src3'"),
    "stale": (stale, CORPUS_SQL + "SELECT path, CASE WHEN source IN ('src1', 'src3') THEN 'new-file' WHEN source = 'src2' THEN 'source-changed' WHEN source = 'src4' THEN 'patches-changed' ELSE '' END AS reason FROM c"),
    "history_page": (history_page, "SELECT CAST(o_orderkey AS VARCHAR) AS build_id, o_custkey AS files FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 20 OFFSET 5"),
    "history_statistics": (history_statistics, "SELECT count(*) AS builds, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS succeeded, round(avg(o_custkey), 6) AS mean_files FROM orders"),
    "benchmark_statistics": (benchmark_statistics, "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_disc(value, 0.95), 6) AS p95, round(stddev_pop(value), 6) AS stddev FROM events GROUP BY event_type"),
    "renamed": (renamed, "WITH u AS (SELECT any_value(" + PATH_SQL + ") AS path, any_value(source) AS source FROM documents GROUP BY text HAVING count(*) = 1) SELECT path, 'new/' || path AS to_path FROM u WHERE source = 'src3'"),
    "deduplicated": (deduplicated, CORPUS_SQL + "SELECT path, CASE WHEN source LIKE 'src1%' THEN 'new' ELSE 'old' END AS content FROM c"),
    "selected": (selected, CORPUS_SQL + "SELECT path FROM c WHERE (lang IN ('en', 'de') OR (lang = 'fr' AND source = 'src2')) AND NOT regexp_full_match(source, 'src1.')"),
    "plugin": (plugin, all_shapes_sql(lambda x: f"upper({x}) || '!'")),
    "exec": (execute, all_shapes_sql(lambda x: f"replace({x}, 'd', 'D')")),
    "ai_transform": (transform, all_shapes_sql(lambda x: f"{x} || 'end'")),
    "lines": (lines, CORPUS_SQL.replace("n_chars,", "n_chars, text,") + "SELECT path, CAST(k - 1 AS BIGINT) AS line, string_split(text, chr(10))[k] AS text FROM (SELECT path, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM c)"),
    "lineage": (lineage, EDGE_SQL + "SELECT path, string_agg(CAST(ord AS VARCHAR) || ':' || op, ',' ORDER BY ord) AS lineage FROM e GROUP BY path"),
    "configured": (configured, EDGE_SQL + CONFIGURED_SQL),
    "suggestions": (suggestions, CORPUS_SQL + """SELECT path, '{"item": "[home](https://example.com/' || CAST(doc_id AS VARCHAR) || ')", "list": 0, "new": "[home](/d/' || CAST(doc_id AS VARCHAR) || ')", "op": "set-list-item"}' AS patch, CAST(0.9 AS DOUBLE) AS score, CAST(1 AS DOUBLE) AS checked FROM c"""),
    "consolidated": (consolidated, """SELECT '{"content": "end", "op": "append-to-file"}' AS patch, CAST(0.9 AS DOUBLE) AS score, count(*) AS files, '**/*.md' AS include FROM documents"""),
    "nearest": (nearest, """WITH t(target) AS (VALUES ('STANDERT'), ('promoo'), ('LARG')), d AS (
 SELECT target, value, least(levenshtein(target, value), levenshtein(lower(target), lower(value))) AS distance,
 CASE WHEN length(target) <= 5 THEN 2 WHEN length(target) <= 10 THEN 3 WHEN length(target) <= 20 THEN 5 ELSE 7 END AS most
 FROM t, (SELECT DISTINCT p_type AS value FROM part) WHERE target <> value)
SELECT target, value, CAST(distance AS BIGINT) AS distance FROM d WHERE distance <= most QUALIFY row_number() OVER (PARTITION BY target ORDER BY distance, value) <= 5"""),
    "similar_names": (similar_names, SIMILAR_SQL),
    "recovered": (recovered, CORPUS_SQL + "SELECT path, 'summary' AS value, CAST(1 AS BIGINT) AS distance FROM c WHERE doc_id % 5 IN (0, 3)"),
    "incremental": (incremental, CORPUS_SQL.replace("n_chars,", "n_chars, text,") + "SELECT path, replace(text, 'e', 'E') AS content, source IN ('src1', 'src2', 'src3') AS rebuilt FROM c"),
    "rebuilt": (rebuilt, CORPUS_SQL.replace("n_chars,", "n_chars, text,") + REBUILT_SQL),
    "counted": (counted, f"WITH w AS ({WORKED_SQL}) SELECT op, count(DISTINCT path) AS documents, CAST(sum(count) AS BIGINT) AS matches FROM w GROUP BY op"),
    "cache_counted": (cache_counted, CORPUS_SQL.replace("n_chars,", "n_chars, text,") + CACHE_SQL),
    "pruned": (pruned, "SELECT CAST(o_orderkey AS VARCHAR) AS build_id FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 30"),
    "compared": (compared, """WITH f AS (SELECT l_returnflag AS b, CAST(l_partkey AS VARCHAR) AS path, max(l_linenumber) AS h, count(*) AS size FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2)
SELECT coalesce(x.path, y.path) AS path, CASE WHEN x.h IS NULL THEN 'added' WHEN y.h IS NULL THEN 'deleted' WHEN x.h = y.h THEN 'unchanged' ELSE 'modified' END AS status,
 CAST(coalesce(y.size, 0) - coalesce(x.size, 0) AS BIGINT) AS size_delta, CAST(coalesce(y.h, 0) - coalesce(x.h, 0) AS BIGINT) AS patch_delta
FROM (SELECT * FROM f WHERE b = 'A') x FULL JOIN (SELECT * FROM f WHERE b = 'R') y ON x.path = y.path"""),
    "regressions": (regressions, "SELECT event_type AS name, round((max(value) - avg(value)) / avg(value) * 100, 6) AS percent FROM events GROUP BY 1"),
    "corpus_diff": (corpus_diff, DIFF_SQL),
    "patched_corpus": (patched_corpus, CORPUS_SQL.replace("n_chars,", "n_chars, text,") + "SELECT CASE WHEN source = 'src3' THEN 'new/' || path ELSE path END AS path, CASE WHEN source = 'src2' THEN text || '!' ELSE text END AS content FROM c WHERE source <> 'src1'"),
    "moved_sections": (moved_sections, MOVED_SQL),
    "structured": (structured, structured_sql([x[2] for x in FORMS])),
    "structured_edits": (structured_edits, structured_sql(EDITED, ", CAST(CASE WHEN event_id % 4 = 2 THEN 1 ELSE 2 END AS BIGINT) AS applied")),
    "worked": (worked, WORKED_SQL),
    "profiled": (profiled, f"WITH w AS ({WORKED_SQL}) SELECT s AS step, op, CAST(CASE s WHEN 2 THEN (SELECT count(*) FROM documents WHERE lang = 'en') ELSE (SELECT count(*) FROM documents) END AS BIGINT) AS tried, documents, matches FROM (SELECT step AS s, op, count(*) AS documents, CAST(sum(count) AS BIGINT) AS matches FROM w GROUP BY 1, 2)"),
    "replayed": (replayed, replayed_sql()),
    "by_operation": (by_operation, f"WITH w AS ({WORKED_SQL}) SELECT op, count(DISTINCT path) AS documents, CAST(sum(count) AS BIGINT) AS matches FROM w GROUP BY op"),
    "missed": (missed, CORPUS_SQL + "SELECT path, 'section ' || chr(39) || 'summary' || chr(39) AS hint, CAST(0.85 AS DOUBLE) AS confidence FROM c WHERE doc_id % 5 IN (0, 3)"),
    "missed_ways": (missed_ways, MISSED_SQL),
    "hinted": (hinted, HINTED_SQL),
    "previewed": (previewed, PREVIEWED_SQL),
    "rolled_back": (rolled_back, "WITH v AS (SELECT l_linenumber AS n, CAST(l_partkey AS VARCHAR) AS path, CAST(max(l_orderkey) AS VARCHAR) AS output FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2) SELECT path, max_by(output, n) AS output FROM v GROUP BY path"),
    "word_similarity": (word_similarity, "SELECT p_partkey, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS likeness FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS a, list_distinct(string_split(lower(p_type || ' ' || p_brand), ' ')) AS b FROM part)"),
    "versioned": (versioned, VERSIONED_SQL),
    "region_tables": (region_tables, "SELECT 'r' || CAST(n_regionkey AS VARCHAR) || '.md' AS path, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) - 1 AS BIGINT) AS row, n_name AS name FROM nation WHERE regexp_matches(n_name, '[13579]$')"),
    "locale_rank": (locale_rank, f"SELECT p_brand, name, row_number() OVER (PARTITION BY p_brand ORDER BY name COLLATE en) AS place FROM ({SPELLED_SQL} part)"),
    "locale_lists": (locale_lists, LOCALE_LISTS_SQL),
    "archived": (archived, CORPUS_SQL.replace("n_chars,", "n_chars, text,") + "SELECT source AS archive, path, strlen(text) AS size, text AS content FROM c WHERE lang IN ('en', 'fr') AND text IS NOT NULL"),
    "scanned": (scanned, CORPUS_SQL.replace("n_chars,", "n_chars, text,") + "SELECT path, text AS content FROM c WHERE text IS NOT NULL"),
    "cleaned": (cleaned, CORPUS_SQL + "SELECT path FROM c WHERE source = 'src1'"),
    "reported": (reported, EDGE_SQL + "SELECT path, CAST(ord AS BIGINT) AS ord, op FROM e"),
    "pinned": (pinned, "SELECT 'https://h.com/' || s_name || '.zip' AS url, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'https://h.com/' || s_name || '.zip' END AS resolved, CASE WHEN s_suppkey % 3 = 0 THEN 'sha256-' || sha256('https://h.com/' || s_name || '.zip') END AS integrity FROM supplier"),
    "grouped": (grouped, grouped_sql()),
    "nested_front": (nested_front, CORPUS_SQL + "SELECT path, CASE WHEN lang = 'en' THEN 'AB' ELSE '' END AS tail, CAST(CASE WHEN lang = 'en' THEN 3 ELSE 0 END AS BIGINT) AS applied, CAST(CASE WHEN lang = 'en' THEN 1 ELSE 3 END AS BIGINT) AS skipped FROM c"),
    "overlapping": (overlapping, EDGE_SQL + "SELECT CAST(x.ord AS BIGINT) AS a, CAST(y.ord AS BIGINT) AS b, count(*) AS files FROM e x JOIN e y ON x.path = y.path AND x.ord = 0 AND y.ord = 5 GROUP BY 1, 2"),
    "most_complex": (most_complex, EDGE_SQL + "SELECT path, count(*) AS patches, CAST(count(*) * 2 + count(DISTINCT op) * 1.5 + sum(CASE WHEN risk >= 8 THEN 1 ELSE 0 END) * 3 AS DOUBLE) AS score FROM e GROUP BY path ORDER BY 3 DESC, path LIMIT 25"),
    "bundled": (bundled, BUNDLED_SQL),
    "likeness": (likeness, "SELECT p_partkey, round(1 - levenshtein(lower(p_name), lower(p_type)) / CAST(greatest(length(p_name), length(p_type)) AS DOUBLE), 6) AS likeness, CAST(0 AS DOUBLE) AS none FROM part"),
    "dated": (dated, DATED_SQL),
    "cache_problems": (cache_problems, CORPUS_SQL + "SELECT path, CASE doc_id % 10 WHEN 1 THEN 'incomplete' WHEN 2 THEN 'damaged' ELSE 'twice' END AS problem FROM c WHERE doc_id % 10 IN (1, 2, 3)"),
    "repaired": (repaired, "SELECT count(*) AS entries, CAST(1 AS BIGINT) AS programs, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS paths FROM documents WHERE doc_id % 10 NOT IN (1, 2, 3)"),
    "suited": (suited, CORPUS_SQL + "SELECT path AS name, doc_id % 7 <> 0 OR doc_id % 5 = 4 AS passed, CAST(CASE WHEN doc_id % 5 = 4 THEN 0 ELSE 1 END AS BIGINT) AS applied, doc_id % 7 <> 0 OR doc_id % 5 = 4 AS same FROM c"),
    "suggested_cells": (suggested_cells, CORPUS_SQL + "SELECT path, op, row, col AS \"column\", new, CAST(0.9 AS DOUBLE) AS score, CAST(1 AS DOUBLE) AS checked FROM c, (VALUES ('replace-table-cell', 'chars', 'value', 'none'), ('set-list-item', '', '', 'ready')) AS t(op, row, col, new)"),
    "streamed": (streamed, CORPUS_SQL.replace("n_chars,", "n_chars, text,") + "SELECT path, replace(CASE WHEN source = 'src2' THEN text || 'old' ELSE text END, 'e', 'E') AS output FROM c"),
    "debounced": (debounced, CORPUS_SQL.replace("n_chars,", "n_chars, text,") + "SELECT path, CASE WHEN source = 'src2' THEN NULL ELSE text END AS content, CAST(2 AS BIGINT) AS events FROM c"),
}


def flagship_sql() -> str:
    lines = [x.replace("plain", "simple") for x in TEMPLATE]
    out: list[str] = []
    for k, x in enumerate(lines):
        if k == 5:
            out.append("built: true")
        if k == 16:
            out.append("more")
        if k in (20, 21, 22, 23):
            x = {20: CHARS, 21: LANG, 22: LANG, 23: SOURCE}[k]
        if k == 30:
            continue
        if k == 33:
            out += ["- [Summary](#summary)", "  - [Detail](#detail)", "- [Data](#data)", "- [Links](#links)"]
            continue
        out.append(x)
    other = [x.replace("## Data", "## Facts").replace("[Data](#data)", "[Facts](#facts)") for x in out]
    count = "CASE WHEN lang IN ('en', 'de') THEN 1 ELSE 0 END"
    return f"SELECT doc_id, {PATH_SQL} AS path, CASE WHEN lang IN ('en', 'de') THEN {filled_sql(other)} ELSE {filled_sql(out)} END AS content, CAST(6 + {count} AS BIGINT) AS applied, CAST(1 AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS errors FROM documents"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f"patch_{name}": patch_query(patch) for name, patch, _ in PATCHES}
    out |= {name: text_query(patch) for name, patch, _ in TEXT}
    out |= {f"file_{name}": file_query(patch) for name, patch, _ in FILES}
    out |= {name: json_query(patch) for name, patch, _ in JSON}
    return {"flagship": flagship} | out | {name: q for name, (q, _) in PLAIN_QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {f"patch_{name}": patch_sql(name, lines) for name, _, lines in PATCHES}
    out |= {name: sql for name, _, sql in TEXT}
    out |= {f"file_{name}": CORPUS_SQL.replace(" FROM documents", f", {CONTENT} AS content FROM documents") + sql for name, _, sql in FILES}
    out |= {name: sql for name, _, sql in JSON}
    return {"flagship": flagship_sql()} | out | {name: sql for name, (_, sql) in PLAIN_QUERIES.items() if sql}
