"""Content operators as Column expressions: text, line and section patches that never leave the JVM.

Tables, lists and tables of contents are in `blocks`. `build(patch, content)` gives the new content and the count as columns, or None where only Python has the exact semantics.
Sections are found in place: header lines are numbered and the first with the wanted id and its end are looked up by
array functions, so no document is exploded.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.patterns import Unsupported, from_js, java_replacement
from textloom.functions.values import occurrences, slug_of
from textloom.operators import blocks

Pair = tuple[Column, Column]

HEADER = r"^(#{1,6})[\s ﻿]+([^\n\r  ]+)\z"
CUSTOM = r"\{#([A-Za-z0-9_-]+)\}\s*\z"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def text_of(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def array_of(text: str) -> Column:
    return F.array(*(F.lit(x) for x in text.split("\n")))


def first_where(lines: Column, test: Callable[[Column, Column], Column]) -> Column:
    """0-based place of the first line that passes, null if none."""
    places = F.transform(lines, lambda x, i: F.when(test(x, i), i))
    return F.array_min(places)


def taken(lines: Column, start: Column | int, end: Column) -> Column:
    """Lines start to end, exclusive."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.slice(lines, start + 1, F.greatest(end - start, F.lit(0)))


def spliced(lines: Column, start: Column, end: Column, new: Column | None) -> Column:
    parts = [taken(lines, 0, start), *([new] if new is not None else []), taken(lines, end, F.size(lines))]
    return text_of(F.concat(*parts))


def given(found: Column, text: Column, new: Column, count: Column | int = 1) -> Pair:
    """The new text where something was found."""
    count = F.lit(count) if isinstance(count, int) else count
    return F.when(found, new).otherwise(text), F.when(found, count).otherwise(0).cast("int")


# Text


def replace(c: Column, p: dict) -> Pair:
    return F.replace(c, F.lit(p["old"]), F.lit(p["new"])), occurrences(c, p["old"])


def replace_regex(c: Column, p: dict) -> Pair:
    flags = "".join(x for x in p.get("flags", "") if x in "ims")
    pattern = from_js(p["pattern"], flags)
    groups = re.compile(from_js(p["pattern"], flags, "python"))
    new = java_replacement(p["replacement"], groups.groups, tuple(groups.groupindex))
    return F.regexp_replace(c, pattern, new), F.regexp_count(c, F.lit(pattern)).cast("int")


def prepend_to_file(c: Column, p: dict) -> Pair:
    return F.concat(F.lit(p["content"]), c), F.lit(1)


def append_to_file(c: Column, p: dict) -> Pair:
    return F.concat(c, F.lit(p["content"])), F.lit(1)


# Lines


def replace_line(c: Column, p: dict) -> Pair:
    lines = lines_of(c)
    n = F.size(F.filter(lines, lambda x: x == p["match"]))
    return given(n > 0, c, text_of(F.transform(lines, lambda x: F.when(x == p["match"], F.lit(p["replacement"])).otherwise(x))), n)


def insert_at_lines(c: Column, p: dict, after: bool) -> Pair:
    if p.get("match") is not None:
        test = lambda x: x == p["match"]
    elif p.get("pattern") is not None and p.get("regex"):
        rx = from_js(p["pattern"])
        test = lambda x: x.rlike(rx)
    else:
        return c, F.lit(0)
    lines, new = lines_of(c), F.lit(p["content"])
    n = F.size(F.filter(lines, test))
    grown = F.flatten(F.transform(lines, lambda x: F.when(test(x), F.array(x, new) if after else F.array(new, x)).otherwise(F.array(x))))
    return given(n > 0, c, text_of(grown), n)


def between(c: Column, p: dict, new: Column | None) -> Pair:
    lines, a = (F.col("_lines"), F.col("_first")) if STAGED in p else (lines_of(c), None)
    a = first_where(lines, lambda x, i: F.contains(x, F.lit(p["start"]))) if a is None else a
    b = first_where(lines, lambda x, i: (i > a) & F.contains(x, F.lit(p["end"])))
    inner = p.get("inclusive", True) is False
    return given(b.isNotNull(), c, spliced(lines, a + 1 if inner else a, b if inner else b + 1, new))


# Sections


def heads_of(lines: Column) -> Column:
    """Header lines: place, level, id and title."""

    def one(x: Column, i: Column) -> Column:
        title = blocks.strip(F.regexp_extract(x, HEADER, 2))
        custom = F.regexp_extract(title, CUSTOM, 1)
        plain = F.when(custom != "", blocks.strip(F.regexp_replace(title, r"\s*" + CUSTOM, ""))).otherwise(title)
        return F.struct(i.alias("at"), F.length(F.regexp_extract(x, HEADER, 1)).alias("level"), F.when(custom != "", custom).otherwise(slug_of(title)).alias("id"), plain.alias("title"))

    return F.filter(F.transform(lines, lambda x, i: F.when(F.startswith(x, F.lit("#")) & x.rlike(HEADER), one(x, i))), lambda h: h.isNotNull())


def sections_of(lines: Column, heads: Column) -> Column:
    """id, level, start, end (exclusive), title of every section."""

    def one(h: Column) -> Column:
        after = F.filter(heads, lambda g: (g["at"] > h["at"]) & (g["level"] <= h["level"]))
        end = F.coalesce(F.array_min(after["at"]), F.size(lines))
        return F.struct(h["id"].alias("id"), h["level"].alias("level"), h["at"].alias("start"), end.alias("end"), h["title"].alias("title"))

    return F.transform(heads, one)


class Place:
    """Lines of a text and one section of it."""

    def __init__(self, text: Column, name: str, patch: dict) -> None:
        staged = STAGED in patch
        self.lines = F.col("_lines") if staged else lines_of(text)
        self.heads = F.col("_heads") if staged else heads_of(self.lines)
        head = F.get(F.filter(self.heads, lambda h: h["id"] == name), F.lit(0))
        self.start, self.level = head["at"], head["level"]
        after = F.filter(self.heads, lambda g: (g["at"] > self.start) & (g["level"] <= self.level))
        self.end = F.coalesce(F.array_min(after["at"]), F.size(self.lines))
        self.there = head.isNotNull()


def remove_section(c: Column, p: dict) -> Pair:
    s = Place(c, p["id"], p)
    end = s.end
    if p.get("includeChildren", True) is False:
        end = F.least(s.end, F.coalesce(F.array_min(F.filter(s.heads, lambda g: g["at"] > s.start)["at"]), s.end))
    return given(s.there, c, spliced(s.lines, s.start, end, None))


def replace_section(c: Column, p: dict) -> Pair:
    s = Place(c, p["id"], p)
    return given(s.there, c, spliced(s.lines, s.start + 1, s.end, array_of(p["content"])))


def prepend_to_section(c: Column, p: dict) -> Pair:
    s = Place(c, p["id"], p)
    return given(s.there, c, spliced(s.lines, s.start + 1, s.start + 1, F.array(F.lit(p["content"]))))


def append_to_section(c: Column, p: dict) -> Pair:
    s = Place(c, p["id"], p)
    return given(s.there, c, spliced(s.lines, s.end, s.end, F.array(F.lit(p["content"]))))


def replace_in_section(c: Column, p: dict) -> Pair:
    s = Place(c, p["id"], p)
    body = text_of(taken(s.lines, s.start + 1, s.end))
    n = F.coalesce(occurrences(body, p["old"]), F.lit(0))
    return given(s.there & (n > 0), c, spliced(s.lines, s.start + 1, s.end, F.array(F.replace(body, F.lit(p["old"]), F.lit(p["new"])))), n)


def rename_header(c: Column, p: dict) -> Pair:
    s = Place(c, p["id"], p)
    line = F.concat(F.repeat(F.lit("#"), s.level), F.lit(f" {p['new']}" if p["new"] else ""))
    return given(s.there, c, spliced(s.lines, s.start, s.start + 1, F.array(line)))


def change_section_level(c: Column, p: dict) -> Pair:
    s = Place(c, p["id"], p)
    level = F.greatest(F.lit(1), F.least(F.lit(6), s.level + p["delta"]))
    line = F.concat(F.repeat(F.lit("#"), level), F.regexp_replace(F.get(s.lines, s.start), "^#{1,6}", ""))
    return given(s.there, c, spliced(s.lines, s.start, s.start + 1, F.array(line)))


def insert_section(c: Column, p: dict) -> Pair:
    s = Place(c, p["id"], p)
    body = ["", *p["content"].removesuffix("\n").split("\n")] if p.get("content") else []
    new = F.array(*(F.lit(x) for x in [p["header"], *body, ""]))
    at = s.start if p.get("position") == "before" else s.end
    return given(s.there, c, spliced(s.lines, at, at, new))


def move_section(c: Column, p: dict) -> Pair:
    if p["id"] == p["after"]:
        return c, F.lit(0)
    s, to = Place(c, p["id"], p), Place(c, p["after"], p)
    moved = taken(s.lines, s.start, s.end)
    # Once cut, a section that held the moved one ends earlier; one before it ends where the next header of its level is.
    rest_end = F.coalesce(F.array_min(F.filter(to.heads, lambda g: (g["at"] > to.start) & (g["level"] <= to.level) & ((g["at"] < s.start) | (g["at"] >= s.end)))["at"]), F.size(s.lines))
    before, after = F.least(rest_end, s.start), F.greatest(rest_end, s.end)
    forward = F.concat(taken(s.lines, 0, s.start), taken(s.lines, s.end, after), moved, taken(s.lines, after, F.size(s.lines)))
    backward = F.concat(taken(s.lines, 0, before), moved, taken(s.lines, before, s.start), taken(s.lines, s.end, F.size(s.lines)))
    ok = s.there & to.there & ~((to.start >= s.start) & (to.start < s.end))
    return given(ok, c, text_of(F.when(rest_end <= s.start, backward).otherwise(forward)))


BUILDERS: dict[str, Callable[[Column, dict], Pair]] = {
    "replace": replace,
    "replace-regex": replace_regex,
    "prepend-to-file": prepend_to_file,
    "append-to-file": append_to_file,
    "replace-line": replace_line,
    "insert-after-line": lambda c, p: insert_at_lines(c, p, True),
    "insert-before-line": lambda c, p: insert_at_lines(c, p, False),
    "delete-between": lambda c, p: between(c, p, None),
    "replace-between": lambda c, p: between(c, p, array_of(p["content"])),
    "remove-section": remove_section,
    "replace-section": replace_section,
    "prepend-to-section": prepend_to_section,
    "append-to-section": append_to_section,
    "replace-in-section": replace_in_section,
    "rename-header": rename_header,
    "change-section-level": change_section_level,
    "insert-section": insert_section,
    "move-section": move_section,
    "update-toc": blocks.update_toc,
} | {op: blocks.builder(op) for op in (*blocks.TABLE_OPS, *blocks.LIST_OPS)}


#: Operators whose `id` names a section.
SECTION = {"remove-section", "replace-section", "prepend-to-section", "append-to-section", "replace-in-section", "rename-header", "change-section-level", "insert-section", "move-section"}
#: Marks a patch whose document's lines, headers or first marker are columns already.
STAGED = "_staged"
STAGES = ("_lines", "_heads", "_first", *blocks.STAGES)


def staged(df: DataFrame, patch: dict) -> tuple[DataFrame, dict]:
    """df with what a patch's expressions refer to again and again, each computed once in a projection of its own."""
    op = patch["op"]
    block = patch.get("table", patch.get("list")) if op in blocks.TABLE_OPS or op in blocks.LIST_OPS else None
    toc = op == "update-toc"
    sections = "id" in patch and op in BUILDERS and op in SECTION or toc or isinstance(block, str)
    if not sections and not op.endswith("-between") and block is None:
        return df, patch
    df = df.withColumn("_lines", lines_of(F.col("content")))
    if sections:
        df = df.withColumn("_heads", heads_of(F.col("_lines")))
    if toc or op.endswith("-between"):
        start = patch.get("marker", "<!-- TOC -->") if toc else patch["start"]
        df = df.withColumn("_first", first_where(F.col("_lines"), lambda x, i: F.contains(x, F.lit(start))))
    if block is not None:
        for name, column in blocks.table_stages(block) if op in blocks.TABLE_OPS else blocks.list_stages(block):
            df = df.withColumn(name, column)
    return df, patch | {STAGED: True}


def build(patch: dict, content: Column) -> Pair | None:
    """New content and count, or None if this patch needs Python."""
    builder = BUILDERS.get(patch["op"])
    try:
        return builder(content, patch) if builder else None
    except Unsupported:
        return None
