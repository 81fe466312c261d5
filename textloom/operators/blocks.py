"""Tables, lists and tables of contents as columns: parsed, changed and written back by higher-order functions.

A stage of its own parses the one table or list that a patch means into a struct (`_block`), so every step after it refers
to a column. Strings sort in the root locale's order (the UNICODE collation); sorting by dates is Python's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.patterns import from_js

Pair = tuple[Column, Column]

#: White space as str.strip knows it.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LOCALE = "UNICODE"
BULLET, NUMBER, TASK = r"^[-*+] ", r"^\d+\. ", r"^\[([ xX])\] "
NUMERIC = r"^[\s\x1c-\x1f\x85\xa0]*([+-]?(?:Infinity|[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?))"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"\A{WHITE}+|{WHITE}+\z", "")


def upto(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def part(x: Column, start: Column | int, end: Column) -> Column:
    """Items start to end, exclusive."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.slice(x, start + 1, F.greatest(end - start, F.lit(0)))


def inserted(x: Column, at: Column, new: Column) -> Column:
    return F.concat(part(x, 0, at), F.array(new), part(x, at, F.size(x)))


def literals(values: list) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def first(x: Column) -> Column:
    return F.get(x, F.lit(0))


def place(position: int | None, size: Column) -> Column:
    """Where an insertion goes: at a position that exists, else at the end."""
    return size if position is None or position < 0 else F.when(F.lit(position) >= size, size).otherwise(F.lit(position))


# Parsing. The stage's columns: _lines, _heads where a section is named.


def cells(line: Column) -> Column:
    """A table line's cells, null if it is none."""
    x = strip(line)
    whole = (F.length(x) > 1) & F.startswith(x, F.lit("|")) & F.endswith(x, F.lit("|"))
    return F.when(whole, F.transform(F.split(x.substr(F.lit(2), F.length(x) - 2), r"\|", -1), strip))


def section_bounds(name: str) -> tuple[Column, Column]:
    head = first(F.filter(F.col("_heads"), lambda h: h["id"] == name))
    after = F.filter(F.col("_heads"), lambda h: (h["at"] > head["at"]) & (h["level"] <= head["level"]))
    return head["at"], F.coalesce(F.array_min(after["at"]), F.size("_lines"))


def chosen(found: Column, which: int | str, inside: Callable[[Column], Column]) -> Column:
    """The first block that a number means, or that lies within a section. found: start and end (inclusive) of blocks."""
    if isinstance(which, int):
        return first(F.filter(found, inside))
    start, end = section_bounds(which)
    return first(F.filter(found, lambda b: (b["start"] >= start) & (b["end"] < end)))


def table_stages(which: int | str) -> list[tuple[str, Column]]:
    """Columns to add one after the other; the last is the table: start, end, headers, rules, rows."""
    lines = F.col("_lines")
    parsed = F.transform(lines, lambda x: F.when(F.contains(x, F.lit("|")), cells(x)))
    row = lambda k: F.get("_cells", k)
    rule = lambda k: (F.size(row(k + 1)) == F.size(row(k))) & F.forall(row(k + 1), lambda c: c.rlike(r"\A:?-+:?\z"))
    heads = F.filter(upto(F.size(lines) - 2), lambda k: F.coalesce((F.size(row(k)) > 0) & rule(k), F.lit(False)))

    def bounds(k: Column) -> Column:
        other = F.filter(upto(F.size(lines)), lambda j: (j > k + 1) & ~F.coalesce(F.size(row(j)) == F.size(row(k)), F.lit(False)))
        return F.struct(k.alias("start"), (F.coalesce(F.array_min(other), F.size(lines)) - 1).alias("end"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    apart = F.aggregate(F.transform(F.col("_starts"), bounds), none, lambda done, b: F.when(F.size(done) == 0, F.array(b)).when(b["start"] > F.element_at(done, -1)["end"], F.concat(done, F.array(b))).otherwise(done))
    at = F.col("_at")
    got = F.struct(at["start"].alias("start"), at["end"].alias("end"), row(at["start"]).alias("headers"), row(at["start"] + 1).alias("rules"), part(F.col("_cells"), at["start"] + 2, at["end"] + 1).alias("rows"))
    return [("_cells", parsed), ("_starts", heads), ("_at", chosen(apart, which, lambda b: (b["start"] <= which) & (b["end"] >= which))), ("_block", F.when(at.isNotNull(), got))]


def list_stages(which: int | str) -> list[tuple[str, Column]]:
    """Columns to add one after the other; the last is the list: start, end, bullet, items (text, task, lines)."""
    lines = F.col("_lines")
    breaks = F.filter(F.transform(lines, lambda x, i: F.when((strip(x) == "") | F.startswith(x, F.lit("#")), i)), lambda i: i.isNotNull())
    marks = F.transform(lines, lambda x: F.when((strip(x) == "") | F.startswith(x, F.lit("#")), "b").when(x.rlike(BULLET), "-").when(x.rlike(NUMBER), "1").otherwise(""))
    # a list begins with the first marker after a break and lasts to the next break
    step = lambda acc, m: F.struct((acc["n"] + 1).alias("n"), F.when(m == "b", F.lit(False)).otherwise(acc["open"] | (m != "")).alias("open"), F.when(~acc["open"] & m.isin("-", "1"), F.concat(acc["starts"], F.array(acc["n"]))).otherwise(acc["starts"]).alias("starts"))
    begin = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate("_marks", begin, step, lambda acc: acc["starts"])
    bounds = F.transform("_starts", lambda s, k: F.struct(s.alias("start"), (F.coalesce(F.array_min(F.filter("_breaks", lambda b: b > s)), F.size(lines)) - 1).alias("end"), k.alias("k")))
    at = F.col("_at")
    kind = F.get("_marks", at["start"])
    own = F.filter(upto(F.size(lines)), lambda i: (i >= at["start"]) & (i <= at["end"]) & (F.get("_marks", i) == kind))

    def item(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_items", k + 1), at["end"] + 1)
        body = F.regexp_replace(F.get(lines, i), F.when(kind == "1", F.lit(NUMBER)).otherwise(F.lit(BULLET)), F.lit(""))
        task = F.regexp_extract(body, TASK, 1)
        text = F.when(task != "", body.substr(F.lit(5), F.length(body))).otherwise(body)
        return F.struct(text.alias("text"), F.when(task == "", "").when(task == " ", "[ ] ").otherwise("[x] ").alias("task"), part(lines, i, end).alias("lines"))

    bullet = F.regexp_extract(F.get(lines, at["start"]), rf"{BULLET}|{NUMBER}", 0)
    got = F.struct(at["start"].alias("start"), at["end"].alias("end"), bullet.alias("bullet"), F.transform("_items", item).alias("items"))
    return [("_breaks", breaks), ("_marks", marks), ("_starts", starts), ("_at", chosen(bounds, which, lambda b: b["k"] == which)), ("_items", F.when(at.isNotNull(), own)), ("_block", F.when(at.isNotNull(), got))]


STAGES = ("_cells", "_starts", "_at", "_block", "_breaks", "_marks", "_items")


# What both share: orders, tests and survivors of rows or items.


def ordered(items: Column, key: Callable[[Column], Column], kind: str, direction: str) -> Column:
    """Items by key; equal ones keep their places in either direction."""
    if kind == "number":
        sort_key = lambda x: F.coalesce(F.regexp_extract(key(x), NUMERIC, 1).try_cast("double"), F.lit(0.0))
    else:
        sort_key = lambda x: F.collate(key(x), LOCALE)
    down = direction == "desc"
    keyed = F.transform(items, lambda x, i: F.struct(sort_key(x).alias("k"), (-i if down else i).alias("i")))
    return F.transform(F.sort_array(keyed, asc=not down), lambda x: F.get(items, F.abs(x["i"])))


def test(match: str | None, pattern: str | None, invert: bool) -> Callable[[Column], Column]:
    rx = from_js(pattern) if pattern is not None else None

    def keep(value: Column) -> Column:
        hit = value.rlike(rx) if rx is not None else value == match if match is not None else F.lit(True)
        return ~hit if invert else hit

    return keep


def survivors(items: Column, key: Callable[[Column], Column], keep: str) -> Column:
    """The first or last of items with equal keys, in order, by a sort."""
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
    step = 1 if keep == "last" else -1
    alone = F.filter(keyed, lambda x, j: ~F.coalesce(F.get(keyed, F.when(j + step >= 0, j + step).otherwise(F.size(items)))["k"] == x["k"], F.lit(False)))
    return F.transform(F.array_sort(F.transform(alone, lambda x: x["i"])), lambda i: F.get(items, i))


# Tables


class Table:
    """The parsed table's parts; changes set new ones. ok: whether the patch applies; n: its count."""

    def __init__(self) -> None:
        b = F.col("_block")
        self.there, self.start, self.end = b.isNotNull(), b["start"], b["end"]
        self.headers, self.rows = b["headers"], b["rows"]
        self.sides = F.transform(b["rules"], lambda c: F.when(F.startswith(c, F.lit(":")) & F.endswith(c, F.lit(":")), ":---:").when(F.startswith(c, F.lit(":")), ":---").when(F.endswith(c, F.lit(":")), "---:").otherwise("---"))
        self.width = F.size(b["headers"])
        self.n: Column = F.lit(1)

    def column(self, column: int | str) -> Column:
        """A column's place, null if there is none."""
        if isinstance(column, int):
            return F.when((F.lit(column) >= 0) & (F.lit(column) < self.width), F.lit(column))
        at = F.array_position(self.headers, column).cast("int")
        return F.when(at > 0, at - 1)

    def row(self, row: int | dict) -> Column:
        if isinstance(row, int):
            return F.when((F.lit(row) >= 0) & (F.lit(row) < F.size(self.rows)), F.lit(row))
        c = self.column(row["column"])
        at = F.array_position(F.transform(self.rows, lambda r: F.get(r, c)), row["value"]).cast("int")
        return F.when(at > 0, at - 1)

    def all_rows(self, change: Callable[[Column], Column]) -> None:
        self.headers, self.sides, self.rows = change(self.headers), change(self.sides), F.transform(self.rows, change)

    def written(self) -> Column:
        line = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
        return F.concat(F.array(line(self.headers), line(self.sides)), F.transform(self.rows, line))


def replace_table_cell(t: Table, p: dict) -> None:
    r, c = t.row(p["row"]), t.column(p["column"])
    t.n = F.when(r.isNotNull() & c.isNotNull(), 1).otherwise(0)
    t.rows = F.transform(t.rows, lambda row, i: F.when(i == r, F.transform(row, lambda v, j: F.when(j == c, p["content"]).otherwise(v))).otherwise(row))


def add_table_row(t: Table, p: dict) -> None:
    values = literals([str(v) for v in p["values"]])
    row = F.transform(upto(t.width), lambda i: F.coalesce(F.get(values, i), F.lit("")))
    t.rows = inserted(t.rows, place(p.get("position"), F.size(t.rows)), row)


def remove_table_row(t: Table, p: dict) -> None:
    r = t.row(p["row"])
    t.n, t.rows = r.isNotNull().cast("int"), F.filter(t.rows, lambda row, i: i != r)


def add_table_column(t: Table, p: dict) -> None:
    at = place(p.get("position"), t.width)
    t.headers, t.sides = inserted(t.headers, at, F.lit(p["header"])), inserted(t.sides, at, F.lit("---"))
    t.rows = F.transform(t.rows, lambda row: inserted(row, at, F.lit(p.get("defaultValue", ""))))


def remove_table_column(t: Table, p: dict) -> None:
    c = t.column(p["column"])
    t.n = c.isNotNull().cast("int")
    t.all_rows(lambda row: F.filter(row, lambda v, i: i != c))


def rename_table_column(t: Table, p: dict) -> None:
    c = t.column(p["column"])
    t.n, t.headers = c.isNotNull().cast("int"), F.transform(t.headers, lambda v, i: F.when(i == c, p["new"]).otherwise(v))


def reorder_table_columns(t: Table, p: dict) -> None:
    at = F.array(*(F.coalesce(t.column(c), F.lit(-1)) for c in p["columns"])) if p["columns"] else F.array().cast("array<int>")
    t.n = (F.array_sort(at) == upto(t.width)).cast("int")
    t.all_rows(lambda row: F.transform(at, lambda i: F.get(row, F.when(i >= 0, i))))


def sort_table(t: Table, p: dict) -> None:
    c = t.column(p["column"])
    t.n, t.rows = c.isNotNull().cast("int"), ordered(t.rows, lambda row: F.get(row, c), p.get("type", "string"), p.get("direction", "asc"))


def filter_table_rows(t: Table, p: dict) -> None:
    c, keep = t.column(p["column"]), test(p.get("match"), p.get("pattern"), p.get("invert", False))
    t.n, t.rows = c.isNotNull().cast("int"), F.filter(t.rows, lambda row: keep(F.get(row, c)))


def deduplicate_table_rows(t: Table, p: dict) -> None:
    c = t.column(p["column"]) if p.get("column") is not None else None
    left = survivors(t.rows, (lambda row: row) if c is None else (lambda row: F.get(row, c)), p.get("keep", "first"))
    removed = F.size(t.rows) - F.size(left)
    t.n, t.rows = removed if c is None else F.when(c.isNotNull(), removed).otherwise(0), left


# Lists


class Items:
    """The parsed list's items; changes set new ones."""

    def __init__(self) -> None:
        b = F.col("_block")
        self.there, self.start, self.end, self.bullet, self.items = b.isNotNull(), b["start"], b["end"], b["bullet"], b["items"]
        self.n: Column = F.lit(1)

    def place(self, item: int | str) -> Column:
        if isinstance(item, int):
            return F.when((F.lit(item) >= 0) & (F.lit(item) < F.size(self.items)), F.lit(item))
        at = F.array_position(self.items["text"], item).cast("int")
        return F.when(at > 0, at - 1)

    def new(self, text: Column, task: Column, lines: Column) -> Column:
        return F.struct(text.alias("text"), task.alias("task"), lines.alias("lines"))

    def written(self) -> Column:
        return F.flatten(F.transform(self.items, lambda x: x["lines"]))


def add_list_item(x: Items, p: dict) -> None:
    item = x.new(F.lit(p["item"]), F.lit(""), F.array(F.concat(x.bullet, F.lit(p["item"]))))
    x.items = inserted(x.items, place(p.get("position"), F.size(x.items)), item)


def remove_list_item(x: Items, p: dict) -> None:
    at = x.place(p["item"])
    x.n, x.items = at.isNotNull().cast("int"), F.filter(x.items, lambda v, i: i != at)


def set_list_item(x: Items, p: dict) -> None:
    at = x.place(p["item"])
    line = lambda v: F.concat(x.bullet, v["task"], F.lit(p["new"]))
    x.n = at.isNotNull().cast("int")
    x.items = F.transform(x.items, lambda v, i: F.when(i == at, x.new(F.lit(p["new"]), v["task"], F.concat(F.array(line(v)), part(v["lines"], 1, F.size(v["lines"]))))).otherwise(v))


def sort_list(x: Items, p: dict) -> None:
    x.items = ordered(x.items, lambda v: v["text"], p.get("type", "string"), p.get("direction", "asc"))


def filter_list_items(x: Items, p: dict) -> None:
    keep = test(p.get("match"), p.get("pattern"), p.get("invert", False))
    left = F.filter(x.items, lambda v: keep(v["text"]))
    x.n, x.items = F.size(x.items) - F.size(left), left


def deduplicate_list_items(x: Items, p: dict) -> None:
    left = survivors(x.items, lambda v: v["text"], p.get("keep", "first"))
    x.n, x.items = F.size(x.items) - F.size(left), left


def reorder_list_items(x: Items, p: dict) -> None:
    at = F.array(*(F.coalesce(x.place(i), F.lit(-1)) for i in p["order"])) if p["order"] else F.array().cast("array<int>")
    x.n = (F.array_sort(at) == upto(F.size(x.items))).cast("int")
    x.items = F.transform(at, lambda i: F.get(x.items, F.when(i >= 0, i)))


def changed(block: Table | Items, change: Callable, text: Column, patch: dict) -> Pair:
    change(block, patch)
    lines = F.col("_lines")
    done = block.there & (block.n > 0)
    new = F.array_join(F.concat(part(lines, 0, block.start), block.written(), part(lines, block.end + 1, F.size(lines))), "\n")
    return F.when(done, new).otherwise(text), F.when(done, block.n).otherwise(0).cast("int")


TABLE_OPS = {f.__name__.replace("_", "-"): f for f in (replace_table_cell, add_table_row, remove_table_row, add_table_column, remove_table_column, rename_table_column, reorder_table_columns, sort_table, filter_table_rows, deduplicate_table_rows)}
LIST_OPS = {f.__name__.replace("_", "-"): f for f in (add_list_item, remove_list_item, set_list_item, sort_list, filter_list_items, deduplicate_list_items, reorder_list_items)}


def builder(op: str) -> Callable[[Column, dict], Pair]:
    block, change = (Table, TABLE_OPS[op]) if op in TABLE_OPS else (Items, LIST_OPS[op])
    return lambda text, patch: changed(block(), change, text, patch)


# Tables of contents


def update_toc(text: Column, patch: dict) -> Pair:
    """Entries of the headers between two levels; a fold numbers them, a counter a level, deeper ones beginning anew."""
    lines, indent = F.col("_lines"), patch.get("indent", "  ")
    low, high = patch.get("minLevel", 2), patch.get("maxLevel", 4)
    a = F.col("_first")
    b = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when((i > a) & F.contains(x, F.lit(patch.get("endMarker", "<!-- /TOC -->"))), i)), lambda i: i.isNotNull()))
    listed = F.filter(F.col("_heads"), lambda h: (h["level"] >= low) & (h["level"] <= high))
    base = F.array_min(listed["level"])

    def step(acc: Column, h: Column) -> Column:
        counts = F.transform(acc["counts"], lambda n, level: F.when(level == h["level"], n + 1).when(level > h["level"], F.lit(0)).otherwise(n))
        mark = F.concat(F.get(counts, h["level"]).cast("string"), F.lit(".")) if patch.get("ordered", False) else F.lit("-")
        entry = F.concat(F.repeat(F.lit(indent), h["level"] - base), mark, F.lit(" ["), h["title"], F.lit("](#"), h["id"], F.lit(")"))
        return F.struct(counts.alias("counts"), F.concat(acc["entries"], F.array(entry)).alias("entries"))

    begin = F.struct(F.array_repeat(F.lit(0), 7).alias("counts"), F.array().cast("array<string>").alias("entries"))
    entries = F.aggregate(listed, begin, step, lambda acc: acc["entries"])
    new = F.array_join(F.concat(part(lines, 0, a + 1), entries, part(lines, b, F.size(lines))), "\n")
    return F.when(b.isNotNull(), new).otherwise(text), b.isNotNull().cast("int")
