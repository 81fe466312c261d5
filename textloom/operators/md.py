"""Content operators on one document, in Python: the exact semantics of every patch, and what fused UDFs run.

Each operator is a function of the text and its parameters that returns the new text and a count; 0 means no match.
"""

from __future__ import annotations

import hashlib
import re
import shlex
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, NamedTuple

from textloom.functions import codecs
from textloom.functions.patterns import compiled, expand
from textloom.functions.values import MISSING, collation_key, date_number, deep_merge, delete_path, float_prefix, get_path, set_path, slug

Result = tuple[str, int]
OPS: dict[str, Callable[..., Result]] = {}


def op(name: str) -> Callable:
    def keep(f: Callable[..., Result]) -> Callable[..., Result]:
        OPS[name] = f
        return f

    return keep


# Structures


class Section(NamedTuple):
    id: str
    level: int
    start: int
    end: int  # exclusive
    title: str


@dataclass
class Table:
    start: int
    end: int  # inclusive
    headers: list[str]
    alignments: list[str]
    rows: list[list[str]]


class Item(NamedTuple):
    text: str
    is_task: bool
    checked: bool
    start: int
    end: int  # inclusive


@dataclass
class ListBlock:
    start: int
    end: int  # inclusive
    ordered: bool
    bullet: str
    items: list[Item] = field(default_factory=list)


class Link(NamedTuple):
    text: str
    url: str
    start: int


class CodeBlock(NamedTuple):
    index: int
    language: str
    body: str


HEADER = re.compile(r"(#{1,6})\s+([^\n\r  ]+)\Z")
CUSTOM_ID = re.compile(r"\s*\{#([A-Za-z0-9_-]+)\}\s*\Z")
BULLET, NUMBER = re.compile(r"([-*+]) "), re.compile(r"(\d+)\. ")
LINK = re.compile(r"\[([^\]]*)\]\(([^)]*)\)")
FENCE = re.compile(r"^(`{3,}|~{3,})([^\n]*)\n([\s\S]*?)\n?\1\s*$", re.M)
RULE = re.compile(r":?-+:?\Z")
RULES = {"left": ":---", "center": ":---:", "right": "---:", "none": "---"}


def sections(lines: list[str]) -> list[Section]:
    """Every header line begins a section that lasts to the next header of its level or above; fences don't matter."""
    heads = []
    for k, line in enumerate(lines):
        if line.startswith("#") and (m := HEADER.match(line)):
            title = m[2].strip()
            custom = CUSTOM_ID.search(title)
            plain = title[: custom.start()].strip() if custom else title
            heads.append((k, len(m[1]), custom[1] if custom else slug(title), plain))
    out = []
    for n, (k, level, name, title) in enumerate(heads):
        end = next((h[0] for h in heads[n + 1 :] if h[1] <= level), len(lines))
        out.append(Section(name, level, k, end, title))
    return out


def section(lines: list[str], name: str) -> Section | None:
    return next((s for s in sections(lines) if s.id == name), None)


def cells(line: str) -> list[str]:
    line = line.strip()
    return [c.strip() for c in line[1:-1].split("|")] if len(line) > 1 and line[0] == "|" and line[-1] == "|" else []


def tables(lines: list[str]) -> list[Table]:
    """Header, rule and at least one more line; rows go on while they have as many cells."""
    out, k = [], 0
    while k + 2 < len(lines):
        head = cells(lines[k]) if "|" in lines[k] else []
        rule = cells(lines[k + 1]) if head else []
        if not head or len(rule) != len(head) or not all(RULE.match(c) for c in rule):
            k += 1
            continue
        sides = [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c[0] == ":", c[-1] == ":"), "none") for c in rule]
        table = Table(k, k + 1, head, sides, [])
        while table.end + 1 < len(lines) and len(row := cells(lines[table.end + 1])) == len(head):
            table.rows.append(row)
            table.end += 1
        out.append(table)
        k = table.end + 1
    return out


def lists(lines: list[str]) -> list[ListBlock]:
    """Runs of top-level markers of one kind; other lines belong to the item before, blank lines and headers end the list."""
    out: list[ListBlock] = []
    now: ListBlock | None = None
    for k, line in enumerate(lines):
        if not line.strip() or line.startswith("#"):
            now = None
            continue
        bullet, number = BULLET.match(line), NUMBER.match(line)
        if now is None:
            if not (m := bullet or number):
                continue
            now = ListBlock(k, k, bullet is None, m[0])
            out.append(now)
        if m := number if now.ordered else bullet:
            body = line[m.end() :]
            task = re.match(r"\[([ xX])\] ", body)
            now.items.append(Item(body[4:] if task else body, bool(task), bool(task and task[1] != " "), k, k))
        now.end = k
        now.items[-1] = now.items[-1]._replace(end=k)
    return out


def links(text: str) -> list[Link]:
    return [Link(m[1], m[2], m.start()) for m in LINK.finditer(text)]


def code_blocks(text: str) -> list[CodeBlock]:
    return [CodeBlock(k, m[2].strip(), m[3]) for k, m in enumerate(FENCE.finditer(text))]


def find_table(lines: list[str], which: int | str) -> Table | None:
    """By a line number inside the table, or the first table that lies within a section."""
    found = tables(lines)
    if isinstance(which, int):
        return next((t for t in found if t.start <= which <= t.end), None)
    s = section(lines, which)
    return next((t for t in found if s and t.start >= s.start and t.end < s.end), None)


def find_list(lines: list[str], which: int | str) -> ListBlock | None:
    """By ordinal, or the first list that lies within a section."""
    found = lists(lines)
    if isinstance(which, int):
        return found[which] if 0 <= which < len(found) else None
    s = section(lines, which)
    return next((x for x in found if s and x.start >= s.start and x.end < s.end), None)


def column_of(t: Table, column: int | str) -> int:
    if isinstance(column, int):
        return column if 0 <= column < len(t.headers) else -1
    return t.headers.index(column) if column in t.headers else -1


def row_of(t: Table, row: int | dict) -> int:
    if isinstance(row, int):
        return row if 0 <= row < len(t.rows) else -1
    c = column_of(t, row["column"])
    return next((k for k, r in enumerate(t.rows) if c >= 0 and r[c] == row["value"]), -1)


def item_of(x: ListBlock, item: int | str) -> int:
    if isinstance(item, int):
        return item if 0 <= item < len(x.items) else -1
    return next((k for k, i in enumerate(x.items) if i.text == item), -1)


def written(t: Table) -> str:
    line = lambda parts: f"| {' | '.join(parts)} |"
    return "\n".join([line(t.headers), line([RULES[a] for a in t.alignments]), *map(line, t.rows)])


def spliced(lines: list[str], start: int, end: int, new: list[str]) -> str:
    """The text with lines start to end (exclusive) replaced."""
    return "\n".join([*lines[:start], *new, *lines[end:]])


# Text


@op("replace")
def replace(text: str, old: str, new: str) -> Result:
    n = text.count(old) if old else 0
    return (text.replace(old, new), n) if n else (text, 0)


@op("replace-regex")
def replace_regex(text: str, pattern: str, replacement: str, flags: str = "") -> Result:
    return compiled(pattern, "".join(c for c in flags if c in "ims")).subn(lambda m: expand(replacement, m), text)


@op("prepend-to-file")
def prepend_to_file(text: str, content: str) -> Result:
    return content + text, 1


@op("append-to-file")
def append_to_file(text: str, content: str) -> Result:
    return text + content, 1


@op("replace-code-block")
def replace_code_block(text: str, index: int, content: str, language: str | None = None) -> Result:
    found = list(FENCE.finditer(text))
    if not 0 <= index < len(found):
        return text, 0
    m = found[index]
    new = f"{m[1]}{m[2] if language is None else language}\n{content.removesuffix(chr(10))}\n{m[1]}"
    return text[: m.start()] + new + text[m.end() :], 1


@op("modify-links")
def modify_links(text: str, urlMatch: str | None = None, urlPattern: str | None = None, textMatch: str | None = None, textPattern: str | None = None, newUrl: str | None = None, urlReplacement: str | None = None, newText: str | None = None, textReplacement: str | None = None) -> Result:  # noqa: N803
    if urlMatch is None and urlPattern is None and textMatch is None and textPattern is None:
        return text, 0

    def fits(value: str, exact: str | None, pattern: str | None) -> bool:
        return value == exact if exact is not None else bool(compiled(pattern).search(value)) if pattern is not None else True

    def changed(value: str, new: str | None, pattern: str | None, template: str | None) -> str:
        if new is not None:
            return new
        if pattern is None or template is None:
            return value
        return compiled(pattern).sub(lambda m: expand(template, m), value, count=1)

    count = 0

    def one(m: re.Match[str]) -> str:
        nonlocal count
        if not fits(m[2], urlMatch, urlPattern) or not fits(m[1], textMatch, textPattern):
            return m[0]
        count += 1
        return f"[{changed(m[1], newText, textPattern, textReplacement)}]({changed(m[2], newUrl, urlPattern, urlReplacement)})"

    return LINK.sub(one, text), count


# Lines


def line_test(match: str | None, pattern: str | None, regex: bool) -> Callable[[str], bool]:
    if match is not None:
        return lambda line: line == match
    if pattern is not None and regex:
        rx = compiled(pattern)
        return lambda line: rx.search(line) is not None
    return lambda line: False


@op("replace-line")
def replace_line(text: str, match: str, replacement: str) -> Result:
    lines = text.split("\n")
    n = lines.count(match)
    return ("\n".join(replacement if x == match else x for x in lines), n) if n else (text, 0)


def insert_at_lines(text: str, content: str, fits: Callable[[str], bool], after: bool) -> Result:
    out, n = [], 0
    for line in text.split("\n"):
        hit = fits(line)
        n += hit
        out += [line, content] if hit and after else [content, line] if hit else [line]
    return ("\n".join(out), n) if n else (text, 0)


@op("insert-after-line")
def insert_after_line(text: str, content: str, match: str | None = None, pattern: str | None = None, regex: bool = False) -> Result:
    return insert_at_lines(text, content, line_test(match, pattern, regex), True)


@op("insert-before-line")
def insert_before_line(text: str, content: str, match: str | None = None, pattern: str | None = None, regex: bool = False) -> Result:
    return insert_at_lines(text, content, line_test(match, pattern, regex), False)


def between(lines: list[str], start: str, end: str) -> tuple[int, int] | None:
    a = next((k for k, x in enumerate(lines) if start in x), None)
    b = None if a is None else next((k for k in range(a + 1, len(lines)) if end in lines[k]), None)
    return None if b is None else (a, b)


@op("delete-between")
def delete_between(text: str, start: str, end: str, inclusive: bool = True) -> Result:
    lines = text.split("\n")
    if not (at := between(lines, start, end)):
        return text, 0
    a, b = at
    return (spliced(lines, a, b + 1, []) if inclusive else spliced(lines, a + 1, b, [])), 1


@op("replace-between")
def replace_between(text: str, start: str, end: str, content: str, inclusive: bool = True) -> Result:
    lines = text.split("\n")
    if not (at := between(lines, start, end)):
        return text, 0
    a, b = at
    new = content.split("\n")
    return (spliced(lines, a, b + 1, new) if inclusive else spliced(lines, a + 1, b, new)), 1


# Sections


@op("remove-section")
def remove_section(text: str, id: str, includeChildren: bool = True) -> Result:  # noqa: A002, N803
    lines = text.split("\n")
    if not (s := section(lines, id)):
        return text, 0
    end = s.end
    if not includeChildren:
        end = next((x.start for x in sections(lines) if s.start < x.start < s.end), s.end)
    return spliced(lines, s.start, end, []), 1


@op("replace-section")
def replace_section(text: str, id: str, content: str) -> Result:  # noqa: A002
    lines = text.split("\n")
    s = section(lines, id)
    return (spliced(lines, s.start + 1, s.end, content.split("\n")), 1) if s else (text, 0)


@op("prepend-to-section")
def prepend_to_section(text: str, id: str, content: str) -> Result:  # noqa: A002
    lines = text.split("\n")
    s = section(lines, id)
    return (spliced(lines, s.start + 1, s.start + 1, [content]), 1) if s else (text, 0)


@op("append-to-section")
def append_to_section(text: str, id: str, content: str) -> Result:  # noqa: A002
    lines = text.split("\n")
    s = section(lines, id)
    return (spliced(lines, s.end, s.end, [content]), 1) if s else (text, 0)


@op("replace-in-section")
def replace_in_section(text: str, id: str, old: str, new: str) -> Result:  # noqa: A002
    lines = text.split("\n")
    s = section(lines, id)
    body, n = replace("\n".join(lines[s.start + 1 : s.end]), old, new) if s else ("", 0)
    return (spliced(lines, s.start + 1, s.end, [body]), n) if s and n else (text, 0)


@op("rename-header")
def rename_header(text: str, id: str, new: str) -> Result:  # noqa: A002
    lines = text.split("\n")
    if not (s := section(lines, id)):
        return text, 0
    return spliced(lines, s.start, s.start + 1, ["#" * s.level + (f" {new}" if new else "")]), 1


@op("move-section")
def move_section(text: str, id: str, after: str) -> Result:  # noqa: A002
    lines = text.split("\n")
    s, to = section(lines, id), section(lines, after)
    if id == after or not s or not to or s.start <= to.start < s.end:
        return text, 0
    rest = lines[: s.start] + lines[s.end :]
    if not (to := section(rest, after)):
        return text, 0
    return spliced(rest, to.end, to.end, lines[s.start : s.end]), 1


@op("change-section-level")
def change_section_level(text: str, id: str, delta: int) -> Result:  # noqa: A002
    lines = text.split("\n")
    if not (s := section(lines, id)):
        return text, 0
    level = max(1, min(6, s.level + delta))
    return spliced(lines, s.start, s.start + 1, ["#" * level + lines[s.start][s.level :]]), 1


@op("insert-section")
def insert_section(text: str, id: str, header: str, position: str = "after", content: str | None = None) -> Result:  # noqa: A002
    lines = text.split("\n")
    if not (s := section(lines, id)):
        return text, 0
    new = [header]
    if content:
        new += ["", *content.removesuffix("\n").split("\n")]
    at = s.start if position == "before" else s.end
    return spliced(lines, at, at, [*new, ""]), 1


@op("update-toc")
def update_toc(text: str, marker: str = "<!-- TOC -->", endMarker: str = "<!-- /TOC -->", minLevel: int = 2, maxLevel: int = 4, ordered: bool = False, indent: str = "  ") -> Result:  # noqa: N803
    lines = text.split("\n")
    if not (at := between(lines, marker, endMarker)):
        return text, 0
    listed = [s for s in sections(lines) if minLevel <= s.level <= maxLevel]
    base = min((s.level for s in listed), default=0)
    numbers = [0] * 7
    entries = []
    for s in listed:
        numbers[s.level] += 1
        numbers[s.level + 1 :] = [0] * (6 - s.level)
        entries.append(f"{indent * (s.level - base)}{f'{numbers[s.level]}.' if ordered else '-'} [{s.title}](#{s.id})")
    return spliced(lines, at[0] + 1, at[1], entries), 1


# Frontmatter


@op("set-frontmatter")
def set_frontmatter(text: str, key: str, value: Any) -> Result:
    return merge_frontmatter(text, {key: value})


@op("merge-frontmatter")
def merge_frontmatter(text: str, values: dict) -> Result:
    data, body, _ = codecs.split_frontmatter(text)
    for key, value in values.items():
        set_path(data, key, value)
    return codecs.join_frontmatter(data, body), 1


@op("remove-frontmatter")
def remove_frontmatter(text: str, key: str) -> Result:
    data, body, there = codecs.split_frontmatter(text)
    if not there or not delete_path(data, key):
        return text, 0
    return (codecs.join_frontmatter(data, body) if data else body), 1


@op("rename-frontmatter")
def rename_frontmatter(text: str, old: str, new: str) -> Result:
    data, body, there = codecs.split_frontmatter(text)
    value = get_path(data, old) if there else MISSING
    if value is MISSING:
        return text, 0
    delete_path(data, old)
    set_path(data, new, value)
    return codecs.join_frontmatter(data, body), 1


# Tables


def table_op(change: Callable[..., int]) -> Callable[..., Result]:
    """An operator from a function that changes a parsed table and tells its count."""

    def run(text: str, table: int | str, **given: Any) -> Result:
        lines = text.split("\n")
        t = find_table(lines, table)
        n = change(t, **given) if t else 0
        return (spliced(lines, t.start, t.end + 1, [written(t)]), n) if t and n else (text, 0)

    return run


def cell_test(match: str | None, pattern: str | None, invert: bool) -> Callable[[str], bool]:
    rx = compiled(pattern) if pattern is not None else None

    def keep(value: str) -> bool:
        hit = rx.search(value) is not None if rx else value == match if match is not None else True
        return hit != invert

    return keep


SORT_KEYS: dict[str, Callable[[str], Any]] = {"number": float_prefix, "date": date_number, "string": collation_key}


def order(values: list[str], kind: str, direction: str) -> list[int]:
    """Positions in order; equal values keep theirs in either direction."""
    keys = [SORT_KEYS[kind](v) for v in values]
    out = sorted(range(len(values)), key=keys.__getitem__, reverse=direction == "desc")
    return out if direction != "desc" else [k for k in sorted(range(len(values))[::-1], key=keys.__getitem__)[::-1]]


def survivors(keys: list[Any], keep: str) -> list[int]:
    """Positions of the first or last of equal keys."""
    seen: dict[Any, int] = {}
    for k, key in enumerate(keys):
        if keep == "last" or key not in seen:
            seen[key] = k
    return sorted(seen.values())


def replace_table_cell(t: Table, row: int | dict, column: int | str, content: str) -> int:
    r, c = row_of(t, row), column_of(t, column)
    if r < 0 or c < 0:
        return 0
    t.rows[r][c] = content
    return 1


def add_table_row(t: Table, values: list[str], position: int | None = None) -> int:
    width = len(t.headers)
    row = [str(v) for v in values[:width]] + [""] * (width - len(values))
    t.rows.insert(len(t.rows) if position is None or position < 0 or position >= len(t.rows) else position, row)
    return 1


def remove_table_row(t: Table, row: int | dict) -> int:
    r = row_of(t, row)
    if r < 0:
        return 0
    del t.rows[r]
    return 1


def add_table_column(t: Table, header: str, defaultValue: str = "", position: int | None = None) -> int:  # noqa: N803
    at = len(t.headers) if position is None or position < 0 or position >= len(t.headers) else position
    t.headers.insert(at, header)
    t.alignments.insert(at, "none")
    for r in t.rows:
        r.insert(at, defaultValue)
    return 1


def remove_table_column(t: Table, column: int | str) -> int:
    c = column_of(t, column)
    if c < 0:
        return 0
    for part in (t.headers, t.alignments, *t.rows):
        del part[c]
    return 1


def rename_table_column(t: Table, column: int | str, new: str) -> int:
    c = column_of(t, column)
    if c < 0:
        return 0
    t.headers[c] = new
    return 1


def reorder_table_columns(t: Table, columns: list[int | str]) -> int:
    at = [column_of(t, c) for c in columns]
    if sorted(at) != list(range(len(t.headers))):
        return 0
    t.headers, t.alignments = [t.headers[k] for k in at], [t.alignments[k] for k in at]
    t.rows = [[r[k] for k in at] for r in t.rows]
    return 1


def sort_table(t: Table, column: int | str, direction: str = "asc", type: str = "string") -> int:  # noqa: A002
    c = column_of(t, column)
    if c < 0:
        return 0
    t.rows = [t.rows[k] for k in order([r[c] for r in t.rows], type, direction)]
    return 1


def filter_table_rows(t: Table, column: int | str, match: str | None = None, pattern: str | None = None, invert: bool = False) -> int:
    c = column_of(t, column)
    if c < 0:
        return 0
    keep = cell_test(match, pattern, invert)
    t.rows = [r for r in t.rows if keep(r[c])]
    return 1


def deduplicate_table_rows(t: Table, column: int | str | None = None, keep: str = "first") -> int:
    c = None if column is None else column_of(t, column)
    if c is not None and c < 0:
        return 0
    left = survivors([tuple(r) if c is None else r[c] for r in t.rows], keep)
    removed = len(t.rows) - len(left)
    t.rows = [t.rows[k] for k in left]
    return removed


for f in (replace_table_cell, add_table_row, remove_table_row, add_table_column, remove_table_column, rename_table_column, reorder_table_columns, sort_table, filter_table_rows, deduplicate_table_rows):
    OPS[f.__name__.replace("_", "-")] = table_op(f)


# Lists


def list_op(change: Callable[..., tuple[list[list[str]], int]]) -> Callable[..., Result]:
    """An operator from a function of a list and its items' blocks of lines that gives new blocks and a count."""

    def run(text: str, list: int | str, **given: Any) -> Result:  # noqa: A002
        lines = text.split("\n")
        x = find_list(lines, list)
        if not x:
            return text, 0
        blocks, n = change(x, [lines[i.start : i.end + 1] for i in x.items], **given)
        return (spliced(lines, x.start, x.end + 1, [line for b in blocks for line in b]), n) if n else (text, 0)

    return run


def add_list_item(x: ListBlock, blocks: list[list[str]], item: str, position: int | None = None) -> tuple[list[list[str]], int]:
    at = len(blocks) if position is None or position < 0 or position >= len(blocks) else position
    return [*blocks[:at], [x.bullet + item], *blocks[at:]], 1


def remove_list_item(x: ListBlock, blocks: list[list[str]], item: int | str) -> tuple[list[list[str]], int]:
    at = item_of(x, item)
    return ([], 0) if at < 0 else ([*blocks[:at], *blocks[at + 1 :]], 1)


def set_list_item(x: ListBlock, blocks: list[list[str]], item: int | str, new: str) -> tuple[list[list[str]], int]:
    at = item_of(x, item)
    if at < 0:
        return [], 0
    task = ("[x] " if x.items[at].checked else "[ ] ") if x.items[at].is_task else ""
    return [*blocks[:at], [x.bullet + task + new, *blocks[at][1:]], *blocks[at + 1 :]], 1


def sort_list(x: ListBlock, blocks: list[list[str]], direction: str = "asc", type: str = "string") -> tuple[list[list[str]], int]:  # noqa: A002
    return [blocks[k] for k in order([i.text for i in x.items], type, direction)], 1


def filter_list_items(x: ListBlock, blocks: list[list[str]], match: str | None = None, pattern: str | None = None, invert: bool = False) -> tuple[list[list[str]], int]:
    keep = cell_test(match, pattern, invert)
    left = [b for i, b in zip(x.items, blocks, strict=True) if keep(i.text)]
    return left, len(blocks) - len(left)


def deduplicate_list_items(x: ListBlock, blocks: list[list[str]], keep: str = "first") -> tuple[list[list[str]], int]:
    left = survivors([i.text for i in x.items], keep)
    return [blocks[k] for k in left], len(blocks) - len(left)


def reorder_list_items(x: ListBlock, blocks: list[list[str]], order: list[int | str]) -> tuple[list[list[str]], int]:
    at = [item_of(x, i) for i in order]
    return ([blocks[k] for k in at], 1) if sorted(at) == list(range(len(blocks))) else ([], 0)


for f in (add_list_item, remove_list_item, set_list_item, sort_list, filter_list_items, deduplicate_list_items, reorder_list_items):
    OPS[f.__name__.replace("_", "-")] = list_op(f)


# Structured files. These take the document's path, which tells its format.


def structured(text: str, path: str, change: Callable[[dict], dict | None]) -> Result:
    form = codecs.format_of(path)
    if not form:
        return text, 0
    try:
        new = change(codecs.load(text, form))
    except ValueError:
        return text, 0
    return (text, 0) if new is None else (codecs.dump(new, form), 1)


@op("json-set")
def json_set(text: str, path: str, value: Any, file: str = "") -> Result:
    def change(data: dict) -> dict:
        set_path(data, path, value)
        return data

    return structured(text, file, change)


@op("json-delete")
def json_delete(text: str, path: str, file: str = "") -> Result:
    return structured(text, file, lambda data: data if delete_path(data, path) else None)


@op("json-merge")
def json_merge(text: str, value: dict, path: str | None = None, file: str = "") -> Result:
    def change(data: dict) -> dict:
        if not path:
            return deep_merge(data, value)
        old = get_path(data, path)
        set_path(data, path, deep_merge(old, value) if isinstance(old, dict) else value)
        return data

    return structured(text, file, change)


# Escape hatches: off unless a build allows them.

PLUGINS: dict[str, Callable[..., str]] = {}
TRANSFORMS: dict[str, Callable[..., str]] = {}


def register_plugin(name: str, function: Callable[..., str]) -> None:
    """A named function of text, parameters and context. Workers register what the driver's build carries to them."""
    if name in PLUGINS and PLUGINS[name] is not function:
        raise ValueError(f"plugin {name!r} is registered already")
    if not callable(function):
        raise TypeError(f"plugin {name!r} is not a function")
    PLUGINS[name] = function


def load_plugin(name: str, path: str, checksum: str | None = None) -> None:
    """Register the function `apply` of a Python file, after its SHA-256 if one is given."""
    data = Path(path).read_bytes()
    if checksum and hashlib.sha256(data).hexdigest() != checksum.removeprefix("sha256-"):
        raise ValueError(f"plugin {name!r} is not the file that was meant")
    module: dict[str, Any] = {"__name__": f"plugin_{name}"}
    exec(compile(data, path, "exec"), module)  # noqa: S102  plugins are code by nature
    if "apply" not in module:
        raise TypeError(f"plugin {name!r} has no function apply")
    register_plugin(name, module["apply"])


@op("exec")
def execute(text: str, command: str, timeout: int = 30_000) -> Result:
    """The text through a command, without a shell; what fails or takes too long changes nothing."""
    try:
        done = subprocess.run(shlex.split(command), input=text.encode(), capture_output=True, timeout=timeout / 1000, check=False)  # noqa: S603
        return (done.stdout.decode(), 1) if done.returncode == 0 else (text, 0)  # as bytes: line ends stay as they are
    except (OSError, ValueError, subprocess.TimeoutExpired):
        return text, 0


@op("ai-transform")
def ai_transform(text: str, prompt: str, provider: str = "default", **given: Any) -> Result:
    """The text through a registered transform; without one, or on any error, it is unchanged."""
    f = TRANSFORMS.get(provider)
    try:
        new = f(text, prompt, given) if f else None
    except Exception:  # noqa: BLE001  a remote model's errors are no error of the build
        return text, 0
    return (new, 1) if isinstance(new, str) else (text, 0)


@op("plugin")
def plugin(text: str, plugin: str, params: dict | None = None, file: str = "") -> Result:
    if plugin not in PLUGINS:
        raise ValueError(f"plugin {plugin!r} is not registered")
    new = PLUGINS[plugin](text, params or {}, {"file": file})
    if not isinstance(new, str):
        raise TypeError(f"plugin {plugin!r} did not return text")
    return new, int(new != text)


FILE_AWARE = frozenset({"json-set", "json-delete", "json-merge", "plugin"})
CORPUS_OPS = ("copy-file", "rename-file", "delete-file", "move-file", "write-file")


def apply(text: str, patch: dict, file: str = "") -> Result:
    """One patch of operator `op` with its own parameters."""
    given = {k: v for k, v in patch.items() if k not in COMMON}
    if patch["op"] in FILE_AWARE:
        given["file"] = file
    if patch["op"] == "ai-transform":
        given = {k: v for k, v in given.items() if v is not None}
    return OPS[patch["op"]](text, **given)


#: Fields that any patch can have.
COMMON = frozenset({"op", "patchId", "extends", "include", "exclude", "onNoMatch", "validate", "group", "when"})
