"""The inverse of a build: patches that turn one document into another, learned from pairs, scored, checked and merged."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import codecs, diff
from textloom.functions.values import MISSING, canonical, content_hash, deep_equal
from textloom.operators import md
from textloom.plans.build import fold
from textloom.plans.planner import own

#: Confidence of a suggestion by the family of its operator.
SCORES = {
    0.95: ("set-frontmatter", "remove-frontmatter", "rename-frontmatter", "merge-frontmatter", "sort-list", "reorder-list-items", "deduplicate-list-items", "filter-list-items", "sort-table", "reorder-table-columns", "rename-table-column", "deduplicate-table-rows", "filter-table-rows"),
    0.9: ("remove-section", "replace-section", "prepend-to-section", "append-to-section", "rename-header", "move-section", "change-section-level", "insert-section", "add-list-item", "remove-list-item", "set-list-item", "modify-links", "replace-table-cell", "add-table-row", "remove-table-row", "add-table-column", "remove-table-column", "replace-code-block", "update-toc", "prepend-to-file", "append-to-file", "json-set", "json-delete", "json-merge", "copy-file", "rename-file", "move-file", "delete-file"),
    0.85: ("replace-in-section", "replace-between", "delete-between"),
    0.75: ("replace-regex",),
    0.6: ("replace-line", "insert-after-line", "insert-before-line"),
}
BY_OP = {op: s for s, ops in SCORES.items() for op in ops}


def score(patch: dict, source: str) -> float:
    if patch["op"] == "replace":
        n = source.count(patch["old"])
        return 0.85 if n >= 3 else 0.7 if n == 2 else 0.5
    return BY_OP.get(patch["op"], 0.5)


def frontmatter_patches(a: str, b: str) -> list[dict]:
    old, new = codecs.split_frontmatter(a)[0], codecs.split_frontmatter(b)[0]
    gone, added = [k for k in old if k not in new], {k: v for k, v in new.items() if k not in old}
    out = []
    for k in list(gone):
        same = [j for j, v in added.items() if deep_equal(v, old[k])]
        if len(same) == 1 and sum(deep_equal(old[x], old[k]) for x in gone) == 1:
            out.append({"op": "rename-frontmatter", "old": k, "new": same[0]})
            gone.remove(k)
            del added[same[0]]
    changed = added | {k: v for k, v in new.items() if k in old and not deep_equal(v, old[k])}
    if len(changed) > 1:
        out.append({"op": "merge-frontmatter", "values": changed})
    elif changed:
        key, value = next(iter(changed.items()))
        out.append({"op": "set-frontmatter", "key": key, "value": value})
    return out + [{"op": "remove-frontmatter", "key": k} for k in gone]


def section_patches(a: str, b: str) -> list[dict]:
    la, lb = a.split("\n"), b.split("\n")
    sa, sb = md.sections(la), md.sections(lb)
    old, new = {s.id: s for s in reversed(sa)}, {s.id: s for s in reversed(sb)}
    out: list[dict] = []
    lost = [s for s in sa if s.id not in new]
    found = [s for s in sb if s.id not in old]
    for s in list(lost):
        near = next((t for t in found if t.level == s.level and la[s.start + 1 : s.end] == lb[t.start + 1 : t.end] or t.level == s.level and abs(t.start - s.start) <= 2), None)
        if near:
            out.append({"op": "rename-header", "id": s.id, "new": near.title})
            lost.remove(s)
            found.remove(near)
    inner = lambda s, group: any(p is not s and p.start < s.start < p.end for p in group)
    out += [{"op": "remove-section", "id": s.id} for s in lost if not inner(s, lost)]
    for t in found:
        if inner(t, found):
            continue
        before = next((s for s in reversed(sb) if s.end <= t.start and s.id in old and s.level == t.level), None)
        after = next((s for s in sb if s.start >= t.end and s.id in old and s.level == t.level), None)
        body = "\n".join(lb[t.start + 1 : t.end]).strip("\n")
        if before or after:
            out.append({"op": "insert-section", "id": (before or after).id, "header": lb[t.start], "position": "after" if before else "before"} | ({"content": body} if body else {}))
    for s in sa:
        t = new.get(s.id)
        if not t:
            continue
        if t.level != s.level:
            out.append({"op": "change-section-level", "id": s.id, "delta": t.level - s.level})
        leaf = lambda x, group: not any(x.start < y.start < x.end for y in group)
        x, y = la[s.start + 1 : s.end], lb[t.start + 1 : t.end]
        if x == y or not leaf(s, sa) or not leaf(t, sb):
            continue
        if len(y) > len(x) and y[len(y) - len(x) :] == x:
            out.append({"op": "prepend-to-section", "id": s.id, "content": "\n".join(y[: len(y) - len(x)])})
        elif len(y) > len(x) and y[: len(x)] == x:
            out.append({"op": "append-to-section", "id": s.id, "content": "\n".join(y[len(x) :])})
        elif len(x) == len(y) and sum(p != q for p, q in zip(x, y, strict=True)) == 1:
            p, q = next((p, q) for p, q in zip(x, y, strict=True) if p != q)
            if p and "\n".join(x).count(p) == 1:
                out.append({"op": "replace-in-section", "id": s.id, "old": p, "new": q})
            else:
                out.append({"op": "replace-section", "id": s.id, "content": "\n".join(y)})
        else:
            out.append({"op": "replace-section", "id": s.id, "content": "\n".join(y)})
    return out


def list_patches(a: str, b: str) -> list[dict]:
    out: list[dict] = []
    for k, (x, y) in enumerate(zip(md.lists(a.split("\n")), md.lists(b.split("\n")), strict=False)):
        p, q = [i.text for i in x.items], [i.text for i in y.items]
        if p == q:
            continue
        if Counter(p) == Counter(q):
            for direction in ("asc", "desc"):
                if [p[i] for i in md.order(p, "string", direction)] == q:
                    out.append({"op": "sort-list", "list": k, "direction": direction})
                    break
            else:
                if len(set(p)) == len(p):
                    out.append({"op": "reorder-list-items", "list": k, "order": q})
            continue
        if len(q) < len(p) and [p[i] for i in md.survivors(p, "first")] == q:
            out.append({"op": "deduplicate-list-items", "list": k})
            continue
        gone, new = [i for i in p if i not in q], [i for i in q if i not in p]
        if len(gone) >= 2 and len(set(gone)) == 1 and not new:
            out.append({"op": "filter-list-items", "list": k, "match": gone[0], "invert": True})
        elif len(gone) == len(new):
            out += [{"op": "set-list-item", "list": k, "item": i, "new": j} for i, j in zip(gone, new, strict=True)]
        else:
            out += [{"op": "remove-list-item", "list": k, "item": i} for i in gone]
            out += [{"op": "add-list-item", "list": k, "item": j} | ({} if q.index(j) == len(q) - 1 else {"position": q.index(j)}) for j in new]
    return out


def link_patches(a: str, b: str) -> list[dict]:
    out: list[dict] = []
    for x, y in zip(md.links(a), md.links(b), strict=False):
        if x.text == y.text and x.url != y.url:
            patch = {"op": "modify-links", "urlMatch": x.url, "newUrl": y.url}
        elif x.url == y.url and x.text != y.text:
            patch = {"op": "modify-links", "textMatch": x.text, "newText": y.text}
        else:
            continue
        if patch not in out:
            out.append(patch)
    return out


def table_patches(a: str, b: str) -> list[dict]:
    out: list[dict] = []
    for x, y in zip(md.tables(a.split("\n")), md.tables(b.split("\n")), strict=False):
        at = {"table": x.start}
        if x.headers != y.headers:
            differ = [k for k, (p, q) in enumerate(zip(x.headers, y.headers, strict=False)) if p != q]
            if len(x.headers) == len(y.headers) and len(differ) == 1 and x.rows == y.rows:
                out.append({"op": "rename-table-column", **at, "column": x.headers[differ[0]], "new": y.headers[differ[0]]})
            elif sorted(x.headers) == sorted(y.headers):
                out.append({"op": "reorder-table-columns", **at, "columns": y.headers})
            else:
                out += [{"op": "remove-table-column", **at, "column": h} for h in x.headers if h not in y.headers]
                for h in y.headers:
                    if h not in x.headers:
                        cells = {r[y.headers.index(h)] for r in y.rows}
                        out.append({"op": "add-table-column", **at, "header": h, "position": y.headers.index(h)} | ({"defaultValue": cells.pop()} if len(cells) == 1 else {}))
            continue
        p, q = [tuple(r) for r in x.rows], [tuple(r) for r in y.rows]
        if p == q:
            continue
        if Counter(p) == Counter(q):
            options = [(h, d, t) for h in range(len(x.headers)) for t in ("string", "number") for d in ("asc", "desc")]
            found = next(((h, d, t) for h, d, t in options if [p[i] for i in md.order([r[h] for r in p], t, d)] == q), None)
            if found:
                out.append({"op": "sort-table", **at, "column": x.headers[found[0]], "direction": found[1], "type": found[2]})
            continue
        if len(q) < len(p) and [p[i] for i in md.survivors(p, "first")] == q:
            out.append({"op": "deduplicate-table-rows", **at})
            continue
        gone = [r for r in p if r not in q]
        if len(gone) >= 2 and [r for r in p if r in q] == q:
            shared = next(((c, r) for c in range(len(x.headers)) if len({r[c] for r in gone}) == 1 and not any(r[c] == gone[0][c] for r in q) for r in gone[:1]), None)
            if shared:
                out.append({"op": "filter-table-rows", **at, "column": x.headers[shared[0]], "match": shared[1][shared[0]], "invert": True})
                continue
        first = lambda rows: {r[0]: r for r in reversed(rows)}
        old, new = first(p), first(q)
        for key, r in new.items():
            if key in old:
                out += [{"op": "replace-table-cell", **at, "row": {"column": x.headers[0], "value": key}, "column": x.headers[c], "content": r[c]} for c in range(1, len(r)) if r[c] != old[key][c]]
        out += [{"op": "remove-table-row", **at, "row": {"column": x.headers[0], "value": key}} for key in old if key not in new]
        out += [{"op": "add-table-row", **at, "values": list(r), "position": q.index(r)} for key, r in new.items() if key not in old]
    return out


def code_patches(a: str, b: str) -> list[dict]:
    out = []
    for x, y in zip(md.code_blocks(a), md.code_blocks(b), strict=False):
        if (x.body, x.language) != (y.body, y.language):
            out.append({"op": "replace-code-block", "index": x.index, "content": y.body} | ({"language": y.language} if x.language != y.language else {}))
    return out


def file_patches(a: str, b: str) -> list[dict]:
    if not a or b.count(a) != 1:
        return []
    head, tail = b.split(a)
    return [{"op": op, "content": x} for op, x in (("prepend-to-file", head), ("append-to-file", tail)) if x]


def between_patches(a: str, b: str) -> list[dict]:
    """Spans between paired comment markers that differ."""
    out = []
    for m in re.finditer(r"<!--\s*(\S+)\s*-->", a):
        start, end = m[0], f"<!-- /{m[1]} -->"
        spans = []
        for text in (a, b):
            lines = text.split("\n")
            at = md.between(lines, start, end)
            spans.append(lines[at[0] + 1 : at[1]] if at else None)
        if None in spans or spans[0] == spans[1]:
            continue
        if m[1] == "TOC":
            out.append({"op": "update-toc"})
        elif not spans[1]:
            out.append({"op": "delete-between", "start": start, "end": end, "inclusive": False})
        else:
            out.append({"op": "replace-between", "start": start, "end": end, "content": "\n".join(spans[1]), "inclusive": False})
    return out


def siblings(found: list[md.Section]) -> dict[str | None, list[str]]:
    """The sections below each section, None for those below none, in order."""
    out: dict[str | None, list[str]] = {}
    above: list[md.Section] = []
    for s in found:
        while above and above[-1].level >= s.level:
            above.pop()
        out.setdefault(above[-1].id if above else None, []).append(s.id)
        above.append(s)
    return out


def move_patches(a: str, b: str) -> list[dict]:
    """The fewest moves of unchanged sections behind a neighbour that give the order of the target, below each section."""
    la, lb = a.split("\n"), b.split("\n")
    sa, sb = md.sections(la), md.sections(lb)
    ids, jds = [s.id for s in sa], [s.id for s in sb]
    if ids == jds or sorted(ids) != sorted(jds) or len(set(ids)) != len(ids):
        return []
    text = lambda lines, s: "\n".join(lines[s.start : s.end]).strip()
    old, new = {s.id: s for s in sa}, {s.id: s for s in sb}
    before, after = siblings(sa), siblings(sb)
    out = []
    for parent, order in after.items():
        if sorted(before.get(parent, [])) != sorted(order):
            continue
        for name, behind in diff.moves(before[parent], order):
            x, y = old[name], new[name]
            if sorted(text(la, x).split("\n")) == sorted(text(lb, y).split("\n")):  # those below it may have moved as well
                out.append({"op": "move-section", "id": name, "after": behind})
    return out


def line_patches(a: str, b: str) -> list[dict]:
    """Word substitutions with equal counts, then equal lines replaced, inserted and deleted."""
    la, lb = a.split("\n"), b.split("\n")
    out: list[dict] = []
    swaps: Counter[tuple[str, str]] = Counter()
    lines: list[dict] = []
    for tag, i, j, k, n in diff.opcodes(la, lb):
        if tag == "replace" and j - i == n - k:
            for x, y in zip(la[i:j], lb[k:n], strict=True):
                p, q = x.split(), y.split()
                differ = {(u, v) for u, v in zip(p, q, strict=False) if u != v}
                if len(p) == len(q) and len(differ) == 1:
                    swaps[differ.pop()] += 1
                elif x.strip() and la.count(x) == 1:
                    lines.append({"op": "replace-line", "match": x, "replacement": y})
        elif tag == "insert" and 1 <= n - k <= 5 and 0 < i < len(la):
            anchor = next((x for x in reversed(la[:i]) if x.strip()), None)
            if anchor is not None and la.count(anchor) == 1:
                lines.append({"op": "insert-after-line", "match": anchor, "content": "\n".join(lb[k:n])})
    for old, new in swaps:
        word = os.path.commonprefix([old[::-1], new[::-1]])[::-1] if not old.isalnum() else ""
        u, v = (old.removesuffix(word), new.removesuffix(word)) if word and old.removesuffix(word).isalnum() else (old, new)
        if u and a.count(u) == b.count(v):
            out.append({"op": "replace", "old": u, "new": v})
    return out + lines


def json_patches(a: str, b: str, form: str) -> list[dict]:
    try:
        old, new = codecs.load(a, form), codecs.load(b, form)
    except ValueError:
        return []

    def walk(x: dict, y: dict, prefix: str) -> list[dict]:
        out: list[dict] = [{"op": "json-delete", "path": prefix + k} for k in x if k not in y]
        changed = {k: v for k, v in y.items() if not (isinstance(v, dict) and isinstance(x.get(k), dict)) and not deep_equal(x.get(k, MISSING), v)}
        if len(changed) > 1:
            out.append({"op": "json-merge", "value": changed} | ({"path": prefix[:-1]} if prefix else {}))
        else:
            out += [{"op": "json-set", "path": prefix + k, "value": v} for k, v in changed.items()]
        return out + [p for k, v in y.items() if isinstance(v, dict) and isinstance(x.get(k), dict) for p in walk(x[k], v, f"{prefix}{k}.")]

    return walk(old, new, "")


DETECTORS = (frontmatter_patches, list_patches, link_patches, table_patches, code_patches, file_patches, section_patches, between_patches, move_patches, line_patches)


def suggest(source: str, target: str, path: str = "") -> list[tuple[dict, float]]:
    """Patches with confidences, best first in the order of their detectors.

    A detector's patches stay if they bring the document nearer to the target than what was found before; moves, each of
    which may only help with the others, together.
    """
    if source == target:
        return []
    if form := codecs.format_of(path):
        return [(p, score(p, source)) for p in json_patches(source, target, form)]
    out: list[tuple[dict, float]] = []
    now = source
    lines = target.split("\n")

    def near(text: str) -> float:
        """Likeness to the target, by lines in common order."""
        own = text.split("\n")
        return 1 - diff.distance(own, lines) / (len(own) + len(lines))

    best = near(now)
    for detect in DETECTORS:
        if now == target:
            break
        found = detect(now, target)
        for group in [found] if detect is move_patches else [[patch] for patch in found]:
            after, kept = now, []
            for patch in group:
                text, n = md.apply(after, own(patch), path)
                if n:
                    kept.append((patch, score(patch, after)))
                    after = text
            if kept and ((got := near(after)) > best or after == target):
                out += kept
                now, best = after, got
    return out


def check(source: str, target: str, patches: list[dict], path: str = "") -> float:
    """1 if the patches give the target exactly, else the share of its lines that are there."""
    got = fold(source, path, list(enumerate(map(own, patches))), "skip")[0]
    if got == target:
        return 1.0
    lines, have = target.split("\n"), set(got.split("\n"))
    return sum(x in have for x in lines) / len(lines) * 0.999


# Over corpora.


def paired(source: DataFrame, target: DataFrame) -> DataFrame:
    """path, source, target of documents that are on both sides and differ. Hashes meet first: only such texts move."""
    side = lambda df, name: df.select("path", content_hash(F.col("content")).alias(name))
    keys = side(source, "a").join(side(target, "b"), "path").filter(~F.col("a").eqNullSafe(F.col("b"))).select("path")
    some = lambda df, name: df.select("path", F.col("content").alias(name)).join(keys, "path", "left_semi")
    return some(source, "source").join(some(target, "target"), "path")


def suggestions(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """path, patch (JSON), score, checked: how near all of a pair's patches come to its target. Best patches come first."""
    schema = "array<struct<patch:string,score:double,checked:double>>"

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, p in batches:
            rows: list[list[dict[str, Any]]] = []
            for x, y, path in zip(a, b, p, strict=True):
                found = [(patch, s) for patch, s in suggest(x, y, path) if s >= least]
                ok = check(x, y, [patch for patch, _ in found], path)
                rows.append([{"patch": json.dumps(patch, ensure_ascii=False, sort_keys=True, default=str), "score": s, "checked": ok} for patch, s in sorted(found, key=lambda x: -x[1])])
            yield pd.Series(rows)

    changed = pairs.filter(F.col("source") != F.col("target"))
    return changed.select("path", F.explode(run("source", "target", "path")).alias("x")).select("path", "x.*")


def consolidated(found: DataFrame) -> DataFrame:
    """patch, score, files, include: equal patches of several documents as one, with the smallest glob over their paths."""
    folder = F.regexp_extract("path", r"\A(.*/)?", 1)
    ext = F.regexp_extract("path", r"(\.[^./]*)\z", 1)
    grouped = found.groupBy("patch").agg(F.max("score").alias("score"), F.count("*").alias("files"), F.min(folder).alias("a"), F.max(folder).alias("b"), F.min(ext).alias("e"), F.max(ext).alias("f"), F.min("path").alias("one"))
    parts = F.filter(F.zip_with(F.split("a", "/"), F.split("b", "/"), lambda x, y: F.when(x == y, x)), lambda x: F.lit(True))
    same = F.coalesce(F.array_position(F.transform(parts, lambda x: F.coalesce(x, F.lit("\0"))), "\0") - 1, F.size(parts))
    common = F.array_join(F.slice(F.split("a", "/"), 1, F.greatest(F.least(same.cast("int"), F.size(F.split("a", "/")) - 1), F.lit(0))), "/")
    glob = F.concat(F.when(common == "", F.lit("")).otherwise(F.concat(common, F.lit("/"))), F.lit("**/*"), F.when(F.col("e") == F.col("f"), F.col("e")).otherwise(F.lit("")))
    return grouped.select("patch", "score", "files", F.when(F.col("files") == 1, F.col("one")).otherwise(glob).alias("include"))


def moved_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, to_path, op: documents that went elsewhere unchanged; only contents that one document has on either side."""
    def alone(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(content_hash(F.col("content")).alias("h")).agg(F.count("*").alias("n"), F.min("path").alias(name)).filter("n = 1").drop("n")

    out = alone(before, "path").join(alone(after, "to_path"), "h").filter(F.col("path") != F.col("to_path"))
    stays = out.join(after.select("path").distinct(), "path", "left_semi").select("path").withColumn("_stays", F.lit(True))
    name = lambda c: F.regexp_extract(c, r"([^/]*)\z", 1)
    op = F.when(F.col("_stays"), "copy-file").when(name("path") == name("to_path"), "move-file").otherwise("rename-file")
    return out.join(stays, "path", "left").select("path", "to_path", op.alias("op"))


def same_patch(a: dict, b: dict) -> bool:
    return canonical(a) == canonical(b)
