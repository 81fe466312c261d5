"""What a build would change, for reading: changed lines with the parts that differ, snippets around a place, steps of a program."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import diff
from textloom.functions.patterns import admitted
from textloom.operators import md
from textloom.plans.checks import holds
from textloom.plans.planner import as_list, own
from textloom.plans.stores import changed

PART = "array<struct<kind:string,text:string>>"
LINES = f"array<struct<kind:string,before:int,after:int,parts:{PART}>>"
KINDS = {"equal": "equal", "delete": "removed", "insert": "added"}


def char_changes(before: str, after: str) -> list[tuple[str, str]]:
    """Runs of equal, removed and added characters that turn one line into the other.

    What both begin and end with is equal.
    """
    first = len(os.path.commonprefix([before, after]))
    last = len(os.path.commonprefix([before[first:][::-1], after[first:][::-1]]))
    x, y = before[first : len(before) - last], after[first : len(after) - last]
    out: list[tuple[str, str]] = [("equal", before[:first])]
    for what, a, b, c, d in diff.opcodes(x, y):
        out += [("equal", x[a:b])] if what == "equal" else [("removed", x[a:b]), ("added", y[c:d])]
    return [(kind, text) for kind, text in [*out, ("equal", before[len(before) - last :])] if text]


def line_changes(before: str | None, after: str | None) -> list[tuple[str, int | None, int | None, list[tuple[str, str]]]]:
    """kind (equal, modified, removed, added), line numbers from 1 and parts of every line of both texts; a text that isn't
    there has none."""
    x, y = ([] if t is None else t.split("\n") for t in (before, after))
    out: list[tuple[str, int | None, int | None, list[tuple[str, str]]]] = []
    for what, a, b, c, d in diff.opcodes(x, y):
        both = min(b - a, d - c)
        for k in range(both):
            kind = "equal" if what == "equal" else "modified"
            out.append((kind, a + k + 1, c + k + 1, [("equal", x[a + k])] if what == "equal" else char_changes(x[a + k], y[c + k])))
        out += [("removed", k + 1, None, [("removed", x[k])]) for k in range(a + both, b)]
        out += [("added", None, k + 1, [("added", y[k])]) for k in range(c + both, d)]
    return out


def preview(before: DataFrame, after: DataFrame, context: bool = False) -> DataFrame:
    """path, status and `lines` of every document that differs; equal lines too if asked for. Only such texts move."""
    some = changed(before, after)
    a = before.select("path", F.col("content").alias("_a")).join(some.select("path"), "path", "left_semi")
    b = after.select("path", F.col("content").alias("_b")).join(some.select("path"), "path", "left_semi")

    @F.arrow_udf(LINES)
    def lines(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        part = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("before", pa.int32()), ("after", pa.int32()), ("parts", part)]))
        for x, y in batches:
            done = [[line for line in line_changes(i, j) if context or line[0] != "equal"] for i, j in zip(x.to_pylist(), y.to_pylist(), strict=True)]
            yield pa.array([[{"kind": k, "before": m, "after": n, "parts": [{"kind": p, "text": t} for p, t in parts]} for k, m, n, parts in d] for d in done], kind)

    return some.join(a, "path", "left").join(b, "path", "left").select("path", "status", lines("_a", "_b").alias("lines"))


def snippet(text: str, line: int, around: int = 2) -> str:
    """Numbered lines around a line (from 1), which is marked."""
    lines = text.split("\n")
    first, last = max(1, line - around), min(len(lines), line + around)
    wide = len(str(last))
    return "\n".join(f"{'>' if n == line else ' '} {n:>{wide}} | {lines[n - 1]}" for n in range(first, last + 1))


class Session:
    """Stepping through patches on one document: look, apply, skip, go back, and keep the decisions for a replay."""

    def __init__(self, path: str, content: str, patches: list[dict], start: int = 0) -> None:
        if not 0 <= start < len(patches):
            raise ValueError("no patch to begin with")
        self.path, self.original, self.patches, self.at = path, content, patches, start
        self.taken: list[tuple[int, str, str]] = []  # patch, decision, text before it

    @property
    def content(self) -> str:
        return self._now(len(self.taken))

    def _now(self, k: int) -> str:
        return self._after(*self.taken[k - 1]) if k else self.original

    def _after(self, n: int, decision: str, text: str) -> str:
        return step(text, self.path, self.patches[n])[0] if decision == "apply" else text

    def look(self) -> tuple[str, int]:
        """The text after the current patch and how often it matches; nothing is decided."""
        return step(self.content, self.path, self.patches[self.at]) if self.at < len(self.patches) else (self.content, 0)

    def decide(self, decision: str) -> bool:
        """apply or skip the current patch and go on; whether there is another."""
        if decision not in ("apply", "skip") or self.at >= len(self.patches):
            raise ValueError(f"no decision: {decision}")
        self.taken.append((self.at, decision, self.content))
        self.at += 1
        return self.at < len(self.patches)

    def back(self) -> bool:
        """Take the last decision back, if there is one."""
        if not self.taken:
            return False
        self.at = self.taken.pop()[0]
        return True

    def decisions(self) -> list[dict]:
        return [{"file": self.path, "patchIndex": n, "action": d} for n, d, _ in self.taken]

    def replay(self, decisions: list[dict]) -> str:
        """Decide as before; what the decisions leave out is not done."""
        for d in decisions:
            if d["file"] == self.path and d["patchIndex"] == self.at:
                self.decide(d["action"])
        return self.content

    def statistics(self) -> dict[str, int]:
        done = [d for _, d, _ in self.taken]
        return {"total": len(self.patches), "applied": done.count("apply"), "skipped": done.count("skip"), "left": len(self.patches) - self.at}


def takes(text: str, path: str, patch: dict) -> bool:
    """Whether a patch is for this document: its globs admit the path and its condition holds."""
    return admitted(path, as_list(patch.get("include")), as_list(patch.get("exclude"))) and ("when" not in patch or holds(patch["when"], text))


def step(text: str, path: str, patch: dict) -> tuple[str, int]:
    """One patch on one document: its text and count, 0 where the patch isn't for it."""
    return md.apply(text, own(patch), path) if takes(text, path, patch) else (text, 0)


def replayed(corpus: DataFrame, patches: list[dict], decisions: DataFrame) -> DataFrame:
    """path, content, applied, skipped: a corpus after the decisions of debug sessions (path, step, action: apply or skip).

    Decisions meet documents by path, a row a document with as many of them as there are patches at most. They are taken in
    order of their steps; what they leave out is not done, and an `apply` of a patch that isn't for the document, or matches
    nothing, leaves it as it is and counts as neither.
    """
    known = decisions.filter(F.col("action").isin("apply", "skip") & F.col("step").between(0, len(patches) - 1))
    of_path = known.groupBy("path").agg(F.array_sort(F.collect_set(F.struct(F.col("step").cast("int").alias("step"), F.col("action")))).alias("taken"))
    joined = corpus.select("path", "content").join(of_path, "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text, taken in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                applied = skipped = 0
                for d in taken or []:
                    if d["action"] == "skip":
                        skipped += 1
                    elif text is not None:
                        text, n = step(text, path, patches[d["step"]])
                        applied += n > 0
                rows.append((path, text, applied, skipped))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["path", "content", "applied", "skipped"])

    return joined.mapInArrow(run, "path string, content string, applied int, skipped int")


def profile(corpus: DataFrame, patches: list[dict]) -> DataFrame:
    """step, op, tried, documents, matches, ms, slowest_ms: for each patch how many documents it was for and matched, and the
    time that it took, in Python. Tasks pass on a row a patch."""
    schema = "step int, tried long, documents long, matches long, ms double, slowest_ms double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [[0, 0, 0, 0.0, 0.0] for _ in patches]
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, patch in enumerate(patches if text is not None else []):
                    began = time.perf_counter()
                    if not takes(text, path, patch):
                        continue
                    text, n = step(text, path, patch)
                    took = 1000 * (time.perf_counter() - began)
                    own = seen[k]
                    seen[k] = [own[0] + 1, own[1] + (n > 0), own[2] + n, own[3] + took, max(own[4], took)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(patches)), pa.int32()), *(pa.array([x[c] for x in seen], t) for c, t in enumerate(kinds))], ["step", "tried", "documents", "matches", "ms", "slowest_ms"])

    found = corpus.select("path", "content").mapInArrow(run, schema)
    named = F.element_at(F.array(*(F.lit(p["op"]) for p in patches)), F.col("step") + 1)
    sums = [F.sum(c).alias(c) for c in ("tried", "documents", "matches", "ms")]
    return found.groupBy("step").agg(*sums, F.max("slowest_ms").alias("slowest_ms")).select("step", named.alias("op"), "tried", "documents", "matches", "ms", "slowest_ms")


def steps(corpus: DataFrame, patches: list[dict]) -> DataFrame:
    """path, step, op, count, before, after: what each patch that matches does to each document, in turn."""
    schema = "path string, step int, op string, count int, before string, after string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, patch in enumerate(patches if text is not None else []):
                    new, n = step(text, path, patch)
                    if n:
                        rows.append((path, k, patch["op"], n, text, new))
                        text = new
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
            names = ["path", "step", "op", "count", "before", "after"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

    return corpus.select("path", "content").mapInArrow(run, schema)
