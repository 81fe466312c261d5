"""Differences of sequences: longest common subsequences in bit rows, unified diffs and their application, least moves.

A row of the table of longest common subsequences is one integer with a bit for each item of the first sequence, and a step
to the next row takes a few operations on it (64 cells a machine word). Rows are kept at every root of their number, those
between are computed again, so memory is linear and the result is exact at any size.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Hashable, Sequence
from math import isqrt

#: Items of so many occurrences have their row of bits made once.
OFTEN = 64


class _Rows:
    """Rows of bits: row j has a zero at i where the subsequence of a[: i + 1] and b[:j] is longer than that of a[:i]."""

    def __init__(self, a: Sequence[Hashable], b: Sequence[Hashable]) -> None:
        self.b, self.full = b, (1 << len(a)) - 1
        self.at: dict[Hashable, list[int]] = {x: [] for x in b}
        for i, x in enumerate(a):
            if x in self.at:
                self.at[x].append(i)
        self.often = {x: self._bits(p) for x, p in self.at.items() if len(p) > OFTEN}
        self.step = isqrt(len(b)) + 1
        self.kept = {0: self.full}
        row = self.full
        for j in range(1, len(b) + 1):
            row = self._next(row, j)
            if j % self.step == 0:
                self.kept[j] = row
        self.block: list[int] = []
        self.first = -1

    @staticmethod
    def _bits(places: list[int]) -> int:
        out = bytearray(places[-1] // 8 + 1) if places else bytearray()
        for p in places:
            out[p >> 3] |= 1 << (p & 7)
        return int.from_bytes(out, "little")

    def _next(self, row: int, j: int) -> int:
        x = self.b[j - 1]
        same = row & (self.often[x] if x in self.often else self._bits(self.at[x]))
        return ((row + same) | (row - same)) & self.full if same else row

    def __getitem__(self, j: int) -> int:
        first = j - j % self.step
        if first != self.first:
            self.block, self.first = [self.kept[first]], first
            for k in range(first + 1, min(first + self.step, len(self.b) + 1)):
                self.block.append(self._next(self.block[-1], k))
        return self.block[j - first]


def common(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Places in both of a longest common subsequence, found from the end: equal items at the end of both are always in it."""
    n, m = len(a), len(b)
    out: list[tuple[int, int]] = []
    while n and m and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
        out.append((n, m))
    if n and m:
        rows = _Rows(a[:n], b[:m])
        while n and m:
            if a[n - 1] == b[m - 1]:
                n, m = n - 1, m - 1
                out.append((n, m))
            elif not rows[m] >> (n - 1) & 1:
                m -= 1  # a[n - 1] counts, but with an earlier item of b
            else:
                part = (1 << n) - 1
                if (rows[m] & part).bit_count() == (rows[m - 1] & part).bit_count():
                    m -= 1
                else:
                    n -= 1
    return out[::-1]


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Items to remove and to add, at least, to turn one into the other."""
    n, m = len(a), len(b)
    k = 0
    while k < min(n, m) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    n, m = len(a), len(b)
    while n and m and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    if not n or not m:
        return n + m
    rows = _Rows(a[:n], b[:m])
    return n + m - 2 * (n - rows[m].bit_count())


def opcodes(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[str, int, int, int, int]]:
    """equal, replace, delete and insert with spans in both, in order and of the least size."""
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    pairs = [*common(a, b), (len(a), len(b))]
    for k, (x, y) in enumerate(pairs):
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        if k < len(pairs) - 1:
            if out and out[-1][0] == "equal" and (i, j) == (x, y):
                out[-1] = ("equal", out[-1][1], x + 1, out[-1][3], y + 1)
            else:
                out.append(("equal", x, x + 1, y, y + 1))
        i, j = x + 1, y + 1
    return out


def _range(start: int, n: int) -> str:
    """A hunk's range: its first line from 1 and its lines; of none, the line before."""
    return f"{start + 1 if n else start},{n}"


def unified(before: list[str], after: list[str], path: str, context: int = 3) -> str:
    """A unified diff of lines, with so many equal ones around changes; empty if there is nothing to tell."""
    codes = opcodes(before, after)
    hunks: list[list[tuple[str, int, int, int, int]]] = []
    for k, (tag, a, b, c, d) in enumerate(codes):
        if tag != "equal":
            if not hunks:
                hunks.append([])
            hunks[-1].append((tag, a, b, c, d))
            continue
        inside, last = bool(hunks), k == len(codes) - 1
        if inside and not last and b - a <= 2 * context:
            hunks[-1].append((tag, a, b, c, d))
            continue
        if inside and (n := min(context, b - a)):
            hunks[-1].append((tag, a, a + n, c, c + n))
        if not last:
            n = min(context, b - a)
            hunks.append([(tag, b - n, b, d - n, d)])
    if not any(tag != "equal" for hunk in hunks for tag, *_ in hunk):
        return ""
    out = [f"--- a/{path}", f"+++ b/{path}"]
    for hunk in hunks:
        a, c, b, d = hunk[0][1], hunk[0][3], hunk[-1][2], hunk[-1][4]
        out.append(f"@@ -{_range(a, b - a)} +{_range(c, d - c)} @@")
        for tag, i, j, k, m in hunk:
            out += [" " + x for x in before[i:j]] if tag == "equal" else ["-" + x for x in before[i:j]] + ["+" + x for x in after[k:m]]
    return "\n".join(out)


HUNK = re.compile(r"@@ -(\d+),(\d+) \+(\d+),(\d+) @@")


def applied(before: list[str], diff: str) -> list[str]:
    """The lines that a unified diff makes of others. Lines that aren't where it says raise ValueError."""
    if not diff:
        return list(before)
    lines = diff.split("\n")
    out: list[str] = []
    at, k = 0, 2
    while k < len(lines):
        m = HUNK.fullmatch(lines[k])
        if not m:
            raise ValueError(f"no hunk: {lines[k]!r}")
        start, old, new = int(m[1]) - (m[2] != "0"), int(m[2]), int(m[4])
        out += before[at:start]
        at, k = start, k + 1
        while old or new:
            sign, text = lines[k][:1], lines[k][1:]
            k += 1
            if sign in (" ", "-"):
                if at >= len(before) or before[at] != text:
                    raise ValueError(f"line {at + 1} is not {text!r}")
                at, old = at + 1, old - 1
            if sign in (" ", "+"):
                out.append(text)
                new -= 1
    return out + before[at:]


def increasing(values: Sequence[int], first: bool = False) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting; with `first`, of the longest that has the first item."""
    low = values[0] if first and values else None
    tops: list[int] = []  # the least end of a subsequence of each length
    places: list[int] = []
    before: list[int] = []
    for k, v in enumerate(values):
        if low is not None and k and v <= low:
            before.append(-2)
            continue
        n = bisect_left(tops, v)
        before.append(places[n - 1] if n else -1)
        tops[n : n + 1], places[n : n + 1] = [v], [k]
    out, at = [], places[-1] if places else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def moves(before: Sequence[Hashable], after: Sequence[Hashable]) -> list[tuple[Hashable, Hashable]]:
    """The items to move, each behind another, to turn one order of distinct items into another: as few as there can be.

    Nothing can be put in front of all others, so the first item stays: where it is in a longest common order, as many move
    as are outside that.
    """
    place = {x: k for k, x in enumerate(before)}
    stay = set(increasing([place[x] for x in after], first=True))
    return [(after[k], after[k - 1]) for k in range(len(after)) if k not in stay]
