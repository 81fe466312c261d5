"""Periodic runs of words: all maximal repetitions of a text, by Kolpakov and Kucherov.

The words of a document, numbered by first occurrence, are read into a suffix automaton. A walk along it cuts them into
Lempel-Ziv factors, each the longest prefix of the rest that begins earlier as well. At each border between factors Main's
algorithm finds the runs that touch or cross it, from the longest common extensions of both sides: two passes for periods
to the left, two for periods to the right. A run that touches no border lies inside a factor and is copied from that
factor's earlier occurrence, where it was found before.

A run of LEAST words or more and three periods holds, at each of its words, a gram of GRAM words that occurs again one
period away. So stretches that no repeated gram covers, by hash, hold nothing of a run, and only covered stretches are read;
the words between them bound runs as the ends of the text do.

Null text has no words. An empty table gives an empty result; repeated rows give repeated rows. Ids are passed on unread,
null or not; columns of the input other than the id and the text play no part and can have any name. A text is one row's
work whatever its length: memory is about 60 bytes a covered word, time is linear.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import buffers, mix, slices

#: Words of the shortest run, and periods.
LEAST, PERIODS = 24, 3


class Automaton:
    """Suffix automaton of a sequence of small integers, with the end of each state's first occurrence.

    Most states have one transition: it stands in two arrays, and only states with more have a dictionary.
    """

    def __init__(self, text: list[int]) -> None:
        self.word, self.target, self.first = array("i", [-1]), array("i", [0]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        link, size, last = array("i", [-1]), array("i", [0]), 0
        for i, c in enumerate(text):
            here = self._state(i)
            size.append(size[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and self.step(at, c) < 0:
                self._connect(at, c, here)
                at = link[at]
            if at >= 0:
                after = self.step(at, c)
                if size[after] != size[at] + 1:
                    copy = self._state(self.first[after])
                    size.append(size[at] + 1)
                    link.append(link[after])
                    self.word[copy], self.target[copy] = self.word[after], self.target[after]
                    if after in self.more:
                        self.more[copy] = dict(self.more[after])
                    while at >= 0 and self.step(at, c) == after:
                        self._connect(at, c, copy)
                        at = link[at]
                    link[after] = after = copy
                link[here] = after
            last = here

    def _state(self, first: int) -> int:
        self.word.append(-1)
        self.target.append(0)
        self.first.append(first)
        return len(self.first) - 1

    def _connect(self, state: int, word: int, target: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.target[state] = word, target
        else:
            self.more.setdefault(state, {})[word] = target

    def step(self, state: int, word: int) -> int:
        """The state after a word, -1 if there is none."""
        if self.word[state] == word:
            return self.target[state]
        return self.more[state].get(word, -1) if state in self.more else -1


def factors(text: list[int]) -> Iterator[tuple[int, int, int]]:
    """Start, stop and earlier place of each Lempel-Ziv factor; a word that is new is a factor with place -1."""
    automaton, n, at = Automaton(text), len(text), 0
    while at < n:
        state, stop = 0, at
        while stop < n and automaton.first[after := automaton.step(state, text[stop])] < stop:
            state, stop = after, stop + 1
        yield (at, stop, automaton.first[state] - (stop - at) + 1) if stop > at else (at, stop := at + 1, -1)
        at = stop


def prefixes(text: list[int]) -> list[int]:
    """For each place the length of the longest common prefix with the whole."""
    n, out = len(text), [0] * len(text)
    if n:
        out[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(out[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and text[k] == text[i + k]:
                k += 1
            left, right = i, i + k
        out[i] = k
    return out


def crossing(text: list[int], low: int, border: int, high: int) -> Iterator[tuple[int, int, int]]:
    """Start, stop and period of repetitions of two periods or more within low .. high that touch the border."""
    before, after = text[low:border], text[border:high]
    back = before[::-1]
    m, n = len(before), len(after)
    own = prefixes(after)
    against = prefixes([*back, -1, *after[::-1], *back])
    for q in range(1, n + 1):  # one period right of the border
        left, right = min(against[m + 1 + n - q], m), own[q] if q < n else 0
        if left + right >= q:
            yield border - left, border + q + right, q
    own = prefixes(back)
    against = prefixes([*after, -1, *before, *after])
    for q in range(1, m + 1):  # one period left of it
        left, right = own[q] if q < m else 0, min(against[n + 1 + m - q], n)
        if left + right >= q:
            yield border - q - left, border + right, q


def repetitions(text: list[int], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """Start, stop and smallest period of every run of at least `least` words and `periods` (two or more) periods, in order."""
    found: dict[tuple[int, int], int] = {}
    starting: dict[int, list[tuple[int, int]]] = {}
    n = len(text)

    def add(start: int, stop: int, period: int) -> None:
        if (start, stop) not in found:
            starting.setdefault(start, []).append((stop, period))
        found[start, stop] = min(period, found.get((start, stop), period))

    last = 0  # words of the factor before
    for start, stop, place in [*factors(text), (n, n, -1)]:
        if start:
            for a, b, q in crossing(text, max(0, start - 2 * last - (stop - start)), start, stop):
                wide = b - a >= max(least, periods * q)
                if wide and (a == 0 or text[a - 1] != text[a - 1 + q]) and (b == n or text[b] != text[b - q]):
                    add(a, b, q)
        if stop - start >= least:
            for a in range(place + 1, place + stop - start):
                for b, _ in tuple(starting.get(a, ())):
                    if b < place + stop - start:
                        add(a + start - place, b + start - place, found[a, b])
        last = stop - start
    return sorted((a, b, q) for (a, b), q in found.items())


def covered(words: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Stretches of words that grams, a power of two of words long, which occur more than once cover."""
    if len(words) <= gram:
        return []
    hashes, size = mix(words), 1
    while size < gram:
        hashes = mix(hashes[:-size] * np.uint64(0x9E3779B97F4A7C15) + hashes[size:])
        size *= 2
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return []
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.union1d(order[1:][same], order[:-1][same])
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + gram, -1)
    inside = np.concatenate([[False], np.cumsum(edges) > 0])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def runs_of(words: list[bytes], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """Start, length and period of the runs of a document's words, by start and period."""
    if len(words) < least:
        return []
    numbers: dict[bytes, int] = {}
    text = [numbers.setdefault(w, len(numbers)) for w in words]
    # the words of a run that are followed by their like one period on are at least so many
    common = min(max(least, periods * q) - q for q in range(1, least + 1))
    out = []
    for a, b in covered(np.array(text, np.uint64), 1 << (common.bit_length() - 1)):
        if b - a >= least:
            out += [(a + s, e - s, q) for s, e, q in repetitions(text[a:b], least, periods)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if runs:
        stay = bytearray(b"\1") * len(words)
        for start, length, period in runs:
            stay[start + period : start + length] = bytes(length - period)
        words = [w for w, k in zip(words, stay, strict=True) if k]
    return b" ".join(words)


def find_runs(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and collapsed, the text without repeated periods."""
    kind = df.schema[doc_id].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = buffers(batch.column(1))
            for a, b in slices(ends):
                sizes, runs, texts = [], [], []
                for i in range(a, b):
                    words = raw[ends[i] : ends[i + 1]].tobytes().split()
                    own = runs_of(words, least, periods)
                    sizes.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    texts.append(collapsed(words, own).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(span)), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(df: DataFrame) -> DataFrame:
    """doc_id, text of documents, of which those whose crc32 of the id ends in 0 go on periodically from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n, a, p = (F.col(f"_plant.{c}") for c in "gnap")
    out = df.select("doc_id", "text", F.struct(F.floor(h / 10).alias("g"), F.size(words).cast("long").alias("n"), words.alias("w"), (h % 10).alias("r")).alias("_plant"))
    out = out.withColumn("_plant", F.when((F.col("_plant.r") == 0) & (n > 0), F.col("_plant").withField("a", F.pmod(g, n))))
    out = out.withColumn("_plant", F.col("_plant").withField("p", 1 + F.floor((n - a) / (3 + g % 8))))
    word = lambda w, i: F.when(i < a, w).otherwise(F.get("_plant.w", (a + (i - a) % p).cast("int")))
    return out.select("doc_id", F.when(F.col("_plant").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_plant.w", word), " ")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The number of runs, the run of the greatest exponent, and digests of all runs and of the collapsed text."""

    def order(x: Column, y: Column) -> Column:
        ahead = x["length"] * y["period"] - y["length"] * x["period"]
        return F.when(ahead != 0, F.signum(-ahead)).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")

    best = F.get(F.array_sort("runs", order), F.lit(0))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
