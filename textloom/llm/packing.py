"""Sequence packing by non-negative least squares over the histogram of piece lengths.

Documents become token ids plus one end id and are cut at every full window; what is left is shorter than a window.
The histogram of those lengths has as many entries as the window, whatever the corpus holds. On the driver, all
combinations of up to three lengths that fill a window exactly are columns of a 0-3 matrix; accelerated projected
gradient solves for the repeat counts that explain the histogram best, the counts are rounded down, and a best-fit
greedy pass over the remaining histogram packs the rest. The plan is a list of (combination, repeats), so a piece finds
its place from its rank among the pieces of its length. Ranks come from 1024 hashed chunks of documents, so that no
length, however frequent, meets in one task.

Null text is empty: the document is its end id alone. An empty table gives an empty result. Repeated rows are packed
once each. Columns of the input other than the id and the text play no part and can have any name.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from textloom.llm.base import buffers, cut, slices

WINDOW = 1024
CHUNKS = 1024
#: Bytes of text that a worker turns into one batch of pieces.
STEP = 1 << 21
#: How byte-level BPE of this family splits a text before merging, and the visible stand-ins of its bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: White space of one run that the faster splitter is given; its search for the end of a run remembers every character of it.
RUN = 100_000
WHITE = re.compile(r"\s+")
#: Characters whose class has long been the same in every version of Unicode: all engines split texts of them alike.
SETTLED = re.compile("[\\x00-\u024f\u0370-\u0373\u0376\u0377\u037a-\u037e\u0384-\u038a\u038e-\u03a1\u03a3-\u0482\u048a-\u052f\u2010-\u205e\u20a0-\u20b5\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f5ff]*\\Z")


def merger(path: str):
    """A function from a text to its ids, faster than the tokenizer and equal to it; None if that isn't certain.

    It merges the neighbours whose union has the least id, the tokenizer those that stand first in its list of merges. Both
    agree if ids follow that list and every token, encoded by itself, is itself: then the last merge that makes a token
    within a text is the one that makes it by itself. Both is checked, and that nothing but splitting and merging is done.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    added = {t["content"] for t in told["added_tokens"]}
    plain = told.get("normalizer") is None and told.get("truncation") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    rest = iter(range(256, 512))
    byte = {chr(b if b in SHOWN else next(rest)): b for b in range(256)}
    vocabulary = {t: k for t, k in model["vocab"].items() if t not in added}
    merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if not set("".join(vocabulary)) <= set(byte) or any(a >= b for a, b in zip([255, *merged], merged, strict=False)) or sorted(merged) != sorted(k for t, k in vocabulary.items() if len(t) > 1):
        return None
    tokenize = Tokenizer.from_file(path).model.tokenize
    if any([x.id for x in tokenize(t)] != [k] for t, k in vocabulary.items()):
        return None
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks={bytes(byte[c] for c in t): k for t, k in vocabulary.items()}, special_tokens={}).encode_ordinary


class Encoder:
    """Token ids of texts: by the merger where it is certain to agree with the tokenizer, else by the tokenizer."""

    def __init__(self, path: str, end_id: int) -> None:
        self.whole, self.end_id, self.merge = Tokenizer.from_file(path), end_id, merger(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def certain(self, text: str) -> bool:
        return self.merge is not None and (text.isascii() or SETTLED.match(text) is not None) and not any(t in text for t in self.added) and (len(text) <= RUN or all(m.end() - m.start() <= RUN for m in WHITE.finditer(text)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text and the end id behind them."""
        ids = self.merge(text) if self.certain(text) else self.whole.encode(text, add_special_tokens=False).ids
        ids.append(self.end_id)
        return np.array(ids, np.uint32)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def tokenized(df: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, and ids if they are kept."""
    kind = df.schema[doc_id].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id).encode
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            texts = batch.column(1).cast(pa.string()).fill_null("")
            _, ends = buffers(texts)
            for a, b in slices(ends, STEP):
                row: list[int] = []
                rows: list[tuple[int, int, int, int]] = []
                ids: list[np.ndarray] = []
                for i, text_ in enumerate(texts.slice(a, b - a).to_pylist(), a):
                    own = encode(text_)
                    data = own.astype("<u4").tobytes()
                    n = len(own)
                    for at in range(0, n, window):
                        part = data[4 * at : 4 * (at + window)]
                        row.append(i)
                        rows.append((at, len(part) // 4, zlib.crc32(part), n))
                        if keep_ids:
                            ids.append(own[at : at + window].astype(np.int32))
                table = np.array(rows, np.int64).reshape(-1, 4)
                columns = [batch.column(0).take(pa.array(row, pa.int32())), *(pa.array(table[:, k]) for k in range(4))]
                if keep_ids:
                    columns.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * keep_ids)

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cuts, schema)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Up to three of the lengths that fill the window exactly, as rows of non-decreasing lengths, 0 for none."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    out = [np.array([[window, 0, 0]])] if have[window] else []
    below = np.flatnonzero(have[:window])
    below = below[below > 0]
    rest = window - below
    two = (rest >= below) & have[rest]
    out.append(np.stack([below[two], rest[two], np.zeros(int(two.sum()), np.int64)], 1))
    a, b = np.meshgrid(below, below, indexing="ij")
    c = window - a - b
    fit = (a <= b) & (b <= c) & (c > 0)
    fit[fit] = have[c[fit]]
    out.append(np.stack([a[fit], b[fit], c[fit]], 1))
    return np.concatenate(out).astype(np.int64)


def solve(combos: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeats x >= 0 with the least ||W (A x - counts)||, W growing with the length that would stay unpacked."""
    if not len(combos):
        return np.zeros(0)
    size = len(counts)
    weight = (np.arange(size) / (size - 1)) ** 2  # squared W
    weight[0] = 0
    uses = lambda x: np.bincount(combos.ravel(), np.repeat(x, combos.shape[1]), size)
    back = lambda r: r[combos].sum(1)
    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue sets the step
        v = back(weight * uses(v))
        bound = np.linalg.norm(v)
        v /= bound
    step = 0.95 / bound
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * back(weight * (uses(y) - counts)), 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and repeats that use every counted piece exactly once. counts[n]: pieces of length n."""
    window, left = len(counts) - 1, counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    combos = combinations(np.flatnonzero(counts), window)
    repeats = np.floor(solve(combos, counts) + 1e-6).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] < 1:
            break
        parts = tuple(int(n) for n in combos[k] if n)
        times = min([int(repeats[k]), *(int(left[n]) // parts.count(n) for n in set(parts))])
        if times > 0:
            out.append((parts, times))
            for n in parts:
                left[n] -= times
    spaces: list[int] = []  # sorted
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(parts: tuple[int, ...], times: int) -> None:
        space = window - sum(parts)
        if not space:
            out.append((parts, times))
            return
        if space not in open_bins:
            open_bins[space] = []
            bisect.insort(spaces, space)
        open_bins[space].append((parts, times))

    for n in range(window, 0, -1):
        more = int(left[n])
        while more:
            at = bisect.bisect_left(spaces, n)
            if at == len(spaces):
                each = window // n
                if more >= each:
                    put((n,) * each, more // each)
                if more % each:
                    put((n,) * (more % each), 1)
                break
            space = spaces[at]
            parts, times = open_bins[space].pop()
            if not open_bins[space]:
                del open_bins[space]
                spaces.pop(at)
            each = min(space // n, more)
            full = min(times, more // each)
            if times > full:
                put(parts, times - full)
            put(parts + (n,) * each, full)
            more -= each * full
    return out + [x for found in open_bins.values() for x in found]


def slots(planned: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length and first rank), first rank, first sequence and offset of each run of pieces."""
    keys, ranks, sequences, offsets = [], [], [], []
    used: dict[int, int] = {}
    sequence = 0
    for parts, times in planned:
        at = 0
        for n in parts:
            rank = used.get(n, 0)
            keys.append((n << 44) + rank)
            ranks.append(rank)
            sequences.append(sequence)
            offsets.append(at)
            used[n] = rank + times
            at += n
        sequence += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, ranks, sequences, offsets))


def pack(df: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Two things go to the driver and back, both of a size that the window alone bounds: the counts of pieces by chunk and
    length (1024 x window) and the plan.
    """
    spark = df.sparkSession
    pieces = cut(tokenized(df, tokenizer, doc_id=doc_id, text=text, window=window, end_id=end_id, keep_ids=keep_ids).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(CHUNKS)).cast("int")), "pieces")
    table = np.zeros((CHUNKS, window + 1), np.int64)
    counted = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n")).toPandas()
    table[counted["chunk"].to_numpy(np.int64), counted["length"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    placed = slots(plan(table.sum(0)))
    shared = spark.sparkContext.broadcast((np.cumsum(table, 0) - table, placed))
    order = Window.partitionBy("chunk", "length").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    kept = [c for c in pieces.columns if c != "chunk"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, (keys, ranks, sequences, offsets) = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + before[batch.column("chunk").to_numpy(), length]
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            columns = [batch.column(c) for c in kept] + [pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long"
    return ranked.select(*kept, "chunk", "rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids in order, and the ids' document boundaries. Needs kept ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"], p["start"], p["offset"], p["length"])).alias("documents"))
