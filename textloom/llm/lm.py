"""Language-model scoring by a weighted backoff automaton.

A text is a sequence of tokens: its words, A-Z folded, then one end. The model is an interpolated word bigram with
absolute discounting, learned from all training documents, as an automaton:

* the root has an arc for every word of the vocabulary, weighted by its discounted unigram probability, and one arc that
  all unknown words share;
* every word and the start of a text are states of their own. A state has an arc for each bigram seen with it, and a
  failure arc to the root with the weight left over for what it has no arc for.

A text is read once from left to right: the state is carried, a failure arc is taken where the state lacks the token's
arc, and log10 weights add up.

Size: only how arcs are found depends on frequency. Those among the CONTEXTS most frequent words are counted and
broadcast as a matrix. All other bigrams of the texts are dealt to buckets: by their second word if it isn't in the HEAD,
else by their first if it isn't, else by both. So a bucket has all bigrams of its rare words and counts them; bigrams of
two rare words go on to a bucket of their first, which has all that follows it. Each bucket sends sums by document.
Neither the vocabulary nor the bigrams have a bound. Rare words are told apart there by 63 bits of their hash.

Null text is empty: its only token is the end. Without training rows every token has probability one, as in the base
formula. A null id counts as empty text in the split. Repeated rows are scored each; other columns play no part.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import cut, give_back, mix, strings

#: Words, the end among them, whose arcs to each other are a matrix.
CONTEXTS = 512
#: Words with their counts that each worker holds, and the longest of them; all others are counted in buckets.
HEAD, HEAD_BYTES = 100_000, 64
#: Distinct words, or bigrams, after which a task passes its counts on, and documents scored at once.
FLUSH, BATCH = 400_000, 500
#: Training tokens a bucket, beyond the LEAST_BUCKETS.
BUCKET, LEAST_BUCKETS = 500_000, 32
#: How a bigram is dealt: by both words, by a rare second word, by a rare first word. Documents go along.
BOTH, SECOND, FIRST, PLAIN = 0, 1, 2, 3
END = b""
ZSTD = pa.Codec("zstd", compression_level=3)


def tokens(text: str) -> list[bytes]:
    """Words of the contract's rule: bytes.lower folds A-Z alone, bytes.split cuts at 0x20 and 0x09-0x0D alone."""
    return text.encode().lower().split()


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n of a table of one text column; the empty word counts the ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            words = pa.array(list(seen), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            if batch.num_rows:
                seen[END] += batch.num_rows
            for x in strings(batch.column(0)):
                seen.update(tokens(x))
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bigram_counts(texts: DataFrame, contexts: list[bytes]) -> DataFrame:
    """arc, n: how often token `arc % size` follows state `arc // size`. The last state is the start, the last token any other word."""
    size = len(contexts) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = {w: k for k, w in enumerate(contexts)}.get
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            ids: list[int] = []
            for x in strings(batch.column(0)):
                ids.append(size)  # a start; masked below as a token
                ids.extend(map(find, tokens(x), repeat(size - 1)))
                ids.append(find(END, size - 1))
                if len(ids) > 1 << 20:
                    total += pairs(np.array(ids), size)
                    ids = []
            if ids:
                total += pairs(np.array(ids), size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["arc", "n"])

    return texts.mapInArrow(count, "arc long, n long").groupBy("arc").agg(F.sum("n").alias("n"))


def pairs(ids: np.ndarray, size: int) -> np.ndarray:
    """Counts of state and token by their place. In ids, `size` marks a start and size - 1 a word that is no state."""
    state, token = ids[:-1], ids[1:]
    fit = (token < size) & (state != size - 1)  # not across texts; other words lead to the root
    state = np.where(state == size, size - 1, state)
    return np.bincount(state[fit] * size + token[fit], minlength=size * size)


def discount_of(once: float, twice: float) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


class Unigrams:
    """Discounted unigram weights: (max(c - d, 0) + d V / (V + 1)) / N, unknown words having c = 0 and one share of V + 1."""

    def __init__(self, total: int, kinds: int, once: int, twice: int) -> None:
        self.total, self.kinds = total, kinds
        self.discount = discount_of(once, twice)
        self.rest = self.discount * kinds / (kinds + 1)

    def log(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.zeros(len(counts))
        return np.log10((np.maximum(counts - self.discount, 0) + self.rest) / self.total)


class Automaton:
    """Arc weights between the most frequent states, and failure weights, as differences to the root's arcs.

    `kinds` and `discount` are those of all bigrams: how many words follow each state, and the discount. Without them the
    tokens that are no state count as no arcs. gain[state * size + token]: what an arc adds to the root's weight of its token; where there is no arc, the failure
    arc's weight. The last state is the start; `size` stands for the root, whose gain is zero.
    """

    def __init__(self, contexts: list[bytes], counts: np.ndarray, arcs: np.ndarray, times: np.ndarray, unigrams: Unigrams, kinds: np.ndarray | None = None, discount: float | None = None) -> None:
        self.size = size = len(contexts) + 1
        n = np.zeros((size, size))
        n.ravel()[arcs] = times
        seen, other = n[:, :-1], n[:, -1]
        if discount is None:
            discount = discount_of((seen == 1).sum(), (seen == 2).sum())
        total = seen.sum(1) + other
        left = discount * (seen > 0).sum(1) + other if kinds is None else discount * kinds
        fail = np.divide(left, total, out=np.ones(size), where=total > 0)
        root = 10.0 ** unigrams.log(counts)
        direct = np.maximum(seen - discount, 0) / np.maximum(total, 1)[:, None] + fail[:, None] * root
        fail = np.log10(np.maximum(fail, 1e-300))
        self.gain = np.zeros((size + 1, size))
        self.gain[:size, :-1] = np.where(seen > 0, np.log10(direct) - np.log10(root), fail[:, None])
        self.gain[:size, -1] = fail
        self.gain = self.gain.ravel()

    def read(self, ids: np.ndarray) -> np.ndarray:
        """The gain at each token of texts laid end to end. In ids, `size` marks a start and size - 1 a word that is no state."""
        size = self.size
        before = np.concatenate([[size], ids[:-1]])
        state = np.where(before == size, size - 1, np.where(before == size - 1, size, before))
        return np.where(ids < size, self.gain[state * size + np.minimum(ids, size - 1)], 0.0)


class Model:
    """What each worker holds of the words. A word's code is its place in the head, the end's comes last; the start has it too."""

    def __init__(self, head: list[bytes], counts: np.ndarray, states: int, ends: int, *totals: int) -> None:
        self.unigrams = Unigrams(*totals)
        self.find = {w: k for k, w in enumerate([*head, END])}.get
        self.end, self.states = len(head), states
        self.counts = counts = np.append(counts, ends)
        self.known, self.base, self.root = counts > 0, np.log10(counts + 1.0), self.unigrams.log(counts)

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Codes of words; less than zero, by their hash, for words that aren't held."""
        out = np.fromiter(map(self.find, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(out < 0)
        out[rare] = np.fromiter((~(xxhash.xxh3_64_intdigest(words[k]) >> 1) for k in rare.tolist()), np.int64, len(rare))
        return out

    def arcs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Place of bigrams in the automaton's matrix, -1 for those that have none."""
        n = self.states
        state, token = (np.where(x == self.end, at_end, np.where((x >= 0) & (x < n - 1), x + 1, -1)) for x, at_end in ((first, n), (second, 0)))
        return np.where((state >= 0) & (token >= 0), state * (n + 1) + token, -1)

    def gains(self, second: np.ndarray, n: np.ndarray, counts: np.ndarray, total: np.ndarray, kinds: np.ndarray, discount: float) -> np.ndarray:
        """What bigrams add to the root's weight of their second word: n occur, `total` with their first word, of so many kinds."""
        root = self.unigrams.log(np.where(second < 0, counts, self.counts[np.maximum(second, 0)]))
        fail = np.divide(discount * kinds, total, out=np.ones(len(n)), where=total > 0)
        seen = np.log10(np.maximum(n - discount, 0) / np.maximum(total, 1) + fail * 10.0**root) - root
        return np.where(n > 0, seen, np.log10(np.maximum(fail, 1e-300)))

    def parts(self, row: np.ndarray, second: np.ndarray, times: np.ndarray, counts: np.ndarray, gains: np.ndarray) -> np.ndarray:
        """row, known, logs and score (the last two as their bits) of bigrams; one whose second word isn't held brings that word's own part."""
        rare = second < 0
        bits = lambda x: (x * times).view(np.int64)
        logs = np.where(rare, np.log10(np.maximum(counts, 0) + 1.0), 0.0)
        return summed(np.stack([row, (rare & (counts > 0)) * times, bits(logs), bits(gains + np.where(rare, self.unigrams.log(counts), 0))]))


def summed(x: np.ndarray) -> np.ndarray:
    """row, known, logs and score added up by row, in its order."""
    if not x.shape[1]:
        return x
    x = x[:, np.argsort(x[0], kind="stable")]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(x[0])) + 1])
    floats = np.add.reduceat(np.ascontiguousarray(x[2:]).view(float), starts, axis=1)
    return np.concatenate([x[:1, starts], np.add.reduceat(x[1:2], starts, axis=1), floats.view(np.int64)])


def by_row(x: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Packed sums by bucket of their rows."""
    found = [(k, pack(*part)) for k, part in split(bucket_of(x[0] >> 8, buckets), x)]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], ["bucket", "blob"])


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit integers, byte by byte, compressed."""
    x = np.ascontiguousarray(np.stack(columns).astype(np.int64))
    body = x.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes()
    return x.shape[1].to_bytes(8, "little") + ZSTD.compress(body, asbytes=True)


def unpack(blobs: list[bytes], columns: int) -> np.ndarray:
    """Columns of all blobs laid end to end."""
    out = [np.zeros((columns, 0), np.int64)]
    for x in blobs:
        n = int.from_bytes(x[:8], "little")
        body = np.frombuffer(ZSTD.decompress(x[8:], n * columns * 8), np.uint8)
        out.append(np.ascontiguousarray(body.reshape(columns, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(columns, n))
    return np.concatenate(out, axis=1)


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(x.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def split(key: np.ndarray, columns: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Columns by key, in order of the key; the order within a key stays."""
    order = np.argsort(key, kind="stable")
    key, columns = key[order], columns[:, order]
    edges = np.flatnonzero(np.diff(key, prepend=-1, append=-1)) if len(key) else np.zeros(0, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(key[a]), columns[:, a:b]


def dealt(x: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """kind, bucket and packed columns of bigrams: first and second word, row, and twice the times, one more in training."""
    x = x[:, np.lexsort((x[2], x[0], x[1]))]
    new = np.diff(x[:3], prepend=np.full((3, 1), -1)).any(0)
    new[:1] = True
    starts = np.flatnonzero(new)
    if len(starts):
        x = np.concatenate([x[:3, starts], [2 * np.add.reduceat(x[3] >> 1, starts) + (x[3, starts] & 1)]])
    first, second = x[0], x[1]
    kind = np.where(second < 0, SECOND, np.where(first < 0, FIRST, BOTH))
    key = np.where(kind == SECOND, second, np.where(kind == FIRST, first, (first << 20) + second))
    for k, part in split(kind * buckets + bucket_of(key, buckets), x):
        yield k // buckets, k % buckets, pack(*part)


def counted(table: pa.Table, buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """kind, bucket, packed columns and facts of one bucket.

    The columns gain how often each bigram, and its second word if that isn't held, occurs in training. Bigrams of rare
    first words come under FIRST, by that word. Facts are kinds of bigrams by first words that are held; -1 and -2 stand
    for all bigrams that occur once and twice.
    """
    x = unpack(table.column("blob").to_pylist(), 4)
    first, second, row, t = x = x[:, np.lexsort((x[0], x[1]))]
    train = (t & 1) * (t >> 1)

    def total(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new = np.any([np.diff(k) != 0 for k in keys], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        n = np.add.reduceat(train, starts)
        return starts, n, np.repeat(n, np.diff(starts, append=len(train)))

    starts, n, each = total(second, first)
    word = total(second)[2] if table.column("kind")[0].as_py() == SECOND else np.full(len(t), -1)
    seen = first[starts][n > 0]
    heads, kinds = np.unique(seen[seen >= 0], return_counts=True)
    facts = pack(np.concatenate([[-1, -2], heads]), np.concatenate([[(n == 1).sum(), (n == 2).sum()], kinds]))
    out = np.stack([first, second, row, t >> 1, each, word])
    rare = first < 0
    yield BOTH, 0, pack(*out[:, ~rare]), facts
    for k, part in split(bucket_of(first[rare], buckets), out[:, rare]):
        yield FIRST, k, pack(*part), pack([], [])


_models: dict[int, Model] = {}


def model_of(shared) -> Model:
    """The broadcast model, put together once a worker."""
    if shared.value[0] not in _models:
        _models.clear()
        _models[shared.value[0]] = Model(*shared.value[1:])
    return _models[shared.value[0]]


def frequent(counts: DataFrame) -> pd.DataFrame:
    """At most HEAD words, all that occur at least so often, most frequent first; no more rows than that leave the tasks."""
    short = counts.filter((F.octet_length("word") <= HEAD_BYTES) & (F.col("word") != ""))
    step = F.floor(F.log2("n") * 16).cast("int")
    room, least = HEAD, None
    for row in sorted(short.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):
        room -= row["words"]
        if room < 0:
            break
        least = row["step"]
    return short.filter(step >= least if least is not None else F.lit(False)).toPandas().sort_values(["n", "word"], ascending=[False, True])


def score(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), held_out(F.col(doc_id)).alias("held_out"))
    training = docs.filter(~F.col("held_out")).select("text")
    counts = cut(word_counts(training), "words")
    zero = lambda c: F.coalesce(c, F.lit(0))
    kinds = lambda k: F.count(F.when(F.col("n") == k, 1))
    total = counts.agg(zero(F.sum("n")).alias("n"), F.count("*").alias("v"), kinds(1).alias("once"), kinds(2).alias("twice"), zero(F.max(F.when(F.col("word") == "", F.col("n")))).alias("ends")).first()
    top = frequent(counts)
    head, head_counts = [w.encode() for w in top["word"]], top["n"].to_numpy(float)
    contexts, context_counts = [END, *head[: CONTEXTS - 1]], np.array([total["ends"], *head_counts[: CONTEXTS - 1]], float)
    totals = (total["n"], total["v"], total["once"], total["twice"])
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, head, head_counts, len(contexts), total["ends"], *totals))
    buckets, flush, size = LEAST_BUCKETS + total["n"] // BUCKET, FLUSH, BATCH
    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double, arcs array<int>, kind int, bucket int, blob binary"
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "arcs", "kind", "bucket", "blob"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = model_of(shared), TaskContext.get().partitionId() << 40
        kept: list[np.ndarray] = []

        def deal(ids: pa.DataType) -> pa.RecordBatch:
            parts = list(dealt(np.concatenate(kept, axis=1), buckets))
            kept.clear()
            null = lambda t: pa.nulls(len(parts), t)
            kinds_, buckets_, blobs = (list(c) for c in zip(*parts, strict=True)) if parts else ([], [], [])
            return pa.RecordBatch.from_arrays(
                [null(pa.int64()), null(ids), null(pa.bool_()), null(pa.int64()), null(pa.int64()), null(pa.float64()), null(pa.float64()), null(pa.list_(pa.int32())), pa.array(kinds_, pa.int32()), pa.array(buckets_, pa.int32()), pa.array(blobs, pa.binary())], names
            )

        ids = pa.null()
        for whole in batches:
            ids = whole.column("doc_id").type
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                rows = batch.num_rows
                words: list[bytes] = []
                sizes = []
                for x in strings(batch.column("text")):
                    own = tokens(x)
                    words += own
                    words.append(END)
                    sizes.append(len(own) + 1)
                second, n = model.codes(words), np.array(sizes)
                first = np.concatenate([[model.end], second[:-1]])  # each text follows an end
                owner = np.repeat(np.arange(rows), n)
                held = second >= 0
                some, of = second[held], owner[held]
                arcs = model.arcs(first, second)
                hot = arcs >= 0
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner[hot], minlength=rows))])
                train = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                others = np.stack([first, second, row + owner, 2 + train[owner]])[:, ~hot]
                null = lambda t, k=rows: pa.nulls(k, t)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(rows)),
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array(n),
                        pa.array(np.bincount(of, model.known[some], rows).astype(np.int64)),
                        pa.array(np.bincount(of, model.base[some], rows).astype(float)),
                        pa.array(np.bincount(of, model.root[some], rows).astype(float)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(arcs[hot], pa.int32())),
                        pa.array(np.full(rows, PLAIN), pa.int32()),
                        pa.array(np.full(rows, (row // size + (row >> 40)) % buckets), pa.int32()),
                        null(pa.binary()),
                    ],
                    names,
                )
                row += rows
                kept.append(others)
                if sum(x.shape[1] for x in kept) > flush:
                    yield deal(ids)
                    give_back()
        if kept:
            yield deal(ids)
        del kept
        give_back()

    def count(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == PLAIN:
            return table.append_column("facts", pa.nulls(len(table), pa.binary()))
        parts = list(zip(*counted(table.select(["kind", "blob"]), buckets), strict=True))
        give_back()
        given = {c: pa.array(x, t) for (c, t), x in zip((("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()), ("facts", pa.binary())), parts, strict=True)}
        return pa.table({f: given[f] if f in given else pa.nulls(len(given["kind"]), table.schema.field(f).type) for f in [*table.column_names, "facts"]})

    bigrams = cut(docs.mapInArrow(read, schema).groupBy("kind", "bucket").applyInArrow(count, f"{schema}, facts binary"), "bigrams")
    words_held = len(head) + 1

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(words_held + 2, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                at, n = unpack([x], 2)
                np.add.at(out, at + 2, n)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], ["at", "n"])

    facts = np.zeros(words_held + 2, np.int64)
    found = bigrams.filter("facts IS NOT NULL").select("facts").mapInArrow(add_up, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    facts[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    arcs = bigram_counts(training, contexts).toPandas()
    place, times = arcs["arc"].to_numpy(np.int64), arcs["n"].to_numpy(float)
    states = len(contexts)
    inner = place % (states + 1) != states
    followers = np.bincount(place[inner] // (states + 1), minlength=states + 1)
    twice, once, kinds_held = facts[0], facts[1], facts[2:].astype(float)
    discount = discount_of(once + (times[inner] == 1).sum(), twice + (times[inner] == 2).sum())
    kinds_held[: states - 1] += followers[1:states]
    kinds_held[-1] += followers[states]
    automaton = Automaton(contexts, context_counts, place, times, Unigrams(*totals), np.concatenate([[0], kinds_held[: states - 1], kinds_held[-1:]]), discount)
    late = spark.sparkContext.broadcast((automaton.gain, kinds_held))

    def of_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kinds_ = model_of(shared), late.value[1]
        kept: list[np.ndarray] = []
        for batch in batches:
            for x in batch.column(0).to_pylist():
                first, second, row, t, n, word = unpack([x], 6)
                kept.append(model.parts(row, second, t, word, model.gains(second, n, word, model.counts[first], kinds_[first], discount)))
                if sum(x.shape[1] for x in kept) > flush:
                    yield by_row(summed(np.concatenate(kept, axis=1)), buckets)
                    kept.clear()
        if kept:
            yield by_row(summed(np.concatenate(kept, axis=1)), buckets)
        give_back()

    def of_rare(table: pa.Table) -> pa.Table:
        model = model_of(shared)
        x = unpack(table.column("blob").to_pylist(), 6)
        first, second, row, t, n, word = x = x[:, np.lexsort((x[1], x[0]))]
        new = np.concatenate([[True], (np.diff(first) != 0) | (np.diff(second) != 0)])
        _, at = np.unique(first, return_inverse=True)
        total_, kinds_ = np.bincount(at, n * new)[at], np.bincount(at, (n > 0) & new)[at]
        return pa.Table.from_batches([by_row(model.parts(row, second, t, word, model.gains(second, n, word, total_, kinds_, discount)), buckets)])

    def of_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = late.value[0]
        for batch in batches:
            arcs_ = batch.column("arcs")
            n = np.diff(arcs_.offsets.to_numpy())
            more = np.bincount(np.repeat(np.arange(len(n)), n), gain[arcs_.flatten().to_numpy()], len(n))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain_names), pa.array(batch.column("score").to_numpy() + more)], [*plain_names, "score"])

    def add(table: pa.Table) -> pa.Table:
        row, known, logs, more = summed(unpack(table.column("blob").to_pylist(), 4))
        return pa.table([pa.array(row), pa.array(known), pa.array(logs.view(float)), pa.array(more.view(float))], ["row", "more_known", "more_logs", "more_score"])

    plain_names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs"]
    plain = bigrams.filter(F.col("kind") == PLAIN).select(*plain_names, "score", "arcs")
    plain = plain.mapInArrow(of_arcs, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double")
    packed = "bucket int, blob binary"
    of_both = bigrams.filter(F.col("kind") == BOTH).select("blob").mapInArrow(of_head, packed)
    of_first = bigrams.filter(F.col("kind") == FIRST).select("bucket", "blob").groupBy("bucket").applyInArrow(of_rare, packed)
    more = of_both.unionByName(of_first).groupBy("bucket").applyInArrow(add, "row long, more_known long, more_logs double, more_score double")
    out = plain.join(more, "row", "left")
    log_all = F.lit(float(np.log10(total["n"] + total["v"] + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero(F.col("more_known"))).alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("logs") + zero(F.col("more_logs")) - F.col("n_tokens") * log_all).alias("base_score"), (F.col("score") + zero(F.col("more_score"))).alias("score"),
    )
