"""Language identification of code-switched text by a linear-chain conditional random field.

Every word is labelled with a language. A word's potentials are sums of learned weights of its features, hashed into one
table: affixes and inner n-grams of two to four bytes (its ends are marked), and the word itself (the lexicon). Learned
transition weights tie neighbours. Forward-backward gives each word's probability of each language; a document's language
is the one with the most probability over its words, weighted by their bytes, and its score is that share.

Training takes at most TRAIN_DOCS labelled documents in all, shared evenly by the languages and picked by hash of id and
text, and of each at most WINDOWS windows of LENGTH words, picked by hash from all over the text; all words of a document
have its label. One window in SPLICED is made of the halves of two documents' windows, so that transitions learn how
languages change within a text. Prediction reads whole texts; `spans` tells which words are of which language.

Forward-backward is exact and runs over segments: a matrix product stands for each segment, messages pass from segment
to segment of a document, then words inside all segments advance together.

A null text, or one without a letter, is `und` with score 0, and so is everything if nothing is labelled. Ties go to the
language first in code point order. Repeated rows are predicted each, an empty table gives an empty result. Other columns
are never read, and pass through whatever their names; those named like the results are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import FOLD, buffers, mix, slices, span_hashes, strings, word_bounds

#: Bounds of the sample on which the model is fitted.
TRAIN_DOCS, WINDOWS, LENGTH, SPLICED = 6000, 12, 32, 4
BUCKETS = 1 << 18
SEGMENT = 64
UNDECIDED = "und"
LETTER = regex.compile(r"\p{L}")
EPOCHS, ROWS, RATE, DECAY = 3, 128, 0.3, 1e-6


class Weights(NamedTuple):
    labels: list[str]
    emit: np.ndarray  # BUCKETS x labels
    move: np.ndarray  # labels x labels


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def features(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of words (spans of folded bytes), laid end to end, and where each word's begin."""
    size = stops - starts + 2  # marked at both ends
    first = np.cumsum(size) - size
    total = int(size.sum())
    body = np.full(total + 3, 0x20, np.uint32)
    inner = np.ones(total, bool)
    inner[first] = False
    inner[first + size - 1] = False
    body[:total][first + size - 1] = 0x0A
    span = stops - starts
    body[:total][inner] = raw[np.repeat(starts, span) + np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)]
    left = np.repeat(first + size, size) - np.arange(total)  # bytes from here to the word's end
    out = np.empty((4, total), np.int64)
    code = body[:total].copy()
    for n in (2, 3, 4):
        code |= body[n - 1 : total + n - 1] << np.uint32(8 * (n - 1))
        mixed = (code + np.uint32(n * 0x1ED270B5)) * np.uint32(0x9E3779B1)
        out[n - 2] = np.where(left >= n, mixed >> np.uint32(14), BUCKETS)
    lexicon = np.full(total, BUCKETS, np.int64)
    lexicon[first] = (hashes >> np.uint64(46)).astype(np.int64)
    out[3] = lexicon
    return out, first


def emissions(weights: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of weights by word. weights has a zero row after its last."""
    total = np.zeros((buckets.shape[1], weights.shape[1]), np.float32)
    for row in buckets:
        total += weights[row]
    return np.add.reduceat(total, first, axis=0) if len(first) else np.zeros((0, weights.shape[1]), np.float32)


def distinct(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of distinct words, one place of each, and each word's number."""
    hashes, index, inverse = np.unique(span_hashes(raw, starts, stops), return_index=True, return_inverse=True)
    return hashes, index, inverse


def padded(weights: np.ndarray) -> np.ndarray:
    return np.vstack([weights, np.zeros((1, weights.shape[1]), weights.dtype)])


def posterior(emit: np.ndarray, words: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probability of each label at each word. emit: log potentials of all words; words: how many each document has."""
    k = emit.shape[1]
    a = np.exp(move - move.max()).astype(np.float64)
    pieces = -(-words // SEGMENT)
    segments = int(pieces.sum())
    base = np.cumsum(pieces) - pieces
    at = np.arange(len(emit)) - np.repeat(np.cumsum(words) - words, words)
    seg, slot = np.repeat(base, words) + at // SEGMENT, at % SEGMENT
    size = np.bincount(seg, minlength=segments)
    x = np.ones((segments, SEGMENT, k))
    x[seg, slot] = np.exp(emit - emit.max(1, keepdims=True))
    begins = np.zeros(segments, bool)
    begins[base[words > 0]] = True
    norm = lambda v, axes: v / v.sum(axes, keepdims=True)
    product = np.broadcast_to(np.eye(k), (segments, k, k)).copy()
    product[~begins] = product[~begins] @ a
    product *= x[:, 0, None, :]
    for s in range(1, SEGMENT):
        live = np.flatnonzero(size > s)
        if not len(live):
            break
        product[live] = norm((product[live] @ a) * x[live, s, None, :], (1, 2))
    into, after = np.ones((segments, k)), np.ones((segments, k))
    last = base + pieces - 1
    for j in range(1, int(pieces.max()) if len(pieces) else 0):
        docs = np.flatnonzero(pieces > j)
        now, back = base[docs] + j, last[docs] - j
        into[now] = norm((into[now - 1, None, :] @ product[now - 1])[:, 0], 1)
        after[back] = norm((product[back + 1] @ after[back + 1, :, None])[..., 0], 1)
    forward = np.empty((segments, SEGMENT, k))
    v = into.copy()
    v[~begins] = v[~begins] @ a
    for s in range(SEGMENT):
        v = norm((v @ a if s else v) * x[:, s], 1)
        forward[:, s] = v
    out = np.empty_like(forward)
    v = after.copy()
    for s in range(SEGMENT - 1, -1, -1):
        out[:, s] = forward[:, s] * v
        live = (size > s)[:, None]
        v = np.where(live, norm((x[:, s] * v) @ a.T, 1), v)
    return norm(out[seg, slot], 1)


def train(texts: list[str], labels: list[str]) -> Weights:
    """Maximum likelihood by stochastic gradients (Adagrad) over windows of words; forward-backward gives expectations."""
    names = sorted(set(labels), key=lambda s: [ord(c) for c in s])
    k = len(names)
    emit, move = np.zeros((BUCKETS + 1, k), np.float32), np.zeros((k, k))
    if k < 2:
        return Weights(names, emit[:BUCKETS], move)
    number = {s: i for i, s in enumerate(names)}
    raw, ends = buffers(pa.array(texts, pa.string()))
    raw = FOLD[raw]
    starts, stops, first = word_bounds(raw, ends)
    owner = np.repeat(np.array([number[s] for s in labels]), np.diff(first))
    windows = [np.arange(at, min(at + LENGTH, b)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) for at in range(a, b, LENGTH)]
    hashes = span_hashes(raw, starts, stops)
    rng = np.random.default_rng(7)
    seen, seen_move = np.full((BUCKETS + 1, k), 1e-6, np.float32), np.full((k, k), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), ROWS):
            chosen = [windows[i] for i in order[at : at + ROWS]]
            for i in range(0, len(chosen) - 1, SPLICED):
                x, y = chosen[i], chosen[i + 1]
                chosen[i] = np.concatenate([x[: len(x) // 2], y[len(y) // 2 :]])
            words = np.concatenate(chosen)
            n = np.array([len(w) for w in chosen])
            _, place, inverse = np.unique(hashes[words], return_index=True, return_inverse=True)
            own = words[place]
            buckets, begin = features(raw, starts[own], stops[own], hashes[own])
            scores = emissions(emit, buckets, begin)[inverse]
            p, pairs = expectations(scores, n, move)
            truth = owner[words]
            gap = p.copy()
            gap[np.arange(len(words)), truth] -= 1
            byword = np.stack([np.bincount(inverse, gap[:, c], len(own)) for c in range(k)], 1) / len(chosen)
            span = np.diff(np.append(begin, buckets.shape[1]))
            grad = np.repeat(byword, span, axis=0)
            used, to = np.unique(buckets, return_inverse=True)
            to = to.reshape(buckets.shape)
            total = np.zeros((len(used), k))
            for row in to:
                for c in range(k):
                    total[:, c] += np.bincount(row, grad[:, c], len(used))
            total += DECAY * emit[used]
            seen[used] += total**2
            emit[used] -= RATE * total / np.sqrt(seen[used])
            emit[BUCKETS] = 0
            real = np.zeros((k, k))
            np.add.at(real, (truth[:-1][inside(n)], truth[1:][inside(n)]), 1)
            g = (pairs - real) / len(chosen) + DECAY * move
            seen_move += g**2
            move -= RATE * g / np.sqrt(seen_move)
    return Weights(names, emit[:BUCKETS], move)


def inside(n: np.ndarray) -> np.ndarray:
    """Which neighbours of words laid end to end are of one sequence."""
    out = np.ones(int(n.sum()), bool)
    out[np.cumsum(n) - 1] = False
    return out[:-1]


def expectations(scores: np.ndarray, n: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities at each word and expected counts of neighbours' labels."""
    k, rows, longest = scores.shape[1], len(n), int(n.max())
    a = np.exp(move - move.max())
    row, slot = np.repeat(np.arange(rows), n), np.arange(len(scores)) - np.repeat(np.cumsum(n) - n, n)
    x = np.ones((rows, longest, k))
    x[row, slot] = np.exp(scores - scores.max(1, keepdims=True))
    norm = lambda v: v / v.sum(1, keepdims=True)
    alpha, beta = np.empty((rows, longest, k)), np.ones((rows, longest, k))
    alpha[:, 0] = norm(x[:, 0])
    for s in range(1, longest):
        alpha[:, s] = norm((alpha[:, s - 1] @ a) * x[:, s])
    for s in range(longest - 2, -1, -1):
        live = (n > s + 1)[:, None]
        beta[:, s] = np.where(live, norm((x[:, s + 1] * beta[:, s + 1]) @ a.T), 1.0)
    p = norm((alpha * beta)[row, slot])
    left = (alpha[:, :-1])[:, :, :, None] * a * (x[:, 1:] * beta[:, 1:])[:, :, None, :]
    live = (np.arange(1, longest)[None, :] < n[:, None])[:, :, None, None]
    left = np.where(live, left / left.sum((2, 3), keepdims=True), 0)
    return p, left.sum((0, 1))


def windows_of(text: str, seed: int) -> str:
    """WINDOWS windows of LENGTH words, by hash from all over the text, in order; the whole text if it has no more."""
    words = text.encode().split()
    count = -(-len(words) // LENGTH)
    if count <= WINDOWS:
        return b" ".join(words).decode()
    lots = mix(np.arange(count, dtype=np.uint64) ^ np.uint64(seed))
    picked = np.sort(np.argpartition(lots, WINDOWS)[:WINDOWS])
    return b" ".join(b" ".join(words[k * LENGTH : (k + 1) * LENGTH]) for k in picked.tolist()).decode()


def sample(docs: DataFrame, limit: int = TRAIN_DOCS) -> tuple[list[str], list[str]]:
    """Windows of at most about `limit` labelled documents, evenly by label, by hash: the same for the same rows."""
    known = docs.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(limit).collect()}
    if not counts:
        return [], []
    each = max(1, limit // len(counts))
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))) for lang, n in sorted(counts.items())))
    lot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [windows_of(x, h & ((1 << 64) - 1)) for x, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(texts, pa.string()), batch.column("h")], ["lang", "text", "h"])

    chosen = known.filter(lot < share).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    got = chosen.mapInArrow(cut_out, "lang string, text string, h long").toPandas().sort_values(["h", "lang", "text"])
    return got["text"].tolist(), got["lang"].tolist()


_padded: dict[str, np.ndarray] = {}


def trained(docs: DataFrame):
    """The model, broadcast: its size is set by the number of languages alone. docs: doc_id, text, lang, held_out."""
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, train(*sample(docs))))


def table_of(shared) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, weights with a row of zeros behind them, and transitions; made once a worker."""
    key, (labels, emit, move) = shared.value
    if key not in _padded:
        _padded.clear()
        _padded[key] = padded(emit)
    return labels, _padded[key], move


def posteriors(raw: np.ndarray, ends: np.ndarray, emit: np.ndarray, move: np.ndarray, seen: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Start, stop and probabilities of each word of the texts, and the first word of each text. With `seen`, whether each
    bucket's features were learned, also what share of its features were, for each word."""
    part = FOLD[raw]
    starts, stops, first = word_bounds(part, ends)
    if not len(starts):
        return starts, stops, np.zeros((0, len(move))), first, np.zeros(0)
    hashes, index, inverse = distinct(part, starts, stops)
    buckets, begin = features(part, starts[index], stops[index], hashes)
    scores = emissions(emit, buckets, begin)[inverse]
    known = np.zeros(0)
    if seen is not None:
        some = buckets < BUCKETS
        known = (np.add.reduceat((seen[buckets] & some).sum(0), begin) / np.maximum(np.add.reduceat(some.sum(0), begin), 1))[inverse]
    return starts, stops, posterior(scores, np.diff(first), move), first, known


def inputs(df: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), held_out(F.col(doc_id)).alias("held_out"))


def label(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """df with lang_pred, score and familiar of every document; columns of those names are replaced.

    familiar is the share of features of a document's words, weighted by their bytes, that the model learned anything about:
    how much there is to go by, whatever the number of languages; 0 without words.
    """
    shared = trained(inputs(df, doc_id, text, lang))
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "familiar")]
    schema = df.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("familiar", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, emit, move = table_of(shared)
        seen = (emit != 0).any(1)
        for batch in batches:
            raw, ends = buffers(batch.column(text))
            familiar = np.zeros(batch.num_rows)
            lettered = np.array([LETTER.search(x) is not None for x in strings(batch.column(text))], bool)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b in slices(ends) if labels else ():
                starts, stops, p, first, known = posteriors(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a], emit, move, seen)
                size = stops - starts
                p = p * size[:, None]
                owner = np.repeat(np.arange(b - a), np.diff(first))
                mass = np.stack([np.bincount(owner, p[:, c], b - a) for c in range(len(labels))], 1)
                best[a:b] = mass.argmax(1)
                familiar[a:b] = np.bincount(owner, known * size, b - a) / np.maximum(np.bincount(owner, size, b - a), 1)
                score[a:b] = np.divide(mass.max(1), mass.sum(1), out=np.zeros(b - a), where=mass.sum(1) > 0)
            ok = lettered & bool(labels)
            names = [labels[k] if good else UNDECIDED for k, good in zip(best.tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(np.where(ok, np.clip(score, 0, 1), 0.0)), pa.array(familiar)], [*kept, "lang_pred", "score", "familiar"])

    return df.select(*kept).mapInArrow(run, schema)


def spans(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id and `spans` of every document: runs of words of one language, as first_word, after_word, lang and score.

    A word's language is its most probable one, a run's score the mean of its words' probabilities of it.
    """
    shared = trained(inputs(df, doc_id, text, lang))
    kind = df.schema[doc_id].dataType.simpleString()
    run_type = pa.list_(pa.struct([("first_word", pa.int64()), ("after_word", pa.int64()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, emit, move = table_of(shared)
        for batch in batches:
            raw, ends = buffers(batch.column(1))
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for a, b in slices(ends) if labels else ():
                _, _, p, first, _ = posteriors(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a], emit, move)
                best = p.argmax(1) if len(p) else np.zeros(0, np.int64)
                for k, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), a):
                    edges = [x, *(x + 1 + np.flatnonzero(np.diff(best[x:y]))).tolist(), y] if y > x else []
                    out[k] = [{"first_word": i - x, "after_word": j - x, "lang": labels[best[i]], "score": float(p[i:j, best[i]].mean())} for i, j in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, run_type)], ["doc_id", "spans"])

    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {kind}, spans array<struct<first_word:long,after_word:long,lang:string,score:double>>")


def predict(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    out = label(df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
