"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target of words: its share by weight of `share` times all words, never above `most` times its own
words; what exceeds that is shared again by weight among the others until no target is above. A document is then taken
floor(m) times, m being its source's target over its words, and once more with probability m - floor(m).

Those draws are not independent: the cube method moves the vector of probabilities through the null space of two
constraints, a source's words and its documents, so both totals stay at their expected values. A flight looks at three
undecided documents at a time; each step decides at least one. Flights run in groups of at most GROUP documents of one
source, what they leave undecided (two documents a group) meets in the next round, and the last round of a source lands:
all choices for its last undecided documents, two and LANDING set aside, are compared and the one whose words come
nearest the expected total is taken.

Null text has no words; null sources form a source of their own, last in order. Documents without words are taken
floor(m) times or once more like others, which adds nothing. Repeated rows are documents of their own; where rows share id,
text and source, their draws are shared out. Reruns agree: all randomness comes from hashes of ids and texts, and from the
numbers of rows where more than a group's rows are alike. An empty table gives an empty result. Other columns of the input
play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.base import WORD, cut, frequent

#: Fixed values of the contract: weights by the sources' order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
GROUP = 4096
LANDING = 14
NEAR = 1e-9
#: Sources up to this many are broadcast as one small row each.
FEW = 10_000


def targets(sizes: np.ndarray, weights: np.ndarray, share: float, most: float) -> np.ndarray:
    """Words wanted of each source. sizes, weights: by source."""
    limit, out = most * sizes, np.zeros(len(sizes))
    left, open_ = share * sizes.sum(), sizes > 0
    while open_.any():
        want = np.where(open_, left * weights / weights[open_].sum(), 0.0)
        over = open_ & (want > limit)
        if not over.any():
            return out + want
        out[over] = limit[over]
        left -= limit[over].sum()
        open_ &= ~over
    return out


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator, keep: int = 0) -> np.ndarray:
    """Move p along vectors that keep sum(p) and sum(p * x) until at most two are undecided, or `keep` more at the end."""
    p = p.astype(float).tolist()
    size = x.astype(float).tolist()
    draws = rng.random(len(p) + 8).tolist()
    active: list[int] = []
    for k in range(len(p) - keep):
        if NEAR < p[k] < 1 - NEAR:
            active.append(k)
        if len(active) < 3:
            continue
        i, j, m = active
        u = (size[m] - size[j], size[i] - size[m], size[j] - size[i])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[q]) / v if v > 0 else -p[q] / v for q, v in zip(active, u, strict=True) if v)
        down = min(p[q] / v if v > 0 else (p[q] - 1) / v for q, v in zip(active, u, strict=True) if v)
        step = up if draws[k] * (up + down) < down else -down
        for q, v in zip(active, u, strict=True):
            p[q] += step * v
        active = [q for q in active if NEAR < p[q] < 1 - NEAR]
        if len(active) == 3:  # rounding: the nearest to a bound is decided
            q = min(active, key=lambda a: min(p[a], 1 - p[a]))
            p[q] = round(p[q])
            active.remove(q)
    return np.array([0.0 if v <= NEAR else 1.0 if v >= 1 - NEAR else v for v in p])


def landing(p: np.ndarray, x: np.ndarray, owed: float) -> np.ndarray:
    """Decide the last few: words nearest to what is owed, then the number of documents nearest the expected."""
    n = len(p)
    choice = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    off = np.abs(choice @ x - owed)
    count = np.abs(choice.sum(1) - p.sum())
    return choice[np.lexsort((count, off))[0]].astype(float)


def seed(frame: pd.DataFrame, round_: int) -> np.random.Generator:
    return np.random.default_rng([round_, len(frame), int(frame["h"].to_numpy(np.int64).view(np.uint64).sum(dtype=np.uint64))])


def ordered(frame: pd.DataFrame, keep: int) -> pd.DataFrame:
    """Large documents first; at the end the `keep` that land, of all sizes below the largest. Ties by hash, then row."""
    frame = frame.sort_values(["size", "h", "row"], ascending=[False, True, True], kind="stable")
    last = np.unique(np.linspace(0.3 * len(frame), len(frame) - 1, keep).astype(int)) if keep else []
    return frame.iloc[np.concatenate([np.setdiff1d(np.arange(len(frame)), last), last]).astype(int)]


def source_table(docs: DataFrame, weights: tuple[float, ...], share: float, most: float) -> pd.DataFrame:
    """Words, documents, target and multiple of each source. One row a source goes to the driver: sources are few labels."""
    got = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).toPandas()
    named = sorted((s for s in got["source"] if s is not None and s == s), key=lambda s: [ord(c) for c in s])
    place = {s: k for k, s in enumerate(named)}
    got["place"] = [place.get(s, len(named)) for s in got["source"]]
    got = got.sort_values("place").reset_index(drop=True)
    sizes = got["source_size"].to_numpy(float)
    got["target"] = targets(sizes, np.array([weights[k % len(weights)] for k in range(len(got))]), share, most)
    got["multiple"] = np.divide(got["target"], sizes, out=np.zeros(len(got)), where=sizes > 0)
    return got


def row_key(doc_id: Column, text: Column, source: Column) -> Column:
    """What rows must share to be drawn from one lot. Nulls have hashes of their own."""
    return F.xxhash64(doc_id, doc_id.isNull(), text, text.isNull(), source, source.isNull())


def mix(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document, and the key by which repeated() finds its row."""
    spark = df.sparkSession
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"), row_key(F.col(doc_id), F.col(text), F.col(source)).alias("key"))
    docs = cut(docs.withColumn("row", F.monotonically_increasing_id()), "sizes")  # a row's number is fixed once written
    table = source_table(docs, weights, share, most)
    known = spark.createDataFrame(
        [(int(r.place), r.source if isinstance(r.source, str) else None, int(r.source_size), float(r.target), float(r.multiple)) for r in table.itertuples()],
        "place int, _source string, source_size long, target double, multiple double",
    )
    docs = docs.join(F.broadcast(known) if len(table) <= FEW else known, F.col("source").eqNullSafe(F.col("_source")))
    docs = docs.withColumn("base", F.floor(F.col("multiple") + F.lit(NEAR)))
    docs = docs.withColumn("p", F.greatest(F.lit(0.0), F.col("multiple") - F.col("base")))
    rest = docs.filter((F.col("p") > NEAR) & (F.col("size") > 0)).select("place", "row", "size", "h", "p")
    often = frequent(rest, "h", GROUP)  # rows that repeat so often are dealt to groups by their number
    lot = F.when(F.col("h").isin(often), F.xxhash64("h", "row")).otherwise(F.col("h")) if often else F.col("h")
    counts = _counted(rest)
    decided = spark.createDataFrame([], "row long, extra int")
    level = 0
    while counts:
        groups = {place: max(1, -(-n // GROUP)) for place, n in counts.items()}
        split = spark.createDataFrame(list(groups.items()), "place int, groups int")
        dealt = rest.join(F.broadcast(split) if len(groups) <= FEW else split, "place")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64(lot, F.lit(level)), F.col("groups").cast("long")).cast("int"))

        flown = cut(dealt.groupBy("place", "part").applyInPandas(flier(level), "place int, row long, size long, h long, p double"), f"flight{level}")
        done = (F.col("p") == 0) | (F.col("p") == 1)
        decided = decided.unionByName(flown.filter(done).select("row", F.col("p").cast("int").alias("extra")))
        rest = flown.filter(~done)
        counts = _counted(rest)
        level += 1
    out = docs.join(decided, "row", "left")
    taken = (F.col("base") + F.coalesce(F.col("extra"), F.lit(0))) * F.col("size")
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "key")


def flier(level: int):
    """The flight of one group; a source's only group lands."""

    def fly(frame: pd.DataFrame) -> pd.DataFrame:
        ends = int(frame["groups"].iloc[0]) == 1
        frame = ordered(frame, LANDING if ends else 0)
        x, before = frame["size"].to_numpy(float), frame["p"].to_numpy(float)
        p = flight(before, x, seed(frame, level), min(LANDING, len(frame)) if ends else 0)
        if ends:
            open_ = (p > 0) & (p < 1)
            p[open_] = landing(p[open_], x[open_], float((before * x).sum() - (p * x)[~open_].sum()))
        return frame.assign(p=p)[["place", "row", "size", "h", "p"]]

    return fly


def _counted(rest: DataFrame) -> dict[int, int]:
    """Undecided documents by source."""
    return {r["place"]: r["n"] for r in rest.groupBy("place").agg(F.count("*").alias("n")).collect()}


def repeated(df: DataFrame, mixed: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of df as often as the mix takes them, each row by a draw of its own. `mixed` is mix(df)."""
    times = mixed.filter(F.col("size") > 0).groupBy(F.col("key").alias("_mix_key")).agg(F.sort_array(F.collect_list((F.col("taken") / F.col("size")).cast("int")), asc=False).alias("_mix_times"))
    times = times.filter(F.col("_mix_times")[0] > 0)
    joined = df.withColumn("_mix_of", row_key(F.col(doc_id), F.col(text), F.col(source))).join(times, F.col("_mix_of") == F.col("_mix_key"))
    among = Window.partitionBy("_mix_of").orderBy(F.xxhash64(*df.columns))  # rows of one key share out its draws
    joined = joined.withColumn("_mix_n", F.get("_mix_times", F.row_number().over(among) - 1)).filter("_mix_n > 0")
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).select(*df.columns)
