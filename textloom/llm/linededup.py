"""Line dedup: remove runs of lines that an earlier place of the corpus already has.

Lines are what line feeds separate, without white space at their ends; blank lines count for nothing. The k-gram of a
line is that line and those after it up to K words. Windows of k-grams that begin within K words of each other select the
k-gram with the smallest hash (winnowing), so any two runs of equal lines with 2 K = 50 words or more select a common
k-gram: it is their guaranteed fingerprint. A fingerprint that an earlier place has too, in order of id and line, is
extended both ways, as long as lines are in a gram that an earlier place has and that overlaps what is covered so far.
Grams are all k-grams, and for each line also the shortest one of K words that ends with it: together they cover every
run of K words or more, whichever place has it. Every deleted line has an equal one at an earlier place, so something of
each repeated run stays.

A gram's places are never paired with each other, only with the first, so a line of a third of all documents costs one
row each; places of grams so frequent are dealt over many tasks. Null text stays null and has no lines, an empty table gives
an empty result. Rows that repeat id and text are one document: they keep the same lines. Null ids come first. Ids and texts
are the only columns read; all others pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import SHARE, SPREAD, cut, spread_join, strings

#: Words of a k-gram, the least that is deleted, and of a window.
K = 25


def parsed(text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Place, hash and words of every line that isn't blank."""
    at, hashes, words = [], [], []
    for k, line in enumerate(text.split("\n")):
        if line := line.strip():
            data = line.encode()
            at.append(k)
            hashes.append(xxhash.xxh3_64_intdigest(data))
            words.append(len(data.split()) or 1)
    return at, np.array(hashes, np.uint64), np.array(words, np.int64)


def fingerprints(hashes: np.ndarray, words: np.ndarray, k: int = K) -> list[tuple[int, int]]:
    """Selected k-grams of a document: hash and the line (among lines that aren't blank) at which each begins."""
    total = np.concatenate([[0], np.cumsum(words)])
    stop = np.searchsorted(total, total[:-1] + k)  # lines i .. stop[i] - 1 have k words
    starts = int((stop < len(total)).sum())
    if not starts:
        return []
    data = hashes.tobytes()
    grams = [xxhash.xxh3_64_intdigest(data[8 * i : 8 * j]) for i, j in enumerate(stop[:starts].tolist())]
    reach = np.minimum(np.searchsorted(total, total[:starts] + k), starts).tolist()
    out: dict[int, int] = {}
    best = -1
    for i in range(starts):
        to = max(reach[i], i + 1)
        if best < i:
            best = min(range(i, to), key=lambda j: (grams[j], -j))
        else:
            for j in range(max(reach[i - 1], i) if i else i, to):
                if grams[j] <= grams[best]:
                    best = j
        out[best] = grams[best]
    return [(h, i) for i, h in out.items()]


def grams(words: np.ndarray, k: int = K) -> list[tuple[int, int]]:
    """First line and stop of the shortest stretches of k words that begin with a line, and of those that end with one."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    stop = np.searchsorted(total, total[:-1] + k)
    start = np.searchsorted(total, total[1:] - k, "right") - 1
    return sorted({(i, j) for i, j in enumerate(stop.tolist()) if j <= n} | {(i, j + 1) for j, i in enumerate(start.tolist()) if i >= 0})


def lines(df: DataFrame, k: int) -> DataFrame:
    """One row a document: id, h (of the text) and its grams: 128 bits of hash, first line that isn't blank, places of its lines, whether it is a fingerprint. Documents under k words have none."""
    kind = df.schema["id"].dataType.simpleString()
    found = pa.list_(pa.struct([("f", pa.int64()), ("g", pa.int64()), ("pos", pa.int32()), ("places", pa.list_(pa.int32())), ("chosen", pa.bool_())]))
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            prints_ = []
            for row, x in enumerate(strings(batch.column(2))):
                at, hashes, words = parsed(x)
                if words.sum() < k:
                    continue
                rows.append(row)
                data = hashes.tobytes()
                stops: dict[int, int] = {}
                own = grams(words, k)
                for i, j in own:
                    stops.setdefault(i, j)  # the k-gram of a line is the shortest that begins there
                chosen = {(i, stops[i]) for _, i in fingerprints(hashes, words, k)}
                prints = []
                for i, j in own:
                    full = xxhash.xxh3_128_intdigest(data[8 * i : 8 * j])
                    prints.append({"f": signed(full >> 64), "g": signed(full & (1 << 64) - 1), "pos": i, "places": at[i:j], "chosen": (i, j) in chosen})
                prints_.append(prints)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(prints_, found)], ["id", "h", "prints"])

    return df.select("id", "h", "text").mapInArrow(run, f"id {kind}, h long, prints array<struct<f:long,g:long,pos:int,places:array<int>,chosen:boolean>>")


def extended(found: list[tuple[int, list[int], bool]]) -> list[int]:
    """Places of the lines to delete in a document, from the grams that an earlier place has: stretches of overlapping ones that have a fingerprint."""
    out: list[int] = []
    stretch: list[int] = []
    stop, anchored = -1, False
    for pos, places, chosen in sorted(found):
        if pos >= stop:
            out += stretch if anchored else []
            stretch, stop, anchored = [], pos, False
        stretch += places[max(stop - pos, 0) :]
        stop, anchored = max(stop, pos + len(places)), anchored or chosen
    return out + (stretch if anchored else [])


def removals(df: DataFrame, k: int = K) -> DataFrame:
    """id, h, gone: places of the lines to delete. df: id, h, text."""
    kind = df.schema["id"].dataType.simpleString()
    known = cut(lines(df, k), "lines").dropDuplicates(["id", "h"])
    prints = known.select("id", "h", F.explode("prints").alias("x")).select("id", "h", "x.*")
    first = prints.groupBy("f", "g").agg(F.min(F.struct("id", "h", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = cut(first, "first")
    least = max((known.agg(F.sum(F.size("prints"))).first()[0] or 0) // SHARE, SPREAD * SPREAD)
    often = [r[0] for r in first.filter(F.col("n") > least).select("f").distinct().collect()]  # fewer than SHARE
    later = spread_join(prints, first.drop("n"), ["f", "g"], often, "inner").filter(~F.struct("id", "h", "pos").eqNullSafe(F.col("first")))
    full = later.groupBy("id", "h").agg(F.collect_list(F.struct("pos", "places", "chosen")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extended([(x["pos"], x["places"], x["chosen"]) for x in at]) for at in batch.column("at").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(out, pa.list_(pa.int32()))], ["id", "h", "gone"])

    return full.mapInArrow(run, f"id {kind}, h long, gone array<int>").filter(F.size("gone") > 0)


def dedup(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """df with `text` less its repeated runs, `n_lines` that the text had and `n_removed` of them. Columns of those two names are replaced."""
    kept = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    body, key = F.col(text).cast("string"), F.xxhash64(F.col(text).cast("string"))
    gone = removals(df.select(F.col(doc_id).alias("id"), key.alias("h"), body.alias("text")), k)
    gone = gone.select(F.col("id").alias("_gone_id"), F.col("h").alias("_gone_h"), F.col("gone").alias("_gone"))
    joined = df.select(*kept).join(gone, F.col(doc_id).eqNullSafe(F.col("_gone_id")) & (key == F.col("_gone_h")), "left")
    split = F.split(body, "\n")
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return joined.select(
        *(F.when(F.col("_gone").isNull(), body).otherwise(left).alias(c) if c == text else F.col(c) for c in kept),
        F.when(body.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
