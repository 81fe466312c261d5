"""Document fingerprints by one-permutation MinHash, in DataFrame expressions alone.

The 64-bit hashes of a text's word 5-grams are binned once: their top bits choose one of BINS bins, and a bin keeps its
smallest hash. An empty bin copies one of the full bins, chosen by a hash of both bins' numbers alone (optimal
densification: each empty bin ranks all bins in its own random order and takes the first full one). Of every bin the lowest
BITS bits are stored. Two fingerprints agree in a bin by chance with probability 2**-BITS; the likeness takes that out:
(agreeing share - 2**-BITS) / (1 - 2**-BITS), not below 0.

Texts are cut into words at white space of the word rule, without folding. A text of fewer than five words has one
shingle, all of them. Null text is empty; an empty text has the empty fingerprint, which is like itself (1) and nothing
else (0). Ids order documents, nulls are smallest, equal ids order by hash of their text.

All hashing, binning and packing is row-local. Only finding the next document moves data: ids are cut into ranges of like
numbers of rows, a range's first row is sent to the range before it as well, and a window within each range does the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH, BINS, BITS = 5, 128, 8
SPACES = r"[\x20\x09-\x0D]+"


def shingle_hashes(words: str) -> Column:
    """Hashes of all shingles of an array column of word hashes."""
    w = F.col(words)
    at = lambda i, k: F.get(w, i + k)
    every = F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*(at(i, k) for k in range(WIDTH))))
    return F.when(F.size(w) >= WIDTH, every).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - int(math.log2(BINS))).cast("int")


def low(h: Column) -> Column:
    return (h.bitwiseAND(F.lit((1 << BITS) - 1)) - (1 << BITS - 1)).cast("tinyint")


def signed(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with `to`, the packed bins of `text` as an array of BINS bytes; empty for a text without words.

    Steps are columns of their own so that what an array's lambda refers to is computed once.
    """
    a, b, c, d = (f"_{to}_{x}" for x in "abcd")
    df = df.withColumn(a, F.transform(F.filter(F.split(F.col(text), SPACES), lambda w: w != ""), lambda w: F.xxhash64(w)))
    df = df.withColumn(b, F.sort_array(shingle_hashes(a)))
    df = df.withColumn(c, F.filter(b, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(b), i - 1)))))
    df = df.withColumn(d, F.transform(c, bin_of))
    rank = lambda j: F.array_min(F.transform(F.col(c), lambda x: F.struct(F.xxhash64(j, bin_of(x)).alias("r"), low(x).alias("v"))))["v"]
    full = F.transform(c, lambda x: F.struct(bin_of(x).alias("j"), low(x).alias("v")))
    empty = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(BINS - 1)), F.col(d)), lambda j: F.struct(j.alias("j"), rank(j).alias("v")))
    packed = F.sort_array(F.concat(full, empty))["v"]
    df = df.withColumn(to, F.when(F.size(c) > 0, packed).otherwise(F.array().cast("array<tinyint>")))
    return df.drop(a, b, c, d)


def written(bins: str) -> Column:
    """Packed bins as hexadecimal digits."""
    digits = F.array(*(F.lit(f"{k:02x}") for k in range(1 << BITS)))
    return F.array_join(F.transform(bins, lambda v: F.get(digits, v.cast("int") + (1 << BITS - 1))), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two texts from their packed bins."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    estimate = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(estimate)


def ranges(df: DataFrame, key: str, number: int) -> tuple[list[list[int]], int]:
    """Bounds that cut a whole-number column into about `number` ranges of like numbers of rows, in a list of lists."""
    side = max(2, math.ceil(math.sqrt(number)))
    number = side * side
    cuts = df.agg(F.percentile_approx(key, [k / number for k in range(1, number)], 10 * number)).first()[0] or [0] * (number - 1)
    return [cuts[k * side : (k + 1) * side] for k in range(side)], side


def range_of(key: Column, bounds: list[list[int]], side: int) -> Column:
    """Number of a value's range, by two short lookups."""
    top = F.array(*(F.lit(b[-1]).cast("long") for b in bounds[:-1]))
    inner = F.array(*(F.array(*(F.lit(x).cast("long") for x in [*b, *[b[-1]] * (side - len(b))])) for b in bounds))
    value = F.coalesce(key.cast("long"), F.lit(-(1 << 63)))
    coarse = F.size(F.filter(top, lambda x: x < value))
    fine = F.size(F.filter(F.slice(F.get(inner, coarse), 1, side - 1), lambda x: x < value))
    return (coarse * side + fine).cast("int")


def next_rows(df: DataFrame, key: str, tie: str, columns: list[str], prefix: str = "next_") -> DataFrame:
    """df with each column of the row that follows in descending order of key, then tie; the first follows the last."""
    spark = df.sparkSession
    bounds, side = ranges(df, key, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = df.withColumn("_range", range_of(F.col(key), bounds, side))
    # One row a range on the driver, their number set by the session's partitions.
    heads = sorted(held.groupBy("_range").agg(F.max(F.struct(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"), F.col(tie).alias("t"))).alias("m")).collect(), key=lambda r: -r["_range"])
    size = side * side
    ks, ts, to = [0] * size, [0] * size, [-1] * size
    for place, r in enumerate(heads):
        ks[r["_range"]], ts[r["_range"]], to[r["_range"]] = r["m"]["k"], r["m"]["t"], heads[place - 1]["_range"]
    look = lambda values, kind: F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("_range"))
    is_head = (F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))) == look(ks, "long")) & (F.col(tie) == look(ts, "long"))
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("g"))
    guest = F.struct(look(to, "int").alias("r"), F.lit(True).alias("g"))
    dealt = held.withColumn("_to", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.withColumn("_range", F.col("_to.r")).withColumn("_guest", F.col("_to.g")).drop("_to")
    order = Window.partitionBy("_range").orderBy(F.asc("_guest"), F.desc_nulls_last(key), F.desc(tie))
    for c in columns:
        dealt = dealt.withColumn(prefix + c, F.lead(c).over(order))
    return dealt.filter(~F.col("_guest")).drop("_range", "_guest")


def fingerprints(df: DataFrame, *, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of a text column, as digits."""
    filled = df.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    return signed(filled, "_text", "_bins").withColumn(to, written("_bins")).drop("_text", "_bins")


def edited(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, whose last third is the beginning of the next document."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    docs = next_rows(signed(docs, "text", "bins"), "doc_id", "tie", ["text", "bins"])
    third = F.floor(F.char_length("text") / 3).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.char_length("text") - third)
    docs = docs.withColumn("edit", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), third)))
    docs = signed(docs.withColumn("n_chars", F.char_length("text").cast("long")).drop("text", "next_text"), "edit", "edit_bins")
    return docs.select(
        "doc_id", "n_chars", F.sha2("edit", 256).alias("edited_sha256"), written("bins").alias("fingerprint"), written("edit_bins").alias("edited_fingerprint"),
        likeness("bins", "edit_bins").alias("near_edited"), likeness("bins", "next_bins").alias("near_next"),
    )
