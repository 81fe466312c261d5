"""What a patch without a match may have meant: recovery strategies with confidences, and fuzzy suggestions over corpora."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import codecs
from textloom.functions.values import levenshtein, similar_strings
from textloom.operators import md
from textloom.plans.spec import SECTION_OPS
from textloom.sources.shared import shared_folder


class Fix(NamedTuple):
    patch: dict
    confidence: float
    why: str


AUTO = 0.8


def section_typo(patch: dict, text: str) -> list[Fix]:
    if patch["op"] not in SECTION_OPS:
        return []
    ids = [s.id for s in md.sections(text.split("\n"))]
    return [Fix(patch | {"id": name}, min(0.85, ratio), f"section {name!r}") for name, _, ratio in similar_strings(patch["id"], ids, 3)] if patch["id"] not in ids else []


def case_mismatch(patch: dict, text: str) -> list[Fix]:
    key = {"replace": "old", "replace-line": "match"}.get(patch["op"])
    if not key or not (m := re.search(re.escape(patch[key]), text, re.I)) or m[0] == patch[key]:
        return []
    return [Fix(patch | {key: m[0]}, 0.9, "letter case")]


def white_space(patch: dict, text: str) -> list[Fix]:
    key = {"replace": "old", "replace-line": "match"}.get(patch["op"])
    words = patch[key].split() if key else []
    if not words or not (m := re.search(r"\s+".join(map(re.escape, words)), text)) or m[0] == patch[key]:
        return []
    return [Fix(patch | {key: m[0]}, 0.88, "white space")]


def key_typo(patch: dict, text: str) -> list[Fix]:
    key = {"remove-frontmatter": "key", "rename-frontmatter": "old"}.get(patch["op"])
    if not key:
        return []
    names = list(codecs.split_frontmatter(text)[0])
    return [Fix(patch | {key: name}, min(0.85, ratio), f"key {name!r}") for name, _, ratio in similar_strings(patch[key], names, 1)]


def line_typo(patch: dict, text: str) -> list[Fix]:
    if patch["op"] not in ("replace-line", "insert-after-line", "insert-before-line") or "match" not in patch:
        return []
    want = patch["match"]
    most = max(5, int(0.2 * len(want)))
    near = sorted((d, x) for x in dict.fromkeys(text.split("\n")) if x.strip() and 0 < (d := levenshtein(want, x, most)) <= most)
    return [Fix(patch | {"match": x}, 0.75 * (1 - min(1.0, d / most)), f"line {x!r}") for d, x in near[:3]]


def marker_order(patch: dict, text: str) -> list[Fix]:
    if patch["op"] not in ("delete-between", "replace-between"):
        return []
    lines = text.split("\n")
    return [Fix(patch | {"start": patch["end"], "end": patch["start"]}, 0.95, "markers swapped")] if not md.between(lines, patch["start"], patch["end"]) and md.between(lines, patch["end"], patch["start"]) else []


#: Edits within which all targets meet candidates first; only those with too few go on to all that their length allows.
RING = 2
#: Targets of so many characters are allowed three edits at most and meet by deletions, longer ones by segments.
SHORT = 10
#: 64-bit words of a key's bitmap of its targets' signatures.
WORDS = 8
STRATEGIES = (section_typo, case_mismatch, white_space, key_typo, line_typo, marker_order)


def fixes(patch: dict, text: str) -> list[Fix]:
    """All fixes that make the patch match, most confident first."""
    found = [f for s in STRATEGIES for f in s(patch, text)]
    return sorted((f for f in found if md.apply(text, {k: v for k, v in f.patch.items() if k != "id" or patch["op"] in SECTION_OPS})[1]), key=lambda f: -f.confidence)


def automatic(patch: dict, text: str, least: float = AUTO) -> Fix | None:
    """The best fix, if it is certain enough."""
    return next((f for f in fixes(patch, text) if f.confidence >= least), None)


def allowed_distance(target: Column) -> Column:
    n = F.char_length(target)
    return F.when(n <= 5, 2).when(n <= 10, 3).when(n <= 20, 5).otherwise(7)


def folded(x: Column) -> Column:
    """Lower case that no context changes and that maps each character to one or none, so folding adds no edits."""
    return F.translate(F.lower(x), "ς\u0307", "σ")


def span(start: Column | int, stop: Column | int) -> Column:
    """Whole numbers from start to stop, none if stop is smaller."""
    start, stop = (F.lit(x) if isinstance(x, int) else x for x in (start, stop))
    return F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))


def deletions(x: Column, most: int) -> Column:
    """Hashes of what up to `most` deletions leave. Strings within so many edits share one."""
    level = whole = F.array(x)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, lambda s: F.transform(span(1, F.char_length(s)), lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.char_length(s)))))))
        whole = F.concat(whole, level)
    return F.transform(F.array_distinct(whole), lambda s: F.xxhash64(F.lit(0), s))


def segment(n: Column, i: Column, most: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 1) of most + 1 nearly equal ones of n characters."""
    short = F.floor(n / (most + 1)).cast("int")
    longer = n % (most + 1)  # the last ones
    return 1 + (i - 1) * short + F.greatest(F.lit(0), i - 1 - (most + 1 - longer)), short + (i > most + 1 - longer).cast("int")


def segments(x: Column, most: int) -> Column:
    """Hashes of a candidate's segments: with up to `most` edits one of them is left whole, at about its place."""
    def one(i: Column) -> Column:
        start, size = segment(F.char_length(x), i, most)
        return F.xxhash64(F.lit(most), F.char_length(x), i, x.substr(start, size))

    return F.transform(span(1, most + 1), one)


def probes(x: Column, most: int) -> Column:
    """Hashes of the pieces of a target that can be a segment of a candidate within `most` edits, by that one's length.

    Of several segments that are left whole one has as many edits before it as segments, and no more after it: its place
    moves by fewer edits than the segments before or after it number.
    """
    n = F.char_length(x)

    def of_length(m: Column) -> Column:
        def of_segment(i: Column) -> Column:
            start, size = segment(m, i, most)
            low = F.greatest(start - (i - 1), start + (n - m) - (most + 1 - i), F.lit(1))
            high = F.least(start + (i - 1), start + (n - m) + (most + 1 - i), n - size + 1)
            return F.transform(span(low, high), lambda at: F.xxhash64(F.lit(most), m, i, x.substr(at, size)))

        return F.flatten(F.transform(span(1, most + 1), of_segment))

    return F.array_distinct(F.flatten(F.transform(span(F.greatest(F.lit(0), n - most), n + most), of_length)))


def with_words(targets: DataFrame, candidates: DataFrame, by: list[str], signatures: Column) -> tuple[DataFrame, Column]:
    """Candidates of keys that have targets, and those of their signatures that their key's targets may have, told by a bitmap
    of one size for each key: the others never leave the row."""
    place = lambda x: F.pmod(x, F.lit(64 * WORDS)).cast("int")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), place(x) % 64)
    word = lambda x: F.floor(place(x) / 64).cast("int")
    none = F.lit(0).cast("bigint")
    seen = targets.groupBy(*by).agg(F.array(*(F.bit_or(F.when(word(F.col("_sig")) == k, bit(F.col("_sig"))).otherwise(none)) for k in range(WORDS))).alias("_seen"))
    return candidates.join(seen, by), F.filter(signatures, lambda x: F.get("_seen", word(x)).bitwiseAND(bit(x)) != 0)


def _pairs(targets: DataFrame, candidates: DataFrame, by: list[str], ring: bool) -> DataFrame:
    """Targets and candidates that share a signature, each pair once, with their distance where it is allowed."""
    x, y = folded(F.col("target")), folded(F.col("value"))
    short, size = F.char_length("target") <= SHORT, F.char_length(y)
    none = F.array().cast("array<bigint>")
    if ring:
        t = F.when(short, deletions(x, RING)).otherwise(probes(x, RING))
        c = F.concat(F.when(size <= SHORT + RING, deletions(y, RING)).otherwise(none), segments(y, RING))
    else:
        t = F.when(short, deletions(x, 3)).when(F.char_length("target") <= 20, probes(x, 5)).otherwise(probes(x, 7))
        c = F.concat(F.when(size <= SHORT + 3, deletions(y, 3)).otherwise(none), segments(y, 5), segments(y, 7))
    targets = targets.withColumn("_sig", F.explode(t))
    if by:
        candidates, c = with_words(targets, candidates, by, c)
    met = targets.join(candidates.withColumn("_sig", F.explode(c)), [*by, "_sig"]).select(*by, "target", "value").distinct()
    met = met.filter(F.col("target") != F.col("value"))
    most = RING if ring else 7
    within = lambda a, b: F.levenshtein(a, b, most)  # noqa: E731 - -1 beyond
    # lower case never adds edits, but for the one letter that becomes two
    odd = F.contains("target", F.lit("İ")) | F.contains("value", F.lit("İ"))
    lower, plain = within(F.lower("target"), F.lower("value")), F.when(odd, within(F.col("target"), F.col("value")))
    both = met.select("*", F.inline(F.array(F.struct(lower.alias("_l"), plain.alias("_p")))))  # computed once, whatever reads it
    distance = F.least(F.when(F.col("_l") >= 0, F.col("_l")), F.when(F.col("_p") >= 0, F.col("_p")))
    return both.withColumn("distance", distance).drop("_l", "_p").filter(F.col("distance") <= (RING if ring else allowed_distance(F.col("target"))))


def nearest(targets: DataFrame, candidates: DataFrame, top: int = 5, key: str | None = None) -> DataFrame:
    """target, value, distance: the candidates nearest each target within the edits its length allows, with case or without.

    With a key, targets meet only their own candidates (a document's sections). Strings meet in an equi-join of signatures
    and are compared once: short ones by what deletions leave of both, longer ones by segments of the candidate that edits
    leave whole. Targets with `top` candidates within RING edits are done; the others, if there are any, go on with all edits
    they may have. What the first ring found is written to the shared folder, since both steps read it.
    """
    by = [key] if key else []
    targets, candidates = targets.select(*by, "target").distinct(), candidates.select(*by, "value").distinct()
    spark, where = targets.sparkSession, shared_folder(targets.sparkSession, "near")
    first = _pairs(targets, candidates, by, ring=True)
    first.write.parquet(where)
    near = spark.read.schema(first.schema).parquet(where)
    done = near.groupBy(*by, "target").agg(F.count("*").alias("_n")).filter(F.col("_n") >= top).drop("_n")
    left = targets.filter(allowed_distance(F.col("target")) > RING).join(done, [*by, "target"], "left_anti")
    found = near if left.isEmpty() else near.unionByName(_pairs(left, candidates, by, ring=False)).distinct()
    place = F.row_number().over(Window.partitionBy(*by, "target").orderBy("distance", "value"))
    return found.withColumn("_place", place).filter(F.col("_place") <= top).select(*by, "target", "value", "distance")
