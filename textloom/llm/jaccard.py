"""N-gram Jaccard join: which documents share at least 80 % of their word 5-grams, exactly, and what they connect.

1. Shingling gives each document its set of 64-bit shingle hashes, a signature of that set and a sketch: of a set of up to
   512 hashes which of 1024 equal ranges have any, of a larger one how many each of 64 has. Documents with one set are one
   node from here on, so exact copies never meet.
2. A fixed table of 2**21 counters, summed over all documents, orders shingles rare first: by the logarithm of their
   counter, then by hash. Any total order makes prefix filtering exact; this one keeps frequent shingles out of prefixes.
3. Each set sends its prefix, the n - ceil(0.8 n) + 1 rarest shingles, to the shingles' buckets: a bitmap of the ids that
   stand for a set keeps nearly all other copies from sending it again. Sets that meet nowhere can't be similar.
4. In each bucket every set is paired with one hub only, the member least edited. Buckets of very frequent shingles are
   salted, and their hubs meet in a second round. Shingles of one prefix alone are told before, from three bytes of each, and
   stay where they are. Pairs that pass the length and positional filters, then the suffix filter
   (a range that one sketch alone has, or has more of, is a member that the other lacks), are verified once: by shortened
   hashes of all members, and on the whole sets where the threshold lies within what chance can add to those.
5. Components of those links tell which members of buckets of three and more are connected already. Of buckets with the
   same members, as the shingles of a shared passage make, one goes on. While pairs across
   components would outnumber the rows many times, members of other components meet their bucket's largest one, by its
   least edited member. At last the pairs of different components that pass all filters are verified, found by blocks of
   members against blocks, so no link that could change a component is lost.

Whole texts are read five times as a rule: for signatures, prefixes (twice), and the few sets that stand in a pair (twice). A bucket, a
hub, a set of copies or a component that holds many rows is dealt over many tasks by counts taken before.

Null text is empty. A document without words has an empty set, is linked with nothing and is its own component. With
fewer than five words the whole sequence is its one shingle. Rows that repeat are nodes of one set. An empty table gives an
empty result. Only the id and the text are read, so other columns can have any name. Null ids are ids like others, and the
smallest. Hash equality of 64 bits stands for equality of shingles and of sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.base import buffers, cut, hot_join, mix, shingle_sets, slices
from textloom.llm.graph import components

WIDTH = 5
#: Similarity of NUMERATOR / DENOMINATOR and more.
NUMERATOR, DENOMINATOR = 4, 5
COUNTERS, PARTS = 1 << 21, 256
#: Bits of the filter of documents whose sets are fetched.
BITS = 1 << 26
#: Bits of the code of a prefix's shingle, and of the filter of codes that occur twice. More shingles than these tell apart
#: let single ones pass, which then meet none.
CODE, FILTER = 32, 27
#: Codes that a task packs at once.
PACKED = 1 << 21
#: Salts of a bucket whose shingle's counter stands out.
SALTS = 64
#: Rounds, at most, in which members meet their buckets' largest components before all remaining pairs do, and how many
#: remaining pairs a row are worth a round, which reads all texts again. Neither changes the result.
ROUNDS, DENSE = 3, 64
#: Ranges of a sketch, and the largest set that has one: sketches hold 16-bit counts. Sets of up to SMALL members have bits
#: of as many bytes instead, and their size before them.
RANGES, SKETCHED = 64, (1 << 16) - 1
SMALL, WIDE = 512, 16 * RANGES
#: What a step of 16 bits between codes of a set's members can't hold: it stands for so much and no member.
STEP = (1 << 16) - 1
#: Members of a block of a bucket.
BLOCK = 512
MASKS = mix(np.arange(1, SALTS + 1, dtype=np.uint64))


def signatures(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set, from its members and size."""
    n = np.diff(ends)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)])
    return mix(total[ends[1:]] - total[ends[:-1]] + n.astype(np.uint64)).view(np.int64)


def sketches(sets: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
    """What bounds how many members two sets have in common: for small sets which of WIDE ranges have any, for others how many each of RANGES has."""
    n = np.diff(ends)
    owner = np.repeat(np.arange(len(n)), n)
    counts = np.bincount(owner * RANGES + (sets >> np.uint64(58)).astype(np.int64), minlength=len(n) * RANGES).reshape(-1, RANGES).astype(np.uint16)
    place = np.cumsum(n <= SMALL) - 1
    bits = np.zeros((int((n <= SMALL).sum()), WIDE), bool)
    some = n[owner] <= SMALL
    bits[place[owner[some]], (sets[some] >> np.uint64(64 - WIDE.bit_length() + 1)).astype(np.int64)] = True
    bits = np.packbits(bits, axis=1)
    return [size.to_bytes(2, "little") + bits[k].tobytes() if size <= SMALL else row.tobytes() if size <= SKETCHED else None for row, size, k in zip(counts, n.tolist(), place.tolist(), strict=True)]


class Sketches:
    """Sketches of several sets, by number."""

    def __init__(self, given: list[bytes | None]) -> None:
        self.small = np.array([x is not None and len(x) == 2 + WIDE // 8 for x in given], bool)
        self.none = np.array([x is None for x in given], bool)
        null = bytes(2 + WIDE // 8)
        self.bits = np.frombuffer(b"".join(x if k else null for x, k in zip(given, self.small.tolist(), strict=True)), np.uint8).reshape(-1, 2 + WIDE // 8)
        self.n, self.bits = self.bits[:, 0].astype(np.int64) + 256 * self.bits[:, 1].astype(np.int64), np.ascontiguousarray(self.bits[:, 2:]).view(np.uint64)
        zero = bytes(2 * RANGES)
        self.counts = np.frombuffer(b"".join(zero if k or x is None else x for x, k in zip(given, self.small.tolist(), strict=True)), np.uint16).reshape(-1, RANGES)

    def may_link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether pairs leave room for enough common members: a bit that one set alone has stands for a member that the other lacks.

        Pairs of a small and a large set pass, and of sets without a sketch.
        """
        out = np.ones(len(x), bool)
        for at in range(0, len(x), 1 << 14):
            p, q = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
            a, b = self.bits[p], self.bits[q]
            alone = lambda u, v: np.bitwise_count(u & ~v).sum(1, dtype=np.int64)
            few = np.minimum(self.n[p] - alone(a, b), self.n[q] - alone(b, a)) * (NUMERATOR + DENOMINATOR) < (self.n[p] + self.n[q]) * NUMERATOR
            u, v = self.counts[p].astype(np.int64), self.counts[q].astype(np.int64)
            less = np.minimum(u, v).sum(1) * (NUMERATOR + DENOMINATOR) < (u.sum(1) + v.sum(1)) * NUMERATOR
            small, large = self.small[p] & self.small[q], ~(self.small[p] | self.small[q] | self.none[p] | self.none[q])
            out[at : at + (1 << 14)] = ~(small & few | large & less)
        return out


def shingled(df: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, n, sig, sketch) and, where n is null, parts of a task's counters (part, counts)."""
    kind = df.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "sig", "sketch", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.uint32)
        type_ = None
        for batch in batches:
            raw, ends = buffers(batch.column(1))
            type_ = batch.column(0).type
            for a, b in slices(ends):
                sets, at = shingle_sets(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a], WIDTH)
                np.add.at(counters, (sets & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(signatures(sets, at)), pa.array(sketches(sets, at), pa.binary()), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], names
                )
        if type_ is not None:
            parts = [x.tobytes() for x in np.minimum(counters, 255).astype(np.uint8).reshape(PARTS, -1)]
            null = lambda t: pa.nulls(PARTS, t)
            yield pa.RecordBatch.from_arrays([null(type_), null(pa.int64()), null(pa.int64()), null(pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names)

    return df.mapInArrow(run, f"doc_id {kind}, n long, sig long, sketch binary, part int, counts binary")


def levels(parts: DataFrame) -> np.ndarray:
    """Logarithms of the summed counters: COUNTERS bytes on the driver, for any corpus. Tasks sum as rows stream by."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = total.setdefault(part, np.zeros(COUNTERS // PARTS, np.int64))
                got += np.frombuffer(counts, np.uint8)
        logs = [np.log2(x + 1).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(logs, pa.binary())], ["part", "logs"])

    out = np.zeros((PARTS, COUNTERS // PARTS), np.uint8)
    for row in parts.repartition("part").mapInArrow(add, "part int, logs binary").collect():
        out[row["part"]] = np.frombuffer(row["logs"], np.uint8)
    return out.ravel()


def prefix_rows(batches: Iterator[pa.RecordBatch], shared: np.ndarray, hot: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """key, sig, n, pos, salted of the rarest shingles of every distinct set of a task, of documents whose bit is set."""
    level, bits = shared[:COUNTERS], shared[COUNTERS:]
    known = set()  # sets of this task: copies that pass the bits send one prefix
    for batch in batches:
        raw, ends = buffers(marked(batch, bits) if len(bits) else batch.column("text"))
        for a, b in slices(ends):
            sets, at = shingle_sets(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a], WIDTH)
            sig, n = signatures(sets, at), np.diff(at)
            _, first = np.unique(sig, return_index=True)
            first = np.array([k for k in first.tolist() if n[k] and int(sig[k]) not in known], np.int64)
            known.update(sig[first].tolist())
            high = level[(sets & np.uint64(COUNTERS - 1)).astype(np.int64)]
            key = (high.astype(np.uint64) << np.uint64(56)) | (sets >> np.uint64(8))
            take = n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1
            picks = []
            for k in first.tolist():
                own = key[at[k] : at[k + 1]]
                picks.append(at[k] + np.argsort(own, kind="stable")[: take[k]])
            if not picks:
                continue
            at_ = np.concatenate(picks)
            count = take[first]
            owner = np.repeat(first, count)
            pos = np.arange(len(at_)) - np.repeat(np.cumsum(count) - count, count)
            salted = high[at_] >= hot
            h = np.where(salted, sets[at_] ^ MASKS[sig[owner] & (SALTS - 1)], sets[at_])
            yield h, sig[owner], n[owner], pos, salted


def marked(batch: pa.RecordBatch, bits: np.ndarray) -> pa.Array:
    """Texts of the documents whose bit is set."""
    at = batch.column("bit").to_numpy()
    return batch.column("text").filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))


def repeated(df: DataFrame, shared, hot: int) -> np.ndarray:
    """2**FILTER bits with those of the codes that prefixes have twice: of one size for any corpus.

    A code is the upper half of a shingle's hash: its first byte is the part, the other three are sent.
    """
    low = CODE - (PARTS - 1).bit_length()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[np.ndarray]) -> pa.RecordBatch:
            codes = np.sort(np.concatenate(held))
            edges = np.searchsorted(codes >> low, np.arange(PARTS + 1))
            three = codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : low // 8]
            some = [k for k in range(PARTS) if edges[k] < edges[k + 1]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([three[edges[k] : edges[k + 1]].tobytes() for k in some], pa.binary())], ["part", "codes"])

        held, size = [], 0
        for h, _, _, _, salted in prefix_rows(batches, shared.value, hot):
            held.append((h[~salted] >> np.uint64(64 - CODE)).astype(np.int64))
            size += len(held[-1])
            if size >= PACKED:
                yield told(held)
                held, size = [], 0
        if size:
            yield told(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(codes, np.uint8).reshape(-1, low // 8).astype(np.int64) @ (1 << 8 * np.arange(low // 8))
                bits = once.setdefault(part, np.zeros(1 << low - 3, np.uint8))
                again = np.concatenate([x[1:][x[1:] == x[:-1]], x[bits[x >> 3] >> (x & 7) & 1 == 1]])
                np.bitwise_or.at(bits, x >> 3, (1 << (x & 7)).astype(np.uint8))
                twice.setdefault(part, np.zeros((1 << FILTER) // PARTS, bool))[again >> CODE - FILTER] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(twice), pa.int32()), pa.array([np.packbits(x).tobytes() for x in twice.values()], pa.binary())], ["part", "bits"])

    out = np.zeros((PARTS, (1 << FILTER) // PARTS // 8), np.uint8)
    for row in df.mapInArrow(pack, "part int, codes binary").repartition("part").mapInArrow(meet, "part int, bits binary").collect():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def prefixes(df: DataFrame, shared, hot: int) -> DataFrame:
    """Dealt by key: key, h, sig, n, pos, salted of the rarest shingles of every distinct set, but for shingles that no second
    prefix has. shared: the levels and, behind them, the bitmap of the ids that stand for a set; without it all documents do.

    The key is the shingle's hash, changed by one of SALTS masks where its counter stands out. Those all go on: their hubs
    meet hubs of other salts.
    """
    df = df.select("text", bit("doc_id").alias("bit"))
    filter_ = df.sparkSession.sparkContext.broadcast(repeated(df, shared, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_.value
        for h, sig, n, pos, salted in prefix_rows(batches, shared.value, hot):
            code = (h >> np.uint64(64 - FILTER)).astype(np.int64)
            keep = salted | ((bits[code >> 3] >> (7 - (code & 7)).astype(np.uint8)) & 1 == 1)
            h, sig, n, pos, salted = (x[keep] for x in (h, sig, n, pos, salted))
            what = (salted.astype(np.int64) << 62) | (n << 31) | pos
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sig), pa.array(what)], ["key", "sig", "what"])

    dealt = df.mapInArrow(run, "key long, sig long, what long").repartition("key")  # three numbers a row cross the network
    mask = F.get(F.array(*(F.lit(int(x)) for x in MASKS.view(np.int64))), F.col("sig").bitwiseAND(SALTS - 1).cast("int"))
    part = lambda by: F.shiftright("what", by).bitwiseAND((1 << 31) - 1).cast("int")
    salted = F.col("what") >= (1 << 62)
    return dealt.select("key", F.when(salted, F.col("key").bitwiseXOR(mask)).otherwise(F.col("key")).alias("h"), "sig", part(31).alias("n"), part(0).alias("pos"), salted.alias("salted"))


def possible(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Length filter, and the positional filter of the first shingle that two prefixes share."""
    short, long_ = F.least(n, m), F.greatest(n, m)
    most = F.lit(1) + F.least(n - pos - 1, m - at - 1)
    return (short * DENOMINATOR >= long_ * NUMERATOR) & (most * (NUMERATOR + DENOMINATOR) >= (n + m) * NUMERATOR)


def hubs(rows: DataFrame, *by: str) -> DataFrame:
    """Each row with its bucket's hub, and whether others than the hub are there.

    The hub is the member with the fewest rarer shingles before the bucket's: of near copies the one least edited, to
    which the others are nearest.
    """
    bucket = Window.partitionBy(*by)
    hub = F.min(F.struct("pos", "n", F.xxhash64("sig").alias("o"), "sig")).over(bucket)
    return rows.withColumn("hub", hub).withColumn("many", F.min("sig").over(bucket) != F.max("sig").over(bucket))


def described(rows: DataFrame, by: str) -> DataFrame:
    """Rows of buckets with `group`, what identifies a bucket's members if they are more than two, and `lead`, the first of
    them by signature with its place. Two halves of a hash are summed, so that copies don't cancel out."""
    bucket = Window.partitionBy(by)
    hash_ = F.xxhash64("sig")
    half = lambda x: F.sum(x).over(bucket)
    group = F.struct(F.count("*").over(bucket).alias("k"), half(hash_.bitwiseAND(0xFFFFFFFF)).alias("low"), half(F.shiftrightunsigned(hash_, 32)).alias("high"))
    lead = F.min(F.struct("sig", "pos")).over(bucket)
    return rows.withColumn("group", group).withColumn("group", F.when(F.col("group.k") > 2, F.col("group"))).withColumn("lead", F.when(F.col("group.k") > 2, lead))


def remaining(rows: DataFrame) -> DataFrame:
    """h, sig, n, pos, salted of the buckets that have pairs beside those with the hub.

    A passage that documents share makes a bucket of each of its shingles, all with the same members. Of such buckets one
    is enough, that of the rarest shingle: there the positional filter holds. A bucket's place in the order of any one
    member is its place among them.
    """
    whole = rows.filter(F.col("group").isNotNull() & ~F.col("salted"))
    kept = whole.filter(F.col("sig") == F.col("lead.sig")).groupBy("group").agg(F.min(F.struct(F.col("lead.pos").alias("p"), "h")).alias("first")).select(F.col("first.h").alias("h"))
    some = whole.join(kept.distinct(), "h", "left_semi").unionByName(rows.filter("salted"))
    return cut(some.select("h", "sig", "n", "pos", "salted").distinct(), "members")


def paired(rows: DataFrame) -> DataFrame:
    other = F.col("sig") != F.col("hub.sig")
    fit = possible(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"))
    return rows.filter(other & fit).select(F.least("sig", "hub.sig").alias("a"), F.greatest("sig", "hub.sig").alias("b"))


def bit(of: str) -> Column:
    """An id's place in a bitmap."""
    return F.pmod(F.xxhash64(of), F.lit(BITS)).cast("long")


def bitmap(ids: DataFrame) -> np.ndarray:
    """BITS bits with those of the ids' hashes set: of one size for any corpus. Tasks set bits as rows stream by."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            bits = batch.column(1).to_numpy()
            for part in np.unique(of := batch.column(0).to_numpy()).tolist():
                found.setdefault(part, np.zeros(BITS // PARTS, bool))[bits[of == part]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.packbits(x).tobytes() for x in found.values()], pa.binary())], ["part", "bits"])

    h = bit("one").cast("int")
    rows = ids.select(F.floor(h / (BITS // PARTS)).cast("int").alias("part"), (h % (BITS // PARTS)).alias("bit"))
    out = np.zeros((PARTS, BITS // PARTS // 8), np.uint8)
    for row in rows.repartition("part").mapInArrow(fill, "part int, bits binary").collect():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def whole_sets(df: DataFrame, shared, packed: Callable[[np.ndarray], bytes]) -> DataFrame:
    """sig, members (packed) of the sets of documents whose id's bit is set: of those wanted, and of few others.

    No text moves: all other documents are passed over where they are read. Sets that nobody asked for meet no pair later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            raw, ends = buffers(marked(whole, shared.value))
            for a, b in slices(ends):
                sets, begin = shingle_sets(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a], WIDTH)
                sig, keep = np.unique(signatures(sets, begin), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array([packed(sets[begin[k] : begin[k + 1]]) for k in keep], pa.binary())], ["sig", "members"])

    hashed = df.select("text", bit("doc_id").alias("bit"))
    return hashed.mapInArrow(run, "sig long, members binary")


def wanted(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """ids of the sets that stand in any pair."""
    some = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    return ids.select("sig", "one").join(some, "sig", "left_semi")


def near_enough(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """The suffix filter: pairs whose sketches leave room for enough common members. Pairs of very large sets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keep = pa.array(Sketches([*batch.column("x").to_pylist(), *batch.column("y").to_pylist()]).may_link(np.arange(n), np.arange(n, 2 * n)))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return cut(attached(cut(pairs, "candidates"), ids.select("sig", "sketch")).mapInArrow(run, "a long, b long"), "pairs")


def attached(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with x and y, what `sets` (sig and a value) has of both. Pairs of a set that has many are dealt over tasks."""
    value = next(c for c in sets.columns if c != "sig")
    x, y = (sets.select(F.col("sig").alias(side), F.col(value).alias(name)) for side, name in (("a", "x"), ("b", "y")))
    return hot_join(hot_join(pairs, x, "a"), y, "b", pairs).select("a", "b", "x", "y")


def placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members with their root; a set without a link is its own root."""
    return members.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))


def divided(members: DataFrame) -> DataFrame:
    """h, salted, size, pairs (of different roots) and hub of buckets with more than one root. The hub is the least edited
    member of the most frequent root. Counts are summed before they move."""
    of_root = members.groupBy("h", "root").agg(F.count("*").alias("m"), F.min(F.struct("pos", "n", F.xxhash64("sig").alias("o"), "sig")).alias("best"), F.max("salted").alias("salted"))
    hub = F.min(F.struct((-F.col("m")).alias("m"), "root", "best"))
    out = of_root.groupBy("h").agg(F.max("salted").alias("salted"), F.sum("m").alias("size"), F.sum(F.col("m").cast("double") * F.col("m")).alias("same"), hub.alias("hub"))
    out = out.withColumn("pairs", (F.col("size").cast("double") * F.col("size") - F.col("same")) / 2).filter("pairs > 0")
    return out.select("h", "salted", "size", "pairs", F.col("hub.root").alias("hub_root"), F.col("hub.best").alias("hub"))


def in_buckets(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """members of the buckets, with the buckets' columns; members of frequent shingles by salts."""
    salt = F.when(F.col("salted"), F.pmod(F.xxhash64("sig"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("salted"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return members.withColumn("_salt", salt).join(buckets.withColumn("_salt", F.explode(salts)).drop("salted"), ["h", "_salt"]).drop("_salt")


def toward_largest(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """Pairs of members with the hub of their bucket, if that is of another root."""
    return paired(in_buckets(members, buckets).filter(F.col("root") != F.col("hub_root"))).distinct()


def across(members: DataFrame, buckets: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs of members of a bucket that have different roots and pass the length, positional and suffix filters.

    Members are dealt to blocks, and each block meets each in a cell of bounded size. Only pairs that pass leave a cell.
    """
    rows = in_buckets(members, buckets.select("h", "salted", "size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sig", F.lit(1)), F.col("blocks").cast("long")).cast("int")).join(ids.select("sig", "sketch"), "sig")
    rows = rows.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["h", "i", "j", "second", "sig", "root", "n", "pos", "sketch"]
    rows = rows.select("h", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), (F.col("block") > F.col("to")).alias("second"), "sig", "root", "n", "pos", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def met(cell: pa.Table) -> pa.RecordBatch:
            a, b = met_in_cell(*(cell.column(c).to_numpy() for c in ("i", "j", "second", "sig", "root", "n", "pos")), cell.column("sketch").to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            key = [batch.column(c).to_numpy() for c in ("h", "i", "j")]
            edges = np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1 if batch.num_rows > 1 else np.zeros(0, np.int64)
            last = kept[-1] if kept else None
            if last is not None and batch.num_rows and any(last.column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in ("h", "i", "j")):
                yield met(pa.Table.from_batches(kept))
                kept = []
            cuts = [0, *edges.tolist(), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x:
                    yield met(pa.Table.from_batches(kept))
                    kept = []
                kept.append(batch.slice(x, y - x))
        if kept:
            yield met(pa.Table.from_batches(kept))

    dealt = rows.select(*names).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def met_in_cell(i: np.ndarray, j: np.ndarray, second: np.ndarray, sig: np.ndarray, root: np.ndarray, n: np.ndarray, pos: np.ndarray, sketch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell that pass: of one block with itself, or of one with another. Filters as in possible() and near_enough()."""
    if not len(sig):
        return sig, sig
    n, pos, second = n.astype(np.int64), pos.astype(np.int64), second.astype(bool)
    x, y = np.triu_indices(len(sig), 1) if i[0] == j[0] else (v.ravel() for v in np.meshgrid(np.flatnonzero(~second), np.flatnonzero(second), indexing="ij"))
    fit = (root[x] != root[y]) & (sig[x] != sig[y]) & (np.minimum(n[x], n[y]) * DENOMINATOR >= np.maximum(n[x], n[y]) * NUMERATOR)
    x, y = x[fit], y[fit]
    fit = (1 + np.minimum(n[x] - pos[x] - 1, n[y] - pos[y] - 1)) * (NUMERATOR + DENOMINATOR) >= (n[x] + n[y]) * NUMERATOR
    x, y = x[fit], y[fit]
    fit = Sketches(sketch).may_link(x, y)
    x, y = sig[x[fit]], sig[y[fit]]
    return np.minimum(x, y), np.maximum(x, y)


def code_bits(n: int) -> int:
    """Bits of the codes of a set of n members. Those of larger sets lie 2**13 to 2**14 apart on average."""
    return 32 if n <= SMALL else 13 + (n - 1).bit_length()


def coded(members: np.ndarray) -> bytes:
    """A set's size and the upper bits of its members: 4 bytes each or, of large sets, the steps between them in 2 bytes."""
    n = len(members)
    top = (members >> np.uint64(64 - code_bits(n))).astype(np.int64)
    if n <= SMALL:
        return n.to_bytes(8, "little") + top.astype(np.uint32).tobytes()
    far, rest = np.divmod(np.diff(top, prepend=0), STEP)
    steps = np.full(n + int(far.sum()), STEP, np.uint16)
    steps[np.arange(n) + np.cumsum(far)] = rest
    return n.to_bytes(8, "little") + steps.tobytes()


def codes(data: pa.Buffer | bytes) -> tuple[int, np.ndarray]:
    """Size and codes of a coded set."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    if n <= SMALL:
        return n, np.frombuffer(data, np.uint32, offset=8).astype(np.int64)
    steps = np.frombuffer(data, np.uint16, offset=8).astype(np.int64)
    return n, np.cumsum(steps)[steps != STEP]


def most_false(expected: float) -> int:
    """What a Poisson variable of this mean exceeds with a probability of less than 2**-64 (Chernoff's bound)."""
    k = int(expected) + 1
    while k * (math.log(k / expected) - 1) + expected < 64 * math.log(2):
        k += 1
    return k - 1


def linked_by_codes(x: pa.Buffer | bytes, y: pa.Buffer | bytes) -> bool | None:
    """Whether two coded sets are similar enough; None if their codes leave it open.

    Common codes are never fewer than common members, and more only by chance: by more than most_false() as rarely as two
    shingles have one hash of 64 bits.
    """
    (n, a), (m, b) = codes(x), codes(y)
    low = min(code_bits(n), code_bits(m))
    (u, c), (v, d) = (np.unique(t >> code_bits(k) - low, return_counts=True) for k, t in ((n, a), (m, b)))
    at = np.minimum(np.searchsorted(v, u), v.size - 1)
    common = int(np.minimum(c, d[at])[v[at] == u].sum())
    enough = lambda k: k * (NUMERATOR + DENOMINATOR) >= (n + m) * NUMERATOR
    return None if enough(common) and not enough(common - most_false(n * m / 2**low)) else enough(common)


def linked(x: pa.Buffer | bytes, y: pa.Buffer | bytes) -> bool:
    """Whether two sorted sets are similar enough."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    at = np.minimum(np.searchsorted(b, a), b.size - 1)
    return int((b[at] == a).sum()) * (NUMERATOR + DENOMINATOR) >= (a.size + b.size) * NUMERATOR


def judged(docs: DataFrame, ids: DataFrame, pairs: DataFrame, packed: Callable[[np.ndarray], bytes], judge: Callable[[pa.Buffer, pa.Buffer], bool | None]) -> DataFrame:
    """a, b, sure of the pairs that judge() doesn't deny. Sets are written once, where they are dealt to pairs: both sides read the same shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted(ids, pairs)))
    sets = whole_sets(docs, shared, packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure = pa.array([judge(p.as_buffer(), q.as_buffer()) for p, q in zip(batch.column("x"), batch.column("y"), strict=True)], pa.bool_())
            keep = sure.fill_null(True)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), sure.is_valid().filter(keep)], ["a", "b", "sure"])

    out = cut(attached(pairs, sets.groupBy("sig").agg(F.first("members").alias("members"))).mapInArrow(run, "a long, b long, sure boolean"), "links")
    shared.destroy()
    return out


def verified(docs: DataFrame, ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that are similar: by codes of the members, a quarter or half as long, and by the whole sets where those leave it open."""
    told = judged(docs, ids, pairs, coded, linked_by_codes)
    sure, left = told.filter("sure").select("a", "b"), told.filter("not sure").select("a", "b")
    return sure if left.isEmpty() else sure.unionByName(judged(docs, ids, left, np.ndarray.tobytes, linked).select("a", "b"))


def connected(docs: DataFrame, ids: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """node, root of every set that has a link. found: the first round's pairs."""
    pairs = near_enough(found, ids)
    roots = components(verified(docs, ids, pairs))
    members = remaining(rows)
    joined = lambda more: components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    for k in range(ROUNDS + 1):
        now = placed(members, roots)
        buckets = cut(divided(now), "divided")
        left = buckets.agg(F.sum("pairs").alias("pairs"), F.sum("size").alias("rows")).first()
        if not left["pairs"]:
            return roots
        near = k < ROUNDS and left["pairs"] > DENSE * left["rows"]
        fresh = lambda met: met.join(pairs, ["a", "b"], "left_anti")  # noqa: E731, B023  used at once
        met = near_enough(fresh(toward_largest(now, buckets)), ids) if near else cut(fresh(across(now, buckets, ids)), "pairs")
        more = None if met.isEmpty() else verified(docs, ids, met)
        some = more is not None and not more.isEmpty()
        roots = joined(more) if some else roots
        if not near:
            break
        pairs = pairs.unionByName(met)
        if not some:  # the same hubs would meet again
            met = cut(fresh(across(now, buckets, ids)), "pairs")
            return roots if met.isEmpty() else joined(verified(docs, ids, met))
    return roots


def join(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    both = cut(shingled(docs), "shingled")
    nodes = both.filter(F.col("part").isNull()).select("doc_id", "n", "sig")
    level = levels(both.filter(F.col("part").isNotNull()).select("part", "counts"))
    hot = max(int(np.median(level)) + 4, 10)
    ids = both.filter(F.col("n") > 0).groupBy("sig").agg(F.min("doc_id").alias("one"), F.first("sketch").alias("sketch"))
    ids = cut(ids, "ids")
    shared = spark.sparkContext.broadcast(np.concatenate([level, bitmap(ids)]))
    rows = described(hubs(prefixes(docs, shared, hot), "key"), "key")
    rows = cut(rows.filter(F.col("many") | F.col("salted")).drop("key"), "buckets")
    shared.destroy()
    again = hubs(rows.filter(F.col("salted") & (F.col("sig") == F.col("hub.sig"))).drop("hub", "many", "group", "lead"), "h")
    roots = connected(docs, ids, rows, paired(rows).unionByName(paired(again)).distinct())
    known = ids.select("sig", "one").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    known = cut(known, "known")
    least = known.groupBy("root").agg(F.min("one").alias("component_id"))
    place = hot_join(known.select("sig", "root"), least, "root").select("sig", "component_id")
    out = hot_join(nodes, place, "sig")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
