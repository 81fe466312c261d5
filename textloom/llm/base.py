"""What the operators of this subpackage share: shared-folder cuts, Arrow text buffers, word and shingle hashes.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D; upper case A-Z is folded, nothing else.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, as a 256-entry table.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, as a byte table.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Java pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass handles; longer documents make a pass of their own.
PASS_BYTES = 1 << 19
#: Rows of an Arrow batch while a cut is written: what a worker holds at once doesn't follow the size of its partition.
ARROW_ROWS = 2000
#: A key of more than one row in so many is dealt over SPREAD tasks; so there are at most SHARE such keys.
SHARE, SPREAD = 1000, 64

_folders: dict[str, SparkSession] = {}
#: The C library's malloc_trim, where there is one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset and all runs in one process, as in tests, a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that was registered, or any other, if it is there."""
    _folders.pop(path, None)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def registered(spark: SparkSession, path: str) -> str:
    """path, which is deleted when the process ends."""
    _folders[path] = spark
    return path


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Cuts made inside are deleted at the end: what was computed from them must have been written by then."""
    before = set(_folders)
    yield
    for path in set(_folders) - before:
        delete(_folders[path], path)


def _clean() -> None:
    for path, spark in list(_folders.items()):
        with contextlib.suppress(Exception):  # the session may have ended before
            delete(spark, path)


atexit.register(_clean)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = registered(spark, f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}")
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(ARROW_ROWS, int(rows) if int(rows) > 0 else ARROW_ROWS)))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return spark.read.schema(df.schema).parquet(path)


def frequent(counted: DataFrame, key: str, least: int = 0) -> list:
    """The keys of more than one in SHARE of the rows, and of more than `least`: SHARE values at most."""
    least = max(counted.count() // SHARE, SPREAD * SPREAD, least)
    return [r[0] for r in counted.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > least) & F.col(key).isNotNull()).select(key).collect()]


def hot_join(rows: DataFrame, table: DataFrame, key: str, counted: DataFrame | None = None) -> DataFrame:
    """rows with the columns of `table`, which has at most one row a key; null keys and those that it lacks get nulls.

    Frequent keys are found first. `counted`: a table, cheaper to read, that has each key as often as rows.
    """
    return spread_join(rows, table, [key], frequent(rows if counted is None else counted, key), "left")


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], often: list, how: str) -> DataFrame:
    """A join whose rows with frequent values of the first key are dealt over SPREAD tasks, to each of which the table's
    rows of that value go."""
    if not often:
        return rows.join(table, keys, how)
    hot = F.col(keys[0]).isin(often)
    left = rows.withColumn("_salt", F.when(hot, F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")).otherwise(0))
    right = table.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return column.fill_null("").to_pylist()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column, null as empty; no copy of the bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(ends: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about `limit` bytes, at least one document each. After the last, freed memory is given back."""
    at, n = 0, len(ends) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, to
        at = to
    give_back()


def give_back() -> None:
    """Hand freed memory to the system: workers outlive their tasks, and one that waits should hold no more than it must."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of an odd number modulo 2**64; kept for short words only."""
    global _powers
    if len(_powers) >= n:
        return _powers
    out = np.full(max(n, 256), 0x9E3779B97F4A7C15 | 1, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if len(out) <= 4096:
        _powers = out
    return out


def word_bounds(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each document (one more entry than documents)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    body = ~SPACE[raw]
    begins, stops = body.copy(), body.copy()
    begins[1:] &= ~body[:-1]
    stops[:-1] &= ~body[1:]
    inner = ends[(ends > 0) & (ends < len(raw))]
    begins[inner] = body[inner]
    stops[inner - 1] = body[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, ends)


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the spans, which are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = stops - starts
    total = int(size.sum())
    first = np.cumsum(size) - size
    if total == 0:
        return mix(np.zeros(len(starts), np.uint64))
    within = np.arange(total, dtype=np.int64) - np.repeat(first, size)
    value = raw[np.repeat(starts, size) + within].astype(np.uint64)
    value += np.uint64(1)
    value *= powers(int(size.max()))[within]
    full = size > 0
    out = np.zeros(len(starts), np.uint64)
    out[full] = np.add.reduceat(value, first[full])
    return mix(out + size.astype(np.uint64))


def shingle_sets(raw: np.ndarray, ends: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document, laid end to end, and their offsets.

    A document with fewer than `width` words has one shingle of all of them; without words it has none.
    """
    raw = FOLD[raw]
    starts, stops, first = word_bounds(raw, ends)
    words = span_hashes(raw, starts, stops)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(int(count.sum()), dtype=np.int64) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    span = np.minimum(n, width)[owner]
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        here = span > k
        if here.all():
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
        else:
            out[here] = mix(out[here] * np.uint64(0x9E3779B97F4A7C15) + words[at[here] + k])
    edges = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    if len(out):
        keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[keep], np.searchsorted(owner[keep], np.arange(len(n) + 1))
