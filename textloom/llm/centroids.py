"""Centroid clustering: exact rounds of nearest centroids on integer vectors by exponion search.

Each vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to any other. When
centroids move, bounds widen by how far; a vector whose upper bound stays below the lower one, or below half the distance
from its centroid to the next, cannot have changed. All others scan only centroids inside a ball around their current one,
of twice the upper bound and the distance to its next neighbour, from a list of centroids sorted by distance. The radius is
inclusive, bounds are rounded outwards and skips need a strict inequality, so ties are seen and go to the smaller number.
Distances are exact integers.

A round is one pass: state in, state out, written to the shared folder, which the next pass reads; a lost executor costs
its tasks alone. Sums of clusters are accumulated by task and come to the driver as one row a cluster. Nothing is shuffled
but those, so neither a frequent vector nor a large cluster burdens a task.

Vectors are kept that have exactly `dims` components, none null or non-finite, and whose scaled components stay below LIMIT,
beyond which a squared distance is no long; others are left out. Components are floor(scale * x) of x as a double. Null ids
hash last and are kept; of equal hashes the smaller vector goes first. With fewer vectors than centroids each is one; an
empty table gives an empty result; repeated rows count each. Other columns play no part and can have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import ARROW_ROWS, delete, registered, shared_dir

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Scaled components are smaller than this: squared distances of 64 components are below 2**62.
LIMIT = 1 << 27
#: Values below this have distances that doubles hold exactly.
SMALL = 1 << 22
#: Bounds are rounded outwards by this share.
SLACK = 1e-9


def kept(df: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, x: the vectors that take part, as integers."""
    whole = F.transform(F.col(embedding).cast("array<double>"), lambda v: F.floor(v * scale))
    scaled = F.forall(F.col(embedding).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < LIMIT))
    return df.filter(F.col(embedding).isNotNull() & (F.size(embedding) == dims) & scaled).select(F.col(vec_id).alias("vec_id"), whole.cast("array<int>").alias("x"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest salted hashes, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("x", key.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    if max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))) < SMALL:
        cross = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        cross = x @ c.T
    return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * cross


class Round:
    """What a pass needs of its centroids: sorted lists of distances between them, and how far each came from the last."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None) -> None:
        self.now, k = now, len(now)
        between = np.sqrt(squared(now, now).astype(np.float64))
        np.fill_diagonal(between, -1)  # each is the first of its own list
        self.order = np.argsort(between, axis=1, kind="stable")
        np.fill_diagonal(between, 0)
        self.sorted = np.take_along_axis(between, self.order, 1)
        self.next = self.sorted[:, 1] if k > 1 else np.full(k, np.inf)
        self.moved = np.sqrt(((now - before) ** 2).sum(1).astype(np.float64)) * (1 + SLACK) if before is not None else None
        if before is not None:  # for each, the farthest that any other came
            far = np.argsort(-self.moved, kind="stable")
            self.others = np.where(np.arange(k) == far[0], self.moved[far[1]] if k > 1 else 0.0, self.moved[far[0]])

    def nearest(self, x: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, bound above and bound below of rows against those candidates: the least number of the nearest, its distance, the next one's."""
        found = squared(x, self.now[candidates])
        least = found.min(1)
        number = np.where(found == least[:, None], candidates, len(self.now)).min(1)
        if len(candidates) == 1:
            return number, np.sqrt(least) * (1 + SLACK), np.full(len(x), np.inf)
        second = np.partition(found, 1, axis=1)[:, 1]
        return number, np.sqrt(least) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)

    def own(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        return ((x - self.now[number]) ** 2).sum(1)

    def assign(self, x: np.ndarray, number: np.ndarray, above: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and bounds after the centroids moved, from those before."""
        number = number.copy()
        above, below = above + self.moved[number], np.maximum(below - self.others[number], 0)
        bar = np.maximum(below, self.next[number] / 2 * (1 - SLACK))
        unsure = np.flatnonzero(above >= bar)
        above[unsure] = np.sqrt(self.own(x[unsure], number[unsure])) * (1 + SLACK)
        unsure = unsure[above[unsure] >= bar[unsure]]
        radius = (2 * above[unsure] + self.next[number[unsure]]) * (1 + SLACK)
        held = number[unsure]
        for a in np.unique(held):
            rows = np.flatnonzero(held == a)
            inside = np.searchsorted(self.sorted[a], radius[rows], "right")
            # balls of like size are scanned together: those of up to 1, 2, 4, 8 .. centroids
            size = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 1))).astype(np.int64), len(self.now))
            for n in np.unique(size):
                at = unsure[rows[size == n]]
                number[at], above[at], below[at] = self.nearest(x[at], self.order[a, :n])
        return number, above, below


STATE = "vec_id {}, x binary, number int, above double, below double, distance long, n long, sums array<long>"


def passed(state: DataFrame, kind: str, plan: Round, first: bool) -> DataFrame:
    """State after a round, and for each task one row a cluster with its count and sums (without a vector)."""
    shared = state.sparkSession.sparkContext.broadcast(plan)
    k, dims = plan.now.shape
    schema = pa.schema([("number", pa.int32()), ("above", pa.float64()), ("below", pa.float64()), ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        sums, counts, ids = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), None

        def packed(ids: pa.Array, x: pa.Array, *columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, x, *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], ["vec_id", "x", *schema.names])

        for batch in batches:
            ids = batch.column(0)
            if first:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
                number, above, below = plan.nearest(x, np.arange(k))
                data = pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary())
            else:
                data = batch.column(1)
                x = np.frombuffer(b"".join(data.to_pylist()), "<i4").astype(np.int64).reshape(-1, dims)
                number, above, below = plan.assign(x, batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy())
            np.add.at(sums, number, x)
            counts += np.bincount(number, minlength=k)
            yield packed(ids, data, number, above, below, plan.own(x, number), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), schema.field("sums").type))
        if ids is not None:
            none = pa.nulls(k, pa.float64())
            yield packed(pa.nulls(k, ids.type), pa.nulls(k, pa.binary()), np.arange(k, dtype=np.int32), none, none, pa.nulls(k, pa.int64()), counts, sums.tolist())

    columns = ["vec_id", "x"] if first else ["vec_id", "x", "number", "above", "below"]
    return (state if first else state.filter("x IS NOT NULL")).select(*columns).mapInArrow(run, STATE.format(kind))


def moved(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """Exact floored means of the clusters; one without vectors stays."""
    out = now.copy()
    total = lambda i: F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}")
    for r in state.filter("sums IS NOT NULL").groupBy("number").agg(F.sum("n").alias("n"), *(total(i) for i in range(now.shape[1]))).collect():
        if r["n"]:
            out[r["number"]] = [int(r[f"s{i}"]) // r["n"] for i in range(now.shape[1])]
    return out


def cluster(df: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid (its components) of every vector that is kept."""
    spark = df.sparkSession
    state = kept(df, vec_id=vec_id, embedding=embedding, dims=dims, scale=scale)
    kind = state.schema["vec_id"].dataType.simpleString()
    now = first_centroids(state, clusters, seed)
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not len(now):
        return spark.createDataFrame([], schema)
    plan, before = Round(now), None
    for k in range(rounds + 1):
        path = registered(spark, f"{shared_dir(spark)}/textloom-centroids-{uuid.uuid4().hex}")
        rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        try:
            out = passed(state, kind, plan, first=k == 0)
            out.write.parquet(path)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        state = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
        if k < rounds:
            after = moved(state, plan.now)
            plan = Round(after, plan.now)
    members = state.filter("x IS NOT NULL")
    sums = {r["number"]: int(r["d"]) for r in members.groupBy("number").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    table = spark.createDataFrame([(i, d, sum(sums.values()), plan.now[i].tolist()) for i, d in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    chosen = members.select("vec_id", F.col("number").alias("cluster"), "distance")
    return chosen.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # a row a centroid


def digests(found: DataFrame) -> DataFrame:
    """The clusters with a digest for each centroid."""
    told = F.sha2(F.array_join(F.transform("centroid", lambda v: v.cast("string")), ","), 256)
    return found.withColumn("centroid_sha256", told).drop("centroid")
