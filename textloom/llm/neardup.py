"""Near duplicates of embeddings: cosine products within the cells of a spherical k-means, one of each group kept.

Equal vectors of a label are one class: copies are counted, never compared. Centroids are fitted on a bounded sample of
the classes (SAMPLE rows at most, by hash); those closer to each other than half the linking angle become one, so that a
dense group has one cell. Each class has the cell of its nearest centroid as home and visits every cell to whose border it
is nearer than `border`; within a label, a cell compares its residents with each other and with its visitors, in blocks of
matrix products of BLOCK rows by BLOCK. A pair that meets in two cells counts in the one with the smaller number. Where
`border` is half the linking distance, `exact_border()`, no pair can be missed; the default leaves pairs near the threshold
a chance of about one in a thousand (measured in the tests), and such closer ones hardly any.

Classes within half the linking angle of their centroid, the core of a cell, are all linked with each other by the triangle
inequality: in cells of more than a block they are counted, not compared, so the copies of one item, however many, cost one
row each. They meet only those residents and visitors that lie within one and a half times the angle. Blocks hold at most
about BLOCK rows a side whatever the size of a cell, a label or a group. A block sends on a row for each linked class with
its count and one edge to the block's smallest class, never pairs; components are joined in the shared folder.

Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing. Vectors of
different lengths are never compared. Scaled vectors have cosine 1 and link. Repeated rows link with each other and count
each, under one id or several; ids may be null: a component's id is the smallest that isn't. Ties at the threshold are
links. An empty table gives an empty result. Other columns pass by whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import SHARE, SPREAD, cut, hot_join, spread_join
from textloom.llm.graph import components

LEAST = 0.93
#: Classes a cell is meant to hold, cells at most, sampled classes a cell, and of all.
PER_CELL, CELLS, PER_CENTROID, SAMPLE = 512, 4096, 32, 1 << 16
BLOCK = 1024
#: A class visits the cells whose border is nearer than this, as a share of exact_border().
BORDER = 0.4
#: Rows that one matrix product of an assignment handles.
ROWS = 512


def exact_border(least: float = LEAST) -> float:
    """Half the greatest distance of linked unit vectors: one of two of them is at least as near to any plane between."""
    return float(np.sqrt(max(2 - 2 * least, 0)) / 2)


def units(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors in double precision of an array column; scaled first, so that no square overflows or vanishes."""
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def fit(x: np.ndarray, cells: int, least: float = LEAST, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of unit vectors, close centroids joined: one row a cell."""
    x = x[np.lexsort(x.T)]
    rng = np.random.default_rng(0)
    c = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))]

    def assigned(c: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[a : a + ROWS] @ c.T).argmax(1) for a in range(0, len(x), ROWS)])

    def means(c: np.ndarray, home: np.ndarray) -> np.ndarray:
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.sqrt((total * total).sum(1))
        return np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)

    for _ in range(rounds):
        home = assigned(c)
        c = means(c, home)
    near = np.cos(np.arccos(least) / 2)
    left = np.ones(len(c), bool)
    for k in np.argsort(-np.bincount(home, minlength=len(c)), kind="stable"):
        if left[k]:
            left &= c @ c[k] < near
            left[k] = True
    c = c[left]
    return means(c, assigned(c))


def placed(classes: DataFrame, centroids: np.ndarray, dims: int, least: float, border: float) -> DataFrame:
    """A row for each cell that a class lives in or visits: label, cell, home, cid, n, angle (to the cell's centroid),
    visits (of a resident) and x."""
    shared = classes.sparkSession.sparkContext.broadcast(centroids)  # CELLS rows at most
    kind = classes.schema["label"].dataType.simpleString()
    element = classes.schema["x"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-30))
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                dots = np.clip(units(batch.column("x"), dims) @ c.T, -1, 1)
                home = dots.argmax(1)
                top = dots[np.arange(len(home)), home]
                near = (top[:, None] - dots) / apart[home] <= border
                near[np.arange(len(home)), home] = True
                row, cell = np.nonzero(near)
                lives = cell == home[row]
                visits: list[list[int] | None] = [None] * len(row)
                for i in np.flatnonzero(lives).tolist():
                    visits[i] = [int(k) for k in np.flatnonzero(near[row[i]]) if k != home[row[i]]]
                take = pa.array(row, pa.int32())
                columns = [batch.column(n).take(take) for n in ("label", "cid", "n", "x")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(cell, pa.int32()), pa.array(home[row], pa.int32()), pa.array(np.arccos(dots[row, cell])), pa.array(visits, pa.list_(pa.int32()))],
                    ["label", "cid", "n", "x", "cell", "home", "angle", "visits"],
                )

    return classes.select("label", "cid", "n", "x").mapInArrow(run, f"label {kind}, cid long, n long, x {element}, cell int, home int, angle double, visits array<int>")


def tasks(rows: DataFrame, least: float) -> DataFrame:
    """Rows with the blocks in which they are compared: side 0 meets side 1, side 2 meets all of its block.

    Cells of one block are one task. In others, residents outside the core (R) meet in pairs of blocks, visitors (V) meet
    them, and the core (C) meets the mantle (M), those of R and V that are near enough. Also `core`: whether the class is
    linked with the whole core uncompared, and that core's count and smallest class.
    """
    theta = float(np.arccos(least))
    lives = F.col("home") == F.col("cell")
    core, mantle = lives & (F.col("angle") <= theta / 2 - 1e-6), F.col("angle") <= 1.5 * theta + 1e-6
    rows = rows.withColumn("g", F.concat_ws(":", F.col("label").cast("string"), F.col("cell").cast("string"))).withColumn("core", core).withColumn("mantle", mantle & ~core)
    blocks = lambda c: F.ceil(F.sum(F.when(c, 1).otherwise(0)) / BLOCK).cast("int")
    counts = rows.groupBy("g").agg(
        F.count("*").alias("total"), blocks(F.col("core")).alias("nc"), blocks(lives & ~F.col("core")).alias("nr"), blocks(~lives).alias("nv"), blocks(F.col("mantle")).alias("nm"),
        F.sum(F.when(F.col("core"), F.col("n"))).alias("core_n"), F.min(F.when(F.col("core"), F.col("cid"))).alias("core_cid"),
    )
    known = hot_join(rows, cut(counts, "counts"), "g")
    of = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda task, i, j, side: F.struct(F.lit(task).alias("task"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    zero = F.lit(0)
    pairs = F.transform(upto("nr"), lambda j: at("R", F.least(j, of("nr")), F.greatest(j, of("nr")), F.when(j == of("nr"), 2).when(j > of("nr"), 0).otherwise(1)))
    guests = F.transform(upto("nv"), lambda j: at("V", of("nr"), j, zero))
    hosts = F.transform(upto("nr"), lambda i: at("V", i, of("nv"), F.lit(1)))
    inner = F.transform(upto("nm"), lambda j: at("C", of("nc"), j, zero))
    outer = F.when(F.col("mantle"), F.transform(upto("nc"), lambda i: at("C", i, of("nm"), F.lit(1)))).otherwise(F.array().cast("array<struct<task:string,i:int,j:int,side:int>>"))
    where = F.when(F.col("total") <= BLOCK, F.array(at("A", zero, zero, F.lit(2)))).when(F.col("core"), inner).when(lives, F.concat(pairs, guests, outer)).otherwise(F.concat(hosts, outer))
    return known.withColumn("in", where).withColumn("core", F.col("core") & (F.col("total") > BLOCK))


def compared(side: np.ndarray, home: np.ndarray, cell: int, visits: list[list[int] | None], x: np.ndarray, n: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows linked with each row of a block, and the least row of its group in the block."""
    same = bool((side == 2).all())
    left, right = (np.arange(len(side)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    found = x[left] @ x[right].T >= least
    if same:
        np.fill_diagonal(found, False)
    lives = home == cell
    # a resident and a visitor that meet in the visitor's home too count where the number is smaller
    found &= lives[left][:, None] | lives[right][None, :]
    for other in np.unique(home[~lives]).tolist():
        if other < cell:
            there = np.array([v is not None and other in v for v in visits])
            guest = home == other
            found &= ~(there[left][:, None] & guest[right][None, :]) & ~(guest[left][:, None] & there[right][None, :])
    links = np.zeros(len(side), np.int64)
    np.add.at(links, left, found @ n[right])
    if not same:
        np.add.at(links, right, n[left] @ found)
    group = np.arange(len(side))
    while True:
        before = group.copy()
        for p, q, m in ((left, right, found), (right, left, found.T)):
            some = m.any(1)
            least_ = np.where(m[some], group[q][None, :], len(side)).min(1, initial=len(side))
            np.minimum.at(group, p[some], least_)
        group = group[group]
        if np.array_equal(group, before):
            return links, group


def links(rows: DataFrame, dims: int, least: float) -> DataFrame:
    """cid, links (rows linked), other (a class of the same component)."""
    known = tasks(cut(rows, "cells"), least)
    dealt = known.select("g", "cell", "home", "cid", "n", "visits", "x", F.explode("in").alias("in")).select("*", "in.*").drop("in")

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks()
        x = units(batch.column("x").chunk(0), dims)
        cid, n = batch.column("cid").to_numpy(), batch.column("n").to_numpy()
        order = np.argsort(cid, kind="stable")
        batch, x, cid, n = batch.take(pa.array(order)), x[order], cid[order], n[order]
        got, group = compared(batch.column("side").to_numpy(), batch.column("home").to_numpy(), batch.column("cell")[0].as_py(), batch.column("visits").to_pylist(), x, n, least)
        some = got > 0
        return pa.table({"cid": cid[some], "links": got[some], "other": cid[group[some]]})

    out = dealt.groupBy("g", "task", "i", "j").applyInArrow(run, "cid long, links long, other long")
    inner = known.filter("core").select("cid", (F.col("core_n") - F.col("n")).alias("links"), F.col("core_cid").alias("other")).filter("links > 0")
    return out.unionByName(inner)


def usable(embedding: Column) -> Column:
    """Whether a vector can link: some component isn't zero, none is null or non-finite."""
    x = embedding.cast("array<double>")
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))


def near_duplicates(df: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST, border: float | None = None, cells: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row. border: see exact_border(); cells: how many, by default as many as rows ask for."""
    if df.schema[embedding].dataType.simpleString() not in ("array<float>", "array<double>"):
        df = df.withColumn(embedding, F.col(embedding).cast("array<double>"))
    border = BORDER * exact_border(least) if border is None else border
    x = F.transform(F.col(embedding), lambda v: F.when(v == 0, F.lit(0).cast(df.schema[embedding].dataType.elementType)).otherwise(v))  # one zero
    live = F.col(label).isNotNull() & usable(F.col(embedding))
    rows = df.select(F.col(vec_id).alias("vec_id"), F.when(live, F.col(label)).alias("label"), F.when(live, x).alias("x"))
    key = [F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(k), "label", "x")) for k in (1, 2)]
    rows = rows.withColumn("h", key[0]).withColumn("h2", key[1])
    classes = rows.filter("x IS NOT NULL").groupBy("label", "x").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("h").alias("h"), F.first("h2").alias("h2"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # written once: the numbers stay
    found = None
    for dims, n in sorted((r["d"], r["n"]) for r in classes.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()):
        own = classes.filter(F.size("x") == dims)
        k = min(max(-(-n // PER_CELL), 1), CELLS) if cells is None else cells
        share = min(PER_CENTROID * k, SAMPLE) / n
        sample = own if share >= 1 else own.filter(F.pmod(F.col("h2"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        picked = sample.select("x").limit(2 * SAMPLE).toArrow().column("x").combine_chunks()
        picked = picked.chunk(0) if isinstance(picked, pa.ChunkedArray) else picked
        at = placed(own, fit(units(picked, dims), k, least) if len(picked) else np.eye(1, dims), dims, least, border)
        now = links(at, dims, least)
        found = now if found is None else found.unionByName(now)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found, "links")
    counted = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = cut(components(found.select(F.col("cid").alias("a"), F.col("other").alias("b")).filter("a <> b")), "components")
    known = classes.drop("x").join(counted, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    known = cut(known, "known")
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = cut(hot_join(known, smallest, "root"), "rooted")
    most = max((known.agg(F.sum("n")).first()[0] or 0) // SHARE, SPREAD * SPREAD)
    often = [r[0] for r in known.filter(F.col("n") > most).select("h").distinct().collect()]  # fewer than SHARE
    table = known.select("h", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = spread_join(rows.select("vec_id", "h", "h2"), table, ["h", "h2"], often, "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
