"""Periodic runs, centroid clustering and embedding near-dedup against brute force, with the edge cases of each."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.conftest import CLASHES, EDGE, prose
from textloom.llm import centroids, neardup, runs

# Runs


def brute(text, least, periods):
    """Every maximal stretch by every period, of equal stretches the smallest."""
    out, n = {}, len(text)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and text[j] == text[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b, q) for (a, b), q in out.items())


def test_all_runs_of_small_alphabets():
    rng = random.Random(1)
    for k in range(1500):
        text = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(60))]
        if k % 3 == 0:  # what repeats again further on is copied from factors
            text = (text[: rng.randrange(1, 20)] * rng.randrange(1, 6) + text)[:90] * rng.randrange(1, 3)
        assert runs.repetitions(text, 2, 2) == brute(text, 2, 2), text
        assert runs.repetitions(text, 6, 3) == brute(text, 6, 3), text


def test_runs_of_structured_words():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(300)]
    for text in (b, thue, [0] * 300, [0, 1] * 150, list(range(50)) * 5, [0] * 40 + [1] + [0] * 40):
        assert runs.repetitions(text, 2, 2) == brute(text, 2, 2)


def test_factors_are_longest_earlier_prefixes():
    rng = random.Random(2)
    for _ in range(200):
        text = [rng.randrange(3) for _ in range(40)]
        at = 0
        for start, stop, place in runs.factors(text):
            assert start == at
            before = max((m for m in range(len(text) - start + 1) if any(text[p : p + m] == text[start : start + m] for p in range(start))), default=0)
            assert stop - start == max(before, 1)
            assert place < 0 and before == 0 or text[place : place + stop - start] == text[start:stop] and place < start
            at = stop
        assert at == len(text)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def expected(doc_id, text):
    words = words_of(text)
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = sorted((a, b - a, q) for a, b, q in brute(words, 24, 3))
    found.sort(key=lambda r: (r[0], r[2]))
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n_, q in found for i in range(s + q, s + n_)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n_},{q}\n" for s, n_, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_documents(make):
    rng = random.Random(3)
    rows = [(i, t) for i, t in EDGE if i < 9] + [(None, "a b c " * 30), (None, None)]
    for i in range(20, 260):
        parts = [prose(rng, rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            parts += [" ".join([prose(rng, rng.randrange(1, 12))] * rng.randrange(1, 9)), prose(rng, rng.randrange(30))]
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    rows += rows[-3:]  # repeated rows
    rows.append((999, "x y " * 20 + "end " + "x y " * 20))  # ties of exponent
    got = [tuple(r) for r in runs.digests(runs.find_runs(runs.planted(make(rows, CLASHES)))).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    want = [expected(i, t) for i, t in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10 and max(r[1] for r in want) > 1
    assert runs.digests(runs.find_runs(runs.planted(make([])))).count() == 0


def test_runs_of_long_texts(make):
    a, b = "a", "a b"
    while len(b) < 200_000:
        a, b = b, f"{b} {a}"
    rng = random.Random(4)
    found = runs.find_runs(make([(1, "x " * 300_000), (2, b), (3, prose(rng, 200_000)), (4, "w" * 3_000_000)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in found[0]["runs"]] == [(0, 300_000, 1)] and found[0]["collapsed"] == "x"
    assert len(found[1]["runs"]) > 1000 and all(r["length"] >= max(24, 3 * r["period"]) for r in found[1]["runs"])
    assert found[2]["runs"] == [] and found[3]["n_words"] == 1


# Centroids


def lloyd(rows, clusters=40, rounds=5):
    use = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            use.append((i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(use, key=key)[:clusters]]
    x = np.array([v for _, v in use], dtype=object)

    def near():
        d = np.stack([((x - np.array(m, dtype=object)) ** 2).sum(1) for m in c], 1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        home, _d = near()
        c = [[int(s) // int((home == k).sum()) for s in x[home == k].sum(0)] if (home == k).any() else m for k, m in enumerate(c)]
    home, d = near()
    out = []
    for (i, _), k, e in zip(use, home, d, strict=True):
        out.append((i, int(k), int(e), int(d[home == k].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()))
    return sorted(out, key=str)


def vectors(spark, rows, extra=()):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.mark.parametrize("kind", ["spread", "ties", "groups", "few", "wide"])
def test_clusters_equal_plain_rounds(spark, kind):
    rng = np.random.default_rng(5)
    n = {"few": 17}.get(kind, 600)
    x = {"spread": rng.normal(size=(n, 64)), "ties": rng.integers(0, 2, (n, 64)) / 256, "groups": rng.normal(size=(8, 64))[rng.integers(0, 8, n)] + rng.normal(size=(n, 64)) * 0.05, "few": rng.normal(size=(n, 64)), "wide": rng.normal(size=(n, 64)) * 50_000}[kind]
    rows = [(i * 7, v.tolist()) for i, v in enumerate(x)]
    rows += [*rows[:5], *[(5001, rows[0][1])] * 40, (None, rows[1][1]), (5002, None), (5003, []), (5004, [1.0] * 63), (5005, [1.0] * 65), (5006, [None] + [1.0] * 63), (5007, [float("nan")] * 64), (5008, [float("inf")] * 64)]
    df = vectors(spark, [(i, v, 1) for i, v in rows], ("x", "number", "n", "sums", "cluster", "h"))
    got = sorted((tuple(r) for r in centroids.digests(centroids.cluster(df)).collect()), key=str)
    assert got == lloyd(rows)


def test_balls_hold_what_a_full_scan_finds():
    rng = np.random.default_rng(6)
    x = rng.integers(-40, 40, (3000, 8))
    c = x[:30].copy()
    number, above, below = centroids.Round(c).nearest(x, np.arange(30))
    scanned = 0
    for _ in range(8):
        after = np.array([x[number == k].sum(0) // max((number == k).sum(), 1) if (number == k).any() else c[k] for k in range(30)])
        plan = centroids.Round(after, c)
        whole = plan.nearest
        plan.nearest = lambda rows, candidates, f=whole: (calls.append(len(rows) * len(candidates)), f(rows, candidates))[1]
        calls = []
        number, above, below = plan.assign(x, number, above, below)
        full = centroids.squared(x, after)
        assert np.array_equal(number, full.argmin(1))
        assert (above**2 >= full.min(1)).all() and (below**2 <= np.sort(full, 1)[:, 1]).all()
        scanned, c = sum(calls), after
    assert scanned < 3000 * 30 / 2


def test_too_large_components_and_no_vectors(spark):
    rows = [(1, [1e30] * 64, 1), (2, [1.0] * 64, 1), (3, [5e5] * 64, 1), (4, [-5e5] * 64, 1)]
    got = {r["vec_id"]: r["distance"] for r in centroids.cluster(vectors(spark, rows)).collect()}
    assert got == {2: 0, 3: 0, 4: 0}
    assert centroids.digests(centroids.cluster(vectors(spark, []))).collect() == []


# Near duplicates


def linked(rows, least=0.93):
    """Brute force: links, smallest id reachable and whether that is the row's own."""
    n = len(rows)
    live = [lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    neighbours = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            if live[i] and live[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b >= least * np.sqrt((a @ a) * (b @ b)):
                    neighbours[i].add(j)
                    neighbours[j].add(i)
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            best = min([root[i], *(root[j] for j in neighbours[i])])
            changed |= best != root[i]
            root[i] = best
    out = []
    for i, (vec, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((vec, len(neighbours[i]), component, vec == component))
    return sorted(out, key=str)


def near_rows(rng, groups=12, most=30, loose=(0.02, 0.05), dims=64, singles=120):
    """Groups of near copies, some tight and some with pairs on both sides of the threshold, and single vectors."""
    rows, i = [], 0
    for g in range(groups):
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        for _ in range(rng.integers(2, most)):
            v = centre + rng.normal(size=dims) * loose[g % len(loose)]
            rows.append((i := i + 3, (v * rng.choice([1, 1, 3])).tolist(), int(g % 3)))
    rows += [(i := i + 3, rng.normal(size=dims).tolist(), int(rng.integers(0, 3))) for _ in range(singles)]
    return rows


ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 64, 1), (9004, [0.0, -0.0] * 32, 1), (9005, [None] + [1.0] * 63, 1), (9006, [float("nan")] * 64, 1), (9007, [float("-inf")] * 64, 1), (9008, [1.0] * 64, None), (9009, [1.0] * 64, None), (9010, [1.0, 2.0], 1), (9011, [2.0, 4.0], 1), (9012, [1e-30] * 64, 2), (9013, [1e30] * 64, 2)]


def check(spark, rows, extra=(), **options):
    got = sorted((tuple(r) for r in neardup.near_duplicates(vectors(spark, rows, extra), **options).collect()), key=str)
    assert got == linked(rows)


def test_near_duplicates_in_one_block(spark):
    rng = np.random.default_rng(7)
    rows = near_rows(rng)
    rows += [*ODD, *rows[:4], *[(7000 + k, rows[9][1], rows[9][2]) for k in range(6)], (None, rows[5][1], rows[5][2]), (None, rng.normal(size=64).tolist(), 1)]
    check(spark, rows, ("h", "h2", "cid", "n", "g", "x", "home", "cell", "least", "links", "root"))


@pytest.mark.parametrize("block", [8, 40, 1024])
def test_near_duplicates_in_many_cells_and_blocks(spark, monkeypatch, block):
    """A border of half the linking distance misses nothing, whatever the blocks; cores aren't compared."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_rows(np.random.default_rng(8), groups=8, most=60, singles=60)
    check(spark, rows, cells=12, border=neardup.exact_border())


def test_chains_and_ties(spark):
    turn = lambda a: [float(np.cos(a)), float(np.sin(a)), 0.0]
    rows = [(k, turn(k * 0.2), 1) for k in range(20)] + [(100, [4.0, 3.0, 0.0], 2), (101, [4.0, 3.0, 0.0], 2)]
    check(spark, rows)
    check(spark, rows, cells=6, border=neardup.exact_border())


def test_recall_at_the_threshold(spark):
    """The default border, on pairs of cosine 0.93 to 0.94 in random directions: at least 0.99 of the links."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1500):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9301, 0.94)
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 1)]
    out = neardup.near_duplicates(vectors(spark, rows), cells=64)
    assert out.filter("n_links = 1 AND component_id IN (vec_id, vec_id - 1)").count() >= 0.99 * len(rows)


def test_a_dense_group_is_counted_not_compared(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 64)
    rng = np.random.default_rng(10)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    rows = [(i, (centre + rng.normal(size=64) * 0.008).tolist(), 1) for i in range(1000)] + [(5000 + i, rng.normal(size=64).tolist(), 1) for i in range(200)]
    dense = neardup.near_duplicates(vectors(spark, rows), cells=8)
    assert dense.filter("vec_id < 1000 AND n_links = 999 AND component_id = 0 AND kept = (vec_id = 0)").count() == 1000
    assert dense.filter("vec_id >= 5000 AND n_links = 0 AND kept").count() == 200


def test_no_vectors(spark):
    assert neardup.near_duplicates(vectors(spark, [])).collect() == []
    assert [tuple(r) for r in neardup.near_duplicates(vectors(spark, [(4, None, 1)])).collect()] == [(4, 0, 4, True)]
