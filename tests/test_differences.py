"""Longest common subsequences, unified diffs, least moves, and the similarity join, against brute force."""

import itertools
import random

import pytest

from textloom.functions import diff
from textloom.functions.values import similar_strings
from textloom.plans import preview, recover, stores, suggest


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t


def test_longest_common_subsequences():
    rng = random.Random(0)
    for k in range(1500):
        a, b = ([rng.randrange(rng.choice([2, 4, 30])) for _ in range(rng.randrange(14 if k % 50 else 200))] for _ in "ab")
        pairs, best = diff.common(a, b), table(a, b)[-1][-1]
        assert len(pairs) == best and all(a[i] == b[j] for i, j in pairs)
        assert all(x < y and u < v for (x, u), (y, v) in itertools.pairwise(pairs))
        assert diff.distance(a, b) == len(a) + len(b) - 2 * best
        codes = diff.opcodes(a, b)
        assert [x for _, i, j, _, _ in codes for x in a[i:j]] == a and [y for _, _, _, i, j in codes for y in b[i:j]] == b


def test_diffs_make_the_target():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([str(rng.randrange(5)) for _ in range(rng.randrange(30))] for _ in "ab")
        text = diff.unified(a, b, "p", rng.randrange(4))
        assert diff.applied(a, text) == b and (text == "") == (a == b)
        assert sum(x[:1] in "+-" for x in text.split("\n")[2:] if x) == diff.distance(a, b)
    lines = [str(k) for k in range(12)]
    assert diff.unified(lines, [*lines[:2], "x", *lines[3:9], "y", *lines[9:]], "f").split("\n") == ["--- a/f", "+++ b/f", "@@ -1,12 +1,13 @@", " 0", " 1", "-2", "+x", *(f" {k}" for k in range(3, 9)), "+y", " 9", " 10", " 11"]
    assert diff.unified(lines, ["x", *lines[1:8], "z", *lines[9:]], "f").count("@@ -") == 2  # seven equal lines part two hunks
    with pytest.raises(ValueError, match="line 3"):
        diff.applied(["0", "1", "z"], diff.unified(lines, lines[:2], "f"))


def test_long_sequences():
    rng = random.Random(2)
    a = [str(rng.randrange(5000)) for _ in range(20_000)]
    b = [x for x in a if rng.random() > 0.01]
    assert len(diff.common(a, b)) == len(b)
    x, y = ("".join(rng.choice("ab c") for _ in range(8000)) for _ in "xy")
    parts = preview.char_changes(x, y)
    assert "".join(t for k, t in parts if k != "added") == x and "".join(t for k, t in parts if k != "removed") == y
    assert sum(len(t) for k, t in parts if k == "equal") > 5000


def test_diff_of_missing_texts():
    assert stores.unified(None, "a\nb", "p") == "--- a/p\n+++ b/p\n@@ -0,0 +1,2 @@\n+a\n+b"
    assert stores.patched(None, stores.unified(None, "a\n", "p")) == "a\n" and stores.patched("a\n", stores.unified("a\n", None, "p")) is None


def test_fewest_moves_of_every_order():
    for n in range(1, 8):
        for order in itertools.permutations(range(n)):
            longest = lambda ok: max(len(s) for r in range(n + 1) for s in itertools.combinations(order, r) if list(s) == sorted(s) and ok(s))
            assert len(diff.increasing(order)) == longest(lambda s: True)
            now = list(range(n))
            moves = diff.moves(now, order)
            for x, behind in moves:
                now.remove(x)
                now.insert(now.index(behind) + 1, x)
            assert tuple(now) == order
            assert len(moves) == n - longest(lambda s: s[:1] == order[:1])


def test_moved_sections_are_suggested():
    rng = random.Random(3)
    for _ in range(60):
        names = [f"s{k}" for k in range(10)]
        inner = {x: rng.randrange(3) for x in names}
        text = lambda order, inner=inner: "# Top\n" + "".join(f"\n## {x}\n\nof {x}\n" + "".join(f"\n### {x}-{k}\n\nbelow\n" for k in range(inner[x])) for x in order)
        order = rng.sample(names, 10)
        found = [p for p, _ in suggest.suggest(text(names), text(order))]
        assert {p["op"] for p in found} <= {"move-section"} and suggest.check(text(names), text(order), found) == 1
        assert len(found) == len(diff.moves(names, order))


def slips(rng, word, n):
    for _ in range(n):
        k = rng.randrange(len(word) + 1)
        word = rng.choice([word[:k] + rng.choice("abcdeX ") + word[k:], word[:k] + word[k + 1 :], word[:k] + rng.choice("abcdeX ") + word[k + 1 :]])
    return word


@pytest.mark.parametrize("top", [1, 3])
def test_similarity_join_equals_brute_force(spark, top):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeABDÉé") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 10, 11, 13, 16, 20, 21, 26, 34]))) for _ in range(150)]
    words += [slips(rng, w, rng.randrange(8)) for w in words] + ["İstanbul", "i̇stanbul", "ΟΔΟΣ", "οδος", "οδοσ", "STRASSE", "straße", "😀😀", "😀", ""]
    targets = [slips(rng, w, rng.randrange(4)) for w in words[::3]] + words[::5]
    df = lambda values, name: spark.createDataFrame([(x,) for x in [*values, None]], f"{name} string")
    got = sorted(tuple(r) for r in recover.nearest(df(targets, "target"), df([*words, *words[:9]], "value"), top).collect())
    assert got == sorted((t, v, d) for t in set(targets) for v, d, _ in similar_strings(t, words, top))


def test_similarity_join_by_key(spark):
    targets = spark.createDataFrame([("p", "sumary"), ("q", "sumary"), ("q", "dta")], "path string, target string")
    found = spark.createDataFrame([("p", "summary"), ("p", "detail"), ("q", "data"), ("q", "Data"), ("q", "links")], "path string, value string")
    assert sorted(tuple(r) for r in recover.nearest(targets, found, 5, "path").collect()) == [("p", "sumary", "summary", 1), ("q", "dta", "Data", 1), ("q", "dta", "data", 1)]


def test_signatures_that_a_keys_targets_lack_stay_in_their_row(spark):
    from pyspark.sql import functions as F

    targets = spark.createDataFrame([(k, 7) for k in range(20)], "path long, _sig long")
    found = spark.createDataFrame([(k, "x", [7, *range(1000 * k, 1000 * k + 40)]) for k in range(40)], "path long, value string, sigs array<long>")
    some, c = recover.with_words(targets, found, ["path"], F.col("sigs"))
    got = some.select("path", c.alias("sigs")).collect()
    assert len(got) == 20 and all(7 in r["sigs"] for r in got) and sum(len(r["sigs"]) for r in got) < 60


def test_similarity_join_grows_with_its_input(spark):
    """No nested loops, no join by length, and hardly more pairs a target in a table ten times as large."""
    from pyspark.sql import functions as F

    def pairs(n):
        words = spark.range(n).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 14).alias("value"))
        left = words.select(F.concat(F.lit("x"), F.expr("substring(value, 2, 30)")).alias("target"))
        return recover._pairs(left, words, [], ring=True)

    plan = pairs(100)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    small, large = (pairs(n).count() for n in (300, 3000))
    assert small >= 250 and large <= 12 * small
