"""Frontmatter as VARIANT against the same conditions in Python, over simple, odd and broken blocks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import frontmatter
from textloom.plans import build, checks, planner

BLOCKS = [
    "lang: en\ntitle: Doc 1", "lang: en\ntags:\n  - a\n  - b\nn: 3", "n: 3", "n: -3", "n: 03", "n: 3.0", "n: '3'", "draft: true", "draft: True", "draft: 'true'", "x: null", "x: ~", "x:", "x: ", "meta:\n  kind: doc", "meta: {kind: doc}", "a.b: 1",
    "lang: en\nlang: fr", "tags: [a, b]", "# note\nlang: en", "lang: en  ", "lang : en", "lang:en", "- a", "text", ": x", "lang: 'en", "{bad", "true: 1", "when: 2024-01-02", "when: '2024-01-02'", "n: 99999999999999999999", "n: 1e3", "x: .nan", "tags:\n  - a\nlang: en\ntags2:\n  - 1",
    "tags:\n- a", "lang: é", 'lang: "e\\u006e"', "a: b: c", "lang: en # note", "meta:\n  kind:\n    deep: 1", "tags:\n  - true\n  - null", "", "  - a", "x:\n  - ",
]
TEXTS = [f"---\n{b}\n---\nbody" for b in BLOCKS] + [f"--- \n{b}\n---\t\n" for b in BLOCKS[:4]] + ["---\nlang: en\n---", "---\nlang: en", "x\n---\nlang: en\n---\n", "", "---\r\nlang: en\r\n---\r\n", "---\n---\n", "---\n\n---\n"]
VALUES = ["en", "3", 3, 3.0, -3, 1000, True, False, None, "doc", "true", "2024-01-02", "é", 1, "b: c", 99999999999999999999, "null"]
KEYS = ["lang", "n", "draft", "x", "meta", "meta.kind", "meta.kind.deep", "tags", "tags.0", "a.b", "a", "when", "true"]
CONDITIONS = [{"frontmatterExists": k} for k in KEYS] + [{"frontmatterEquals": {"key": k, "value": v}} for k, v in itertools.product(KEYS, VALUES)]


def test_columns_equal_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, content string").repartition(3)
    for name, column in frontmatter.stages(F.col("content")):
        df = df.withColumn(name, column)
    some = [c for c in CONDITIONS if checks.has_column(c)] + [{"not": CONDITIONS[0]}, {"allOf": [CONDITIONS[0], {"fileContains": "body"}]}, {"anyOf": [CONDITIONS[1], CONDITIONS[2]]}]
    assert len(some) > 200 and not checks.has_column({"not": {"frontmatterEquals": {"key": "tags", "value": ["a", "b"]}}})
    df = df.cache()
    for at in range(0, len(some), 60):
        part = some[at : at + 60]
        for r in df.select("i", F.array(*(checks.condition_column(c, F.col("content")) for c in part)).alias("got")).collect():
            assert r["got"] == [checks.holds(c, TEXTS[r["i"]]) for c in part], (TEXTS[r["i"]], [c for c, g in zip(part, r["got"], strict=True) if g != checks.holds(c, TEXTS[r["i"]])])
    hard = df.filter("_yaml IS NOT NULL AND _json IS NULL").count()
    assert 10 < hard < len(TEXTS) - 10


def test_programs_with_frontmatter(spark):
    """Conditions see what patches before them left; rules see what the patch leaves; nulls and extra columns pass."""
    rng = random.Random(8)
    texts = [rng.choice(TEXTS) for _ in range(60)] + [None]
    df = spark.createDataFrame([(str(i), t, "f") for i, t in enumerate(texts)], "path string, content string, front string")
    patches = [
        {"op": "replace", "old": "lang: en", "new": "lang: de", "when": {"frontmatterEquals": {"key": "lang", "value": "en"}}},
        {"op": "append-to-file", "content": "x", "when": {"not": {"frontmatterExists": "lang"}}, "validate": {"frontmatterRequired": ["n", "lang"], "contains": "y"}},
        {"op": "append-to-file", "content": "z", "when": {"frontmatterEquals": {"key": "tags", "value": ["a", "b"]}}},
    ]
    assert [planner.needs_python(p) for p in patches] == [False, False, True]
    for r in build.apply_patches(df, patches).collect():
        want = build.fold(texts[int(r["path"])], r["path"], list(enumerate(patches)), "warn")
        assert (r["content"], r["applied"], r["skipped"], r["warnings"], r["errors"]) == want
    checked = build.build(df, planner.Program([], [], validators=[{"name": "v", "frontmatterRequired": ["lang"]}]))
    for r in checked.collect():
        t = texts[int(r["path"])]
        assert bool(r["errors"]) == (t is not None and bool(checks.failures({"frontmatterRequired": ["lang"]}, t)))


def test_only_odd_blocks_need_python(spark):
    patch = {"op": "append-to-file", "content": "x", "when": {"frontmatterEquals": {"key": "lang", "value": "en"}}}
    df = spark.createDataFrame([("a", "---\nlang: en\ntags:\n  - a\n---\n"), ("b", "none"), ("c", None)], "path string, content string")
    out = build.apply_patches(df, [patch], native_only=True)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(out.select("path", "applied").collect()) == [("a", 1), ("b", 0), ("c", 0)]
    with pytest.raises(Exception, match="needs a YAML parser"):
        build.apply_patches(df.withColumn("content", F.lit("---\n{a: 1}\n---\n")), [patch], native_only=True).collect()


def test_neighbours_that_parse_frontmatter_share_a_worker(spark):
    """One Python step for all of them, with what each leaves alone, as columns, and what all leave in Python."""
    kind = {"frontmatterEquals": {"key": "meta.kind", "value": "doc"}}
    patches = [
        {"op": "set-frontmatter", "key": "meta.kind", "value": "doc", "include": "1*"}, {"op": "append-to-file", "content": "A", "when": kind},
        {"op": "append-to-file", "content": "B", "when": {"not": kind}, "validate": {"frontmatterRequired": ["lang"]}}, {"op": "replace", "old": "body", "new": "C"},
    ]
    assert [(p, len(r)) for p, r in planner.runs(patches)] == [(True, 3), (False, 1)]
    assert [p for p, _ in planner.runs(patches, False)] == [True, False]
    assert [p for p, _ in planner.runs(patches[1:2])] == [False] and [p for p, _ in planner.runs(patches[2:3])] == [True]
    sort = {"op": "sort-list", "list": 0, "when": kind}
    assert [p for p, _ in planner.runs([patches[0], sort, patches[1]])] == [True, False]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate([*TEXTS, None])], "path string, content string")
    out = build.apply_patches(df, patches)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    alone = df
    for p in patches:
        alone = build.apply_patches(alone, [p]).select("path", "content")
    want = {str(i): build.fold(t, str(i), list(enumerate(patches)), "warn") for i, t in enumerate([*TEXTS, None])}
    assert {r["path"]: (r["content"], r["applied"], r["skipped"], r["warnings"], r["errors"]) for r in out.collect()} == want
    assert {r["path"]: r["content"] for r in alone.collect()} == {k: v[0] for k, v in want.items()}
