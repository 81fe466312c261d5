"""Tables, lists and tables of contents as columns against their Python forms, on random documents."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import md, native
from textloom.plans import build

WORDS = ["a", "b", "Zeta", "zeta", "10", "9", "2.5x", "-1", "", "a b", "é", "Éa", "_u", "x|y"]
SPACES = ["", " ", "  ", "\t", " ", "　", "\x1f"]


def table_lines(rng):
    width = rng.choice([1, 2, 2, 3])
    row = lambda n: rng.choice(SPACES) + "|" + "|".join(f"{rng.choice(SPACES)}{rng.choice(WORDS)}{rng.choice(SPACES)}" for _ in range(n)) + "|" + rng.choice(SPACES)
    head = "| " + " | ".join(["k", "v", "w"][:width]) + " |"
    rule = "|" + "|".join(rng.choice([" --- ", ":--", "--: ", " :-: ", "-"]) for _ in range(width + (rng.random() < 0.1))) + "|"
    return [head, rule, *(row(width if rng.random() < 0.95 else width + 1) for _ in range(rng.randrange(6)))]


def list_lines(rng):
    marks = ["- ", "* ", "+ "] if rng.random() < 0.7 else ["1. ", "12. "]
    out = []
    for _ in range(rng.randrange(1, 6)):
        out.append(rng.choice(marks) + rng.choice(["", "", "[ ] ", "[x] ", "[X] ", "[y] "]) + rng.choice(WORDS))
        if rng.random() < 0.3:
            out.append(rng.choice(["  more", "- ", "1. one", "   - nested", "text"]))
    return out


def document(rng):
    lines = []
    for _ in range(rng.randrange(7)):
        lines += rng.choice([lambda: ["# Top", ""], lambda: ["## Data", ""], lambda: ["### Deep {#deep}"], lambda: ["## Links"], lambda: [""], lambda: ["text", ""], lambda: ["| k | v |"], lambda: table_lines(rng), lambda: table_lines(rng), lambda: list_lines(rng), lambda: list_lines(rng), lambda: ["<!-- TOC -->", "old", "<!-- /TOC -->"], lambda: ["　"]])()
        if rng.random() < 0.5:
            lines.append("")
    return rng.choice(["\n", "\n", "\n", "\r\n"]).join(lines)


AT = [0, 3, 9, "data", "deep"]
PATCHES = [
    *({"op": "replace-table-cell", "row": r, "column": c, "content": "N|"} for r in (0, 2, {"column": "k", "value": "a"}, {"column": "none", "value": "a"}) for c in (0, 1, "v", "none")),
    *({"op": "add-table-row", "values": v, **p} for v in ([], ["n"], ["n", 1, "o", "p"]) for p in ({}, {"position": 0}, {"position": 2}, {"position": -1})),
    *({"op": "remove-table-row", "row": r} for r in (0, 1, 7, {"column": 0, "value": "b"})),
    *({"op": "add-table-column", "header": "new", **p} for p in ({}, {"position": 0, "defaultValue": "-"}, {"position": 9})),
    *({"op": "remove-table-column", "column": c} for c in (0, "v", 5)),
    {"op": "rename-table-column", "column": "k", "new": "key"},
    *({"op": "reorder-table-columns", "columns": c} for c in (["v", "k"], [0], [1, 0], ["w", 0, 1], [])),
    *({"op": "sort-table", "column": c, "type": t, "direction": d} for c in (0, "v") for t in ("string", "number") for d in ("asc", "desc")),
    *({"op": "filter-table-rows", "column": "k", **f} for f in ({"match": "a"}, {"match": "a", "invert": True}, {"pattern": "^[a-z]"}, {})),
    *({"op": "deduplicate-table-rows", **f} for f in ({}, {"keep": "last"}, {"column": "k"}, {"column": 1, "keep": "last"}, {"column": "none"})),
    *({"op": "add-list-item", "item": "new", **p} for p in ({}, {"position": 0}, {"position": 1}, {"position": 99})),
    *({"op": "remove-list-item", "item": i} for i in (0, 2, "a", "none")),
    *({"op": "set-list-item", "item": i, "new": "set"} for i in (0, "b", "none")),
    *({"op": "sort-list", "type": t, "direction": d} for t in ("string", "number") for d in ("asc", "desc")),
    *({"op": "filter-list-items", **f} for f in ({"match": "a"}, {"match": "a", "invert": True}, {"pattern": "e"})),
    *({"op": "deduplicate-list-items", "keep": k} for k in ("first", "last")),
    *({"op": "reorder-list-items", "order": o} for o in ([1, 0], [0], ["b", "a"], [2, 0, 1])),
]
TOC = [{"op": "update-toc"}, {"op": "update-toc", "ordered": True, "minLevel": 1, "maxLevel": 6, "indent": "\t"}, {"op": "update-toc", "marker": "TOC", "endMarker": "/TOC"}]


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(6)
    texts = [document(rng) for _ in range(220)] + ["", "\n", "- a", "| k |\n|-|\n| b |", "| k |\n|-|"]
    return texts, spark.createDataFrame(list(enumerate(texts)), "i int, content string").repartition(4).cache()


@pytest.mark.parametrize("part", range(6))
def test_columns_equal_python(spark, documents, part):
    texts, df = documents
    rng = random.Random(7 + part)
    for patch in [*PATCHES, *TOC][part::6]:
        which = {} if patch["op"] == "update-toc" else {"list" if "list" in patch["op"] else "table": rng.choice(AT)}
        staged, marked = native.staged(df, patch | which)
        text, n = native.build(marked, F.col("content"))
        got = {r["i"]: (r["t"], r["n"]) for r in staged.select("i", text.alias("t"), n.alias("n")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == md.apply(t, patch | which), (patch | which, t)


def test_programs_stay_in_the_jvm(spark, documents):
    """Several blocks one after the other, null contents, extra columns; only sorting by dates leaves the JVM."""
    texts, df = documents
    program = [{"op": "sort-table", "table": "data", "column": 0}, {"op": "deduplicate-list-items", "list": 0}, {"op": "update-toc"}, {"op": "add-list-item", "list": "data", "item": "x", "include": "1*"}]
    rows = df.select(F.col("i").cast("string").alias("path"), "content", F.lit(1).alias("_cells"), F.lit(2).alias("n")).drop("_cells").unionByName(spark.createDataFrame([("none", None, 1)], "path string, content string, n int"))
    out = build.apply_patches(rows, program, native_only=True).collect()
    for r in out:
        if r["path"] == "none":
            assert r["content"] is None and r["applied"] == 0
        else:
            assert (r["content"], r["applied"], r["warnings"]) == tuple(build.fold(texts[int(r["path"])], r["path"], list(enumerate(program)), "warn")[k] for k in (0, 1, 3))
    with pytest.raises(ValueError, match="no native form: sort-table"):
        build.apply_patches(rows, [{"op": "sort-table", "table": 0, "column": 0, "type": "date"}], native_only=True)


def test_sort_by_locale(spark):
    import duckdb

    words = ["zebra", "Zebra", "äpfel", "apfel", "Apfel", "éa", "ea", "Eb", "_x", "-y", "$5", "5", "10", "#a", "ß", "ss", "ñ", "n", "o", "Ö", "日本", "я", "(a)", "a.b", "a b", "ab", "a-b"]
    text = "\n".join(f"- {w}" for w in words)
    df = spark.createDataFrame([("p", text)], "path string, content string")
    got = [x[2:] for x in build.apply_patches(df, [{"op": "sort-list", "list": 0}], native_only=True).first()["content"].split("\n")]
    con = duckdb.connect()
    con.execute("CREATE TABLE w AS SELECT unnest(?) AS w", [words])
    assert got == [r[0] for r in con.execute("SELECT w FROM w ORDER BY w COLLATE en").fetchall()]
