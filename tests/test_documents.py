"""Document operators: small cases with exact texts and counts, and both tiers against each other."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import md, native
from textloom.plans.spec import FIELDS

DOC = """---
title: A
n: 1
---
# Top {#top}

intro
## One

a
b

### Deep

c

## Two

| k | v |
|:--|--:|
| x | 10 |
| y | 9 |
| x | 10 |

1. first
   more
2. second

<!-- a -->
in
<!-- /a -->
"""


def run(patch, text=DOC, file=""):
    return md.apply(text, patch, file)


def test_all_operators_are_there():
    assert len(FIELDS) == 53
    assert set(md.OPS) | set(md.CORPUS_OPS) == set(FIELDS)


@pytest.mark.parametrize(
    ("patch", "text", "want", "count"),
    [
        ({"op": "replace", "old": "a", "new": "$&"}, "banana", "b$&n$&n$&", 3),
        ({"op": "replace", "old": "x", "new": "y"}, "banana", "banana", 0),
        ({"op": "replace-regex", "pattern": r"(\w)\.$", "replacement": "<$1$$>"}, "a.\nb.", "a.\n<b$>", 1),
        ({"op": "replace-regex", "pattern": "^B", "replacement": "x", "flags": "im"}, "b\nB", "x\nx", 2),
        ({"op": "replace-line", "match": "a", "replacement": "b"}, "a\naa\na", "b\naa\nb", 2),
        ({"op": "insert-after-line", "match": "a", "content": "n"}, "a\nb", "a\nn\nb", 1),
        ({"op": "insert-before-line", "pattern": "^b$", "regex": True, "content": "n"}, "a\nb", "a\nn\nb", 1),
        ({"op": "delete-between", "start": "<", "end": ">"}, "1\n<\n2\n>\n3", "1\n3", 1),
        ({"op": "delete-between", "start": ">", "end": "<"}, "1\n<\n2\n>\n3", "1\n<\n2\n>\n3", 0),
        ({"op": "replace-between", "start": "<", "end": ">", "content": "x\ny", "inclusive": False}, "<\n2\n>", "<\nx\ny\n>", 1),
        ({"op": "rename-header", "id": "a-b", "new": "C"}, "## A  b!\nx", "## C\nx", 1),
        ({"op": "remove-section", "id": "a"}, "# a\r\nx", "# a\r\nx", 0),
        ({"op": "remove-section", "id": "a", "includeChildren": False}, "# a\nx\n## b\ny", "## b\ny", 1),
        ({"op": "change-section-level", "id": "a", "delta": -4}, "## a\n### b", "# a\n### b", 1),
        ({"op": "move-section", "id": "a", "after": "b"}, "# a\n1\n# b\n2", "# b\n2\n# a\n1", 1),
        ({"op": "move-section", "id": "a", "after": "c"}, "# a\n## c\n# b", "# a\n## c\n# b", 0),
        ({"op": "update-toc"}, "<!-- TOC -->\nx\n<!-- /TOC -->\n# T", "<!-- TOC -->\n<!-- /TOC -->\n# T", 1),
        ({"op": "remove-frontmatter", "key": "a"}, "---\na: 1\n---\nx", "x", 1),
        ({"op": "remove-frontmatter", "key": "a.b"}, "---\na: 1\n---\nx", "---\na: 1\n---\nx", 0),
        ({"op": "set-frontmatter", "key": "a.b", "value": True}, "x", "---\na:\n  b: true\n---\nx", 1),
        ({"op": "rename-frontmatter", "old": "a", "new": "c"}, "---\na: yes\nb: 2\n---\n", "---\nb: 2\nc: yes\n---\n", 1),
        ({"op": "replace-code-block", "index": 1, "content": "z\n"}, "```js\na\n```\n~~~\nb\n~~~\nend", "```js\na\n```\n~~~\nz\n~~~\nend", 1),
        ({"op": "modify-links", "urlPattern": "^/a", "urlReplacement": "/b"}, "[x](/a/1) ![y](/a) [z](/c)", "[x](/b/1) ![y](/b) [z](/c)", 2),
        ({"op": "modify-links", "newUrl": "q"}, "[x](y)", "[x](y)", 0),
        ({"op": "sort-list", "list": 0, "type": "number", "direction": "desc"}, "- 2 b\n- 10 a\n  sub\n- x", "- 10 a\n  sub\n- 2 b\n- x", 1),
        ({"op": "set-list-item", "list": 0, "item": "a", "new": "b"}, "* [x] a\n  sub", "* [x] b\n  sub", 1),
        ({"op": "filter-list-items", "list": 0, "match": "b"}, "- a\n- b", "- b", 1),
        ({"op": "filter-list-items", "list": 0}, "- a\n- b", "- a\n- b", 0),
        ({"op": "deduplicate-list-items", "list": 0, "keep": "last"}, "- a\n- b\n- a", "- b\n- a", 1),
        ({"op": "reorder-list-items", "list": 0, "order": ["b", 0]}, "- a\n- b", "- b\n- a", 1),
        ({"op": "add-list-item", "list": 0, "item": "n", "position": 1}, "1. a\n2. b", "1. a\n1. n\n2. b", 1),
    ],
)
def test_texts(patch, text, want, count):
    assert run(patch, text) == (want, count)


def test_tables():
    lines = DOC.split("\n")
    (t,) = md.tables(lines)
    assert (t.headers, t.alignments, len(t.rows)) == (["k", "v"], ["left", "right"], 3)
    new, n = run({"op": "deduplicate-table-rows", "table": "two"})
    assert n == 1
    assert "| k | v |\n| :--- | ---: |\n| x | 10 |\n| y | 9 |\n\n" in new
    by_number = run({"op": "sort-table", "table": "two", "column": "v", "type": "number"})[0]
    assert by_number.index("| y | 9 |") < by_number.index("| x | 10 |")
    assert run({"op": "remove-table-row", "table": "two", "row": {"column": "k", "value": "z"}})[1] == 0
    assert run({"op": "filter-table-rows", "table": "two", "column": "k"})[1] == 1
    assert md.tables(["| a |", "|---|"]) == []


@pytest.mark.parametrize(
    ("file", "text", "want"),
    [
        ("a.json", '{"a": 1}', '{\n  "a": 1,\n  "b": {\n    "c": 2\n  }\n}'),
        ("a.yaml", "a: 1\n", "a: 1\nb:\n  c: 2\n"),
        ("a.toml", "a = 1\n", "a = 1\n\n[b]\nc = 2\n"),
        (".env", "# x\na=1\n", "a=1\nb.c=2\n"),
        ("a.properties", "a.z: 1\n", "a.z=1\nb.c=2\n"),
    ],
)
def test_structured_files(file, text, want):
    patch = {"op": "json-set", "path": "b.c", "value": 2}
    if file == ".env":
        patch = {"op": "json-merge", "value": {"b.c": 2}}
    assert run(patch, text, file) == (want, 1)


def test_structured_misses():
    assert run({"op": "json-delete", "path": "q"}, '{"a": 1}', "a.json")[1] == 0
    assert run({"op": "json-set", "path": "q", "value": 1}, "{bad", "a.json") == ("{bad", 0)
    assert run({"op": "json-set", "path": "q", "value": 1}, "x", "a.md") == ("x", 0)
    assert run({"op": "json-merge", "value": {"b": [1]}, "path": "a"}, '{"a": {"b": [2], "c": 3}}', "x.json")[0].split() == '{ "a": { "b": [ 1 ], "c": 3 } }'.split()


def random_document(rng):
    parts = ["# A", "## B", "### C {#c}", "#### D d", "text", "", "start here", "end here", "- item", "| x |", "## B", "a a a"]
    return "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))


NATIVE = [
    {"op": "replace", "old": "a", "new": "bb"},
    {"op": "replace-regex", "pattern": r"^(#+) (\w)", "replacement": "$1 _$2$$", "flags": "m"},
    {"op": "replace-line", "match": "text", "replacement": "x\ny"},
    {"op": "insert-after-line", "match": "## B", "content": "n"},
    {"op": "insert-before-line", "pattern": "^s.*t", "regex": True, "content": "n"},
    {"op": "delete-between", "start": "start", "end": "end"},
    {"op": "delete-between", "start": "start", "end": "end", "inclusive": False},
    {"op": "replace-between", "start": "start", "end": "end", "content": "p\nq"},
    {"op": "remove-section", "id": "b"},
    {"op": "remove-section", "id": "b", "includeChildren": False},
    {"op": "replace-section", "id": "b", "content": "r\ns"},
    {"op": "prepend-to-section", "id": "c", "content": "r"},
    {"op": "append-to-section", "id": "b", "content": "r"},
    {"op": "replace-in-section", "id": "b", "old": "a", "new": "z"},
    {"op": "rename-header", "id": "c", "new": "N"},
    {"op": "change-section-level", "id": "b", "delta": 2},
    {"op": "insert-section", "id": "b", "header": "## N", "content": "x\n", "position": "before"},
    {"op": "move-section", "id": "b", "after": "a"},
    {"op": "move-section", "id": "c", "after": "d-d"},
]


def test_columns_equal_python(spark):
    rng = random.Random(5)
    texts = [random_document(rng) for _ in range(300)] + ["", "\n", DOC, DOC.replace("\n", "\r\n")]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, content string").cache()
    for patch in NATIVE:
        text, n = native.build(patch, F.col("content"))
        got = {r["k"]: (r["t"], r["n"]) for r in df.select("k", text.alias("t"), n.alias("n")).collect()}
        for k, t in enumerate(texts):
            assert got[k] == md.apply(t, patch), (patch, t)
