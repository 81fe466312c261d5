"""Planner, builds, corpus patches, analytics, stores, suggestions, recovery, sources and watch."""

import contextlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import codecs, patterns, values
from textloom.operators import md
from textloom.operators.corpus import apply_corpus
from textloom.plans import analytics, build, checks, recover, spec, stores, suggest
from textloom.plans.planner import Program, inherited, program, substituted
from textloom.sources import files, remote, templates


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [
        ("**/*.md", "a.md", True), ("**/*.md", "x/y/a.md", True), ("*.md", "x/a.md", False), ("*.md", ".a.md", False), ("docs/**", "docs/a/b", True),
        ("a/{b,c}/*.md", "a/c/z.md", True), ("a?c", "a/c", False), ("[a-c]x", "bx", True), ("!(a).md", "b.md", True), ("!(a).md", "a.md", False), ("a/**/b", "a/b", True), ("!*.md", "a.md", False),
    ],
)
def test_globs(glob, path, want):
    assert patterns.matches(path, glob) is want


def test_patterns_end_like_javascript():
    assert not patterns.compiled("a$").search("a\n")
    assert patterns.compiled("a$", "m").search("a\nb")
    assert not patterns.compiled("a.b").search("a\rb")
    assert patterns.check_js("(") and patterns.check_js("a", "q") and not patterns.check_js(r"(?<x>a)\k<x>")


SCALARS = ["Doc 17", "en", "true", "True", "null", "~", "3", "03", "-4", "1.5", "a: b", "a #b", "- x", "yes", "2020-01-01", "", "a  b", "x.y/z", "é", "'q'", "[a]", "0", "-0", "*a", "|", "<<", "1_000"]


@given(st.lists(st.tuples(st.sampled_from(["title", "a-b", "_x", "true", "1", "é", "a b"]), st.one_of(st.sampled_from(SCALARS), st.lists(st.sampled_from(SCALARS), max_size=2))), min_size=1, max_size=4))
def test_simple_frontmatter_equals_yaml(entries):
    lines = [x for k, v in entries for x in ([f"{k}: {v}"] if isinstance(v, str) else [f"{k}:", *(f"  - {i}" for i in v)])]
    with contextlib.suppress(KeyError):
        assert repr(codecs.simple_load(lines)) == repr(codecs.yaml_load("\n".join(lines)))
    data = {k: v if isinstance(v, str) else {"in": v, "n": None} for k, v in entries}
    assert "".join(codecs.simple_dump(k, v) or codecs.yaml_dump({k: v}) for k, v in data.items()) == codecs.yaml_dump(data)


def test_yaml_is_1_2():
    assert codecs.yaml_load("a: yes\nb: 0o17\nc: 010\nd: ~") == {"a": "yes", "b": 15, "c": 10, "d": None}
    data = {"a": "true", "b": ["x", {"c": 1.5}], "d": {}, "e": "l1\nl2\n", "f": None}
    assert codecs.yaml_load(codecs.yaml_dump(data)) == data
    assert codecs.split_frontmatter("---\n- a\n---\nx") == ({}, "x", True)
    assert codecs.split_frontmatter("--- \na: 1\n---\n") == ({}, "--- \na: 1\n---\n", False)
    assert codecs.condition_frontmatter("--- \na: 1\n--- \nx") == {"a": 1}


def test_values():
    assert values.levenshtein("kitten", "sitting") == 3
    assert values.levenshtein("aaaa", "bbbb", 1) == 2
    assert [x[0] for x in values.similar_strings("sumary", ["summary", "Summary", "other", "sumary"])] == ["Summary", "summary"]
    assert values.float_prefix("12.5kg") == 12.5 and values.float_prefix("x") == 0
    assert values.date_number("1970-01-02") == 86_400_000 and values.date_number("no") == 0
    data = {"a": 1}
    values.set_path(data, "a.b", None)
    assert values.get_path(data, "a.b") is None and values.get_path(data, "a.c") is values.MISSING


def test_inheritance_and_variables():
    patches = [
        {"op": "replace", "id": "p", "old": "a", "new": "b", "include": "x/*", "group": "g"},
        {"op": "replace", "extends": "p", "old": "c", "include": ["y/*"]},
    ]
    child = inherited(patches)[1]
    assert child["include"] == ["x/*", "y/*"] and child["new"] == "b" and child["old"] == "c" and "extends" not in child
    with pytest.raises(ValueError, match="extend each other"):
        inherited([{"op": "replace", "id": "a", "extends": "b"}, {"op": "replace", "id": "b", "extends": "a"}])
    assert substituted({"op": "replace", "old": "${x}", "new": "${y}", "values": {"k": "${x}"}}, {"x": "1"}) == {"op": "replace", "old": "1", "new": "${y}", "values": {"k": "${x}"}}
    assert not program({"patches": patches}, enable=["h"]).content
    assert len(program({"patches": patches}, disable=["h"]).content) == 2


def test_config_problems():
    good = "apiVersion: engine/v1\nkind: Kustomization\nresources: ['*.md']\npatches:\n- {op: replace, old: a, new: b, when: {not: {fileContains: x}}}\n"
    assert spec.read(good)["patches"][0]["old"] == "a"
    bad = {"apiVersion": "v2", "kind": "x", "patches": [{"op": "nope"}, {"op": "replace", "old": ""}, {"op": "replace-regex", "pattern": "(", "replacement": ""}, {"op": "sort-table", "table": 1, "column": 0, "direction": "up"}, {"op": "replace", "old": "a", "new": "b", "extends": "zz", "when": {"anyOf": []}}]}
    fields = {p.field for p in spec.problems(bad)}
    assert {"apiVersion", "kind", "resources", "patches[0].op", "patches[1].old", "patches[1].new", "patches[2].pattern", "patches[3].direction", "patches[4].extends", "patches[4].when.anyOf"} <= fields
    assert len(spec.schema()["properties"]["patches"]["items"]["oneOf"]) == 53
    with pytest.raises(ValueError, match="leaves"):
        spec.relative("a/../../b")


def test_conditions():
    text = "---\na: {b: 1}\n---\nxyz"
    assert checks.holds({"frontmatterEquals": {"key": "a.b", "value": 1}}, text)
    assert not checks.holds({"frontmatterEquals": {"key": "a.b", "value": True}}, text)
    assert checks.holds({"allOf": []}, text) and not checks.holds({"anyOf": []}, text)
    assert checks.holds({"fileMatches": "/XYZ/i"}, text) and not checks.holds({"fileMatches": "("}, text)
    assert checks.words(text) == 1 and checks.lines("") == 0 and checks.lines("a\n") == 2


@pytest.fixture
def corpus(spark):
    rows = [("a/x.md", "# T\n\nalpha\n"), ("a/y.md", "# T\n\nbeta\n"), ("b/x.md", "---\nk: v\n---\n# T\n")]
    return spark.createDataFrame(rows, "path string, content string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_build(corpus):
    patches = [
        {"op": "replace", "old": "alpha", "new": "beta", "include": "a/*"},
        {"op": "set-frontmatter", "key": "z", "value": 1, "when": {"frontmatterExists": "k"}},
        {"op": "replace", "old": "beta", "new": "gamma", "onNoMatch": "error", "validate": {"notContains": "gamma"}},
    ]
    got = {r["path"]: r for r in build.build(corpus, Program([], patches, "warn", [{"name": "v", "frontmatterRequired": ["k"]}])).collect()}
    assert got["a/x.md"]["content"] == "# T\n\ngamma\n" and got["a/x.md"]["applied"] == 2 and got["a/x.md"]["skipped"] == 1
    assert got["a/y.md"]["warnings"] == ["patch 0 (replace): no match"]
    assert got["b/x.md"]["content"] == "---\nk: v\nz: 1\n---\n# T\n"
    assert got["b/x.md"]["errors"] == ["patch 2 (replace): no match"]
    assert got["a/y.md"]["errors"] == ["patch 2 (replace): breaks notContains", "validator v: breaks frontmatterRequired"]
    with pytest.raises(build.BuildError):
        build.strict(build.build(corpus, Program([], patches)))
    with pytest.raises(PermissionError):
        build.apply_patches(corpus, [{"op": "exec", "command": "cat"}])


def test_plugins_and_commands(corpus):
    md.register_plugin("up", lambda text, params, context: text.upper() + params["end"])
    out = build.apply_patches(corpus, [{"op": "plugin", "plugin": "up", "params": {"end": "!"}}, {"op": "exec", "command": "tr A a"}, {"op": "exec", "command": "false", "onNoMatch": "skip"}], allow_exec=True)
    assert rows(out, "content", "applied")[0] == ("# T\n\nBETa\n!", 2)
    with pytest.raises(ValueError, match="registered already"):
        md.register_plugin("up", str)
    assert md.apply("x", {"op": "ai-transform", "prompt": "p"}) == ("x", 0)


def test_corpus_patches(corpus):
    out = apply_corpus(corpus, [
        {"op": "copy-file", "src": "a/x.md", "dest": "a/y.md"}, {"op": "rename-file", "match": "b/*.md", "rename": "z.md"},
        {"op": "move-file", "match": "b/z.md", "dest": "c"}, {"op": "write-file", "path": "n.md", "content": "n"}, {"op": "delete-file", "match": "a/x.*"},
    ])
    assert rows(out, "path", "content") == [("a/y.md", "# T\n\nalpha\n"), ("c/z.md", "---\nk: v\n---\n# T\n"), ("n.md", "n")]
    assert apply_corpus(corpus, [{"op": "copy-file", "src": "none.md", "dest": "a/x.md"}]).count() == 3


def test_one_document_a_path(corpus):
    out = apply_corpus(corpus, [{"op": "rename-file", "match": "a/*.md", "rename": "z.md"}])
    assert rows(out, "path", "content") == [("a/z.md", "# T\n\nbeta\n"), *rows(corpus.filter("path like 'b/%'"), "path", "content")]
    out = apply_corpus(corpus, [{"op": "copy-file", "src": "a/x.md", "dest": "b/y.md"}, {"op": "move-file", "match": "a/y.md", "dest": "b"}])
    assert dict(rows(out, "path", "content"))["b/y.md"] == "# T\n\nbeta\n" and out.count() == out.select("path").distinct().count()
    with pytest.raises(ValueError, match="not a file name"):
        apply_corpus(corpus, [{"op": "rename-file", "match": "a/*.md", "rename": "../z.md"}])


def test_null_content(spark):
    df = spark.createDataFrame([("a.md", None), ("b.md", "# T\n")], "path string, content string")
    for patch in ({"op": "replace", "old": "T", "new": "U"}, {"op": "set-frontmatter", "key": "k", "value": 1}, {"op": "append-to-section", "id": "t", "content": "x"}, {"op": "replace-code-block", "index": 0, "content": "x"}):
        out = build.build(df, Program([], [patch | {"when": {"not": {"fileContains": "zz"}}}, patch], "warn", [{"name": "v", "minWordCount": 0}, {"name": "w", "frontmatterRequired": ["k"]}]))
        assert rows(out.filter("path = 'a.md'"), "content", "applied", "skipped", "warnings", "errors") == [(None, 0, 1, [f"patch 1 ({patch['op']}): no match"], [])]


def test_partitions_do_not_matter(corpus):
    patches = [{"op": "append-to-section", "id": "t", "content": "x"}, {"op": "set-frontmatter", "key": "a", "value": [1]}]
    one, many = (rows(build.apply_patches(corpus.repartition(n), patches), "path", "content", "applied") for n in (1, 7))
    assert one == many


def test_lint_and_conflicts():
    patches = [{"op": "remove-section", "id": "a"}, {"op": "append-to-section", "id": "a", "content": "x"}, {"op": "replace", "old": "q", "new": "q"}]
    assert {m for _, _, m in analytics.lint(patches)} == {"destructive and unguarded", "replaces text by itself"}
    report = analytics.dry_run(patches)
    assert report["conflicts"] == [(0, 1, "section", "high")] and report["risk_level"] == "medium"


def test_incremental(spark, corpus):
    p = Program([], [{"op": "replace", "old": "T", "new": "U"}])
    empty = spark.createDataFrame([], "path string, source_hash string, patch_hash string, output string")
    first = stores.incremental(corpus, empty, p)
    cache = first.select("path", "source_hash", "patch_hash", F.col("content").alias("output"))
    changed = corpus.withColumn("content", F.when(F.col("path") == "a/x.md", F.lit("# T new")).otherwise(F.col("content")))
    again = stores.incremental(changed, cache, p)
    assert rows(again, "path", "rebuilt") == [("a/x.md", True), ("a/y.md", False), ("b/x.md", False)]
    assert rows(again, "path", "content") == rows(build.build(changed, p), "path", "content")
    assert stores.program_hash(p) != stores.program_hash(Program([], [{"op": "replace", "old": "T", "new": "V"}]))


def test_diffs(corpus):
    after = corpus.filter("path <> 'a/y.md'").withColumn("content", F.concat("content", F.lit("x")))
    got = {r["path"]: r for r in stores.corpus_diff(corpus, after).collect()}
    assert {p: r["status"] for p, r in got.items()} == {"a/x.md": "modified", "a/y.md": "deleted", "b/x.md": "modified"}
    assert "+x" in got["a/x.md"]["diff"]


ROUND_TRIPS = [
    ("---\na: 1\n---\nx", "---\nb: 1\nc: 2\n---\nx"),
    ("# A\n\none\n\n# B\n\ntwo\n", "# A\n\none\n\n# C\n\ntwo\n"),
    ("# A\n\none\n\n# B\n\ntwo\n", "# A\n\none\nmore\n\n# B\n\ntwo\n"),
    ("- b\n- a\n- c", "- a\n- b\n- c"),
    ("- b\n- a\n- b", "- b\n- a"),
    ("[x](u) y", "[x](v) y"),
    ("| k | v |\n|---|---|\n| a | 1 |\n| b | 2 |", "| k | v |\n| --- | --- |\n| a | 1 |\n| b | 3 |"),
    ("| k | v |\n| --- | --- |\n| b | 1 |\n| a | 2 |", "| k | v |\n| --- | --- |\n| a | 2 |\n| b | 1 |"),
    ("```js\na\n```\n\nz", "```ts\nb\n```\n\nz"),
    ("text", "head\ntext\ntail"),
    ("# A\n\na\n\n# B\n\nb\n\n# C\n\nc\n", "# A\n\na\n\n# C\n\nc\n\n# B\n\nb\n"),
    ("x\n<!-- t -->\na\n<!-- /t -->\ny", "x\n<!-- t -->\nb\nc\n<!-- /t -->\ny"),
    ("use foo and foo\nor foo here", "use bar and bar\nor bar here"),
]


@pytest.mark.parametrize(("a", "b"), ROUND_TRIPS)
def test_suggestions_round_trip(a, b):
    found = [p for p, _ in suggest.suggest(a, b)]
    assert found
    assert suggest.check(a, b, found) > 0.6


def test_suggestions_over_corpora(spark, corpus):
    target = corpus.withColumn("content", F.replace("content", F.lit("# T"), F.lit("# T\n\nnew")))
    found = suggest.suggestions(suggest.paired(corpus, target))
    assert found.count() >= 3 and found.filter("checked = 1").count() >= 1
    assert suggest.consolidated(found).count() <= found.count()
    assert [p["op"] for p in suggest.json_patches('{"a": 1, "b": {"c": 1}}', '{"b": {"c": 2}, "d": 3}', "json")] == ["json-delete", "json-set", "json-set"]


@pytest.mark.parametrize(
    ("patch", "text", "field", "want"),
    [
        ({"op": "remove-section", "id": "sumary"}, "# Summary\nx", "id", "summary"),
        ({"op": "replace", "old": "HELLO", "new": "x"}, "say hello", "old", "hello"),
        ({"op": "replace", "old": "a b", "new": "x"}, "a\n b", "old", "a\n b"),
        ({"op": "remove-frontmatter", "key": "titel"}, "---\ntitle: 1\n---\n", "key", "title"),
        ({"op": "replace-line", "match": "some lime", "replacement": "x"}, "some line\nother", "match", "some line"),
        ({"op": "delete-between", "start": "b", "end": "a"}, "a\nx\nb", "start", "a"),
    ],
)
def test_recovery(patch, text, field, want):
    assert recover.fixes(patch, text)[0].patch[field] == want


def test_nearest(spark):
    t = spark.createDataFrame([("sumary",)], "target string")
    c = spark.createDataFrame([("summary",), ("data",), ("Sumary",)], "value string")
    assert rows(recover.nearest(t, c), "value", "distance") == [("Sumary", 0), ("summary", 1)]


def test_remote():
    assert remote.git_url("github.com/o/r//docs?ref=v1") == ("https://github.com/o/r.git", "docs", "v1")
    assert remote.git_url("git::https://x.org/r.git//a/b").folder == "a/b"
    assert remote.git_url("docs/*.md") is None
    assert remote.archive_url("https://x.org/a.tar.gz//sub?sha256=ab") == ("https://x.org/a.tar.gz", "sub", "ab")
    assert remote.allowed("https://evil.org/x", ["good.org", "*.fine.org"]) and not remote.allowed("https://a.fine.org/x", ["*.fine.org"])
    entry = {"u": {"url": "u", "resolved": "r", "integrity": "i", "fetched": "t"}}
    assert remote.read_lock(remote.write_lock(entry)) == entry
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return b"ok"

    assert remote.with_retries(call, 3, sleep=lambda s: None) == b"ok"
    assert templates.substitute(r"{{a}} \{{a}} {{b}}", {"a": "1"}) == "1 {{a}} {{b}}"


def test_files(spark, tmp_path, corpus):
    files.write_files(corpus, str(tmp_path / "in"))
    (tmp_path / "in/node_modules").mkdir()
    (tmp_path / "in/node_modules/x.md").write_text("no")
    back = files.read_corpus(spark, str(tmp_path / "in"))
    assert rows(back, "path", "content") == rows(corpus, "path", "content")
    (tmp_path / "in/config.yaml").write_text("resources: ['a/*.md', '!a/y.md']")
    (tmp_path / "top").mkdir()
    (tmp_path / "top/config.yaml").write_text("resources: ['../in', 'own.md']")
    (tmp_path / "top/own.md").write_text("own")
    assert rows(files.overlay(spark, str(tmp_path / "top/config.yaml")), "path") == [("a/x.md",), ("own.md",)]


def test_watch(spark, tmp_path, corpus):
    from textloom.streaming.watch import Watch, stream_table

    corpus.write.parquet(str(tmp_path / "in"))
    watch = Watch(spark, str(tmp_path / "state"), Program([], [{"op": "replace", "old": "T", "new": "U"}]))
    watch.start(stream_table(spark, str(tmp_path / "in")), str(tmp_path / "c"), once=True).awaitTermination()
    assert watch.current().count() == 3
    spark.createDataFrame([("a/x.md", "T2"), ("a/y.md", "# T\n\nbeta\n")], "path string, content string").write.mode("append").parquet(str(tmp_path / "in"))
    watch.start(stream_table(spark, str(tmp_path / "in")), str(tmp_path / "c"), once=True).awaitTermination()
    assert rows(watch.current().filter("path = 'a/x.md'"), "output") == [("U2",)]
    assert watch.versions().filter("version = 1").count() == 1


def test_watch_keeps_folders_apart_and_compacts(spark, tmp_path):
    from textloom.streaming.watch import Watch, stream_files

    inside = tmp_path / "in"
    seen = []
    watch = Watch(spark, str(tmp_path / "state"), Program([], [{"op": "replace", "old": "T", "new": "U"}]), on_build=lambda df, n: seen.append((n, df.count())), compact=2)
    for k in range(5):
        for where in ("a", "b c"):
            (inside / where).mkdir(parents=True, exist_ok=True)
            (inside / where / f"i{k}.md").write_text(f"T{where}{k}")
        watch.start(stream_files(spark, str(inside)), str(tmp_path / "c"), once=True).awaitTermination()
    assert rows(watch.current(), "path", "output") == sorted((f"{w}/i{k}.md", f"U{w}{k}") for w in ("a", "b c") for k in range(5))
    assert seen == [(k, 2) for k in range(5)] and watch.table.base() == 3
    assert sorted(p.name for p in (tmp_path / "state/output").iterdir() if p.is_dir()) == ["base=1", "base=3", "version=2", "version=3", "version=4"]
    watch.batch(spark.createDataFrame([("a/i0.md", "T")], "path string, content string"), 2)  # an old batch again
    assert watch.current().count() == 10
    gone = watch.sweep(watch.current().filter("path like 'a/%'").select("path"))
    assert gone.count() == 5 and watch.current().count() == 5


def test_newest_rows_move_only_what_is_asked_for(spark, tmp_path):
    table = stores.Versions(spark, str(tmp_path), "path string, output string, deleted boolean, version long")
    for n in range(2):
        table.write(spark.createDataFrame([("a", f"x{n}", False, n)], table.schema), n)
    out = table.newest(columns=("deleted",))
    assert rows(out, "path", "deleted") == [("a", False)] and rows(table.newest(), "output") == [("x1",)]
    assert "output:string" in table.newest()._jdf.queryExecution().executedPlan().toString()
    assert "output:string" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("compact", [2, 10])
@pytest.mark.parametrize("corpus_patch", [False, True])
def test_sweep_between_batches(spark, tmp_path, compact, corpus_patch):
    """What was swept stays away, what comes later arrives, and a batch that runs again changes nothing."""
    from textloom.streaming.watch import Watch

    table = lambda *r: spark.createDataFrame(list(r), "path string, content string")
    program = Program([{"op": "delete-file", "match": "none.md"}] if corpus_patch else [], [{"op": "replace", "old": "x", "new": "y"}])
    watch = Watch(spark, str(tmp_path / "state"), program, compact=compact)
    assert watch.sweep(table(("a.md", "")).limit(0)).count() == 0
    watch.batch(table(("a.md", "x1"), ("b.md", "x2")), 0)
    assert rows(watch.sweep(table(("a.md", ""))), "path") == [("b.md",)]
    assert watch.sweep(table(("a.md", ""))).count() == 0
    watch.batch(table(("c.md", "x3")), 1)
    watch.batch(table(("c.md", "x3")), 1)
    watch.batch(table(("a.md", "x1"), ("b.md", "x2")), 0)
    assert rows(watch.current(), "path", "output") == [("a.md", "y1"), ("c.md", "y3")]
    watch.batch(table(("b.md", "x2"), ("a.md", None)), 2)
    assert rows(watch.current(), "path", "output") == [("b.md", "y2"), ("c.md", "y3")]
    assert watch.sweep(watch.current().select("path").limit(0)).count() == 2
    watch.batch(table(("b.md", "x2"), ("a.md", None)), 2)
    assert watch.current().count() == 0


def test_debounced_changes(spark, tmp_path):
    """Two changes of a path within the quiet time are one, deletes are events, and a restart loses nothing."""
    import time

    from textloom.streaming.debounce import debounced
    from textloom.streaming.watch import Watch, stream_table

    def put(*r):
        spark.createDataFrame(list(r), "path string, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def until(ready, seconds=120):
        end = time.time() + seconds
        while not ready() and time.time() < end:
            assert running.exception() is None, str(running.exception())
            time.sleep(0.2)
        assert ready()

    put(("a.md", "x1"), ("b.md", "x2"))
    seen = []
    watch = Watch(spark, str(tmp_path / "state"), Program([], [{"op": "replace", "old": "x", "new": "y"}]), on_build=lambda df, n: seen.extend(rows(df, "path", "output")))
    source = stream_table(spark, str(tmp_path / "in"))
    running = watch.start(source, str(tmp_path / "c"), every="100 milliseconds", quiet=20_000)
    until(lambda: (running.lastProgress or {}).get("batchId", -1) >= 1)
    put(("a.md", "x3"))
    n = running.lastProgress["batchId"]
    until(lambda: running.lastProgress["batchId"] >= n + 1)
    running.stop()  # both wait
    assert seen == []
    running = watch.start(stream_table(spark, str(tmp_path / "in")), str(tmp_path / "c"), every="100 milliseconds", quiet=500)
    until(lambda: len(seen) >= 2)
    assert sorted(seen) == [("a.md", "y3"), ("b.md", "y2")]
    put(("b.md", None))
    until(lambda: ("b.md", None) in seen)
    running.stop()
    assert rows(watch.current(), "path", "output") == [("a.md", "y3")]
    assert debounced(stream_table(spark, str(tmp_path / "in")), 10).columns == ["path", "content", "modified", "events"]


def test_watch_rebuilds_if_documents_depend_on_each_other(spark, tmp_path):
    from textloom.streaming.watch import Watch

    watch = Watch(spark, str(tmp_path / "state"), Program([{"op": "copy-file", "src": "a.md", "dest": "b.md"}], [{"op": "replace", "old": "x", "new": "y"}]))
    table = lambda *r: spark.createDataFrame(list(r), "path string, content string")
    watch.batch(table(("a.md", "x1")), 0)
    watch.batch(table(("c.md", "x3")), 1)
    assert rows(watch.current(), "path", "output") == [("a.md", "y1"), ("b.md", "y1"), ("c.md", "y3")]
    watch.batch(table(("a.md", None)), 2)
    assert rows(watch.current(), "path", "output") == [("c.md", "y3")]


def test_watch_raises_what_the_store_raises(spark, tmp_path):
    from textloom.streaming.watch import Hooks, Watch

    (tmp_path / "state/output/version=0").mkdir(parents=True)
    (tmp_path / "state/output/version=0/_SUCCESS").write_text("")
    (tmp_path / "state/output/version=0/part-0.parquet").write_text("not parquet")
    out = tmp_path / "said"
    watch = Watch(spark, str(tmp_path / "state"), Program([], []), hooks=Hooks(on_error=[f"echo '{{{{exitCode}}}}' > {out}"]))
    with pytest.raises(Exception, match="(?i)parquet"):
        watch.batch(spark.createDataFrame([("a.md", "x")], "path string, content string"), 1)
    assert out.read_text() == "1\n"


def test_hooks(tmp_path):
    from textloom.streaming.watch import run_hooks

    out = tmp_path / "out"
    good = run_hooks([f"echo \"File: {{{{file}}}} {{{{none}}}}\" '{{{{error}}}}' {{{{file}}}} > {out}", "exit 3", f"echo last >> {out}"], {"file": "a $(touch x)'.md", "error": "e"})
    assert not good and out.read_text() == "File: a $(touch x)'.md {{none}} e a $(touch x)'.md\nlast\n"
    assert not run_hooks(["sleep 5"], {}, timeout=0.2) and run_hooks([], {})


def test_progress(spark, tmp_path, corpus):
    import time

    from textloom.streaming.watch import Progress, Watch, stream_table

    corpus.write.parquet(str(tmp_path / "in"))
    said: list[dict] = []
    listener = Progress(said.append)
    spark.streams.addListener(listener)
    try:
        Watch(spark, str(tmp_path / "state"), Program([], [])).start(stream_table(spark, str(tmp_path / "in")), str(tmp_path / "c"), once=True).awaitTermination()
        for _ in range(100):
            if any(x["event"] == "ended" for x in said):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [x["event"] for x in said] == ["started", "progress", "ended"] and said[1]["rows"] == 3


def test_suites(spark):
    from textloom.plans import suites

    text = "tests:\n- name: a\n  input: x\n  patches: [{op: replace, old: x, new: y}]\n  expected: y\n- name: b\n  input: x\n  patches: []\n  expected: z\n"
    got = {r["name"]: r for r in suites.run(spark, suites.read(text)).collect()}
    assert got["a"]["passed"] and got["a"]["applied"] == 1
    assert not got["b"]["passed"] and "-z" in got["b"]["diff"] and "+x" in got["b"]["diff"]
    with pytest.raises(spec.Invalid):
        suites.read("tests: [{name: a}]")


def test_plugin_files(tmp_path):
    import hashlib

    file = tmp_path / "p.py"
    file.write_text("def apply(text, params, context):\n    return text + '!'\n")
    md.load_plugin("shout", str(file), "sha256-" + hashlib.sha256(file.read_bytes()).hexdigest())
    assert md.apply("a", {"op": "plugin", "plugin": "shout"}) == ("a!", 1)
    with pytest.raises(ValueError, match="meant"):
        md.load_plugin("other", str(file), "00")
