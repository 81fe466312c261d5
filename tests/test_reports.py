"""Fetched resources, previews, debug sessions, reports, and stores that persist."""

import io
import json
import subprocess
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.operators import md
from textloom.plans import preview, recover, reports, stores
from textloom.plans.planner import Program
from textloom.sources import fetch, files, remote

PATCHES = [{"op": "replace", "old": "a", "new": "b"}, {"op": "remove-section", "id": "sumary"}, {"op": "append-to-file", "content": "z", "include": "x/**"}]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("a.md", "# Summary\n\na a\n"), ("x/b.md", "none"), ("n.md", None)], "path string, content string")


def tar(entries: dict[str, str], link: str = "") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, text in entries.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))
        if link:
            info = tarfile.TarInfo(link)
            info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
            t.addfile(info)
    return out.getvalue()


def test_archives():
    assert fetch.unpacked("r.tar.gz", tar({"top/docs/a.md": "A", "top/b.md": "B"}, "top/l")) == [("b.md", "B"), ("docs/a.md", "A")]
    assert fetch.unpacked("r.tgz", tar({"top/docs/a.md": "A", "top/b.md": "B"}), "docs") == [("a.md", "A")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/x.md", "é")
        z.writestr("b.json", "{}")
    assert fetch.unpacked("r.zip", out.getvalue()) == [("a/x.md", "é"), ("b.json", "{}")]
    for bad in ("../x", "/x", "a/../../x", "c:\\x"):
        with pytest.raises(ValueError, match="leads out"):
            fetch.unpacked("r.tar.gz", tar({bad: "x"}))
    with pytest.raises(ValueError, match="more than 2 bytes"):
        fetch.unpacked("r.tar.gz", tar({"a": "xyz"}), most=2)


def test_credentials():
    assert fetch.credentials(None) == {}
    assert fetch.credentials({"type": "bearer", "tokenEnv": "T"}, {"T": "s"}) == {"Authorization": "Bearer s"}
    assert fetch.credentials({"type": "basic", "username": "u", "passwordEnv": "P"}, {"P": "p"}) == {"Authorization": "Basic dTpw"}
    for bad in ({"type": "bearer", "tokenEnv": "none"}, {"type": "basic", "username": "u"}, {"type": "key"}):
        with pytest.raises(ValueError, match="auth"):
            fetch.credentials(bad, {})


def test_fetch_archive(spark, tmp_path):
    data, asked = tar({"r/docs/a.md": "A"}), []

    def opener(url, headers):
        asked.append((url, dict(headers)))
        if len(asked) == 1:
            raise OSError("busy")
        return data

    remote_sleep, remote.time.sleep = remote.time.sleep, lambda s: None
    try:
        url = {"url": "https://h.com/r.tar.gz//docs", "auth": {"type": "bearer", "tokenEnv": "T"}}
        fetch_ = lambda **k: fetch.fetch(spark, url | k.pop("more", {}), str(tmp_path / "c"), opener=opener, env={"T": "s"}, **k)
        with pytest.raises(FileNotFoundError):
            fetch_(offline=True)
        with pytest.raises(PermissionError, match="host"):
            fetch_(security={"allowedHosts": ["x.com"]})
        asked.clear()
        corpus, lock = fetch_()
    finally:
        remote.time.sleep = remote_sleep
    assert rows(corpus, "path", "content") == [("a.md", "A")]
    assert asked == [("https://h.com/r.tar.gz", {"Authorization": "Bearer s"})] * 2
    assert rows(fetch_(offline=True, lock={lock["url"]: lock})[0], "path") == [("a.md",)] and len(asked) == 2
    with pytest.raises(ValueError, match="not sha256-"):
        fetch_(lock={lock["url"]: lock | {"integrity": "sha256-" + "0" * 64}})
    with pytest.raises(ValueError, match="not sha256-"):
        fetch_(more={"sha256": "1" * 64})


def test_fetch_git(spark, tmp_path):
    origin = tmp_path / "origin.git"
    (origin / "docs").mkdir(parents=True)
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@e", *a], cwd=origin, check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q", "-b", "main")
    (origin / "docs/a.md").write_text("one")
    run("add", ".")
    run("commit", "-qm", "one")
    first = run("rev-parse", "HEAD")
    (origin / "docs/a.md").write_text("two")
    run("commit", "-qam", "two")
    url = f"git::file://{origin}//docs?ref=main"
    corpus, lock = fetch.fetch(spark, url, str(tmp_path / "c"))
    assert rows(corpus, "path", "content") == [("a.md", "two")] and lock["resolved"] == run("rev-parse", "HEAD")
    old, _ = fetch.fetch(spark, url, str(tmp_path / "c"), lock={lock["url"]: {"resolved": first}})
    assert rows(old, "path", "content") == [("a.md", "one")]


def test_clean_and_order(spark, tmp_path, docs):
    out = tmp_path / "out"
    files.write_files(docs.filter("content IS NOT NULL"), str(out))
    (out / "old.md").write_text("old")
    assert rows(files.clean(str(out), docs, delete=False), "path") == [("old.md",)] and (out / "old.md").exists()
    assert rows(files.clean(str(out), docs), "path") == [("old.md",)] and not (out / "old.md").exists() and (out / "x/b.md").exists()
    assert [r["path"] for r in reports.in_order(docs).collect()] == ["a.md", "n.md", "x/b.md"]


def test_preview(docs):
    after = docs.withColumn("content", F.replace("content", F.lit("a a"), F.lit("a b\nc")))
    (row,) = preview.preview(docs, after).collect()
    assert (row["path"], row["status"]) == ("a.md", "modified")
    assert [(x["kind"], x["before"], x["after"], [tuple(p) for p in x["parts"]]) for x in row["lines"]] == [("modified", 3, 3, [("equal", "a "), ("removed", "a"), ("added", "b")]), ("added", None, 4, [("added", "c")])]
    for x, y in (("kitten", "sitting"), ("", "a"), ("a", ""), ("x" * 3000, "y")):
        parts = preview.char_changes(x, y)
        assert "".join(t for k, t in parts if k != "added") == x and "".join(t for k, t in parts if k != "removed") == y
    assert preview.snippet("a\nb\nc\nd", 2, 1) == "  1 | a\n> 2 | b\n  3 | c"


def test_session():
    s = preview.Session("x/b.md", "a", PATCHES)
    assert s.look() == ("b", 1) and s.content == "a"
    assert s.decide("apply") and s.content == "b" and s.look()[1] == 0
    assert s.decide("skip") and not s.decide("apply") and s.content == md.apply("b", PATCHES[2])[0]
    kept, text = s.decisions(), s.content
    assert s.statistics() == {"total": 3, "applied": 2, "skipped": 1, "left": 0}
    assert s.back() and s.content == "b" and s.at == 2
    assert preview.Session("x/b.md", "a", PATCHES).replay(json.loads(json.dumps(kept))) == text
    with pytest.raises(ValueError, match="no patch"):
        preview.Session("p", "", [])


def test_steps_and_reports(spark, docs, tmp_path):
    assert rows(preview.steps(docs, PATCHES), "path", "step", "op", "count") == [("a.md", 0, "replace", 3), ("x/b.md", 2, "append-to-file", 1)]
    assert rows(reports.by_operation(docs, PATCHES), "op", "documents", "matches") == [("append-to-file", 1, 1), ("replace", 1, 3)]
    hint = [{"op": "remove-section", "id": "sumary"}, {"op": "remove-section", "id": "sumary", "include": "x/**"}]
    assert rows(reports.hints(docs, hint), "path", "step", "hint") == [("a.md", 0, "section 'summary'")]
    got = {r["section"]: json.loads(r["body"]) for r in reports.bundle(docs, PATCHES).collect()}
    assert got["coverage"] == {"total": 3, "patched": 3, "unpatched": 0, "percent": 100.0}
    assert [x["files"] for x in got["impact"]] == [3, 3, 1] and got["safety"]["patches"] == 3 and [x["ord"] for x in got["riskiest"]][0] == 1
    report = {"files": 2, "by": {"op": "replace"}}
    assert reports.as_text(report) == "files  2\nby:\n  op  replace\n" and json.loads(reports.as_json(report)) == report
    for form, read in (("json", spark.read.json), ("text", spark.read.text)):
        reports.write_rows(docs, str(tmp_path / form), form)
        assert read(str(tmp_path / form)).count() == 3
    texts = spark.createDataFrame([("a b C", "c d"), ("", " "), (None, "a")], "x string, y string")
    assert [r[0] for r in texts.select(reports.word_similarity(F.col("x"), F.col("y"))).collect()] == [0.25, 1.0, None]


def test_cache_store(spark, tmp_path, docs):
    program = Program([], [{"op": "replace", "old": "a", "new": "b"}])
    table = stores.cache_store(spark, str(tmp_path / "cache"))
    some = docs.filter("content IS NOT NULL")
    stores.write_cache(stores.incremental(some, stores.read_cache(table), program), table, 0)
    again = stores.incremental(some, stores.read_cache(table), program)
    assert rows(again, "path", "rebuilt") == [("a.md", False), ("x/b.md", False)]
    cache = stores.read_cache(table)
    bad = cache.withColumn("output", F.when(F.col("path") == "a.md", "damaged").otherwise(F.col("output"))).unionByName(cache.filter("path = 'x/b.md'"))
    assert rows(stores.cache_problems(bad), "path", "problem") == [("a.md", "damaged"), ("x/b.md", "twice")]
    assert stores.repaired(bad).count() == 0 and stores.repaired(cache).count() == 2 and stores.cache_problems(cache).isEmpty()
    assert tuple(stores.cache_sizes(cache).first()) == (2, 1, len("# Summbry\n\nb b\n") + 4)


def test_rollback_and_update(spark, docs):
    history = spark.createDataFrame([("1", "2024-01-01", True), ("2", "2024-01-02", False), ("3", "2024-01-03", True), ("4", "2024-01-04", True)], "build_id string, ts string, success boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    outputs = spark.createDataFrame([("1", "a", "a1"), ("1", "b", "b1"), ("2", "a", "bad"), ("3", "a", None), ("3", "b", "b3"), ("4", "b", "b4")], "build_id string, path string, output string")
    at = lambda k: rows(stores.rolled_back(outputs, history, k), "path", "output")
    assert at("1") == [("a", "a1"), ("b", "b1")] and at("3") == [("b", "b3")] and at("4") == [("b", "b4")]
    new, what = stores.updated(stores.snapshot(docs), docs.filter("path <> 'x/b.md'"))
    assert new.count() == 2 and rows(what, "path", "status")[-1] == ("x/b.md", "deleted")


def test_many_targets_meet_by_length(spark):
    names = spark.createDataFrame([("summary",), ("details",), ("x",)], "value string")
    targets = spark.createDataFrame([("sumary",), ("detail",), ("completely other",)], "target string")
    assert rows(recover.nearest(targets, names), "target", "value", "distance") == [("detail", "details", 1), ("sumary", "summary", 1)]



def test_templates(spark, tmp_path):
    from textloom.sources import templates

    user = tmp_path / "user" / "mine"
    (user / "docs").mkdir(parents=True)
    (user / "template.yaml").write_text("name: mine\nvariables:\n  title:\n    default: T\n  who:\n")
    (user / "docs/{{title}}.md").write_text("# {{title}} by {{who}} \\{{title}}\n")
    found = templates.available(tmp_path / "user", tmp_path / "none")
    assert {"base", "overlay", "fork", "pipeline", "mine"} == set(found)
    with pytest.raises(ValueError, match="needs who"):
        found["mine"].rendered({})
    assert templates.scaffold(found["mine"], tmp_path / "out", {"who": "x"}) == ["docs/T.md"]
    assert (tmp_path / "out/docs/T.md").read_text() == "# T by x {{title}}\n"
    with pytest.raises(FileExistsError):
        templates.scaffold(found["mine"], tmp_path / "out", {"who": "x"})
    with pytest.raises(ValueError):
        templates.scaffold(found["mine"], tmp_path / "out", {"who": "x", "title": "../../x"}, overwrite=True)
    templates.scaffold(found["pipeline"], tmp_path / "p", {})
    (tmp_path / "p/base/a.md").write_text("a")
    assert rows(files.overlay(spark, str(tmp_path / "p/production/config.yaml")), "content") == [("a",)]


def test_counters_come_with_the_write(spark, docs, tmp_path):
    from textloom.plans import build

    program = Program([], [*PATCHES, {"op": "replace", "old": "none", "new": "some"}, {"op": "set-frontmatter", "key": "k", "value": 1}])
    counters = reports.Counters(program)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    told = counters.write(build.build(docs, program, tally=True), f"file://{tmp_path}/out")
    assert len(jobs.getJobIdsForGroup("counted")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plain = build.build(docs, program)
    assert {k: told[k] for k in ("files", "changed", "applied", "skipped", "warnings", "errors", "bytes")} == plain_statistics(plain)
    assert told["ms"] > 0 and told["slowest_ms"] <= told["ms"] and told["seconds"] > 0
    assert counters.by_operation() == {r["op"]: (r["documents"], r["matches"]) for r in reports.by_operation(docs, program.content).collect()}
    assert spark.read.parquet(f"file://{tmp_path}/out").columns == ["path", "content", "applied", "skipped", "warnings", "errors"]


def plain_statistics(built):
    from textloom.plans.build import statistics

    return {k: v or 0 for k, v in statistics(built).first().asDict().items()}


def test_a_patch_rebuilds_what_it_admits(spark):
    corpus = spark.createDataFrame([("a/1.md", "x"), ("b/2.md", "x"), ("c/3.md", None)], "path string, content string")
    old = Program([], [{"op": "replace", "old": "x", "new": "y", "include": "a/**"}, {"op": "append-to-file", "content": "!"}])
    built = stores.incremental(corpus, spark.createDataFrame([], stores.CACHE), old)
    cache = built.select("path", "source_hash", "patch_hash", "output_hash", F.col("content").alias("output")).cache()
    again = lambda program: rows(stores.incremental(corpus, cache, program), "path", "rebuilt")
    assert again(old) == [("a/1.md", False), ("b/2.md", False), ("c/3.md", False)]
    assert again(Program([], [old.content[0] | {"new": "z"}, old.content[1]]))[:2] == [("a/1.md", True), ("b/2.md", False)]
    assert again(Program([], [old.content[0] | {"include": "b/**"}, old.content[1]]))[:2] == [("a/1.md", True), ("b/2.md", True)]
    assert again(Program([], [*old.content, {"op": "replace", "old": "q", "new": "r", "include": "d/**"}]))[:2] == [("a/1.md", False), ("b/2.md", False)]
    assert all(r for _, r in again(Program([], old.content, validators=[{"name": "v", "contains": "x"}])))
    counters = reports.Counters(old)
    counters.on(stores.incremental(corpus.unionByName(spark.createDataFrame([("d/4.md", "x")], corpus.schema)), cache, old, tally=True)).write.format("noop").mode("overwrite").save()
    told = counters.statistics()
    assert told["files"] == 4 and told["reasons"]["new-file"] == 1 and told["hits"] + told["misses"] == 4


@pytest.mark.parametrize("form", ["zip", "tar", "tar.gz"])
def test_archives_are_read_by_many_tasks(spark, tmp_path, form):
    from textloom.sources import archives

    files_ = [(f"top/{'a' if k % 2 else 'b'}/{k}.md", (f"é{k} " * 2000).encode()) for k in range(40)]
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / f"in/deep/x.{form}").write_bytes(archives.packed(files_, form))
    (tmp_path / f"in/y.{form}").write_bytes(archives.packed([("b/1.md", b"one"), ("b/1.md", b"two")], form))
    (tmp_path / "in/other.txt").write_text("no archive")
    read = lambda **k: archives.read_archives(spark, f"file://{tmp_path}/in", bytes=100_000, **k)
    want = sorted([(f"deep/x.{form}", p.removeprefix("top/"), len(c), c.decode()) for p, c in files_] + [(f"y.{form}", "1.md", 3, "two")])
    assert rows(read(), "archive", "path", "size", "content") == want
    tasks = read().rdd.getNumPartitions()
    assert tasks == 2 if form == "tar.gz" else tasks >= 5
    one = read().filter("path LIKE 'a/%'")
    assert rows(one, "path") == sorted((p,) for _, p, *_ in want if p.startswith("a/")) and (form == "tar.gz" or one.rdd.getNumPartitions() < tasks)
    assert rows(read().filter(F.col("path").isin("a/1.md", "none")), "path") == [("a/1.md",)]
    assert rows(read(content=False), "path", "content") == sorted((p, None) for _, p, *_ in want)
    assert rows(read(folder="a"), "path") == sorted((p.removeprefix("a/"),) for _, p, *_ in want if p.startswith("a/"))
    with pytest.raises(Exception, match="unpacks to more than"):
        read(most=10).collect()
    (tmp_path / f"in/z.{form}").write_bytes(archives.packed([("../x", b"x")], form))
    with pytest.raises(Exception, match="leads out"):
        read().collect()


def test_a_configuration_with_remote_resources(spark, tmp_path):
    """An archive, a repository, a base and local files as one table; pinned, and again from the cache alone."""
    origin = tmp_path / "origin.git"
    origin.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@e", *a], cwd=origin, check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (origin / "g.md").write_text("git")
    (origin / "l.md").write_text("git")
    run("add", ".")
    run("commit", "-qm", "one")
    at = tmp_path / "conf"
    at.mkdir()
    (at / "l.md").write_text("local")
    (at / "config.yaml").write_text(f"resources: ['*.md', {{url: 'https://h.com/r.zip//docs', auth: {{type: bearer, tokenEnv: T}}}}, 'git::file://{origin}?ref=main', '!**/no.md']")
    data = tar({"r/docs/a.md": "A", "r/docs/l.md": "far", "r/docs/no.md": "N"})
    opener = lambda url, headers: _zip(data) if headers == {"Authorization": "Bearer s"} else b""
    lock: dict = {}
    read = lambda **k: rows(files.overlay(spark, str(at / "config.yaml"), cache=f"file://{tmp_path}/cache", lock=lock, env={"T": "s"}, **k), "path", "content")
    assert read(opener=opener) == [("a.md", "A"), ("g.md", "git"), ("l.md", "local")]
    assert set(lock) == {"https://h.com/r.zip", f"file://{origin}"} or len(lock) == 2
    (origin / "g.md").write_text("newer")
    run("commit", "-qam", "two")
    assert read(opener=lambda url, headers: 1 / 0) == [("a.md", "A"), ("g.md", "git"), ("l.md", "local")]
    lock["https://h.com/r.zip"]["integrity"] = "sha256-" + "0" * 64
    with pytest.raises(Exception, match="not sha256-"):
        read(opener=opener)
    with pytest.raises(ValueError, match="cache"):
        files.overlay(spark, str(at / "config.yaml"))


def _zip(data):
    out = io.BytesIO()
    with tarfile.open(fileobj=io.BytesIO(data)) as t, zipfile.ZipFile(out, "w") as z:
        for m in t:
            z.writestr(m.name, t.extractfile(m).read())
    return out.getvalue()


def test_profile_and_replay(spark, docs):
    told = {r["step"]: r for r in preview.profile(docs, PATCHES).collect()}
    assert [(told[k]["op"], told[k]["tried"], told[k]["documents"], told[k]["matches"]) for k in range(3)] == [("replace", 2, 1, 3), ("remove-section", 2, 0, 0), ("append-to-file", 1, 1, 1)]
    assert all(r["ms"] >= r["slowest_ms"] >= 0 for r in told.values())
    taken = spark.createDataFrame([("a.md", 0, "apply"), ("a.md", 1, "apply"), ("a.md", 0, "apply"), ("x/b.md", 2, "skip"), ("x/b.md", 9, "apply"), ("n.md", 0, "apply"), ("none", 0, "apply")], "path string, step int, action string")
    assert rows(preview.replayed(docs, PATCHES, taken), "path", "content", "applied", "skipped") == [("a.md", "# Summbry\n\nb b\n", 1, 0), ("n.md", None, 0, 0), ("x/b.md", "none", 0, 1)]
    session = preview.Session("a.md", "# Summary\n\na a\n", PATCHES)
    assert session.replay([{"file": "a.md", "patchIndex": 0, "action": "apply"}]) == "# Summbry\n\nb b\n"


def test_files_are_listed_and_read_by_few_tasks(spark, tmp_path):
    from textloom.sources import files

    for k in range(300):
        (tmp_path / f"in/d{k % 3}/e").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"in/d{k % 3}/e/{k} +%.md").write_text(f"é{k}\r\n", newline="")
    for name in (".hidden.md", "_made.md", "a.txt", "node_modules/a.md", ".git/a.md"):
        (tmp_path / "in" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("no")
    (tmp_path / "in/empty.md").write_text("")
    out = files.read_corpus(spark, f"file://{tmp_path}/in")
    assert rows(out, "path", "content") == sorted([(f"d{k % 3}/e/{k} +%.md", f"é{k}\r\n") for k in range(300)] + [("empty.md", "")])
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_cleaning_reads_no_contents(spark, tmp_path, monkeypatch):
    from textloom.sources import files

    (tmp_path / "a.md").write_text("x")
    (tmp_path / "b.md").write_text("x")
    monkeypatch.setattr(files, "read_corpus", lambda *args: 1 / 0)
    kept = spark.createDataFrame([("a.md",)], "path string")
    assert rows(files.clean(f"file://{tmp_path}", kept), "path") == [("b.md",)]
    assert (tmp_path / "a.md").exists() and not (tmp_path / "b.md").exists()


def test_overlays_read_only_what_wins(spark, tmp_path):
    """A file that no task can open is in the way of a reader of all files, but neither of what wins nor of names."""
    from textloom.sources import files

    for name, told in (("base", "['*.md']"), ("top", "['../base', '*.md']")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "config.yaml").write_text(f"resources: {told}")
    (tmp_path / "base/a.md").symlink_to(tmp_path / "none")
    (tmp_path / "base/b.md").write_text("b")
    (tmp_path / "top/a.md").write_text("own")
    out = files.overlay(spark, str(tmp_path / "top/config.yaml"), chain=True)
    found = sorted((r["path"], r["content"], [x.split("/")[-2] for x in r["chain"]]) for r in out.collect())
    assert found == [("a.md", "own", ["top"]), ("b.md", "b", ["base", "top"])]
    (tmp_path / "top/c.md").symlink_to(tmp_path / "none")
    names = files.overlay(spark, str(tmp_path / "top/config.yaml"), chain=True, contents=False)
    assert names.columns == ["path", "chain"] and rows(names, "path") == [("a.md",), ("b.md",), ("c.md",)]


@pytest.mark.parametrize("form", ["zip", "tar", "tar.gz"])
def test_archives_are_written_as_a_stream(form):
    import io
    import os
    import tracemalloc

    from textloom.sources import archives

    class Sink(io.RawIOBase):
        def writable(self):
            return True

        def write(self, data):
            return len(data)

    data = os.urandom(1 << 20)
    tracemalloc.start()
    packer = archives.Packer(Sink(), form)
    for k in range(30):
        packer.add(f"{k}.md", data)
    packer.close()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def test_archive_directories_are_read_once(spark, tmp_path):
    """Tasks go to their members by the listing: nothing of a zip's directory is asked for again."""
    from textloom.sources import archives

    data = archives.packed([(f"a/{k}.md", f"é{k} ".encode() * 500) for k in range(2500)] + [("b/x.md", b"x"), ("b/x.md", b"y")], "zip")
    (tmp_path / "x.zip").write_bytes(data)
    listing = archives.list_archives(spark, str(tmp_path))
    (tmp_path / "x.zip").write_bytes(data[: data.index(b"PK\1\2")])
    read = archives.read_archives(spark, str(tmp_path), listing=listing, bytes=100_000)
    want = sorted([(f"a/{k}.md", f"é{k} " * 500) for k in range(2500)] + [("b/x.md", "y")])
    assert rows(read, "path", "content") == want and read.rdd.getNumPartitions() > 10
    assert rows(read.filter(F.col("path").startswith("b/")), "path") == [("b/x.md",)]


def test_archive_partitions_are_bounded(spark, tmp_path, monkeypatch):
    from textloom.sources import archives

    (tmp_path / "x.tar").write_bytes(archives.packed([(f"{k}.md", b"x" * 100) for k in range(3000)], "tar"))
    listing = archives.list_archives(spark, f"file://{tmp_path}")
    monkeypatch.setattr(archives, "PARTITIONS", 5)
    reader = archives.ArchiveReader({"path": f"file://{tmp_path}", "listing": listing, "bytes": "1"})
    parts = reader.partitions()
    assert 5 <= len(parts) <= 6
    assert sorted(p for part in parts for batch in reader.read(part) for p in batch.column(1).to_pylist()) == sorted(f"{k}.md" for k in range(3000))


@pytest.mark.parametrize("form", ["zip", "tar", "tar.gz"])
def test_archives_are_written_in_pieces(spark, tmp_path, form):
    """One large archive is many tasks' work, and still one archive in order of its paths, for any reader."""
    import tarfile
    import zipfile

    from textloom.sources import archives

    texts = spark.range(4000).select(F.lit("k").alias("key"), F.format_string("d/%05d é.md", "id").alias("path"), F.sha2(F.col("id").cast("string"), 512).alias("content"))
    texts = texts.withColumn("content", F.repeat("content", 20)).withColumn("content", F.when(F.col("path") < "d/00010", None).otherwise(F.col("content")))
    want = {r.path: r.content for r in texts.collect() if r.content is not None}
    # the data is small, so tasks must not be put together for their size
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        archives.write_archives(texts, f"file://{tmp_path}/out", "key", form)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [x.name for x in (tmp_path / "out").iterdir() if not x.name.startswith(".")] == [f"k.{form}"]
    name = tmp_path / f"out/k.{form}"
    if form == "zip":
        with zipfile.ZipFile(name) as z:
            assert z.testzip() is None and [(x, z.read(x).decode()) for x in z.namelist()] == sorted(want.items())
    else:
        with tarfile.open(name) as t:
            assert [(m.name, t.extractfile(m).read().decode()) for m in t] == sorted(want.items())
    if form == "tar.gz":
        assert name.read_bytes().count(b"\x1f\x8b\x08\0\0\0\0\0") > 2  # streams: pieces, and the end
    assert rows(archives.read_archives(spark, f"file://{tmp_path}/out"), "path", "content") == sorted((p.removeprefix("d/"), c) for p, c in want.items())


def test_joined_zips_are_wide(tmp_path):
    import zipfile

    from pyarrow import fs

    from textloom.sources import archives

    for k in range(2):
        (tmp_path / f"{k}").write_bytes(archives.packed([(f"{k}/{n}", b"") for n in range(33000)], "zip"))
    with open(tmp_path / "x.zip", "wb") as out:
        archives.joined(fs.LocalFileSystem(), [str(tmp_path / "0"), str(tmp_path / "1")], "zip", out)
    with zipfile.ZipFile(tmp_path / "x.zip") as z, open(tmp_path / "x.zip", "rb") as source:
        assert len(z.namelist()) == 66000 and z.read("1/32999") == b""
        found = archives.members("x.zip", source, "", 10)
        assert [(m.name, m.at) for m in found] == [(i.filename, i.header_offset) for i in z.infolist()]
        fields, name, extra, comment = next(archives.entries(source))
    far = archives.moved(fields, name, extra, comment, 5 << 30)
    fields = archives.ENTRY.unpack_from(far)
    assert fields[16] == 0xFFFFFFFF and archives.wide(far[archives.ENTRY.size + len(name) :], fields[9], fields[8], fields[16])[2] == 5 << 30


def test_compressed_tars_of_several_streams():
    import gzip

    from textloom.sources import archives

    data = archives.packed([(f"{k}.md", b"x" * 100) for k in range(4)], "tar")
    streams = gzip.compress(data[:2048]) + gzip.compress(data[2048:])
    found = archives.members("x.tar.gz", io.BytesIO(streams), "", 1000)
    assert [m.path for m in found] == [f"{k}.md" for k in range(4)]
    assert [d for _, d in archives.contents("x.tar.gz", io.BytesIO(streams), found)] == [b"x" * 100] * 4
