"""The pipeline, stage by stage and whole, over a small corpus with every edge case."""

import random

import pytest

from tests.llm.conftest import EDGE, FRENCH, prose


@pytest.fixture
def folder(make, tmp_path):
    rng = random.Random(13)
    rows = [(k, prose(rng, rng.randint(20, 80), FRENCH if k % 3 == 0 else None) if k % 3 == 0 else prose(rng, rng.randint(20, 80)), "fr" if k % 3 == 0 else "en", f"s{k % 4}") for k in range(60)]
    rows += [(100, rows[1][1], "en", "s1"), (101, rows[2][1] + " end", "en", None), (102, "123 456", None, "s1"), *((200 + i, t, None, None) for i, t in EDGE)]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def test_stages(spark, folder):
    import corpus_pipeline as c

    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in c.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        kept[name] = [r[0] for r in docs.select("doc_id").collect()]
        if name != c.STAGES[-1][0]:
            assert docs.columns == columns
    assert {1, 2, 100, 101} <= set(kept["language_id"]) and not {102, 201, 202} & set(kept["language_id"])
    assert set(range(60)) <= set(kept["language_id"])
    assert 100 not in kept["line_dedup"] and set(range(60)) <= set(kept["line_dedup"])
    assert 101 not in kept["ngram_jaccard"] and set(range(60)) <= set(kept["ngram_jaccard"])
    assert set(kept["packing"]) == set(kept["mix"])


def test_run(spark, folder):
    import corpus_pipeline as c

    out = c.run(spark, folder[0])
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 20


def test_run_leaves_its_last_stage_alone(spark, folder):
    from pathlib import Path

    import corpus_pipeline as c
    from textloom.llm.base import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in shared.iterdir()}
    c.run(spark, folder[0])
    (new,) = [p for p in shared.iterdir() if p.name not in before]
    assert new.name.startswith("pipeline-") and [p.name for p in new.iterdir() if not p.name.startswith(".")] == ["4-packing"]


def test_without_labels_letters_decide(spark, make):
    import corpus_pipeline as c

    rows = [(1, "plain words", None), (2, "123 !!", None), (3, None, None), (4, "слова", None)]
    assert sorted(r.doc_id for r in c.language_id(spark, make(rows), "").collect()) == [1, 4]


def test_clean_documents_keep_their_language(spark, make):
    import corpus_pipeline as c

    rng = random.Random(77)
    rows = [(k, prose(rng, rng.randint(1, 400), FRENCH if k % 2 else None) if k % 2 else prose(rng, rng.randint(1, 400)), ("fr" if k % 2 else "en") if k % 5 else None) for k in range(300)]
    out = {r.doc_id: r.lang for r in c.language_id(spark, make(rows), "").collect()}
    assert len(out) == 300 and sum(out[k] == ("fr" if k % 2 else "en") for k in out) >= 295


def test_empty(spark, make, tmp_path):
    import corpus_pipeline as c

    make([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert c.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_group_stays(spark, make):
    import corpus_pipeline as c

    rng = random.Random(41)
    a, b, d = (prose(rng, 60) for _ in range(3))
    rows = [*[(1, a)] * 5, (1, b), (2, b + " end"), (2, d), (None, b), (None, d), (3, a + " end"), (None, prose(rng, 60))]
    out = [(r.doc_id, r.text) for r in c.ngram_jaccard(spark, make(rows), "").collect()]
    assert sorted(out, key=str) == sorted([(1, a), (1, b), (2, d), rows[-1]], key=str)


def test_rows_that_share_an_id_are_repeated_by_their_own_draws(spark, make):
    import corpus_pipeline as c
    from textloom.llm import mixing

    rng = random.Random(42)
    rows = [(k % 2 or None, prose(rng, 30 + k % 3) if k % 3 else "the same few words", "en", f"s{k % 3}") for k in range(300)]
    docs = make(rows)
    want = {(r.source_size, round(r.target)): 0 for r in mixing.mix(docs).collect()}
    drawn = sum(r.taken for r in mixing.mix(docs).collect())
    out = c.mix(spark, docs, "").collect()
    assert sum(len(r.text.split()) for r in out) == drawn
    for source in ("s0", "s1", "s2"):
        size = sum(len(t.split()) for _, t, _, s in rows if s == source)
        target = next(b for a, b in want if a == size)
        assert abs(sum(len(r.text.split()) for r in out if r.source == source) - target) <= 32
