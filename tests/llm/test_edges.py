"""Every operator on null ids, null and empty and very long texts, repeated rows, empty tables and clashing columns."""

import random
import zlib

import pytest

from tests.llm.conftest import CLASHES, EDGE, FRENCH, prose
from textloom.llm import centroids, fingerprint, jaccard, langid, linededup, lm, media, mixing, neardup, packing, runs, secret_scan
from textloom.llm.queries import tokenizer_path

DOCUMENTS = {
    "packing": lambda d: packing.pack(d, tokenizer_path()),
    "media": lambda d: media.features(media.stored(d)),
    "mixing": lambda d: mixing.mix(d).drop("key"),
    "secrets": lambda d: secret_scan.digests(secret_scan.find_secrets(d)),
    "lm": lm.score,
    "fingerprint": fingerprint.edited,
    "linededup": linededup.dedup,
    "jaccard": jaccard.join,
    "langid": langid.predict,
    "runs": lambda d: runs.digests(runs.find_runs(runs.planted(d))),
}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    long_words, long_lines = " ".join(rng.choice(FRENCH) for _ in range(150_000)), "\n".join(prose(rng, 9) for _ in range(20_000))
    return [(None, None), (None, "null id"), (None, "null id"), *EDGE, (50, long_words), (51, long_lines), (52, "x" * 1_200_000), (53, " \n" * 400_000), (54, "a b " * 200_000), (55, "é" * 300_000 + "\0")]


@pytest.mark.parametrize("name", DOCUMENTS)
def test_nulls_long_texts_and_repeated_rows(make, rows, name):
    """One row a document, or a piece; null ids are ids; equal rows have equal results."""
    out = DOCUMENTS[name](make(rows, CLASHES)).toPandas()
    ids = sorted(-1 if i is None else i for i, *_ in rows)
    found = out["doc_id"].fillna(-1).astype(int)
    if name == "packing":
        assert set(found) == set(ids) and (out.groupby("sequence_id").length.sum() <= 1024).all()
    else:
        assert sorted(found) == ids
    if name in ("media", "secrets", "lm", "langid", "runs"):
        again = out[found == 5].drop(columns="doc_id").astype(str)
        assert len(again) == 2 and len(again.drop_duplicates()) == 1


@pytest.mark.parametrize("name", DOCUMENTS)
def test_empty_tables(make, name):
    assert DOCUMENTS[name](make([], CLASHES)).count() == 0


def test_empty_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert centroids.digests(centroids.cluster(none)).count() == 0 and neardup.near_duplicates(none).count() == 0


def test_media_payloads_of_long_and_null_texts(make, rows):
    out = media.features(media.stored(make(rows))).toPandas()
    for i, t in rows:
        if i is not None and i != 5:
            b = (t or "").encode()
            padded = b + bytes(-len(b) % 64 or (0 if b else 64))
            r = out[out.doc_id == i].iloc[0]
            assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(b), len(padded), zlib.crc32(padded[-64:]))
    assert out[out.n_bytes == 0].feature.nunique() == 1  # equal texts, equal features


def test_ties_of_the_mix(make):
    """Sources of one size and weight share alike, whatever the order of rows; a rerun agrees."""
    rows = [(k, "a b c d e", "en", f"s{k % 4}") for k in range(400)]
    one, two = (mixing.mix(make(r)).drop("key").toPandas().sort_values(["doc_id"]).reset_index(drop=True) for r in (rows, rows[::-1]))
    assert one.equals(two) and one.groupby("target").ngroups <= 3
    assert (one.taken <= 2 * one["size"]).all()


def test_documents_of_no_known_language_are_unfamiliar(make):
    """Whatever the number of languages, unknown ones, noise and digits have little that was learned; code-switched text has all."""
    rng = random.Random(22)
    rows = [(k, prose(rng, 60, FRENCH if k % 2 else None) if k % 2 else prose(rng, 60), "fr" if k % 2 else "en") for k in range(120)]
    mixed = [(1000 + k, prose(rng, 12) + " " + prose(rng, 12, FRENCH) + " " + prose(rng, 12), None) for k in range(20)]
    noise = " ".join("".join(rng.choice("bcdfghjkqvwxz") for _ in range(6)) for _ in range(40))
    odd = [(2000, "η γλώσσα είναι ένα σύστημα επικοινωνίας", None), (2001, noise, None), (2002, "汉语 是 世界 上 使用", None), (2003, "9f86d081884c7d659a2feaa0c55ad015", None)]
    out = langid.label(make(rows + mixed + odd)).select("doc_id", "familiar").toPandas().set_index("doc_id").familiar
    assert out[out.index < 2000].min() > 0.9 and out[out.index >= 2000].max() < 0.6 and out.between(0, 1).all()
