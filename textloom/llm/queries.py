"""The queries opN_<name> of this subpackage over its whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import centroids, fingerprint, html_text, jaccard, langid, linededup, lm, media, mixing, neardup, packing, runs, secret_scan
from textloom.llm.base import documents, embeddings


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the installed public tokenizers."""
    return str(Path(find_spec("public_tokenizers").origin).parent / name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.stored(documents(spark, sf_dir)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("key")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(documents(spark, sf_dir)))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(documents(spark, sf_dir))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(documents(spark, sf_dir))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(documents(spark, sf_dir))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), drop=True)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find_runs(runs.planted(documents(spark, sf_dir))))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(centroids.cluster(embeddings(spark, sf_dir)))


def op13_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(embeddings(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_packing, op2_media, op3_mixing, op4_secrets, op5_lm, op6_fingerprint, op7_linededup, op8_jaccard, op9_langid, op10_html, op11_runs, op12_centroids, op13_neardup)
    return {f.__name__: f for f in own}


#: Shingle sets, links by counting common shingles, and reachability along links.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS set FROM w
), n AS (SELECT doc_id, CAST(len(set) AS BIGINT) AS n FROM s
), u AS (SELECT doc_id, unnest(set) AS shingle FROM s
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""


#: Pairs of one label by cosine, and reachability along links.
NEARDUP_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) >= 0.93 * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))
), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def centroids_sql() -> str:
    """Rounds of assignment and floored means, one pair of tables each."""
    nearest = "SELECT vec_id, any_value(v.x) AS x, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := m.c)) AS near FROM v, m{0} m GROUP BY vec_id"
    parts = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE len(embedding) = {centroids.DIMS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {centroids.DIMS})",
        f"m0 AS (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {centroids.CLUSTERS})",
    ]
    for k in range(centroids.ROUNDS):
        parts += [
            f"a{k} AS ({nearest.format(k)})",
            f"s{k} AS (SELECT near.c AS c, i, floor(sum(x[i]) / count(*)) AS f FROM a{k}, (SELECT unnest(range(1, {centroids.DIMS + 1})) AS i) GROUP BY ALL)",
            f"m{k + 1} AS (SELECT c, list(f ORDER BY i) AS x FROM s{k} GROUP BY c UNION ALL SELECT c, x FROM m{k} WHERE c NOT IN (SELECT c FROM s{k}))",
        ]
    last = centroids.ROUNDS
    told = "sha256(array_to_string(list_transform(m.x, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','))"
    return f"""WITH {", ".join(parts)}, z AS ({nearest.format(last)})
SELECT vec_id, CAST(near.c AS INTEGER) AS cluster, CAST(near.d AS BIGINT) AS distance, CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia,
CAST(sum(near.d) OVER () AS BIGINT) AS inertia, {told} AS centroid_sha256 FROM z JOIN m{last} m ON m.c = z.near.c"""


def oracle_sql() -> dict[str, str]:
    """Tokenizers, media, random draws, decoded secrets, trained models, hash sketches, markup and runs have no form in SQL."""
    return {"op8_jaccard": JACCARD_SQL, "op12_centroids": centroids_sql(), "op13_neardup": NEARDUP_SQL}
