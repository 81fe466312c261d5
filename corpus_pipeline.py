"""The corpus pipeline: documents in, packed training sequences out, one Parquet write after each stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm import jaccard, langid, linededup, mixing, packing
from textloom.llm.base import delete, documents, registered, scratch, shared_dir
from textloom.llm.queries import tokenizer_path

#: A document of whose words' features the model has learned less than this share is of no language that it knows. That
#: doesn't depend on how many languages there are, and words of several known ones are all familiar.
LEAST_FAMILIAR = 0.7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no known language, go. A missing language becomes the predicted one.

    Where no row with a text has a language nothing can be learned: then every document with a letter stays.
    """
    if docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).isEmpty():
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    out = langid.label(docs)
    known = (F.col("lang_pred") != langid.UNDECIDED) & (F.col("familiar") >= LEAST_FAMILIAR)
    return out.filter(known).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; a document that had nothing else goes with them."""
    out = linededup.dedup(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"\S")
    return out.filter(left).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row with the smallest id stays; ids may repeat or be null, nulls come last."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    id_ = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key")
    found = jaccard.join(keyed.select(id_.alias("doc_id"), "text"))
    first = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id._key").alias("_kept"))
    rows = keyed.join(first, F.col("_key") == F.col("_kept"), "left_semi")
    among = Window.partitionBy("_key").orderBy(F.xxhash64(*docs.columns))  # rows of one id and text
    return rows.withColumn("_n", F.row_number().over(among)).filter("_n = 1").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs, mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("mix", mix), ("packing", pack)]

#: Language ID, winnowing and packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written and read again before the next begins, then what it was made
    of is deleted. The last stage's rows are deleted when the process ends."""
    docs, before = documents(spark, sf_dir), None
    folder = registered(spark, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
