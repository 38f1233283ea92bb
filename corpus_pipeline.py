"""A training corpus from documents: five stages, each an operator of takewise.llm.

Every stage takes an empty table, columns of further names, repeated rows and rows without doc_id; but for the last each
returns the columns it got. The key of the pseudonyms is the session's spark.takewise.pseudonymKey.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takewise.llm import minhash, packing, pii, substrings, weak_labels
from takewise.llm import text as tx
from takewise.session import checkpoint


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows a changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer rejects go, those with a null, empty or blank text among them."""
    tx.short_batches(spark)
    return weak_labels.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (shingles of five words, 0.8 similar) the one with the smallest doc_id stays; its repeated rows
    stay with it. Documents without words or without doc_id are nobody's duplicates."""
    tx.short_batches(spark)
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that also start earlier go; what is left of a document stays, if only an empty text.
    Rows without doc_id stay as they are."""
    tx.short_batches(spark)
    return _measured(substrings.strip_passages(docs))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values are replaced; a null or empty text has none."""
    key = pii.session_key(spark)
    return _measured(pii.pseudonymise(docs, key=key).select(*[F.col(f"`{c}`") for c in docs.columns]))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: the place of each piece of each document; a null or empty text is the end token alone."""
    tx.short_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("PII", pseudonyms),
    ("best-fit packing", packed),
]

#: SQL cannot express the scorer of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
