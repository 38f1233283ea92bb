"""The registered queries over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takewise.llm import host_rules, lines, minhash, multi_index, packing, pii, prefix_tries, repair, substrings, suffix_groups, tokens, weak_labels
from takewise.llm import text as tx
from takewise.llm.oracles import ORACLE_SQL as ORACLE_SQL


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx.short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = host_rules.quality_rules(_documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), settings=minhash.Settings(words=4))


def op3_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_groups.remove_repeats(_documents(spark, sf_dir))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.remove_passages(_documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_documents(spark, sf_dir), key=pii.session_key(spark)).select("doc_id", "text", "n_private")


def op6_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(_documents(spark, sf_dir))


def op7_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(_documents(spark, sf_dir))


def op8_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tokens.decode(tokens.encode(_documents(spark, sf_dir)))
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op11_prefix_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_tries.prefix_nodes(prefix_tries.rebuilt(prefix_tries.sequences(conversations)))


def op12_suffix_dawg(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx.short_batches(spark)
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair.repair(conversations, repair.damaged(conversations))


def op13_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.dedup_lines(_documents(spark, sf_dir))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_host_rules": op1_host_rules,
    "op2_circulant_minhash": op2_circulant_minhash,
    "op3_suffix_groups": op3_suffix_groups,
    "op4_super_kmers": op4_super_kmers,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_section_tokens": op6_section_tokens,
    "op7_weak_labels": op7_weak_labels,
    "op8_merge_replay": op8_merge_replay,
    "op9_multi_index": op9_multi_index,
    "op10_best_fit": op10_best_fit,
    "op11_prefix_tries": op11_prefix_tries,
    "op12_suffix_dawg": op12_suffix_dawg,
    "op13_cuckoo_lines": op13_cuckoo_lines,
}

