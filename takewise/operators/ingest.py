"""New files by content: what to copy, what to record, what is known already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_files(files: DataFrame, journal: DataFrame) -> DataFrame:
    """Files whose hash the journal doesn't have; copies among them stay."""
    return files.join(journal.select("file_hash").distinct(), "file_hash", "left_anti")


def staging_budget(files: DataFrame, free_mb: int, min_free_mb: int = 5000) -> DataFrame:
    """One row: the whole MiB that files need, and whether free space is known and too low for them and the margin."""
    need = F.floor(F.coalesce(F.sum("bytes"), F.lit(0)) / 1048576).cast("long")
    return files.agg(need.alias("needed_mb")).withColumn("low", F.lit(free_mb > 0) & (F.lit(free_mb) < F.col("needed_mb") + min_free_mb))


def stage(files: DataFrame) -> DataFrame:
    """A row per hash: the first path, and its name in staging. Minima are pre-aggregated, so a much copied file is no hot task."""
    first = files.groupBy("file_hash").agg(F.min(F.struct("path", "suffix", "bytes")).alias("f"))
    return first.select("file_hash", F.col("f.path").alias("path"), F.concat("file_hash", "f.suffix").alias("staged_name"), F.col("f.bytes").alias("bytes"))


def create_recordings(uploads: DataFrame, recordings: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(created, duplicates) of uploads (filename, file_hash, arrival_seq): the first of each unknown hash is created."""
    first = uploads.groupBy("file_hash").agg(F.min("arrival_seq").alias("arrival_seq"))
    fresh = first.join(recordings.select("file_hash").distinct(), "file_hash", "left_anti")
    created = uploads.join(fresh, ["file_hash", "arrival_seq"], "left_semi")
    duplicates = uploads.join(fresh, ["file_hash", "arrival_seq"], "left_anti")
    created = created.select("file_hash", "filename", "arrival_seq", F.lit("song").alias("kind"), F.lit("uploading").alias("state"), F.lit(now).cast("timestamp").alias("uploaded_at"))
    return created, duplicates


def journal_update(journal: DataFrame, confirmed: DataFrame, now) -> DataFrame:
    """The journal with all confirmed hashes (accepted or duplicate) stamped now."""
    seen = confirmed.where(F.col("status").isin("accepted", "duplicate")).select("file_hash").distinct().withColumn("seen_at", F.lit(now).cast("timestamp"))
    return journal.join(seen, "file_hash", "full").select("file_hash", F.coalesce("seen_at", "uploaded_at").alias("uploaded_at"))


def classify_kind(recordings: DataFrame, threshold_sec: float = 1020) -> DataFrame:
    """kind by duration: a set from the threshold on; of unknown duration a song."""
    return recordings.withColumn("kind", F.when(F.col("duration_sec") >= threshold_sec, "set").otherwise("song"))


