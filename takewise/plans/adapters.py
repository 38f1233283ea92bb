"""The library's tables derived from general test tables, by column arithmetic alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from takewise.functions import arrays

#: States of a song and of a set, in order of processing, as fixed values.
SONG_STATES = ["uploading", "normalizing", "trimming", "analyzing", "grouped", "ungrouped", "reprocess"]
SET_STATES = ["uploading", "normalizing", "ready"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def riffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five riffs a recording, from embeddings."""
    v = F.col("v")
    got = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    got = got.withColumn("z", arrays.znorm(v))
    i = F.col("vec_id")
    tempo = F.when(i % 50 == 0, 0.0).otherwise(60 + (i * 37) % 160 + 0.5 * F.col("label"))
    part = lambda at, n: F.transform(F.slice(v, at, n), lambda x: F.round(F.abs(x), 4))
    return got.select(
        i.alias("riff_id"),
        F.floor(i / 5).cast("long").alias("recording_id"),
        (i % 5).cast("int").alias("riff_index"),
        i.alias("riff_order"),
        tempo.cast("double").alias("tempo"),
        (((i * 13) % 100) / 100.0).alias("uniformity"),
        part(1, 16).alias("groove"),
        part(17, 16).alias("drums"),
        part(33, 7).alias("spectral"),
        arrays.rounded(F.col("z")).alias("contour"),
        F.transform(arrays.quantised(F.col("z")), lambda x: x.cast("double")).alias("intervals"),
    )


def batch(all_riffs: DataFrame) -> DataFrame:
    return all_riffs.where("recording_id % 10 = 0")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording per document."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    duration = F.col("n_chars") / 5.0
    kind = F.when(duration >= 1020, "set").otherwise("song")
    state = F.when(kind == "song", F.element_at(F.array(*map(F.lit, SONG_STATES)), (i % 7 + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, SET_STATES)), (i % 3 + 1).cast("int")))
    at = F.timestamp_seconds(F.lit(1704067200) + i * 600)
    cut = F.when(i % 11 != 0, (i % 40).cast("double"))
    some = lambda n, what: F.when(i % n == 0, F.concat(F.lit(f"{what}/"), i.cast("string")))
    return table(spark, sf_dir, "documents").select(
        i.alias("recording_id"),
        at.alias("creation_time"),
        kind.alias("kind"),
        F.concat(F.lit("ZOOM"), F.lpad(i.cast("string"), 7, "0"), F.lit(".wav")).alias("filename"),
        F.sha2(text, 256).alias("file_hash"),
        at.alias("uploaded_at"),
        state.alias("state"),
        F.when((kind == "song") & (i % 7 == 4), F.col("source")).alias("song_id"),
        F.lit(None).cast("string").alias("set_id"),
        F.when(kind == "song", some(2, "flac")).alias("path_flac"),
        F.when(kind == "song", some(5, "song")).alias("path_song"),
        F.when(kind == "song", cut).alias("cut_start_sec"),
        F.when(kind == "song", cut + duration).alias("cut_end_sec"),
        F.when((kind == "song") & (i % 6 == 0), cut).alias("saved_cut_start_sec"),
        F.when((kind == "song") & (i % 6 == 0), cut + duration).alias("saved_cut_end_sec"),
        F.when(kind == "song", (i * 17 % 100) / 100.0).alias("trim_confidence"),
        F.when(kind == "song", F.lit("energy_wall")).alias("trim_method"),
        F.when((kind == "song") & (i % 4 != 0), 60 + (i * 7 % 120) + 0.5).alias("tempo"),
        duration.alias("duration_sec"),
        F.when(i % 9 == 0, F.array(F.lit("riff_0:no_contour"))).alias("processing_flags"),
        F.col("lang").alias("lang"),
    )


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("d"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("d") * 600)
    return got.select(F.col("source").alias("song_id"), at.alias("creation_time"), F.concat(F.lit("Song "), F.col("source")).alias("title"), F.when(F.col("d") % 2 == 0, F.lit("note")).alias("notes"), at.alias("created_at"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame a second, from a user's events in order."""
    got = table(spark, sf_dir, "events")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    kind = F.when(F.col("event_type") == "click", 1.0).when(F.col("event_type") == "view", 2.0).otherwise(3.0)
    return got.select(F.col("user_id").alias("recording_id"), number.cast("long").alias("frame_idx"), F.col("value").cast("double").alias("rms"), (1 / (1 + F.col("value"))).alias("flatness"), kind.alias("c1"), F.col("value").alias("c0"))


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, idx, t_sec): a user's events by the hours since the first."""
    got = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return got.select(F.col("user_id").alias("recording_id"), (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("idx"), ((micros - F.min(micros).over(w)) / 3600000000.0).alias("t_sec"), F.col("value").alias("strength"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("/card/"), F.lpad(i.cast("string"), 9, "0"), F.lit(".wav")).alias("path"), F.lit(".wav").alias("suffix"), (F.col("n_chars") * 1024).alias("bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash"), i.alias("arrival_seq"))


