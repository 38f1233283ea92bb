"""Manifests and riffs as the library stores them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "recordingId string, filePath string, filename string, fileHash string, _corrupt_record string"
FINGERPRINT = "struct<groove:array<double>,drums:array<double>,spectral:array<double>,tempo:double,onsetUniformity:double>"
CONTOUR = "struct<contour:array<double>,intervals:array<int>,method:string,pyinConfidence:double>"


def manifest_columns(raw: DataFrame, *also: str) -> DataFrame:
    """Manifests with snake-case names, the file each comes from, and broken for those that are no manifest; also: further
    columns to keep."""
    broken = F.col("_corrupt_record").isNotNull() | F.col("recordingId").isNull()
    return raw.select(F.col("recordingId").alias("recording_id"), F.col("filePath").alias("file_path"), "filename", F.col("fileHash").alias("file_hash"), F.input_file_name().alias("source"), broken.alias("broken"), *also)


def read_manifests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): a manifest per file in order of file name; one that can't be read is set aside."""
    raw = manifest_columns(spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").json(folder))
    return raw.where("NOT broken").drop("broken").orderBy("source"), raw.where("broken").select("source")


def riff_columns(rows: DataFrame) -> DataFrame:
    """Riffs with fingerprint and contour JSON as structs; an old contour, a bare list, has no intervals. Null becomes empty."""
    old = F.struct(F.from_json("contour", "array<double>").alias("contour"), F.array().cast("array<int>").alias("intervals"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("double").alias("pyinConfidence"))
    contour = F.when(F.ltrim("contour").startswith("["), old).otherwise(F.from_json("contour", CONTOUR))
    fingerprint = F.from_json("fingerprint", FINGERPRINT)
    got = rows.withColumn("c", contour).withColumn("f", fingerprint)
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return got.select(
        *[c for c in rows.columns if c not in ("contour", "fingerprint", "tempo")],
        F.col("f.tempo").alias("tempo"), F.col("f.onsetUniformity").alias("uniformity"),
        *[empty(F.col(f"f.{c}"), "array<double>").alias(c) for c in ("groove", "drums", "spectral")],
        empty(F.col("c.contour"), "array<double>").alias("contour"), empty(F.col("c.intervals"), "array<int>").alias("intervals"),
    )


def read_riffs(spark: SparkSession, path: str) -> DataFrame:
    schema = "riff_id string, recording_id string, riff_index int, start_sec double, end_sec double, fingerprint string, contour string"
    return riff_columns(spark.read.schema(schema).json(path))


def versions(spark: SparkSession, folder: str, name: str = "version") -> list[int]:
    """The numbers n of the parts {folder}/{name}=n that were written to their end, in order; none if there is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    parts = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith(f"{name}=")]
    whole = [p.getName() for p in parts if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(x.partition("=")[2]) for x in whole)


def write_table(table: DataFrame, path: str, partitions: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet; recordings are laid out by kind and state, so that lists of a state read that part alone."""
    writer = table.write.mode(mode)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_bucketed(table: DataFrame, name: str, key: str = "recording_id", buckets: int = 64) -> None:
    """A table of the warehouse in buckets of a key, so that joins and groups on it need no shuffle."""
    table.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
