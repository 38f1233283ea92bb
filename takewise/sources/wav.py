"""Audio files too large for one task: listed before they are read, hashed in pieces, decoded by ranges of bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takewise.sources import audio

#: Bytes that are held of a file at once while it is hashed.
PIECE = 8 << 20


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_audio(spark: SparkSession, root: str) -> DataFrame:
    """(path, filename, suffix, bytes, modified) of files that end in exactly .wav or .WAV, at any depth; none is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,WAV}").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), F.regexp_extract("path", r"(\.[^.]*)$", 1).alias("suffix"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def unseen(listed: DataFrame, journal: DataFrame) -> DataFrame:
    """The listed files that journal (path, bytes, modified) doesn't hold as they are now."""
    return listed.join(journal.select("path", "bytes", "modified"), ["path", "bytes", "modified"], "left_anti")


def hashed(files: DataFrame) -> DataFrame:
    """files (path, ...) with file_hash, the SHA-256 of the content in small hexadecimal letters; a file passes through its
    task in pieces. A file that is gone by then has none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for path in part["path"]:
                where, name = _located(path)
                digest = hashlib.sha256()
                try:
                    with where.open_input_stream(name) as stream:
                        while piece := stream.read(PIECE):
                            digest.update(piece)
                except FileNotFoundError:
                    found.append(None)
                else:
                    found.append(digest.hexdigest())
            yield part.assign(file_hash=found)

    spread = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")  # a task each, as far as may be
    return spread.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.schema)}, file_hash string")


def scan_new(spark: SparkSession, root: str, journal: DataFrame) -> DataFrame:
    """(path, filename, suffix, bytes, modified, file_hash) of the files under root that journal doesn't hold: a listing first,
    then the content of these alone. What comes out, added to the journal, makes the next scan read nothing."""
    return hashed(unseen(list_audio(spark, root), journal))


def layouts(files: DataFrame) -> DataFrame:
    """files (path, key, bytes) with what their headers say; those that can't be decoded are left out. A few bytes are read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, key, size in zip(part["path"], part["key"], part["bytes"]):
                where, name = _located(path)
                with where.open_input_file(name) as file:
                    how = audio.layout(lambda at, n: file.read_at(min(n, max(0, size - at)), at), size)
                if how is not None and how.known:
                    rows.append((path, key, how.tag, how.rate, how.channels, how.bits, how.begin, how.end))
            yield pd.DataFrame(rows, columns=["path", "key", "tag", "rate", "channels", "bits", "begin", "end"])

    return files.select("path", F.col("key").cast("string").alias("key"), "bytes").mapInPandas(run, "path string, key string, tag int, rate int, channels int, bits int, begin long, end long")


def resampled(read, n: int, rate: int, wanted: int, low: int, high: int) -> np.ndarray:
    """Samples low to high of what audio.resample makes of n samples, of which read(a, b) gives some."""
    if rate == wanted:
        return read(low, min(high, n))
    high = min(high, int(n * wanted / rate))
    if high <= low:
        return np.empty(0)
    at = np.arange(low, high) * rate / wanted
    k = max(1, rate // wanted)
    first, last = int(at[0]), min(n, int(at[-1]) + 2)
    left, right = (k - 1) - (k - 1) // 2, (k - 1) // 2  # of a mean of k, what it takes from before and behind
    a, b = max(0, first - left), min(n, last + right)
    x = read(a, b)
    if k > 1:
        x = np.convolve(np.pad(x, (left - (first - a), right - (b - last))), np.ones(k) / k, mode="valid")
    return np.interp(at, np.arange(first, last), x[: last - first])


def read_ranges(files: DataFrame, key: str = "filename", target: int | None = 22050, chunk: int = 1 << 18, halo: int = 1536) -> DataFrame:
    """As audio.decode_pcm, from files (path, bytes, ...) that are where they are: each chunk is read by itself, so that one
    file is in as many tasks as it has chunks and no task holds more of it than a chunk."""
    told = layouts(files.select("path", F.col(key).alias("key"), "bytes"))
    frames = F.floor((F.col("end") - F.col("begin")) / (F.col("bits") / 8 * F.col("channels")))
    wanted = F.floor(frames * target / F.col("rate")) if target else frames
    out = F.when(F.col("rate") == F.lit(target or 0), frames).otherwise(wanted)
    chunks = told.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(out / chunk) - 1).cast("int"))))
    spread = chunks.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "chunk_idx")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                how = audio.Layout(r.tag, r.rate, r.channels, r.bits, r.begin, r.end)
                where, name = _located(r.path)
                with where.open_input_file(name) as file:
                    read = lambda a, b: audio.samples_of(file.read_at(max(0, b - a) * how.frame, how.begin + a * how.frame), how)  # noqa: B023, E731
                    at = r.chunk_idx * chunk
                    low = max(0, at - audio.LEAD)
                    x = resampled(read, how.frames, how.rate, target or how.rate, low, at + chunk + halo).astype(np.float32)
                yield pd.DataFrame({"recording_id": [r.key], "sr": [target or how.rate], "chunk_idx": [r.chunk_idx], "first": [at], "samples": [x[at - low :]], "before": [x[: at - low]]})

    return spread.mapInPandas(run, audio.CHUNK)


def save_files(files: DataFrame, folder: str) -> None:
    """Writes files (name, content) to a folder that all tasks reach; each appears whole, also when it is written again."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, root = _located(folder)
        where.create_dir(root, recursive=True)
        for number, part in enumerate(parts):
            for name, content in zip(part["name"], part["content"]):
                with where.open_output_stream(f"{root}/{name}.{number}.part") as stream:
                    stream.write(bytes(content))
                where.move(f"{root}/{name}.{number}.part", f"{root}/{name}")
            yield part[["name"]]

    files.select("name", "content").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()
