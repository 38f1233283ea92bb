"""Audio files as rows: what there is, and their samples in chunks."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_audio(spark: SparkSession, root: str) -> DataFrame:
    """(path, filename, suffix, bytes, file_hash, content) of files that end in exactly .wav or .WAV, at any depth."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,WAV}").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), F.regexp_extract("path", r"(\.[^.]*)$", 1).alias("suffix"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("file_hash"), "content")


#: Format tags of samples as whole numbers and as floating point, and of a header that gives the tag further on.
_WHOLE, _FLOAT, _FURTHER = 1, 3, 0xFFFE


@dataclass(frozen=True)
class Layout:
    """What a file's header says: where its samples begin and end, and how they are written."""

    tag: int
    rate: int
    channels: int
    bits: int
    begin: int
    end: int

    @property
    def frame(self) -> int:
        """Bytes of one sample of all channels."""
        return self.bits // 8 * self.channels

    @property
    def known(self) -> bool:
        return self.rate > 0 and self.channels > 0 and (self.tag, self.bits) in ((_WHOLE, 8), (_WHOLE, 16), (_WHOLE, 24), (_WHOLE, 32), (_FLOAT, 32), (_FLOAT, 64))

    @property
    def frames(self) -> int:
        return max(0, self.end - self.begin) // self.frame if self.known else 0


def layout(read: Callable[[int, int], bytes], size: int) -> Layout | None:
    """The layout of a file of size bytes of which read(at, n) gives n; None if it isn't a WAV file with samples."""
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, told = 12, None
    while at + 8 <= size:
        chunk = read(at, 8)
        length = struct.unpack("<I", chunk[4:])[0] if len(chunk) == 8 else 0
        if chunk[:4] == b"fmt ":
            body = read(at + 8, min(length, 40))
            if len(body) < 16:
                return None
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            told = (struct.unpack_from("<H", body, 24)[0] if tag == _FURTHER and len(body) >= 26 else tag, rate, channels, bits)
        elif chunk[:4] == b"data":
            return Layout(*told, at + 8, min(size, at + 8 + length)) if told else None
        at += 8 + length + length % 2
    return None


def samples_of(data: bytes, how: Layout) -> np.ndarray:
    """Mono samples of whole frames, -1 to 1 for whole numbers; channels are averaged."""
    data = data[: len(data) // how.frame * how.frame]
    if how.tag == _FLOAT:
        values = np.frombuffer(data, f"<f{how.bits // 8}").astype(float)
    elif how.bits == 8:  # the only width without a sign
        values = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif how.bits == 24:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        values = (raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) / 2.0**31
    else:
        values = np.frombuffer(data, f"<i{how.bits // 8}") / 2.0 ** (how.bits - 1)
    return values.reshape(-1, how.channels).mean(axis=1) if len(values) else values


def pcm(content: bytes) -> tuple[int, np.ndarray] | None:
    """Sampling rate and mono samples of a WAV file: whole numbers of 8, 16, 24 or 32 bits or floating point; None for others."""
    how = layout(lambda at, n: content[at : at + n], len(content))
    if how is None or not how.known:
        return None
    return how.rate, samples_of(content[how.begin : how.end], how)


def resample(samples: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """Linear interpolation at another rate, behind a mean filter where the rate falls."""
    if rate == wanted or not len(samples):
        return samples
    k = rate // wanted
    if k > 1:
        samples = np.convolve(samples, np.ones(k) / k, mode="same")
    return np.interp(np.arange(int(len(samples) * wanted / rate)) * rate / wanted, np.arange(len(samples)), samples)


#: Samples that a chunk carries from before its start, so that a frame there knows the one before it.
LEAD = 512

CHUNK = "recording_id string, sr int, chunk_idx int, first long, samples array<float>, before array<float>"
#: Samples of the chunks that a batch holds, some more by the last of them.
HELD = 1 << 20


def chunk_batches(chunks: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Chunks, as tuples of CHUNK's columns, in batches of a few megabytes."""

    def lists(parts: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, parts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).astype(np.float32)))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        plain = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*plain, lists(columns[4]), lists(columns[5])], [c.split()[0] for c in CHUNK.split(", ")])

    rows, held = [], 0
    for row in chunks:
        rows.append(row)
        held += len(row[4])
        if held >= HELD:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


def decode_pcm(files: DataFrame, key: str = "file_hash", target: int | None = 22050, chunk: int = 1 << 18, halo: int = 1536) -> DataFrame:
    """(recording_id, sr, chunk_idx, first, samples, before): chunks that run halo samples into the next one, and LEAD samples
    from before each (none for the first).

    What isn't a WAV file, or one of other codes than whole numbers and floating point, gives no rows. One file at a time is
    held by a task; wav.read_ranges reads large files by ranges instead.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, content in zip(part.column("key"), part.column("content")):
                read = pcm(content.as_py()) if content.is_valid else None
                if read is None:
                    continue
                rate, x = read
                if target and rate:
                    x, rate = resample(x, rate, target), target
                yield from chunk_batches((name.as_py(), rate, i, at, x[at : at + chunk + halo], x[max(0, at - LEAD) : at]) for i, at in enumerate(range(0, max(len(x), 1), chunk)))

    return files.select(F.col(key).cast("string").alias("key"), "content").mapInArrow(run, CHUNK)
