"""Words, blocks of documents and the hashes that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a task holds at once, in bytes.
BLOCK_BYTES = 8 << 20

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of whatever name don't matter."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as bytes; null becomes empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """(doc_id, text) batches as lists of whole documents of about size bytes."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), binary(batch, "text")):
            ids.append(doc)
            texts.append(text)
            held += len(text) + 64
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


class Numbering(dict):
    """Words by number, in order of first use."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


class WordHashes:
    """64-bit hashes of words, kept for the words of a block."""

    def __init__(self, most: int = 150_000):
        self.most = most
        self.numbers, self.table = Numbering(), np.empty(0, np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.numbers) > self.most:
            self.numbers, self.table = Numbering(), np.empty(0, np.uint64)
        known = len(self.numbers)
        codes = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if len(self.numbers) > known:
            if len(self.numbers) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros(max(1024, len(self.numbers)), np.uint64)])
            fresh = list(self.numbers)[known:] if known == 0 else [w for w in dict.fromkeys(words) if self.numbers[w] >= known]
            self.table[known : known + len(fresh)] = [xxhash.xxh3_64_intdigest(w) for w in fresh]
        return self.table[codes]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def joined(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of width consecutive hashes."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out + hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return mixed(out)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of a document, sorted: with fewer words the whole sequence is one, without words none is."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    return np.unique(joined(words, min(width, len(words))))


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, part: int = 1 << 20) -> np.ndarray:
    """The runs of values that begin at starts, one after the other; indices are made for about part values at a time."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out, at = np.empty(total, values.dtype), 0
    shift = starts - (ends - lengths)
    while at < len(ends):
        low = int(ends[at] - lengths[at])
        to = max(at + 1, int(np.searchsorted(ends, low + part, side="right")))
        high = int(ends[to - 1])
        out[low:high] = values[np.arange(low, high) + np.repeat(shift[at:to], lengths[at:to])]
        at = to
    return out


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: no more than rows of them go to a Python worker at once, whatever the session's larger setting says."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def partitions(df: DataFrame, times: int = 1) -> int:
    """The cluster's number of shuffle partitions, which its owner sets to suit the input."""
    return times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


