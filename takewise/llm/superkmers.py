"""Repeated windows of documents, found exactly by sending runs of windows that share a minimiser to one bucket.

A window is a fixed number of consecutive symbols (words or bytes). Of the short grams inside a window the one with the
least hash is its minimiser, the leftmost of equal ones; equal windows have equal minimisers. Neighbouring windows
mostly share one, so they travel as one string. Three shuffles do the work:

1. Minimisers alone go to buckets. One that occurs once in the corpus cannot belong to a repeated window.
2. The runs with the other minimisers go to the minimiser's bucket as packed strings; the bucket finds equal windows.
3. Spans to remove go back to their documents.

A task sends what it meets twice only once: of equal strings in a block of documents the earliest goes to the bucket,
and all windows of the others are known to be repeated there and then. So a passage that a third of all documents
share sends its bucket one string per block of documents, and no task gathers the documents that hold it.

A short phrase in many documents with different neighbours would still gather a string from each of them. So grams that
are common in a sample of documents come last in the order that minimisers are taken by: a window has one only if all
its grams are common, as in a repeated passage. Any order gives the same result; the sample only spreads the work.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from takewise.llm import text as tx
from takewise.session import checkpoint

_LOW = np.uint64((1 << 24) - 1)
_TOP = np.uint64(1 << 63)
#: Documents that are looked at for common grams, and in how many of them a common one occurs.
SAMPLE, COMMON = 20_000, 20
_CHUNK = 1 << 20
_RUNS = "doc_id long, start array<int>, many array<int>, key array<long>"
_ARROW_RUNS = ["doc_id", "start", "many", "key"]


@dataclass(frozen=True)
class Units:
    """How texts fall into symbols: cut(text) gives them, hashes(symbols) the hash of each gram, slice packs a run."""

    window: int
    gram: int
    cut: Callable
    hashes: Callable
    slice: Callable
    labels: Callable


class Order:
    """Ranks of grams: by hash, the common ones behind all others."""

    def __init__(self, common: np.ndarray):
        self.common = np.sort(common)
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.common >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        ranks = hashes >> np.uint64(1) & ~_LOW
        if len(self.common):
            maybe = np.flatnonzero(self.hint[(hashes >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.common, hashes[maybe]), len(self.common) - 1)
            ranks[maybe[self.common[at] == hashes[maybe]]] |= _TOP
        return ranks


def minimiser_runs(hashes: np.ndarray, grams: int, order: Order = Order(np.empty(0, np.uint64))) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of grams hashes each that share a minimiser: first window, number of windows, minimiser's hash."""
    windows = len(hashes) - grams + 1
    parts = []
    for at in range(0, max(windows, 0), _CHUNK):
        part = hashes[at : min(at + _CHUNK, windows) + grams - 1]
        least, size = order(part) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * size <= grams:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < grams:
            least = np.minimum(least[: len(least) - (grams - size)], least[grams - size :])
        place = (least & _LOW).astype(np.int64)
        starts = np.append(0, np.flatnonzero(place[1:] != place[:-1]) + 1)
        parts.append((starts + at, np.diff(np.append(starts, len(place))), part[place[starts]]))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def pack(*arrays: np.ndarray, data: bytes = b"") -> bytes:
    """Arrays and bytes as one compressed string; the bytes of an array's numbers are dealt by significance."""
    parts = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if len(a) else b"" for a in arrays]
    head = struct.pack(f"<{len(arrays)}q", *map(len, arrays))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts) + data)


def unpack(blob: bytes, *kinds: str) -> tuple:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    lengths, at, out = struct.unpack_from(f"<{len(kinds)}q", raw), 8 * len(kinds), []
    for n, kind in zip(lengths, kinds):
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel() if n else np.empty(0, kind))
        at += n * size
    return (*out, raw[at:])


def _dealt(buckets: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(buckets, kind="stable")
    return order, np.searchsorted(buckets[order], np.arange(count + 1))


def _by_document(doc: np.ndarray, start: np.ndarray, many: np.ndarray, key: np.ndarray) -> pa.Table:
    order = np.argsort(doc, kind="stable")
    doc, first = doc[order], np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    offsets = pa.array(np.append(np.flatnonzero(first), len(doc)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order], kind)) for x, kind in ((start, pa.int32()), (many, pa.int32()), (key, pa.int64()))]
    return pa.table([pa.array(doc[first], pa.int64()), *lists], names=_ARROW_RUNS)


_SEED = ("<u8", "<i8", "<i4", "<i4", "<u8", "<i8", "<i4", "<i4", "<u8")


def _common(docs: DataFrame, units: Units, documents: int) -> np.ndarray:
    """The hashes of grams in COMMON or more of about SAMPLE documents chosen by a hash of doc_id.

    A sample has grams for COMMON of them each at most, whatever the corpus. Only grams whose hash is low enough to be a
    minimiser of some window, but for one in 20,000, are counted.
    """
    low = np.uint64(min((1 << 64) - 1, 10 * (1 << 64) // (units.window - units.gram + 1)))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(1, documents)) * (1 << 30))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = units.hashes()
        for _, texts in tx.blocks(batches):
            found = []
            for text in texts:
                own = hashes(units.cut(text))
                found.append(np.unique(own[own <= low]))
            gram, many = np.unique(np.concatenate(found), return_counts=True)
            often = many > 1
            yield pa.RecordBatch.from_arrays([pa.array(gram[often].view(np.int64)), pa.array(many[often], pa.int64())], names=["gram", "many"])

    common = chosen.mapInArrow(count, "gram long, many long").groupBy("gram").agg(F.sum("many").alias("many")).where(F.col("many") >= COMMON)
    return np.array([r.gram for r in common.select("gram").collect()], np.int64).view(np.uint64)


def _seeds(units: Units, buckets: int, ranks: Order) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = units.hashes()
        grams = units.window - units.gram + 1
        for ids, texts in tx.blocks(batches):
            found, counts = [], []
            for text in texts:
                got = minimiser_runs(hashes(units.cut(text)), grams, ranks)
                found.append(got)
                counts.append(len(got[0]))
            start, many, key = (np.concatenate(x) for x in zip(*found))
            doc = np.repeat(np.array(ids, np.int64), counts)
            order = np.argsort(key, kind="stable")
            new = np.append(True, key[order[1:]] != key[order[:-1]])[: len(order)]
            size = np.diff(np.append(np.flatnonzero(new), len(order)))
            alone, head = np.zeros(len(order), bool), order[new]
            alone[head[size == 1]] = True
            known, twice = key[head[size > 1]], ~alone
            one = (key[alone], doc[alone], start[alone], many[alone])
            own = (doc[twice], start[twice], many[twice], key[twice])
            cuts = [_dealt((one[0] % np.uint64(buckets)).astype(np.int64), buckets), _dealt((known % np.uint64(buckets)).astype(np.int64), buckets), _dealt((tx.mixed(own[0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), buckets)]
            at, blobs = [], []
            for b in range(buckets):
                pick = [o[c[b] : c[b + 1]] for o, c in cuts]
                if any(map(len, pick)):
                    at.append(b)
                    blobs.append(pack(one[0][pick[0]], one[1][pick[0]], one[2][pick[0]].astype("<i4"), one[3][pick[0]].astype("<i4"), known[pick[1]], own[0][pick[2]], own[1][pick[2]].astype("<i4"), own[2][pick[2]].astype("<i4"), own[3][pick[2]]))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return run


def _repeated_minimisers(table: pa.Table) -> pa.Table:
    rows = [unpack(b, *_SEED)[:-1] for b in table.column("blob").to_pylist()]
    key, doc, start, many, known, own_doc, own_start, own_many, own_key = (np.concatenate(x) for x in zip(*rows))
    every = np.sort(np.concatenate([key, known]))
    often = np.unique(every[1:][every[1:] == every[:-1]])
    often = np.union1d(often, known)
    at = np.minimum(np.searchsorted(often, key), max(0, len(often) - 1))
    hit = often[at] == key if len(often) else np.zeros(len(key), bool)
    return _by_document(*(np.concatenate([a[hit], b]) for a, b in ((doc, own_doc), (start, own_start), (many, own_many))), np.concatenate([key[hit], own_key]).view(np.int64))


_STRINGS = ("<u8", "<i8", "<i4", "<i4", "<i4", "<i8", "<i4", "<i4")


def _strings(units: Units, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(docs: list[tuple[int, bytes, list]]) -> pa.RecordBatch:
            held: dict[bytes, int] = {}
            rows, texts, own = [], [], []
            for doc, text, parts in sorted(docs, key=lambda x: x[0]):
                symbols = units.cut(text)
                runs = {(s, m): k for p in parts for s, m, k in zip(p["start"], p["many"], p["key"])}
                for (s, m), k in sorted(runs.items()):
                    string = units.slice(symbols, s, m + units.window - 1)
                    if held.setdefault(string, len(texts)) == len(texts):
                        texts.append(string)
                        rows.append((k, doc, s, m))
                    elif rows[held[string]][1:3] != (doc, s):
                        own.append((doc, s, m))
            key, doc, start, many = np.array(rows, np.int64).reshape(-1, 4).T
            key, own_doc, own_start, own_many = key.astype(np.uint64), *np.array(own, np.int64).reshape(-1, 3).T
            cuts = [_dealt((key % np.uint64(buckets)).astype(np.int64), buckets), _dealt((tx.mixed(own_doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), buckets)]
            at, blobs = [], []
            for b in range(buckets):
                one, two = (o[c[b] : c[b + 1]] for o, c in cuts)
                if len(one) or len(two):
                    strings = [texts[i] for i in one.tolist()]
                    size = np.fromiter(map(len, strings), np.int32, len(strings))
                    at.append(b)
                    blobs.append(pack(key[one], doc[one], *(x[one].astype("<i4") for x in (start, many)), size, own_doc[two], *(x[two].astype("<i4") for x in (own_start, own_many)), data=b"".join(strings)))
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        docs, held = [], 0
        for batch in batches:
            for doc, text, parts in zip(batch.column("doc_id").to_pylist(), tx.binary(batch, "text"), batch.column("runs")):
                docs.append((doc, text, parts.as_py()))
                held += len(text)
                if held >= tx.BLOCK_BYTES:
                    yield send(docs)
                    docs, held = [], 0
        if docs:
            yield send(docs)

    return run


def _repeated_windows(units: Units) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        rows = [unpack(b, *_STRINGS) for b in table.column("blob").to_pylist()]
        key, doc, start, many, size, own_doc, own_start, own_many = (np.concatenate(x) for x in list(zip(*rows))[:-1])
        strings: list[bytes] = []
        for row in rows:
            data, ends = row[-1], np.cumsum(row[4], dtype=np.int64).tolist()
            strings += [data[a:b] for a, b in zip([0, *ends], ends)]
        numbers = tx.Numbering()
        which = np.fromiter(map(numbers.__getitem__, strings), np.int64, len(strings))
        order = np.lexsort((start, doc, which))
        first = np.append(True, which[order[1:]] != which[order[:-1]])[: len(order)]
        lead = order[first]  # the earliest row of each string, by the string's number
        same = (doc == doc[lead[which]]) & (start == start[lead[which]]) if len(which) else np.zeros(0, bool)
        copies = np.flatnonzero(~same)
        out = [(doc[copies], start[copies], many[copies]), (own_doc, own_start, own_many)]

        by_key = lead[np.argsort(key[lead], kind="stable")]
        keys = key[by_key]
        shared = np.zeros(len(keys), bool)
        if len(keys):
            equal = keys[1:] == keys[:-1]
            shared[1:] |= equal
            shared[:-1] |= equal
        rest = by_key[shared]
        if len(rest):
            n = many[rest].astype(np.int64)
            label = units.labels([strings[i] for i in rest.tolist()], key[rest], n)
            string = np.repeat(np.arange(len(rest)), n)
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            place = start[rest][string] + offset
            order = np.lexsort((place, doc[rest][string], label))
            again = np.append(False, label[order[1:]] == label[order[:-1]]) & (label[order] >= 0)
            hit = np.zeros(len(label), bool)
            hit[order] = again
            step = np.flatnonzero(hit)
            if len(step):
                new = np.append(True, (np.diff(step) > 1) | (string[step[1:]] != string[step[:-1]]))
                begin = step[new]
                out.append((doc[rest][string[begin]], place[begin], np.diff(np.append(np.flatnonzero(new), len(step)))))
        doc, start, many = (np.concatenate(x) for x in zip(*out))
        return _by_document(doc, start, many, np.zeros(len(doc), np.int64))

    return run


def _per_document(rows: DataFrame) -> DataFrame:
    """One row per document; a document has no more of them than buckets or windows."""
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("start", "many", "key")).alias("runs"))


def _placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, ...) and their number; if different texts share a doc_id, then with place in its stead: numbers in
    order of doc_id and then of the texts' digests, and doc_id itself as own_id."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("many"))
    seen = ids.agg(F.sum("many").alias("rows"), F.max("many").alias("most")).first()
    if (seen.most or 0) < 2:
        return docs, seen.rows or 0
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    numbered = checkpoint(docs.select("doc_id", digest).distinct().orderBy("doc_id", "digest").withColumn("place", F.monotonically_increasing_id()))
    placed = docs.select("*", digest).join(numbered, ["doc_id", "digest"]).drop("digest")
    return placed.withColumnRenamed("doc_id", "own_id").withColumnRenamed("place", "doc_id"), seen.rows


def repeated(docs: DataFrame, units: Units, others: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, and the columns others) with runs: where windows start that also start earlier; null where there are none.

    Earlier is a smaller doc_id, or the same document and an earlier start. Equal rows are one document; different texts
    of one doc_id are documents in order of their SHA-256. Rows without doc_id stay, but are compared with nothing. Null
    texts have no windows. A text of any length is cut whole, in one task.
    """
    every = tx.only(docs, "doc_id", "text", *(others or []))
    if every.schema["doc_id"].dataType != LongType():  # a cast of what is long already keeps Spark from shuffling the texts only once
        every = every.withColumn("doc_id", F.col("doc_id").cast("long"))
    whole, documents = _placed(every.where(F.col("doc_id").isNotNull()))
    docs = whole.select("doc_id", "text")
    buckets = tx.partitions(docs, 4)
    order = Order(_common(docs, units, documents))
    found = docs.mapInArrow(_seeds(units, buckets, order), "bucket int, blob binary").groupBy("bucket").applyInArrow(_repeated_minimisers, _RUNS)
    strings = docs.join(_per_document(found), "doc_id").mapInArrow(_strings(units, buckets), "bucket int, blob binary")
    windows = _per_document(strings.groupBy("bucket").applyInArrow(_repeated_windows(units), _RUNS))
    out = whole.join(windows, "doc_id", "left")
    if "own_id" in whole.columns:
        out = out.drop("doc_id").withColumnRenamed("own_id", "doc_id")
    nameless = every.where(F.col("doc_id").isNull()).withColumn("runs", F.lit(None).cast(windows.schema["runs"].dataType))
    return out.unionByName(nameless)


def covered(parts: list[dict] | None, window: int, length: int) -> list[tuple[int, int]]:
    """The maximal runs of symbols inside the windows that parts names, within a text of length symbols."""
    runs = sorted((s, s + m + window - 1) for p in parts or () for s, m in zip(p["start"], p["many"]))
    out: list[tuple[int, int]] = []
    for a, b in runs:
        b = min(b, length)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
