"""Documents packed into training sequences of a fixed number of tokens."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from takewise.llm import bpe
from takewise.llm import text as tx
from takewise.session import checkpoint

WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0, model: str = WORD_MODEL) -> DataFrame:
    """(doc_id, piece, start, length, ids binary): each document's ids and the id end after them, cut at capacity.

    ids are little-endian unsigned 32-bit numbers. A null or empty text is the id end alone. Each row is a document by
    itself, repeated rows too; an empty table has no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail, step = bpe.word_encoder(model), np.array([end], "<u4"), 4 * capacity
        for ids, texts in tx.blocks(batches):
            out: list[tuple] = []
            values, lengths = encoder.ids(texts)
            for doc, stop, many in zip(ids, np.cumsum(lengths).tolist(), lengths):
                raw = np.append(values[stop - many : stop], tail).tobytes()
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    out.append((doc, k, at // 4, len(part) // 4, part))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids"])

    got = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return got.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """How many sequences hold which lengths: [(sequences, [(length, times), ...]), ...], from the number of pieces of each length.

    Pieces over a third of the capacity come first: the longest open sequence by sequence, each with the longest other
    such piece that still fits, so a sequence has two of them at most. The shorter ones follow, the longest first, each
    into the smallest gap that holds it, else into a new sequence. Equal pieces and equal gaps are dealt with together,
    so the work depends on capacity alone.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    gaps: dict[int, list[list]] = {}
    open_gaps: list[int] = []
    full: list[tuple[int, list[tuple[int, int]]]] = []

    def keep(gap: int, many: int, held: list[tuple[int, int]]) -> None:
        if not many:
            return
        if gap == 0:
            full.append((many, held))
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(open_gaps, gap)
        gaps[gap].append([many, held])

    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        if k < 0:
            keep(capacity - a, left[a], [(a, 1)])
            large.pop()
            continue
        b = large[k]
        if a == b:
            keep(capacity - 2 * a, left[a] // 2, [(a, 2)])
            left[a] %= 2
            if left[a]:  # one is left over; it takes the next shorter one, if there is any
                large.pop()
                if large:
                    b = large[-1]
                    keep(capacity - a - b, 1, [(a, 1), (b, 1)])
                    left[b] -= 1
                    if not left[b]:
                        large.pop()
                else:
                    keep(capacity - a, 1, [(a, 1)])
            else:
                large.pop()
            continue
        many = min(left[a], left[b])
        keep(capacity - a - b, many, [(a, 1), (b, 1)])
        for n in (a, b):
            left[n] -= many
            if not left[n]:
                large.remove(n)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        rest = left[n]
        while rest:
            k = bisect_left(open_gaps, n)
            if k == len(open_gaps):
                gap, group, = capacity, [-(-rest // (capacity // n)), []]
            else:
                gap = open_gaps[k]
                group = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[k]
            many, held = group
            fit = gap // n
            filled = min(many, rest // fit)
            keep(gap - fit * n, filled, [*held, (n, fit)])
            rest -= filled * fit
            many -= filled
            if many and rest:  # fewer than fit are left: they share one gap
                keep(gap - rest * n, 1, [*held, (n, rest)])
                rest, many = 0, many - 1
            if held:
                keep(gap, many, held)
    return full + [(many, held) for gap in open_gaps for many, held in gaps[gap]]


def best_fit(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """items with sequence_id and offset: the place of each piece (doc_id, piece, start, length, ...).

    Only the number of pieces of each length, at most capacity numbers, goes to the driver, which plans how many
    sequences hold which lengths. The pieces of a length are then numbered, in salted parts since one length may be that
    of very many pieces, and the number alone says which sequence a piece goes to.
    """
    items = checkpoint(items)
    salts = tx.partitions(items)
    order = [F.col(c) for c in items.columns if c != "length"]
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    parts = items.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("many"))
    parts = checkpoint(parts)
    counts = {r.length: r.many for r in parts.groupBy("length").agg(F.sum("many").alias("many")).collect()}

    slots, used, sequence = [], dict.fromkeys(counts, 0), 0
    for many, held in plan(counts, capacity):
        offset = 0
        for length, times in held:
            slots.append((length, used[length], times, sequence, offset))
            used[length] += many * times
            offset += length * times
        sequence += many
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)

    before = F.sum("many").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    first = parts.select(F.col("length"), "salt", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1
    ranked = items.withColumn("number", number.cast("long")).join(first, ["length", "salt"]).withColumn("number", F.col("number") + F.col("before")).drop("salt", "before")
    names = ranked.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            slot = table[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            step = rank - slot[:, 1]
            columns = [batch.column(c) for c in names if c != "number"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(slot[:, 3] + step // slot[:, 2]), pa.array(slot[:, 4] + step % slot[:, 2] * length)], names=[*[c for c in names if c != "number"], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "number")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, model: str = WORD_MODEL) -> DataFrame:
    """Each document's pieces and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, doc_id, text, capacity, 0, model)
    return best_fit(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
