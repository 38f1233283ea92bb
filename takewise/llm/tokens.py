"""Token ids of whole documents, their bytes again, and the tokens of each section of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from takewise.llm import bpe
from takewise.llm import text as tx

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _lists(values: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(values, kind))


def _gathered(batches: Iterator[pa.RecordBatch], size: int = tx.BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about size bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held and sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def corpus_words(docs: DataFrame, text: str = "text", ranks: str = BYTE_RANKS, pattern: str = public_tokenizers.PATTERN, shared: int = 100_000, longest: int = 64) -> tuple[DataFrame, DataFrame]:
    """(piece, ids) of words found in several blocks of documents, each replayed once for the whole corpus.

    A word is a match of pattern that is no token as it stands. Of those of at most longest characters the commonest are
    taken, no more than shared: words are counted per number of blocks that hold them, and the least number is chosen from
    which on they are few enough. Each task replays all merges over its share of them. The second table holds the counts
    and is to be unpersisted when the first has been read.
    """

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, met = bpe.byte_encoder(ranks, pattern)[0], set()
        for _, texts in tx.blocks(batches):
            need = [piece for piece in encoder.missing([t.decode() for t in texts], met) if len(piece) <= longest]
            yield pa.RecordBatch.from_arrays([pa.array(need, pa.string())], names=["piece"])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.byte_encoder(ranks, pattern)[0]
        for batch in _gathered(batches):
            ids, at = encoder.merged(tx.binary(batch, "piece"))
            yield pa.RecordBatch.from_arrays([batch.column("piece"), _lists(ids.astype(np.int32), np.diff(np.append(at, len(ids))).tolist(), pa.int32())], names=["piece", "ids"])

    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.length("text") > 0)
    counted = rows.mapInArrow(wanted, "piece string").groupBy("piece").agg(F.count("*").alias("n")).where("n > 1").persist(StorageLevel.DISK_ONLY)
    # the numbers of blocks in steps of an eighth of a doubling, so there are a few hundred at any size
    step = F.floor(8 * F.log2("n"))
    least, total = 1 << 30, 0
    for row in counted.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += row["count"]
        if total > shared:
            break
        least = row.step
    return counted.where(step >= least).select("piece").mapInArrow(replay, "piece string, ids array<int>"), counted


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = BYTE_RANKS, pattern: str = public_tokenizers.PATTERN, shared: int = 100_000) -> DataFrame:
    """(doc_id, ids array<int>) of whole texts by byte-level merges, each match of pattern by itself.

    A match that is a token as it stands needs no merges. Of the others, words that several blocks of documents hold are
    replayed once for the corpus (corpus_words) and broadcast: shared words of 64 characters at most, whatever the corpus.
    A word that one block alone holds, or that is longer or not among those shared, is replayed with its block, all new
    words of a block at once. A null or empty text has no ids. Special tokens' strings are ordinary text. A row is encoded
    by itself, so repeated rows and ties give equal ids; a text of any length is taken whole; an empty table gives an
    empty result.
    """
    words, counted = corpus_words(docs, text, ranks, pattern, shared)
    table = words.toArrow()
    counted.unpersist()
    lists = table.column("ids").combine_chunks()
    held = docs.sparkSession.sparkContext.broadcast((table.column("piece").to_pylist(), lists.flatten().to_numpy(), lists.value_lengths().to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.byte_encoder(ranks, pattern)[0]
        if encoder.base[0] is not held.value[0]:
            encoder.begin(*held.value)
        for ids, texts in tx.blocks(batches):
            values, lengths = encoder.ids([t.decode() for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(values.view(np.int32), lengths, pa.int32())], names=["doc_id", "ids"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str = BYTE_RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes that the ids stand for. Null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, back, start = bpe.byte_encoder(ranks, pattern)
        size = np.diff(start)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lists = part.column("ids")
                values = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
                stops = np.append(0, np.cumsum(size[values]))[np.append(0, ends)]
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(stops), pa.py_buffer(tx.ragged(back, start[values], size[values]))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, held.cast(pa.binary())], names=["doc_id", "ids", "decoded"])

    return tx.only(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the lines of a text, each with the line break that ends it."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10) + 1
    if not len(ends) or ends[-1] < len(text):
        ends = np.append(ends, len(text))
    starts = np.append(0, ends[:-1])
    return starts[: len(ends)], ends


def given_sections(spans: list[dict | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, start, end) of the spans that can hold characters, in order of start and without overlap.

    A span that is null, has a null end or holds nothing is left out; a character in several spans belongs to the one that
    starts first, the earlier in the list of two with the same start, and a span left with nothing is left out too.
    """
    some = [(s["start"], k, s["end"]) for k, s in enumerate(spans) if s and s["start"] is not None and s["end"] is not None]
    starts, place, ends = np.array(sorted(some), np.int64).reshape(-1, 3).T
    before = np.maximum.accumulate(np.append(np.iinfo(np.int64).min, ends))[:-1]
    starts = np.maximum(starts, before)
    held = starts < ends
    return place[held], starts[held], ends[held]


def allocate(token_start: np.ndarray, token_end: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The section of each token, -1 for none: the one with most of its characters, the earlier of two with as many.

    Both tokens and sections are in order of start; sections don't overlap. A token that lies in one section alone is
    found by one search; the sections that a crossing token touches are gone through in order.
    """
    if not len(starts) or not len(token_start):
        return np.full(len(token_start), -1, np.int64)
    first = np.searchsorted(ends, token_start, side="right")
    last = np.searchsorted(starts, token_end, side="left") - 1
    best, most = np.full(len(token_start), -1, np.int64), np.zeros(len(token_start), np.int64)
    for step in range(int(np.maximum(last - first, -1).max()) + 1):
        at = first + step
        inside = np.flatnonzero(at <= last)
        k = at[inside]
        common = np.minimum(token_end[inside], ends[k]) - np.maximum(token_start[inside], starts[k])
        better = common > most[inside]
        best[inside[better]], most[inside[better]] = k[better], common[better]
    return best


def section_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spans: str | None = None, ranks: str = BYTE_RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Tokens of each section, from one encoding of the whole document: a row per document and section.

    spans names a column array<struct<start int, end int>> of character spans in any order; a character in several of
    them belongs to the one that starts first, and a span that is null, has a null field or holds nothing has a row of 0
    tokens. Without it the sections are the lines, each with its line break. A token's span runs from the character that holds its first
    byte to the end of the one that holds its last byte. It counts for the section that holds most of its characters,
    the earlier one if two hold as many, none if it lies outside all. n_crossing of a section are those of its tokens
    that also lie in another. A null or empty text has no rows by lines, and rows of 0 tokens by given spans; null
    spans are none. The counts of a document's sections never add up to more than its tokens. A text of any
    length is taken whole; repeated rows give their rows each; an empty table has none; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _, first = bpe.byte_encoder(ranks, pattern)
        sizes, kinds = np.diff(first), [pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 2]
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            given = batch.column("spans").to_pylist() if spans else None
            at = 0
            while at < len(ids):
                end, held = at, 0
                while end < len(ids) and held < tx.BLOCK_BYTES:
                    held += len(texts[end]) + 64
                    end += 1
                out: list[list[pa.Array]] = []
                whole, lengths = encoder.ids(texts[at:end])
                for k, stop in zip(range(at, end), np.cumsum(lengths).tolist()):
                    if spans:
                        place, starts, ends = given_sections(given[k] or [])
                        n, bounds = len(given[k] or []), [[s and s[f] for s in given[k] or ()] for f in ("start", "end")]
                    elif texts[k]:
                        starts, ends = line_sections(texts[k])
                        place, n, bounds = np.arange(len(starts)), len(starts), [starts, ends]
                    else:
                        continue
                    values = whole[stop - lengths[k - at] : stop]
                    ends_at = np.cumsum(sizes[values])
                    raw = np.frombuffer(texts[k].encode(), np.uint8)
                    chars = np.cumsum((raw & 0xC0) != 0x80)
                    start_char, end_char = (chars[ends_at - sizes[values]] - 1, chars[ends_at - 1]) if len(raw) else (ends_at, ends_at)
                    own = allocate(start_char, end_char, starts, ends)
                    inside = own >= 0
                    crossing = inside.copy()
                    crossing[inside] = (start_char[inside] < starts[own[inside]]) | (end_char[inside] > ends[own[inside]])
                    counts = [np.bincount(place[own[some]], minlength=n) for some in (inside, crossing)]
                    out.append([pa.array(x, kind) for x, kind in zip(([ids[k]] * n, np.arange(n), *bounds, *counts), kinds)])
                columns = [pa.concat_arrays(x) for x in zip(*out)] if out else [pa.array([], kind) for kind in kinds]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])
                at = end

    columns = [F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")]
    if spans:
        columns.append(F.col(f"`{spans}`").alias("spans"))
    return docs.select(*columns).mapInArrow(run, "doc_id long, section int, start int, end int, n_tokens long, n_crossing long")
