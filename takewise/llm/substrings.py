"""Passages of words that documents repeat, removed wherever they also start earlier."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takewise.llm import superkmers
from takewise.llm import text as tx

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _window_labels(window: int):
    def labels(strings: list[bytes], keys: np.ndarray, many: np.ndarray) -> np.ndarray:
        """The windows of all strings by number; equal windows have equal numbers. They are sorted by their words."""
        numbers = tx.Numbering()
        codes = [np.fromiter(map(numbers.__getitem__, s.split(b" ")), np.int32) for s in strings]
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, window) for c in codes])
        hashes = np.concatenate([tx.joined(c.astype(np.uint64), window) for c in codes])
        order = np.argsort(hashes, kind="stable")
        equal = hashes[order[1:]] == hashes[order[:-1]]
        alike = np.zeros(len(rows), bool)
        alike[order[1:]] |= equal
        alike[order[:-1]] |= equal
        out = np.full(len(rows), -1, np.int64)
        some = np.flatnonzero(alike)
        if len(some):
            packed = np.ascontiguousarray(rows[some]).view(np.dtype((np.void, 4 * window))).ravel()
            out[some] = np.unique(packed, return_inverse=True)[1]
        return out

    return labels


def _word_hashes(gram: int):
    def begin():
        hashes = tx.WordHashes()
        return lambda words: tx.joined(hashes(words), gram)

    return begin


def word_units(window: int = 20, gram: int = 5) -> superkmers.Units:
    return superkmers.Units(window, gram, bytes.split, _word_hashes(gram), lambda words, a, n: b" ".join(words[a : a + n]), _window_labels(window))


def _without(text: bytes, words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    """The text without these runs of its words; white space before the next word goes with a run."""
    if not spans:
        return text
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    edges = [0, *[starts[x] for span in spans for x in span], len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])


def strip_passages(docs: DataFrame, window: int = 20, gram: int = 5) -> DataFrame:
    """docs with text stripped of the passages that remove_passages finds, white space and all other columns unchanged.

    A document that repeats passages from its first to its last word stays with an empty text. Rows without doc_id are
    nobody's copies and stay as they are. Columns may have any names.
    """
    names = docs.columns
    inner = {c: c if c in ("doc_id", "text") else f"other_{i}" for i, c in enumerate(names)}  # no name clashes with those used on the way
    own = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in inner.items()])
    held = superkmers.repeated(own, word_units(window, gram), [k for c, k in inner.items() if c != k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, parts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs")):
                parts = parts.as_py()
                if text is not None and parts:
                    words = text.split()
                    text = _without(text, words, superkmers.covered(parts, window, len(words)))
                kept.append(None if text is None else text.decode())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if c == "text" else batch.column(inner[c]) for c in names], names=names)

    schema = ", ".join(f"`{c}` {'long' if c == 'doc_id' else docs.schema[c].dataType.simpleString()}" for c in names)
    return held.mapInArrow(run, schema)


def remove_passages(docs: DataFrame, window: int = 20, gram: int = 5) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of each document.

    Each word is removed that a window of consecutive words covers whose sequence also starts earlier. spans are the
    removed runs of words; kept are the other words, joined by one space. A null or empty text, or one shorter than a
    window, loses nothing (null: kept is empty). Equal rows are the same document and give equal rows; different texts
    of one doc_id are documents in order of their SHA-256; rows without doc_id lose nothing. A very long text is cut in
    one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, parts in zip(tx.binary(batch, "text"), batch.column("runs")):
                words, parts = text.split(), parts.as_py()
                spans = superkmers.covered(parts, window, len(words))
                edges = [0, *[x for span in spans for x in span], len(words)]
                kept = b" ".join([w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]])
                rows.append((len(words), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], kept.decode()))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return superkmers.repeated(docs, word_units(window, gram)).mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string")
