"""Quality rules by host: failures of document rules, shrunk to the corpus, decide about hosts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takewise.llm import text as tx
from takewise.session import checkpoint

_SYMBOLS = b"#*$%&|<>"
_SCHEMA = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(codes: np.ndarray, width: int) -> int:
    """Words inside the windows of width words that occur twice or more; codes: the words by number."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    keys = tx.joined(codes.astype(np.uint64), width)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(codes, width)
    pairs = np.flatnonzero(same)
    if (windows[order[pairs]] != windows[order[pairs + 1]]).any():  # two windows share a hash: compare the words themselves
        _, which, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        twice = counts[which.ravel()] > 1
    else:
        twice = np.zeros(n, bool)
        twice[order[pairs]] = twice[order[pairs + 1]] = True
    steps = np.zeros(len(codes) + 1, np.int64)
    steps[:n] += twice
    steps[width : width + n] -= twice
    return int((np.cumsum(steps)[:-1] > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def document_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", window: int = 8) -> DataFrame:
    """Counts of each whole text. A null or empty text has no words and counts of 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in tx.binary(batch, "text"):
                words = body.split()
                numbers = tx.Numbering()
                codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                rows.append((len(words), len(b"".join(words).decode()), len(body) - len(body.translate(None, _SYMBOLS)), repeated_lines(body), repeated_words(codes, window)))
            counts = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("host").cast(pa.string()), *counts], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    got = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{host}`").cast("string").alias("host"))
    return got.mapInArrow(count, _SCHEMA)


def default_rules(min_words: int = 20, max_repeated: int = 30) -> dict[str, Column]:
    """Rules by name for a document; true is a failure. max_repeated: per cent of the words."""
    return {
        "too_short": F.col("n_words") < min_words,
        "repetitive": 100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"),
    }


def default_host_rules() -> dict[str, Column]:
    """Rules by name whose failures count against the host alone: symbols, repeated lines and words of odd length."""
    return default_rules() | {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "repeated_lines": F.col("n_dup_lines") > 2,
        "odd_words": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    }


def host_verdicts(counts: DataFrame, rules: dict[str, Column], max_rate: float = 0.25) -> DataFrame:
    """A row per host: documents, failures of each rule, the shrunk rate of each rule and whether the host is rejected.

    The prior of a rule is the beta distribution with the mean of the hosts' rates and their variance less what chance
    makes of it in hosts of their sizes (method of moments). Where chance explains it all, each host gets the mean. A
    host whose rate beyond shrinking is over max_rate for any rule is rejected. Documents without a host belong to none.
    """
    hosts = counts.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(rule.cast("long")).alias(f"{name}_failed") for name, rule in rules.items()])
    rates = {name: F.col(f"{name}_failed") / F.col("n_docs") for name in rules}
    prior = hosts.agg(F.avg(1 / F.col("n_docs")).alias("noise"), *[f(rates[name]).alias(f"{name}_{what}") for name in rules for what, f in (("mean", F.avg), ("var", F.var_pop))])
    out, rejected = hosts.join(F.broadcast(prior)), F.lit(False)  # the prior is one row
    for name in rules:
        mean = F.col(f"{name}_mean")
        var = F.col(f"{name}_var") - mean * (1 - mean) * F.col("noise")
        weight = mean * (1 - mean) / var - 1
        shrunk = F.when(var <= 0, mean).when(weight <= 0, rates[name]).otherwise((F.col(f"{name}_failed") + mean * weight) / (F.col("n_docs") + weight))
        out = out.withColumn(f"{name}_rate", shrunk)
        rejected = rejected | (F.col(f"{name}_rate") > max_rate)
    return out.withColumn("rejected", rejected).drop("noise", *[f"{name}_{what}" for name in rules for what in ("mean", "var")])


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", rules: dict[str, Column] | None = None, host_rules: dict[str, Column] | None = None, max_rate: float = 0.25, few: int = 100_000, salts: int = 32) -> DataFrame:
    """Each document with its counts, whether it failed a rule itself, and whether it stays.

    A document goes if it fails one of rules or its host is rejected, by the rates at which its documents fail any of
    host_rules. Null and empty texts fail as too short; an empty table gives an empty result; repeated rows are judged
    each; a very long text is counted whole, in one task. The counts are written once to the checkpoint folder. Rejected
    hosts come back by a broadcast if they are few at most, else by a join in which each host is split into salts.
    """
    rules = default_rules() if rules is None else rules
    failed = F.lit(False)
    for rule in rules.values():
        failed = failed | rule
    counts = checkpoint(document_counts(docs, doc_id, text, host).withColumn("base_failed", failed))
    verdicts = host_verdicts(counts, default_host_rules() if host_rules is None else host_rules, max_rate)
    bad = checkpoint(verdicts.where("rejected").select(F.col("host").alias("judged")))
    if bad.count() <= few:
        joined = counts.join(F.broadcast(bad), F.col("host") == F.col("judged"), "left")
    else:
        bad = bad.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = counts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int"))
        joined = salted.join(bad, (F.col("host") == F.col("judged")) & (F.col("salt") == F.col("part")), "left").drop("salt", "part")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("judged").isNull()).drop("judged")
