"""Conversations with faults: what is wrong with them and the cheapest edits that put their structure right."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takewise.llm import text as tx
from takewise.llm.dawg import SuffixAutomaton, follow, needed
from takewise.llm.prefix_tries import turn_key
from takewise.session import checkpoint

#: Nodes of an automaton before a task starts another one.
NODES = 300_000
_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
_REPAIRED = "conv_id long, position long, role string, text string"


def damaged(conversations: DataFrame, of: int = 20) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults, by the crc32 of conv_id:turn modulo of: 0 drops the row, 1
    empties its text, 2 takes out its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    A null counts as one space, in what is hashed and as role or text."""
    space = F.lit(" ")
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), space)
    kind = (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % of).cast("int")
    rows = conversations.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("col")


def _ordered(df: DataFrame, *also: str) -> DataFrame:
    """The rows of a conversation in one task, in order of turn, null first, then of role and key."""
    return df.repartition(tx.partitions(df), "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *also, F.asc_nulls_first("turn"), "role", "key")


def _same(a: int | None, b: int | None) -> bool:
    return a == b and (a is None) == (b is None)


class _Faults:
    """Faults of one conversation, a row at a time; of the texts it holds digests alone."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.seen, self.symbols = conv_id, set(), []
        self.low = self.high = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, key: bytes, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        twice = key in self.seen
        self.seen.add(key)
        if blank:
            self.blank += 1
        elif twice:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        symbol = initial if initial in ("s", "u", "a") else "o"
        self.symbols.append("x" if blank or twice else symbol.upper() if cut else symbol)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, np.iinfo(np.int64).max)
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, "".join(self.symbols)


def _find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = [x.split()[0] for x in _AUDIT.split(", ")], [pa.int64()] * 6 + [pa.string()]
    held = None
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
    for batch in parts:
        done = []
        for conv, mark, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "mark", "turn", "initial", "key", "blank", "cut"))):
            if held is None or not _same(held.conv_id, conv):
                if held is not None:
                    done.append(held.row())
                held = _Faults(conv)
            if not mark:
                held.add(*row)
        yield out(done)
    if held is not None:
        yield out([held.row()])


def faults(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Gaps, faults and the signature of each conv_id of conversations, from its rows (conv_id, turn, role, text).

    A row is blank (nothing but white space), else a duplicate (role and text seen earlier in the conversation), else
    truncated (the last character that isn't white space is no full stop, exclamation or question mark). Rows of equal turn
    stand in order of role and of a digest. Texts stay where they are: flags and a key of 16 bytes go to the conversation.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    key = turn_key(F.col("role"), F.col("text"))
    told = rows.select("conv_id", F.lit(0).alias("mark"), "turn", "role", F.substring("role", 1, 1).alias("initial"), key.alias("key"), blank.alias("blank"), cut.alias("cut"))
    none = lambda kind: F.lit(None).cast(kind)
    marks = conversations.select(F.col("`conv_id`").cast("long").alias("conv_id")).distinct().select("conv_id", F.lit(1).alias("mark"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("initial"), none("binary").alias("key"), none("boolean").alias("blank"), none("boolean").alias("cut"))
    return _ordered(told.unionByName(marks), "mark").mapInArrow(_find, _AUDIT)


def cheapest(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct signatures, dealt by ranges of what they end with, so that a task has those that
    share suffixes: each suffix is worked out once in it, and only those at the edge of a range in another one too."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for batch in parts:
            own, best = batch.column("signature").to_pylist(), []
            for signature in own:
                if len(automaton.symbol) > NODES:
                    automaton = SuffixAutomaton()
                best.append(automaton.best(signature))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([c for c, _ in best], pa.int64()), pa.array([a for _, a in best], pa.string())], names=["signature", "cost", "audit"])

    distinct = signatures.select("signature").distinct().withColumn("end", F.reverse("signature"))
    dealt = distinct.repartitionByRange(tx.partitions(signatures), "end").sortWithinPartitions("end")
    return dealt.select("signature").mapInArrow(run, "signature string, cost long, audit string")


def audits(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """faults with the cost and the audit of the cheapest edits: K keeps a row, R changes its role, D deletes it, I inserts an
    empty user or assistant turn, so that the initials of the roles are (s?(ua)+)?. Equal signatures are worked out once."""
    found = checkpoint(faults(rows, conversations))
    return checkpoint(found.join(cheapest(found), "signature").drop("signature"))


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


def _mend(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows behind the audit of their conversation (mark 0), one after the other."""
    conv, audit, at, state, position = None, "", 0, 0, 0
    names, kinds = [x.split()[0] for x in _REPAIRED.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in parts:
        done: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal position
            done.append((conv, position, role, text))
            position += 1

        def insert() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                put(needed(state), "")
                at, state = at + 1, follow(state, "I", "")

        for own, mark, told, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "mark", "audit", "role", "text"))):
            if not mark:
                insert()
                conv, audit, at, state, position = own, told, 0, 0, 0
                continue
            insert()
            edit = audit[at]
            if edit != "D":
                put(role if edit == "K" else needed(state), text)
            at, state = at + 1, follow(state, edit, _initial(role))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)
    done = []
    while at < len(audit):
        done.append((conv, position, needed(state), ""))
        at, state, position = at + 1, follow(state, "I", ""), position + 1
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the rows after the edits of audits (conv_id, audit); each conversation's stand together,
    in order. Texts are shuffled once and pass one by one."""
    none = lambda kind: F.lit(None).cast(kind)
    told = audits.select("conv_id", F.lit(0).alias("mark"), "audit", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("binary").alias("key"))
    held = rows.select("conv_id", F.lit(1).alias("mark"), none("string").alias("audit"), "turn", "role", "text", turn_key(F.col("role"), F.col("text")).alias("key"))
    return _ordered(told.unionByName(held), "mark").mapInArrow(_mend, _REPAIRED)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of role:text, newline-joined, from rows as repaired leaves them; no shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, None
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.string())], names=["conv_id", "repaired_sha256"])
        for batch in parts:
            done = []
            for own, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text"))):
                if position == 0:
                    if held is not None:
                        done.append((conv, held.hexdigest()))
                    conv, held = own, hashlib.sha256()
                held.update(("\n" * (position > 0) + f"{role}:{text}").encode())
            yield out(done)
        if held is not None:
            yield out([(conv, held.hexdigest())])

    return repaired.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """A row per conv_id of conversations: its gaps, faults, cost, audit and the digest of what is left after the edits.

    rows, by default conversations themselves, are what is repaired; a conversation without any has zeros, an empty audit
    and the digest of nothing. Null role or text counts as one space; null conv_ids are one conversation. A conversation
    without faults has only K. A conversation passes through one task row by row; what is held of it is a symbol and a key
    per row. An empty table gives an empty result; further columns play no part.
    """
    if rows is None:
        space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(c)
        rows = conversations.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), space("role"), space("text"))
    found = audits(rows, conversations)
    left = digests(repaired(rows, found)).withColumnRenamed("conv_id", "own")
    both = found.join(left, found["conv_id"].eqNullSafe(left["own"]), "left").drop("own")
    return both.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))
