"""Which beginnings conversations share: double-array tries per shard of prefixes, their upper nodes merged."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takewise.llm import text as tx
from takewise.llm.double_array import DoubleArray
from takewise.session import checkpoint

#: Nodes that a task packs into one trie, and the least number of sequences in it, so that each round merges most of them.
NODES, LEAST = 200_000, 16
_KEY = 16
_NONE = np.iinfo(np.int64).max
_PATH = "path binary, words array<long>, n array<long>, first array<long>, children array<long>, leaves array<long>, saved array<long>, ends array<binary>"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ended binary, own binary, up binary"
_LISTS = ("words", "n", "first", "children", "leaves", "saved")


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart."""
    return F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * _KEY))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<key, words>>) of conversations (conv_id, turn, role, text), in order of turn, null first.

    Null role or text counts as empty. Turns of equal number stand in order of role, then of the key; repeated rows are turns
    of their own. Rows without conv_id belong to no conversation. What is shuffled is a key and a count for each turn.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("`conv_id`").isNotNull()).select(
        F.col("`conv_id`").cast("long").alias("conv_id"),
        F.struct(F.col("`turn`").isNotNull().alias("numbered"), F.coalesce(F.col("`turn`"), F.lit(0)).alias("turn"), role.alias("role"), turn_key(role, text).alias("key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).alias("t"),
    )
    turns = F.array_sort(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def rebuilt(sequences: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation begins with the first h turns of the one whose conv_id is the multiple of every below its own, in
    place of its own first h; h: crc32 of the decimal conv_id modulo most. Fewer or no such turns are taken if there are fewer."""
    head = sequences.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    both = sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(head, "base", "left").withColumn("h", h)
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    taken = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return both.select("conv_id", F.concat(taken, own).alias("turns"))


def listed(members: DataFrame, most: int = 50_000) -> DataFrame:
    """(path_id, ended): SHA-256 of the members' decimal conv_ids, ascending and joined by commas.

    Members (path_id, conv_id) are dealt by ranges of both, so those of one path may be many: each task joins its own ones
    in lists of most at most, and what meets for a path are these lists, in order, one at a time.
    """

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            paths, ids = batch.column("path_id").to_pylist(), batch.column("conv_id").to_numpy()
            cuts = [i for i in range(len(paths)) if i == 0 or paths[i] != paths[i - 1] or i % most == 0]
            text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(paths)])]
            yield pa.RecordBatch.from_arrays([pa.array([paths[a] for a in cuts], pa.binary()), pa.array(ids[cuts], pa.int64()), pa.array(text, pa.string())], names=["path_id", "at", "ids"])

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held = None, None
        for batch in parts:
            done = []
            for own, ids in zip(batch.column("path_id").to_pylist(), batch.column("ids").to_pylist()):
                if own != path:
                    if path is not None:
                        done.append((path, held.digest()))
                    path, held = own, hashlib.sha256(ids.encode())
                else:
                    held.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.binary()) for i in (0, 1)], names=["path_id", "ended"])
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (path, held.digest())], names=["path_id", "ended"])

    n = tx.partitions(members)
    lists = members.repartitionByRange(n, "path_id", "conv_id").sortWithinPartitions("path_id", "conv_id").mapInArrow(join, "path_id binary, at long, ids string")
    return lists.repartition(n, "path_id").sortWithinPartitions("path_id", "at").mapInArrow(digest, "path_id binary, ended binary")


def _digests(path: bytes) -> list[bytes]:
    """The digest of each prefix, from the empty one on."""
    running, out = hashlib.sha256(), []
    out.append(running.digest()[:_KEY])
    for at in range(0, len(path), _KEY):
        running.update(path[at : at + _KEY])
        out.append(running.copy().digest()[:_KEY])
    return out


def _shared(one: bytes, two: bytes) -> int:
    """How many keys two paths share at their beginning."""
    a, b = (np.frombuffer(x, np.uint8).reshape(-1, _KEY) for x in (one, two))
    n = min(len(a), len(b))
    differ = np.flatnonzero((a[:n] != b[:n]).any(1))
    return int(differ[0]) if len(differ) else n


def pack(rows: list[dict], last: bool, named: bool) -> tuple[list[tuple], list[tuple]]:
    """Nodes (_NODE) of the trie over sorted distinct paths (_PATH), and the paths at its edges for the next round.

    The nodes on the first and the last path may have parts elsewhere: unless this is the last round, they go on as two
    paths with what is known of each node, and all others are complete. named: nodes carry the digest of their prefix.
    """
    paths = [r["path"] for r in rows]
    lengths = np.array([len(p) // _KEY for p in paths], np.int64)
    keys = np.frombuffer(b"".join(paths), f"V{_KEY}")
    _, codes = np.unique(keys, return_inverse=True) if len(keys) else (None, np.empty(0, np.int64))
    codes = codes.astype(np.int64).ravel() + 1
    trie = DoubleArray(codes, lengths)
    places = trie.walk(codes, lengths)
    size, starts = trie.used, np.cumsum(lengths + 1) - lengths - 1
    depth = np.arange(len(places)) - np.repeat(starts, lengths + 1)
    flat = {k: np.concatenate([np.asarray(r[k], np.int64) for r in rows]) for k in _LISTS}
    held = {k: np.zeros(size, np.int64) for k in ("n", "children", "leaves", "saved")}
    for k, v in held.items():
        np.add.at(v, places, flat[k])
    first, words, level = np.full(size, _NONE), np.zeros(size, np.int64), np.zeros(size, np.int64)
    np.minimum.at(first, places, flat["first"])
    words[places], level[places] = flat["words"], depth
    ended: dict[int, bytes] = {}
    for r, at in zip(rows, starts.tolist()):
        for i, x in enumerate(r["ends"]):
            if x is not None:
                ended[int(places[at + i])] = x
    nodes = np.unique(places)
    open_ = np.zeros(size, bool)
    edges = [] if last else sorted({0, len(rows) - 1})
    for i in edges:
        open_[places[starts[i] : starts[i] + lengths[i] + 1]] = True
    closed = nodes[~open_[nodes]]
    closed = closed[np.argsort(-level[closed], kind="stable")]
    cuts = np.flatnonzero(np.r_[True, level[closed][1:] != level[closed][:-1]]) if len(closed) else []
    for low, high in zip(cuts, [*cuts[1:], len(closed)]):
        own = closed[low:high]
        held["leaves"][own] += held["children"][own] == 0
        held["saved"][own] += (held["n"][own] - 1) * words[own]
        if level[own[0]]:
            for k, v in (("children", 1), ("leaves", held["leaves"][own]), ("saved", held["saved"][own])):
                np.add.at(held[k], trie.check[own], v)
    digest: dict[int, bytes] = {}
    for i in range(len(rows)) if named else edges:
        digest.update(zip(places[starts[i] : starts[i] + lengths[i] + 1].tolist(), _digests(paths[i])))
    done = []
    for s in closed.tolist():
        up, root = int(trie.check[s]), not level[s]
        below = not root and bool(open_[up])
        done.append((int(first[s]), int(level[s]), None if root or below else int(first[up]), *(int(held[k][s]) for k in ("n", "children", "leaves", "saved")), ended.get(s), digest[s] if named else None, digest[up] if below else None))
    going, told = [], 0
    for i in edges:
        own = places[starts[i] : starts[i] + lengths[i] + 1]
        told = 0 if i == 0 else _shared(paths[0], paths[i]) + 1  # nodes that went with the first path go without values here
        new = np.arange(len(own)) >= told
        lists = [np.where(new, held[k][own], 0).tolist() for k in ("n", "children", "leaves", "saved")]
        going.append((paths[i], words[own].tolist(), lists[0], np.where(new, first[own], _NONE).tolist(), *lists[1:], [ended.get(int(s)) if x else None for s, x in zip(own, new)]))
    return done, going


def _packed(last: bool, named: bool):
    nodes, edges = ([x.split()[0] for x in s.split(", ")] for s in (_NODE, _PATH))
    kinds = {"depth": pa.int64(), "ended": pa.binary(), "own": pa.binary(), "up": pa.binary(), "path": pa.binary(), "ends": pa.list_(pa.binary())} | {k: pa.list_(pa.int64()) for k in _LISTS}

    def out(done: list[tuple], going: list[tuple]) -> pa.RecordBatch:
        table = {k: [x[i] for x in done] + [None] * len(going) for i, k in enumerate(nodes)}
        table |= {k: [None] * len(done) + [x[i] for x in going] for i, k in enumerate(edges)}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in table.items()], names=list(table))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in parts:
            for row in batch.to_pylist():
                held.append(row)
                many += len(row["n"])
                if many >= NODES and len(held) >= LEAST and not last:
                    yield out(*pack(held, last, named))
                    held, many = [], 0
        if held:
            yield out(*pack(held, last, named))

    return run


def prefix_nodes(sequences: DataFrame, salts: int = 16) -> DataFrame:
    """A row per distinct beginning of sequences (conv_id, turns array<struct<key, words>>), the empty one included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest conv_id of its
    members, its length, the same of the node above (null for the root), the members, the children, the childless nodes
    at or below it, the words that all but one member need not read again, summed over the nodes at or below it, and the
    digest of the members that end there.

    Equal sequences are one path with a count. Paths are dealt by ranges, so a shard holds neighbours, a beginning that a
    third of all share is spread over many, and only nodes on a shard's first and last path can have parts elsewhere. Each
    shard packs tries of about NODES nodes; the paths at their edges go through the same again until one trie holds
    what is left. A conversation's keys, 16 bytes a turn, are in one task at a time. An empty table has no nodes; a
    sequence without turns ends at the root.
    """
    keys = F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")
    path = F.unhex(keys)
    members = checkpoint(sequences.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")).withColumn("path_id", F.unhex(F.sha2("path", 256))))
    paths = members.groupBy("path_id").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("many"))
    paths = paths.join(listed(members.select("path_id", "conv_id")), "path_id")
    size = F.size("words") + 1
    nothing = F.array_repeat(F.lit(0).cast("long"), size)
    going = paths.select(
        "path", F.concat(F.array(F.lit(0).cast("long")), "words").alias("words"), F.array_repeat("many", size).alias("n"), F.array_repeat("conv_id", size).alias("first"),
        nothing.alias("children"), nothing.alias("leaves"), nothing.alias("saved"), F.concat(F.array_repeat(F.lit(None).cast("binary"), size - 1), F.array("ended")).alias("ends"),
    )
    done, named, parts = None, False, tx.partitions(members)
    names = [x.split()[0] for x in _PATH.split(", ")]
    going = checkpoint(going)
    while True:
        many, rows = going.agg(F.coalesce(F.sum(F.size("n")), F.lit(0)), F.count(F.lit(1))).first()
        last = named and (many <= NODES or rows <= LEAST)
        if named:  # a trie has LEAST paths or more and hands on two, so each round has a quarter of the paths at most
            parts = 1 if last else max(1, min(parts, many // NODES, rows // LEAST))
        dealt = going.coalesce(1) if last else going.repartitionByRange(parts, "path")
        got = checkpoint(dealt.sortWithinPartitions("path").mapInArrow(_packed(last, named), f"{_NODE}, {_PATH}"))
        own = got.where("conv_id IS NOT NULL").drop(*names)
        done = own if done is None else done.unionByName(own)
        if last:
            break
        going, named = got.where("path IS NOT NULL").select(*names), True
    upper = done.where("own IS NOT NULL").select(F.col("own").alias("up"), F.col("conv_id").alias("above"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    below = done.where("up IS NOT NULL").withColumn("salt", F.pmod("conv_id", F.lit(salts)).cast("int")).join(upper, ["up", "salt"]).withColumn("parent_conv_id", F.col("above"))
    nodes = done.where("up IS NULL").unionByName(below.select(*done.columns))
    return nodes.select(*[x.split()[0] for x in _NODE.split(", ")[:7]], F.coalesce(F.lower(F.hex("ended")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
