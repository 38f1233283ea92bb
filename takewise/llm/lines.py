"""Line dedup that can be taken back: sharded cuckoo filters before exact tables of references."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takewise.llm import text as tx
from takewise.llm.cuckoo import CuckooFilter, places
from takewise.session import checkpoint, new_folder
from takewise.sources.tables import versions

_REFS = "shard int, key binary, docs array<long>, sign int"
_SHARDS = "shard int, slots binary, key binary"
_KEY = 16


def line_key(line: bytes, least: int = 10) -> bytes | None:
    """The digest of a line's key: stripped of [\\x20\\x09-\\x0D], A-Z in small letters; None below least code points."""
    key = line.strip().lower()
    if len(key) < 4 * least and len(key.decode()) < least:
        return None
    return hashlib.sha256(key).digest()[:_KEY]


def references(docs: DataFrame, shards: int, sign: int, least: int) -> DataFrame:
    """(shard, key, docs, sign): the documents of a block that hold a key, each row of docs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in tx.blocks(batches):
            found: dict[bytes, list[int]] = {}
            for doc, text in zip(ids, texts):
                for key in {line_key(line, least) for line in text.split(b"\n")} - {None}:
                    found.setdefault(key, []).append(doc)
            if not found:
                continue
            shard = np.frombuffer(b"".join(found), np.uint32).reshape(-1, 4)[:, 0] % np.uint32(shards)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64())), pa.array(np.full(len(found), sign, np.int32))],
                names=["shard", "key", "docs", "sign"],
            )

    return tx.only(docs, "doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(run, _REFS)


def _through_filters(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by shard and step: its filter (0), keys to add (1), keys to remove (2), keys to ask for and add (3).

    Out come the keys of step 3 that the filter held already, or that came before, and each shard's filter as it is then.
    """
    shard, held = None, None
    schema = pa.schema([("shard", pa.int32()), ("slots", pa.binary()), ("key", pa.binary())])

    def out(slots: list, keys: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(slots), pa.int32()), pa.array(slots, pa.binary()), pa.array(keys, pa.binary())], schema=schema)

    for batch in parts:
        shards, steps = batch.column("shard").to_numpy(), batch.column("step").to_numpy()
        cuts = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (steps[1:] != steps[:-1])]) if len(shards) else []
        for low, high in zip(cuts, [*cuts[1:], len(shards)]):
            if shards[low] != shard:
                if held is not None:
                    yield out([held.to_bytes()], [None])
                shard, held = int(shards[low]), CuckooFilter()
            step, own = steps[low], batch.slice(low, high - low)
            if step == 0:
                held = CuckooFilter(own.column("slots")[0].as_py())
                continue
            listed = own.column("key").to_pylist()
            keys = np.frombuffer(b"".join(listed), np.uint8).reshape(-1, _KEY)
            if step < 3:
                (held.add if step == 1 else held.remove)(*places(keys))
                continue
            _, first = np.unique(keys.copy().view(f"V{_KEY}").ravel(), return_index=True)
            fresh = np.zeros(len(keys), bool)
            fresh[first] = ~held.contains(*places(keys[first]))
            held.add(*places(keys[fresh]))
            seen = np.flatnonzero(~fresh)
            if len(seen):
                yield out([None] * len(seen), [listed[i] for i in seen])
    if held is not None:
        yield out([held.to_bytes()], [None])


class LineIndex:
    """Which lines of documents (doc_id, text) repeat, kept in a folder by batches of insertions and deletions.

    A line counts by its key (line_key). The folder holds, for each batch, the references: keys with the documents that
    hold them, +1 for an insertion and -1 for a deletion, so the live documents of a key are those whose sum is positive;
    and for each shard of the keys a cuckoo filter. A batch of insertions asks the filter of each key's shard; a key that
    it doesn't know is new, and needs no exact count until it is met again. Only keys met again are counted exactly. A
    fingerprint that stands for two keys makes one of them look known: the exact count tells, and it is added with the
    next batch. A deletion takes keys without references out of the filters, so everything can be taken back.

    Batches have rising numbers; doing the last one again replaces it, and one that broke off doesn't count. Inserting
    rows of a doc_id that is there adds their lines to it, deleting them takes the lines away; deleting what was not
    inserted is an error. Rows without doc_id take no part and keep all lines. Null and empty texts have one empty line.
    """

    def __init__(self, spark: SparkSession, folder: str, shards: int | None = None, least: int = 10):
        self.spark, self.folder, self.least = spark, folder, least
        made = versions(spark, f"{folder}/refs", "batch")
        if made:
            shards = spark.read.json(f"{folder}/settings").first()["shards"]
        else:
            shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(shards).alias("shards")).write.mode("overwrite").json(f"{folder}/settings")
        self.shards = shards

    def _before(self, batch: int) -> int | None:
        done = versions(self.spark, f"{self.folder}/shards", "batch")
        if done and done[-1] > batch:
            raise ValueError(f"batch {done[-1]} was done already; {batch} cannot come after it")
        return max((n for n in done if n < batch), default=None)

    def _read(self, what: str, schema: str, last: int | None) -> DataFrame:
        if last is None:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.folder}/{what}").where(F.col("batch") <= last)

    def _write(self, what: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{what}/batch={batch}")

    def _missed(self, last: int | None) -> DataFrame:
        """(shard, key): keys of the last batch of which every row looked known though no document held them before."""
        seen = self._read("shards", _SHARDS, last).where((F.col("batch") == F.lit(last)) & F.col("key").isNotNull()).groupBy("shard", "key").agg(F.count(F.lit(1)).alias("seen"))
        own = F.col("batch") == F.lit(last)
        refs = self._read("refs", _REFS, last).join(seen, ["shard", "key"])
        counted = refs.groupBy("shard", "key", "seen").agg(F.sum(F.when(own, 1).otherwise(0)).alias("rows"), F.sum(F.when(~own, F.size("docs") * F.col("sign")).otherwise(0)).alias("before"))
        return counted.where("rows = seen AND before = 0").select("shard", "key")

    def _pass(self, batch: int, before: int | None, keys: DataFrame, step: int) -> None:
        nothing, blank = F.lit(None).cast("binary"), F.col("key")
        filters = self._read("shards", _SHARDS, before).where((F.col("batch") == F.lit(before)) & F.col("slots").isNotNull())
        rows = filters.select("shard", F.lit(0).alias("step"), "slots", nothing.alias("key"))
        if before is not None:
            rows = rows.unionByName(self._missed(before).select("shard", F.lit(1).alias("step"), nothing.alias("slots"), blank.alias("key")))
        rows = rows.unionByName(keys.select("shard", F.lit(step).alias("step"), nothing.alias("slots"), blank.alias("key")))
        dealt = rows.repartition(self.shards, "shard").sortWithinPartitions("shard", "step")
        self._write("shards", dealt.mapInArrow(_through_filters, _SHARDS), batch)

    def insert(self, docs: DataFrame, batch: int) -> None:
        """Adds docs (doc_id, text)."""
        before = self._before(batch)
        self._write("refs", references(docs, self.shards, 1, self.least), batch)
        self._pass(batch, before, self._read("refs", _REFS, batch).where(F.col("batch") == batch), 3)

    def delete(self, docs: DataFrame, batch: int) -> None:
        """Takes docs away, given as they were inserted."""
        before = self._before(batch)
        self._write("refs", references(docs, self.shards, -1, self.least), batch)
        refs = self._read("refs", _REFS, batch)
        touched = refs.where(F.col("batch") == batch).select("shard", "key").distinct()
        left = refs.join(touched, ["shard", "key"], "left_semi").groupBy("shard", "key").agg(F.sum(F.size("docs") * F.col("sign")).alias("n"))
        wrong = F.raise_error(F.lit("documents were deleted that had not been inserted")).cast("boolean")
        self._pass(batch, before, left.where(F.when(F.col("n") < 0, wrong).otherwise(F.col("n") == 0)), 2)

    def repeats(self) -> DataFrame:
        """(doc_id, keys): the keys that a document shares with one of smaller doc_id."""
        last = max(versions(self.spark, f"{self.folder}/shards", "batch"), default=None)
        refs = self._read("refs", _REFS, last)
        again = refs.where("size(docs) > 1").select("key").union(self._read("shards", _SHARDS, last).where("key IS NOT NULL").select("key")).distinct()
        pairs = refs.join(again, "key", "left_semi").select("key", "sign", F.explode("docs").alias("doc_id"))
        live = checkpoint(pairs.groupBy("key", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0").drop("n"))
        # written, so that the join deals both sides itself and Spark may split a key that very many documents hold
        first = checkpoint(live.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first"))
        return live.join(first, "key").where("doc_id > first").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept): the texts without lines that a document of smaller doc_id in the index holds."""
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lines, dropped, kept = [], [], []
                for text, keys in zip(tx.binary(batch, "text"), batch.column("keys").to_pylist()):
                    n = text.count(b"\n") + 1
                    if keys:
                        gone = set(keys)
                        stay = [x for x in text.split(b"\n") if line_key(x, least) not in gone]
                        text = b"\n".join(stay)
                    lines.append(n)
                    dropped.append(n - len(stay) if keys else 0)
                    kept.append(text)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

        docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
        told = docs.where("doc_id IS NOT NULL").join(self.repeats(), "doc_id", "left")
        rest = docs.where("doc_id IS NULL").withColumn("keys", F.lit(None).cast("array<binary>"))  # apart, or they would meet in one task
        return told.unionByName(rest).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """Each row's text without the lines whose key (least code points or more) a document of smaller doc_id holds.

    The whole table goes into a new LineIndex as one batch; see there for nulls and repeated rows. A document that holds a
    key several times first keeps all those lines. A text whose lines all go is empty. Ties cannot occur between different
    doc_ids; rows of one doc_id are one document. Other columns play no part, an empty table gives an empty result, and a
    very long text is read whole, in one task. A key in a third of all documents is one reference per block of texts.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    index = LineIndex(docs.sparkSession, new_folder(docs.sparkSession), least=least)
    index.insert(docs, 0)
    return index.apply(docs)
