"""Streams whose memory is Spark's state store: latest states with their counts, and first manifests within a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from takewise.sources.tables import MANIFEST, manifest_columns, versions

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the given one stays as it is."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return own


class LatestState(StatefulProcessor):
    """Of a recording the latest state by seq, of equal ones the one that comes last; its changes go on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "seq long, state string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        old = tuple(self.latest.get()) if self.latest.exists() else None
        new = old
        for row in rows:
            if row.seq is not None:
                now = (row.seq, row.state)
                new = now if new is None or _after(now, new) else new
        if new == old:
            return
        self.latest.update(new)
        if old is None or old[1] != new[1]:
            if old is not None:
                yield Row(state=old[1], n=-1)
            yield Row(state=new[1], n=1)

    def close(self) -> None:
        pass


def _after(a: tuple[int, str | None], b: tuple[int, str | None]) -> bool:
    """As structs sort: nulls first."""
    return (a[0], a[1] is not None, a[1] or "") > (b[0], b[1] is not None, b[1] or "")


def state_changes(events: DataFrame) -> DataFrame:
    """(state, n): for each change of a recording's latest state -1 for the old one and +1 for the new one, from a stream of
    events (recording_id of any type, state, seq). One operator keyed by recording; a count over it is a plain sum."""
    rows = events.select("recording_id", "state", F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("recording_id").transformWithState(LatestState(), "state string, n long", "Update", "None")


def counts_into(path: str) -> Callable[[DataFrame, int], None]:
    """Adds a batch's changes up by state and writes them as its own part: a few rows, whatever number of recordings."""

    def each(batch: DataFrame, number: int) -> None:
        batch.groupBy("state").agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """(state, n): the recordings of each state now."""
    parts = [f"{path}/batch={n}" for n in versions(spark, path, "batch")]
    if not parts:
        return spark.createDataFrame([], "state string, n long")
    return spark.read.schema("state string, n long").parquet(*parts).groupBy("state").agg(F.sum("n").alias("n")).where("n <> 0")


def first_manifests(manifests: DataFrame, delay: str = "30 days") -> DataFrame:
    """The first manifest of each hash on a stream of manifests, by the state store alone: a hash is forgotten when no file that
    was written less than delay before the newest can come any more. dedup_into remembers all, in a table."""
    return manifests.where("NOT broken").withWatermark("written_at", delay).dropDuplicatesWithinWatermark(["file_hash"])


def stream_dated_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """library.stream_manifests with the time at which each file was written."""
    raw = spark.readStream.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    dated = raw.select("*", F.col("_metadata.file_modification_time").alias("written_at"))
    return manifest_columns(dated, "written_at")
