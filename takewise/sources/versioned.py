"""A partitioned table of which an edit rewrites the touched parts alone, and versions that tell which files hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takewise.sources.tables import versions


class VersionedTable:
    """Rows in folders of their partition and of the edit that wrote them; a version lists the folders that hold.

    An edit reads the partitions with rows of its keys, writes what becomes of them under its own number, adds rows that
    move to other partitions beside what these hold, and last writes the list of the new version. Readers of an older
    version keep seeing it. An edit that broke off has no list and is done again under the same number. Partitions are
    few by design (kinds and states); their list is all that goes through the driver.
    """

    def __init__(self, spark: SparkSession, folder: str, partitions: list[str], most: int = 8):
        self.spark, self.folder, self.partitions, self.most = spark, folder, partitions, most

    @property
    def version(self) -> int:
        """The newest version, -1 if there is none."""
        return max(versions(self.spark, f"{self.folder}/lists"), default=-1)

    def _list(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/lists/version={version}")

    def _write(self, rows: DataFrame, version: int, kept: DataFrame | None) -> None:
        stamped = rows.withColumn("written", F.lit(version))
        # a folder written by an edit that broke off is replaced; those of other edits stay
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.partitions, "written").parquet(f"{self.folder}/data")
        new = self.spark.read.schema(stamped.schema).parquet(f"{self.folder}/data").where(F.col("written") == version).select(*self.partitions, "written").distinct()
        (new if kept is None else kept.unionByName(new)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/lists/version={version}")

    def create(self, rows: DataFrame) -> None:
        if self.version >= 0:
            raise ValueError(f"{self.folder} holds a table")
        self._write(rows, 0, None)

    def _where(self, rows: list) -> Column:
        """The rows of the listed folders, as a condition that prunes all others."""
        at = F.lit(False)
        for r in rows:
            one = F.lit(True)
            for c in r.asDict():
                one = one & F.col(c).eqNullSafe(F.lit(r[c]))
            at = at | one
        return at

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version if version is None else version
        if version < 0:
            raise ValueError(f"{self.folder} holds no table")
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.folder}/data").where(self._where(self._list(version).collect())).drop("written")

    def edit(self, keys: DataFrame, key: str, apply: Callable[[DataFrame], DataFrame]) -> int:
        """A new version in which the partitions that hold rows of keys (key) are what apply makes of them; its number.

        apply gets the whole partitions and returns their rows, of whatever partition. A partition in more than most
        folders is rewritten as one, touched or not.
        """
        now = self.version
        listed = self._list(now).collect()
        hit = self.read(now).join(keys.select(key).distinct(), key, "left_semi").select(*self.partitions).distinct().collect()
        folders: dict[tuple, int] = {}
        for r in listed:
            at = tuple(r[c] for c in self.partitions)
            folders[at] = folders.get(at, 0) + 1
        touched = {tuple(r[c] for c in self.partitions) for r in hit} | {at for at, n in folders.items() if n > self.most}
        old = [r for r in listed if tuple(r[c] for c in self.partitions) in touched]
        kept = self._list(now).where(~self._where(old))
        if not touched:
            kept.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/lists/version={now + 1}")
            return now + 1
        rows = self.spark.read.option("mergeSchema", True).parquet(f"{self.folder}/data").where(self._where(old)).drop("written")
        self._write(apply(rows), now + 1, kept)
        return now + 1
