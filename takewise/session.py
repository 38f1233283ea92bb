"""Session settings and the folder in which long lineages are cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "takewise", **conf: str) -> SparkSession:
    """A session with the settings that the queries expect; the cluster's own settings win."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent a temporary folder takes its place in local mode, as in tests; on a cluster, whose
    machines would not see each other's folders, that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df from files in the shared folder: for rows that are too many to shuffle or to compute twice, by columns and
    compressed, so that a few bytes hold a row."""
    folder = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def new_folder(spark: SparkSession) -> str:
    """The name of a folder that doesn't exist yet, in the shared one."""
    return f"{_shared(spark)}/written-{uuid.uuid4().hex}"
