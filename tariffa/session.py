"""Session settings for a cluster or for a local run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The library's settings on a builder for any cluster; master, memory and shuffle partitions stay the caller's."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def local_session(cpus="*", memory="8g", name="tariffa") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = configure(SparkSession.builder.master(f"local[{cpus}]").appName(name))
    spark = (
        builder.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tariffa-"))
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own: dict[str, str] = {}


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the place that all executors share, named in spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a session whose executors are threads of this process; any other
    session must set it, because each of its machines would write to a disk of its own.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        master = conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tariffa-work-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the work folder: they run once, and Spark knows their size."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
