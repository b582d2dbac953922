"""Streaming forms of the append-only feeds. Each reuses the batch expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tariffa import fixed_values as fv
from tariffa.operators.ingest import melt, sheet_rows_panel, typed
from tariffa.operators.upsert import KEY
from tariffa.sources.keyed_store import KeyedStore
from tariffa.sources.readers import parse_log, stream_sheets


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.readStream.text(path))


def tally_by_window(log: DataFrame, window="1 hour", late="1 hour") -> DataFrame:
    """Cells and credits per outcome and time window; later rows than `late` are dropped."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("credits_nominal").alias("credits")).select(
        F.col("window.start").alias("window_start"), "kind", "n_cells", "credits")


def failed_once(log: DataFrame, late="1 hour") -> DataFrame:
    """Failed cells of the log, each once within the watermark."""
    failed = log.where(F.col("kind").isin(*fv.FAILED_KINDS))
    return failed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["property", "channel", "arrival", "los"])


def typed_sheets(sheets: DataFrame, slugs: dict, ids=("arrival_date",)) -> DataFrame:
    """Melt and type dropped sheets as they arrive (no state)."""
    return typed(melt(sheets, slugs, ids))


def sheet_panel_stream(spark: SparkSession, folder, slugs: dict, source: str, tier="any", drop=(), strict=True, glob="*") -> DataFrame:
    """Panel rows of CSV sheets as they are dropped into a folder (no state). Files may have other columns, in another order."""
    return sheet_rows_panel(stream_sheets(spark, folder, glob), slugs, source, tier, drop, strict)


def upsert_batches(target: str, keys=KEY, writer="stream", buckets=None):
    """`foreachBatch` function: keyed upsert of quote files into a stored table (see `keyed_store`).

    Each batch becomes visible as a whole, by one manifest, or not at all. A batch that is run again after a failure is either
    written anew or, if it had been committed, skipped. A batch without rows only records its number. Rows of one
    batch all enter, as in the batch form. `writer` names the stream: two streams into one table need two names.
    """
    if "arrival_date" not in keys:
        raise ValueError("the keys must hold arrival_date: months are replaced as a whole")

    def apply(batch: DataFrame, batch_id: int) -> None:
        KeyedStore(batch.sparkSession, target, keys, buckets=buckets).upsert(batch, writer, batch_id)

    return apply
