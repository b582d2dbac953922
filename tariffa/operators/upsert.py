"""Keyed upsert of quote rows and the work queues derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tariffa import fixed_values as fv
from tariffa.operators.gates import denied_cells
from tariffa.operators.rank import running_total

KEY = ("property_id", "channel", "arrival_date", "nights", "room_type_canonical")
CELL = ("property_id", "channel", "arrival_date", "nights")


def _text_key(keys):
    return {f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)}


def upsert(old: DataFrame, new: DataFrame, keys=KEY) -> DataFrame:
    """Old rows whose key is not among the new rows, then all new rows.

    Keys compare as text with null as ''. The result has the old table's columns.
    """
    text = _text_key(keys)
    fresh = new.select(*[c.alias(n) for n, c in text.items()]).distinct()
    kept = old.withColumns(text).join(fresh, list(text), "left_anti").drop(*text)
    added = new.select(*[
        (F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema.fields])
    return kept.unionByName(added)


def upsert_report(old: DataFrame, new: DataFrame, keys=KEY, cell=CELL) -> DataFrame:
    """Row and key counts of an upsert."""
    text = _text_key(keys)
    fresh = new.select(*[c.alias(n) for n, c in text.items()]).distinct()
    dropped = old.withColumns(text).join(fresh, list(text), "left_semi")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    counts = n(old, "old_rows")
    for df, name in ((new, "new_rows"), (fresh, "new_keys"), (new.select(*cell).distinct(), "new_cells"), (dropped, "dropped")):
        counts = counts.unionByName(n(df, name))
    wide = {w: F.sum(F.when(F.col("what") == w, F.col("n")).otherwise(0)) for w in (
        "old_rows", "new_rows", "new_keys", "new_cells", "dropped")}
    return counts.agg(*[c.alias(w) for w, c in wide.items()]).withColumn(
        "final_rows", F.col("old_rows") - F.col("dropped") + F.col("new_rows")).withColumn(
        "delta", F.col("final_rows") - F.col("old_rows"))


def cell_state(rows: DataFrame, cell=CELL) -> DataFrame:
    """Per cell: has an extracted row, has a sentinel, and is therefore complete."""
    status = F.trim(F.coalesce("status", F.lit("")))
    extracted = F.max(F.lower(status).isin(*fv.EXTRACTED_STATUSES))
    sentinel = F.max(status.isin(*fv.SENTINELS))
    return rows.groupBy(*cell).agg(extracted.alias("has_extracted"), sentinel.alias("has_sentinel")).withColumn(
        "is_complete", F.col("has_extracted") & ~F.col("has_sentinel"))


def complete_cells(rows: DataFrame, cell=CELL) -> DataFrame:
    """Cells with an extracted row and no sentinel."""
    return cell_state(rows, cell).where("is_complete").select(*cell)


def retry_queue(log: DataFrame, done: DataFrame, deny=(), cell=CELL) -> DataFrame:
    """Logged failures, each cell once, that are still not complete and still allowed."""
    failed = log.where(F.col("kind").isin(*fv.FAILED_KINDS)).select(*cell).distinct()
    return denied_cells(failed.join(done, list(cell), "left_anti"), deny)


def cell_matrix(properties: DataFrame, channels, dates, nights) -> DataFrame:
    """Every property with every channel, date and stay of the run's settings.

    The three lists are settings of fixed size, laid out per property.
    """
    out = properties.select("property_id")
    for name, values in (("channel", channels), ("arrival_date", dates), ("nights", nights)):
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out.withColumn("arrival_date", F.col("arrival_date").cast("date"))


def work_queue(matrix: DataFrame, done: DataFrame, deny=(), cell=CELL) -> DataFrame:
    """The full matrix without denied and complete cells."""
    return denied_cells(matrix, deny).join(done, list(cell), "left_anti")


def with_cost(queue: DataFrame, stealth_channels, basic=fv.CREDITS_BASIC, stealth=fv.CREDITS_STEALTH) -> DataFrame:
    return queue.withColumn("credits", F.when(F.col("channel").isin(*stealth_channels), stealth).otherwise(basic))


def projected_cost(costed: DataFrame, basic=fv.CREDITS_BASIC) -> DataFrame:
    return costed.agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("credits") > basic).alias("n_stealth"),
        F.coalesce(F.sum("credits"), F.lit(0)).alias("credits"))


def budget_cut(costed: DataFrame, position: str, ceiling=fv.CREDIT_CEILING, block=1_000_000) -> DataFrame:
    """Mark the cells that run: those whose predecessors together cost less than the ceiling."""
    return running_total(costed, position, "credits", "spent_before", block).withColumn(
        "runs", F.col("spent_before") < ceiling)


def outcome_tally(log: DataFrame) -> DataFrame:
    """Cells and credits per outcome."""
    return log.groupBy("kind").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("credits").alias("credits"))


def checkpoints(log: DataFrame, position: str, every=50, block=1_000_000) -> DataFrame:
    """Running cells and credits at every `every`-th cell of a run (positions from 0)."""
    run = running_total(log, position, "credits", "spent_before", block)
    at = (F.col(position) + 1) % every == 0
    return run.where(at).select((F.col(position) + 1).alias("n_cells"), (F.col("spent_before") + F.col("credits")).alias("credits"))
