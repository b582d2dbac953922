"""Sinks: the panel by as-of day, quote rows, and one table per result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from tariffa import fixed_values as fv, schemas
from tariffa.functions import cells
from tariffa.operators.ingest import checked_sheets, named_cell, sheet_rows_panel


def write_panel(panel: DataFrame, path: str, mode="overwrite") -> None:
    """Fixed columns, one folder per as-of day; other days of the target stay, whatever the session's settings.

    Rows are gathered by day, and adaptive execution splits large days over several tasks.
    """
    rows = schemas.conform(panel, schemas.PANEL).hint("rebalance", F.col("as_of_date"))
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("as_of_date").parquet(path)


def write_sheets(rows: DataFrame, slugs: dict, source: str, path: str, tier="any", drop=(), mode="overwrite") -> dict[str, int]:
    """The panel of sheet rows, written, and the counts that were observed while it was written.

    The counts come from the writing pass itself, so nothing is read twice for them: n_sheet_rows, n_undated (rows
    without a date, which are left out), n_rows of the panel, and n_<status> for each status, with n_unknown for all other words.
    """
    seen, kept = Observation("sheets"), Observation("panel")
    status, undated = F.col("availability_status"), cells.sheet_date(named_cell(fv.SHEET_DATE_HEADER)).isNull()
    rows = checked_sheets(rows, slugs, drop).observe(seen, F.count(F.lit(1)).alias("n_sheet_rows"), F.count_if(undated).alias("n_undated"))
    panel = sheet_rows_panel(rows, slugs, source, tier, drop, strict=False).observe(
        kept, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(status == s).alias(f"n_{s}") for s in fv.STATUSES],
        F.count_if(~status.isin(*fv.STATUSES)).alias("n_unknown"))
    write_panel(panel, path, mode)
    return seen.get | kept.get


def append_quotes(rows: DataFrame, path: str) -> None:
    """Append with the fixed columns; extra columns are dropped, missing ones are null."""
    schemas.conform(rows, schemas.QUOTES).write.mode("append").parquet(path)


def write_results(results: dict, folder: str, fmt="parquet") -> list[str]:
    """Write every named result as its own table; returns the folders."""
    out = []
    for name, df in results.items():
        target = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(target)
        out.append(target)
    return out
