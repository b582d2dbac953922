"""A small table with counts that stands for the panel.

Rows of one property and date that agree in source, tier, status, price and market figures are one row with `n_rows`; its
stay and order columns are those of the first of them, `last_row` holds those of the last (null for one row alone). So whatever picks first rows (first series, demand, peer status) reads
the table as it reads the panel, and whatever counts or ranks takes `weight=N_ROWS`. Parts merge: counts add up, the first row
of several parts is the first of their first rows, and the last row the last of their last rows. Stored by as-of day, a new or mended day rewrites only its own folder.

Null keys are values of their own. An empty panel gives an empty table. Other columns of the panel are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tariffa.operators.rank import date_led, weight_of
from tariffa.session import stored

N_ROWS, LAST = "n_rows", "last_row"
KEYS = ("source", "room_tier", "property", "arrival_date", "availability_status", "rate_usd", "market_demand_frac", "market_otb_frac")
AS_OF = "as_of_date"


def price_days(panel: DataFrame, order, as_of=False, weight=None) -> DataFrame:
    """The counted rows; with `as_of` also apart by as-of day. `order` is a unique order of the panel's rows after the stay."""
    keys, firsts = [*([AS_OF] if as_of else []), *KEYS], ["length_of_stay_nights", *order]
    # the groups are sorted by date and property, and so is what is stored: whatever groups by them finds its rows in order
    rows = panel.select(*keys, F.struct(*firsts).alias("_own"), last_row(panel, order).alias("_last"), weight_of(weight).cast("long").alias("_times"))
    groups = rows.groupBy(*sorted(date_led(keys), key=lambda k: k not in ("arrival_date", "property"))).agg(F.sum("_times").alias(N_ROWS), F.min("_own").alias("_first"), F.max("_last").alias("_last"))
    last = F.when(~F.col("_last").eqNullSafe(F.col("_first")), F.col("_last"))
    return groups.select(*keys, "_first.*", last.alias(LAST), N_ROWS)


def last_row(rows: DataFrame, order) -> Column:
    """Stay and order columns of the last row that a row stands for: of a counted one, or of a panel row itself."""
    own = F.struct("length_of_stay_nights", *order)
    return F.coalesce(F.col(LAST), own) if LAST in rows.columns else own


def merged_days(days: DataFrame, order) -> DataFrame:
    """Parts of the table (as-of days, batches) as one."""
    return price_days(days, order, weight=N_ROWS)


def refresh(panel: DataFrame, path: str, order) -> None:
    """Write the as-of days that the panel holds; the other days of the stored table stay as they are."""
    days = price_days(panel, order, as_of=True).hint("rebalance", F.col(AS_OF))
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(AS_OF).parquet(path)


def read(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """The stored table, or its as-of days in a range; only their folders are read."""
    days = spark.read.parquet(path)
    if since is not None:
        days = days.where(F.col(AS_OF) >= F.lit(since).cast("date"))
    if until is not None:
        days = days.where(F.col(AS_OF) <= F.lit(until).cast("date"))
    return days


def counted(panel: DataFrame, order) -> DataFrame:
    """The table of a panel, written to the work folder: all results of one build read the panel once."""
    return stored(price_days(panel, order), "price-days")
