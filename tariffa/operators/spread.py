"""Subject price against the peers' median, by demand.

`weight` names the column that says how many rows a row stands for (see `price_days`); without it each counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tariffa import fixed_values as fv
from tariffa.functions.plans import demand_bucket, spread_verdict
from tariffa.functions.text import case
from tariffa.operators.panel import first_series, top_dates
from tariffa.operators.rank import describe, exact_median, first_row, weight_of, weighted
from tariffa.operators.series import dual_baseline


def peer_median(rows: DataFrame, peers, weight=None) -> DataFrame:
    """Per date: median and number of the peers' quoted rows (all stays pooled). A counted table is read twice and not shuffled."""
    return exact_median(rows.where(F.col("property").isin(*peers)), ["arrival_date"], {"peer_median_usd": "rate_usd"}, fine=weight is None,
                        merged={"n_peers": (weight_of(weight), "sum")}, weight=weight)


def spread_rows(rows: DataFrame, subject: str, peers, keep=(), weight=None) -> DataFrame:
    """One row per subject quote with known demand; a date without peers keeps a null gap."""
    mine = rows.where((F.col("property") == subject) & F.col("market_demand_frac").isNotNull())
    dated = rows.where(F.col("arrival_date").isNotNull())
    return (
        mine.select("arrival_date", "rate_usd", "market_demand_frac", *keep, *([] if weight is None else [weight]))
        .join(peer_median(dated, peers, weight), "arrival_date", "left")
        .withColumn("n_peers", F.coalesce("n_peers", F.lit(0)))
        .withColumn("delta_usd", F.col("rate_usd") - F.col("peer_median_usd"))
        .withColumn("bucket", demand_bucket("market_demand_frac")))


def spread_by_bucket(spread: DataFrame, weight=None) -> DataFrame:
    """Rows, rows with a gap, distinct dates and median gap per demand bucket."""
    per_date = spread.groupBy("bucket", "arrival_date").agg(
        weighted(weight).alias("rows"), weighted(weight, F.col("delta_usd").isNotNull()).alias("gaps"))
    plain = per_date.groupBy("bucket").agg(
        F.sum("rows").alias("n_rows"), F.sum("gaps").alias("n_deltas"), F.count(F.lit(1)).alias("n_dates"))
    return plain.join(exact_median(spread, ["bucket"], {"median_delta_usd": "delta_usd"}, weight=weight), "bucket", "left")


def spread_headline(spread: DataFrame, weight=None) -> DataFrame:
    """Median gap on normal and high-demand rows, the move between them, and the verdict."""
    buckets = spread_by_bucket(spread, weight)
    at = lambda name, c: F.max(F.when(F.col("bucket") == name, F.col(c)))
    n = lambda name: F.coalesce(at(name, "n_deltas"), F.lit(0))
    head = buckets.agg(
        at("normal", "median_delta_usd").alias("delta_typical_usd"), at("high", "median_delta_usd").alias("delta_high_usd"),
        n("normal").alias("n_normal"), n("shoulder").alias("n_shoulder"), n("high").alias("n_high"),
        F.coalesce(at("high", "n_dates"), F.lit(0)).alias("n_high_dates"))
    move = F.col("delta_high_usd") - F.col("delta_typical_usd")
    return (
        head.withColumn("spread_movement_usd", move)
        .withColumn("classification", spread_verdict("spread_movement_usd", "n_high"))
        .withColumn("label", case([(F.col("classification") == k, v) for k, v in fv.SPREAD_LABELS])))


def collapse_dates(spread: DataFrame, weight=None) -> DataFrame:
    """One point per date: medians over stays; demand, bucket and peer count as they are."""
    return describe(spread, ["arrival_date"], [
        F.min("market_demand_frac").alias("market_demand_frac"), F.min("bucket").alias("bucket"),
        F.min("n_peers").alias("n_peers")],
        {"rate_usd": "rate_usd", "peer_median_usd": "peer_median_usd", "delta_usd": "delta_usd"}, fine=True, weight=weight)


# ------------------------------------------------------------------ high-bucket audit
def peer_status(panel: DataFrame, order) -> DataFrame:
    """Per property and date: the first available row, else the first row's status."""
    available = F.col("availability_status") == "available"
    return first_row(panel, ["property", "arrival_date"], [(~available), "length_of_stay_nights", *order],
                     ["availability_status", "rate_usd"])


def audit_grid(spread: DataFrame, panel: DataFrame, peers, order, weight=None) -> DataFrame:
    """Every peer on every high-demand date, with its status or `absent_row`.

    The peer list is a literal of fixed size, laid out per date.
    """
    dates = spread.where(F.col("bucket") == "high").groupBy("arrival_date").agg(weighted(weight).alias("n_rows"))
    grid = dates.select("*", F.explode(F.array(*map(F.lit, peers))).alias("property"))
    status = peer_status(panel.where(F.col("property").isin(*peers)), order)
    return grid.join(status, ["property", "arrival_date"], "left").withColumn(
        "availability_status", F.coalesce("availability_status", F.lit("absent_row")))


def audit_dates(grid: DataFrame) -> DataFrame:
    """Peers counted in and out per high-demand date; the lists are at most the peer set."""
    inside = F.col("availability_status") == "available"
    return grid.groupBy("arrival_date", "n_rows").agg(
        F.count_if(inside).alias("n_included"),
        F.array_sort(F.collect_list(F.when(inside, F.struct("property", "rate_usd")))).alias("included"),
        F.array_sort(F.collect_list(F.when(~inside, F.struct("property", "availability_status")))).alias("excluded"))


def audit_panel_sizes(grid: DataFrame) -> DataFrame:
    """How many high-demand rows have how many peers."""
    return audit_dates(grid).groupBy("n_included").agg(F.sum("n_rows").alias("n_rows"))


def audit_status_tally(grid: DataFrame) -> DataFrame:
    """Why peers dropped out of the high-demand rows."""
    return grid.where(F.col("availability_status") != "available").groupBy("availability_status").agg(
        F.sum("n_rows").alias("n_rows"))


def audit_sensitivity(spread: DataFrame, grid: DataFrame, min_peers=4, weight=None) -> DataFrame:
    """Median high-demand gap as it is and on dates with enough peers."""
    sizes = audit_dates(grid).select("arrival_date", "n_included")
    high = spread.where((F.col("bucket") == "high") & F.col("delta_usd").isNotNull()).join(sizes, "arrival_date")
    full = F.when(F.col("n_included") >= min_peers, F.col("delta_usd"))
    return describe(high.withColumn("full", full), [], [
        weighted(weight).alias("n_asis"), weighted(weight, F.col("full").isNotNull()).alias("n_full")],
        {"delta_high_asis": "delta_usd", "delta_high_full": "full"}, weight=weight).withColumn(
        "shift_usd", F.col("delta_high_full") - F.col("delta_high_asis"))


# ------------------------------------------------------------------ compression table
def compression(rows: DataFrame, demand: DataFrame, subject: str, peers, order, top_n=60, weight=None) -> DataFrame:
    """Top dates by demand with price, baseline and percent of the subject and of the peers.

    The peers' median per date is treated as one price series.
    """
    mine = first_series(rows.where(F.col("property") == subject), order)
    peer = peer_median(rows, peers, weight).select(F.lit("peers").alias("property"), "arrival_date",
                                           F.col("peer_median_usd").alias("rate_usd"))

    def side(series, name):
        return dual_baseline(series, 1).select(
            "arrival_date", F.col("rate_usd").alias(f"{name}_rate_usd"), F.col("baseline_usd").alias(f"{name}_baseline_usd"),
            F.col("pct").alias(f"{name}_pct"), F.col("on_plateau").alias(f"{name}_on_plateau"))

    dates = top_dates(demand, top_n).select("arrival_date", "market_demand_frac")
    out = dates.join(side(mine, "subject"), "arrival_date", "left").join(side(peer, "peer"), "arrival_date", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("subject_on_plateau", "peer_on_plateau")})


def anti_yield(table: DataFrame, below=fv.ANTI_YIELD) -> DataFrame:
    """High-demand dates on which the subject sits under its own baseline."""
    return table.where(F.col("subject_pct") < below)


# ------------------------------------------------------------------ recheck
def recheck(rows: DataFrame, spread: DataFrame, subject: str, peers, order, tolerance=0.50, weight=None) -> DataFrame:
    """Recompute the first row with a gap of each bucket from the slice, by another plan.

    The dates are picked first; then only the rows of those dates are read again.
    """
    first = first_row(spread.where(F.col("delta_usd").isNotNull()), ["bucket"], ["arrival_date", *order],
                      ["arrival_date", "rate_usd", "peer_median_usd", "delta_usd"])
    at_dates = first.select("bucket", "arrival_date")
    peer = exact_median(
        rows.where(F.col("property").isin(*peers)).join(at_dates, "arrival_date"), ["bucket"], {"again_peer_usd": "rate_usd"}, weight=weight)
    mine = first_row(
        rows.where((F.col("property") == subject) & F.col("market_demand_frac").isNotNull()).join(at_dates, "arrival_date"),
        ["bucket"], order, [F.col("rate_usd").alias("again_rate_usd")])
    off = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance, F.lit(False))
    return first.join(peer, "bucket", "left").join(mine, "bucket", "left").withColumn(
        "matches", off("rate_usd", "again_rate_usd") & off("peer_median_usd", "again_peer_usd"))
