"""Panel slices, one-row-per-date reductions and direct panel reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tariffa import fixed_values as fv
from tariffa.functions import cells, stats
from tariffa.functions.text import fields_contain
from tariffa.operators.rank import describe, exact_median, first_row, ranked, weighted


def _matches(name: str, wanted) -> Column:
    if wanted is None:
        return F.lit(True)
    return F.col(name).isin(*([wanted] if isinstance(wanted, str) else list(wanted)))


def panel_slice(panel: DataFrame, source=None, tier=None, properties=None, available=True) -> DataFrame:
    """Rows of the given source, tier and properties (a name, a list, or None for all).

    With `available`, only rows that carry a usable price.
    """
    out = panel.where(_matches("source", source) & _matches("room_tier", tier) & _matches("property", properties))
    return out.where(quoted()) if available else out


def quoted() -> Column:
    return (F.col("availability_status") == "available") & F.col("rate_usd").isNotNull()


def status_breakdown(panel: DataFrame, keys=("property",)) -> DataFrame:
    return panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), *stats.status_counts())


def ingest_counts(panel: DataFrame) -> DataFrame:
    """Long diagnostics: rows per status, per property for two statuses, distinct stays.

    One pass: rows are counted by status, property and stay first, and these few counts are laid out as lines.
    """
    few = panel.groupBy("availability_status", "property", "length_of_stay_nights").agg(F.count(F.lit(1)).alias("n"))
    marked = F.col("availability_status").isin("not_loaded", "sold_out")
    def line(what, name, when):
        return F.when(when, F.struct(what.alias("what"), F.col(name).cast("string").alias("name"), "n"))
    lines = F.array(
        line(F.lit("status"), "availability_status", F.lit(True)),
        line(F.concat("availability_status", F.lit("_by_property")), "property", F.coalesce(marked, F.lit(False))),
        line(F.lit("length_of_stay"), "length_of_stay_nights", F.col("length_of_stay_nights").isNotNull()))
    return few.select(F.inline(F.filter(lines, lambda x: x.isNotNull()))).groupBy("what", "name").agg(F.sum("n").alias("n"))


def first_per_date(rows: DataFrame, order, columns, keys=("property", "arrival_date")) -> DataFrame:
    """First row per date: shortest stay, then the given unique order."""
    return first_row(rows, keys, ["length_of_stay_nights", *order], columns)


def median_series(rows: DataFrame, keys=("property", "arrival_date"), weight=None) -> DataFrame:
    """One price per date: the median over stays (and over all other rows of the slice)."""
    return exact_median(rows, keys, "rate_usd", fine=True, weight=weight)


def first_series(rows: DataFrame, order, keys=("property", "arrival_date")) -> DataFrame:
    """One price per date: the first row's price."""
    return first_per_date(rows, order, ["rate_usd"], keys)


def demand_series(rows: DataFrame, order) -> DataFrame:
    """Market demand and on-the-books share, one row per date."""
    out = first_per_date(rows, order, ["market_demand_frac", "market_otb_frac"], ("arrival_date",))
    return out.withColumn("dow", cells.day_label(F.lit(None).cast("string"), "arrival_date"))


def high_demand_days(demand: DataFrame, above=fv.HIGH_DEMAND) -> DataFrame:
    return demand.agg(
        F.count_if(F.col("market_demand_frac") > above).alias("n_high"), F.count(F.lit(1)).alias("n_dates"))


def populated_share(demand: DataFrame, metrics=("market_demand_frac", "market_otb_frac")) -> DataFrame:
    """Share of dates on which a metric is known."""
    return demand.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics
    ]))).groupBy("metric").agg(
        F.count("v").alias("n_populated"), F.count(F.lit(1)).alias("n_dates"),
        (F.count("v") / F.count(F.lit(1))).alias("share"))


def top_dates(demand: DataFrame, n: int) -> DataFrame:
    """The n dates with the highest demand; earlier dates win ties."""
    return demand.where(F.col("market_demand_frac").isNotNull()).orderBy(
        F.desc("market_demand_frac"), "arrival_date").limit(n)


def month_starts(dates: DataFrame) -> DataFrame:
    """Position of the first date of each month in the sorted list of dates (0-based)."""
    days = dates.select("arrival_date").distinct()
    months = days.groupBy(F.date_trunc("month", "arrival_date").cast("date").alias("month")).agg(
        F.min("arrival_date").alias("first_date"), F.count(F.lit(1)).alias("n_dates"))
    before = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    return months.select("month", "first_date", "n_dates", F.coalesce(F.sum("n_dates").over(before), F.lit(0)).alias("position"))


def tier_position(rows: DataFrame) -> DataFrame:
    """Median, mean and count of prices per property and tier."""
    return describe(rows, ["property", "room_tier"], [
        F.avg("rate_usd").alias("mean_usd"), F.count("rate_usd").alias("n")], {"median_usd": "rate_usd"})


def tier_spread(rows: DataFrame, lower="standard", upper="premium") -> DataFrame:
    """Median of each tier per date, side by side, with upper minus lower."""
    medians = exact_median(rows.where(F.col("room_tier").isin(lower, upper)), ["arrival_date", "room_tier"], "rate_usd", fine=True)
    at = lambda tier: F.max(F.when(F.col("room_tier") == tier, F.col("rate_usd")))
    return medians.groupBy("arrival_date").agg(
        at(lower).alias(f"{lower}_median_usd"), at(upper).alias(f"{upper}_median_usd"),
        (at(upper) - at(lower)).alias("spread_usd"))


def parity_gap(rows: DataFrame, left: str, right: str, order, keys=("property",)) -> DataFrame:
    """Median of |left - right| / min over the dates on which both channels quote.

    The price of a date and channel is its first non-null one.
    """
    priced = rows.where(F.col("source").isin(left, right) & F.col("rate_usd").isNotNull())
    first = first_per_date(priced, order, ["rate_usd"], (*keys, "arrival_date", "source"))
    at = lambda ch: F.max(F.when(F.col("source") == ch, F.col("rate_usd")))
    both = first.groupBy(*keys, "arrival_date").agg(at(left).alias("a"), at(right).alias("b")).where(
        "a is not null and b is not null")
    gap = both.withColumn("gap", F.try_divide(F.abs(F.col("a") - F.col("b")), F.least("a", "b")))
    return describe(gap, keys, [F.count(F.lit(1)).alias("n_dates")], {"median_gap": "gap"})


def los_restrictions(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("availability_status") == "los_restricted").select(
        "arrival_date", "property", F.col("los_restriction").cast("int").alias("los_restriction"))


def los_grid(panel: DataFrame, properties) -> DataFrame:
    """Dates by property with the largest stay restriction; one column per listed property."""
    rows = los_restrictions(panel).where(F.col("property").isin(*properties))
    return rows.groupBy("arrival_date").agg(*[
        F.max(F.when(F.col("property") == p, F.col("los_restriction"))).alias(p) for p in properties])


def rate_lines(rows: DataFrame) -> DataFrame:
    return rows.select("property", "arrival_date", "rate_usd")


def weekday_pattern(rows: DataFrame) -> DataFrame:
    return rows.select(
        "property", cells.iso_year("arrival_date").alias("iso_year"), F.weekofyear("arrival_date").alias("iso_week"),
        "arrival_date", F.date_format("arrival_date", "EEE").alias("dow"), "rate_usd")


def demand_scatter(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("market_demand_frac").isNotNull()).select(
        "property", "arrival_date", F.col("market_demand_frac").alias("demand_frac"), "rate_usd")


def explorer_feed(rows: DataFrame, labels: dict, channel="direct") -> DataFrame:
    """Row feed with display labels (the slug where there is none) and one channel name."""
    names = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    return rows.select(
        "arrival_date", F.date_format("arrival_date", "EEE").alias("dow"),
        F.coalesce(F.try_element_at(names, F.col("property")), F.col("property")).alias("property"),
        "rate_usd", "room_tier", F.lit(channel).alias("channel"))


def explorer_profile(rows: DataFrame, weight=None) -> DataFrame:
    """Count, range, median and distinct dates per property."""
    per_date = rows.groupBy("property", "arrival_date").agg(
        weighted(weight).alias("n"), F.min("rate_usd").alias("lo"), F.max("rate_usd").alias("hi"))
    plain = per_date.groupBy("property").agg(
        F.sum("n").alias("n"), F.min("lo").alias("min_usd"), F.max("hi").alias("max_usd"),
        F.count(F.lit(1)).alias("n_dates"))
    return plain.join(exact_median(rows, ["property"], {"median_usd": "rate_usd"}, weight=weight), "property", "left")


def quarter_lines(rows: DataFrame, ranges) -> DataFrame:
    """Rows tagged with every named date range (label, first day, last day) that holds them.

    The ranges are literals of fixed number, so this is a projection and not a join.
    """
    named = F.array(*[
        F.struct(F.lit(n).alias("panel"), F.lit(a).cast("date").alias("panel_start"),
                 F.lit(b).cast("date").alias("panel_end")) for n, a, b in ranges])
    inside = F.filter(named, lambda r: F.col("arrival_date").between(r["panel_start"], r["panel_end"]))
    return rows.select("property", "arrival_date", "rate_usd", F.inline(inside))


def clipped(rows: DataFrame, cap: float) -> DataFrame:
    """The price as drawn under a cap, beside the actual price."""
    return rows.withColumn("shown_usd", F.least(F.col("rate_usd"), F.lit(cap))).withColumn(
        "is_clipped", F.col("rate_usd") > cap)


def sample_rows(rows: DataFrame, key, n: int, seed: int) -> DataFrame:
    """Repeatable sample of n rows: the smallest md5 sums of the seed and a unique key as text."""
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))
    return rows.orderBy(mixed, *key).limit(n)


def dataset_meta(panel: DataFrame) -> DataFrame:
    """Rows, earliest as-of day and number of properties of a panel."""
    per_property = panel.groupBy("property").agg(F.count(F.lit(1)).alias("n"), F.min("as_of_date").alias("as_of"))
    return per_property.agg(
        F.sum("n").alias("n_rows"), F.min("as_of").alias("first_as_of"), F.count(F.lit(1)).alias("n_properties"))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values, sorted."""
    return rows.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def filter_text(rows: DataFrame, needle: str) -> DataFrame:
    """Rows in which any column contains the text, ignoring case."""
    return rows.where(fields_contain(rows.columns, needle))


def sort_positions(rows: DataFrame, column: str, descending=False, tie=()) -> DataFrame:
    """All rows with their 1-based position in the order of a number, nulls last, ties by `tie`."""
    return ranked(rows, [], F.col(column) if descending else -F.col(column), list(tie), "position")


def sort_nulls_last(rows: DataFrame, column: str, descending=False, tie=()) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), *tie)


def forbidden_rows(panel: DataFrame, forbidden) -> DataFrame:
    """Rows per property that must not be in the panel; an empty result means it is clean."""
    return panel.where(F.col("property").isin(*forbidden)).groupBy("property").count().withColumnRenamed("count", "n")
