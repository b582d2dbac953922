"""Series analytics: flat runs, weekday baselines, first differences, weekly ranges.

Every window here runs over one row per property and date, so its size is bounded by
the calendar and not by the number of panel rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tariffa import fixed_values as fv
from tariffa.functions import cells, stats
from tariffa.operators.panel import quoted
from tariffa.operators.rank import describe, exact_median, join_on, order_statistics

KEYS = ("property",)


# ------------------------------------------------------------------ flat runs
def flat_steps(series: DataFrame, keys=KEYS, max_step=fv.FLAT_MAX_STEP) -> DataFrame:
    """Number the maximal runs of a price series.

    A run breaks when the price moves by `max_step` or more against the observation
    before, or when that one is 0. Missing dates do not break a run.
    """
    by_date = Window.partitionBy(*keys).orderBy("arrival_date")
    prev = F.lag("rate_usd").over(by_date)
    moved = F.try_divide(F.abs(F.col("rate_usd") - prev), F.abs(prev)) >= (
        F.col(max_step) if isinstance(max_step, str) else F.lit(max_step))
    breaks = prev.isNull() | (prev == 0) | moved
    return series.where(F.col("rate_usd").isNotNull()).withColumn("_break", breaks.cast("int")).withColumn(
        "run", F.sum("_break").over(by_date)).drop("_break")


def runs(series: DataFrame, keys=KEYS, min_days=fv.FLAT_MIN_DAYS, max_step=fv.FLAT_MAX_STEP) -> DataFrame:
    """All runs with their dates, length and median; `is_flat` marks the plateaus.

    A plateau is a run whose number of observations and calendar span both reach
    `min_days`.
    """
    limit = F.col(min_days) if isinstance(min_days, str) else F.lit(min_days)
    found = flat_steps(series, keys, max_step).groupBy(*keys, "run").agg(
        F.min("arrival_date").alias("start_date"), F.max("arrival_date").alias("end_date"),
        F.count(F.lit(1)).alias("n_obs"), F.median("rate_usd").alias("median_usd"))
    span = F.date_diff("end_date", "start_date") + 1
    return found.withColumn("span_days", span).withColumn(
        "is_flat", (F.col("n_obs") >= limit) & (span >= limit)).drop("run")


def flat_runs(series: DataFrame, keys=KEYS, min_days=fv.FLAT_MIN_DAYS, max_step=fv.FLAT_MAX_STEP) -> DataFrame:
    """The plateaus of a series."""
    return runs(series, keys, min_days, max_step).where("is_flat").drop("is_flat")


def mark_flat(series: DataFrame, keys=KEYS, min_days=fv.FLAT_MIN_DAYS, max_step=fv.FLAT_MAX_STEP) -> DataFrame:
    """The series with a flag on every date that lies in a plateau."""
    run = Window.partitionBy(*keys, "run")
    span = F.date_diff(F.max("arrival_date").over(run), F.min("arrival_date").over(run)) + 1
    flat = (F.count(F.lit(1)).over(run) >= min_days) & (span >= min_days)
    return flat_steps(series, keys, max_step).withColumn("on_plateau", flat).drop("run")


def _flat_shares(series: DataFrame, keys, min_days, max_step) -> DataFrame:
    flat = F.col("is_flat")
    by_span = F.struct((-F.col("span_days")).alias("s"), F.col("start_date").alias("d"), F.col("median_usd").alias("m"))
    return runs(series, keys, min_days, max_step).groupBy(*keys).agg(
        F.sum("n_obs").alias("n_observed"), F.coalesce(F.sum(F.when(flat, F.col("n_obs"))), F.lit(0)).alias("n_on_plateau"),
        F.coalesce(F.max(F.when(flat, F.col("span_days"))), F.lit(0)).alias("longest_plateau_days"),
        F.count_if(flat).alias("n_plateaus"),
        F.transform(F.array_sort(F.collect_list(F.when(flat, by_span))), lambda r: r["m"]).alias("plateau_values_usd"),
    ).withColumn("pct_flat", F.try_divide("n_on_plateau", "n_observed"))


def flatness(series: DataFrame, properties=None, min_days=fv.FLAT_MIN_DAYS, max_step=fv.FLAT_MAX_STEP) -> DataFrame:
    """Share of observed dates on plateaus, longest span and plateau prices by span.

    With `properties`, listed properties without any price get a zero row.
    """
    out = _flat_shares(series, KEYS, min_days, max_step)
    if properties is not None:
        listed = series.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, properties))).alias("property"))
        zeros = {c: 0 for c in ("n_observed", "n_on_plateau", "longest_plateau_days", "n_plateaus")}
        out = listed.join(out, "property", "left").fillna(zeros).withColumn(
            "plateau_values_usd", F.coalesce("plateau_values_usd", F.array().cast("array<double>")))
    return out.select("property", "n_observed", "n_on_plateau", "pct_flat", "longest_plateau_days", "n_plateaus",
                      "plateau_values_usd")


def flatness_combos(series: DataFrame, subject: str, combos=fv.FLAT_COMBOS) -> DataFrame:
    """Flatness under several parameter sets, against the median of the other properties.

    A set passes when the subject's share is at least twice the peers' median, or is
    positive while that median is zero or unknown.
    """
    options = F.array(*[
        F.struct(F.lit(n).alias("combo"), F.lit(d).alias("min_days"), F.lit(s).alias("max_step")) for n, d, s in combos])
    keys = ("combo", "min_days", "max_step", "property")
    shares = _flat_shares(series.select("*", F.inline(options)), keys, "min_days", "max_step")
    is_subject = F.col("property") == subject
    of_set = describe(shares, ["combo"], [F.max(F.when(is_subject, F.col("pct_flat"))).alias("_mine")], {"_peers": F.when(~is_subject, F.col("pct_flat"))})
    shares = join_on(shares, of_set, ["combo"])
    mine, peers = F.col("_mine"), F.col("_peers")
    ratio = F.when(peers > 0, mine / peers)
    passed = F.coalesce(ratio >= 2.0, F.lit(False)) | (
        F.coalesce(mine > 0, F.lit(False)) & (peers.isNull() | (peers == 0)))
    return shares.select(
        "combo", "property", "n_observed", "n_on_plateau", "pct_flat", "longest_plateau_days",
        peers.alias("peer_median_pct"), ratio.alias("subject_ratio"), passed.alias("combo_passes"))


def below_ceiling(combos: DataFrame, properties, combo="loosened", ceiling=0.10) -> DataFrame:
    """Are the listed properties under a flat share ceiling in one parameter set?"""
    return combos.where((F.col("combo") == combo) & F.col("property").isin(*properties)).select(
        "property", "pct_flat", (F.coalesce("pct_flat", F.lit(0.0)) < ceiling).alias("below"))


def flat_stretches(rows: DataFrame, subject: str, peers=None, min_days=fv.FLAT_MIN_DAYS,
                   max_step=fv.FLAT_MAX_STEP) -> DataFrame:
    """The subject's flat stretches with the peers' median price inside each.

    Stretches of one subject do not overlap, so a stretch is laid out as its calendar
    days and the peers join on the date: an equi-join instead of a range join.
    """
    own = exact_median(rows.where(F.col("property") == subject), ["property", "arrival_date"], "rate_usd", fine=True)
    flat = flat_runs(own, KEYS, min_days, max_step)
    days = flat.select("start_date", F.explode(F.sequence("start_date", "end_date")).alias("arrival_date"))
    others = rows.where((F.col("property") != subject) if peers is None else F.col("property").isin(*peers))
    inside = others.select("arrival_date", "rate_usd").join(days, "arrival_date")
    peer = exact_median(inside, ["start_date"], {"peer_median_during": "rate_usd"})
    return flat.join(peer, "start_date", "left").select(
        "property", F.bround("median_usd").cast("int").alias("rate_usd"), "start_date", "end_date",
        F.col("span_days").alias("days"), F.col("n_obs").alias("n_observed"), "peer_median_during")


def panel_overlap(stretches: DataFrame, labelled: DataFrame) -> DataFrame:
    """First and last date label of each panel inside each stretch.

    `labelled` has the dates drawn in each panel. A stretch without a label inside the
    panel does not appear.
    """
    days = stretches.select(
        "start_date", "end_date", "rate_usd", F.explode(F.sequence("start_date", "end_date")).alias("arrival_date"))
    labels = labelled.select("panel", "arrival_date").distinct()
    return labels.join(days, "arrival_date").groupBy("panel", "start_date", "end_date", "rate_usd").agg(
        F.min("arrival_date").alias("first_label"), F.max("arrival_date").alias("last_label"))


# ------------------------------------------------------------------ dual baseline
def dual_baseline(series: DataFrame, smooth_rows=7, keys=KEYS, min_days=fv.FLAT_MIN_DAYS,
                  max_step=fv.FLAT_MAX_STEP) -> DataFrame:
    """Price against its weekday median, forced to 0 on plateaus, and its trailing mean."""
    marked = mark_flat(series, keys, min_days, max_step).withColumn("weekday", cells.weekday("arrival_date"))
    base = F.median("rate_usd").over(Window.partitionBy(*keys, "weekday"))
    trailing = Window.partitionBy(*keys).orderBy("arrival_date").rowsBetween(-(smooth_rows - 1), 0)
    pct = F.when(F.col("on_plateau"), F.lit(0.0)).otherwise(
        F.try_divide(F.col("rate_usd") - F.col("baseline_usd"), F.nullif("baseline_usd", F.lit(0.0))))
    return (
        marked.withColumn("baseline_usd", base).withColumn("pct", pct)
        .withColumn("pct_smoothed", F.avg("pct").over(trailing)))


def yield_series(series: DataFrame, smooth_rows=7, **limits) -> DataFrame:
    return dual_baseline(series, smooth_rows, **limits).select(
        "property", "arrival_date", "rate_usd", "baseline_usd", "on_plateau",
        F.col("pct_smoothed").alias("pct_above_baseline"))


def yield_composite(yields: DataFrame, subject: str) -> DataFrame:
    """Per date: the subject's smoothed percent and the peers' median, range and count."""
    mine = F.col("property") == subject
    pct = F.col("pct_above_baseline")
    peer = F.when(~mine, pct)
    return exact_median(yields, ["arrival_date"], {"peer_median_pct": peer}, fine=True, merged={
        "subject_pct": (F.when(mine, pct), "max"), "peer_min_pct": (peer, "min"), "peer_max_pct": (peer, "max"),
        "n_peers": (F.when(~mine, 1).otherwise(0), "sum")}).select(
        "arrival_date", "subject_pct", "peer_median_pct", "peer_min_pct", "peer_max_pct", "n_peers")


def diagnostic_dates(composite: DataFrame, gap=fv.DIAGNOSTIC_GAP) -> DataFrame:
    """Dates on which the peers yield while the subject holds."""
    return composite.where(F.col("peer_median_pct") - F.col("subject_pct") >= gap)


def series_profile(yields: DataFrame, share=0.95) -> DataFrame:
    """Count, mean, median, nearest-rank percentile and range of the smoothed percent."""
    v = "pct_above_baseline"
    plain = yields.groupBy("property").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean_pct"), F.median(v).alias("median_pct"),
        F.min(v).alias("min_pct"), F.max(v).alias("max_pct"),
        F.count_if("on_plateau").alias("n_on_plateau"))
    high = order_statistics(yields, ["property"], {"p95": v}, {
        "_pct": lambda n: F.bround(share * (n - 1)).cast("long")})
    return plain.join(high, "property", "left")


# ------------------------------------------------------------------ correlation rules
def corr_levels(panel: DataFrame, metric: str, at_least: float, low_n: int, keys=KEYS) -> DataFrame:
    """Pearson r of price and a metric per property, with the counts behind it."""
    ok = quoted() & F.col(metric).isNotNull()
    r = stats.pearson(F.col("rate_usd"), F.col(metric), ok)
    n = F.count_if(ok)
    return panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), n.alias("n_used"), r.alias("r"), stats.over(r, at_least).alias("passes"),
        (r.isNull() | (n < low_n)).alias("low_power"), *stats.status_counts())


def day_steps(panel: DataFrame, metric: str, order, keys=KEYS) -> DataFrame:
    """Changes of price and metric between neighbouring rows exactly one day apart.

    In (date, stay, order) sequence, only the last row of a day and the first row of
    the next can be one day apart, so two rows per date are enough.
    """
    sequence = ["length_of_stay_nights", *order]
    row = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(sequence)],
                   F.col("rate_usd").alias("rate"), F.col(metric).cast("double").alias("metric"))
    ends = panel.where(quoted() & F.col(metric).isNotNull()).groupBy(*keys, "arrival_date").agg(
        F.min(row).alias("head"), F.max(row).alias("tail"))
    by_date = Window.partitionBy(*keys).orderBy("arrival_date")
    before = F.lag("tail").over(by_date)
    return ends.select(
        *keys, "arrival_date", (F.date_diff("arrival_date", F.lag("arrival_date").over(by_date)) == 1).alias("next_day"),
        (F.col("head.rate") - before["rate"]).alias("d_rate"), (F.col("head.metric") - before["metric"]).alias("d_metric"))


def corr_diffs(panel: DataFrame, metric: str, order, at_least: float, low_n: int, keys=KEYS) -> DataFrame:
    """Pearson r of day-over-day changes, with the counts behind it."""
    step = F.col("next_day")
    r = stats.pearson(F.col("d_rate"), F.col("d_metric"), step)
    pairs = day_steps(panel, metric, order, keys).groupBy(*keys).agg(F.count_if(step).alias("n_used"), r.alias("r"))
    totals = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), *stats.status_counts())
    n = F.coalesce("n_used", F.lit(0))
    return totals.join(pairs, list(keys), "left").withColumns({
        "n_used": n, "passes": stats.over(F.col("r"), at_least), "low_power": F.col("r").isNull() | (n < low_n)})


def rolling(weekly: DataFrame, keys=KEYS) -> DataFrame:
    """Trailing four-week mean of range over mean price, for weeks with hi, lo and mean."""
    ratio = F.when(F.col("mean") > 0, (F.col("hi") - F.col("lo")) / F.col("mean"))
    four = Window.partitionBy(*keys).orderBy("iso_year", "iso_week").rowsBetween(-3, 0)
    return weekly.withColumn("ratio", ratio).withColumn(
        "rolling", F.when(F.count("ratio").over(four) >= 2, F.avg("ratio").over(four)))


def weekly_range(panel: DataFrame, at_least=fv.WEEK_RANGE_MIN, low_n=fv.WEEK_RANGE_LOW_N, keys=KEYS) -> DataFrame:
    """Median over weeks of the trailing four-week mean of (max - min) / mean price."""
    weekly = panel.where(quoted()).groupBy(
        *keys, cells.iso_year("arrival_date").alias("iso_year"), F.weekofyear("arrival_date").alias("iso_week")).agg(
        stats.distinct_weekdays("arrival_date").alias("n_weekdays"), F.count(F.lit(1)).alias("n"),
        F.max("rate_usd").alias("hi"), F.min("rate_usd").alias("lo"), F.avg("rate_usd").alias("mean"))
    value = rolling(weekly, keys).groupBy(*keys).agg(
        F.median("rolling").alias("value"), F.count_if(F.col("n_weekdays") >= 5).alias("n_full_weeks"),
        F.sum("n").alias("n_used"))
    totals = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), *stats.status_counts())
    return totals.join(value, list(keys), "left").withColumns({
        "n_used": F.coalesce("n_used", F.lit(0)), "n_full_weeks": F.coalesce("n_full_weeks", F.lit(0)),
        "passes": stats.over(F.col("value"), at_least),
        "low_power": F.col("value").isNull() | (F.coalesce("n_full_weeks", F.lit(0)) < low_n)})
