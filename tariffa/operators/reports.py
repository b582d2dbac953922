"""Headline numbers and the pass/warn table over finished results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tariffa.operators.rank import weighted
from tariffa.schemas import union_all


def _lines(df: DataFrame, fields, rows) -> DataFrame:
    """Lay several result rows out of each row of `df` (one read for all of them)."""
    return df.select(F.inline(F.array(*[
        F.struct(*[c.cast(t).alias(n) for c, (n, t) in zip(row, fields)]) for row in rows])))


def headline_kpis(verdicts: DataFrame, demand_days: DataFrame, parity: DataFrame, premium: DataFrame, subject: str,
                  premium_pair: str, claimed_premium=0.0) -> DataFrame:
    """The dashboard's headline rows, one per number.

    Six numbers; the demand correlation has one row for each of its three parts and the
    premium one row each for the claimed and the observed value.
    """
    mine = verdicts.where(F.col("property") == subject)
    gap = parity.where(F.col("property") == subject)
    pair = premium.where((F.col("pair") == premium_pair) & (F.col("channel") == "all"))
    fields = (("kpi", "string"), ("unit", "string"), ("value", "double"), ("label", "string"), ("n_used", "bigint"))
    none = F.lit(None)
    t, c = F.lit, F.col
    return union_all([
        _lines(mine, fields, [
            (t("verdict_label"), t("categorical"), none, c("display_label"), c("n_rules_observed")),
            *[(t(f"demand_response_r_{k}"), t("pearson_r"), c(f"r_{k}"), none, c(f"n_{k}")) for k in ("1a", "1b", "1b_levels")],
            (t("dow_normalized_range_pct"), t("pct"), c("dow_range") * 100, none, c("n_dow"))]),
        _lines(demand_days, fields, [
            (t("days_high_demand_count"), t("count"), c("n_high"), none, c("n_dates")),
            (t("view_premium_claimed_usd"), t("usd"), t(claimed_premium), none, t(0))]),
        _lines(gap, fields, [(t("channel_gap_median_pct"), t("pct"), c("median_gap") * 100, none, c("n_dates"))]),
        _lines(pair, fields, [(t("view_premium_observed_usd"), t("usd"), c("median_usd"), none, c("n"))]),
    ])


def _checked(df: DataFrame, rows) -> DataFrame:
    """(check, value, ok) rows of one frame from one aggregate; an unknown value passes."""
    sums = df.agg(*[value.cast("double").alias(name) for name, value, _ in rows])
    fields = (("check", "string"), ("value", "double"), ("ok", "boolean"))
    return _lines(sums, fields, [
        (F.lit(name), F.col(name), F.coalesce(ok(F.col(name)), F.lit(True))) for name, _, ok in rows])


def invariants(panel: DataFrame, verdicts: DataFrame, compression: DataFrame, profile: DataFrame, explorer: DataFrame,
               composite: DataFrame, subject: str, min_rows=1500, min_dates=360, min_cells=200, weight=None) -> DataFrame:
    """Checks on finished results as (check, value, ok) rows; `weight` names the panel's count column, if it has one."""
    per_date = panel.groupBy("arrival_date").agg(weighted(weight).alias("n"))
    mine = F.col("property") == subject
    pct = F.array("subject_pct", "peer_pct")
    at = lambda c: F.max(F.when(mine, F.col(c)))
    worst_r = F.max(F.greatest(*[F.abs(F.coalesce(c, F.lit(0.0))) for c in ("r_1a", "r_1b", "r_1b_levels")]))
    return union_all([
        _checked(verdicts, [
            ("correlation_bound", worst_r, lambda v: v <= 1.0 + 1e-9),
            ("weekly_range_min", F.min("dow_range"), lambda v: v >= 0)]),
        _checked(per_date, [
            ("panel_rows", F.sum("n"), lambda v: v >= min_rows),
            ("panel_dates", F.count(F.lit(1)), lambda v: v >= min_dates)]),
        _checked(compression, [
            ("compression_rows", F.count(F.lit(1)), lambda v: v.between(1, 60)),
            ("demand_min", F.min("market_demand_frac"), lambda v: v >= 0),
            ("demand_max", F.max("market_demand_frac"), lambda v: v <= 1),
            ("percent_min", F.min(F.array_min(pct)), lambda v: v >= -1.0),
            ("percent_max", F.max(F.array_max(pct)), lambda v: v <= 5.0)]),
        _checked(profile, [
            ("subject_mean_pct", at("mean_pct"), lambda v: F.abs(v) <= 0.15),
            ("subject_p95_pct", at("p95_pct"), lambda v: v <= 1.30),
            ("subject_plateau_dates", at("n_on_plateau"), lambda v: v >= 150),
            ("peers_p95_over_25", F.count_if(~mine & (F.col("p95_pct") >= 0.25)), lambda v: v >= 3)]),
        _checked(composite, [
            ("diagnostic_dates", F.count_if(F.col("peer_median_pct") - F.col("subject_pct") >= 0.20), lambda v: v >= 30)]),
        _checked(explorer, [("cells_per_property", F.min("n"), lambda v: v >= min_cells)]),
    ])
