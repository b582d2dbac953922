"""All result tables of a dashboard build, from one panel and one quote table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tariffa.operators import panel as P, price_days as D, quotes as Q, series as S, spread as X, verdicts as V


def panel_results(panel: DataFrame, subject: str, peers, order, source=None, tier=None, quarters=()) -> dict:
    """Named result frames of the panel.

    The scoped panel is counted into a small table at once (and the ranked verdicts are laid out); all else runs when it is
    written. Results that need no single rows take their parts from the counted table, so the panel is read for it once.
    """
    everyone = [subject, *peers]
    scoped = P.panel_slice(panel, source, tier, available=False)
    rows = P.panel_slice(scoped)
    days, w = D.counted(scoped, order), D.N_ROWS
    priced = P.panel_slice(days)
    demand = P.demand_series(days, order)
    yields = S.yield_series(P.first_series(P.panel_slice(priced, properties=everyone), order))
    day_spread = X.spread_rows(priced, subject, peers, weight=w)
    spread = X.spread_rows(rows, subject, peers, ("length_of_stay_nights", *order))
    grid = X.audit_grid(day_spread, days, peers, order, w)
    verdicts = V.rm_verdicts(P.panel_slice(scoped, properties=everyone, available=False), order)
    stretches = S.flat_stretches(rows, subject, peers)
    out = {
        "market_demand": demand, "top_dates": P.top_dates(demand, 5), "los_restrictions": P.los_restrictions(scoped),
        "flatness": S.flatness(P.median_series(priced, weight=w), everyone), "flat_stretches": stretches,
        "verdicts": V.comp_verdicts(verdicts), "yield_series": yields, "yield_composite": S.yield_composite(yields, subject),
        "spread_rows": spread, "spread_headline": X.spread_headline(day_spread, w), "spread_by_date": X.collapse_dates(day_spread, w),
        "audit_dates": X.audit_dates(grid), "audit_sensitivity": X.audit_sensitivity(day_spread, grid, weight=w),
        "compression": X.compression(priced, demand, subject, peers, order, weight=w),
        "explorer": P.explorer_feed(P.panel_slice(rows, properties=everyone), {subject: subject}),
        "meta": P.dataset_meta(panel),
    }
    if quarters:
        lines = P.quarter_lines(rows, quarters)
        out |= {"quarter_lines": lines, "panel_overlap": S.panel_overlap(stretches, lines)}
    return out


def quote_results(quotes: DataFrame, order, channels, pairs=(), steps=(), by=("property_id",)) -> dict:
    """Named result frames of the quote rows (one night, posted rate)."""
    cells = Q.room_cells(Q.posted_rows(quotes, order, nights=1), order, by)
    spreads = Q.channel_spread(cells, channels, by)
    out = {
        "coverage": Q.coverage(cells, channels, by), "price_range": Q.price_range(cells, by),
        "rate_matrix": Q.rate_matrix(cells, channels, by), "yield_intensity": Q.yield_intensity(cells, by),
        "channel_spread": spreads, "spread_summary": Q.spread_summary(spreads),
        "pairwise_spread": Q.pairwise_spread(spreads, channels), "payload_coverage": Q.payload_coverage(cells),
        "ratio_check": Q.ratio_check(quotes),
    }
    if steps:
        out["tier_steps"] = Q.tier_steps(cells, steps, by)
    if pairs:
        out["view_premium"] = Q.matched_premium(Q.plan_cells(quotes, order, by), pairs, by)
    return out


