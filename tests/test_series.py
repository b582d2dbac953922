import datetime as dt
import random
import statistics

import pytest

from tariffa.operators import panel as P, series as S, verdicts as V

DAY = dt.date(2026, 5, 1)


def brute_runs(points, min_days, max_step):
    """Plateaus by walking the observations one by one."""
    points = sorted(points)
    runs, current = [], [points[0]]
    for a, b in zip(points, points[1:]):
        if a[1] == 0 or abs(b[1] - a[1]) / abs(a[1]) >= max_step:
            runs.append(current)
            current = []
        current.append(b)
    runs.append(current)
    out = []
    for r in runs:
        span = (r[-1][0] - r[0][0]).days + 1
        if len(r) >= min_days and span >= min_days:
            out.append((r[0][0], r[-1][0], len(r), span, statistics.median(v for _, v in r)))
    return out


def series(spark, seed=1, n=250):
    rnd = random.Random(seed)
    data, flat = [], {}
    for prop in ("a", "b"):
        v = 300.0
        for i in range(n):
            if rnd.random() < 0.15:
                continue  # missing date
            if rnd.random() < 0.08:
                v = rnd.choice([200.0, 320.0, 410.0, 0.0])
            v2 = round(v * (1 + rnd.uniform(-0.02, 0.02)), 2)
            data.append((prop, DAY + dt.timedelta(days=i), v2))
            flat.setdefault(prop, []).append((DAY + dt.timedelta(days=i), v2))
    return spark.createDataFrame(data, "property string, arrival_date date, rate_usd double"), flat


@pytest.mark.parametrize("min_days,step", [(10, 0.05), (5, 0.03), (14, 0.10)])
def test_plateaus_equal_a_walk(spark, min_days, step):
    df, points = series(spark)
    got = sorted((r.property, r.start_date, r.end_date, r.n_obs, r.span_days, r.median_usd)
                 for r in S.flat_runs(df, min_days=min_days, max_step=step).collect())
    assert got == sorted((p, *run) for p in points for run in brute_runs(points[p], min_days, step))


def test_marked_dates_are_the_dates_of_the_plateaus(spark):
    df, points = series(spark, 2)
    marked = {(r.property, r.arrival_date) for r in S.mark_flat(df).where("on_plateau").collect()}
    want = {(p, d) for p in points for a, b, *_ in brute_runs(points[p], 10, 0.05) for d, _ in points[p] if a <= d <= b}
    assert marked == want and marked


def test_dual_baseline_rules(spark):
    df, points = series(spark, 3)
    rows = S.dual_baseline(df, 3).orderBy("property", "arrival_date").collect()
    for prop in points:
        mine = [r for r in rows if r.property == prop]
        base = {w: statistics.median(v for d, v in points[prop] if d.weekday() == w) for w in range(7)}
        pct = []
        for r in mine:
            b = base[r.arrival_date.weekday()]
            assert r.baseline_usd == b
            pct.append(0.0 if r.on_plateau else (None if b == 0 else (r.rate_usd - b) / b))
        for i, r in enumerate(mine):
            window = [x for x in pct[max(0, i - 2):i + 1] if x is not None]
            assert (r.pct_smoothed is None) == (not window)
            if window:
                assert r.pct_smoothed == pytest.approx(sum(window) / len(window))


def test_absent_property_gets_a_zero_row(spark):
    df, _ = series(spark)
    row = S.flatness(df, ["a", "none"]).where("property = 'none'").first()
    assert (row.n_observed, row.n_on_plateau, row.pct_flat, row.plateau_values_usd) == (0, 0, None, [])


def panel_rows(spark, rates, metric=None):
    data = [("p", DAY + dt.timedelta(days=d), los, "available" if r is not None else "sold_out", r, m, m)
            for d, los, r, m in [(d, los, r, (metric or {}).get(d, 0.5)) for d, los, r in rates]]
    return spark.createDataFrame(data, "property string, arrival_date date, length_of_stay_nights int, availability_status string, rate_usd double, market_demand_frac double, market_otb_frac double")


def test_constant_side_gives_null_not_an_error(spark):
    df = panel_rows(spark, [(d, 1, 100.0 + d) for d in range(5)])
    row = S.corr_levels(df, "market_demand_frac", 0.3, 30).first()
    assert row.r is None and row.passes is False and row.low_power is True and row.n_used == 5


def test_first_differences_use_neighbouring_days_only(spark):
    rates = [(0, 1, 100.0), (0, 3, 110.0), (1, 1, 130.0), (1, 3, 90.0), (3, 1, 200.0), (4, 1, 210.0), (5, 1, None)]
    metric = {0: 0.1, 1: 0.4, 3: 0.9, 4: 0.95}
    steps = [r for r in S.day_steps(panel_rows(spark, rates, metric), "market_otb_frac", []).orderBy("arrival_date").collect() if r.next_day]
    # day 1 starts after the last row of day 0 (110), day 4 after day 3
    assert [r.d_rate for r in steps] == [20.0, 10.0]


def test_verdict_without_rows_is_static(spark):
    df = panel_rows(spark, [(d, 1, None) for d in range(3)])
    row = V.rm_verdicts(df, []).first()
    assert row.classification == "STATIC" and row.display_label == "STATIC (0 of 2 observed; 1 skipped; lead-time n/a)"


def test_iso_year_of_a_year_end(spark):
    from tariffa.functions import cells
    df = spark.createDataFrame([(dt.date(2027, 1, 1),)], "d date").select(cells.iso_year("d").alias("y"), cells.weekday("d").alias("w"))
    assert tuple(df.first()) == (2026, 4)


def test_nulls_sort_last_and_text_filter(spark):
    df = spark.createDataFrame([(1, "Ab"), (None, "cd"), (3, None)], "n int, t string")
    assert [r.n for r in P.sort_nulls_last(df, "n", True).collect()] == [3, 1, None]
    assert P.filter_text(df, "aB").count() == 1 and P.filter_text(df, "NULL").count() == 2
