import datetime as dt
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tariffa.operators import panel as P, price_days as D, rank, reports, series as S, spread as X, verdicts as V
from tariffa.plans import panel_queries as PQ, flow_queries as FQ

DDL = ("as_of_date date, arrival_date date, property string, source string, room_tier string, length_of_stay_nights int, availability_status string, "
       "rate_usd double, market_demand_frac double, market_otb_frac double, seq int, other string")
ORDER, PEERS = ["seq"], ["a", "b", "c", "d"]
DAY = dt.date(2026, 5, 1)


def panel(spark, seed=3, n=4000, as_of=range(3)):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        day = rnd.randrange(60)
        quoted = rnd.random() < 0.8
        demand = None if day % 7 == 0 else (day * 37 % 101) / 100
        rows.append((DAY - dt.timedelta(days=1 + rnd.choice(list(as_of))), None if rnd.random() < 0.01 else DAY + dt.timedelta(days=day), rnd.choice(["me", "me", *PEERS]), rnd.choice(["x", "y"]),
                     rnd.choice(["std", None]), rnd.choice([1, 2, 7]), "available" if quoted else rnd.choice(["sold_out", None]), rnd.choice([0.0, -0.0, 100.0, 110.5, 300.0, None]) if quoted else None,
                     demand, demand, i, "z"))
    return spark.createDataFrame(rows, DDL)


def same(a, b):
    names = sorted(a.columns)
    rows = lambda df: sorted((tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()), key=str)
    assert names == sorted(b.columns) and rows(a) == rows(b) and rows(a)


def test_every_result_is_that_of_the_rows(spark):
    raw = panel(spark)
    days, w = D.counted(raw, ORDER), D.N_ROWS
    assert days.count() < raw.count() and days.agg(F.sum(w)).first()[0] == raw.count()
    rows, few = P.panel_slice(raw), P.panel_slice(days)
    same(P.first_series(rows, ORDER), P.first_series(few, ORDER))
    demand = [P.demand_series(P.panel_slice(p, source="x", available=False), ORDER) for p in (raw, days)]
    same(*demand)
    same(X.peer_status(raw, ORDER), X.peer_status(days, ORDER))
    same(P.explorer_profile(rows), P.explorer_profile(few, w))
    long, short = X.spread_rows(rows, "me", PEERS), X.spread_rows(few, "me", PEERS, weight=w)
    for fn in (X.spread_by_bucket, X.spread_headline, X.collapse_dates):
        same(fn(long), fn(short, weight=w))
    grids = X.audit_grid(long, raw, PEERS, ORDER), X.audit_grid(short, days, PEERS, ORDER, w)
    same(*grids)
    same(X.audit_sensitivity(long, grids[0], 3), X.audit_sensitivity(short, grids[1], 3, w))
    same(X.compression(rows, demand[0], "me", PEERS, ORDER), X.compression(few, demand[1], "me", PEERS, ORDER, weight=w))
    order = ["length_of_stay_nights", *ORDER]
    same(X.recheck(rows, X.spread_rows(rows, "me", PEERS, order), "me", PEERS, order), X.recheck(few, X.spread_rows(few, "me", PEERS, order, w), "me", PEERS, order, weight=w))


def test_stored_days_are_refreshed_one_by_one(spark, tmp_path):
    path, old, new = str(tmp_path / "days"), panel(spark), panel(spark, seed=4, n=300, as_of=[1])
    D.refresh(old, path, ORDER)
    D.refresh(new, path, ORDER)
    now = old.where(~F.col("as_of_date").isin([r[0] for r in new.select("as_of_date").distinct().collect()])).unionByName(new)
    same(D.merged_days(D.read(spark, path), ORDER), D.price_days(now, ORDER))
    last = DAY - dt.timedelta(days=1)
    same(D.read(spark, path, since=last).drop("as_of_date"), D.price_days(now.where(F.col("as_of_date") >= F.lit(last)), ORDER))
    assert D.read(spark, path, until=DAY - dt.timedelta(days=9)).count() == 0
    # unmerged parts give the same results as the merged table
    same(X.spread_by_bucket(X.spread_rows(P.panel_slice(D.read(spark, path)), "me", PEERS, weight=D.N_ROWS), D.N_ROWS), X.spread_by_bucket(X.spread_rows(P.panel_slice(now), "me", PEERS)))


def test_verdicts_of_counted_rows(spark):
    raw = panel(spark, n=6000)
    off = F.when(F.col("seq") % 3 == 0, 1e-3).otherwise(0.0)  # unlike prices too, far from their spread
    rows = raw.withColumn("rate_usd", F.col("rate_usd") + 1e6 + off)
    days = D.counted(rows, ORDER)
    assert days.where(F.col(D.LAST).isNotNull()).count() > 100
    want, got = ({r.property: r for r in v.collect()} for v in (V.rm_verdicts(rows, ORDER), V.rm_verdicts(days, ORDER, D.N_ROWS)))
    assert set(want) == set(got) == {"me", *PEERS}
    for p, r in want.items():
        for c, x in r.asDict().items():
            assert got[p][c] == (pytest.approx(x, rel=1e-6, abs=1e-9) if isinstance(x, float) else x), (p, c)


def test_weighted_medians_with_merged_aggregates(spark):
    data = [("p", 1.0, 2), ("p", 4.0, 1), ("p", None, 5), ("q", None, 3), ("r", 7.0, 4), ("r", 7.0, 4), (None, -2.0, 1)]
    df = spark.createDataFrame(data, "k string, v double, n int")
    got = [{r.k: (r.m, r.all) for r in rank.exact_median(df, ["k"], {"m": "v"}, fine, {"all": (F.col("n"), "sum")}, weight="n").collect()} for fine in (False, True)]
    assert got[0] == got[1] == {"p": (1.0, 8), "q": (None, 3), "r": (7.0, 8), None: (-2.0, 1)}


def test_pass_table_reads_raw_rows_for_the_counted_panel_alone(spark):
    assert scans(FQ.checked_results(spark, "/root/testdata/sf0.001")) == 0


def test_empty_panel(spark):
    days = D.counted(panel(spark).limit(0), ORDER)
    assert days.count() == 0
    head = X.spread_headline(X.spread_rows(P.panel_slice(days), "me", PEERS, weight=D.N_ROWS), D.N_ROWS).first()
    assert (head.n_normal, head.n_high, head.delta_high_usd) == (0, 0, None)


@pytest.mark.parametrize("fine", [False, True])
def test_weighted_ranks(spark, fine):
    rnd = random.Random(7)
    data = [(rnd.choice("pq"), None if rnd.random() < 0.1 else rnd.choice([1.0, 2.5, 1e9, -4.0]), rnd.randrange(1, 2000)) for _ in range(60)]
    df = spark.createDataFrame(data, "k string, v double, n int")
    for values in ({"m": "v"}, {"m": "v", "twice": F.col("v") * 2}):
        got = {r.k: r.m for r in rank.exact_median(df, ["k"], values, fine, weight="n").collect()}
        assert got == {k: statistics.median([v for a, v, n in data if a == k and v is not None for _ in range(n)]) for k in "pq"}


def scans(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    return len(re.findall(r"FileScan parquet [^\n]*lineitem", text))


def test_raw_rows_are_read_once_more_at_most(spark):
    """Beside the one read that writes the counted panel."""
    sf = "/root/testdata/sf0.001"
    for name, most in {"spread_headline": 0, "compression": 0, "spread_recheck": 0, "audit_sensitivity": 0}.items():
        assert scans(PQ.Q[name][0](spark, sf)) <= most, name
    assert scans(FQ.checked_results(spark, sf)) <= 1
