"""A sample of the registered queries against their SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, as_rows

SF = "/root/testdata/sf0.001"
NAMES = ["status_breakdown", "median_series", "plateaus", "flat_stretches", "comp_verdicts", "spread_headline", "audit_sensitivity", "room_cells",
         "pairwise_spread", "matched_premium", "flatten_quotes", "gate_status", "melt_status", "keyed_upsert", "budget_cut", "field_counters"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert as_rows(df.columns, [tuple(r) for r in df.collect()]) == as_rows(names, cur.fetchall())


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "pct_flat" in out.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dashboard_tables_can_be_written(spark, tmp_path):
    from tariffa.plans import dashboard, quote_queries
    from tariffa.sources import fixtures as fx, writers

    panel = fx.load(spark, SF, "rate_panel")
    tables = dashboard.panel_results(panel, "NATION_7", ["NATION_3", "NATION_8"], list(fx.ROW_KEY))
    quotes = quote_queries.with_flag(spark, SF)
    tables |= dashboard.quote_results(quotes, list(fx.ROW_KEY), fx.CHANNELS, quote_queries.PAIRS, quote_queries.PAIRS)
    some = {k: tables[k] for k in ("market_demand", "flatness", "spread_headline", "coverage", "view_premium")}
    folders = writers.write_results(some, str(tmp_path))
    assert [spark.read.parquet(f).columns for f in folders] == [df.columns for df in some.values()]
    assert all(df.columns for df in tables.values())
