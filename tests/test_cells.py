import datetime as dt

import pytest
from pyspark.sql import functions as F

from tariffa import fixed_values as fv
from tariffa.functions import cells
from tariffa.operators import ingest

CASES = [
    ("199", (199.0, "available", None)), ("199.5", (199.5, "available", None)), ("-50.0", (-50.0, "available", None)),
    ("1e6", (1e6, "available", None)), (None, (None, "blank", None)), ("NaN", (None, "blank", None)), ("0", (None, "blank", None)),
    ("0.0", (None, "blank", None)), ("", (None, "blank", None)), ("   ", (None, "blank", None)), ("\t\n", (None, "blank", None)),
    ("Sold out", (None, "sold_out", None)), (" SOLD OUT ", (None, "sold_out", None)), ("No flex", (None, "no_flex", None)),
    ("Room n/a", (None, "room_na", None)), ("Room na", (None, "room_na", None)), ("--", (None, "not_loaded", None)),
    ("—", (None, "unknown_sentinel:—", None)), ("3rd Party only", (None, "third_party_only", None)),
    ("1 guest only", (None, "one_guest_only", None)), ("LOS2", (None, "los_restricted", 2)), ("los7", (None, "los_restricted", 7)),
    ("LOS14", (None, "los_restricted", 14)), ("LOS2 weekend only", (None, "unknown_sentinel:LOS2 weekend only", None)),
    (" Mystery ", (None, "unknown_sentinel:Mystery", None)), ("Infinity", (None, "unknown_sentinel:Infinity", None)),
    ("1d", (None, "unknown_sentinel:1d", None)), ("2F", (None, "unknown_sentinel:2F", None)), (".5", (0.5, "available", None)), ("1e999", (None, "unknown_sentinel:1e999", None)),
]


def test_cell_typing_table(spark):
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, c string")
    got = {r.i: tuple(r.t) for r in rows.select("i", cells.typed_cell("c").alias("t")).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def test_every_named_status_is_listed():
    assert {s for _, s in fv.STATUS_WORDS} <= set(fv.STATUSES)
    assert set(fv.EXCLUDED_STATUSES) == set(fv.STATUSES) - {"available"}


@pytest.mark.parametrize("cell,want", [
    ("46150", dt.date(2026, 5, 8)), ("46150.75", dt.date(2026, 5, 8)), ("2026-05-08", dt.date(2026, 5, 8)), ("0", None), ("", None),
    ("soon", None), (None, None)])
def test_sheet_date(spark, cell, want):
    assert spark.createDataFrame([(cell,)], "c string").select(cells.sheet_date("c").alias("d")).first().d == want


@pytest.mark.parametrize("stamp,file_day,want", [
    ("08/05 10:15", "2026-05-09", dt.date(2026, 5, 8)), ("30/12 09:00", "2026-01-03", dt.date(2025, 12, 30)),
    ("31/02 09:00", "2026-03-01", None), ("no stamp", "2026-03-01", None)])
def test_updated_day(spark, stamp, file_day, want):
    row = spark.createDataFrame([(stamp, file_day)], "s string, f string").withColumn("f", F.col("f").cast("timestamp"))
    assert row.select(cells.updated_day("s", "f").alias("d")).first().d == want


def test_melt_keeps_every_cell_and_counts_unknown(spark):
    wide = spark.createDataFrame([("2026-05-08", "199", "Odd"), ("2026-05-09", "LOS3", None)], "arrival_date string, A string, B string")
    long = ingest.typed(ingest.melt(wide, {"A": "a", "B": "b", "C": "c"}))
    assert long.count() == 4
    assert [tuple(r) for r in ingest.unknown_statuses(long).collect()] == [("Odd", 1)]


def test_unknown_texts_are_counted_whole(spark):
    long = spark.createDataFrame([("unknown_sentinel:" + "x" * 1_000_005 + e,) for e in "aab"], "availability_status string")
    assert sorted((len(r.cell_text), r.cell_text[-1], r.n) for r in ingest.unknown_statuses(long).collect()) == [(1_000_006, "a", 2), (1_000_006, "b", 1)]


def test_header_drift_and_preflight(spark):
    one = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    slugs = one([("H1", "a"), ("H2", "b"), ("H3", "b")], "header string, slug string")
    drop = one([("Gone",), ("H3",)], "header string")
    heads = one([("f", "H1"), ("f", "Date"), ("f", "Unnamed: 3"), ("f", None), ("f", "h1"), ("f", "Gone")], "file string, header string")
    assert [tuple(r) for r in ingest.header_drift(heads, slugs, drop).collect()] == [("f", "h1")]
    peers = one([("b",), ("z",)], "property string")
    found = {tuple(r) for r in ingest.map_preflight(slugs, drop, "s", peers).collect()}
    assert found == {("subject_missing", "s"), ("peer_missing", "z"), ("duplicate_slug", "b"), ("mapped_and_dropped", "H3"), ("orphan_slug", "a")}
    assert ingest.map_preflight(slugs.where("false"), drop, "s", peers).count() == 0
