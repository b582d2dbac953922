import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tariffa import schemas
from tariffa.operators import ingest, upsert as U, verify as Y
from tariffa.sources import readers, writers
from tariffa.streaming import feeds

DDL = "property_id string, channel string, arrival_date date, nights int, room_type_canonical string, rate_per_night_usd double"


def rows(spark, data):
    return spark.createDataFrame([(p, c, dt.date.fromisoformat(d), n, r, v) for p, c, d, n, r, v in data], DDL)


OLD = [("p", "direct", "2026-05-01", 1, "king", 100.0), ("p", "direct", "2026-05-01", 1, None, 90.0), ("p", "direct", "2026-06-01", 1, "king", 110.0)]
NEW = [("p", "direct", "2026-05-01", 1, "", 95.0), ("p", "direct", "2026-05-02", 1, "king", 120.0), ("p", "direct", "2026-05-02", 1, "king", 121.0)]


def as_set(df):
    return sorted((r.arrival_date.isoformat(), r.room_type_canonical or "", r.rate_per_night_usd) for r in df.collect())


WANT = [("2026-05-01", "", 95.0), ("2026-05-01", "king", 100.0), ("2026-05-02", "king", 120.0), ("2026-05-02", "king", 121.0), ("2026-06-01", "king", 110.0)]


def test_upsert_replaces_by_text_key_and_is_idempotent(spark):
    old, new = rows(spark, OLD), rows(spark, NEW)
    once = U.upsert(old, new)
    assert as_set(once) == WANT and as_set(U.upsert(once, new)) == WANT
    report = U.upsert_report(old, new).first()
    assert (report.old_rows, report.new_rows, report.new_keys, report.new_cells, report.dropped, report.final_rows, report.delta) == (3, 3, 2, 2, 1, 5, 2)


def test_complete_cells(spark):
    cases = {"a": ["ok"], "b": ["no_inventory"], "c": ["FAIL_NO_BAR_FLEX"], "d": ["ok", "FAIL_ROOM_COUNT_SHORT"], "e": ["non_bar_rate"], "f": [" OK "], "g": ["fail_no_bar_flex", "ok"]}
    df = spark.createDataFrame([(p, "direct", "2026-05-01", 1, s) for p, ss in cases.items() for s in ss], "property_id string, channel string, arrival_date string, nights int, status string")
    assert sorted(r.property_id for r in U.complete_cells(df).collect()) == ["a", "b", "f", "g"]


def test_explicit_null_is_an_assertion(spark):
    cells = [("a", {"promo_banner_pct": None}, {"promo_banner_pct": None}, True), ("b", {"promo_banner_pct": None}, {"promo_banner_pct": "5"}, False),
             ("c", {}, {"promo_banner_pct": "5"}, None), ("d", {"promo_banner_pct": "15"}, {"promo_banner_pct": "15.0"}, True), ("e", {"promo_banner_pct": "15"}, {}, False)]
    df = spark.createDataFrame([(i, "x", e, a) for i, e, a, _ in cells], "cell_id string, channel string, expected map<string,string>, actual map<string,string>")
    got = {r.cell_id: r.passed for r in Y.checks(df, ["promo_banner_pct"]).collect()}
    assert got == {i: w for i, _, _, w in cells}


def test_aliases_tolerance_and_presence(spark):
    df = spark.createDataFrame([
        ("a", "x", {"bar_non_ref_nightly_allin": "100", "promo_banner_text_contains": "save", "room_type_canonical_present": "true"},
         {"bar_non_ref_nightly_allin": "102", "promo_banner_text": "Pay now and SAVE", "room_canonical_resolved": "hr_king"}),
        ("b", "x", {"bar_non_ref_nightly_allin": "100", "promo_banner_text_contains": "save", "room_type_canonical_present": "true"},
         {"bar_non_ref_nightly_allin": "102.5", "promo_banner_text": "x", "room_canonical_resolved": " "})], "cell_id string, channel string, expected map<string,string>, actual map<string,string>")
    got = {(r.cell_id, r.field): r.passed for r in Y.checks(df, ["bar_non_ref_nightly_allin", "promo_banner_text", "room_type_canonical_present"]).collect()}
    assert all(v is (k[0] == "a") for k, v in got.items())


def test_verdict_needs_every_critical_field(spark):
    full = [("x", f, 20, 0, 0) for f in ("bar_non_ref_nightly_allin", "marketing_name_verbatim", "room_type_canonical_present")]
    ddl = "channel string, field string, n_pass long, n_fail long, n_na long"
    v = lambda data, **kw: Y.run_verdict(spark.createDataFrame(data, ddl), **kw).first().verdict
    assert v(full) == "GREEN" and v(full[:2]) == "RED" and v(full + [("x", "promo_banner_pct", 17, 3, 0)]) == "YELLOW"
    assert v(full + [("y", "promo_banner_pct", 1, 0, 0)]) == "GREEN" and v(full + [("y", "promo_banner_pct", 1, 0, 0)], per_channel=True) == "RED"
    assert Y.run_verdict(spark.createDataFrame([], ddl)).first().verdict == "RED"


def test_streak_and_disagreement(spark):
    runs = spark.createDataFrame([(i, v) for i, v in enumerate(["GREEN", "RED", "GREEN", "GREEN"])], "seq long, verdict string")
    assert tuple(Y.green_streak(runs).first()) == (2, 4)
    df = spark.createDataFrame([("RED", "GREEN"), ("RED", None), ("RED", "RED")], "local_verdict string, report_verdict string")
    assert [(r.final_verdict, r.refused) for r in Y.settle(df).collect()] == [("RED", True), ("RED", False), ("RED", False)]
    assert [r.final_verdict for r in Y.settle(df, trust=True).collect()] == ["GREEN", "RED", "RED"]


def test_sources_round_trip(spark, tmp_path):
    sheet = tmp_path / "in"
    sheet.mkdir()
    (sheet / "drop_2026-05-08_los3_x.csv").write_text("Date,H1\n46150,199\n")
    (sheet / "plain.csv").write_text("Date,H1\n46151,Sold out\n")
    got = {(r.length_of_stay_nights, r.as_of_date.isoformat() if r.length_of_stay_nights == 3 else "") for r in readers.read_sheets(spark, str(sheet / "*.csv")).collect()}
    assert got == {(3, "2026-05-08"), (1, "")}
    log = tmp_path / "log.json"
    log.write_text(json.dumps({"ts": "2026-05-08T00:00:00Z", "kind": "ok", "los": 1}) + "\nnot json\n")
    assert readers.read_log(spark, str(log)).count() == 1
    panel = spark.createDataFrame([(dt.date(2026, 5, 8), dt.date(2026, 5, 9), "p", 100.0)], "as_of_date date, arrival_date date, property string, rate_usd double")
    writers.write_panel(panel, str(tmp_path / "panel"))
    assert readers.read_panel(spark, str(tmp_path / "panel")).select("property", "rate_usd").collect() == [("p", 100.0)]
    for _ in range(2):
        writers.append_quotes(rows(spark, OLD).withColumn("extra", F.lit(1)), str(tmp_path / "quotes"))
    stored = readers.read_quotes(spark, str(tmp_path / "quotes"))
    assert stored.count() == 6 and stored.columns == [f.name for f in schemas.QUOTES.fields]
    stored.write.option("header", True).csv(str(tmp_path / "csv"))
    assert readers.read_quotes(spark, str(tmp_path / "csv"), "csv").exceptAll(stored).count() == 0


def test_each_sheet_goes_by_its_own_headers(spark, tmp_path):
    (tmp_path / "a_2026-05-08_los3_x.csv").write_text('Day,Date,Market demand,Market OTB,"Hotel ""A"", x",Hotel B\n,46150,0.5,0.4,199,299\n')
    (tmp_path / "b.csv").write_text('Updated,08/05 10:15\n,\n\nHotel B,Date,Market OTB,Market demand,"Hotel ""A"", x"\n299,46150,0.4,0.5,199,extra\nSold out,46151\n\n')
    rows = readers.read_sheets(spark, str(tmp_path / "*.csv"))
    slugs = {'Hotel "A", x': "a", "Hotel B": "b"}
    got = sorted((r.length_of_stay_nights, r.arrival_date.isoformat(), r.property, r.rate_usd, r.availability_status, r.market_demand_frac) for r in ingest.sheet_rows_panel(rows, slugs, "booking").collect())
    one = [(n, "2026-05-08", p, v, "available", 0.5) for n in (1, 3) for p, v in (("a", 199.0), ("b", 299.0))]
    assert got == sorted(one + [(1, "2026-05-09", "a", None, "blank", None), (1, "2026-05-09", "b", None, "sold_out", None)])
    stamped = {r.file: r.as_of_date for r in rows.select("file", "as_of_date").distinct().collect()}
    assert stamped["a_2026-05-08_los3_x.csv"] == dt.date(2026, 5, 8) and (stamped["b.csv"].month, stamped["b.csv"].day) == (5, 8)


def test_unknown_or_missing_headers_stop_the_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Market demand,Market OTB,Hotel A,Hotel a\n46150,0.5,0.4,1,2\n")
    rows = readers.read_sheets(spark, str(tmp_path / "*.csv"))
    with pytest.raises(ValueError, match="Hotel a"):
        ingest.sheet_rows_panel(rows, {"Hotel A": "a"}, "booking")
    assert ingest.sheet_rows_panel(rows, {"Hotel A": "a"}, "booking", drop=["Hotel a"]).count() == 1
    (tmp_path / "b.csv").write_text("Date,Market OTB,Hotel A\n46150,0.4,1\n")
    with pytest.raises(ValueError, match="Market demand"):
        ingest.sheet_rows_panel(readers.read_sheets(spark, str(tmp_path / "b.csv")), {"Hotel A": "a"}, "booking")


def test_a_day_is_written_without_touching_other_days(spark, tmp_path):
    day = lambda n: spark.createDataFrame([(dt.date(2026, 5, n), dt.date(2026, 6, 1), "p", float(n))], "as_of_date date, arrival_date date, property string, rate_usd double")
    plain = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        for n in (8, 9, 9):
            writers.write_panel(day(n), str(tmp_path / "panel"))
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", plain)
    assert sorted(r.rate_usd for r in readers.read_panel(spark, str(tmp_path / "panel")).collect()) == [8.0, 9.0]


def test_captures_are_read_with_their_schema(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"property_id": "p", "channel": "direct", "markdown": "text", "extract": {"rooms": [{"marketing_name": "King"}]}}) + "\n")
    row = readers.read_captures(spark, str(tmp_path / "c.json")).first()
    assert row.property_id == "p" and row.extract.rooms[0].marketing_name == "King" and row.source_url is None


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def write_log(folder):
    folder.mkdir()
    lines = [("00:05", "ok", "p1"), ("00:40", "bot_blocked", "p2"), ("00:50", "bot_blocked", "p2"), ("01:10", "ok", "p3"), ("05:00", "extract_failed", "p4"), ("09:00", "ok", "p5")]
    body = "\n".join(json.dumps({"ts": f"2026-05-08T{t}:00Z", "kind": k, "property": p, "channel": "direct", "arrival": "2026-06-01", "los": 1, "credits_nominal": 5}) for t, k, p in lines)
    (folder / "a.json").write_text(body + "\nbroken\n")


def test_stream_tally_and_dedupe(spark, tmp_path):
    write_log(tmp_path / "log")
    log = feeds.log_stream(spark, str(tmp_path / "log"))
    got = {(r.window_start.hour, r.kind, r.n_cells, r.credits) for r in drain(feeds.tally_by_window(log), "tally").collect()}
    batch = readers.read_log(spark, str(tmp_path / "log")).groupBy(F.hour("ts").alias("h"), "kind").agg(F.count("*").alias("n"), F.sum("credits_nominal").alias("c")).collect()
    # a window is final once the watermark (the latest time less an hour) has passed its end
    assert got == {(r.h, r.kind, r.n, r.c) for r in batch if r.h < 8}
    assert sorted(r.property for r in drain(feeds.failed_once(log), "failed").collect()) == ["p2", "p4"]


def test_stream_of_sheets_equals_batch(spark, tmp_path):
    src = tmp_path / "sheets"
    src.mkdir()
    (src / "a.json").write_text(json.dumps({"arrival_date": "2026-05-08", "A": "199", "B": "LOS2"}) + "\n")
    ddl = "arrival_date string, A string, B string"
    stream = feeds.typed_sheets(spark.readStream.schema(ddl).json(str(src)), {"A": "a", "B": "b"})
    batch = feeds.typed_sheets(spark.read.schema(ddl).json(str(src)), {"A": "a", "B": "b"})
    assert sorted(map(tuple, drain(stream, "sheets").collect())) == sorted(map(tuple, batch.collect()))
