import csv
import io
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tariffa import fixed_values as fv
from tariffa.operators import ingest, panel as P
from tariffa.sources import readers, writers
from tariffa.streaming import feeds

HEAD = "Date,Market demand,Market OTB,Hotel A,Hotel B"
SLUGS = {"Hotel A": "a", "Hotel B": "b"}


def panel(df):
    return sorted((r.as_of_date.isoformat(), r.length_of_stay_nights, r.arrival_date.isoformat(), r.property, r.rate_usd or -1.0, r.availability_status) for r in df.collect())


def fields(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.f for r in df.select("i", F.transform(ingest.csv_lines(F.col("t")), ingest.csv_fields).alias("f")).orderBy("i").collect()]


def test_lines_and_fields_follow_the_csv_rules(spark):
    rng = random.Random(4)
    piece = lambda: "".join(rng.choice(["a", "b", ",", '"', "\n", "\r\n", " ", "é"]) for _ in range(rng.randrange(6)))
    rows = [[[piece() for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 4))] for _ in range(200)]
    texts = []
    for r in rows:
        out = io.StringIO()
        csv.writer(out, quoting=rng.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL]), lineterminator=rng.choice(["\n", "\r\n"])).writerows(r)
        texts.append(out.getvalue())
    got = fields(spark, texts)
    for t, f in zip(texts, got):
        assert f[-1] == [""] and f[:-1] == [r or [""] for r in csv.reader(io.StringIO(t, newline=""))], t
    odd = ['a"b,"c"d,e', '"open,x\ny', '""', '"",', '"a""",""""', ",", ""]
    assert fields(spark, odd) == [[['a"b', "cd", "e"]], [['"open', "x"], ["y"]], [[""]], [["", ""]], [['a"', '"']], [["", ""]], [[""]]]


def test_cells_of_any_length(spark, tmp_path):
    note = ('x""y,' * 40000) + "\n" * 1000
    (tmp_path / "s_2026-05-08_los2_.csv").write_text(f'My OTB,{HEAD}\n"{note}",46150,0.5,0.4,199,"299"\n' + '""' * 100000 + ',46151,0.5,0.4,"Sold out",' + "9" * 200000 + "\n")
    rows = readers.read_sheets(spark, str(tmp_path / "*.csv")).collect()
    assert [r.cells[0] for r in rows] == [note.replace('""', '"'), '"' * 99999]
    got = panel(ingest.sheet_rows_panel(readers.read_sheets(spark, str(tmp_path / "*.csv")), SLUGS, "booking"))
    assert got[:2] == [("2026-05-08", 2, "2026-05-08", "a", 199.0, "available"), ("2026-05-08", 2, "2026-05-08", "b", 299.0, "available")] and len(got) == 4


def drop(folder, name, text):
    """A file appears whole."""
    (folder / f".{name}").write_text(text)
    (folder / f".{name}").rename(folder / name)


def test_a_stream_of_sheets_with_other_headers_equals_the_batch(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    drop(src, "a_2026-05-08_los3_x.csv", f'{HEAD}\n46150,0.5,0.4,199,"1,299"\n')
    drop(src, "b_2026-05-09_x.csv", 'Hotel B,"My OTB",Date,Market OTB,Market demand,Hotel A\n299,"two\nlines, ""quoted""",46150,0.4,0.5,Sold out\n--,,46151\n')

    def run():
        stream = feeds.sheet_panel_stream(spark, src, SLUGS, "booking", glob="*.csv")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
        batch = ingest.sheet_rows_panel(readers.read_sheets(spark, str(src / "*.csv")), SLUGS, "booking")
        got = spark.read.parquet(out)
        assert got.columns == batch.columns and panel(got) == panel(batch)
        return len(panel(got))
    assert run() == 6
    drop(src, "c_2026-05-10_los1_.csv", "x,y\nUpdated,08/05 10:15\nHotel B,Date,Market demand,Market OTB\nLOS2,46152,0.5,0.4\n")
    assert run() == 7  # a restart takes only what is new
    drop(src, "d.csv", "no header here\n")
    assert run() == 7


def test_an_unknown_header_stops_the_stream_before_any_cell(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    drop(src, "a.csv", f"{HEAD},Hotel C,Unnamed: 9\n46150,0.5,0.4,199,299,1,2\n")

    def run(**kw):
        stream = feeds.sheet_panel_stream(spark, src, SLUGS, "booking", **kw)
        name = f"sheets{len(kw)}"
        stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).count()
    with pytest.raises(StreamingQueryException, match="unknown .Hotel C., missing .."):
        run()
    assert run(drop=["Hotel C"]) == 2
    drop(src, "b.csv", "Date,Market demand,Hotel A\n46150,0.5,1\n")
    with pytest.raises(StreamingQueryException, match="missing .Market OTB."):
        run(drop=["Hotel C"], tier="any")


def test_counts_observed_while_writing_equal_those_of_the_panel(spark, tmp_path):
    (tmp_path / "a_2026-05-08_los3_x.csv").write_text(f'{HEAD}\n46150,0.5,0.4,199,Sold out\nTotal,,,1,2\n46151,0.5,0.4,LOS2,Mystery\n46152,,,--,--\n')
    (tmp_path / "b_2026-05-09_los1_x.csv").write_text("Hotel B,Date,Market OTB,Market demand\nMystery,46150,0.4,0.5\n,0\n")
    rows = readers.read_sheets(spark, str(tmp_path / "*.csv"))
    got = writers.write_sheets(rows, SLUGS, "booking", str(tmp_path / "panel"))
    stored = readers.read_panel(spark, str(tmp_path / "panel"))
    counts = {(r.what, r.name): r.n for r in P.ingest_counts(stored).collect()}
    assert (got["n_sheet_rows"], got["n_undated"], got["n_rows"]) == (6, 2, 7) and stored.count() == 7
    assert {s: got[f"n_{s}"] for s in fv.STATUSES} == {s: counts.get(("status", s), 0) for s in fv.STATUSES}
    assert got["n_unknown"] == sum(n for (what, s), n in counts.items() if what == "status" and s.startswith(fv.UNKNOWN_STATUS_PREFIX)) == 2
    assert sum(r.n for r in ingest.unknown_statuses(stored).collect()) == got["n_unknown"]
    assert counts[("sold_out_by_property", "b")] == 1 and counts[("not_loaded_by_property", "a")] == 1 and counts[("length_of_stay", "3")] == 6
    plan = P.ingest_counts(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_sheet_queries_read_the_tables_once(spark):
    """Rules on dates and cells run on the written sheet, header checks and panel on the written files."""
    from tariffa.plans import flow_queries as FQ
    sf = "/root/testdata/sf0.001"
    for df, folder in ((FQ.I.sheet_panel(FQ.text_sheet(spark, sf), FQ.SLUGS, "booking"), "/wide-sheet-"), (FQ.csv_panel(spark, sf), "/sheets-")):
        assert df.inputFiles() and all(folder in f for f in df.inputFiles())


def test_wide_sheet_shuffles_no_cells(spark, tmp_path):
    """The numbers that stand for cells give the view's rows, also for odd ones; cells are not shuffled to be told apart."""
    import re

    from tariffa.sources import fixtures as fx

    for name in ("lineitem", "orders", "part", "supplier", "nation"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        kinds = dict(df.dtypes)
        odd = {"part": {"p_retailprice": "CASE p_partkey % 5 WHEN 0 THEN -p_retailprice WHEN 1 THEN NULL WHEN 2 THEN p_retailprice / 1000 ELSE p_retailprice END"},
               "lineitem": {"l_tax": "CASE WHEN l_orderkey % 3 > 0 THEN l_tax END", "l_discount": "CASE WHEN l_orderkey % 7 > 0 THEN l_discount END",
                            "l_returnflag": "CASE WHEN l_orderkey % 5 > 0 THEN l_returnflag END", "l_shipdate": "CASE WHEN l_orderkey % 13 > 0 THEN l_shipdate END"}}.get(name, {})
        df.selectExpr(*[f"CAST({odd[c]} AS {kinds[c]}) AS {c}" if c in odd else c for c in df.columns]).write.parquet(f"{tmp_path}/{name}.parquet")
    got = fx.load(spark, str(tmp_path), "sheet_wide")
    keys = re.findall(r"hashpartitioning\(([^)]*)", got._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("cell#" in k for k in keys)
    sql, tables = fx.SHEET_WIDE, fx.VIEWS["sheet_wide"][1]
    for t in tables:
        sql = sql.replace(f"FROM {t}\n", f"FROM {{{t}}}\n").replace(f"JOIN {t} ON", f"JOIN {{{t}}} ON")
    want = spark.sql(sql, **{t: spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in tables})
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
