import hashlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from check_oracle import as_rows
from tariffa.llm import exact_dedup, url_filter
from tariffa.llm.common import shared_folder


def test_awkward_rows(spark, docs, no_docs):
    index = exact_dedup.DigestIndex(spark, shared_folder(spark, "index"), 4)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in exact_dedup.dedup(docs, index).collect()), key=str)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert got == sorted(want, key=str)
    assert exact_dedup.dedup(no_docs, index).collect() == []


def test_kept_rows_once_with_all_columns(spark, docs):
    kept = exact_dedup.kept_rows(docs, exact_dedup.DigestIndex(spark, shared_folder(spark, "index"), 4))
    assert kept.columns == docs.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({r["text"] or "" for r in docs.collect()})


def test_index_persists_and_appends_by_merge_anti_join(spark):
    path = shared_folder(spark, "index")
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    exact_dedup.dedup(first, exact_dedup.DigestIndex(spark, path, 4)).collect()
    again = exact_dedup.DigestIndex(spark, path, 4)
    second = spark.createDataFrame([(9, "a"), (8, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.dedup(second, again).collect()) == [(8, 8, True), (9, 2, False)]
    assert again.entries().count() == 3
    plan = again.entries().hint("merge").join(exact_dedup.grouped(exact_dedup.digests(first)).repartition(4, "digest"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Bucketed: true" in text


def test_a_batch_adds_one_file_a_bucket_however_many_tasks_the_join_has(spark, monkeypatch):
    frame = type(spark.range(0))
    dealt = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *c: dealt(self, max(40, n), *c))  # as on a cluster with more parts than buckets
    path = shared_folder(spark, "index")
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('t', id) AS text")
    index = exact_dedup.DigestIndex(spark, path, 4)
    index.append(exact_dedup.grouped(exact_dedup.digests(docs)))
    assert index.entries().count() == 500
    assert len(list(Path(path.removeprefix("file:")).glob("*.parquet"))) <= 4


@pytest.fixture(scope="module")
def pages(spark):
    urls = ["http://A.example.org/es/1", "https://example.org/en/17?x=1", "https://blog.example.org/en/2", "x://notexample.org", "https://b.com/de/", "https://B.COM:8080/fr/x#y", None, "no scheme",
            "http://com/fr/1", "", "http://a.net/?u=://evil/", "http://a.net/x", "http://a.net/x", "http://bad.net/1", "http://bad.net/2", "http://bad.net/3"] + [f"http://bad.net/{i}" for i in range(40)]
    rows = [(i, u, "x", 1) for i, u in enumerate(urls)] + [(None, "http://null.id/", "x", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, pages int")


def test_urls_equal_sql_and_rules_win(spark, pages):
    labels = spark.createDataFrame([(i, 0 if i > 12 else 1, 0) for i in range(8, 50)] + [(7, None, None)], "doc_id long, quality int, toxic int")
    good = labels.selectExpr("doc_id as page_id", "case when quality = 1 then 1 when quality = 0 then 0 end as good")
    got = url_filter.judge(pages, good)
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    con.register("labels", labels.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    cur = con.execute(url_filter.SQL)
    assert as_rows(got.columns, [tuple(r) for r in got.collect()]) == as_rows([c[0] for c in cur.description], cur.fetchall())
    by = {r["page_id"]: r for r in got.collect()}
    assert (by[0]["host"], by[0]["path"], by[0]["rule"], by[0]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (by[1]["rule"], by[2]["rule"], by[3]["rule"], by[5]["rule"]) == ("example.org/en/1", "org/", None, None)
    assert by[20]["verdict"] == "block" and by[11]["verdict"] == "allow" and by[8]["rule"] == "com/fr/"
    assert (by[6]["host"], by[6]["path"], by[7]["host"]) == ("", "", "")


def test_no_pages(spark, pages):
    assert url_filter.judge(pages.limit(0), spark.createDataFrame([], "page_id long, good int")).collect() == []


def test_plans_hold_no_python(spark):
    for fn in (exact_dedup.op3_exact_dedup, url_filter.op7_url_filter):
        text = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in text for x in ("Python", "Arrow", "Pandas", "BroadcastNestedLoop", "Cartesian"))
