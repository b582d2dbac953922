import datetime as dt
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tariffa.operators import upsert as U
from tariffa.sources.keyed_store import Conflict, KeyedStore, key_digest
from tariffa.streaming import feeds

DDL = "property_id string, channel string, arrival_date date, nights int, room_type_canonical string, rate_per_night_usd double"
OLD = [("p", "direct", "2026-05-01", 1, "king", 100.0), ("p", "direct", "2026-05-01", 1, None, 90.0), ("p", "direct", "2026-06-01", 1, "king", 110.0), (None, "x", None, None, None, 1.0)]
NEW = [("p", "direct", "2026-05-01", 1, "", 95.0), ("p", "direct", "2026-05-02", 1, "king", 120.0), ("p", "direct", "2026-05-02", 1, "king", 121.0), ("", "x", None, None, "", 2.0)]


def rows(spark, data):
    return spark.createDataFrame([(p, c, d and dt.date.fromisoformat(d), n, r, v) for p, c, d, n, r, v in data], DDL)


def as_rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "table"), buckets=3)


def test_upserts_equal_the_batch_form(spark, store):
    want = spark.createDataFrame([], DDL)
    for data in (OLD, NEW, NEW, OLD[:2], [("q", "direct", "2027-01-01", 1, "king", 5.0)]):
        want = U.upsert(want, rows(spark, data))
        store.upsert(rows(spark, data))
        assert as_rows(store.read()) == as_rows(want) and store.read().columns == want.columns
    assert store.versions() == [0, 1, 2, 3, 4]
    assert len({v for v in store.manifest().months.values()}) == 4  # untouched months stay where they are
    assert as_rows(store.read(0)) == as_rows(rows(spark, OLD))  # older versions stay as they were
    assert len(store.vacuum(keep=2)) == 5 and store.versions() == [3, 4] and as_rows(store.read()) == as_rows(want)
    with pytest.raises(ValueError):
        store.read(0)


def test_other_columns_and_many_rows(spark, store):
    many = spark.range(3000).selectExpr("concat('p', id % 700) as property_id", "'direct' as channel", "date_add(date'2026-01-01', cast(id % 90 as int)) as arrival_date",
                                        "cast(1 + id % 3 as int) as nights", "if(id % 5 = 0, null, concat('r', id % 7)) as room_type_canonical", "cast(id as double) as rate_per_night_usd")
    batch = many.where("rate_per_night_usd % 4 = 0").drop("rate_per_night_usd").withColumn("extra", F.lit(1))
    store.upsert(many)
    store.upsert(batch)
    assert as_rows(store.read()) == as_rows(U.upsert(many, batch))
    files = [(f.parent, re.search(r"_(\d+)\.c000", f.name)[1]) for f in Path(store.root).rglob("*.parquet")]
    assert {b for _, b in files} == {"00000", "00001", "00002"}
    assert max(Counter(files).values()) <= 2  # a month and bucket: the file of the kept rows and that of the batch


def test_only_the_batch_is_shuffled(spark, store):
    store.upsert(rows(spark, OLD))
    batch = rows(spark, NEW).withColumn("_key", key_digest(store.keys))
    kept, name = store.kept(store.manifest(), batch, ["2026-05", "2026-06"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    try:
        lines = plan.split("SortMergeJoin")[1].split("\n")
        scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line)
        assert "Bucketed: true" in lines[scan]
        assert not any("Exchange" in line for line in lines[:scan]) and any("hashpartitioning(_key" in line for line in lines[scan + 1:])
    finally:
        spark.sql(f"DROP TABLE {name}")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("keyed_")]


def test_empty_batches_and_repeated_ones(spark, store):
    apply = feeds.upsert_batches(store.root, buckets=3)
    none = spark.createDataFrame([], DDL)
    apply(none, 0)  # an empty first batch
    assert store.read().collect() == [] and store.read().columns == none.columns
    apply(rows(spark, OLD), 1)
    apply(none, 2)  # an empty later batch
    apply(rows(spark, NEW), 3)
    want = as_rows(U.upsert(rows(spark, OLD), rows(spark, NEW)))
    for k in (0, 1, 2, 3):
        apply(rows(spark, OLD), k)  # committed before: skipped
    assert as_rows(store.read()) == want and store.versions() == [0, 1, 2, 3]
    feeds.upsert_batches(store.root, writer="other")(rows(spark, OLD[:1]), 0)  # another stream counts for itself
    assert store.manifest().batches == {"stream": 3, "other": 0} and store.manifest().buckets == 3


@pytest.mark.parametrize("point", ["data", "manifest", "after"])
def test_a_killed_batch_is_never_half_seen(spark, store, monkeypatch, point):
    apply = feeds.upsert_batches(store.root, buckets=3)
    apply(rows(spark, OLD), 0)
    before, want = as_rows(store.read()), as_rows(U.upsert(rows(spark, OLD), rows(spark, NEW)))
    snapshot = store.read()
    write, commit = KeyedStore._write, KeyedStore._commit

    def lost(self, *a):
        if point == "data":  # some folders are there, some not
            write(self, a[0], a[1].limit(1), a[2])
        elif point == "after":
            commit(self, *a)
        raise RuntimeError("lost")
    monkeypatch.setattr(KeyedStore, "_write" if point == "data" else "_commit", lost)
    with pytest.raises(RuntimeError, match="lost"):
        apply(rows(spark, NEW), 1)
    monkeypatch.undo()
    assert as_rows(store.read()) == (want if point == "after" else before)
    apply(rows(spark, NEW), 1)
    assert as_rows(store.read()) == want and store.versions() == [0, 1]
    assert as_rows(snapshot) == before  # a reader that began before goes on
    assert bool(store.vacuum(keep=2)) == (point != "after") and as_rows(store.read()) == want


def test_two_writers_of_one_version(spark, store, monkeypatch):
    store.upsert(rows(spark, OLD))
    stale = store.manifest()
    store.upsert(rows(spark, NEW))
    want = as_rows(store.read())
    monkeypatch.setattr(KeyedStore, "manifest", lambda self, number=None: stale)
    with pytest.raises(Conflict):
        store.upsert(rows(spark, OLD))
    monkeypatch.undo()
    assert as_rows(store.read()) == want
    with pytest.raises(ValueError):
        KeyedStore(spark, store.root, ("property_id", "arrival_date")).upsert(rows(spark, OLD))
    with pytest.raises(ValueError):
        KeyedStore(spark, store.root, ("property_id",))
    with pytest.raises(ValueError):
        KeyedStore(spark, store.root + "-none").read()
    assert KeyedStore(spark, store.root + "-none").read(schema=DDL).collect() == []


def test_a_stream_restarts_where_it_stopped(spark, tmp_path):
    src, target = tmp_path / "in", str(tmp_path / "table")
    for k, data in enumerate((OLD, NEW)):
        rows(spark, data).coalesce(1).write.mode("append").parquet(str(src))
        for _ in range(2):  # the second run finds nothing new
            spark.readStream.schema(DDL).parquet(str(src)).writeStream.foreachBatch(feeds.upsert_batches(target, buckets=2)).trigger(availableNow=True).option(
                "checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
        assert KeyedStore(spark, target).versions() == list(range(k + 1))
    assert as_rows(KeyedStore(spark, target).read()) == as_rows(U.upsert(rows(spark, OLD), rows(spark, NEW)))
