"""Stateful streams that stop and start again from their checkpoint, with late and repeated rows."""
import json
import os

from pyspark.sql import functions as F

from tariffa.sources import readers
from tariffa.streaming import feeds

# (time, kind, property); each part is one file that arrives after the one before was read
PARTS = [
    [("00:05", "ok", "p1"), ("00:40", "bot_blocked", "p2"), ("00:50", "bot_blocked", "p2"), ("01:10", "ok", "p3")],
    [("00:55", "bot_blocked", "p2"), ("01:20", "extract_failed", "p4"), ("01:20", "extract_failed", "p4"), ("02:30", "ok", "p1")],  # repeated, and late but within the hour
    [("02:40", "ok", "p1")],  # rows count as late by the watermark before the last batch
    [("00:10", "ok", "p9"), ("01:40", "extract_failed", "p4"), ("05:00", "extract_failed", "p5")],  # the first one is too late
    [("09:00", "ok", "p6")],
]


def drop(folder, k):
    lines = [{"ts": f"2026-05-08T{t}:00Z", "kind": kind, "property": p, "channel": "direct", "arrival": "2026-06-01", "los": 1, "credits_nominal": 5} for t, kind, p in PARTS[k]]
    (folder / f".{k}").write_text("\n".join(map(json.dumps, lines)))
    os.utime(folder / f".{k}", (1_800_000_000 + k, 1_800_000_000 + k))  # the order of arrival
    (folder / f".{k}").rename(folder / f"{k}.json")


def run(df, folder):
    df.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start().awaitTermination()


def follow(spark, form, tmp_path, stops):
    """Rows of the stream over all parts; with stops, a new query goes on from the checkpoint after each part."""
    folder = tmp_path / f"{form.__name__}-{stops}"
    (folder / "in").mkdir(parents=True)
    for k in range(len(PARTS)):
        drop(folder / "in", k)
        if stops:
            run(form(feeds.log_stream(spark, str(folder / "in"))), folder)
    if not stops:
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder / "in"))  # one file a batch, in one query
        run(form(readers.parse_log(stream)), folder)
    return spark.read.parquet(str(folder / "out"))


def test_the_tally_equals_one_unbroken_run(spark, tmp_path):
    broken, whole = (follow(spark, feeds.tally_by_window, tmp_path, s) for s in (True, False))
    got = sorted(map(tuple, broken.collect()))
    assert got == sorted(map(tuple, whole.collect())) and len(set(got)) == len(got)
    # rows within the lateness count, later ones do not; the last windows are still open
    assert {(r.window_start.hour, r.kind): r.n_cells for r in broken.collect()} == {
        (0, "ok"): 1, (0, "bot_blocked"): 3, (1, "ok"): 1, (1, "extract_failed"): 3, (2, "ok"): 2, (5, "extract_failed"): 1}


def test_no_failed_key_comes_twice(spark, tmp_path):
    broken, whole = (follow(spark, feeds.failed_once, tmp_path, s) for s in (True, False))
    got = sorted(r.property for r in broken.collect())
    assert got == sorted(r.property for r in whole.collect()) == ["p2", "p4", "p5"]
    assert broken.groupBy("property").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
