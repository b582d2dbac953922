import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tariffa import fixed_values as fv
from tariffa.operators import rank, series as S


def table(spark, n=4000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # one key holds a third of the rows; values repeat, are negative, tiny, null or NaN
        key = "hot" if i % 3 == 0 else f"k{i % 11}"
        v = rnd.choice([rnd.uniform(-5, 5), round(rnd.uniform(100, 400), 1), 0.0, rnd.gauss(0, 1e-3), None, float("nan"), 1e12])
        rows.append((key, None if i % 7 == 0 else i % 2, v, i))
    return rows, spark.createDataFrame(rows, "k string, g int, v double, i int")


def brute(rows):
    groups = {}
    for k, g, v, _ in rows:
        if v is not None and v == v:
            groups.setdefault((k, g), []).append(v)
    return groups


def test_exact_median_equals_brute_force(spark):
    rows, df = table(spark)
    want = {k: statistics.median(v) for k, v in brute(rows).items()}
    for fine in (False, True):
        got = {(r.k, r.g): r.v for r in rank.exact_median(df, ["k", "g"], "v", fine).collect()}
        assert got == want


def test_several_medians_and_plain_aggregates(spark):
    rows, df = table(spark)
    out = rank.describe(df.withColumn("w", F.col("v") * 2), [], [F.count("v").alias("n")], {"a": "v", "b": "w"}).first()
    values = [v for vs in brute(rows).values() for v in vs]
    assert out.a == statistics.median(values) and out.b == 2 * out.a


def test_order_statistics_any_rank(spark):
    rows, df = table(spark)
    got = {(r.k, r.g): r.x_p for r in rank.order_statistics(df, ["k", "g"], {"x": "v"}, {
        "_p": lambda n: F.bround(0.95 * (n - 1)).cast("long")}).collect()}
    assert got == {k: sorted(v)[round(0.95 * (len(v) - 1))] for k, v in brute(rows).items()}


def test_rank_with_nulls_last_and_ties(spark):
    rows, df = table(spark, 500)
    df = df.where(~F.isnan("v") | F.col("v").isNull())
    got = {r.i: r.rank for r in rank.ranked(df, ["k"], "v", "i").collect()}
    clean = [r for r in rows if r[2] is None or r[2] == r[2]]
    want = {}
    for k in {r[0] for r in clean}:
        order = sorted((r for r in clean if r[0] == k), key=lambda r: (r[2] is None, -(r[2] or 0), r[3]))
        want |= {r[3]: n for n, r in enumerate(order, 1)}
    assert got == want


def test_running_total_over_blocks(spark):
    df = spark.range(1000).withColumn("c", (F.col("id") % 7).cast("long"))
    got = {r.id: r.s for r in rank.running_total(df, "id", "c", "s", block=64).collect()}
    total, want = 0, {}
    for i in range(1000):
        want[i] = total
        total += i % 7
    assert got == want


def test_first_row_takes_a_total_order(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 9.0), ("b", None, 3.0), ("b", 1, 4.0)], "k string, o int, v double")
    assert {r.k: r.v for r in rank.first_row(df, ["k"], ["o"], ["v"]).collect()} == {"a": 9.0, "b": 3.0}


def test_bucket_keeps_order(spark):
    rnd = random.Random(3)
    values = sorted([rnd.uniform(-1e6, 1e6) for _ in range(500)] + [rnd.gauss(0, 1e-6) for _ in range(500)] + [0.0, -0.0, 1e300, -1e300])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    buckets = [r.b for r in df.select("i", rank.value_bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert buckets == sorted(buckets)


def test_many_values_in_one_coarse_bucket_are_ranked_in_parts(spark):
    rows = spark.range(100_000).select(F.lit("g").alias("k"), (F.lit(1.0) + F.col("id") * 1e-10).alias("v"))
    assert rows.select(rank.value_bucket(F.col("v"))).distinct().count() == 1
    got = rank.exact_median(rows, ["k"], "v").first()
    assert got.v == pytest.approx(1.0 + 49_999.5e-10, abs=1e-13)
    plan = rank.exact_median(rows, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan


def test_null_keys_and_several_metrics(spark):
    rows = spark.createDataFrame([(None, 1.0, 5.0), (None, 3.0, None), ("a", 2.0, 1.0), ("a", None, 9.0), ("b", None, None)], "k string, x double, y double")
    for fine in (False, True):
        got = {r.k: (r.x, r.y) for r in rank.exact_median(rows, ["k"], {"x": "x", "y": "y"}, fine).collect()}
        assert got == {None: (2.0, 5.0), "a": (2.0, 5.0)}


def test_merged_aggregates_come_from_the_same_pass(spark):
    rnd = random.Random(11)
    data = [(rnd.choice([None, "a", "b", "c"]), rnd.choice([None, float("nan"), 0.0, 1.0, 2.5]), rnd.randrange(9)) for _ in range(200)] + [("none", None, 4), ("none", None, 1)]
    df = spark.createDataFrame(data, "k string, v double, w int")
    out = rank.exact_median(df, ["k"], {"mid": "v"}, fine=True, merged={"n": (F.lit(1), "sum"), "lo": (F.col("w"), "min"), "hi": (F.when(F.col("v") > 1, F.col("w")), "max")})
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.min("w").alias("lo"), F.max(F.when(F.col("v") > 1, F.col("w"))).alias("hi"), F.median(F.nanvl("v", F.lit(None).cast("double"))).alias("mid"))
    assert out.columns == ["k", "n", "lo", "hi", "mid"] and sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2  # once for the counts, once for the histogram on the same shuffle
    with pytest.raises(ValueError):
        rank.exact_median(df, ["k"], {"mid": "v"}, merged={"n": (F.lit(1), "sum")})


def test_equal_scores_of_many_rows_are_spread(spark):
    rows = spark.range(10_000).select(F.format_string("p%05d", "id").alias("p"), F.when(F.col("id") % 3 == 0, 0.0).when(F.col("id") % 3 == 1, 0.00001).alias("s"))
    got = [(r.p, r.rank) for r in rank.ranked(rows, [], "s", "p").orderBy("rank").collect()]
    want = sorted(((r.p, r.s) for r in rows.collect()), key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    assert got == [(p, i + 1) for i, (p, _) in enumerate(want)]


def test_equal_scores_with_like_ties_lie_on_many_parts(spark):
    rows = spark.range(100_000).select(F.format_string("Property#%09d", "id").alias("p"), F.when(F.col("id") % 50 > 0, 7.5).alias("s"))
    parts = rank.laid_out(rows, [F.desc_nulls_last("s"), F.col("p")], 8).groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("lo"), F.max("_at").alias("hi")).collect()
    assert len(parts) == 8 and max(r.n for r in parts) < 25_000 and all(r.lo == 0 and r.hi == r.n - 1 for r in parts)
    got = rank.ranked(rows, [], "s", "p", parts=8).select("p", "s", "rank").collect()
    want = sorted(((r.p, r.s) for r in got), key=lambda r: (r[1] is None, r[0]))
    assert [(p, s) for p, s, _ in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 100_001))


def test_ranks_within_groups_over_parts(spark):
    rnd = random.Random(7)
    data = [(rnd.choice([None, "a", "b"]), rnd.choice([None, 0.0, -0.0, 1.0, float("nan")]), i) for i in range(3000)] + [(f"k{i}", 1.0, i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, s double, i int")
    by_group = {}
    for k, s, i in data:
        by_group.setdefault(k, []).append((s is None, -(1e9 if s != s else s) if s is not None else 0, i))
    want = {(k, i): n for k, rs in by_group.items() for n, (_, _, i) in enumerate(sorted(rs), 1)}
    for parts in (None, 1, 6):
        assert {(r.k, r.i): r.rank for r in rank.ranked(df, ["k"], "s", "i", parts=parts).collect()} == want
    assert rank.ranked(df.limit(0), ["k"], "s", "i").collect() == []


def test_running_total_over_wide_gaps(spark):
    rows = spark.range(3000).select((F.col("id") * 10**9).alias("at"), F.lit(2).alias("n"))
    out = rank.running_total(rows, "at", "n", "before")
    assert all(r.before == 2 * r.at // 10**9 for r in out.collect())


def test_many_properties(spark):
    days = spark.sql("select explode(sequence(date'2026-01-01', date'2026-01-20')) as arrival_date")
    series = spark.range(500).select(F.format_string("p%04d", "id").alias("property")).join(days).withColumn("rate_usd", F.lit(100.0) + F.dayofmonth("arrival_date"))
    combos = S.flatness_combos(series, "p0000")
    assert combos.count() == 500 * len(fv.FLAT_COMBOS)
    assert not re.search(r"windowspecdefinition\(combo#\d+, spec", combos._jdf.queryExecution().optimizedPlan().toString())


def test_fine_medians_shuffle_once(spark):
    rows = spark.range(1000).select((F.col("id") % 300).alias("k"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = rank.exact_median(rows, ["k"], "v", fine=True)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    used = [line for line in final.split("\n") if "Exchange hashpartitioning" in line and "Reused" not in line]
    assert len(used) <= 4, final
