"""Field-level verification of captured cells against an expected list.

Cells carry two maps of text: `expected` and `actual`. In `expected` a key with a null
value asserts that the actual value is null; a key that is not there asserts nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tariffa import fixed_values as fv
from tariffa.functions.text import case, decimal, strip, text


def _first_key(m: Column, keys) -> Column:
    """Value of the first key that the map has, also when that value is null."""
    return case([(F.map_contains_key(m, k), m[k]) for k in keys], F.lit(None).cast("string"))


def field_check(field: str) -> Column:
    """struct(expected, actual, passed) of one field; passed is null when nothing is asserted."""
    spec_keys, actual_keys = fv.VERIFY_FIELDS[field]
    spec, seen = F.col("expected"), F.col("actual")
    asserted = F.coalesce(spec.isNotNull() & F.exists(F.map_keys(spec), lambda k: k.isin(*spec_keys)), F.lit(False))
    want = _first_key(spec, spec_keys)
    got = F.coalesce(*[F.try_element_at(seen, F.lit(k)) for k in actual_keys])
    if field == "room_type_canonical_present":
        low = F.lower(got)
        got = F.when(low.isin("true", "false"), low).otherwise(F.when(got.isNotNull(), (strip(got) != "").cast("string")))
        want = F.lower(want)
    a, e = decimal(F.trim(got)), decimal(F.trim(want))
    if field == "bar_non_ref_nightly_allin":
        same = F.try_divide(F.abs(a - e), e) <= fv.RATE_TOLERANCE
    elif field == "promo_banner_text":
        same = F.lower(got).contains(F.lower(want))
    else:
        same = (got == want) | F.coalesce(a == e, F.lit(False))
    passed = case([
        (~asserted, F.lit(None)), (want.isNull(), got.isNull()), (got.isNull(), False)], F.coalesce(same, F.lit(False)))
    return F.struct(want.alias("expected"), got.alias("actual"), passed.cast("boolean").alias("passed"))


def match_cells(report: DataFrame, spec: DataFrame) -> DataFrame:
    """Report entries with their spec cell; entries without one are left out."""
    return report.join(spec, "cell_id")


def checks(cells: DataFrame, fields=fv.TRACKED_FIELDS, keep=("cell_id", "channel")) -> DataFrame:
    """One row per cell and field."""
    return cells.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), field_check(f).alias("check")) for f in fields]))).select(
        *keep, "field", "check.*")


def field_counters(checked: DataFrame) -> DataFrame:
    """Passed, failed and not asserted checks per channel and field."""
    return checked.groupBy("channel", "field").agg(
        F.count_if(F.coalesce("passed", F.lit(False))).alias("n_pass"),
        F.count_if(F.coalesce(~F.col("passed"), F.lit(False))).alias("n_fail"),
        F.count_if(F.col("passed").isNull()).alias("n_na"))


def fail_samples(checked: DataFrame, k=3) -> DataFrame:
    """The first k failing cells of every channel and field, by cell id.

    Spark keeps only k rows per group before the shuffle for this kind of filter.
    """
    nth = F.row_number().over(Window.partitionBy("channel", "field").orderBy("cell_id"))
    return checked.where(~F.col("passed")).withColumn("nth", nth).where(F.col("nth") <= k).drop("passed")


def run_verdict(counters: DataFrame, critical=fv.CRITICAL_FIELDS, per_channel=False) -> DataFrame:
    """GREEN, YELLOW or RED by the lowest pass rate of a channel and field.

    RED without any counter, and RED when a critical field was never checked (in any
    channel, or with `per_channel` in one of them).
    """
    done = F.col("n_pass") + F.col("n_fail")
    rate = F.try_divide(F.col("n_pass"), done)
    if per_channel:
        channels = counters.groupBy("channel").agg(*[
            F.sum(F.when(F.col("field") == c, done).otherwise(0)).alias(f"c{i}") for i, c in enumerate(critical)])
        gaps = channels.agg(F.sum(sum((F.col(f"c{i}") == 0).cast("int") for i in range(len(critical)))).alias("g"))
        unchecked = F.coalesce(gaps.scalar(), F.lit(0))
    else:
        unchecked = sum((F.coalesce(F.sum(F.when(F.col("field") == c, done)), F.lit(0)) == 0).cast("int") for c in critical)
    head = counters.agg(F.count(F.lit(1)).alias("n_counters"), F.min(rate).alias("worst_rate"),
                        F.lit(0).alias("z") if per_channel else unchecked.alias("n_unchecked_critical"))
    if per_channel:
        head = head.drop("z").withColumn("n_unchecked_critical", unchecked)
    worst = F.coalesce("worst_rate", F.lit(1.0))
    return head.withColumn("verdict", case([
        ((F.col("n_counters") == 0) | (F.col("n_unchecked_critical") > 0), "RED"),
        (worst >= fv.GREEN_FROM, "GREEN"), (worst >= fv.YELLOW_FROM, "YELLOW")], "RED"))


def settle(verdicts: DataFrame, local="local_verdict", report="report_verdict", trust=False) -> DataFrame:
    """Local verdict against the reported one: refuse a different report unless it is trusted."""
    differs = (text(report) != "") & (F.col(report) != F.col(local))
    return verdicts.withColumn("final_verdict", F.when(differs & F.lit(trust), F.col(report)).otherwise(F.col(local))).withColumn(
        "refused", differs & ~F.lit(trust))


def truth_rows(cells: DataFrame, fields=fv.TRUTH_FIELDS) -> DataFrame:
    """Cells that the report passes and whose every asserted stored field matches here too."""
    agree = [F.coalesce(field_check(f)["passed"], F.lit(True)) for f in fields]
    ok = agree[0]
    for a in agree[1:]:
        ok = ok & a
    return cells.where((F.col("report_verdict") == "PASS") & ok)


def green_streak(runs: DataFrame, position="seq", verdict="verdict") -> DataFrame:
    """Number of GREEN runs at the end of the history, and of all runs."""
    last_other = runs.where(F.col(verdict) != "GREEN").agg(F.max(position)).scalar()
    return runs.agg(
        F.count_if(F.col(position) > F.coalesce(last_other, F.lit(-1).cast("bigint"))).alias("green_streak"),
        F.count(F.lit(1)).alias("n_runs"))


def last_runs(runs: DataFrame, k=10, position="seq") -> DataFrame:
    return runs.orderBy(F.desc(position)).limit(k)
