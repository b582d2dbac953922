"""Order statistics, first rows and running totals that never gather a group in one task.

A plain `median` keeps every distinct value of a group in one task. Here a group is
first counted into value buckets, which both engines of a shuffle can pre-aggregate.
The running count over the buckets (a bounded number per group, whatever the group
holds) tells which bucket carries the wanted rank, and only the rows of that bucket
are then ranked. The answer is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tariffa.functions.text import any_of
from tariffa.session import stored

BUCKETS_PER_E = 1024  # relative bucket width of about 0.1%
PARTS = 1024  # parts of a wanted bucket
BLOCKS = 100_000  # of a running total


def value_bucket(v: Column) -> Column:
    """Order-preserving coarse bucket of a double; the number of buckets is bounded."""
    size = F.floor(F.least(F.log1p(F.abs(v) * 1e4), F.lit(800.0)) * BUCKETS_PER_E)
    return F.when(v < 0, -size).otherwise(size)


def join_on(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Equi-join that treats null keys as equal and keeps one copy of the keys."""
    names = {k: f"_r_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()])
    return left.join(right, cond, how).drop(*names.values())


def _holding(histogram: DataFrame, by, order: str, before, ranks: dict, also: Column | None = None) -> DataFrame:
    """The histogram rows that hold any wanted rank (or are wanted also), with the count before them as `_start`."""
    upto = before + F.sum("_n").over(Window.partitionBy(*by).orderBy(order))
    rows = histogram.select("*", (upto - F.col("_n")).alias("_start"), upto.alias("_upto"))
    return rows.where(any_of([*([] if also is None else [also]), *((fn(F.col("_total")) >= F.col("_start")) & (fn(F.col("_total")) < F.col("_upto")) for fn in ranks.values())]))


#: How the parts of an aggregate are put together.
MERGE = {"min": F.min, "max": F.max, "sum": F.sum}


def weight_of(weight) -> Column:
    """How many rows a row stands for: one, or the column named."""
    return F.lit(1) if weight is None else F.col(weight)


def weighted(weight, when: Column | None = None) -> Column:
    """The number of rows (for which `when` is true) that a group of weighted rows stands for."""
    return F.coalesce(F.sum(weight_of(weight) if when is None else F.when(when, weight_of(weight))), F.lit(0)).cast("long")


def order_statistics(df: DataFrame, keys, values: dict, ranks: dict, fine=False, merged: dict | None = None, weight=None) -> DataFrame:
    """Exact values at given ranks.

    `values` maps a name to a column; `ranks` maps a suffix to a function from the
    group's row count to a 0-based rank. Nulls and NaN are left out. The result has
    the keys and one column `<name><suffix>` for every pair. Groups without a value
    are absent.

    The keys travel as one struct, in which null keys are equal to each other. Coarse keys
    read the input twice: once for the histogram, once for the rows of the wanted buckets.
    Those are counted by value, and a second histogram cuts each wanted bucket into PARTS,
    so that also many values in one bucket are ranked in many tasks. With `fine` keys (about
    as many groups as rows) the input is shuffled once, by group and bucket; counts, ranks
    and values stay on that partitioning and only the histogram moves.

    `merged` (one value, and fine keys or a weight) maps a name to (column, "min", "max" or "sum"): plain aggregates of the same groups
    in the same pass, over all their rows. Then groups without a value are there too, with null ranks.

    `weight` names a column of positive whole numbers: a row then counts as that many equal rows. Such a table is stored and cheap
    to read twice; for coarse keys the wanted buckets are stored too, so that Spark knows how few they are before it plans the join.
    """
    merged = merged or {}
    if merged and not ((fine or weight is not None) and len(values) == 1):
        raise ValueError("merged aggregates need fine keys (or a weight) and one value")
    keys = list(keys)
    cols = {name: F.col(c) if isinstance(c, str) else c for name, c in values.items()}
    key = F.struct(*[F.col(k) for k in keys])
    times = [] if weight is None else [F.col(weight).cast("long").alias("_times")]
    if len(cols) == 1:
        (only, c), = cols.items()
        rows = df.select(F.struct(key.alias("k")).alias("_k"), F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias("_v"), *times, *[x.alias(f"_m_{n}") for n, (x, _) in merged.items()])
    else:
        only = None
        rows = df.select(key.alias("_g"), *times, F.inline(F.array(*[
            F.struct(F.lit(name).alias("_metric"), c.cast("double").alias("_v")) for name, c in cols.items()]))).select(
            F.struct(F.col("_g").alias("k"), F.col("_metric").alias("metric")).alias("_k"), "_v", *([] if weight is None else ["_times"]))
    if not merged:
        rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    # never null, so that a join adds no filter to one of its sides and the shuffles stay alike
    rows = rows.withColumn("_bucket", F.coalesce(value_bucket(F.col("_v")), F.lit(0).cast("long")))
    many = (F.count("_v") if weight is None else F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_times"))), F.lit(0))).alias("_w")
    total = F.sum("_n").over(Window.partitionBy("_k")).alias("_total")
    put = [MERGE[how](f"_m_{n}").alias(f"_m_{n}") for n, (_, how) in merged.items()]
    whole = [MERGE[how](f"_m_{n}").over(Window.partitionBy("_k")).alias(f"_all_{n}") for n, (_, how) in merged.items()]
    alls, unvalued = [f"_all_{n}" for n in merged], F.col("_total") == 0 if merged else None
    if fine:
        counted = rows.repartition("_k", "_bucket").groupBy("_k", "_bucket", "_v").agg(many, *put)
        histogram = counted.groupBy("_k", "_bucket").agg(F.sum("_w").alias("_n"), *put).select("_k", "_bucket", "_n", total, *whole)
        wanted = _holding(histogram, ["_k"], "_bucket", F.lit(0), ranks, unvalued).select("_k", "_bucket", F.col("_start").alias("_before"), "_total", *alls)
        near, inside = counted.join(wanted, ["_k", "_bucket"]), ["_k", "_bucket"]
    else:
        histogram = rows.groupBy("_k", "_bucket").agg(many.alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), *put).select("*", total, *whole)
        wanted = _holding(histogram, ["_k"], "_bucket", F.lit(0), ranks, unvalued).select("_k", "_bucket", F.col("_start").alias("_base"), "_total", "_min", "_max", *alls)
        if weight is not None:
            wanted = stored(wanted, "wanted-buckets")
        counted = rows.join(wanted, ["_k", "_bucket"]).groupBy("_k", "_bucket", "_base", "_total", "_min", "_max", *alls, "_v").agg(many)
        part = F.coalesce(F.least(F.floor(F.try_divide(F.col("_v") - F.col("_min"), F.col("_max") - F.col("_min")) * PARTS), F.lit(PARTS - 1).cast("long")), F.lit(0).cast("long"))
        counted = counted.withColumn("_part", part)
        parts = counted.groupBy("_k", "_bucket", "_base", "_total", "_part").agg(F.sum("_w").alias("_n"))
        chosen = _holding(parts, ["_k", "_bucket"], "_part", F.col("_base"), ranks, unvalued).select("_k", "_bucket", "_part", F.col("_start").alias("_before"))
        near, inside = counted.join(chosen, ["_k", "_bucket", "_part"]), ["_k", "_bucket", "_part"]
    counted = near.withColumn("_upto", F.col("_before") + F.sum("_w").over(Window.partitionBy(*inside).orderBy("_v")))
    out = [
        F.min(F.when((F.lit(True) if only else F.col("_k.metric") == name) & (F.col("_upto") > fn(F.col("_total"))), F.col("_v")))
        .alias(name + suffix)
        for name in cols for suffix, fn in ranks.items()
    ]
    # the parts are named too (they are null where the whole is), so that both uses of `counted` read one shuffle of all columns
    out += [(F.coalesce(F.first(f"_all_{n}"), F.max(f"_m_{n}")) if fine else F.first(f"_all_{n}")).alias(n) for n in merged]
    return counted.groupBy(F.col("_k.k").alias("_g")).agg(*out).select(*[F.col(f"_g.{k}").alias(k) for k in keys], *[n + s for n in cols for s in ranks], *merged)


def exact_median(df: DataFrame, keys, values, fine=False, merged: dict | None = None, weight=None) -> DataFrame:
    """Exact interpolated median per group, one column for each entry of `values`, and those of `merged`."""
    values = {values: values} if isinstance(values, str) else dict(values)
    both = order_statistics(df, keys, values, {
        "_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2),
    }, fine, merged, weight)
    return both.select(*keys, *(merged or {}), *[
        ((F.col(f"{v}_lo") + F.col(f"{v}_hi")) / 2).alias(v) for v in values
    ])


def describe(df: DataFrame, keys, aggs, medians: dict, fine=False, weight=None) -> DataFrame:
    """Plain aggregates and exact medians of the same groups, joined on the keys."""
    keys = list(keys)
    if not keys:  # one row also for empty input
        plain = df.agg(*aggs).withColumn("_all", F.lit(1))
        middle = exact_median(df.withColumn("_all", F.lit(1)), ["_all"], medians, fine, weight=weight)
        return plain.join(middle, "_all", "left").drop("_all")
    plain = df.groupBy(*keys).agg(*aggs)
    return join_on(plain, exact_median(df, keys, medians, fine, weight=weight), keys, "left")


def date_led(keys) -> list[str]:
    """The keys with the date in front.

    Aggregates of structs are sorted by their groups, and such a sort compares the first 8 bytes of the first key, only where
    these are equal the rows themselves. Names often agree in them. Tables that are stored in this order are sorted already.
    """
    return sorted(keys, key=lambda k: k != "arrival_date")


def first_row(df: DataFrame, keys, order, columns) -> DataFrame:
    """The columns of the first row of each group under a total order.

    An aggregate, so both sides of the shuffle carry one row per group; no group is
    sorted in one task.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ranked = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)],
                      F.struct(*columns).alias("_row"))
    return df.groupBy(*date_led(keys)).agg(F.min(ranked).alias("_first")).select(*keys, "_first._row.*")


def running_total(df: DataFrame, position: str, amount, name: str, block: int = 1_000_000) -> DataFrame:
    """Sum of `amount` over all rows before this one in `position` order.

    The whole-number positions may have gaps of any size: their range is cut into at most
    `BLOCKS` even blocks of at least `block` positions, the block sums are added up first
    (a bounded number), then each block is summed on its own.
    """
    amount = F.col(amount) if isinstance(amount, str) else amount
    at = F.col(position).cast("decimal(38,0)")
    low, high = df.agg(F.min(at), F.max(at)).first()
    low, high = int(low or 0), int(high or 0)
    width = max(block, -(-(high - low + 1) // BLOCKS))
    rows = df.withColumn("_amount", amount).withColumn("_block", F.floor((at - F.lit(low).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)")).cast("long"))
    sums = rows.groupBy("_block").agg(F.sum("_amount").alias("_sum"))
    before_block = sums.select("_block", F.coalesce(
        F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ).alias("_base"))
    inside = Window.partitionBy("_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(before_block, "_block")
        .withColumn(name, F.col("_base") + F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
        .drop("_block", "_base", "_amount")
    )


def laid_out(df: DataFrame, order, parts: int | None = None) -> DataFrame:
    """The rows in `order` over several files: `_part` is the number of the range a row lies in, `_at` its place there.

    The ranges are cut at sampled splitters of the whole order, so equal leading values are cut by the columns after them.
    The rows are written to the work folder: the input runs once, and what is counted is what is ranked.
    """
    laid = (df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    laid = laid.withColumns({"_part": F.shiftright(place, 33), "_at": place.bitwiseAND((1 << 33) - 1)})
    return stored(laid, "laid-out")


def ranked(df: DataFrame, keys, score, tie, name="rank", parts: int | None = None) -> DataFrame:
    """1-based rank by score, best first, null scores last, ties by `tie` (a unique order).

    The rows are laid out by range of keys, score and tie. A row's rank is its place in its range, plus the rows that its
    group has in earlier ranges: a running sum over one count a range and group. No range grows with the rows that share a
    score, and the rows are shuffled once.
    """
    keys = list(keys)
    score = F.col(score) if isinstance(score, str) else score
    ties = [F.col(t) if isinstance(t, str) else t for t in ([tie] if isinstance(tie, (str, Column)) else tie)]
    rows = df.withColumn("_score", score.cast("double") + F.lit(0.0))  # one zero
    laid = laid_out(rows, [*[F.asc_nulls_first(k) for k in keys], F.desc_nulls_last("_score"), *ties], parts)
    group = ["_part", *keys]
    counts = laid.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_before"))
    return join_on(laid, counts, group).withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before", "_score")
