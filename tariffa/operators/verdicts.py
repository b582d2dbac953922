"""Rule verdicts per property and the ranked comparison of all properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tariffa import fixed_values as fv
from tariffa.functions import cells, stats
from tariffa.functions.text import case
from tariffa.operators.price_days import last_row
from tariffa.operators.rank import date_led, describe, join_on, ranked, weight_of, weighted
from tariffa.operators.series import KEYS, quoted, rolling
from tariffa.session import stored


METRICS = {"demand": "market_demand_frac", "otb": "market_otb_frac"}


def _known(m: str) -> Column:
    return quoted() & F.col(METRICS[m]).isNotNull()


def _moments(m: str, x: Column, y: Column, weight) -> list[Column]:
    """Means, squared deviations and products of a group. Weighted rows are summed up around the centres of `_centred`."""
    if weight is None:
        n = F.count_if(_known(m))
        return [F.avg(x).alias("x"), F.avg(y).alias("y"), (F.var_pop(x) * n).alias("xx"), (F.var_pop(y) * n).alias("yy"), (F.covar_pop(x, y) * n).alias("xy")]
    n, w = weighted(weight, _known(m)), F.col(weight)
    off = {"x": x - F.col(f"_{m}_x"), "y": y - F.col(f"_{m}_y")}
    mean = {a: F.try_divide(F.sum(w * off[a]), n) for a in "xy"}
    around = lambda a, b: F.sum(w * off[a] * off[b]) - n * mean[a] * mean[b]
    return [*[(F.max(f"_{m}_{a}") + mean[a]).alias(a) for a in "xy"], around("x", "x").alias("xx"), around("y", "y").alias("yy"), around("x", "y").alias("xy")]


def _centred(panel: DataFrame, keys, weight) -> DataFrame:
    """The rows with the means of their property (one small stored table), from which the deviations are taken."""
    mean = lambda m, c: F.try_divide(F.sum(F.when(_known(m), F.col(c) * F.col(weight))), weighted(weight, _known(m)))
    centres = panel.groupBy(*keys).agg(*[mean(m, c).alias(f"_{m}_{a}") for m in METRICS for a, c in (("x", "rate_usd"), ("y", METRICS[m]))])
    return panel.join(stored(centres, "centres"), list(keys))


def date_moments(panel: DataFrame, order, keys=KEYS, weight=None) -> DataFrame:
    """One row per property and date with all that the rules need, from one read of the panel (or three of the counted one).

    Counts, means, squared deviations and products of price and each metric, the first and
    last row of the day in (stay, order) sequence, and count, range and mean of the price.
    """
    panel = panel.where(F.col("property").isNotNull())
    if weight is not None:
        panel = _centred(panel, keys, weight)
    rate, last = F.col("rate_usd"), last_row(panel, order)
    quotes = weighted(weight, quoted())
    out = [weighted(weight).alias("n_total"), quotes.alias("n"), F.max(F.when(quoted(), rate)).alias("hi"), F.min(F.when(quoted(), rate)).alias("lo"),
           F.try_divide(F.sum(F.when(quoted(), rate * weight_of(weight))), quotes).alias("mean")]
    for m, metric in METRICS.items():
        ok, of_row = _known(m), [rate.alias("rate"), F.col(metric).cast("double").alias("metric")]
        x, y = F.when(ok, rate), F.when(ok, F.col(metric).cast("double"))
        out += [weighted(weight, ok).alias(f"n_{m}"), F.struct(
            *_moments(m, x, y, weight), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).alias(m)]
        if m == "otb":
            head = F.struct("length_of_stay_nights", *order)
            ends = [fn(F.when(ok, F.struct(at.alias("at"), *of_row))).alias(name) for fn, at, name in ((F.min, head, "head"), (F.max, last, "tail"))]
    by = date_led([*keys, "arrival_date"])
    if weight is None:
        return panel.groupBy(*by).agg(*out, *ends)
    # numbers alone are kept in place by a hash aggregate; only the ends need sorted groups
    return join_on(panel.groupBy(*by).agg(*out), panel.where(_known("otb")).groupBy(*by).agg(*ends), by, "left")


def _r(m: str) -> Column:
    """Pearson r from sums of squares and products around the overall means; null if a side is constant."""
    varies = (F.max(f"{m}_x1") > F.min(f"{m}_x0")) & (F.max(f"{m}_y1") > F.min(f"{m}_y0"))
    return F.when(varies, F.try_divide(F.sum(f"{m}_xy"), F.sqrt(F.sum(f"{m}_xx")) * F.sqrt(F.sum(f"{m}_yy"))))


def rule_inputs(panel: DataFrame, order, keys=KEYS, weight=None) -> DataFrame:
    """r values, weekly range and their counts per property, from one read of the panel.

    The moments per date are merged around the means over all dates, so no large sums of
    squares are subtracted. All later steps work on one row per property and date, and then
    per week, on one partitioning by property.
    """
    whole, by_date = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("arrival_date")
    so_far = by_date.rowsBetween(Window.unboundedPreceding, -1)
    dates = date_moments(panel, order, keys, weight)
    centre = {f"{m}_{a}": F.try_divide(F.sum(F.col(f"n_{m}") * F.col(f"{m}.{a}")).over(whole), F.sum(f"n_{m}").over(whole)) for m in METRICS for a in "xy"}
    before, day = F.last("tail", True).over(so_far), F.last(F.when(F.col("tail").isNotNull(), F.col("arrival_date")), True).over(so_far)
    dates = dates.withColumns({**centre, "before": before, "day": day})
    step = (F.date_diff("arrival_date", "day") == 1) & F.col("head").isNotNull()
    dates = dates.withColumns({"d_x": F.when(step, F.col("head.rate") - F.col("before.rate")), "d_y": F.when(step, F.col("head.metric") - F.col("before.metric"))})
    dates = dates.withColumns({f"diff_{a}": F.avg(f"d_{a}").over(whole) for a in "xy"})
    sums = []
    for m in METRICS:
        off = {a: F.col(f"{m}.{a}") - F.col(f"{m}_{a}") for a in "xy"}
        sums += [F.sum(F.col(f"{m}.{a}{b}") + F.col(f"n_{m}") * off[a] * off[b]).alias(f"{m}_{a}{b}") for a, b in ("xx", "xy", "yy")]
        sums += [F.sum(f"n_{m}").alias(f"n_{m}"), *[f(f"{m}.{a}{i}").alias(f"{m}_{a}{i}") for a in "xy" for i, f in enumerate((F.min, F.max))]]
    off = {a: F.col(f"d_{a}") - F.col(f"diff_{a}") for a in "xy"}
    sums += [F.sum(off[a] * off[b]).alias(f"diff_{a}{b}") for a, b in ("xx", "xy", "yy")]
    sums += [F.count("d_x").alias("n_diff"), *[f(f"d_{a}").alias(f"diff_{a}{i}") for a in "xy" for i, f in enumerate((F.min, F.max))]]
    weekday = F.when(F.col("n") > 0, F.expr("shiftleft(1, weekday(arrival_date))"))
    weeks = dates.groupBy(*keys, cells.iso_year("arrival_date").alias("iso_year"), F.weekofyear("arrival_date").alias("iso_week")).agg(
        *sums, F.coalesce(F.bit_count(F.bit_or(weekday)), F.lit(0)).alias("n_weekdays"), (F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"),
        F.sum("n").alias("n"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    return rolling(weeks.withColumn("priced", F.col("n") > 0), (*keys, "priced")).groupBy(*keys).agg(
        F.sum("n_demand").alias("n_1a"), _r("demand").alias("r_1a"), F.sum("n_diff").alias("n_1b"), _r("diff").alias("r_1b"),
        F.sum("n_otb").alias("n_1b_levels"), _r("otb").alias("r_1b_levels"), F.median("rolling").alias("dow_range"),
        F.count_if(F.col("n_weekdays") >= 5).alias("n_full_weeks"), F.sum("n").alias("n_dow"))


def demand_response(panel: DataFrame, order) -> DataFrame:
    """Price reacts to demand: level r and first-difference r both over their limits.

    The level r on the books share is reported beside them and does not decide.
    """
    return _responses(rule_inputs(panel, order)).drop("dow_range", "n_full_weeks", "n_dow")


def _responses(inputs: DataFrame) -> DataFrame:
    limits = {"1a": (fv.CORR_DEMAND_MIN, fv.CORR_DEMAND_LOW_N), "1b": (fv.CORR_DIFF_MIN, fv.CORR_DIFF_LOW_N), "1b_levels": (fv.CORR_LEVEL_MIN, fv.CORR_LEVEL_LOW_N)}
    out = inputs.withColumns({f"pass_{k}": stats.over(F.col(f"r_{k}"), at_least) for k, (at_least, _) in limits.items()})
    out = out.withColumns({f"low_power_{k}": F.col(f"r_{k}").isNull() | (F.col(f"n_{k}") < low) for k, (_, low) in limits.items()})
    return out.withColumn("rule1_pass", F.col("pass_1a") & F.col("pass_1b"))


def rm_verdicts(panel: DataFrame, order, weight=None) -> DataFrame:
    """STATIC, PARTIALLY_DYNAMIC or DYNAMIC for every property.

    Three rules count. The lead-time rule cannot be measured on one panel and stays
    null, which keeps the verdict from reaching DYNAMIC. `weight` names the count column of a counted panel.
    """
    rules = _responses(rule_inputs(panel, order, weight=weight)).withColumns({
        "rule2_pass": stats.over(F.col("dow_range"), fv.WEEK_RANGE_MIN),
        "low_power_dow": F.col("dow_range").isNull() | (F.col("n_full_weeks") < fv.WEEK_RANGE_LOW_N),
        "rule3_pass": F.lit(None).cast("boolean")}).drop("n_full_weeks")
    names = ("rule1_pass", "rule2_pass", "rule3_pass")
    passed = sum((F.coalesce(F.col(n), F.lit(False)).cast("int") for n in names), F.lit(0))
    skipped = sum((F.col(n).isNull().cast("int") for n in names), F.lit(0))
    label = case([
        ((F.col("n_rules_passed") == 3) & (F.col("n_rules_skipped") == 0), "DYNAMIC"),
        (F.col("n_rules_passed") == 0, "STATIC"),
    ], "PARTIALLY_DYNAMIC")
    note = F.when(F.col("rule3_pass").isNull(), "; lead-time n/a").otherwise("")
    return (
        rules.withColumn("n_rules_passed", passed).withColumn("n_rules_skipped", skipped)
        .withColumn("n_rules_observed", 3 - F.col("n_rules_skipped")).withColumn("classification", label)
        .withColumn("display_label", F.format_string(
            "%s (%d of %d observed; %d skipped%s)", "classification", "n_rules_passed", "n_rules_observed",
            "n_rules_skipped", note)))


def comp_verdicts(verdicts: DataFrame, position="property") -> DataFrame:
    """All verdicts ranked by the sum of both r values and the weekly range (null as 0)."""
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("r_1a", "r_1b", "dow_range")]
    scored = verdicts.withColumn("composite", parts[0] + parts[1] + parts[2])
    return ranked(scored, [], "composite", position).select(
        "property", "classification", "display_label", "r_1a", "r_1b", "r_1b_levels", "dow_range", "composite",
        "rank", "rule1_pass", "rule2_pass")


def median_range(verdicts: DataFrame) -> DataFrame:
    """Median weekly range over the properties that have one."""
    return describe(verdicts, [], [F.count("dow_range").alias("n")], {"median_dow_range": "dow_range"}).select("median_dow_range", "n")
