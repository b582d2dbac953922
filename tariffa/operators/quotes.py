"""Analyses of quote rows: canonical picks, channel spreads, premiums, coverage.

Every function takes the entity columns as `by`, so several properties are analysed
in one pass.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from tariffa import fixed_values as fv
from tariffa.functions import plans
from tariffa.functions.cells import weekday
from tariffa.functions.stats import cv_percent
from tariffa.functions.text import case, decimal
from tariffa.operators.rank import describe, first_row, join_on, ranked

ROOM = ("property_id", "channel", "arrival_date", "nights", "marketing_name")
RATE, LABEL, PHRASE, MEMBER = "rate_per_night_usd", "rate_plan_label", "cancellation_phrase", "is_genius_member_rate"


# ------------------------------------------------------------------ picks and tags
def with_facts(quotes: DataFrame, phrase=PHRASE) -> DataFrame:
    """Add state, inclusions and fence of every plan, once, for the rules that need them."""
    return quotes.withColumns({
        "_state": plans.refundability(F.lit(None).cast("string") if phrase is None else phrase, LABEL),
        "_inside": plans.bundle(LABEL), "_fenced": plans.is_fenced(LABEL, MEMBER)})


FACTS = ("_state", "_inside", "_fenced")


def pick(quotes: DataFrame, state: str, order, room=ROOM) -> DataFrame:
    """Lowest bare, posted plan of each room for a refundability state; first plan on ties."""
    rows = with_facts(quotes).where(plans.fits(state, RATE, *FACTS))
    return first_row(rows, room, [RATE, *order], [LABEL, RATE, *order])


def tag_rows(quotes: DataFrame, order, room=ROOM, missed=None) -> DataFrame:
    """Posted-rate flag, bucket, derived flags and row status of every plan.

    The two picked plans of a room come from one aggregate over the pickable plans and
    are joined back; AQE splits a room that holds very many plans.
    """
    facts = with_facts(quotes)
    rank = F.struct(*[F.col(c) for c in (RATE, *order)])
    bar, flex = (plans.fits(s, RATE, *FACTS) for s in (fv.NON_REFUNDABLE, fv.REFUNDABLE))
    picks = facts.where(bar | flex).groupBy(*room).agg(
        F.min(F.when(bar, rank)).alias("_bar"), F.min(F.when(flex, rank)).alias("_flex"))
    is_bar = F.coalesce(rank == F.col("_bar"), F.lit(False)) & bar
    is_flex = F.coalesce(rank == F.col("_flex"), F.lit(False)) & flex
    bucket = case([(F.col("is_bar"), "BAR_NON_REF"), (F.col("_is_flex"), "BAR_FLEX")], plans.bucket(RATE, *FACTS))
    incomplete = F.lit(False) if missed is None else F.size(missed) > 0
    return join_on(facts, picks, room, "left").withColumns({"is_bar": is_bar, "_is_flex": is_flex}).withColumns({
        "rate_plan_canonical": bucket, "bundle_inclusions": F.col("_inside"),
        "strikethrough_pct": plans.strikethrough_share("strikethrough_orig_rate", RATE),
        "status": case([(incomplete, "extract_incomplete"), (F.col("is_bar"), "ok")], "non_bar_rate"),
    }).drop("_bar", "_flex", "_is_flex", *FACTS)


def posted_rows(quotes: DataFrame, order, room=ROOM, **wanted) -> DataFrame:
    """The posted-rate rows alone: the pick of each room, without tagging the others."""
    rows = with_facts(quotes).where(plans.fits(fv.NON_REFUNDABLE, RATE, *FACTS)).drop(*FACTS)
    rest = [c for c in quotes.columns if c not in room]
    return posted(first_row(rows, room, [RATE, *order], rest).withColumn("is_bar", F.lit(True)), **wanted)


def posted(tagged: DataFrame, nights=None, skus=None, on_weekday=None, sku_column="marketing_name") -> DataFrame:
    """Posted-rate rows with a price, of given nights, SKUs and weekday (Monday is 0)."""
    out = tagged.where(F.col("is_bar") & plans.has_rate(RATE))
    if nights is not None:
        out = out.where(F.col("nights") == nights)
    if skus is not None:
        out = out.where(F.col(sku_column).isin(*skus))
    if on_weekday is not None:
        out = out.where(weekday("arrival_date") == on_weekday)
    return out


def lowest_price(rows: DataFrame, keys, order) -> DataFrame:
    """Lowest price per key, accessible rooms only when there is no other."""
    ada = F.coalesce(F.col("mapped_ada"), F.lit(False))
    return first_row(rows, keys, [ada, RATE, *order], [F.col(RATE).alias("rate_usd")])


def room_cells(posted_rows: DataFrame, order, by=("property_id",), room="marketing_name", unmapped="UNMAPPED") -> DataFrame:
    """One price per channel, date and room; unmapped rooms are left out."""
    return lowest_price(posted_rows.where(F.col(room) != unmapped).withColumn("room", F.col(room)),
                        [*by, "channel", "arrival_date", "room"], order)


def plan_cells(quotes: DataFrame, order, by=("property_id",), room="marketing_name", nights=1, rooms=None) -> DataFrame:
    """One price per channel, date, room and plan label over the refundable rows; nights=None takes every stay."""
    rows = quotes.where(F.col("refundable") & plans.has_rate(RATE))
    if nights is not None:
        rows = rows.where(F.col("nights") == nights)
    if rooms is not None:
        rows = rows.where(F.col(room).isin(*rooms))
    return lowest_price(rows.withColumn("room", F.col(room)), [*by, "channel", "arrival_date", "room", LABEL], order)


# ------------------------------------------------------------------ coverage and ranges
def coverage(cells: DataFrame, channels, by=("property_id",)) -> DataFrame:
    """Dates covered per room and channel, the total, and the dates there are."""
    dates = cells.groupBy(*by, "arrival_date").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count("one").alias("n_dates"))
    counts = cells.where(F.col("channel").isin(*channels)).groupBy(*by, "room").agg(
        *[F.count_if(F.col("channel") == c).alias(c) for c in channels], F.count(F.lit(1)).alias("total"))
    return counts.join(dates, list(by)).withColumn("n_possible", F.col("n_dates") * len(channels))


def price_range(cells: DataFrame, by=("property_id",)) -> DataFrame:
    return describe(cells, [*by, "room"], [
        F.count("rate_usd").alias("n"), F.min("rate_usd").alias("min_usd"), F.max("rate_usd").alias("max_usd"),
        F.avg("rate_usd").alias("mean_usd")], {"median_usd": "rate_usd"})


def rate_matrix(cells: DataFrame, channels, by=("property_id",)) -> DataFrame:
    """One row per room and date: a column per channel and the mean over channels."""
    return cells.where(F.col("channel").isin(*channels)).groupBy(*by, "room", "arrival_date").agg(
        *[F.max(F.when(F.col("channel") == c, F.col("rate_usd"))).alias(c) for c in channels],
        F.avg("rate_usd").alias("mean_usd"))


def matrix_by_date(cells: DataFrame, dates, channel=None, by=("property_id",)) -> DataFrame:
    """Rooms and channels (or the rooms of one channel) by the caller's full list of dates or months."""
    rows = cells if channel is None else cells.where(F.col("channel") == channel)
    return rows.groupBy(*by, "channel", "room").pivot("arrival_date", list(dates)).agg(F.max("rate_usd"))


def matrix_long(cells: DataFrame, by=("property_id",)) -> DataFrame:
    """The same prices with one row per room, channel and date, for any range of dates."""
    return cells.groupBy(*by, "channel", "room", "arrival_date").agg(F.max("rate_usd").alias("rate_usd"))


def first_rows(cells: DataFrame, n: int, order) -> DataFrame:
    """The first n rows of a sorted export."""
    return cells.orderBy(*order).limit(n)


def yield_intensity(cells: DataFrame, by=("property_id",)) -> DataFrame:
    """Variation of each room's price, most variable first; one price gives no CV."""
    stats = describe(cells, [*by, "room"], [
        F.count("rate_usd").alias("n"), F.min("rate_usd").alias("min_usd"), F.max("rate_usd").alias("max_usd"),
        F.avg("rate_usd").alias("mean_usd"), cv_percent(F.col("rate_usd")).alias("cv_pct")], {"median_usd": "rate_usd"})
    ratio = F.when(F.col("n") >= 2, F.try_divide("max_usd", "min_usd"))
    return ranked(stats.withColumn("max_min_ratio", ratio), by, "cv_pct", "room")


def payload_coverage(cells: DataFrame) -> DataFrame:
    """Dates, rooms and cells, overall and per channel."""
    per = cells.groupBy("channel", "arrival_date", "room").agg(F.count(F.lit(1)).alias("n"))
    overall = per.agg(F.lit("all").alias("channel"), F.count_distinct("arrival_date").alias("n_dates"),
                      F.count_distinct("room").alias("n_rooms"), F.sum("n").alias("n_cells"))
    each = per.groupBy("channel").agg(F.count_distinct("arrival_date").alias("n_dates"),
                                      F.count_distinct("room").alias("n_rooms"), F.sum("n").alias("n_cells"))
    return overall.unionByName(each)


# ------------------------------------------------------------------ channel spreads
def channel_spread(cells: DataFrame, channels, by=("property_id",)) -> DataFrame:
    """Lowest and highest channel of each room and date that has at least two.

    Ties go to the channel that comes first in the list.
    """
    place = case([(F.col("channel") == c, i) for i, c in enumerate(channels)])
    low = F.min(F.struct("rate_usd", place.alias("place"), "channel"))
    high = F.max(F.struct("rate_usd", (-place).alias("place"), "channel"))
    wide = cells.where(F.col("channel").isin(*channels)).groupBy(*by, "room", "arrival_date").agg(
        F.count(F.lit(1)).alias("n_channels"), low.alias("low"), high.alias("high"),
        *[F.max(F.when(F.col("channel") == c, F.col("rate_usd"))).alias(f"rate_{c}") for c in channels],
    ).where("n_channels >= 2")
    spread = F.col("high.rate_usd") - F.col("low.rate_usd")
    return wide.select(
        *by, "room", "arrival_date", "n_channels", F.col("low.rate_usd").alias("min_usd"),
        F.col("high.rate_usd").alias("max_usd"), F.col("low.channel").alias("min_channel"),
        F.col("high.channel").alias("max_channel"), spread.alias("spread_usd"),
        F.coalesce(F.try_divide(spread, F.col("low.rate_usd")) * 100, F.lit(0.0)).alias("spread_pct"),
        *[f"rate_{c}" for c in channels])


def spread_summary(spreads: DataFrame) -> DataFrame:
    """Spread statistics overall, per room and per date, as rows of (level, name)."""
    levels = F.array(*[
        F.struct(F.lit(level).alias("level"), name.cast("string").alias("name")) for level, name in (
            ("all", F.lit("")), ("room", F.col("room")), ("date", F.col("arrival_date")))])
    pct = F.col("spread_pct")
    return describe(spreads.select("spread_pct", F.inline(levels)), ["level", "name"], [
        F.count(F.lit(1)).alias("n"), F.avg(pct).alias("mean_pct"), F.max(pct).alias("max_pct"),
        F.count_if(pct >= 10).alias("n_10"), F.count_if(pct >= 30).alias("n_30")], {"median_pct": "spread_pct"})


def worst_spreads(spreads: DataFrame, n=15, tie=("arrival_date", "room", "property_id")) -> DataFrame:
    return spreads.orderBy(F.desc("spread_pct"), *tie).limit(n)


def _gap_pct(a, b):
    """|a - b| / min in percent; null unless both are there (`least` skips nulls)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.try_divide(F.abs(a - b), F.least(a, b)) * 100)


def pairwise_spread(spreads: DataFrame, channels) -> DataFrame:
    """|a - b| / min in percent for every pair of listed channels with both prices.

    The pairs are fixed by the channel list, so they are columns of one row and not a
    self join.
    """
    pairs = F.array(*[
        F.struct(F.lit(a).alias("channel_a"), F.lit(b).alias("channel_b"),
                 _gap_pct(F.col(f"rate_{a}"), F.col(f"rate_{b}")).alias("pct"))
        for a, b in combinations(channels, 2)])
    rows = spreads.select(F.inline(pairs)).where("pct is not null")
    return describe(rows, ["channel_a", "channel_b"], [
        F.count(F.lit(1)).alias("n"), F.avg("pct").alias("mean_pct"), F.max("pct").alias("max_pct")],
        {"median_pct": "pct"})


# ------------------------------------------------------------------ premiums and steps
def _roles(pairs, first, second):
    """(pair, role) array of a room from the fixed list of (label, first room, second room)."""
    return F.filter(F.array(*[
        F.struct(F.lit(label).alias("pair"), F.lit(role).alias("role"), F.lit(room).alias("_room"))
        for label, a, b in pairs for role, room in ((first, a), (second, b))]), lambda r: r["_room"] == F.col("room"))


def matched_premium(plan_rows: DataFrame, pairs, by=("property_id",), preferred="Standard Rate") -> DataFrame:
    """Premium of a view room over its base room on a plan that both sell.

    The preferred plan if both have it, else the plan whose cheaper side is lowest.
    `pairs` holds (label, base room, view room).
    """
    cell = [*by, "pair", "channel", "arrival_date"]
    both = plan_rows.select(*by, "channel", "arrival_date", LABEL, "rate_usd", F.inline(_roles(pairs, "base", "view"))).groupBy(
        *cell, LABEL).agg(
        F.min(F.when(F.col("role") == "base", F.col("rate_usd"))).alias("base_usd"),
        F.min(F.when(F.col("role") == "view", F.col("rate_usd"))).alias("view_usd"),
    ).where("base_usd is not null and view_usd is not null")
    best = F.min(F.struct((F.col(LABEL) != preferred).alias("a"), F.least("base_usd", "view_usd").alias("b"),
                          F.col(LABEL).alias("plan"), F.col("base_usd").alias("base"), F.col("view_usd").alias("view")))
    delta = F.col("best.view") - F.col("best.base")
    return both.groupBy(*cell).agg(
        best.alias("best"), F.count(F.lit(1)).alias("matched_n"),
        F.array_join(F.array_sort(F.collect_set(LABEL)), "|").alias("matched_plans"),
    ).select(*cell, F.col("best.plan").alias("rate_plan"), F.col("best.base").alias("base_usd"),
             F.col("best.view").alias("view_usd"), delta.alias("delta_usd"),
             (F.try_divide(delta, F.col("best.base")) * 100).alias("delta_pct"), "matched_n", "matched_plans")


def tier_steps(cells: DataFrame, steps, by=("property_id",)) -> DataFrame:
    """Upper minus lower room on the same channel and date. `steps` holds (label, lower, upper)."""
    cell = [*by, "pair", "channel", "arrival_date"]
    both = cells.select(*by, "channel", "arrival_date", "rate_usd", F.inline(_roles(steps, "lower", "upper"))).groupBy(*cell).agg(
        F.max(F.when(F.col("role") == "lower", F.col("rate_usd"))).alias("lower_usd"),
        F.max(F.when(F.col("role") == "upper", F.col("rate_usd"))).alias("upper_usd"),
    ).where("lower_usd is not null and upper_usd is not null")
    delta = F.col("upper_usd") - F.col("lower_usd")
    return both.withColumn("delta_usd", delta).withColumn("delta_pct", F.try_divide(delta, F.col("lower_usd")) * 100)


def delta_summary(rows: DataFrame, by=()) -> DataFrame:
    """Statistics of a delta per pair, overall (channel 'all') and per channel."""
    levels = rows.drop("channel").select("pair", *by, "delta_usd", "delta_pct", F.lit("all").alias("channel")).unionByName(
        rows.select("pair", *by, "delta_usd", "delta_pct", "channel"))
    d, p = F.col("delta_usd"), F.col("delta_pct")
    return describe(levels, [*by, "pair", "channel"], [
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_usd"), F.avg(p).alias("mean_pct"), F.min(d).alias("min_usd"),
        F.max(d).alias("max_usd"), F.count_if(d < 0).alias("n_negative"), F.count_if(d == 0).alias("n_zero"),
        cv_percent(d).alias("cv_pct")], {"median_usd": "delta_usd", "median_pct": "delta_pct"})


# ------------------------------------------------------------------ weekday ladder
def sku_ladder(posted_rows: DataFrame, order, sku="marketing_name", min_n=None, thin_below=3) -> DataFrame:
    """Price per SKU over the dates given: lowest per date and SKU, then median and range.

    `min_n` maps a SKU to the observations it needs to be shown.
    """
    per_date = lowest_price(posted_rows.where(F.col(sku).isNotNull()).withColumn("mapped_ada", F.lit(False))
                            .withColumn("sku", F.col(sku)), ["arrival_date", "sku"], order)
    out = describe(per_date, ["sku"], [
        F.count(F.lit(1)).alias("n"), F.min("rate_usd").alias("min_usd"), F.max("rate_usd").alias("max_usd")],
        {"median_usd": "rate_usd"})
    for name, needed in (min_n or {}).items():
        out = out.where((F.col("sku") != name) | (F.col("n") >= needed))
    return out.withColumn("is_thin", F.col("n") < thin_below)


def ladder_deltas(ladder: DataFrame, pairs) -> DataFrame:
    """Difference of two SKU medians for every listed (view, base) pair; null if one is absent."""
    at = lambda s: F.max(F.when(F.col("sku") == s, F.col("median_usd")))
    wide = ladder.agg(*[(at(v) - at(b)).alias(f"d{i}") for i, (v, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(f"{v}_minus_{b}").alias("pair"), F.col(f"d{i}").alias("value_usd"))
        for i, (v, b) in enumerate(pairs)])))


def ratio_check(quotes: DataFrame, suspect_above=1.10) -> DataFrame:
    """Nightly price against stay total / nights: suspects and range, overall and per nights."""
    ratio = F.col(RATE) / (F.col("total_stay_usd") / F.col("nights"))
    rows = quotes.where((F.col(RATE) > 0) & (F.col("total_stay_usd") > 0)).select(ratio.alias("ratio"), F.explode(
        F.array(F.lit("all"), F.concat(F.lit("los_"), F.col("nights").cast("string")))).alias("stay"))
    return describe(rows, ["stay"], [
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ratio") > suspect_above).alias("n_suspect"),
        F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio")], {"median_ratio": "ratio"})


# ------------------------------------------------------------------ audits
def pick_audit(quotes: DataFrame, order, legacy="is_legacy_bar", room=ROOM) -> DataFrame:
    """Old posted-rate flag against the new pick, counted by channel (rooms as units).

    Stored rows carry no phrase, so labels decide refundability.
    """
    fits = plans.fits(fv.NON_REFUNDABLE, RATE, *FACTS)
    row = F.struct(F.col(RATE).alias("rate"), *[F.col(o) for o in order], F.trim(F.coalesce(LABEL, F.lit(""))).alias("label"))
    in_order = F.struct(*[F.col(o) for o in order], F.col(RATE).alias("rate"), F.trim(F.coalesce(LABEL, F.lit(""))).alias("label"))
    rooms = with_facts(quotes, None).groupBy(*room).agg(
        F.min(F.when(fits, row)).alias("new"), F.min(F.when(F.col(legacy), in_order)).alias("old"))
    old, new = F.col("old").isNotNull(), F.col("new").isNotNull()
    same = old & new & (F.col("old.label") == F.col("new.label")) & (F.col("old.rate") == F.col("new.rate"))
    counts = rooms.groupBy("channel").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(same).alias("agree"), F.count_if(old & new & ~same).alias("disagree"),
        F.count_if(old & ~new).alias("new_none"), F.count_if(~old).alias("no_legacy"),
        F.count_if(~old & ~new).alias("both_none"))
    return counts.withColumn("disagreement_rate", F.try_divide(
        F.col("disagree") + F.col("new_none"), F.col("total") - F.col("no_legacy")))


def pick_check(picks: DataFrame, expected: DataFrame, keys) -> DataFrame:
    """Picked labels against expected ones.

    `expected` has the keys, `expected_bar`, `expected_flex` and `flex_any`. A null
    expected flex label means that nothing may be picked, unless `flex_any` is set.
    """
    both = join_on(expected, picks, keys, "left")
    flex = case([
        (F.coalesce("flex_any", F.lit(False)), F.col("flex_label").isNotNull()),
        (F.col("expected_flex").isNull(), F.col("flex_label").isNull()),
    ], F.coalesce(F.col("flex_label") == F.col("expected_flex"), F.lit(False)))
    return both.withColumn("bar_match", F.coalesce(F.col("bar_label") == F.col("expected_bar"), F.lit(False))).withColumn(
        "flex_match", flex)


def unknown_refundability(quotes: DataFrame, cell=("property_id", "channel", "arrival_date", "nights")) -> DataFrame:
    return quotes.groupBy(*cell).agg(
        F.count_if(plans.refundability(PHRASE, LABEL) == fv.UNKNOWN).alias("n_unknown"), F.count(F.lit(1)).alias("n_plans"))


def recover_text(rows: DataFrame, booleans=(), numbers=()) -> DataFrame:
    """Typed columns from stored text: true/false words and numbers, anything else null."""
    return rows.withColumns({c: plans.true_text(c) for c in booleans} | {c: decimal(F.trim(c)) for c in numbers})

