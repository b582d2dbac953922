"""Nested captures to quote rows.

All steps on one capture are array expressions inside its row: picking, gates and tier
rewriting need no shuffle, and a capture is flattened in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tariffa import fixed_values as fv
from tariffa.functions import pages, plans, rooms
from tariffa.functions.text import case, once, strip, text
from tariffa.schemas import PLAN, QUOTES, conform

CELL = ("property_id", "channel", "arrival_date", "nights")


def capture_rooms() -> Column:
    """The rooms of a capture without null entries; an absent list is empty."""
    return F.filter(F.coalesce(F.col("extract.rooms"), F.array()), lambda r: r.isNotNull())


def room_plans(room: Column) -> Column:
    return F.coalesce(room["rate_plans"], F.array())


def plan_facts(p: Column):
    """State, inclusions and fence of one plan."""
    return (plans.refundability(p["cancellation_phrase"], p["rate_plan_label"]), plans.bundle(p["rate_plan_label"]),
            plans.is_fenced(p["rate_plan_label"], p["is_genius_member_rate"]))


def _candidates(plan_array: Column) -> Column:
    """State, price and position of every plan that may be picked."""
    def one(p, i):
        state, inside, fenced = plan_facts(p)
        fits = plans.has_rate(p["rate_per_night_usd"]) & ~fenced & plans.is_bare(inside)
        return F.struct(F.when(fits, state).alias("state"), p["rate_per_night_usd"].alias("rate"), i.alias("idx"))

    return F.filter(F.transform(plan_array, one), lambda c: c["state"].isin(fv.NON_REFUNDABLE, fv.REFUNDABLE))


def with_picks(captures: DataFrame) -> DataFrame:
    """Add `picked`: every room with the positions of its two picked plans.

    The lowest price wins, the first plan on ties.
    """
    found = F.transform(capture_rooms(), lambda r: F.struct(r.alias("room"), _candidates(room_plans(r)).alias("c")))
    lowest = lambda x, state: F.array_min(F.transform(
        F.filter(x["c"], lambda c: c["state"] == state), lambda c: F.struct(c["rate"], c["idx"])))["idx"]
    return once(captures, picked=F.transform(found, lambda x: F.struct(
        x["room"].alias("room"), lowest(x, fv.NON_REFUNDABLE).alias("bar_idx"), lowest(x, fv.REFUNDABLE).alias("flex_idx"))))


def flatten_plans(captures: DataFrame, keep=CELL) -> DataFrame:
    """One row per room and rate plan, with both positions; a room without plans gives no row."""
    per_room = captures.select(*keep, F.posexplode(capture_rooms()).alias("room_idx", "room"))
    return per_room.select(*keep, "room_idx", F.col("room.marketing_name").alias("marketing_name"),
                           F.posexplode("room.rate_plans").alias("plan_idx", "plan")).select(
        *keep, "room_idx", "plan_idx", "marketing_name", "plan.*")


def _row(plan_idx, label, rate, total, flag, member, breakfast, confidence, available, is_bar, status, bucket,
         strike, strike_pct, inside) -> Column:
    fields = dict(
        plan_idx=(plan_idx, "int"), rate_plan_label=(label, "string"), rate_per_night_usd=(rate, "double"),
        total_stay_usd=(total, "double"), refundable=(flag, "boolean"), is_genius_member_rate=(member, "boolean"),
        includes_breakfast=(breakfast, "boolean"), rate_plan_confidence=(confidence, "string"),
        availability_status=(available, "string"), is_bar=(is_bar, "boolean"), status=(status, "string"),
        rate_plan_canonical=(bucket, "string"), strikethrough_orig_rate=(strike, "double"),
        strikethrough_pct=(strike_pct, "double"), bundle_inclusions=(inside, "string"))
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).cast(t).alias(n) for n, (c, t) in fields.items()])


def _plan_row(p: Column, i: Column, picked: Column, incomplete: Column) -> Column:
    is_bar = F.coalesce(i == picked["bar_idx"], F.lit(False))
    is_flex = F.coalesce(i == picked["flex_idx"], F.lit(False))
    return _row(
        i, text(p["rate_plan_label"]), p["rate_per_night_usd"], p["total_stay_usd"],
        plans.refundable_flag(p["cancellation_phrase"], p["refundable"]), p["is_genius_member_rate"],
        p["includes_breakfast"], text(p["rate_plan_confidence"]),
        F.coalesce(F.nullif(p["availability_status"], F.lit("")), F.lit("unknown")), is_bar,
        case([(incomplete, "extract_incomplete"), (is_bar, "ok")], "non_bar_rate"),
        case([(is_bar, "BAR_NON_REF"), (is_flex, "BAR_FLEX")], plans.bucket(p["rate_per_night_usd"], *plan_facts(p))),
        p["strikethrough_orig_rate"], plans.strikethrough_share(p["strikethrough_orig_rate"], p["rate_per_night_usd"]),
        plans.bundle(p["rate_plan_label"]))


def _empty_row(status: Column, available: Column = None) -> Column:
    none = F.lit(None)
    return _row(none, "", none, none, none, none, none, "", F.lit("unknown") if available is None else available,
                False, status, status, none, none, none)


def flatten(captures: DataFrame, sku_properties=(), detailed_properties=(), skus=fv.ROOM_SKUS) -> DataFrame:
    """Quote rows of kept captures: plan rows, then a sentinel row for each missing pick.

    `missed` (array of labels) on the input marks the rows of incomplete captures.
    """
    incomplete = F.size("missed") > 0
    failed = lambda x: F.array_compact(F.array(
        F.when(x["bar_idx"].isNull(), F.lit("FAIL_NO_BARE_NON_REF")), F.when(x["flex_idx"].isNull(), F.lit("FAIL_NO_BAR_FLEX"))))
    per_room = pages.with_promo(with_picks(captures)).select("*", F.posexplode("picked").alias("room_idx", "pick"))
    rows = per_room.withColumn("lines", F.concat(
        F.transform(room_plans(F.col("pick.room")), lambda p, i: _plan_row(p, i, F.col("pick"), incomplete)),
        F.transform(failed(F.col("pick")), _empty_row)))
    name = F.col("pick.room.marketing_name")
    sku = F.when(F.col("property_id").isin(*sku_properties), rooms.sku(name, skus)) if sku_properties else F.lit(None)
    flat = once(rows, cls=rooms.classify_room(name, "property_id", detailed_properties)).select(
        *CELL, "room_idx", text("extract.property_name").alias("scraped_property_name"),
        text(name).alias("scraped_marketing_name"), text("pick.room.sub_description").alias("sub_description"),
        text("pick.room.bed_config").alias("bed_config"), F.col("pick.room.occupancy_max").alias("occupancy_max"),
        F.array_join("missed", ",").alias("missed_patterns"), F.col("captured_at").alias("scrape_timestamp_utc"),
        "source_url", sku.cast("string").alias("room_type_canonical"),
        "cls", "promo", F.inline("lines"))
    return flat.select("*", "cls.*", "promo.*").drop("cls", "promo")


def quote_rows(flat: DataFrame) -> DataFrame:
    """The stored columns of flattened rows."""
    return conform(flat, QUOTES)


def cell_sentinels(gated: DataFrame) -> DataFrame:
    """One row per cell that ends without rates on purpose: no inventory, or too few rooms."""
    kept = pages.with_promo(gated.where(F.col("keep") == "sentinel"))
    no_rooms = F.col("status") == "no_inventory"
    row = _empty_row(F.col("status"), F.when(no_rooms, F.col("status")).otherwise("unknown"))
    return conform(kept.select(
        *CELL, F.lit("").alias("scraped_property_name"), F.lit("").alias("scraped_marketing_name"),
        F.lit("").alias("sub_description"), F.lit("").alias("bed_config"),
        F.lit("").alias("mapped_internal_code"), F.lit("").alias("mapped_tier"), F.lit("").alias("mapped_view"),
        F.lit("").alias("mapping_source"), F.col("reason").alias("missed_patterns"),
        F.col("captured_at").alias("scrape_timestamp_utc"), "source_url", "promo.*", row.alias("line"),
    ).select("*", "line.*").drop("line").withColumn(
        "rate_plan_canonical", F.when(F.col("status") == "no_inventory", "NO_INVENTORY").otherwise(F.col("status"))), QUOTES)


def picker_failures(flat: DataFrame) -> DataFrame:
    """Rooms without a pick: kind, name and SKU per cell."""
    return flat.where(F.col("status").isin(*fv.PICK_SENTINELS)).select(
        *CELL, F.col("status").alias("kind"), F.col("scraped_marketing_name").alias("marketing_name"),
        F.col("room_type_canonical").alias("room_canonical"))


def unmapped_names(captures: DataFrame, skus=fv.ROOM_SKUS, keep=CELL) -> DataFrame:
    """Distinct trimmed room names of each cell that have no SKU."""
    names = F.transform(capture_rooms(), lambda r: strip(text(r["marketing_name"])))
    unknown = F.array_distinct(F.filter(names, lambda n: (n != "") & rooms.sku(n, skus).isNull()))
    return captures.select(*keep, unknown.alias("unmapped"))


def render_class(captures: DataFrame, keep=CELL) -> DataFrame:
    """Fewest plans of any room, named ok from 3 on and thin below."""
    least = F.coalesce(F.array_min(F.transform(capture_rooms(), lambda r: F.size(room_plans(r)))), F.lit(0))
    return captures.select(*keep, F.concat(
        F.when(least >= 3, "ok_min_").otherwise("thin_min_"), least.cast("string")).alias("render"))


# ------------------------------------------------------------------ tiers from page text
def rewrite_tiers(captures: DataFrame, only: Column = None) -> DataFrame:
    """Replace the plans of every room whose text block shows its cancellation tiers.

    With `only`, the pages of other captures are not read and their rooms stay as they are. Adds `tiers`: per room the number of tiers, the anchor price and why the room was
    left as it is.
    """
    nights = F.greatest(F.coalesce(F.col("extract.nights"), F.lit(1)), F.lit(1))
    found = F.transform(capture_rooms(), lambda r: F.struct(
        r.alias("room"), (lambda b: b if only is None else F.when(only, b))(pages.room_block(F.col("markdown"), r["marketing_name"])).alias("block")))
    read = F.transform(found, lambda x: F.struct(
        x["room"].alias("room"), x["block"].isNotNull().alias("has_block"),
        pages.block_tiers(x["block"]).alias("tiers"),
        pages.block_lead_in(x["block"], F.coalesce(F.col("extract.nights"), F.lit(1))).alias("lead_in")))

    def plan(t, lead):
        nightly = (lead + t["add_on_usd"]).cast("double")
        return F.struct(
            F.concat(t["refund_label"], F.lit(" + $"), t["add_on_usd"].cast("string"), F.lit(" (pay "), t["pay_timing"],
                     F.lit(")")).alias("rate_plan_label"),
            nightly.alias("rate_per_night_usd"), (nightly * nights).alias("total_stay_usd"),
            F.lower(t["refund_label"]).startswith("fully refundable").alias("refundable"),
            F.lit(False).alias("is_genius_member_rate"), F.lit(False).alias("includes_breakfast"),
            F.lit("high").alias("rate_plan_confidence"), F.lit("available").alias("availability_status"),
            t["refund_label"].alias("cancellation_phrase"), F.lit(None).cast("double").alias("strikethrough_orig_rate"),
        ).cast(PLAN)

    reason = lambda x: case([
        (~x["has_block"], "no_room_block"), (F.size(x["tiers"]) == 0, "no_tiers_in_block"),
        (x["lead_in"].isNull(), "no_lead_in_anchor")])
    new_rooms = F.transform("_read", lambda x: F.when(reason(x).isNull(), x["room"].withField(
        "rate_plans", F.transform(x["tiers"], lambda t: plan(t, x["lead_in"])))).otherwise(x["room"]))
    return once(captures, _read=read).withColumns({
        "extract": F.when(F.col("extract").isNotNull(), F.col("extract").withField("rooms", new_rooms)),
        "tiers": F.transform("_read", lambda x: F.struct(
            x["room"]["marketing_name"].alias("marketing_name"), F.size(x["tiers"]).alias("n_tiers"),
            F.when(reason(x).isNull(), x["lead_in"]).alias("lead_in"), reason(x).alias("skip_reason"))),
    }).drop("_read")


def tier_outcomes(rewritten: DataFrame) -> DataFrame:
    """Rooms and tiers per outcome."""
    return rewritten.select(F.inline("tiers")).groupBy(F.coalesce("skip_reason", F.lit("replaced")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_rooms"), F.sum("n_tiers").alias("n_tiers"))


# ------------------------------------------------------------------ reservation system
def crs_plans(responses: DataFrame, keep=("property_id", "arrival_date", "nights")) -> DataFrame:
    """Bookable prices of reservation-system responses, one row per room and rate.

    Both availability lists count. Unavailable entries, entries without a room or rate
    code and entries without a price are left out. Names come from the response's own
    lists, by code.
    """
    prices = F.flatten(F.transform(
        F.concat(*[F.coalesce(F.col(c), F.array()) for c in ("ProductAvailabilityDetail", "ProductAvailabilityList")]),
        lambda d: F.coalesce(d["Prices"], F.array())))
    by_code = lambda items, code: F.try_element_at(F.filter(items, lambda x: x["Code"] == code), F.lit(-1))
    filled = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    rows = responses.select(
        *keep, F.col("ContentLists.RoomList").alias("_rooms"), F.col("ContentLists.RateList").alias("_rates"),
        F.explode(prices).alias("p")).select(
        *keep, "_rooms", "_rates", "p.Available", F.nullif("p.Product.Room.Code", F.lit("")).alias("room_code"),
        F.nullif("p.Product.Rate.Code", F.lit("")).alias("rate_code"),
        plans.nightly_from_stay(F.col("p.Product.Prices.Total.Price.Total.AmountWithFees"),
                                F.col("p.Product.Prices.PerNight.Price.Total.Amount"), "nights").alias("price"),
    ).where("coalesce(Available, true) and room_code is not null and rate_code is not null and price.total_stay_usd is not null")
    named = rows.withColumn("_room", by_code(F.col("_rooms"), F.col("room_code"))).withColumn(
        "_rate", by_code(F.col("_rates"), F.col("rate_code")))
    rate = F.col("_rate")
    label = filled(rate["Name"], rate["Details"]["DisplayName"], rate["Details"]["Description"], F.col("rate_code"))
    return named.withColumn("rate_plan_label", label).withColumn("_policy", plans.crs_refundability(
        rate["CategoryCode"], F.col("rate_plan_label"), rate["Details"]["Description"], rate["Details"]["DetailedDescription"])).select(
        *keep, "room_code", "rate_code",
        filled(F.col("_room.Name"), F.col("_room.Details.Description"), F.col("room_code")).alias("marketing_name"),
        "rate_plan_label", "price.rate_per_night_usd", "price.total_stay_usd", "_policy.refundable",
        text("_policy.cancellation_phrase").alias("cancellation_phrase"),
        F.when(F.coalesce("Available", F.lit(False)), "available").otherwise("sold_out").alias("availability_status"))


# ------------------------------------------------------------------ hand-entered captures
def hand_entered(entries: DataFrame, url_template: str, no_room_note="fully sold out", skus=fv.ROOM_SKUS) -> DataFrame:
    """Quote rows of a hand-kept price list; a date without a room name is a sold-out date."""
    out = F.col("marketing_name").isNull()
    rows = entries.withColumn("cls", rooms.classify_room("marketing_name", "property_id")).withColumn(
        "source_url", dated_url(F.lit(url_template), "arrival_date", "nights"))
    pick = lambda a, b: F.when(out, b).otherwise(a)
    none = F.lit(None)
    cls = {f"mapped_{c}": pick(F.col(f"cls.mapped_{c}"), F.lit("") if c in ("internal_code", "tier", "view") else none)
           for c in ("internal_code", "tier", "view", "bedrooms", "ada")}
    return conform(rows.withColumns({
        "scraped_marketing_name": pick(F.col("marketing_name"), F.lit("")),
        "rate_plan_label": pick(F.lit("Standard Rate"), F.lit("")), "rate_per_night_usd": pick(F.col("rate_usd"), none),
        "total_stay_usd": pick(F.col("rate_usd") * F.col("nights"), none), "refundable": pick(F.lit(True), none),
        "is_genius_member_rate": pick(F.lit(False), none), "is_bar": ~out,
        "rate_plan_confidence": pick(F.lit("manual_chrome"), F.lit("")),
        "availability_status": pick(F.lit("available"), F.lit("no_inventory")),
        "mapping_source": pick(F.col("cls.mapping_source"), F.lit("")), "status": pick(F.lit("ok"), F.lit("no_inventory")),
        "missed_patterns": pick(F.lit(""), F.lit(no_room_note)),
        "room_type_canonical": pick(rooms.sku("marketing_name", skus), none),
        "rate_plan_canonical": pick(F.lit("BAR_FLEX"), F.lit("NO_INVENTORY")),
        "penthouse_variant": pick(F.col("cls.penthouse_variant"), none), **cls}), QUOTES)


def dated_url(template: Column, arrival, nights) -> Column:
    """Fill the date tokens of a page address for a stay."""
    arrive = F.col(arrival)
    depart = F.date_add(arrive, F.col(nights))
    url = template
    for name, day in (("arrive", arrive), ("depart", depart)):
        for token, fmt in ((name, "yyyy-MM-dd"), (f"{name}_day", "dd"), (f"{name}_mmyyyy", "MMyyyy"), (f"{name}_mdy", "MM/dd/yyyy")):
            url = F.replace(url, F.lit("{" + token + "}"), F.date_format(day, fmt))
    return url
