"""Gates that reject captures which their own page does not support.

Every gate is a column over one capture, so the whole cascade is one projection.
Captures carry `expected_tokens` (array of name tokens of the property) beside the
capture columns. Reasons are short codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tariffa import fixed_values as fv
from tariffa.functions import pages, rooms
from tariffa.functions.text import case, identity, once, plain_money, strip, text
from tariffa.operators.captures import (
    CELL, capture_rooms, cell_sentinels, flatten, quote_rows, rewrite_tiers, room_plans, with_picks)


def implausible_reason(channel="channel", tokens=None) -> Column:
    """Code of the first plausibility rule that a capture breaks, else null."""
    tokens = tokens or pages.price_tokens("markdown", bare_when=F.col(channel) == "booking")
    found = capture_rooms()
    name = strip(text("extract.property_name"))
    arrival = strip(text("extract.arrival_date"))
    off = F.try_element_at(F.filter(F.transform(found, lambda r: r["rate_per_night_usd"]),
                                    lambda v: (v < fv.MIN_RATE) | (v > fv.MAX_RATE)), F.lit(1))
    low = F.size(F.filter(found, lambda r: r["rate_per_night_usd"] <= fv.PLACEHOLDER_CEILING))
    claimed = F.flatten(F.transform(found, lambda r: F.transform(room_plans(r), lambda p: p["rate_per_night_usd"])))
    return case([
        (name.rlike(fv.PLACEHOLDER_NAME), "placeholder_name"),
        (~pages.names_any(identity(name), F.col("expected_tokens")), "other_property"),
        ((arrival != "") & (arrival != F.date_format("arrival_date", "yyyy-MM-dd")), "other_date"),
        ((F.size(found) == 0) & (F.length(text("markdown")) > 500), "rooms_missed"),
        (F.coalesce(off < fv.MIN_RATE, F.lit(False)), "rate_below_floor"),
        (F.coalesce(off > fv.MAX_RATE, F.lit(False)), "rate_above_ceiling"),
        (low >= 3, "placeholder_rates"),
        (~pages.rates_supported(claimed, tokens, channel), "rates_not_on_page"),
    ])


def unanchored_rooms() -> Column:
    """Room names that are not in the page, word for word."""
    names = F.transform(capture_rooms(), lambda r: strip(text(r["marketing_name"])))
    return F.filter(names, lambda n: (n != "") & ~text("markdown").contains(n))


def room_anchor_fails() -> Column:
    """True when a named room is not in the page, or the page is empty and rooms are not."""
    return (F.size(capture_rooms()) > 0) & ((text("markdown") == "") | (F.size(unanchored_rooms()) > 0))


TOKENS = ("dollar_word", "bare", "dollar", "plus")


def with_tokens(captures: DataFrame) -> DataFrame:
    """Read the number tokens of every page once."""
    page = once(captures, _page=plain_money("markdown"))
    tokens = pages.price_tokens("markdown", F.col("_page"), F.col("channel") == "booking")
    return once(page, **{f"_t_{k}": tokens[k] for k in TOKENS}).drop("_page")


def anchor_check(captures: DataFrame, keep_tokens=False) -> DataFrame:
    """Add `anchor_fails` (picked prices that the page does not show) and `anchor_warnings`.

    Only the two picked plans of a room can fail the capture. Other plans whose price
    is not in the page are listed as warnings.
    """
    bound = with_tokens(with_picks(captures))
    t = {k: F.col(f"_t_{k}") for k in TOKENS}
    shown = lambda p: pages.price_supported(p["rate_per_night_usd"], p["rate_plan_label"], t)

    def one(x, field, kind):
        plan = F.try_element_at(room_plans(x["room"]), x[field] + 1)
        return F.when(x[field].isNotNull() & ~shown(plan), F.struct(
            F.lit(kind).alias("kind"), x["room"]["marketing_name"].alias("room"), plan["rate_per_night_usd"].alias("rate")))

    fails = F.array_compact(F.flatten(F.transform("picked", lambda x: F.array(
        one(x, "bar_idx", "BAR_NON_REF"), one(x, "flex_idx", "BAR_FLEX")))))

    def others(x):
        listed = F.transform(room_plans(x["room"]), lambda p, i: F.struct(
            i.alias("idx"), p["rate_per_night_usd"].alias("rate"), text(p["rate_plan_label"]).alias("label"),
            x["room"]["marketing_name"].alias("room"), shown(p).alias("shown")))
        return F.filter(listed, lambda p: (p["rate"] > 0) & ~p["shown"] & ~p["idx"].eqNullSafe(x["bar_idx"])
                        & ~p["idx"].eqNullSafe(x["flex_idx"]))

    warnings = F.transform(F.flatten(F.transform("picked", others)), lambda w: F.struct(
        w["room"].alias("room"), w["rate"].alias("rate"), w["label"].alias("label")))
    out = once(bound, anchor_fails=fails, anchor_warnings=warnings)
    return out.drop("picked") if keep_tokens else out.drop("picked", *[f"_t_{k}" for k in TOKENS])


def room_count(property_id, channel, subject_properties=(), expected=fv.EXPECTED_ROOMS, declared_on="hotels_com") -> Column:
    """struct(n_rooms, expected, is_short). Off for other properties and without an expected count.

    On one channel the page's own 'Showing X of Y rooms' replaces the configured count.
    """
    n = F.size(capture_rooms())
    configured = F.coalesce(case([(F.col(channel) == c, k) for c, k in expected], F.lit(None).cast("int")), F.lit(0))
    on = F.col(property_id).isin(*subject_properties) if subject_properties else F.lit(False)
    declared = F.when(F.col(channel) == declared_on, pages.declared_rooms("markdown"))
    wanted = F.when(~on | (configured <= 0), F.lit(0)).otherwise(F.coalesce(declared, configured))
    return F.struct(n.alias("n_rooms"), wanted.alias("expected"), (on & (configured > 0) & (n < wanted)).alias("is_short"))


def thin_render(channel="channel", expected=fv.EXPECTED_ROOMS, thin_on="hotels_com") -> Column:
    """Why a capture looks half rendered on one channel, else null."""
    sizes = F.transform(capture_rooms(), lambda r: F.size(room_plans(r)))
    most, least = F.coalesce(F.array_max(sizes), F.lit(0)), F.coalesce(F.array_min(sizes), F.lit(0))
    configured = F.coalesce(case([(F.col(channel) == c, k) for c, k in expected], F.lit(None).cast("int")), F.lit(0))
    wanted = F.coalesce(pages.declared_rooms("markdown"), configured)
    few = (wanted > 0) & (F.size(sizes) < wanted) & (least < 2)
    return F.when((F.col(channel) == thin_on) & ((most < 2) | few), case([
        ((most < 2) & few, "no_room_expanded;rooms_short"), (most < 2, "no_room_expanded")], "rooms_short"))


def simple_gate(captures: DataFrame) -> DataFrame:
    """blocked, missing extract, implausible or ok, with the reason."""
    sig, why = pages.block_signature("markdown"), implausible_reason()
    no_extract = F.col("extract").isNull()
    judged = once(captures, _sig=sig, _why=why)
    sig, why = F.col("_sig"), F.col("_why")
    return judged.withColumns({
        "status": case([(sig.isNotNull(), "bot_blocked"), (no_extract | why.isNotNull(), "extract_failed")], "ok"),
        "reason": case([(sig.isNotNull(), sig), (no_extract, "no_extract")], F.coalesce(why, F.lit(""))),
    }).drop("_sig", "_why")


def gate(captures: DataFrame, subject_properties=(), chain_markers=(), expected=fv.EXPECTED_ROOMS, api_channel=None,
         detailed_properties=(), skus=fv.ROOM_SKUS) -> DataFrame:
    """Final status, reason and what to keep of each capture (`rows`, `sentinel`, `none`).

    The gates run in a fixed order and the first one that fails decides. Captures of
    `api_channel` come from a reservation system: they have no page, and fewer rooms
    than expected means that the rest is sold.
    """
    api = (F.col("channel") == api_channel) if api_channel else F.lit(False)
    subject = F.col("property_id").isin(*subject_properties) if subject_properties else F.lit(False)
    detailed = F.col("property_id").isin(*detailed_properties) if detailed_properties else F.lit(False)
    chain = (pages.is_chain_page("markdown", chain_markers) if chain_markers else F.lit(False)) & ~api
    names = F.transform(capture_rooms(), lambda r: text(r["marketing_name"]))
    unmapped = F.filter(names, lambda n: (strip(n) != "") & rooms.sku(n, skus).isNull())
    missed = F.when(detailed & ~api, rooms.missing_patterns("markdown", names)).otherwise(F.array().cast("array<string>"))

    judged = once(
        anchor_check(captures, keep_tokens=True), missed=missed, _unmapped=F.size(unmapped),
        _count=room_count("property_id", "channel", subject_properties, expected),
        _sig=F.when(~api, pages.block_signature("markdown")), _why=F.when(~api, implausible_reason(tokens={k: F.col(f"_t_{k}") for k in TOKENS})),
        _off_page=room_anchor_fails(),
        _empty=F.when(F.size(capture_rooms()) == 0, pages.empty_page_class("markdown", "expected_tokens")))
    no_extract = F.col("extract").isNull()
    no_rooms = F.size(capture_rooms()) == 0
    short = F.col("_count.is_short")
    steps = [
        (chain, "FAIL_CHAIN_PAGE_SOFT", F.lit("chain_page")),
        (F.col("_sig").isNotNull(), "bot_blocked", F.col("_sig")),
        (no_extract, "extract_failed", F.lit("no_extract")),
        (no_rooms & api, "no_inventory", F.lit("no_prices")),
        (no_rooms & (F.col("_empty") == "PASS_NO_INVENTORY"), "no_inventory", F.lit("page_says_no_inventory")),
        (no_rooms & (F.col("_empty") == "FAIL_URL_BROKEN"), "FAIL_URL_BROKEN", F.lit("broken_or_other_page")),
        (F.col("_why").isNotNull(), "extract_failed", F.col("_why")),
        (F.col("_off_page") & ~api, "extract_failed", F.lit("room_not_on_page")),
        (short & ~api, "FAIL_ROOM_COUNT_SHORT", F.lit("rooms_short")),
        (subject & (F.col("_unmapped") > 0), "FAIL_UNKNOWN_ROOM_TYPE", F.lit("unmapped_room")),
        ((F.size("anchor_fails") > 0) & ~api, "extract_failed", F.lit("pick_not_on_page")),
        (short, "compression_short", F.lit("rooms_sold")),
        (F.size("missed") > 0, "extract_incomplete", F.lit("patterns_missed")),
    ]
    status = case([(c, s) for c, s, _ in steps], "ok")
    reason = case([(c, r) for c, _, r in steps], "")
    keep = case([
        (F.col("status").isin("no_inventory", "FAIL_ROOM_COUNT_SHORT"), "sentinel"),
        (F.col("status").isin("ok", "extract_incomplete", "compression_short"), "rows")], "none")
    return once(judged, status=status, reason=reason).withColumn("keep", keep).drop(
        "_count", "_sig", "_why", "_empty", "_off_page", "_unmapped", *[f"_t_{k}" for k in TOKENS])


def capture_rows(captures: DataFrame, tier_channel=None, chain_markers=(), sku_properties=(), detailed_properties=(), **settings) -> DataFrame:
    """Stored quote rows of captures, in the order of a run.

    Pages of `tier_channel` that are not chain pages get their plans from the cancellation
    tiers in the text, then all gates decide; kept captures are flattened, and cells that end
    without rates on purpose give one sentinel row. `upsert` takes the rows as a batch.
    """
    if tier_channel:
        wanted = F.col("channel") == tier_channel
        if chain_markers:
            wanted = wanted & ~pages.is_chain_page("markdown", chain_markers)
        captures = rewrite_tiers(captures, wanted)
    gated = gate(captures, chain_markers=chain_markers, detailed_properties=detailed_properties, **settings)
    kept = quote_rows(flatten(gated.where(F.col("keep") == "rows"), sku_properties, detailed_properties))
    return kept.unionByName(cell_sentinels(gated))


def denied_cells(cells: DataFrame, deny) -> DataFrame:
    """Cells without the denied (property or None for any, channel, except properties) rules.

    The rules are literals of fixed number.
    """
    rules = F.lit(False)
    for prop, channel, spared in deny:
        hit = F.col("channel") == channel
        if prop is not None:
            hit = hit & (F.col("property_id") == prop)
        if spared:
            hit = hit & ~F.col("property_id").isin(*spared)
        rules = rules | hit
    return cells.where(~rules)


def smoke_summary(captures: DataFrame, expected_rooms: int) -> DataFrame:
    """Per capture: status, rooms, the first five rates and notes."""
    n = F.size(capture_rooms())
    sig, empty = pages.block_signature("markdown"), pages.empty_page_class("markdown", "expected_tokens")
    why = F.when(n > 0, implausible_reason())
    judged = once(captures, _sig=sig, _empty=empty, _why=why)
    sig, empty, why = F.col("_sig"), F.col("_empty"), F.col("_why")
    status = case([
        (sig.isNotNull(), "bot_blocked"), ((n == 0) & (empty == "PASS_NO_INVENTORY"), "no_inventory"),
        (n == 0, "url_broken"), (n < expected_rooms, "extraction_incomplete")], "ok")
    notes = F.array_compact(F.array(
        sig, F.when((n == 0) & sig.isNull(), F.coalesce(empty, F.lit("no_signal"))), F.when(sig.isNull(), why),
        F.when((n > 0) & (n < expected_rooms) & sig.isNull(), F.lit("rooms_short"))))
    first = F.slice(F.transform(capture_rooms(), lambda r: F.struct(
        r["marketing_name"].alias("marketing_name"), r["rate_per_night_usd"].alias("rate_per_night_usd"))), 1, 5)
    shown = sig.isNull()
    return judged.select(
        *CELL, status.alias("status"), F.when(shown, n).otherwise(0).alias("n_rooms"),
        F.when(shown, first).otherwise(F.slice(first, 1, 0)).alias("sample_rates"), notes.alias("notes"))
