"""Column expressions on page text: signatures, price tokens, promo copy, declared counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tariffa import fixed_values as fv
from tariffa.functions.text import any_of, bind, case, col, contains_any, first_contained, identity, once, plain_money, strip, text, to_int


def block_signature(markdown) -> Column:
    """The first block-page signature found in the page, else null."""
    return bind(F.lower(text(markdown)), lambda low: first_contained(low, fv.BLOCK_SIGNATURES))


def names_any(haystack: Column, tokens: Column) -> Column:
    """Does a normalized text hold one of the expected tokens? True without tokens."""
    wanted = F.transform(F.filter(tokens, lambda t: F.coalesce(t, F.lit("")) != ""), identity)
    return F.coalesce((F.size(wanted) == 0) | F.exists(wanted, lambda t: haystack.contains(t)), F.lit(True))


def empty_page_class(markdown, tokens) -> Column:
    """Why a page gave no rooms: broken page, no inventory, or null when it does not say.

    Broken words win. 'No inventory' only counts on a page that names the property.
    """
    return bind(identity(markdown), lambda page: case([
        (page == "", F.lit(None).cast("string")),
        (contains_any(page, fv.BROKEN_PAGE_SIGNATURES), "FAIL_URL_BROKEN"),
        (contains_any(page, fv.NO_INVENTORY_SIGNATURES),
         F.when(names_any(page, col(tokens)), "PASS_NO_INVENTORY").otherwise("FAIL_URL_BROKEN")),
    ], F.lit(None).cast("string")))


def cell_verdict(block, http_status, cell_status, empty_class, rows_extracted, expected_present) -> Column:
    """Verdict of one observed cell; the most specific evidence comes first."""
    http, n = col(http_status), F.coalesce(col(rows_extracted), F.lit(0))
    no = F.coalesce(col(empty_class) == "PASS_NO_INVENTORY", F.lit(False)) | ~F.coalesce(col(expected_present), F.lit(True))
    return case([
        (text(block) != "", "FAIL_URL_BROKEN"),
        (http.isin(404, 410) | http.between(500, 599), "FAIL_URL_BROKEN"),
        (F.lower(text(cell_status)).isin(*fv.BLOCKED_CELL_WORDS), "FAIL_URL_BROKEN"),
        (col(empty_class) == "FAIL_URL_BROKEN", "FAIL_URL_BROKEN"),
        ((n == 0) & no, "PASS_NO_INVENTORY"),
        (n > 0, "PASS"),
    ], "NO_DATA")


# ------------------------------------------------------------------ price tokens
def _tokens(page: Column, pattern: str) -> Column:
    return F.regexp_extract_all(page, F.lit(pattern), F.lit(1))


def price_tokens(markdown, page=None, bare_when=None) -> dict:
    """Arrays of the number tokens of a page, after thousands commas are dropped.

    `dollar_word`: $n up to a word end. `bare`: n without a $ (only read where
    `bare_when` holds). `dollar`: $n up to the last digit. `plus`: n of a `+ $n` add-on.
    """
    page = plain_money(markdown) if page is None else page
    bare = _tokens(page, r"(?<!\$)\b(\d+)\b")
    return {
        "dollar_word": _tokens(page, r"\$(\d+)\b"), "bare": bare if bare_when is None else F.when(bare_when, bare),
        "dollar": _tokens(page, r"\$(\d+)"), "plus": _tokens(page, r"\+\s*\$(\d+)"),
    }


def whole(rate: Column) -> Column:
    """Whole dollars as the digits a page would show."""
    return rate.try_cast("bigint").cast("string")


def rates_supported(rates: Column, tokens: dict, channel, bare_channel="booking") -> Column:
    """Is at least one claimed price printed on the page? True when none is claimed.

    One channel prints prices without a dollar sign: there a bare number counts too,
    unless it looks like a year or lies outside 100..9999.
    """
    claimed = F.array_distinct(F.transform(F.filter(rates, lambda r: r > 0), whole))
    plain = F.filter(claimed, lambda v: v.cast("bigint").between(100, 9999) & ~v.isin(*map(str, fv.YEAR_TOKENS)))
    found = F.arrays_overlap(claimed, tokens["dollar_word"]) | (
        (col(channel) == bare_channel) & F.arrays_overlap(plain, tokens["bare"]))
    return F.coalesce((F.size(claimed) == 0) | found, F.lit(True))


def price_supported(rate: Column, label: Column, tokens: dict) -> Column:
    """Is one picked price printed as $n, or as base plus the add-on its label names?"""
    n = rate.try_cast("bigint")
    extra = F.regexp_extract(text(label), r"\+\s*\$(\d+)", 1)
    base = n - extra.try_cast("bigint")
    by_parts = (base > 0) & F.array_contains(tokens["dollar"], base.cast("string")) & F.array_contains(
        tokens["plus"], extra.try_cast("bigint").cast("string"))
    return F.coalesce((n > 0) & (F.array_contains(tokens["dollar"], n.cast("string")) | F.coalesce(by_parts, F.lit(False))),
                      F.lit(False))


# ------------------------------------------------------------------ promo copy
def with_promo(df: DataFrame, markdown="markdown", name="promo") -> DataFrame:
    """Add the struct of posted promo, its percent, weekly copy, member gate and fenced offer.

    All patterns are tried; the best kind wins, whatever comes first in the text. Card
    and member offers are kept apart from the posted promo. A pattern only runs on
    pages that hold a word every match needs.
    """
    page, low = F.col(markdown), F.col("_low")

    def hit(pattern, hints, group=0):
        found = F.nullif(strip(F.regexp_extract(page, "(?iU)" + pattern, group)), F.lit(""))
        return F.when(contains_any(low, hints), found)

    hits = {f"_hit{i}": hit(p, h) for i, (_, p, _, h) in enumerate(fv.PROMO_PATTERNS)}
    read = once(once(df, _low=F.lower(page)), **hits)
    percent = lambda i, p, g: F.when(
        F.col(f"_hit{i}").isNotNull(), F.regexp_extract(F.col(f"_hit{i}"), "(?iU)" + p, g)).try_cast("double")
    pct = {i: percent(i, p, g) if g else F.lit(None).cast("double") for i, (_, p, g, _) in enumerate(fv.PROMO_PATTERNS)}
    order = [i for kind in fv.POSTED_PROMO_KINDS for i, row in enumerate(fv.PROMO_PATTERNS) if row[0] == kind]
    fenced = [i for i, row in enumerate(fv.PROMO_PATTERNS) if row[0] in fv.FENCED_PROMO_KINDS]
    gate = contains_any(low, fv.MEMBER_GATE_HINTS) & page.rlike("(?iU)" + fv.MEMBER_GATE)
    out = F.struct(
        F.coalesce(*[F.col(f"_hit{i}") for i in order]).alias("promo_banner_text"),
        case([(F.col(f"_hit{i}").isNotNull(), pct[i]) for i in order],
             F.lit(None).cast("double")).alias("promo_banner_pct"),
        hit(fv.WEEKLY_DISCLOSURE, [fv.WEEKLY_DISCLOSURE_HINT]).alias("weekly_rate_disclosure"),
        F.when(gate, F.lit(True)).alias("member_rate_gated"),
        F.coalesce(*[F.col(f"_hit{i}") for i in fenced]).alias("member_or_card_offer_text"),
    )
    return once(read, **{name: out}).drop("_low", *hits)


def declared_rooms(markdown) -> Column:
    """Y of 'Showing X of Y rooms', else null."""
    return F.regexp_extract(text(markdown), fv.DECLARED_ROOMS, 2).try_cast("int")


def is_chain_page(markdown, markers) -> Column:
    """A page that lists several properties: every marker is on it."""
    return ~any_of(~text(markdown).contains(m) for m in markers)


# ------------------------------------------------------------------ room blocks
def room_block(markdown, name: Column) -> Column:
    """The part of the page under the room's own heading, else null."""
    squeeze = lambda c: strip(F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " "))
    title = lambda part: strip(F.regexp_extract(part, r"(?d)^###\s+(.+)", 1))
    parts = F.filter(F.split(text(markdown), r"(?md)^(?=###\s+.)"), lambda p: (
        (title(p) != "") & ~F.lower(title(p)).startswith(fv.PHOTO_HEADING) & (squeeze(title(p)) == squeeze(name))))
    body = F.split(F.try_element_at(parts, F.lit(1)), fv.BLOCK_END)
    return F.when(strip(text(name)) != "", F.try_element_at(body, F.lit(1)))


def block_tiers(block: Column) -> Column:
    """array<struct(refund_label, add_on_usd, pay_timing)> of the block's cancellation rows."""
    part = lambda g: F.regexp_extract_all(block, F.lit(fv.TIER_ROW), F.lit(g))
    rows = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))
    return F.coalesce(F.transform(rows, lambda r: F.struct(
        strip(r["a"]).alias("refund_label"), to_int(r["b"]).alias("add_on_usd"),
        F.when(F.lower(r["c"]).contains("deposit"), "deposit").otherwise("later").alias("pay_timing"))),
        F.array().cast("array<struct<refund_label:string,add_on_usd:int,pay_timing:string>>"))


def block_lead_in(block: Column, nights: Column) -> Column:
    """Nightly anchor price of a block: '$N nightly', else stay total over nights, rounded down."""
    nightly = to_int(F.regexp_extract(block, fv.LEAD_IN_NIGHTLY, 1))
    total = to_int(F.regexp_extract(block, fv.STAY_TOTAL, 1))
    return F.coalesce(nightly, F.when(nights > 0, F.floor(total / nights).cast("int")))
