"""Column expressions on one rate plan: refundability, bundles, buckets, promo math."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tariffa import fixed_values as fv
from tariffa.functions.text import case, col, contains_any, strip, text


def refundability(phrase, label) -> Column:
    """REFUNDABLE, NON_REFUNDABLE or UNKNOWN. The phrase speaks before the label."""
    p, l = F.lower(text(phrase)), F.lower(text(label))
    return case([
        (contains_any(p, fv.NON_REFUNDABLE_PHRASES), fv.NON_REFUNDABLE),
        (contains_any(p, fv.REFUNDABLE_PHRASES), fv.REFUNDABLE),
        (contains_any(l, fv.NON_REFUNDABLE_LABELS), fv.NON_REFUNDABLE),
        (contains_any(l, fv.REFUNDABLE_LABELS), fv.REFUNDABLE),
    ], fv.UNKNOWN)


def refundable_flag(phrase, flag) -> Column:
    """The flag as the phrase says; the captured flag when the phrase is silent."""
    p = F.lower(text(phrase))
    return case([
        (contains_any(p, fv.FLAG_OFF_PHRASES), False),
        (contains_any(p, fv.REFUNDABLE_PHRASES), True),
    ], col(flag))


def bundle(label) -> Column:
    """Sorted comma list of inclusions named in the label, null when there are none.

    A pattern only runs on labels that hold its bare word.
    """
    low = F.lower(text(label))
    names = [
        F.when(contains_any(low, hints) & low.rlike(fv.BUNDLE_ANCHOR + word), F.lit(name))
        for word, name, hints in sorted(fv.BUNDLE_WORDS, key=lambda w: w[1])
    ]
    return F.nullif(F.concat_ws(",", *names), F.lit(""))


def is_bare(bundles) -> Column:
    return strip(text(bundles)) == ""


def is_fenced(label, member_flag) -> Column:
    """Member, card or loyalty offers never stand for the posted rate."""
    return F.coalesce(col(member_flag), F.lit(False)) | contains_any(F.lower(text(label)), fv.MEMBER_OR_CARD_LABELS)


def has_rate(rate) -> Column:
    return F.coalesce(col(rate) > 0, F.lit(False)) & ~F.isnan(col(rate).cast("double"))


def fits(wanted: str, rate, state, inside, fenced) -> Column:
    """Can a plan be picked for `wanted`, given its state, inclusions and fence?"""
    return has_rate(rate) & is_bare(inside) & (col(state) == wanted) & ~col(fenced)


def bucket(rate, state, inside, fenced) -> Column:
    """Bucket of one plan: member or card, then parking bundles, then bare, else null."""
    by_state = lambda off, on: case([
        (col(state) == fv.NON_REFUNDABLE, off), (col(state) == fv.REFUNDABLE, on)], F.lit(None).cast("string"))
    return case([
        (~has_rate(rate), F.lit(None).cast("string")),
        (col(fenced), "MEMBER_OR_CARD_OFFER"),
        (F.lower(text(inside)).contains("parking"), by_state("BUNDLED_PARKING_NON_REF", "BUNDLED_PARKING_FLEX")),
        (is_bare(inside), by_state("BAR_NON_REF", "BAR_FLEX")),
    ], F.lit(None).cast("string"))


def strikethrough_share(original, rate) -> Column:
    """(original - rate) / original when original > rate > 0, to 4 places."""
    o, r = col(original), col(rate)
    return F.when((o > r) & (r > 0), F.bround((o - r) / o, 4))


def phrase_from_flag(label, flag) -> Column:
    """Cancellation phrase for a plan that has only a label and a flag."""
    low = F.lower(text(label))
    return case([
        (contains_any(low, ("non-refund", "pay now")), "Non-refundable"),
        (contains_any(low, ("free cancellation", "fully refundable", "pay flex", " flex")) | low.startswith("flex"),
         "Free cancellation"),
        (F.coalesce(col(flag), F.lit(False)), "Free cancellation"),
        (F.coalesce(~col(flag), F.lit(False)), "Non-refundable"),
    ], "")


def crs_refundability(category, name, description, long_description) -> Column:
    """struct(refundable, cancellation_phrase) from reservation-system rate metadata."""
    nm = text(name)
    body = F.coalesce(*[F.nullif(text(c), F.lit("")) for c in (long_description, description, name)], F.lit(""))
    both = lambda pattern: body.rlike("(?i)" + pattern) | nm.rlike("(?i)" + pattern)
    off = (F.upper(text(category)) == "NRF") | both(fv.CRS_NON_REFUNDABLE) | nm.rlike("(?i)" + fv.CRS_PAY_NOW)
    on = both(fv.CRS_FLEXIBLE) | both(fv.CRS_CANCEL_WORD)

    def phrase(words, lead):
        made = F.when(nm != "", F.concat(F.lit(lead + " ("), nm, F.lit(")"))).otherwise(F.lit(lead))
        return F.when(contains_any(F.lower(body), words), body).otherwise(made)

    return F.struct(
        case([(off, False), (on, True)], F.lit(None).cast("boolean")).alias("refundable"),
        case([
            (off, phrase(fv.NON_REFUNDABLE_PHRASES, "Non-refundable")),
            (on, phrase(fv.REFUNDABLE_PHRASES, "Refundable")),
        ], F.lit(None).cast("string")).alias("cancellation_phrase"),
    )


def true_text(c) -> Column:
    """Text 'true' / 'false' to boolean, anything else to null."""
    low = F.lower(strip(text(c)))
    return case([(low == "true", True), (low == "false", False)], F.lit(None).cast("boolean"))


def spread_verdict(movement, n_high) -> Column:
    """Ordered rule on the move of the subject-minus-peers gap."""
    m = col(movement)
    return case([
        ((col(n_high) < fv.MIN_HIGH_ROWS) | m.isNull(), "INSUFFICIENT_DEMAND_WINDOW"),
        (m >= fv.YIELDS_USD, "YIELDS_WITH_MARKET"),
        (F.abs(m) < fv.NOISE_USD, "ANCHORED"),
        (m <= -fv.NOISE_USD, "ANTI_YIELDS"),
    ], "PARTIALLY_DYNAMIC")


def demand_bucket(demand) -> Column:
    d = col(demand)
    return case([(d < fv.SHOULDER_FROM, "normal"), (d < fv.HIGH_FROM, "shoulder")], "high")


def nightly_from_stay(total_with_fees, per_night, nights) -> Column:
    """struct(total_stay_usd, rate_per_night_usd): stay total, else nightly times nights."""
    n = F.greatest(F.lit(1), col(nights))
    total = F.coalesce(col(total_with_fees), col(per_night) * n)
    return F.struct(
        F.bround(total, 2).alias("total_stay_usd"), F.bround(total / n, 2).alias("rate_per_night_usd")
    )
