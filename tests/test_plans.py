import pytest
from pyspark.sql import functions as F

from tariffa.functions import pages, plans, rooms
from tariffa.operators import quotes as Q


def value(spark, column, **fields):
    ddl = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in fields.items())
    return spark.createDataFrame([tuple(fields.values())], ddl).select(column.alias("x")).first().x


@pytest.mark.parametrize("phrase,label,want", [
    ("Free cancellation before Jul 10", "", "REFUNDABLE"), ("Fully refundable", "", "REFUNDABLE"), ("Non-refundable - no changes", "", "NON_REFUNDABLE"),
    ("", "Standard Rate", "UNKNOWN"), (None, None, "UNKNOWN"), ("", "Pay Now and Save", "NON_REFUNDABLE"), ("Refundable", "Pay now", "REFUNDABLE"),
    ("", "PAY FLEX", "REFUNDABLE"), ("", "Prepaid stay", "NON_REFUNDABLE")])
def test_refundability(spark, phrase, label, want):
    assert value(spark, plans.refundability("p", "l"), p=phrase, l=label) == want


@pytest.mark.parametrize("label,want", [
    ("Non-refundable + Parking", "parking"), ("Includes 1 parking spot", "parking"), ("Includes breakfast + WiFi", "breakfast,wifi"),
    ("with $50 resort credit", None), ("incl. dining credit", "credit"), ("Parking nearby", None), ("Best rate with airport shuttle", "transfer"), (None, None)])
def test_bundle(spark, label, want):
    assert value(spark, plans.bundle("l"), l=label) == want


@pytest.mark.parametrize("rate,label,phrase,member,want", [
    (200.0, "Room", "Non-refundable", False, "BAR_NON_REF"), (200.0, "Room", "Free cancellation", False, "BAR_FLEX"),
    (200.0, "Room + parking", "Non-refundable", False, "BUNDLED_PARKING_NON_REF"), (200.0, "Room + parking", "", False, None),
    (200.0, "Room + breakfast", "Non-refundable", False, None), (200.0, "Visa Offer", "Non-refundable", False, "MEMBER_OR_CARD_OFFER"),
    (200.0, "Room", "Non-refundable", True, "MEMBER_OR_CARD_OFFER"), (0.0, "Room", "Non-refundable", False, None), (200.0, "Room", "", False, None)])
def test_bucket(spark, rate, label, phrase, member, want):
    got = value(spark, plans.bucket("r", plans.refundability("p", "l"), plans.bundle("l"), plans.is_fenced("l", "m")), r=rate, l=label, p=phrase, m=member)
    assert got == want


def test_pick_takes_lowest_and_first_on_ties(spark):
    rows = [("x", 0, "Standard", "Free cancellation", 320.0, False), ("x", 1, "A", "Non-refundable", 285.0, False), ("x", 2, "B", "Non-refundable", 285.0, False),
            ("x", 3, "Genius deal", "Non-refundable", 100.0, False), ("y", 0, "Standard Rate", None, 90.0, False)]
    df = spark.createDataFrame(rows, "room string, i int, rate_plan_label string, cancellation_phrase string, rate_per_night_usd double, is_genius_member_rate boolean")
    got = [(r.room, r.rate_plan_label) for r in Q.pick(df, "NON_REFUNDABLE", ["i"], ("room",)).collect()]
    assert got == [("x", "A")]


@pytest.mark.parametrize("category,name,long,want", [
    ("NRF", "Pay Now and Save", "", (False, "Non-refundable (Pay Now and Save)")), ("BAR", "Best Flexible Rate", "", (True, "Refundable (Best Flexible Rate)")),
    ("PRO", "Visa Offer", "", (None, None)), ("DIS", "X", "This rate is non-cancellable", (False, "Non-refundable (X)")),
    ("PKG", "P", "Cancel up to 24h", (True, "Refundable (P)")), ("", "", "Fully refundable stay", (True, "Fully refundable stay"))])
def test_crs_refundability(spark, category, name, long, want):
    assert tuple(value(spark, plans.crs_refundability("c", "n", "d", "g"), c=category, n=name, d="", g=long)) == want


@pytest.mark.parametrize("name,prop,want", [
    ("Two Bedroom Suite", "o", ("CMP_2BR_tier_4_premier", "tier_4_premier", "non_view", 2, False, None)),
    ("Deluxe King View", "o", ("CMP_0BR_tier_2_view", "tier_2_view", "view", None, False, None)),
    ("Penthouse, 1 Bedroom, Terrace", "s", ("PH", "tier_5_penthouse", "penthouse", 1, False, "1BR")),
    ("One Bedroom H Street View", "s", ("1BDPRC", "tier_2_view", "h_street", 1, False, None)),
    ("Private Terrace", "s", ("PTR", "tier_4_premier", "terrace", None, False, None)),
    ("Accessible Two Bedroom", "s", ("2BD", "tier_3_suite", "non_view", 2, True, None)), ("Loft", "s", ("UNMAPPED", "unknown", "unknown", None, False, None))])
def test_room_classes(spark, name, prop, want):
    r = value(spark, rooms.classify_room("n", "p", ["s"]), n=name, p=prop)
    assert (r.mapped_internal_code, r.mapped_tier, r.mapped_view, r.mapped_bedrooms, r.mapped_ada, r.penthouse_variant) == want


def test_sku_needs_the_exact_name(spark):
    assert value(spark, rooms.sku("n"), n="  King Room ") == "hr_king"
    assert value(spark, rooms.sku("n"), n="king room") is None


@pytest.mark.parametrize("text,banner,pct,fenced", [
    ("Visa offer: enjoy up to 10pct off best flexible rate. Pay now and enjoy savings up to 15pct on this stay.", "Pay now and enjoy savings up to 15", 15.0, True),
    ("**15% off** Limited time. Reduced weekly rate available.", "15% off", 15.0, False),
    ("You get a reduced weekly rate here", "reduced weekly rate", None, False),
    ("Mastercard Offer: up to 10pct off best flexible rate.", None, None, True), ("Sign in to see member prices", None, None, True),
    ("8% off seasonal. Pay now and save up to 15pct.", "Pay now and save up to 15", 15.0, False), ("", None, None, False)])
def test_promo_kinds(spark, text, banner, pct, fenced):
    p = pages.with_promo(spark.createDataFrame([(text,)], "markdown string")).first().promo
    assert (p.promo_banner_text, p.promo_banner_pct, p.member_or_card_offer_text is not None) == (banner, pct, fenced)


@pytest.mark.parametrize("text,want", [
    ("Grand Hotel: no rooms available", "PASS_NO_INVENTORY"), ("no rooms available", "FAIL_URL_BROKEN"), ("Grand-Hotel 404 Not Found, sold out", "FAIL_URL_BROKEN"),
    ("Grand Hotel rooms from $200", None), ("", None)])
def test_empty_page(spark, text, want):
    df = spark.createDataFrame([(text, ["grand hotel"])], "m string, t array<string>")
    assert df.select(pages.empty_page_class("m", "t").alias("x")).first().x == want


@pytest.mark.parametrize("rate,label,page,want", [
    (295.0, "", "from $295 a night", True), (295.9, "", "from $295Reserve", True), (163.0, "", "+ $1634", False), (341.0, "+$46 add-on", "$295 / night + $46 more", True),
    (341.0, "+$46 add-on", "$295 / night", False), (1807.0, "", "$1,807 total", True), (0.0, "", "$0", False)])
def test_price_support(spark, rate, label, page, want):
    df = spark.createDataFrame([(rate, label, page)], "r double, l string, m string")
    assert df.select(pages.price_supported(F.col("r"), F.col("l"), pages.price_tokens("m")).alias("x")).first().x is want


@pytest.mark.parametrize("rates,channel,page,want", [
    ([300.0], "direct", "now 300", False), ([300.0], "booking", "now 300", True), ([2026.0], "booking", "May 2026", False), ([300.0], "booking", "id 1300", False),
    ([], "direct", "", True), ([1234.0], "direct", "$1,234 nightly", True), ([50.0], "booking", "50", False)])
def test_rates_on_page(spark, rates, channel, page, want):
    df = spark.createDataFrame([(rates, channel, page)], "r array<double>, c string, m string")
    assert df.select(pages.rates_supported(F.col("r"), pages.price_tokens("m"), "c").alias("x")).first().x is want
