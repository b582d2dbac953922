"""Registered quote queries with the same result in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tariffa import fixed_values as fv
from tariffa.functions import plans, rooms
from tariffa.operators import quotes as Q_
from tariffa.plans.common import R, rounded
from tariffa.sources import fixtures as fx

KEY = list(fx.ROW_KEY)
K = ", ".join(KEY)
CH = fx.CHANNELS
ORDER = ["rate_plan_label", *KEY]
PAIRS = (("A", "ECONOMY", "STANDARD"), ("B", "SMALL", "LARGE"), ("C", "PROMO", "MEDIUM"))
SUNDAY = 6


def quotes(s, d):
    return fx.load(s, d, "quotes")


def tagged(s, d):
    return Q_.tag_rows(quotes(s, d), KEY)


def posted(s, d, **kw):
    return Q_.posted_rows(quotes(s, d), KEY, nights=1, **kw)


def cells(s, d):
    return Q_.room_cells(posted(s, d), KEY)


def with_flag(s, d):
    return quotes(s, d).withColumn("refundable", plans.refundable_flag("cancellation_phrase", F.col("rate_plan_label") == "Standard Rate"))


def plan_cells(s, d):
    return Q_.plan_cells(with_flag(s, d), KEY, nights=7)


def all_plan_cells(s, d):
    """Matched plans need one plan in both rooms, so every stay counts here."""
    return Q_.plan_cells(with_flag(s, d), KEY, nights=None)


def spreads(s, d):
    return Q_.channel_spread(cells(s, d), CH)


def premium(s, d):
    return Q_.matched_premium(all_plan_cells(s, d), PAIRS)


def steps(s, d):
    return Q_.tier_steps(cells(s, d), PAIRS)


# ------------------------------------------------------------------ SQL parts
def has(col, words):
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


STATE = f"""CASE WHEN {has("coalesce(cancellation_phrase,'')", fv.NON_REFUNDABLE_PHRASES)} THEN 'NON_REFUNDABLE'
 WHEN {has("coalesce(cancellation_phrase,'')", fv.REFUNDABLE_PHRASES)} THEN 'REFUNDABLE'
 WHEN {has('rate_plan_label', fv.NON_REFUNDABLE_LABELS)} THEN 'NON_REFUNDABLE'
 WHEN {has('rate_plan_label', fv.REFUNDABLE_LABELS)} THEN 'REFUNDABLE' ELSE 'UNKNOWN' END"""
LABEL_STATE = f"""CASE WHEN {has('rate_plan_label', fv.NON_REFUNDABLE_LABELS)} THEN 'NON_REFUNDABLE'
 WHEN {has('rate_plan_label', fv.REFUNDABLE_LABELS)} THEN 'REFUNDABLE' ELSE 'UNKNOWN' END"""
BUNDLE = """CASE WHEN rate_plan_label = 'Advance Purchase + Parking' THEN 'parking' WHEN rate_plan_label = 'Fully refundable, includes breakfast' THEN 'breakfast' END"""
FENCED = f"(is_genius_member_rate OR {has('rate_plan_label', fv.MEMBER_OR_CARD_LABELS)})"
ROOM = "property_id, channel, arrival_date, nights, marketing_name"
PLANS = fx.cte("quotes") + f""", q0 AS (SELECT *, {STATE} AS state, {BUNDLE} AS bundles, {FENCED} AS fenced FROM quotes)
, q1 AS (SELECT *, (rate_per_night_usd > 0 AND bundles IS NULL AND NOT fenced) AS fits FROM q0)
, q2 AS (SELECT *, (fits AND state = 'NON_REFUNDABLE' AND 1 = row_number() OVER (PARTITION BY {ROOM}, fits, state ORDER BY rate_per_night_usd, {K})) AS is_bar,
   (fits AND state = 'REFUNDABLE' AND 1 = row_number() OVER (PARTITION BY {ROOM}, fits, state ORDER BY rate_per_night_usd, {K})) AS is_flex FROM q1)
"""
CELLS = PLANS + f""", cells AS (SELECT property_id, channel, arrival_date, marketing_name AS room, rate_per_night_usd AS rate_usd FROM q2
 WHERE is_bar AND nights = 1 QUALIFY row_number() OVER (PARTITION BY property_id, channel, arrival_date, marketing_name ORDER BY mapped_ada, rate_per_night_usd, {K}) = 1)
"""
FLAG = f"""CASE WHEN {has("coalesce(cancellation_phrase,'')", fv.FLAG_OFF_PHRASES)} THEN false
 WHEN {has("coalesce(cancellation_phrase,'')", fv.REFUNDABLE_PHRASES)} THEN true ELSE rate_plan_label = 'Standard Rate' END"""
PCELLS = lambda where: fx.cte("quotes") + f""", pc AS (SELECT property_id, channel, arrival_date, marketing_name AS room, rate_plan_label, rate_per_night_usd AS rate_usd FROM quotes
 WHERE {FLAG} AND {where} QUALIFY row_number() OVER (PARTITION BY property_id, channel, arrival_date, marketing_name, rate_plan_label ORDER BY mapped_ada, rate_per_night_usd, {K}) = 1)
"""  # noqa: E731
SPREADS = CELLS + """, w AS (SELECT property_id, room, arrival_date, count(*) AS n_channels, min(rate_usd) AS min_usd, max(rate_usd) AS max_usd,
 max(rate_usd) FILTER (WHERE channel = 'direct') AS rate_direct, max(rate_usd) FILTER (WHERE channel = 'hotels_com') AS rate_hotels_com,
 max(rate_usd) FILTER (WHERE channel = 'booking') AS rate_booking FROM cells GROUP BY ALL HAVING count(*) >= 2)
, sp AS (SELECT *, CASE WHEN rate_direct = min_usd THEN 'direct' WHEN rate_hotels_com = min_usd THEN 'hotels_com' ELSE 'booking' END AS min_channel,
 CASE WHEN rate_direct = max_usd THEN 'direct' WHEN rate_hotels_com = max_usd THEN 'hotels_com' ELSE 'booking' END AS max_channel,
 max_usd - min_usd AS spread_usd, (max_usd - min_usd) / min_usd * 100 AS spread_pct FROM w)
"""
SPREAD_COLS = f"""property_id, room, arrival_date, n_channels, {R('min_usd')}, {R('max_usd')}, min_channel, max_channel, {R('spread_usd')}, {R('spread_pct')},
 {R('rate_direct')}, {R('rate_hotels_com')}, {R('rate_booking')}"""
PAIR_VALUES = "(VALUES " + ", ".join(f"('{a}','{b}','{c}')" for a, b, c in PAIRS) + ")"
PREMIUM = PCELLS("true") + f""", pr(pair, base, vw) AS {PAIR_VALUES}
, b AS (SELECT pr.pair, x.property_id, x.channel, x.arrival_date, x.rate_plan_label, x.rate_usd AS base_usd, y.rate_usd AS view_usd FROM pr
 JOIN pc x ON x.room = base JOIN pc y ON y.room = vw AND y.property_id = x.property_id AND y.channel = x.channel AND y.arrival_date = x.arrival_date AND y.rate_plan_label = x.rate_plan_label)
, prem AS (SELECT property_id, pair, channel, arrival_date, rate_plan_label AS rate_plan, base_usd, view_usd, view_usd - base_usd AS delta_usd, (view_usd - base_usd) / base_usd * 100 AS delta_pct,
 count(*) OVER c AS matched_n, string_agg(rate_plan_label, '|') OVER (c ORDER BY rate_plan_label ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS matched_plans FROM b
 WINDOW c AS (PARTITION BY property_id, pair, channel, arrival_date)
 QUALIFY row_number() OVER (PARTITION BY property_id, pair, channel, arrival_date ORDER BY CASE WHEN rate_plan_label = 'Standard Rate' THEN 0 ELSE 1 END, least(base_usd, view_usd), rate_plan_label) = 1)
"""
STEPS = CELLS + f""", pr(pair, lo, hi) AS {PAIR_VALUES}
, st AS (SELECT x.property_id, pair, x.channel, x.arrival_date, x.rate_usd AS lower_usd, y.rate_usd AS upper_usd, y.rate_usd - x.rate_usd AS delta_usd, (y.rate_usd - x.rate_usd) / x.rate_usd * 100 AS delta_pct
 FROM pr JOIN cells x ON x.room = lo JOIN cells y ON y.room = hi AND y.property_id = x.property_id AND y.channel = x.channel AND y.arrival_date = x.arrival_date)
"""


def summary(source):
    return f""", lv AS (SELECT pair, 'all' AS channel, delta_usd AS d, delta_pct AS p FROM {source} UNION ALL SELECT pair, channel, delta_usd, delta_pct FROM {source})
SELECT pair, channel, count(*) AS n, {R('avg(d)', 'mean_usd')}, {R('avg(p)', 'mean_pct')}, {R('min(d)', 'min_usd')}, {R('max(d)', 'max_usd')}, count(*) FILTER (WHERE d < 0) AS n_negative,
 count(*) FILTER (WHERE d = 0) AS n_zero, {R('stddev_samp(d) / nullif(avg(d), 0) * 100', 'cv_pct')}, {R('median(d)', 'median_usd')}, {R('median(p)', 'median_pct')} FROM lv GROUP BY pair, channel"""


LADDER = PLANS + f""", ld AS (SELECT arrival_date, marketing_name AS sku, min(rate_per_night_usd) AS rate_usd FROM q2 WHERE is_bar AND nights = 1 AND isodow(arrival_date) = 7 GROUP BY ALL)
, lad AS (SELECT sku, count(*) AS n, min(rate_usd) AS min_usd, max(rate_usd) AS max_usd, median(rate_usd) AS median_usd FROM ld GROUP BY sku HAVING sku <> 'PROMO' OR count(*) >= 3)
"""

Q = {}


def add(name, fn, sql=None):
    Q[name] = (lambda spark, d, fn=fn: rounded(fn(spark, d)), sql)


# ------------------------------------------------------------------ plan rules
add("plan_tags", lambda s, d: tagged(s, d).select(
    *ORDER, "is_bar", "rate_plan_canonical", "bundle_inclusions", "strikethrough_pct", "status",
    plans.refundability("cancellation_phrase", "rate_plan_label").alias("state"),
    plans.refundable_flag("cancellation_phrase", F.lit(None).cast("boolean")).alias("refundable")), PLANS + f"""SELECT rate_plan_label, {K}, is_bar,
 CASE WHEN is_bar THEN 'BAR_NON_REF' WHEN is_flex THEN 'BAR_FLEX' WHEN fenced THEN 'MEMBER_OR_CARD_OFFER'
  WHEN bundles = 'parking' THEN CASE state WHEN 'NON_REFUNDABLE' THEN 'BUNDLED_PARKING_NON_REF' WHEN 'REFUNDABLE' THEN 'BUNDLED_PARKING_FLEX' END
  WHEN bundles IS NULL THEN CASE state WHEN 'NON_REFUNDABLE' THEN 'BAR_NON_REF' WHEN 'REFUNDABLE' THEN 'BAR_FLEX' END END AS rate_plan_canonical,
 bundles AS bundle_inclusions, CASE WHEN strikethrough_orig_rate > rate_per_night_usd THEN round((strikethrough_orig_rate - rate_per_night_usd) / strikethrough_orig_rate, 4) END AS strikethrough_pct,
 CASE WHEN is_bar THEN 'ok' ELSE 'non_bar_rate' END AS status, state,
 CASE WHEN cancellation_phrase = 'Non-refundable' THEN false WHEN cancellation_phrase = 'Free cancellation' THEN true END AS refundable FROM q2""")
for _name, _state, _flag in (("bar_pick", fv.NON_REFUNDABLE, "is_bar"), ("flex_pick", fv.REFUNDABLE, "is_flex")):
    add(_name, lambda s, d, st=_state: Q_.pick(quotes(s, d), st, KEY), PLANS + f"SELECT {ROOM}, rate_plan_label, {R('rate_per_night_usd')}, {K} FROM q2 WHERE {_flag}")
add("unknown_refundability", lambda s, d: Q_.unknown_refundability(quotes(s, d)), PLANS + """SELECT property_id, channel, arrival_date, nights,
 count(*) FILTER (WHERE state = 'UNKNOWN') AS n_unknown, count(*) AS n_plans FROM q2 GROUP BY ALL""")
add("phrase_from_flag", lambda s, d: quotes(s, d).select(*KEY, plans.phrase_from_flag("rate_plan_label", F.when(F.col("l_linenumber") != 7, F.col("mapped_ada"))).alias("phrase")),
    fx.cte("quotes") + f"""SELECT {K}, CASE WHEN contains(lower(rate_plan_label), 'non-refund') OR contains(lower(rate_plan_label), 'pay now') THEN 'Non-refundable'
 WHEN contains(lower(rate_plan_label), 'free cancellation') OR contains(lower(rate_plan_label), 'fully refundable') THEN 'Free cancellation'
 WHEN l_linenumber = 7 THEN '' WHEN mapped_ada THEN 'Free cancellation' ELSE 'Non-refundable' END AS phrase FROM quotes""")
add("text_recovery", lambda s, d: Q_.recover_text(quotes(s, d).select(
    *KEY, F.concat(F.lit(" "), F.upper(F.col("is_genius_member_rate").cast("string"))).alias("flag"), F.when(F.col("mapped_ada"), "n/a").otherwise(
        F.col("nights").cast("string")).alias("num")), ("flag",), ("num",)),
    fx.cte("quotes") + f"SELECT {K}, is_genius_member_rate AS flag, CASE WHEN NOT mapped_ada THEN CAST(nights AS DOUBLE) END AS num FROM quotes")
ROOM_NAME = "CASE l_linenumber WHEN 1 THEN concat('Two Bedroom ', marketing_name, ' View') WHEN 2 THEN concat('1 BR ', marketing_name, ' Suite') WHEN 3 THEN 'H Street One Bedroom' WHEN 4 THEN 'Accessible Penthouse, 2 Bedrooms' WHEN 5 THEN 'Private Terrace 1 bedroom' WHEN 6 THEN ' King Room ' ELSE 'Balcony Suite' END"
add("room_classes", lambda s, d: quotes(s, d).select(*KEY, "property_id", F.expr(ROOM_NAME).alias("room_name")).select(
    *KEY, F.expr("room_name"), rooms.classify_room("room_name", "property_id", ["NATION_3"]).alias("c"), rooms.sku("room_name").alias("sku")).select(
    *KEY, "c.mapped_internal_code", "c.mapped_tier", "c.mapped_view", "c.mapped_bedrooms", "c.mapped_ada", "c.penthouse_variant", "sku"),
    fx.cte("quotes") + f""", r AS (SELECT {K}, property_id = 'NATION_3' AS named, lower(trim({ROOM_NAME})) AS n FROM quotes)
, g AS (SELECT *, CASE WHEN n LIKE 'two bedroom%' OR n LIKE '%2 bedrooms' THEN 2 WHEN n LIKE '1 br%' OR n LIKE '%one bedroom' OR n LIKE '%1 bedroom' THEN 1 END AS beds,
  CASE WHEN n LIKE '%penthouse%' THEN 'tier_5_penthouse' WHEN n LIKE '%suite%' THEN 'tier_4_premier' WHEN n LIKE '%view%' THEN 'tier_2_view' ELSE 'tier_1_entry' END AS gt,
  CASE WHEN n LIKE '%view%' THEN 'view' ELSE 'non_view' END AS gv, CASE WHEN n LIKE '1 br%' THEN NULL WHEN n LIKE 'two bedroom%' OR n LIKE '%2 bedrooms' THEN 2 WHEN n LIKE '%one bedroom' OR n LIKE '%1 bedroom' THEN 1 END AS nb FROM r)
SELECT {K}, CASE WHEN NOT named THEN 'CMP_' || coalesce(CAST(CASE WHEN n LIKE '%2 bedrooms' THEN NULL ELSE beds END AS VARCHAR), '0') || 'BR_' || gt
   WHEN n LIKE '%penthouse%' THEN 'PH' WHEN n LIKE '%terrace%' THEN 'PTR1' WHEN n LIKE 'h street%' THEN '1BDPRC' WHEN nb IS NOT NULL THEN nb || 'BD' ELSE 'UNMAPPED' END AS mapped_internal_code,
 CASE WHEN NOT named THEN gt WHEN n LIKE '%penthouse%' THEN 'tier_5_penthouse' WHEN n LIKE '%terrace%' THEN 'tier_4_premier' WHEN n LIKE 'h street%' THEN 'tier_2_view' WHEN nb = 2 THEN 'tier_3_suite' WHEN nb = 1 THEN 'tier_1_entry' ELSE 'unknown' END AS mapped_tier,
 CASE WHEN NOT named THEN gv WHEN n LIKE '%penthouse%' THEN 'penthouse' WHEN n LIKE '%terrace%' THEN 'terrace' WHEN n LIKE 'h street%' THEN 'h_street' WHEN nb IS NOT NULL THEN 'non_view' ELSE 'unknown' END AS mapped_view,
 CASE WHEN named THEN nb WHEN n LIKE '%2 bedrooms' THEN NULL ELSE beds END AS mapped_bedrooms, n LIKE '%accessible%' AS mapped_ada, CASE WHEN named AND n LIKE '%penthouse%' THEN nb || 'BR' END AS penthouse_variant,
 CASE n WHEN 'king room' THEN 'hr_king' WHEN 'balcony suite' THEN 'hr_suite_balcony' END AS sku FROM g""")

# ------------------------------------------------------------------ cells, coverage, ranges
add("room_cells", cells, CELLS + "SELECT property_id, channel, arrival_date, room, " + R("rate_usd") + " FROM cells")
add("plan_cells", plan_cells, PCELLS("nights = 7") + "SELECT property_id, channel, arrival_date, room, rate_plan_label, " + R("rate_usd") + " FROM pc")
add("coverage", lambda s, d: Q_.coverage(cells(s, d), CH), CELLS + """, dt AS (SELECT property_id, count(DISTINCT arrival_date) AS n_dates FROM cells GROUP BY property_id)
SELECT c.property_id, room, count(*) FILTER (WHERE channel = 'direct') AS direct, count(*) FILTER (WHERE channel = 'hotels_com') AS hotels_com, count(*) FILTER (WHERE channel = 'booking') AS booking,
 count(*) AS total, any_value(n_dates) AS n_dates, any_value(n_dates) * 3 AS n_possible FROM cells c JOIN dt USING (property_id) GROUP BY c.property_id, room""")
add("price_range", lambda s, d: Q_.price_range(cells(s, d)), CELLS + f"""SELECT property_id, room, count(*) AS n, {R('min(rate_usd)', 'min_usd')}, {R('max(rate_usd)', 'max_usd')}, {R('avg(rate_usd)', 'mean_usd')},
 {R('median(rate_usd)', 'median_usd')} FROM cells GROUP BY ALL""")
add("rate_matrix", lambda s, d: Q_.rate_matrix(cells(s, d), CH), CELLS + "SELECT property_id, room, arrival_date, " + ", ".join(
    R(f"max(rate_usd) FILTER (WHERE channel = '{c}')", c) for c in CH) + f", {R('avg(rate_usd)', 'mean_usd')} FROM cells GROUP BY property_id, room, arrival_date")

MONTHS = [f"{y}-{m:02d}" for y in range(1992, 1999) for m in range(1, 13)]  # every month that has arrival dates
add("matrix_by_date", lambda s, d: Q_.matrix_by_date(cells(s, d).withColumn("arrival_date", F.date_format("arrival_date", "yyyy-MM")), MONTHS),
    CELLS + "SELECT property_id, channel, room, " + ", ".join(
    R(f"max(rate_usd) FILTER (WHERE strftime(arrival_date, '%Y-%m') = '{m}')", f'"{m}"') for m in MONTHS) +
    " FROM cells GROUP BY property_id, channel, room")
add("matrix_long", lambda s, d: Q_.matrix_long(cells(s, d)), CELLS + f"SELECT property_id, channel, room, arrival_date, {R('max(rate_usd)', 'rate_usd')} FROM cells GROUP BY ALL")
add("export_head", lambda s, d: Q_.first_rows(cells(s, d), 50, ["channel", "arrival_date", "room", "property_id"]),
    CELLS + f"SELECT property_id, channel, arrival_date, room, {R('rate_usd')} FROM cells ORDER BY channel, arrival_date, room, property_id LIMIT 50")
add("yield_intensity", lambda s, d: Q_.yield_intensity(cells(s, d)), CELLS + f""", y AS (SELECT property_id, room, count(*) AS n, min(rate_usd) AS mn, max(rate_usd) AS mx, avg(rate_usd) AS av,
 stddev_samp(rate_usd) / avg(rate_usd) * 100 AS cv, median(rate_usd) AS md FROM cells GROUP BY ALL)
SELECT property_id, room, n, {R('mn', 'min_usd')}, {R('mx', 'max_usd')}, {R('av', 'mean_usd')}, {R('cv', 'cv_pct')}, {R('md', 'median_usd')}, {R('CASE WHEN n >= 2 THEN mx / mn END', 'max_min_ratio')},
 row_number() OVER (PARTITION BY property_id ORDER BY cv DESC NULLS LAST, room) AS rank FROM y""")
add("payload_coverage", lambda s, d: Q_.payload_coverage(cells(s, d)), CELLS + """SELECT 'all' AS channel, count(DISTINCT arrival_date) AS n_dates, count(DISTINCT room) AS n_rooms, count(*) AS n_cells FROM cells
UNION ALL SELECT channel, count(DISTINCT arrival_date), count(DISTINCT room), count(*) FROM cells GROUP BY channel""")

# ------------------------------------------------------------------ spreads
add("channel_spread", spreads, SPREADS + f"SELECT {SPREAD_COLS} FROM sp")
add("spread_summary", lambda s, d: Q_.spread_summary(spreads(s, d)), SPREADS + f""", lv AS (SELECT 'all' AS level, '' AS name, spread_pct AS p FROM sp UNION ALL SELECT 'room', room, spread_pct FROM sp
 UNION ALL SELECT 'date', CAST(arrival_date AS VARCHAR), spread_pct FROM sp)
SELECT level, name, count(*) AS n, {R('avg(p)', 'mean_pct')}, {R('max(p)', 'max_pct')}, count(*) FILTER (WHERE p >= 10) AS n_10, count(*) FILTER (WHERE p >= 30) AS n_30, {R('median(p)', 'median_pct')} FROM lv GROUP BY ALL""")
add("worst_spreads", lambda s, d: Q_.worst_spreads(spreads(s, d)), SPREADS + f"SELECT {SPREAD_COLS} FROM sp ORDER BY sp.spread_pct DESC, arrival_date, room, property_id LIMIT 15")
add("pairwise_spread", lambda s, d: Q_.pairwise_spread(spreads(s, d), CH), SPREADS + ", pp AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS channel_a, '{b}' AS channel_b, abs(rate_{a} - rate_{b}) / least(rate_{a}, rate_{b}) * 100 AS p FROM sp WHERE rate_{a} IS NOT NULL AND rate_{b} IS NOT NULL"
    for a, b in (("direct", "hotels_com"), ("direct", "booking"), ("hotels_com", "booking"))) + f""")
SELECT channel_a, channel_b, count(*) AS n, {R('avg(p)', 'mean_pct')}, {R('max(p)', 'max_pct')}, {R('median(p)', 'median_pct')} FROM pp GROUP BY ALL""")
add("matched_premium", premium, PREMIUM + f"""SELECT property_id, pair, channel, arrival_date, rate_plan, {R('base_usd')}, {R('view_usd')}, {R('delta_usd')}, {R('delta_pct')}, matched_n, matched_plans FROM prem""")
add("premium_summary", lambda s, d: Q_.delta_summary(premium(s, d)), PREMIUM + summary("prem"))
add("tier_steps", steps, STEPS + f"SELECT property_id, pair, channel, arrival_date, {R('lower_usd')}, {R('upper_usd')}, {R('delta_usd')}, {R('delta_pct')} FROM st")
add("step_summary", lambda s, d: Q_.delta_summary(steps(s, d)), STEPS + summary("st"))


def ladder(s, d):
    return Q_.sku_ladder(posted(s, d, on_weekday=SUNDAY), KEY, min_n={"PROMO": 3})


add("sku_ladder", ladder, LADDER + f"SELECT sku, n, {R('min_usd')}, {R('max_usd')}, {R('median_usd')}, n < 3 AS is_thin FROM lad")
add("ladder_deltas", lambda s, d: Q_.ladder_deltas(ladder(s, d), [("LARGE", "SMALL"), ("MEDIUM", "absent")]), LADDER + f"""SELECT 'LARGE_minus_SMALL' AS pair,
 {R("max(median_usd) FILTER (WHERE sku = 'LARGE') - max(median_usd) FILTER (WHERE sku = 'SMALL')", 'value_usd')} FROM lad UNION ALL SELECT 'MEDIUM_minus_absent', NULL""")
add("ratio_check", lambda s, d: Q_.ratio_check(quotes(s, d), 0.97), fx.cte("quotes") + f""", r AS (SELECT nights, rate_per_night_usd / (total_stay_usd / nights) AS ratio FROM quotes WHERE rate_per_night_usd > 0 AND total_stay_usd > 0)
, l AS (SELECT 'all' AS stay, ratio FROM r UNION ALL SELECT 'los_' || nights, ratio FROM r)
SELECT stay, count(*) AS n, count(*) FILTER (WHERE ratio > 0.97) AS n_suspect, {R('min(ratio)', 'min_ratio')}, {R('max(ratio)', 'max_ratio')}, {R('median(ratio)', 'median_ratio')} FROM l GROUP BY stay""")

# ------------------------------------------------------------------ audits
add("pick_audit", lambda s, d: Q_.pick_audit(quotes(s, d).withColumn("is_legacy_bar", (F.col("status") == "ok") & (F.col("l_linenumber") <= 2)), KEY),
    fx.cte("quotes") + f""", a AS (SELECT *, (status = 'ok' AND l_linenumber <= 2) AS legacy, ({BUNDLE} IS NULL AND NOT {FENCED} AND ({LABEL_STATE}) = 'NON_REFUNDABLE') AS fits FROM quotes)
, n AS (SELECT {ROOM}, rate_plan_label AS nl, rate_per_night_usd AS nr FROM a WHERE fits QUALIFY row_number() OVER (PARTITION BY {ROOM} ORDER BY rate_per_night_usd, {K}) = 1)
, o AS (SELECT {ROOM}, rate_plan_label AS ol, rate_per_night_usd AS orr FROM a WHERE legacy QUALIFY row_number() OVER (PARTITION BY {ROOM} ORDER BY {K}) = 1)
, j AS (SELECT r.channel, ol, orr, nl, nr FROM (SELECT DISTINCT {ROOM} FROM a) r LEFT JOIN n USING ({ROOM}) LEFT JOIN o USING ({ROOM}))
, c AS (SELECT channel, count(*) AS total, count(*) FILTER (WHERE ol = nl AND orr = nr) AS agree, count(*) FILTER (WHERE ol IS NOT NULL AND nl IS NOT NULL AND NOT (ol = nl AND orr = nr)) AS disagree,
 count(*) FILTER (WHERE ol IS NOT NULL AND nl IS NULL) AS new_none, count(*) FILTER (WHERE ol IS NULL) AS no_legacy, count(*) FILTER (WHERE ol IS NULL AND nl IS NULL) AS both_none FROM j GROUP BY channel)
SELECT *, {R('(disagree + new_none) / nullif(total - no_legacy, 0)', 'disagreement_rate')} FROM c""")


def expected_picks(s, d):
    return quotes(s, d).groupBy(*Q_.ROOM).agg(
        F.max(F.when(F.col("l_linenumber") == 1, F.col("rate_plan_label"))).alias("expected_bar"),
        F.max(F.when(F.col("l_linenumber") == 6, F.col("rate_plan_label"))).alias("expected_flex"),
        F.max(F.col("l_linenumber") == 2).alias("flex_any"))


def picked_labels(s, d):
    both = Q_.join_on(Q_.pick(quotes(s, d), fv.NON_REFUNDABLE, KEY).select(*Q_.ROOM, F.col("rate_plan_label").alias("bar_label")),
                      Q_.pick(quotes(s, d), fv.REFUNDABLE, KEY).select(*Q_.ROOM, F.col("rate_plan_label").alias("flex_label")), Q_.ROOM, "left")
    return both


add("pick_check", lambda s, d: Q_.pick_check(picked_labels(s, d), expected_picks(s, d), list(Q_.ROOM)), PLANS + f"""
, e AS (SELECT {ROOM}, max(rate_plan_label) FILTER (WHERE l_linenumber = 1) AS expected_bar, max(rate_plan_label) FILTER (WHERE l_linenumber = 6) AS expected_flex, bool_or(l_linenumber = 2) AS flex_any,
 max(rate_plan_label) FILTER (WHERE is_bar) AS bar_label, CASE WHEN bool_or(is_bar) THEN max(rate_plan_label) FILTER (WHERE is_flex) END AS flex_label FROM q2 GROUP BY {ROOM})
SELECT *, coalesce(bar_label = expected_bar, false) AS bar_match, CASE WHEN flex_any THEN flex_label IS NOT NULL WHEN expected_flex IS NULL THEN flex_label IS NULL ELSE coalesce(flex_label = expected_flex, false) END AS flex_match FROM e""")
