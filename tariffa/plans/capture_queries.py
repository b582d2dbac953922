"""Registered capture and gate queries over page texts, with the same result in plain SQL.

Captures are laid out from the documents: the page is a lead text, room blocks and the
whole document; the nested rooms are array literals over the same row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tariffa import fixed_values as fv
from tariffa.functions import pages, rooms
from tariffa.operators import captures as C, gates as G
from tariffa.plans.common import R, rounded
from tariffa.schemas import EXTRACT
from tariffa.sources import fixtures as fx

CELL = list(C.CELL)
NL = "chr(10)"
BASE = f"""
SELECT doc_id, source AS property_id, CASE doc_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'booking' ELSE 'hotels_com' END AS channel,
  DATE '2026-01-01' + CAST(doc_id % 365 AS INT) AS arrival_date, CASE doc_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END AS nights,
  CAST(200 + (doc_id * 37) % 400 AS INT) AS base,
  CASE doc_id % 17 WHEN 0 THEN 'Sample Inn' WHEN 1 THEN 'Other Inn' ELSE concat('Grand - Hotel ', source) END AS property_name,
  CASE doc_id % 23 WHEN 0 THEN '2020-01-01' ELSE '' END AS arrival_text,
  CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END AS n_rooms,
  CASE doc_id % 13 WHEN 0 THEN 'Mystery Loft' ELSE 'Balcony Suite' END AS name_b,
  CASE doc_id % 19 WHEN 0 THEN CAST(50 AS DOUBLE) END AS room_rate,
  concat(CASE doc_id % 9 WHEN 0 THEN 'Access Denied. ' WHEN 1 THEN '404 Not Found. '
     WHEN 2 THEN 'Grand Hotel: we have no availability here between these dates. '
     WHEN 3 THEN 'no availability ' WHEN 4 THEN 'Showing 2 of 6 rooms. ' WHEN 5 THEN 'Showing 2 of 2 rooms. ' ELSE '' END,
   {NL}, '### View all photos for King Room', {NL}, '### King Room', {NL},
   CASE WHEN doc_id % 10 < 8 THEN concat('Non-Refundable', {NL}, chr(92), '+ $0Reserve now, pay deposit', {NL},
     'Fully refundable before Sep 23', {NL}, chr(92), '+ $163Reserve now, pay later', {NL}) ELSE '' END,
   CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('The current price is $', CAST((200 + (doc_id * 37) % 400) * 3 AS STRING), ' total')
     ELSE concat('$', CAST(200 + (doc_id * 37) % 400 AS STRING), ' nightly') END, {NL},
   CASE doc_id % 6 WHEN 0 THEN '' ELSE concat('$', CAST(225 + (doc_id * 37) % 400 AS STRING), 'Reserve ') END,
   CASE doc_id % 11 WHEN 0 THEN '' ELSE concat({NL}, '### Balcony Suite', {NL}, '+ $46 more. ') END,
   {NL}, '## Have a question?', {NL}, CASE doc_id % 12 WHEN 0 THEN concat('| [Penthouse deal', {NL}) ELSE '' END, text) AS markdown
FROM documents
"""
PLAN = "'rate_plan_label', {}, 'rate_per_night_usd', CAST({} AS DOUBLE), 'total_stay_usd', CAST(({}) * nights AS DOUBLE), 'refundable', {}, 'is_genius_member_rate', false, 'includes_breakfast', false, 'rate_plan_confidence', 'high', 'availability_status', 'available', 'cancellation_phrase', {}, 'strikethrough_orig_rate', {}"


def _plan(label, rate, flag, phrase, strike="CAST(NULL AS DOUBLE)"):
    return f"named_struct({PLAN.format(label, rate, rate, flag, phrase, strike)})"


KING = ", ".join([
    _plan("'Standard Rate'", "base + 25", "false", "'Free cancellation before Jul 10'", "CAST(base + 125 AS DOUBLE)"),
    _plan("'Pay Now and Save'", "base", "CAST(NULL AS BOOLEAN)", "CAST(NULL AS STRING)"),
    _plan("'Advance Purchase + Parking'", "base + 60", "true", "'Non-refundable'"),
    _plan("'Visa Offer'", "base - 10", "true", "'Free cancellation'")])
SUITE = _plan("'Fully refundable + $46'", "base + 46", "CAST(NULL AS BOOLEAN)", "CAST(NULL AS STRING)")
ROOMS = f"""slice(array(named_struct('marketing_name', 'King Room', 'sub_description', '', 'bed_config', '1 king', 'occupancy_max', 2, 'rate_per_night_usd', room_rate, 'rate_plans', array({KING})),
 named_struct('marketing_name', name_b, 'sub_description', '', 'bed_config', '', 'occupancy_max', 4, 'rate_per_night_usd', CAST(NULL AS DOUBLE), 'rate_plans', array({SUITE}))), 1, n_rooms)"""
KEEP = ("doc_id", *CELL)


def captures(s, d):
    base = s.sql(BASE.replace("FROM documents\n", "FROM {documents}\n"), documents=s.read.parquet(f"{d}/documents.parquet"))
    extract = f"named_struct('property_name', property_name, 'arrival_date', CASE WHEN arrival_text <> '' THEN arrival_text ELSE date_format(arrival_date, 'yyyy-MM-dd') END, 'nights', nights, 'rooms', {ROOMS})"
    return base.select(
        *KEEP, "markdown", F.concat(F.lit("https://rates.example/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.lit("2026-05-10 00:00:00").cast("timestamp").alias("captured_at"), F.array(F.lit("grand-hotel")).alias("expected_tokens"),
        F.expr(extract).cast(EXTRACT.replace("\n", " ")).alias("extract"))


def pages_df(s, d):
    return fx.load(s, d, "page_text")


GATE = {"subject_properties": ["src1", "src2", "src3", "src4"], "expected": (("direct", 1), ("booking", 2), ("hotels_com", 2)), "detailed_properties": ["src5", "src6"]}


def gated(s, d):
    return G.gate(captures(s, d), **GATE)


def flat(s, d):
    return C.flatten(captures(s, d).withColumn("missed", F.array().cast("array<string>")), sku_properties=["src1", "src2"])


# ------------------------------------------------------------------ SQL parts
B = f"WITH b AS ({BASE})\n"
PT = fx.cte("page_text")
IDENT = lambda c: f"trim(regexp_replace(replace(lower({c}), '-', ' '), '\\s+', ' ', 'g'))"


def any_in(c, words):
    return "(" + " OR ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def first_in(c, words):
    return "CASE " + " ".join(f"WHEN contains({c}, '{w.replace(chr(39), chr(39) * 2)}') THEN '{w.replace(chr(39), chr(39) * 2)}'" for w in words) + " END"


EMPTY = f"""CASE WHEN {any_in('ident', fv.BROKEN_PAGE_SIGNATURES)} THEN 'FAIL_URL_BROKEN' WHEN {any_in('ident', fv.NO_INVENTORY_SIGNATURES)}
 THEN CASE WHEN contains(ident, 'grand hotel') THEN 'PASS_NO_INVENTORY' ELSE 'FAIL_URL_BROKEN' END END"""
# the plan rows of every capture
PLANS = B + """, p AS (
 SELECT b.*, 0 AS room_idx, 0 AS plan_idx, 'King Room' AS room, 'Standard Rate' AS label, base + 25 AS rate, false AS refundable, 'REFUNDABLE' AS state, 'BAR_FLEX' AS bucket, NULL AS bundles FROM b WHERE n_rooms >= 1
 UNION ALL SELECT b.*, 0, 1, 'King Room', 'Pay Now and Save', base, NULL, 'NON_REFUNDABLE', 'BAR_NON_REF', NULL FROM b WHERE n_rooms >= 1
 UNION ALL SELECT b.*, 0, 2, 'King Room', 'Advance Purchase + Parking', base + 60, true, 'NON_REFUNDABLE', 'BUNDLED_PARKING_NON_REF', 'parking' FROM b WHERE n_rooms >= 1
 UNION ALL SELECT b.*, 0, 3, 'King Room', 'Visa Offer', base - 10, true, 'REFUNDABLE', 'MEMBER_OR_CARD_OFFER', NULL FROM b WHERE n_rooms >= 1
 UNION ALL SELECT b.*, 1, 0, name_b, 'Fully refundable + $46', base + 46, NULL, 'REFUNDABLE', 'BAR_FLEX', NULL FROM b WHERE n_rooms >= 2)
"""
GATES = B + f""", g0 AS (SELECT *, lower(markdown) AS low, {IDENT('markdown')} AS ident, regexp_replace(markdown, '([0-9]),([0-9]{{3}})', '\\1\\2', 'g') AS md FROM b)
, g1 AS (SELECT *, {first_in('low', fv.BLOCK_SIGNATURES)} AS sig, {EMPTY} AS empty_class,
  try_cast(nullif(regexp_extract(markdown, '(?i)Showing\\s+(\\d+)\\s+of\\s+(\\d+)\\s+rooms?', 2), '') AS INT) AS declared,
  regexp_matches(md, '\\$' || base || '([^0-9]|$)') AS has_base, regexp_matches(md, '\\$' || (base + 25) || '([^0-9]|$)') AS has_25,
  regexp_matches(md, '\\$' || (base + 46) || '([^0-9]|$)') AS has_46, regexp_matches(md, '\\+\\s*\\$46([^0-9]|$)') AS has_plus,
  regexp_matches(md, '\\$(' || base || '|' || (base + 25) || '|' || (base + 60) || '|' || (base - 10) || CASE WHEN n_rooms > 1 THEN '|' || (base + 46) ELSE '' END || ')\\b') AS any_dollar,
  regexp_matches(md, '(^|[^$0-9A-Za-z_])(' || base || '|' || (base + 25) || '|' || (base + 60) || '|' || (base - 10) || CASE WHEN n_rooms > 1 THEN '|' || (base + 46) ELSE '' END || ')\\b') AS any_bare FROM g0)
, g2 AS (SELECT *, CASE WHEN property_name = 'Sample Inn' THEN 'placeholder_name' WHEN property_name = 'Other Inn' THEN 'other_property' WHEN arrival_text <> '' THEN 'other_date'
   WHEN n_rooms = 0 AND length(markdown) > 500 THEN 'rooms_missed' WHEN n_rooms > 0 AND room_rate < 100 THEN 'rate_below_floor'
   WHEN n_rooms > 0 AND NOT any_dollar AND NOT (channel = 'booking' AND any_bare) THEN 'rates_not_on_page' END AS why,
  (n_rooms >= 1 AND NOT contains(markdown, 'King Room')) OR (n_rooms = 2 AND NOT contains(markdown, name_b)) AS room_fail,
  (n_rooms >= 1 AND NOT has_base) AS bar_fail, (n_rooms >= 1 AND NOT has_25) AS flex_fail,
  (n_rooms = 2 AND NOT (has_46 OR (has_base AND has_plus))) AS suite_fail,
  (property_id IN ('src5','src6') AND regexp_matches(low, '(###|\\|\\s*\\[)[^\\n|]*penthouse')) AS missed_penthouse,
  property_id IN ('src1','src2','src3','src4') AS subject, CASE channel WHEN 'direct' THEN 1 ELSE 2 END AS configured FROM g1)
, g3 AS (SELECT *, subject AND n_rooms < CASE WHEN channel = 'hotels_com' THEN coalesce(declared, configured) ELSE configured END AS short FROM g2)
, g4 AS (SELECT *, CASE WHEN sig IS NOT NULL THEN 'bot_blocked' WHEN n_rooms = 0 AND empty_class = 'PASS_NO_INVENTORY' THEN 'no_inventory' WHEN n_rooms = 0 AND empty_class = 'FAIL_URL_BROKEN' THEN 'FAIL_URL_BROKEN'
  WHEN why IS NOT NULL OR room_fail THEN 'extract_failed' WHEN short THEN 'FAIL_ROOM_COUNT_SHORT' WHEN subject AND n_rooms = 2 AND name_b = 'Mystery Loft' THEN 'FAIL_UNKNOWN_ROOM_TYPE'
  WHEN bar_fail OR flex_fail OR suite_fail THEN 'extract_failed' WHEN missed_penthouse THEN 'extract_incomplete' ELSE 'ok' END AS status,
 CASE WHEN sig IS NOT NULL THEN sig WHEN n_rooms = 0 AND empty_class = 'PASS_NO_INVENTORY' THEN 'page_says_no_inventory' WHEN n_rooms = 0 AND empty_class = 'FAIL_URL_BROKEN' THEN 'broken_or_other_page'
  WHEN why IS NOT NULL THEN why WHEN room_fail THEN 'room_not_on_page' WHEN short THEN 'rooms_short' WHEN subject AND n_rooms = 2 AND name_b = 'Mystery Loft' THEN 'unmapped_room'
  WHEN bar_fail OR flex_fail OR suite_fail THEN 'pick_not_on_page' WHEN missed_penthouse THEN 'patterns_missed' ELSE '' END AS reason FROM g3)
"""
TIERS = B + """, t AS (SELECT doc_id, n_rooms, name_b, base, nights, doc_id % 11 <> 0 AS has_suite, CASE WHEN doc_id % 10 < 8 THEN 2 ELSE 0 END AS king_tiers,
 CASE WHEN doc_id % 4 >= 2 THEN base WHEN doc_id % 4 = 1 THEN base * 3 // nights END AS lead_in FROM b)
, r AS (SELECT doc_id, 'King Room' AS marketing_name, king_tiers AS n_tiers, lead_in, CASE WHEN king_tiers = 0 THEN 'no_tiers_in_block' WHEN lead_in IS NULL THEN 'no_lead_in_anchor' END AS skip_reason, base, nights FROM t WHERE n_rooms >= 1
 UNION ALL SELECT doc_id, name_b, 0, NULL, CASE WHEN name_b = 'Balcony Suite' AND has_suite THEN 'no_tiers_in_block' ELSE 'no_room_block' END, base, nights FROM t WHERE n_rooms >= 2)
"""

Q = {}


def add(name, fn, sql=None):
    Q[name] = (lambda spark, d, fn=fn: rounded(fn(spark, d)), sql)


# ------------------------------------------------------------------ page text
def promo(s, d):
    return pages.with_promo(pages_df(s, d)).select("doc_id", "promo.*")


X = lambda p, g=0: f"nullif(trim(regexp_extract(markdown, '(?i){p}', {g})), '')"
_posted = [(p, g) for kind in fv.POSTED_PROMO_KINDS for k, p, g, _ in fv.PROMO_PATTERNS if k == kind]
add("promo_signals", promo, PT + "SELECT doc_id, coalesce(" + ", ".join(X(p) for p, _ in _posted) + ") AS promo_banner_text, CASE " + " ".join(
    f"WHEN {X(p)} IS NOT NULL THEN " + (f"try_cast({X(p, g)} AS DOUBLE)" if g else "NULL") for p, g in _posted) + " END AS promo_banner_pct, " +
    X(fv.WEEKLY_DISCLOSURE) + " AS weekly_rate_disclosure, CASE WHEN regexp_matches(markdown, '(?i)" + fv.MEMBER_GATE + "') THEN true END AS member_rate_gated, coalesce(" +
    ", ".join(X(p) for k, p, _, _ in fv.PROMO_PATTERNS if k in fv.FENCED_PROMO_KINDS) + ") AS member_or_card_offer_text FROM page_text")
add("block_gate", lambda s, d: pages_df(s, d).select("doc_id", pages.block_signature("markdown").alias("signature")),
    PT + f"SELECT doc_id, {first_in('lower(markdown)', fv.BLOCK_SIGNATURES)} AS signature FROM page_text")
add("empty_page", lambda s, d: pages_df(s, d).withColumn("t", F.array(F.lit("Grand-Hotel"))).select("doc_id", pages.empty_page_class("markdown", "t").alias("empty_class")),
    PT + f", i AS (SELECT doc_id, {IDENT('markdown')} AS ident FROM page_text) SELECT doc_id, {EMPTY} AS empty_class FROM i")
add("declared_rooms", lambda s, d: pages_df(s, d).select("doc_id", pages.declared_rooms("markdown").alias("n_declared")),
    PT + "SELECT doc_id, try_cast(nullif(regexp_extract(markdown, '(?i)Showing\\s+(\\d+)\\s+of\\s+(\\d+)\\s+rooms?', 2), '') AS INT) AS n_declared FROM page_text")
add("chain_pages", lambda s, d: pages_df(s, d).select("doc_id", pages.is_chain_page("markdown", ["Visa offer", "nightly"]).alias("is_chain")),
    PT + "SELECT doc_id, contains(markdown, 'Visa offer') AND contains(markdown, 'nightly') AS is_chain FROM page_text")
add("claimed_rate_anchor", lambda s, d: pages_df(s, d).select("doc_id", pages.rates_supported(F.array(F.col("claimed_rate").cast("double")), pages.price_tokens("markdown"), "channel").alias("ok")),
    PT + """, m AS (SELECT *, regexp_replace(markdown, '([0-9]),([0-9]{3})', '\\1\\2', 'g') AS md FROM page_text)
SELECT doc_id, regexp_matches(md, '\\$' || claimed_rate || '\\b') OR (channel = 'booking' AND regexp_matches(md, '(^|[^$0-9A-Za-z_])' || claimed_rate || '\\b')) AS ok FROM m""")
add("cell_verdict", lambda s, d: pages_df(s, d).withColumn("t", F.array(F.lit("grand hotel"))).select(
    "doc_id", pages.block_signature("markdown").alias("block"), pages.empty_page_class("markdown", "t").alias("empty_class"),
    F.expr("CASE doc_id % 14 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 200 END").alias("http"), F.expr("CASE doc_id % 15 WHEN 0 THEN 'DataDome' ELSE 'ok' END").alias("cell_status"),
    F.expr("CAST(doc_id % 2 AS INT)").alias("n"), F.expr("doc_id % 4 < 2").alias("present")).select(
    "doc_id", pages.cell_verdict("block", "http", "cell_status", "empty_class", "n", "present").alias("verdict")), PT + f"""
, i AS (SELECT doc_id, {first_in('lower(markdown)', fv.BLOCK_SIGNATURES)} AS block, {IDENT('markdown')} AS ident FROM page_text), e AS (SELECT *, {EMPTY} AS ec FROM i)
SELECT doc_id, CASE WHEN block IS NOT NULL OR doc_id % 14 IN (0, 1) OR doc_id % 15 = 0 OR coalesce(ec = 'FAIL_URL_BROKEN', false) THEN 'FAIL_URL_BROKEN'
 WHEN doc_id % 2 = 0 AND (coalesce(ec = 'PASS_NO_INVENTORY', false) OR doc_id % 4 >= 2) THEN 'PASS_NO_INVENTORY' WHEN doc_id % 2 > 0 THEN 'PASS' ELSE 'NO_DATA' END AS verdict FROM e""")

# ------------------------------------------------------------------ flattening
add("flatten_plans", lambda s, d: C.flatten_plans(captures(s, d), KEEP).select(
    *KEEP, "room_idx", "plan_idx", "marketing_name", "rate_plan_label", "rate_per_night_usd", "total_stay_usd"), PLANS + f"""SELECT doc_id, property_id, channel, arrival_date, nights,
 room_idx, plan_idx, room AS marketing_name, label AS rate_plan_label, CAST(rate AS DOUBLE) AS rate_per_night_usd, CAST(rate * nights AS DOUBLE) AS total_stay_usd FROM p""")
FLAT = ("property_id", "channel", "arrival_date", "nights", "source_url", "scraped_marketing_name", "rate_plan_label", "rate_per_night_usd", "refundable",
        "is_bar", "status", "rate_plan_canonical", "bundle_inclusions", "strikethrough_pct", "room_type_canonical")
add("flatten_quotes", lambda s, d: flat(s, d).select(*FLAT), PLANS + """, x AS (SELECT doc_id, property_id, channel, arrival_date, nights, room, label, CAST(rate AS DOUBLE) AS rate,
  CASE label WHEN 'Standard Rate' THEN true WHEN 'Advance Purchase + Parking' THEN false WHEN 'Visa Offer' THEN true END AS refundable, label = 'Pay Now and Save' AS is_bar,
  CASE WHEN label = 'Pay Now and Save' THEN 'ok' ELSE 'non_bar_rate' END AS status, bucket, bundles, CASE WHEN label = 'Standard Rate' THEN round_even(100.0 / (base + 125), 4) END AS sp FROM p
 UNION ALL SELECT doc_id, property_id, channel, arrival_date, nights, name_b, '', NULL, NULL, false, 'FAIL_NO_BARE_NON_REF', 'FAIL_NO_BARE_NON_REF', NULL, NULL FROM b WHERE n_rooms >= 2)
SELECT property_id, channel, arrival_date, nights, 'https://rates.example/' || doc_id AS source_url, room AS scraped_marketing_name, label AS rate_plan_label, rate AS rate_per_night_usd, refundable, is_bar, status,
 bucket AS rate_plan_canonical, bundles AS bundle_inclusions, sp AS strikethrough_pct,
 CASE WHEN property_id IN ('src1','src2') THEN CASE room WHEN 'King Room' THEN 'hr_king' WHEN 'Balcony Suite' THEN 'hr_suite_balcony' END END AS room_type_canonical FROM x""")
add("picker_failures", lambda s, d: C.picker_failures(flat(s, d)), B + """SELECT property_id, channel, arrival_date, nights, 'FAIL_NO_BARE_NON_REF' AS kind, name_b AS marketing_name,
 CASE WHEN property_id IN ('src1','src2') AND name_b = 'Balcony Suite' THEN 'hr_suite_balcony' END AS room_canonical FROM b WHERE n_rooms >= 2""")
add("unmapped_names", lambda s, d: C.unmapped_names(captures(s, d), keep=KEEP).select(*KEEP, F.array_join("unmapped", ",").alias("unmapped")),
    B + "SELECT doc_id, property_id, channel, arrival_date, nights, CASE WHEN n_rooms = 2 AND name_b = 'Mystery Loft' THEN name_b ELSE '' END AS unmapped FROM b")
add("render_class", lambda s, d: C.render_class(captures(s, d), KEEP), B + """SELECT doc_id, property_id, channel, arrival_date, nights,
 CASE n_rooms WHEN 0 THEN 'thin_min_0' WHEN 1 THEN 'ok_min_4' ELSE 'thin_min_1' END AS render FROM b""")
add("tier_rows", lambda s, d: C.flatten_plans(C.rewrite_tiers(captures(s, d)), ("doc_id",)).select(
    "doc_id", "marketing_name", "plan_idx", "rate_plan_label", "rate_per_night_usd", "total_stay_usd", "refundable", "cancellation_phrase"), TIERS + PLANS[len(B):] + """, k AS (SELECT *, unnest([0, 1]) AS i FROM r WHERE skip_reason IS NULL)
SELECT doc_id, marketing_name, i AS plan_idx, CASE i WHEN 0 THEN 'Non-Refundable + $0 (pay deposit)' ELSE 'Fully refundable before Sep 23 + $163 (pay later)' END AS rate_plan_label,
 CAST(lead_in + i * 163 AS DOUBLE) AS rate_per_night_usd, CAST((lead_in + i * 163) * nights AS DOUBLE) AS total_stay_usd, i = 1 AS refundable, CASE i WHEN 0 THEN 'Non-Refundable' ELSE 'Fully refundable before Sep 23' END AS cancellation_phrase FROM k
UNION ALL SELECT doc_id, room, plan_idx, label, CAST(rate AS DOUBLE), CAST(rate * p.nights AS DOUBLE), refundable,
 CASE label WHEN 'Standard Rate' THEN 'Free cancellation before Jul 10' WHEN 'Advance Purchase + Parking' THEN 'Non-refundable' WHEN 'Visa Offer' THEN 'Free cancellation' END
 FROM p WHERE (doc_id, room) IN (SELECT (doc_id, marketing_name) FROM r WHERE skip_reason IS NOT NULL)""")
add("tier_outcomes", lambda s, d: C.tier_outcomes(C.rewrite_tiers(captures(s, d))), TIERS + """SELECT coalesce(skip_reason, 'replaced') AS outcome, count(*) AS n_rooms, CAST(sum(n_tiers) AS BIGINT) AS n_tiers FROM r GROUP BY ALL""")

# ------------------------------------------------------------------ gates
add("plausibility", lambda s, d: captures(s, d).select("doc_id", G.implausible_reason().alias("reason")), GATES + "SELECT doc_id, why AS reason FROM g2")
add("room_anchor", lambda s, d: captures(s, d).select("doc_id", G.room_anchor_fails().alias("fails"), F.array_join(G.unanchored_rooms(), ",").alias("missing")),
    GATES + """SELECT doc_id, coalesce(room_fail, false) AS fails, concat_ws(',', CASE WHEN n_rooms >= 1 AND NOT contains(markdown, 'King Room') THEN 'King Room' END,
 CASE WHEN n_rooms = 2 AND NOT contains(markdown, name_b) THEN name_b END) AS missing FROM g2""")
add("pick_anchor", lambda s, d: G.anchor_check(captures(s, d)).select(
    "doc_id", F.array_join("anchor_fails.kind", ",").alias("fails"), F.size("anchor_warnings").alias("n_warnings")), GATES + """, w AS (SELECT *,
 regexp_matches(md, '\\$' || (base + 60) || '([^0-9]|$)') AS has_60, regexp_matches(md, '\\$' || (base - 10) || '([^0-9]|$)') AS has_10 FROM g2)
SELECT doc_id, concat_ws(',', CASE WHEN bar_fail THEN 'BAR_NON_REF' END, CASE WHEN flex_fail THEN 'BAR_FLEX' END, CASE WHEN suite_fail THEN 'BAR_FLEX' END) AS fails,
 CAST(n_rooms >= 1 AND NOT has_60 AS INT) + CAST(n_rooms >= 1 AND NOT has_10 AS INT) AS n_warnings FROM w""")
add("anchor_warnings", lambda s, d: G.anchor_check(captures(s, d)).select("doc_id", F.inline("anchor_warnings")), GATES + f""", w AS (SELECT doc_id, n_rooms, md, base + 60 AS rate, 'Advance Purchase + Parking' AS label FROM g2
 UNION ALL SELECT doc_id, n_rooms, md, base - 10, 'Visa Offer' FROM g2)
SELECT doc_id, 'King Room' AS room, CAST(rate AS DOUBLE) AS rate, label FROM w WHERE n_rooms >= 1 AND NOT regexp_matches(md, '\\$' || rate || '([^0-9]|$)')""")
add("simple_gate", lambda s, d: G.simple_gate(captures(s, d)).select("doc_id", "status", "reason"), GATES + """SELECT doc_id, CASE WHEN sig IS NOT NULL THEN 'bot_blocked' WHEN why IS NOT NULL THEN 'extract_failed' ELSE 'ok' END AS status,
 coalesce(sig, why, '') AS reason FROM g2""")
add("missing_patterns", lambda s, d: captures(s, d).select("doc_id", F.array_join(rooms.missing_patterns("markdown", F.transform(C.capture_rooms(), lambda r: r["marketing_name"])), ",").alias("missed")),
    GATES + "SELECT doc_id, concat_ws(',', " + ", ".join(
        f"CASE WHEN regexp_matches(low, '{h}') THEN '{label}' END" for label, h, _ in fv.VARIANCE_PATTERNS) + ") AS missed FROM g2")
add("room_count", lambda s, d: captures(s, d).select("doc_id", G.room_count("property_id", "channel", ["src1", "src2"], (("direct", 1), ("booking", 2), ("hotels_com", 2))).alias("c")).select("doc_id", "c.*"),
    GATES + """, c AS (SELECT *, CASE WHEN property_id NOT IN ('src1','src2') THEN 0 WHEN channel = 'hotels_com' THEN coalesce(declared, configured) ELSE configured END AS expected FROM g2)
SELECT doc_id, n_rooms, expected, property_id IN ('src1','src2') AND n_rooms < expected AS is_short FROM c""")
add("thin_render", lambda s, d: captures(s, d).select("doc_id", G.thin_render("channel", (("hotels_com", 2),)).alias("why")), GATES + """SELECT doc_id,
 CASE WHEN channel <> 'hotels_com' THEN NULL WHEN n_rooms = 0 AND coalesce(declared, 2) > 0 THEN 'no_room_expanded;rooms_short' WHEN n_rooms = 0 THEN 'no_room_expanded'
  WHEN n_rooms = 2 AND coalesce(declared, 2) > 2 THEN 'rooms_short' END AS why FROM g2""")
add("gate_status", lambda s, d: gated(s, d).select("doc_id", "status", "reason", "keep"), GATES + """SELECT doc_id, status, reason,
 CASE WHEN status IN ('no_inventory','FAIL_ROOM_COUNT_SHORT') THEN 'sentinel' WHEN status IN ('ok','extract_incomplete') THEN 'rows' ELSE 'none' END AS keep FROM g4""")
add("cell_sentinels", lambda s, d: C.cell_sentinels(gated(s, d)).select("source_url", "status", "rate_plan_canonical", "availability_status", "missed_patterns", "is_bar"), GATES + """
SELECT 'https://rates.example/' || doc_id AS source_url, status, CASE status WHEN 'no_inventory' THEN 'NO_INVENTORY' ELSE status END AS rate_plan_canonical,
 CASE status WHEN 'no_inventory' THEN status ELSE 'unknown' END AS availability_status, reason AS missed_patterns, false AS is_bar FROM g4 WHERE status IN ('no_inventory','FAIL_ROOM_COUNT_SHORT')""")
KEPT = ("source_url", "scraped_marketing_name", "rate_plan_label", "rate_per_night_usd", "refundable", "is_bar", "status", "rate_plan_canonical", "bundle_inclusions", "strikethrough_pct", "missed_patterns")
add("kept_rows", lambda s, d: C.quote_rows(C.flatten(gated(s, d).where("keep = 'rows'"))).select(*KEPT), GATES + PLANS[len(B):] + """
, k AS (SELECT doc_id, status AS cs, missed_penthouse FROM g4 WHERE status IN ('ok','extract_incomplete'))
, x AS (SELECT doc_id, room, label, CAST(rate AS DOUBLE) AS rate, CASE label WHEN 'Standard Rate' THEN true WHEN 'Advance Purchase + Parking' THEN false WHEN 'Visa Offer' THEN true END AS refundable,
  label = 'Pay Now and Save' AS is_bar, CASE WHEN cs <> 'ok' THEN 'extract_incomplete' WHEN label = 'Pay Now and Save' THEN 'ok' ELSE 'non_bar_rate' END AS status, bucket, bundles,
  CASE WHEN label = 'Standard Rate' THEN round_even(100.0 / (base + 125), 4) END AS sp, missed_penthouse FROM p JOIN k USING (doc_id)
 UNION ALL SELECT doc_id, name_b, '', NULL, NULL, false, 'FAIL_NO_BARE_NON_REF', 'FAIL_NO_BARE_NON_REF', NULL, NULL, missed_penthouse FROM b JOIN k USING (doc_id) WHERE n_rooms >= 2)
SELECT 'https://rates.example/' || doc_id AS source_url, room AS scraped_marketing_name, label AS rate_plan_label, rate AS rate_per_night_usd, refundable, is_bar, status, bucket AS rate_plan_canonical,
 bundles AS bundle_inclusions, sp AS strikethrough_pct, CASE WHEN missed_penthouse THEN 'penthouse' ELSE '' END AS missed_patterns FROM x""")
add("capture_rows", lambda s, d: G.capture_rows(captures(s, d), **GATE).select(*KEPT), Q["kept_rows"][1] + """ UNION ALL
SELECT 'https://rates.example/' || doc_id, '', '', NULL, NULL, false, status, CASE status WHEN 'no_inventory' THEN 'NO_INVENTORY' ELSE status END, NULL, NULL, reason
 FROM g4 WHERE status IN ('no_inventory','FAIL_ROOM_COUNT_SHORT')""")
add("smoke_summary", lambda s, d: G.smoke_summary(captures(s, d).withColumn("nights", F.col("doc_id")), 2).select(
    F.col("nights").alias("doc_id"), "status", "n_rooms", F.array_join("sample_rates.marketing_name", ",").alias("rooms"), F.array_join("notes", "|").alias("notes")), GATES + """
SELECT doc_id, CASE WHEN sig IS NOT NULL THEN 'bot_blocked' WHEN n_rooms = 0 AND coalesce(empty_class = 'PASS_NO_INVENTORY', false) THEN 'no_inventory' WHEN n_rooms = 0 THEN 'url_broken' WHEN n_rooms < 2 THEN 'extraction_incomplete' ELSE 'ok' END AS status,
 CASE WHEN sig IS NULL THEN n_rooms ELSE 0 END AS n_rooms, CASE WHEN sig IS NOT NULL OR n_rooms = 0 THEN '' WHEN n_rooms = 1 THEN 'King Room' ELSE 'King Room,' || name_b END AS rooms,
 concat_ws('|', sig, CASE WHEN n_rooms = 0 AND sig IS NULL THEN coalesce(empty_class, 'no_signal') END, CASE WHEN sig IS NULL AND n_rooms > 0 THEN why END, CASE WHEN n_rooms = 1 AND sig IS NULL THEN 'rooms_short' END) AS notes FROM g2""")

# ------------------------------------------------------------------ reservation system
CRS = """named_struct('RoomList', array(named_struct('Code', 'K1', 'Name', 'King Room', 'Details', named_struct('Description', 'd')), named_struct('Code', 'S1', 'Name', '', 'Details', named_struct('Description', 'Suite text'))),
 'RateList', array(named_struct('Code', 'NREF', 'Name', 'Pay Now and Save', 'CategoryCode', 'NRF', 'Details', named_struct('DisplayName', '', 'Description', '', 'DetailedDescription', 'This rate is non-refundable')),
  named_struct('Code', 'BFR', 'Name', '', 'CategoryCode', 'BAR', 'Details', named_struct('DisplayName', 'Best Flexible Rate', 'Description', '', 'DetailedDescription', '')),
  named_struct('Code', 'VISA', 'Name', 'Visa Offer', 'CategoryCode', 'PRO', 'Details', named_struct('DisplayName', '', 'Description', CASE WHEN p_size % 2 = 0 THEN 'you may cancel' ELSE '' END, 'DetailedDescription', ''))))"""
PRICE = "named_struct('Available', {}, 'Product', named_struct('Room', named_struct('Code', {}), 'Rate', named_struct('Code', {}), 'Prices', named_struct('Total', named_struct('Price', named_struct('Total', named_struct('AmountWithFees', {}, 'Amount', CAST(NULL AS DOUBLE)))), 'PerNight', named_struct('Price', named_struct('Total', named_struct('AmountWithFees', CAST(NULL AS DOUBLE), 'Amount', {}))))))"
NONE = "CAST(NULL AS DOUBLE)"


def crs(s, d):
    rows = s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", "p_retailprice", F.expr("CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 7 END").alias("nights"))
    detail = ", ".join([PRICE.format("true", "'K1'", "'NREF'", "p_retailprice", NONE), PRICE.format("p_size <= 25", "'K1'", "'BFR'", NONE, "p_retailprice"),
                        PRICE.format("true", "'K1'", "''", "p_retailprice", NONE)])
    listed = ", ".join([PRICE.format("CAST(NULL AS BOOLEAN)", "'S1'", "'VISA'", "p_retailprice + 1", NONE), PRICE.format("true", "'X9'", "'ZZZ'", NONE, "CASE WHEN p_size > 10 THEN p_retailprice END")])
    return rows.select("p_partkey", "p_size", "nights", F.expr(CRS).alias("ContentLists"), F.expr(f"array(named_struct('Prices', array({detail})))").alias("ProductAvailabilityDetail"),
                       F.expr(f"array(named_struct('Prices', array({listed})))").alias("ProductAvailabilityList"))


add("crs_plans", lambda s, d: C.crs_plans(crs(s, d), ("p_partkey", "nights")), """WITH r AS (SELECT p_partkey, p_size, p_retailprice AS p, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 7 END AS nights FROM part)
, u AS (SELECT p_partkey, nights, 'K1' AS room_code, 'NREF' AS rate_code, 'King Room' AS marketing_name, 'Pay Now and Save' AS rate_plan_label, p AS total, false AS refundable, 'This rate is non-refundable' AS cancellation_phrase, 'available' AS availability_status FROM r
 UNION ALL SELECT p_partkey, nights, 'K1', 'BFR', 'King Room', 'Best Flexible Rate', p * nights, true, 'Refundable (Best Flexible Rate)', 'available' FROM r WHERE p_size <= 25
 UNION ALL SELECT p_partkey, nights, 'S1', 'VISA', 'Suite text', 'Visa Offer', p + 1, CASE WHEN p_size % 2 = 0 THEN true END, CASE WHEN p_size % 2 = 0 THEN 'Refundable (Visa Offer)' ELSE '' END, 'sold_out' FROM r
 UNION ALL SELECT p_partkey, nights, 'X9', 'ZZZ', 'X9', 'ZZZ', p * nights, NULL, '', 'available' FROM r WHERE p_size > 10)
SELECT p_partkey, nights, room_code, rate_code, marketing_name, rate_plan_label, """ + R("round_even(total / nights, 2)", "rate_per_night_usd") + ", " + R("round_even(total, 2)", "total_stay_usd") +
    ", refundable, cancellation_phrase, availability_status FROM u")
