"""Registered ingest, upsert, queue and verification queries with the same result in plain SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tariffa.functions import cells
from tariffa.operators import captures as C, gates as G, ingest as I, panel as P, price_days as D, quotes as Q_, reports as RP_, series as S, upsert as U, verify as Y
from tariffa.plans import panel_queries as PQ, quote_queries as QQ
from tariffa.plans.common import R, rounded
from tariffa.session import stored, work_folder
from tariffa.sources import fixtures as fx
from tariffa.sources.keyed_store import KeyedStore
from tariffa.schemas import upgrade_quotes

SLUGS = {f"c{i}": p for i, p in enumerate(fx.PROPERTIES)}
CELL = list(U.CELL)
C4 = ", ".join(CELL)


def sheet(s, d):
    """The wide sheet, one row a date, written once: rules on its cells and dates would else be pushed down to every row it is made of."""
    wide, path = fx.load(s, d, "sheet_wide"), work_folder(s, "wide-sheet")
    wide.write.parquet(path)
    return s.read.schema(wide.schema).parquet(path)


def csv_files(s, d):
    """The sheet as one CSV text a month: cells in quotes, a note with quotes, commas and a line end, columns the other way round
    in every second month. A month is at most 31 lines."""
    wide = sheet(s, d).withColumn("month", F.date_format("arrival_date", "yyyy-MM"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    note = F.concat(F.lit('say "ok", '), F.col("month"), F.lit("\nsecond line"))
    named = {"Date": F.datediff("arrival_date", F.lit("1899-12-30")).cast("string"), "Market demand": F.col("market_demand").cast("string"), "Market OTB": F.lit("0.5"),
             "My OTB": note, **{h: F.col(h) for h in SLUGS}}
    line = lambda names: F.concat_ws(",", *[quoted(named[n]) for n in names])
    odd, names = F.month("arrival_date") % 2 == 1, list(named)
    lines = F.array_sort(F.collect_list(F.struct("arrival_date", F.when(odd, line(names)).otherwise(line(names[::-1])).alias("text"))))
    head = F.when(F.substr(F.col("month"), F.lit(6), F.lit(2)).cast("int") % 2 == 1, ",".join(names)).otherwise(",".join(names[::-1]))
    return wide.groupBy("month").agg(lines.alias("lines")).select(
        F.concat(F.lit("sheet_"), "month", F.lit("-01_los3_.csv")).alias("file"), F.to_timestamp(F.lit("2026-05-08 00:00:00")).alias("file_time"),
        F.concat(head, F.lit("\r\n"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).alias("value"))


def csv_panel(s, d):
    """The sheets are written once: the header checks and the panel read the files, not the tables they were made of."""
    files, path = csv_files(s, d), work_folder(s, "sheets")
    files.write.parquet(path)
    return I.sheet_rows_panel(I.sheet_rows(s.read.schema(files.schema).parquet(path)), SLUGS, "booking")


def melted(s, d):
    return I.typed(I.melt(sheet(s, d), SLUGS))


def log(s, d):
    return fx.load(s, d, "cell_log").withColumnsRenamed({"property": "property_id", "arrival": "arrival_date", "los": "nights"})


def status_rows(s, d):
    """Stored rows of cells: the log's words as row statuses."""
    return log(s, d).withColumnRenamed("kind", "status")


def done(s, d):
    return U.complete_cells(status_rows(s, d))


DENY = (("P3", "booking", None), (None, "hotels_com", ["P1", "P2", "P4", "P5", "P8", "P11"]))
DENIED = "(property_id = 'P3' AND channel = 'booking') OR (channel = 'hotels_com' AND property_id NOT IN ('P1','P2','P4','P5','P8','P11'))"


def matrix(s, d):
    """Every day between the first and the last arrival of the log."""
    rows = log(s, d)
    first, last = rows.agg(F.min("arrival_date"), F.max("arrival_date")).first()
    dates = [] if first is None else [(first + datetime.timedelta(days=i)).isoformat() for i in range((last - first).days + 1)]
    return U.cell_matrix(rows.select("property_id").distinct(), fx.CHANNELS, dates, [1, 3, 7])


def queue(s, d):
    return U.work_queue(matrix(s, d), done(s, d), DENY)


def old_new(s, d):
    """An existing table and a batch with an extra and a missing column."""
    q = QQ.quotes(s, d).withColumn("room_type_canonical", F.when(F.col("marketing_name") != "PROMO", F.col("marketing_name")))
    old = q.where("l_linenumber <= 4").select(*CELL, "room_type_canonical", "rate_plan_label", "rate_per_night_usd", "mapped_ada")
    new = q.where("l_linenumber > 3").select(*CELL, "room_type_canonical", "rate_plan_label", "rate_per_night_usd", "sub_code")
    return old, new


def stored_upsert(s, d):
    """The same rows through a stored table: the old ones as its first version, the batch as its second."""
    store = KeyedStore(s, work_folder(s, "stored-upsert"))
    for batch in old_new(s, d):
        store.upsert(batch)
    return store.read()


def verify_cells(s, d):
    v = fx.load(s, d, "verify_cells")
    text_ = lambda c: F.col(c).cast("string")
    expected = F.map_concat(
        F.create_map(F.lit("bar_non_ref_nightly_allin"), text_("exp_rate"), F.lit("marketing_name_verbatim"), text_("exp_name"),
                     F.lit("room_type_canonical_present"), F.lit("true")),
        F.when(F.col("exp_promo_asserted"), F.create_map(F.lit("promo_banner_pct"), text_("exp_promo_pct"))).otherwise(
            F.create_map().cast("map<string,string>")))
    actual = F.create_map(F.lit("bar_non_ref_nightly_allin"), text_("act_rate"), F.lit("marketing_name"), text_("act_name"),
                          F.lit("promo_banner_pct"), F.col("act_promo_pct").cast("double").cast("string"),
                          F.lit("room_canonical_resolved"), F.when(F.col("cell_id") % 50 != 0, F.col("channel")).otherwise(""))
    return v.select("cell_id", "channel", "report_verdict", "exp_rate", expected.alias("expected"), actual.alias("actual"))


def joined_cells(s, d):
    v = verify_cells(s, d)
    return Y.match_cells(v.select("cell_id", "report_verdict", "actual"), v.select("cell_id", "channel", "exp_rate", "expected").where("cell_id % 37 <> 5"))


def checked(s, d):
    return Y.checks(joined_cells(s, d))


# ------------------------------------------------------------------ SQL parts
SW = fx.cte("rate_panel", "sheet_wide").replace("FROM (" + fx.RATE_PANEL + ") p)", "FROM rate_panel)")
MELT = SW + ", raw AS (" + " UNION ALL ".join(f"SELECT arrival_date, '{p}' AS property, trim(c{i}) AS v FROM sheet_wide" for i, p in enumerate(fx.PROPERTIES)) + """)
, ty AS (SELECT arrival_date, property, CASE WHEN v IS NULL OR v = '' OR try_cast(v AS DOUBLE) = 0 THEN 'blank' WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'available'
  WHEN lower(v) = 'sold out' THEN 'sold_out' WHEN lower(v) = 'no flex' THEN 'no_flex' WHEN lower(v) IN ('room n/a','room na') THEN 'room_na' WHEN v = '--' THEN 'not_loaded'
  WHEN regexp_full_match(v, 'LOS[0-9]+') THEN 'los_restricted' ELSE 'unknown_sentinel:' || v END AS availability_status,
  CASE WHEN try_cast(v AS DOUBLE) <> 0 THEN try_cast(v AS DOUBLE) END AS rate_usd, try_cast(nullif(regexp_extract(v, '^LOS([0-9]+)$', 1), '') AS INT) AS los_restriction FROM raw)
"""
LOGV = fx.cte("cell_log") + """, lg AS (SELECT event_id, ts, property AS property_id, channel, arrival AS arrival_date, los AS nights, kind, credits FROM cell_log)
, st AS (SELECT property_id, channel, arrival_date, nights, bool_or(lower(kind) IN ('ok','extract_incomplete','compression_short','no_inventory')) AS has_extracted,
   bool_or(kind IN ('FAIL_NO_BARE_NON_REF','FAIL_NO_BAR_FLEX','FAIL_ROOM_COUNT_SHORT')) AS has_sentinel FROM lg GROUP BY ALL)
, dn AS (SELECT property_id, channel, arrival_date, nights FROM st WHERE has_extracted AND NOT has_sentinel)
"""
QUEUE = LOGV + f""", mx AS (SELECT property_id, channel, arrival_date, nights FROM (SELECT DISTINCT property_id FROM lg) p CROSS JOIN (SELECT unnest(['direct','hotels_com','booking']) AS channel) c
 CROSS JOIN (SELECT CAST(unnest(generate_series(min(arrival_date), max(arrival_date), INTERVAL 1 DAY)) AS DATE) AS arrival_date FROM lg) a CROSS JOIN (SELECT unnest([1, 3, 7]) AS nights) n)
, qu AS (SELECT * FROM (SELECT * FROM mx WHERE NOT ({DENIED})) z ANTI JOIN dn USING ({C4}))
"""
UPS = fx.cte("quotes") + f""", q AS (SELECT *, CASE WHEN marketing_name <> 'PROMO' THEN marketing_name END AS room_type_canonical FROM quotes)
, o AS (SELECT * FROM q WHERE l_linenumber <= 4), n AS (SELECT * FROM q WHERE l_linenumber > 3)
, nk AS (SELECT DISTINCT {C4}, coalesce(room_type_canonical, '') AS rk FROM n)
, kept AS (SELECT o.* FROM o LEFT JOIN nk ON nk.property_id = o.property_id AND nk.channel = o.channel AND nk.arrival_date = o.arrival_date AND nk.nights = o.nights AND nk.rk = coalesce(o.room_type_canonical, '') WHERE nk.rk IS NULL)
"""
CHECKS = fx.cte("verify_cells") + """, v AS (SELECT * FROM verify_cells WHERE cell_id % 37 <> 5)
, ck AS (SELECT cell_id, channel, 'bar_non_ref_nightly_allin' AS field, abs(act_rate - exp_rate) / exp_rate <= 0.02 AS passed FROM v
 UNION ALL SELECT cell_id, channel, 'marketing_name_verbatim', coalesce(act_name = exp_name, false) FROM v
 UNION ALL SELECT cell_id, channel, 'room_type_canonical_present', cell_id % 50 <> 0 FROM v
 UNION ALL SELECT cell_id, channel, 'promo_banner_pct', CASE WHEN NOT exp_promo_asserted THEN NULL WHEN exp_promo_pct IS NULL THEN act_promo_pct IS NULL ELSE coalesce(exp_promo_pct = act_promo_pct, false) END FROM v
 UNION ALL SELECT cell_id, channel, unnest(['promo_banner_text','weekly_rate_disclosure_present','bundle_inclusions','member_rate_gated','min_rate_rows_visible']), NULL FROM v)
, fc AS (SELECT channel, field, count(*) FILTER (WHERE passed) AS n_pass, count(*) FILTER (WHERE NOT passed) AS n_fail, count(*) FILTER (WHERE passed IS NULL) AS n_na FROM ck GROUP BY ALL)
"""
VERD = """CASE WHEN count(*) = 0 THEN 'RED' WHEN min(n_pass / nullif(n_pass + n_fail, 0)) >= 0.95 THEN 'GREEN' WHEN min(n_pass / nullif(n_pass + n_fail, 0)) >= 0.80 THEN 'YELLOW' ELSE 'RED' END"""

Q = {}


def add(name, fn, sql=None):
    Q[name] = (lambda spark, d, fn=fn: rounded(fn(spark, d)), sql)


# ------------------------------------------------------------------ ingest
add("melt_status", melted, MELT + f"SELECT arrival_date, property, availability_status, {R('rate_usd')}, los_restriction FROM ty")
add("csv_sheets", lambda s, d: csv_panel(s, d).select("as_of_date", "arrival_date", "length_of_stay_nights", "property", "availability_status", "rate_usd", "los_restriction"),
    MELT + f"""SELECT CAST(date_trunc('month', arrival_date) AS DATE) AS as_of_date, arrival_date, 3 AS length_of_stay_nights, property, availability_status, {R('rate_usd')}, los_restriction FROM ty""")
add("unknown_tally", lambda s, d: I.unknown_statuses(melted(s, d)), MELT + """SELECT substr(availability_status, 18) AS cell_text, count(*) AS n FROM ty WHERE availability_status LIKE 'unknown_sentinel:%' GROUP BY ALL""")


def text_sheet(s, d):
    """A sheet as it is read from a file: text cells, serial days, rows without a date."""
    w = sheet(s, d)
    serial = F.date_diff("arrival_date", F.lit("1899-12-30").cast("date")).cast("string")
    date = F.when(F.weekday("arrival_date") == 0, F.date_format("arrival_date", "yyyy-MM-dd")).when(F.weekday("arrival_date") == 1, F.lit("")).otherwise(serial)
    return w.withColumns({
        "Date": date, "Day": F.when(F.weekday("arrival_date") != 2, F.concat(F.lit(" "), F.date_format("arrival_date", "EEE"))),
        "Market demand": F.coalesce(F.col("market_demand").cast("string"), F.lit("n/a")), "Market OTB": F.lit("0.5"),
        "as_of_date": F.lit("1995-01-01").cast("date"), "length_of_stay_nights": F.lit(3)}).drop("arrival_date", "market_demand")


add("sheet_panel", lambda s, d: I.sheet_panel(text_sheet(s, d), SLUGS, "booking"), MELT + f"""SELECT DATE '1995-01-01' AS as_of_date, arrival_date, strftime(arrival_date, '%a') AS dow,
 'booking' AS source, 'any' AS room_tier, property, {R('rate_usd')}, availability_status, los_restriction, {R('w.market_demand', 'market_demand_frac')}, CAST(0.5 AS DOUBLE) AS market_otb_frac, 3 AS length_of_stay_nights
 FROM ty JOIN (SELECT arrival_date, market_demand FROM sheet_wide) w USING (arrival_date) WHERE isodow(arrival_date) <> 2""")
add("undated_rows", lambda s, d: I.undated(text_sheet(s, d)), SW + "SELECT count(*) FILTER (WHERE isodow(arrival_date) = 2) AS n_undated, count(*) AS n_rows FROM sheet_wide")
add("updated_day", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(
    F.date_format(F.date_add(F.to_date("ts"), F.expr("CAST(event_id % 200 AS INT)")), "dd/MM"), F.lit(" 08:15")).alias("stamp"), F.col("ts").alias("t")).select(
    "event_id", cells.updated_day("stamp", "t").alias("as_of")), """WITH e AS (SELECT event_id, ts, CAST(ts AS DATE) + CAST(event_id % 200 AS INT) AS day FROM events)
, c AS (SELECT *, make_date(year(ts), month(day), day(day)) AS this_year FROM e)
SELECT event_id, CASE WHEN CAST(this_year AS TIMESTAMP) > ts + INTERVAL 90 DAY THEN make_date(year(ts) - 1, month(day), day(day)) ELSE this_year END AS as_of FROM c""")


def headers(s, d):
    part = s.read.parquet(f"{d}/part.parquet")
    return part.select(F.col("p_type").alias("file"), F.col("p_brand").alias("header")).unionByName(
        part.select(F.col("p_type").alias("file"), F.when(F.col("p_size") % 2 == 0, "Date").otherwise(F.concat(F.lit("Unnamed: "), F.col("p_size").cast("string"))).alias("header")))


def nation_map(s, d):
    return s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("header"),
                                                        F.concat(F.lit("slug"), (F.col("n_nationkey") % 22).cast("string")).alias("slug"), "n_nationkey")


add("drift_check", lambda s, d: I.header_drift(headers(s, d), nation_map(s, d).where("n_nationkey < 15"), nation_map(s, d).where("n_nationkey > 18")), """SELECT DISTINCT p_type AS file, p_brand AS header FROM part
 WHERE CAST(replace(p_brand, 'Brand#', '') AS INT) BETWEEN 15 AND 18 OR CAST(replace(p_brand, 'Brand#', '') AS INT) > 24""")
add("map_preflight", lambda s, d: I.map_preflight(nation_map(s, d), nation_map(s, d).where("n_nationkey = 4").select("header"), "slug99", s.read.parquet(f"{d}/supplier.parquet").select(
    F.concat(F.lit("slug"), (F.col("s_suppkey") % 24).cast("string")).alias("property")).distinct()), """WITH m AS (SELECT 'Brand#' || n_nationkey AS header, 'slug' || (n_nationkey % 22) AS slug FROM nation)
, p AS (SELECT DISTINCT 'slug' || (s_suppkey % 24) AS slug FROM supplier)
SELECT 'subject_missing' AS problem, 'slug99' AS name UNION ALL SELECT 'peer_missing', slug FROM p WHERE slug NOT IN (SELECT slug FROM m)
UNION ALL SELECT 'duplicate_slug', slug FROM m GROUP BY slug HAVING count(*) > 1 UNION ALL SELECT 'mapped_and_dropped', 'Brand#4'
UNION ALL SELECT DISTINCT 'orphan_slug', slug FROM m WHERE slug NOT IN (SELECT slug FROM p)""")
def sampled(s, d):
    """A drawn sample of melted prices; those of the 13th are altered."""
    drawn = P.sample_rows(melted(s, d).select("property", "arrival_date", "rate_usd"), ["property", "arrival_date"], 200, 42)
    return drawn.withColumn("rate_usd", F.when(F.dayofmonth("arrival_date") == 13, F.col("rate_usd") + 1).otherwise(F.col("rate_usd")))


DRAWN = "(SELECT property, arrival_date, rate_usd FROM ty ORDER BY md5(concat_ws('|', '42', coalesce(property, ''), coalesce(CAST(arrival_date AS VARCHAR), ''))), property, arrival_date LIMIT 200)"
add("sample_recheck", lambda s, d: I.sample_recheck(sampled(s, d), melted(s, d).select("property", "arrival_date", "rate_usd")),
    MELT.replace(", ty AS (", ", ty AS MATERIALIZED (") + f""", m AS MATERIALIZED (SELECT property, arrival_date, rate_usd + CASE WHEN day(arrival_date) = 13 THEN 1 ELSE 0 END AS r FROM {DRAWN})
SELECT property, arrival_date, {R('m.r', 'rate_usd')}, {R('t.rate_usd', 'source_usd')}, coalesce(abs(m.r - t.rate_usd) <= 1e-6, false) AS matches FROM m LEFT JOIN ty t USING (property, arrival_date)""")
add("sample_rows", lambda s, d: P.sample_rows(melted(s, d), ["property", "arrival_date"], 20, 42), MELT + f"""SELECT property, arrival_date, {R('rate_usd')}, availability_status, los_restriction
 FROM ty ORDER BY md5(concat_ws('|', '42', coalesce(property, ''), coalesce(CAST(arrival_date AS VARCHAR), ''))), property, arrival_date LIMIT 20""")

# ------------------------------------------------------------------ upsert and queues
add("keyed_upsert", lambda s, d: U.upsert(*old_new(s, d)), UPS + f"""SELECT {C4}, room_type_canonical, rate_plan_label, {R('rate_per_night_usd')}, mapped_ada FROM kept
 UNION ALL SELECT {C4}, room_type_canonical, rate_plan_label, {R('rate_per_night_usd')}, NULL FROM n""")
add("stored_upsert", stored_upsert, Q["keyed_upsert"][1])
add("upsert_report", lambda s, d: U.upsert_report(*old_new(s, d)), UPS + f"""SELECT (SELECT count(*) FROM o) AS old_rows, (SELECT count(*) FROM n) AS new_rows, (SELECT count(*) FROM nk) AS new_keys,
 (SELECT count(*) FROM (SELECT DISTINCT {C4} FROM n)) AS new_cells, (SELECT count(*) FROM o) - (SELECT count(*) FROM kept) AS dropped, (SELECT count(*) FROM kept) + (SELECT count(*) FROM n) AS final_rows,
 (SELECT count(*) FROM kept) + (SELECT count(*) FROM n) - (SELECT count(*) FROM o) AS delta""")
add("cell_state", lambda s, d: U.cell_state(status_rows(s, d)), LOGV + "SELECT *, has_extracted AND NOT has_sentinel AS is_complete FROM st")
add("complete_cells", done, LOGV + "SELECT * FROM dn")
add("retry_queue", lambda s, d: U.retry_queue(log(s, d), done(s, d), DENY), LOGV + f"""SELECT * FROM (SELECT DISTINCT {C4} FROM lg WHERE kind IN ('http_error','extract_failed','bot_blocked') AND NOT ({DENIED})) f ANTI JOIN dn USING ({C4})""")
add("work_queue", queue, QUEUE + f"SELECT {C4} FROM qu")
add("projected_cost", lambda s, d: U.projected_cost(U.with_cost(queue(s, d), ["hotels_com"])), QUEUE + """SELECT count(*) AS n_cells, count(*) FILTER (WHERE channel = 'hotels_com') AS n_stealth,
 CAST(coalesce(sum(CASE WHEN channel = 'hotels_com' THEN 25 ELSE 5 END), 0) AS BIGINT) AS credits FROM qu""")
add("budget_cut", lambda s, d: U.budget_cut(log(s, d), "event_id", 5500, 1000).select("event_id", "spent_before", "runs"), LOGV + """, r AS (SELECT event_id,
 CAST(coalesce(sum(credits) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_before FROM lg) SELECT *, spent_before < 5500 AS runs FROM r""")
add("outcome_tally", lambda s, d: U.outcome_tally(log(s, d)), LOGV + "SELECT kind, count(*) AS n_cells, CAST(sum(credits) AS BIGINT) AS credits FROM lg GROUP BY kind")
add("checkpoints", lambda s, d: U.checkpoints(log(s, d), "event_id", 50, 1000), LOGV + """, r AS (SELECT event_id, CAST(sum(credits) OVER (ORDER BY event_id) AS BIGINT) AS credits FROM lg)
SELECT event_id + 1 AS n_cells, credits FROM r WHERE (event_id + 1) % 50 = 0""")


def v1_rows(s, d):
    q = QQ.quotes(s, d)
    have = {"property_id", "channel", "arrival_date", "nights", "rate_plan_label", "rate_per_night_usd", "total_stay_usd", "is_genius_member_rate", "mapped_ada", "status"}
    from tariffa.schemas import QUOTES_V1
    return q.select(*[(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in QUOTES_V1.fields])


add("schema_upgrade", lambda s, d: upgrade_quotes(v1_rows(s, d)).select("property_id", "channel", "arrival_date", "nights", "rate_plan_label", "rate_per_night_usd", "bundle_inclusions", "promo_banner_pct", "member_rate_gated"),
    fx.cte("quotes") + f"SELECT property_id, channel, arrival_date, nights, rate_plan_label, {R('rate_per_night_usd')}, NULL AS bundle_inclusions, NULL AS promo_banner_pct, NULL AS member_rate_gated FROM quotes")
URL = "https://h.example/?in={arrive}&out={depart}&d={arrive_day}-{depart_day}&m={arrive_mmyyyy}/{depart_mmyyyy}&u={arrive_mdy}~{depart_mdy}"
add("dated_urls", lambda s, d: log(s, d).select("event_id", C.dated_url(F.lit(URL), "arrival_date", "nights").alias("url")), LOGV + """SELECT event_id, 'https://h.example/?in=' || strftime(a, '%Y-%m-%d') || '&out=' || strftime(b, '%Y-%m-%d') ||
 '&d=' || strftime(a, '%d') || '-' || strftime(b, '%d') || '&m=' || strftime(a, '%m%Y') || '/' || strftime(b, '%m%Y') || '&u=' || strftime(a, '%m/%d/%Y') || '~' || strftime(b, '%m/%d/%Y') AS url
 FROM (SELECT event_id, arrival_date AS a, arrival_date + nights AS b FROM lg) z""")
add("hand_entered", lambda s, d: C.hand_entered(QQ.quotes(s, d).select(
    "property_id", "channel", "arrival_date", "nights", F.when(~F.col("mapped_ada"), F.when(F.col("l_linenumber") < 4, "King Room").otherwise("Luxury Suite")).alias("marketing_name"),
    F.col("rate_per_night_usd").alias("rate_usd"), F.lit("2026-05-10").cast("timestamp").alias("scrape_timestamp_utc")), "https://h.example/{arrive}/{depart}").select(
    "property_id", "channel", "arrival_date", "nights", "scraped_marketing_name", "rate_per_night_usd", "total_stay_usd", "is_bar", "status", "room_type_canonical", "rate_plan_canonical", "mapped_tier", "source_url"),
    fx.cte("quotes") + f""", h AS (SELECT *, mapped_ada AS gone, CASE WHEN l_linenumber < 4 THEN 'King Room' ELSE 'Luxury Suite' END AS nm FROM quotes)
SELECT property_id, channel, arrival_date, nights, CASE WHEN gone THEN '' ELSE nm END AS scraped_marketing_name, {R('CASE WHEN NOT gone THEN h.rate_per_night_usd END', 'rate_per_night_usd')},
 {R('CASE WHEN NOT gone THEN h.rate_per_night_usd * nights END', 'total_stay_usd')}, NOT gone AS is_bar, CASE WHEN gone THEN 'no_inventory' ELSE 'ok' END AS status,
 CASE WHEN NOT gone THEN CASE nm WHEN 'King Room' THEN 'hr_king' ELSE 'hr_suite_luxury' END END AS room_type_canonical, CASE WHEN gone THEN 'NO_INVENTORY' ELSE 'BAR_FLEX' END AS rate_plan_canonical,
 CASE WHEN gone THEN '' WHEN nm = 'King Room' THEN 'tier_1_entry' ELSE 'tier_4_premier' END AS mapped_tier,
 'https://h.example/' || strftime(arrival_date, '%Y-%m-%d') || '/' || strftime(arrival_date + nights, '%Y-%m-%d') AS source_url FROM h""")
add("allowed_cells", lambda s, d: G.denied_cells(log(s, d).select("event_id", *CELL), DENY), LOGV + f"SELECT event_id, {C4} FROM lg WHERE NOT ({DENIED})")

# ------------------------------------------------------------------ verification
add("field_checks", lambda s, d: checked(s, d).select("cell_id", "channel", "field", "passed"), CHECKS + "SELECT * FROM ck")
add("field_counters", lambda s, d: Y.field_counters(checked(s, d)), CHECKS + "SELECT * FROM fc")
add("fail_samples", lambda s, d: Y.fail_samples(checked(s, d)).select("channel", "field", "cell_id", "nth"), CHECKS + """SELECT channel, field, cell_id, CAST(row_number() OVER (PARTITION BY channel, field ORDER BY cell_id) AS INT) AS nth
 FROM ck WHERE NOT passed QUALIFY row_number() OVER (PARTITION BY channel, field ORDER BY cell_id) <= 3""")
add("run_verdict", lambda s, d: Y.run_verdict(Y.field_counters(checked(s, d))), CHECKS + f"""SELECT count(*) AS n_counters, {R('min(n_pass / nullif(n_pass + n_fail, 0))', 'worst_rate')}, 0 AS n_unchecked_critical, {VERD} AS verdict FROM fc""")
add("channel_verdicts", lambda s, d: Y.settle(Y.field_counters(checked(s, d)).groupBy("channel").agg(
    F.min(F.try_divide("n_pass", F.col("n_pass") + F.col("n_fail"))).alias("worst")).select(
    "channel", F.when(F.col("worst") >= 0.95, "GREEN").when(F.col("worst") >= 0.8, "YELLOW").otherwise("RED").alias("local_verdict"),
    F.when(F.col("channel").isin("PROMO", "LARGE"), "GREEN").alias("report_verdict"))), CHECKS + f""", z AS (SELECT channel, {VERD} AS local_verdict, CASE WHEN channel IN ('PROMO','LARGE') THEN 'GREEN' END AS report_verdict FROM fc GROUP BY channel)
SELECT *, local_verdict AS final_verdict, coalesce(report_verdict <> local_verdict, false) AS refused FROM z""")
add("truth_rows", lambda s, d: Y.truth_rows(joined_cells(s, d)).select("cell_id", "channel", "exp_rate"), CHECKS + f"""SELECT cell_id, channel, {R('exp_rate')} FROM v WHERE report_verdict = 'PASS'
 AND cell_id NOT IN (SELECT cell_id FROM ck WHERE NOT passed)""")


def runs(s, d):
    """One verification run per log minute bucket: RED when it holds very many errors."""
    return fx.load(s, d, "cell_log").groupBy(F.col("arrival").alias("day")).agg(
        F.unix_date("day").cast("bigint").alias("seq"), F.avg((F.col("kind") == "extract_failed").cast("double")).alias("share")).select(
        "seq", F.when(F.col("share") < 0.21, "GREEN").when(F.col("share") < 0.24, "YELLOW").otherwise("RED").alias("verdict"))


RUNS = fx.cte("cell_log") + """, w AS (SELECT CAST(date_diff('day', DATE '1970-01-01', arrival) AS BIGINT) AS seq, avg(CASE WHEN kind = 'extract_failed' THEN 1.0 ELSE 0.0 END) AS share FROM cell_log GROUP BY arrival)
, rn AS (SELECT seq, CASE WHEN share < 0.21 THEN 'GREEN' WHEN share < 0.24 THEN 'YELLOW' ELSE 'RED' END AS verdict FROM w)
"""
add("green_streak", lambda s, d: Y.green_streak(runs(s, d)), RUNS + "SELECT count(*) FILTER (WHERE seq > coalesce((SELECT max(seq) FROM rn WHERE verdict <> 'GREEN'), -1)) AS green_streak, count(*) AS n_runs FROM rn")
add("last_runs", lambda s, d: Y.last_runs(runs(s, d), 10), RUNS + "SELECT * FROM rn ORDER BY seq DESC LIMIT 10")

# ------------------------------------------------------------------ headline numbers
add("headline_kpis", lambda s, d: RP_.headline_kpis(PQ.verdicts(s, d), P.high_demand_days(PQ.demand(s, d)), PQ.parity(s, d), Q_.delta_summary(QQ.premium(s, d)), fx.SUBJECT, "A"),
    PQ.VERDICT.replace("WITH rate_panel AS", QQ.PREMIUM.rstrip() + "\n, rate_panel AS", 1) + PQ.DEMAND + PQ.PARITY[len(PQ.RP):] + f"""
, me AS (SELECT * FROM verdict WHERE property = '{fx.SUBJECT}'), one AS (SELECT median(delta_usd) AS m, count(*) AS n FROM prem WHERE pair = 'A')
SELECT kpi, unit, {R('value')}, label, CAST(n_used AS BIGINT) AS n_used FROM (
 SELECT 'verdict_label' AS kpi, 'categorical' AS unit, CAST(NULL AS DOUBLE) AS value, display_label AS label, n_rules_observed AS n_used FROM me
 UNION ALL SELECT 'days_high_demand_count', 'count', count(*) FILTER (WHERE market_demand_frac > 0.9), NULL, count(*) FROM dem
 UNION ALL SELECT 'demand_response_r_1a', 'pearson_r', r_1a, NULL, n_1a FROM me UNION ALL SELECT 'demand_response_r_1b', 'pearson_r', r_1b, NULL, n_1b FROM me
 UNION ALL SELECT 'demand_response_r_1b_levels', 'pearson_r', r_1b_levels, NULL, n_1b_levels FROM me
 UNION ALL SELECT 'dow_normalized_range_pct', 'pct', dow_range * 100, NULL, n_dow FROM me
 UNION ALL SELECT 'channel_gap_median_pct', 'pct', median_gap * 100, NULL, n_dates FROM gap WHERE property = '{fx.SUBJECT}'
 UNION ALL SELECT 'view_premium_observed_usd', 'usd', m, NULL, n FROM one UNION ALL SELECT 'view_premium_claimed_usd', 'usd', 0, NULL, 0) z""")
_from = lambda name: f"({PQ.Q[name][1]})"
INVARIANTS = [
    ("comp_verdicts", "correlation_bound", "max(greatest(abs(coalesce(r_1a, 0)), abs(coalesce(r_1b, 0)), abs(coalesce(r_1b_levels, 0))))", "<= 1.0 + 1e-9"),
    ("comp_verdicts", "weekly_range_min", "min(dow_range)", ">= 0"),
    (None, "panel_rows", "count(*)", ">= 1500"), (None, "panel_dates", "count(DISTINCT arrival_date)", ">= 360"),
    ("compression", "compression_rows", "count(*)", "BETWEEN 1 AND 60"), ("compression", "demand_min", "min(market_demand_frac)", ">= 0"), ("compression", "demand_max", "max(market_demand_frac)", "<= 1"),
    ("compression", "percent_min", "min(least(subject_pct, peer_pct))", ">= -1.0"), ("compression", "percent_max", "max(greatest(subject_pct, peer_pct))", "<= 5.0"),
    ("series_profile", "subject_mean_pct", f"max(CASE WHEN property = '{fx.SUBJECT}' THEN mean_pct END)", "BETWEEN -0.15 AND 0.15"),
    ("series_profile", "subject_p95_pct", f"max(CASE WHEN property = '{fx.SUBJECT}' THEN p95_pct END)", "<= 1.30"),
    ("series_profile", "subject_plateau_dates", f"max(CASE WHEN property = '{fx.SUBJECT}' THEN n_on_plateau END)", ">= 150"),
    ("series_profile", "peers_p95_over_25", f"count(*) FILTER (WHERE property <> '{fx.SUBJECT}' AND p95_pct >= 0.25)", ">= 3"),
    ("yield_composite", "diagnostic_dates", "count(*) FILTER (WHERE peer_median_pct - subject_pct >= 0.20)", ">= 30"),
    ("explorer_profile", "cells_per_property", "min(n)", ">= 200")]


def checked_results(spark, d):
    """The pass table, all of it from the counted panel; the yield series, which three checks read, is stored."""
    days = PQ.days(spark, d)
    rows = PQ.day_rows(days)
    yields = stored(S.yield_series(P.first_series(rows, PQ.KEY)), "yields")
    return RP_.invariants(days, PQ.day_verdicts(days), PQ.day_compression(days), S.series_profile(yields), P.explorer_profile(rows, D.N_ROWS),
                          S.yield_composite(yields, fx.SUBJECT), fx.SUBJECT, weight=D.N_ROWS)


add("invariants", checked_results, "SELECT q.check_name AS \"check\", (round(v, 6) + 0.0) AS value, coalesce(ok, true) AS ok FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS check_name, CAST({value} AS DOUBLE) AS v, CAST({value} AS DOUBLE) {test} AS ok FROM " + (_from(query) if query else f"({fx.cte('rate_panel')} SELECT * FROM rate_panel)") + " z"
    for query, name, value, test in INVARIANTS) + ") q")
