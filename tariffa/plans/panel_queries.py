"""Registered panel queries with the same result in plain SQL."""

from __future__ import annotations

from tariffa.operators import panel as P, price_days as D, series as S, spread as X, verdicts as V
from tariffa.plans.common import R, rounded
from tariffa.sources import fixtures as fx
from pyspark.sql import functions as F

KEY = list(fx.ROW_KEY)
K = ", ".join(KEY)
RP = fx.cte("rate_panel")
AVAIL = "availability_status = 'available' AND rate_usd IS NOT NULL"
SUBJECT = fx.SUBJECT
DEMAND_SOURCE = "brandcom"
QUARTERS = (("Q1", "1995-01-01", "1996-06-30"), ("Q2", "1996-07-01", "1998-03-31"),
            ("Q3", "1998-04-01", "2000-06-30"), ("Q4", "2000-07-01", "2002-12-31"))
LABELS = {f"NATION_{i}": f"Hotel {i}" for i in range(0, 25, 2)}


def panel(spark, d):
    return fx.load(spark, d, "rate_panel")


def rows(spark, d):
    return P.panel_slice(panel(spark, d))


def demand(spark, d):
    return P.demand_series(P.panel_slice(panel(spark, d), source=DEMAND_SOURCE, available=False), KEY)


def series(spark, d):
    return P.median_series(rows(spark, d))


def yields(spark, d):
    return S.yield_series(P.first_series(rows(spark, d), KEY))


def spread(spark, d):
    return X.spread_rows(rows(spark, d), SUBJECT, fx.PEERS, ("length_of_stay_nights", *KEY))


def audit(spark, d):
    return X.audit_grid(spread(spark, d), panel(spark, d), fx.PEERS, KEY)


def days(spark, d):
    """The panel as one small table with counts; a query calls it once and takes all its parts from it."""
    return D.counted(panel(spark, d), KEY)


def day_rows(days):
    return P.panel_slice(days)


def day_verdicts(days):
    return V.rm_verdicts(days, KEY, D.N_ROWS)


def day_spread(days):
    return X.spread_rows(day_rows(days), SUBJECT, fx.PEERS, ("length_of_stay_nights", *KEY), D.N_ROWS)


def day_compression(days):
    demand = P.demand_series(P.panel_slice(days, source=DEMAND_SOURCE, available=False), KEY)
    return X.compression(day_rows(days), demand, SUBJECT, fx.PEERS, KEY, weight=D.N_ROWS)


def day_sensitivity(days, min_peers=12):
    spread = day_spread(days)
    return X.audit_sensitivity(spread, X.audit_grid(spread, days, fx.PEERS, KEY, D.N_ROWS), min_peers, D.N_ROWS)


def day_recheck(days):
    return X.recheck(day_rows(days), day_spread(days), SUBJECT, fx.PEERS, ["length_of_stay_nights", *KEY], weight=D.N_ROWS)


def compression(spark, d):
    return day_compression(days(spark, d))


def stretches(spark, d):
    return S.flat_stretches(rows(spark, d), SUBJECT)


# ------------------------------------------------------------------ SQL parts
STATUS = ", ".join(f"count(*) FILTER (WHERE availability_status = '{s}') AS {s}" for s in (
    "sold_out", "los_restricted", "room_na", "blank", "not_loaded", "no_flex", "third_party_only", "one_guest_only"))
OTHER = "count(*) FILTER (WHERE availability_status NOT IN ('available','blank','sold_out','no_flex','room_na','not_loaded','third_party_only','one_guest_only','los_restricted')) AS other"
AV = RP + f", av AS (SELECT * FROM rate_panel WHERE {AVAIL})\n"
MED = AV + ", s AS (SELECT property, arrival_date, median(rate_usd) AS rate_usd FROM av GROUP BY ALL)\n"
FIRST = AV + f""", s AS (SELECT property, arrival_date, rate_usd FROM av
 QUALIFY row_number() OVER (PARTITION BY property, arrival_date ORDER BY length_of_stay_nights, {K}) = 1)
"""


def run_sql(source="s", keys="property", step="0.05", prefix=""):
    """CTEs that number the runs of a series and summarise them."""
    return f""", {prefix}lagged AS (SELECT *, lag(rate_usd) OVER (PARTITION BY {keys} ORDER BY arrival_date) AS prev FROM {source})
, {prefix}broken AS (SELECT *, CASE WHEN prev IS NULL OR prev = 0 OR abs(rate_usd - prev) / abs(prev) >= {step} THEN 1 ELSE 0 END AS brk FROM {prefix}lagged)
, {prefix}numbered AS (SELECT *, sum(brk) OVER (PARTITION BY {keys} ORDER BY arrival_date) AS run FROM {prefix}broken)
, {prefix}runs AS (SELECT {keys}, run, min(arrival_date) AS start_date, max(arrival_date) AS end_date, count(*) AS n_obs,
    median(rate_usd) AS median_usd, date_diff('day', min(arrival_date), max(arrival_date)) + 1 AS span_days FROM {prefix}numbered GROUP BY {keys}, run)
"""


def base_sql(source, smooth, out, extra=""):
    """CTEs of the weekday baseline frame of a series table with (property, arrival_date, rate_usd)."""
    return run_sql(source, "property", "0.05", f"{out}_") + f""", {out}_marked AS (
  SELECT n.property, n.arrival_date, n.rate_usd, isodow(n.arrival_date) - 1 AS wd, (r.n_obs >= 10 AND r.span_days >= 10) AS on_plateau
  FROM {out}_numbered n JOIN {out}_runs r USING (property, run))
, {out}_based AS (SELECT *, median(rate_usd) OVER (PARTITION BY property, wd) AS baseline_usd FROM {out}_marked)
, {out}_pct AS (SELECT *, CASE WHEN on_plateau THEN 0.0 ELSE (rate_usd - baseline_usd) / nullif(baseline_usd, 0) END AS pct FROM {out}_based)
, {out} AS (SELECT *, avg(pct) OVER (PARTITION BY property ORDER BY arrival_date ROWS BETWEEN {smooth - 1} PRECEDING AND CURRENT ROW) AS pct_smoothed FROM {out}_pct)
"""


YIELD = FIRST + base_sql("s", 7, "y")
COMPOSITE = YIELD + f""", comp AS (SELECT arrival_date, max(pct_smoothed) FILTER (WHERE property = '{SUBJECT}') AS subject_pct,
  median(pct_smoothed) FILTER (WHERE property <> '{SUBJECT}') AS peer_median_pct, min(pct_smoothed) FILTER (WHERE property <> '{SUBJECT}') AS peer_min_pct,
  max(pct_smoothed) FILTER (WHERE property <> '{SUBJECT}') AS peer_max_pct, count(*) FILTER (WHERE property <> '{SUBJECT}') AS n_peers FROM y GROUP BY arrival_date)
"""
DEMAND = f""", dem AS (SELECT arrival_date, strftime(arrival_date, '%a') AS dow, market_demand_frac, market_otb_frac FROM rate_panel
 WHERE source = '{DEMAND_SOURCE}' QUALIFY row_number() OVER (PARTITION BY arrival_date ORDER BY length_of_stay_nights, {K}) = 1)
"""
SPREAD = AV + f""", peers AS (SELECT arrival_date, median(rate_usd) AS peer_median_usd, count(*) AS n_peers FROM av WHERE property <> '{SUBJECT}' GROUP BY ALL)
, sp AS (SELECT a.*, p.peer_median_usd, coalesce(p.n_peers, 0) AS n_peers, a.rate_usd - p.peer_median_usd AS delta_usd,
   CASE WHEN market_demand_frac < 0.5 THEN 'normal' WHEN market_demand_frac < 0.8 THEN 'shoulder' ELSE 'high' END AS bucket
   FROM av a LEFT JOIN peers p USING (arrival_date) WHERE property = '{SUBJECT}' AND market_demand_frac IS NOT NULL)
"""
PEER_LIST = ", ".join(f"'{p}'" for p in fx.PEERS)
AUDIT = SPREAD + f""", hd AS (SELECT arrival_date, count(*) AS n_rows FROM sp WHERE bucket = 'high' GROUP BY ALL)
, st AS (SELECT property, arrival_date, availability_status, rate_usd FROM rate_panel QUALIFY row_number() OVER (
    PARTITION BY property, arrival_date ORDER BY (CASE WHEN availability_status = 'available' THEN 0 ELSE 1 END), length_of_stay_nights, {K}) = 1)
, grid AS (SELECT h.arrival_date, h.n_rows, p.property, coalesce(s.availability_status, 'absent_row') AS availability_status, s.rate_usd
    FROM hd h CROSS JOIN (SELECT unnest([{PEER_LIST}]) AS property) p LEFT JOIN st s ON s.property = p.property AND s.arrival_date = h.arrival_date)
, sizes AS (SELECT arrival_date, n_rows, count(*) FILTER (WHERE availability_status = 'available') AS n_included FROM grid GROUP BY ALL)
"""
COMPRESSION = AV + DEMAND + f""", s1 AS (SELECT property, arrival_date, rate_usd FROM av WHERE property = '{SUBJECT}'
 QUALIFY row_number() OVER (PARTITION BY arrival_date ORDER BY length_of_stay_nights, {K}) = 1)
, s2 AS (SELECT 'peers' AS property, arrival_date, median(rate_usd) AS rate_usd FROM av WHERE property <> '{SUBJECT}' GROUP BY ALL)
""" + base_sql("s1", 1, "b1") + base_sql("s2", 1, "b2") + """, cmp AS (
 SELECT d.arrival_date, d.market_demand_frac, b1.rate_usd AS subject_rate_usd, b1.baseline_usd AS subject_baseline_usd, b1.pct AS subject_pct,
   coalesce(b1.on_plateau, false) AS subject_on_plateau, b2.rate_usd AS peer_rate_usd, b2.baseline_usd AS peer_baseline_usd, b2.pct AS peer_pct,
   coalesce(b2.on_plateau, false) AS peer_on_plateau
 FROM (SELECT * FROM dem WHERE market_demand_frac IS NOT NULL ORDER BY market_demand_frac DESC, arrival_date LIMIT 60) d
 LEFT JOIN b1 USING (arrival_date) LEFT JOIN b2 USING (arrival_date))
"""


def corr_sql(metric, lo, n):
    ok = f"({AVAIL} AND {metric} IS NOT NULL)"
    x, y = f"CASE WHEN {ok} THEN rate_usd END", f"CASE WHEN {ok} THEN {metric} END"
    return f"""SELECT property, count(*) AS n_total, count(*) FILTER (WHERE {ok}) AS n_used,
  covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0) AS r, {STATUS}, {OTHER} FROM rate_panel GROUP BY property"""


def corr_out(name, lo, n, cols="*"):
    return f"SELECT {cols}, coalesce(r > {lo}, false) AS passes, (r IS NULL OR n_used < {n}) AS low_power FROM {name}"


DIFFS = f""", seqd AS (SELECT property, arrival_date, rate_usd, market_otb_frac AS m,
   lag(arrival_date) OVER w AS pd, lag(rate_usd) OVER w AS pr, lag(market_otb_frac) OVER w AS pm FROM rate_panel
   WHERE {AVAIL} AND market_otb_frac IS NOT NULL WINDOW w AS (PARTITION BY property ORDER BY arrival_date, length_of_stay_nights, {K}))
, pairs AS (SELECT property, rate_usd - pr AS dr, m - pm AS dm FROM seqd WHERE date_diff('day', pd, arrival_date) = 1)
, dif0 AS (SELECT property, count(*) AS n_used, covar_samp(dr, dm) / nullif(stddev_samp(dr) * stddev_samp(dm), 0) AS r FROM pairs GROUP BY property)
, dif1 AS (SELECT property, count(*) AS n_total, {STATUS}, {OTHER} FROM rate_panel GROUP BY property)
, dif AS (SELECT t.*, coalesce(d.n_used, 0) AS n_used, d.r FROM dif1 t LEFT JOIN dif0 d USING (property))
"""
WEEKS = f""", wk AS (SELECT property, isoyear(arrival_date) AS y, weekofyear(arrival_date) AS w, count(DISTINCT isodow(arrival_date)) AS nd, count(*) AS n,
   CASE WHEN avg(rate_usd) > 0 THEN (max(rate_usd) - min(rate_usd)) / avg(rate_usd) END AS ratio FROM rate_panel WHERE {AVAIL} GROUP BY ALL)
, rl AS (SELECT *, CASE WHEN count(ratio) OVER f >= 2 THEN avg(ratio) OVER f END AS rolling FROM wk
   WINDOW f AS (PARTITION BY property ORDER BY y, w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
, wv AS (SELECT property, median(rolling) AS value, count(*) FILTER (WHERE nd >= 5) AS n_full_weeks, CAST(sum(n) AS BIGINT) AS n_used FROM rl GROUP BY property)
, wr AS (SELECT t.property, count(*) AS n_total, {STATUS}, {OTHER} FROM rate_panel t GROUP BY t.property)
"""
VERDICT = RP + f", c1a AS ({corr_sql('market_demand_frac', 0.3, 30)}), cbl AS ({corr_sql('market_otb_frac', 0.2, 100)})" + DIFFS + WEEKS + """
, ver AS (SELECT a.property, a.r AS r_1a, b.r AS r_1b, l.r AS r_1b_levels, wv.value AS dow_range, a.n_used AS n_1a, b.n_used AS n_1b, l.n_used AS n_1b_levels,
  coalesce(wv.n_used, 0) AS n_dow, coalesce(a.r > 0.3, false) AND coalesce(b.r > 0.1, false) AS rule1_pass, coalesce(wv.value > 0.1, false) AS rule2_pass
  FROM c1a a JOIN dif b USING (property) JOIN cbl l USING (property) LEFT JOIN wv USING (property))
, verd AS (SELECT *, CAST(rule1_pass AS INT) + CAST(rule2_pass AS INT) AS n_rules_passed, 1 AS n_rules_skipped, 2 AS n_rules_observed,
  CASE WHEN NOT rule1_pass AND NOT rule2_pass THEN 'STATIC' ELSE 'PARTIALLY_DYNAMIC' END AS classification FROM ver)
, verdict AS (SELECT *, classification || ' (' || n_rules_passed || ' of 2 observed; 1 skipped; lead-time n/a)' AS display_label,
  coalesce(r_1a, 0) + coalesce(r_1b, 0) + coalesce(dow_range, 0) AS composite FROM verd)
"""

Q = {}


def add(name, fn, sql=None):
    Q[name] = (lambda spark, d, fn=fn: rounded(fn(spark, d)), sql)


# ------------------------------------------------------------------ direct reports
add("status_breakdown", lambda s, d: P.status_breakdown(panel(s, d)),
    RP + f"SELECT property, count(*) AS n_total, {STATUS}, {OTHER} FROM rate_panel GROUP BY property")
add("ingest_counts", lambda s, d: P.ingest_counts(panel(s, d)), RP + """
SELECT 'status' AS what, availability_status AS name, count(*) AS n FROM rate_panel GROUP BY ALL
UNION ALL SELECT availability_status || '_by_property', property, count(*) FROM rate_panel WHERE availability_status IN ('not_loaded','sold_out') GROUP BY ALL
UNION ALL SELECT 'length_of_stay', CAST(length_of_stay_nights AS VARCHAR), count(*) FROM rate_panel GROUP BY ALL""")
add("panel_slice", lambda s, d: P.rate_lines(P.panel_slice(panel(s, d), "brandcom", ["standard", "premium"])),
    AV + "SELECT property, arrival_date, " + R("rate_usd") + " FROM av WHERE source = 'brandcom' AND room_tier IN ('standard','premium')")
add("median_series", series, MED + "SELECT property, arrival_date, " + R("rate_usd") + " FROM s")
add("first_series", lambda s, d: P.first_series(rows(s, d), KEY), FIRST + "SELECT property, arrival_date, " + R("rate_usd") + " FROM s")
add("peer_median", lambda s, d: X.peer_median(rows(s, d), fx.PEERS),
    SPREAD + "SELECT arrival_date, n_peers, " + R("peer_median_usd") + " FROM peers")
add("tier_position", lambda s, d: P.tier_position(rows(s, d)), AV + f"""SELECT property, room_tier, {R('avg(rate_usd)', 'mean_usd')},
 count(*) AS n, {R('median(rate_usd)', 'median_usd')} FROM av GROUP BY ALL""")
add("demand_series", demand, RP + DEMAND + "SELECT arrival_date, dow, " + R("market_demand_frac") + ", " + R("market_otb_frac") + " FROM dem")
add("high_demand_days", lambda s, d: P.high_demand_days(demand(s, d)),
    RP + DEMAND + "SELECT count(*) FILTER (WHERE market_demand_frac > 0.9) AS n_high, count(*) AS n_dates FROM dem")
add("populated_share", lambda s, d: P.populated_share(demand(s, d)), RP + DEMAND + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, count({m}) AS n_populated, count(*) AS n_dates, {R(f'count({m}) / count(*)', 'share')} FROM dem"
    for m in ("market_demand_frac", "market_otb_frac")))
add("top_dates", lambda s, d: P.top_dates(demand(s, d), 5), RP + DEMAND + f"""SELECT arrival_date, dow, {R('market_demand_frac')}, {R('market_otb_frac')} FROM dem
 WHERE market_demand_frac IS NOT NULL ORDER BY dem.market_demand_frac DESC, arrival_date LIMIT 5""")
add("month_starts", lambda s, d: P.month_starts(demand(s, d)), RP + DEMAND + """, m AS (SELECT CAST(date_trunc('month', arrival_date) AS DATE) AS month,
 min(arrival_date) AS first_date, count(*) AS n_dates FROM dem GROUP BY ALL)
SELECT month, first_date, n_dates, CAST(coalesce(sum(n_dates) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM m""")
add("dataset_meta", lambda s, d: P.dataset_meta(panel(s, d)), RP + """SELECT count(*) AS n_rows, min(as_of_date) AS first_as_of, count(DISTINCT property) AS n_properties FROM rate_panel""")
add("distinct_dates", lambda s, d: P.distinct_values(panel(s, d), "arrival_date"), RP + "SELECT DISTINCT arrival_date FROM rate_panel")
add("forbidden_rows", lambda s, d: P.forbidden_rows(panel(s, d), ["NATION_3", "park"]),
    RP + "SELECT property, count(*) AS n FROM rate_panel WHERE property IN ('NATION_3','park') GROUP BY ALL")
add("weekday_pattern", lambda s, d: P.weekday_pattern(rows(s, d)), AV + f"""SELECT property, isoyear(arrival_date) AS iso_year, weekofyear(arrival_date) AS iso_week,
 arrival_date, strftime(arrival_date, '%a') AS dow, {R('rate_usd')} FROM av""")
add("demand_scatter", lambda s, d: P.demand_scatter(rows(s, d)), AV + f"""SELECT property, arrival_date, {R('market_demand_frac', 'demand_frac')}, {R('rate_usd')}
 FROM av WHERE market_demand_frac IS NOT NULL""")
add("explorer_feed", lambda s, d: P.explorer_feed(rows(s, d), LABELS), AV + f"""SELECT arrival_date, strftime(arrival_date, '%a') AS dow,
 CASE WHEN CAST(replace(property, 'NATION_', '') AS INT) % 2 = 0 THEN replace(property, 'NATION_', 'Hotel ') ELSE property END AS property,
 {R('rate_usd')}, room_tier, 'direct' AS channel FROM av""")
add("explorer_profile", lambda s, d: P.explorer_profile(rows(s, d)), AV + f"""SELECT property, count(*) AS n, {R('min(rate_usd)', 'min_usd')}, {R('max(rate_usd)', 'max_usd')},
 count(DISTINCT arrival_date) AS n_dates, {R('median(rate_usd)', 'median_usd')} FROM av GROUP BY property""")
add("text_filter", lambda s, d: P.filter_text(rows(s, d).select("arrival_date", "property", "room_tier", "source"), "Nation_2"),
    AV + "SELECT arrival_date, property, room_tier, source FROM av WHERE contains(lower(property), 'nation_2')")
add("sorted_nulls_last", lambda s, d: P.sort_positions(panel(s, d).groupBy("property", "availability_status").agg(
    F.max("rate_usd").alias("rate_usd")), "rate_usd", True, ("property", "availability_status")),
    RP + f"SELECT property, availability_status, {R('m', 'rate_usd')}, row_number() OVER (ORDER BY m DESC NULLS LAST, property, availability_status) AS position FROM (SELECT property, availability_status, max(rate_usd) AS m FROM rate_panel GROUP BY ALL) q")
add("los_restrictions", lambda s, d: P.los_restrictions(panel(s, d)),
    RP + "SELECT arrival_date, property, CAST(los_restriction AS INT) AS los_restriction FROM rate_panel WHERE availability_status = 'los_restricted'")
add("los_grid", lambda s, d: P.los_grid(panel(s, d), fx.PROPERTIES), RP + "SELECT arrival_date, " + ", ".join(
    f"CAST(max(los_restriction) FILTER (WHERE property = '{p}') AS INT) AS {p}" for p in fx.PROPERTIES) +
    " FROM rate_panel WHERE availability_status = 'los_restricted' GROUP BY arrival_date")
add("tier_spread", lambda s, d: P.tier_spread(P.panel_slice(rows(s, d), properties=fx.PEERS)), AV + f""", m AS (SELECT arrival_date,
 median(rate_usd) FILTER (WHERE room_tier = 'standard') AS a, median(rate_usd) FILTER (WHERE room_tier = 'premium') AS b FROM av
 WHERE property <> '{SUBJECT}' AND room_tier IN ('standard','premium') GROUP BY arrival_date)
SELECT arrival_date, {R('a', 'standard_median_usd')}, {R('b', 'premium_median_usd')}, {R('b - a', 'spread_usd')} FROM m""")
PARITY = AV + f""", f AS (SELECT property, arrival_date, source, rate_usd FROM av WHERE source IN ('brandcom','bookingcom')
 QUALIFY row_number() OVER (PARTITION BY property, arrival_date, source ORDER BY length_of_stay_nights, {K}) = 1)
, p AS (SELECT property, arrival_date, max(rate_usd) FILTER (WHERE source = 'brandcom') AS a, max(rate_usd) FILTER (WHERE source = 'bookingcom') AS b FROM f GROUP BY ALL)
, gap AS (SELECT property, count(*) AS n_dates, median(abs(a - b) / least(a, b)) AS median_gap FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY property)
"""


def parity(s, d):
    return P.parity_gap(rows(s, d), "brandcom", "bookingcom", KEY)


add("parity_gap", parity, PARITY + "SELECT property, n_dates, " + R("median_gap") + " FROM gap")
add("quarter_lines", lambda s, d: P.quarter_lines(rows(s, d), QUARTERS), AV + ", q(panel, panel_start, panel_end) AS (VALUES " + ", ".join(
    f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in QUARTERS) + f""")
SELECT property, arrival_date, {R('rate_usd')}, panel, panel_start, panel_end FROM av JOIN q ON arrival_date BETWEEN panel_start AND panel_end""")
add("clipped_rates", lambda s, d: P.clipped(rows(s, d), 1000.0).select("property", "arrival_date", "rate_usd", "shown_usd", "is_clipped"),
    AV + f"SELECT property, arrival_date, {R('rate_usd')}, {R('least(rate_usd, 1000.0)', 'shown_usd')}, rate_usd > 1000 AS is_clipped FROM av")

# ------------------------------------------------------------------ flat runs and baselines
add("plateaus", lambda s, d: S.flat_runs(series(s, d)), MED + run_sql() + f"""SELECT property, start_date, end_date, n_obs, {R('median_usd')}, span_days
 FROM runs WHERE n_obs >= 10 AND span_days >= 10""")
FLAT = "n_obs >= 10 AND span_days >= 10"
add("flatness", lambda s, d: S.flatness(series(s, d), [*fx.PROPERTIES, "absent"]).drop("plateau_values_usd"), MED + run_sql() + f"""
, f AS (SELECT property, CAST(sum(n_obs) AS BIGINT) AS n_observed, CAST(coalesce(sum(n_obs) FILTER (WHERE {FLAT}), 0) AS BIGINT) AS n_on_plateau,
 coalesce(max(span_days) FILTER (WHERE {FLAT}), 0) AS longest_plateau_days, count(*) FILTER (WHERE {FLAT}) AS n_plateaus FROM runs GROUP BY property)
SELECT p.property, coalesce(n_observed, 0) AS n_observed, coalesce(n_on_plateau, 0) AS n_on_plateau, {R('n_on_plateau / n_observed', 'pct_flat')},
 coalesce(longest_plateau_days, 0) AS longest_plateau_days, coalesce(n_plateaus, 0) AS n_plateaus
FROM (SELECT unnest([{PEER_LIST}, '{SUBJECT}', 'absent']) AS property) p LEFT JOIN f USING (property)""")
add("plateau_values", lambda s, d: S.flatness(series(s, d)).select("property", F.posexplode(F.slice("plateau_values_usd", 1, 5)).alias("pos", "plateau_usd")),
    MED + run_sql() + f"""SELECT property, CAST(rn - 1 AS INT) AS pos, {R('median_usd', 'plateau_usd')} FROM (SELECT *, row_number() OVER (
 PARTITION BY property ORDER BY span_days DESC, start_date) AS rn FROM runs WHERE {FLAT}) z WHERE rn <= 5""")
COMBO_ROWS = (("default", 10, 0.05), ("tightened", 10, 0.03), ("loosened", 10, 0.10), ("longer", 14, 0.05))
add("flatness_combos", lambda s, d: S.flatness_combos(series(s, d), SUBJECT), MED + ", opt(combo, min_days, max_step) AS (VALUES " + ", ".join(
    f"('{a}', {b}, {c}::DOUBLE)" for a, b, c in COMBO_ROWS) + "), sc AS (SELECT s.*, opt.* FROM s CROSS JOIN opt)" + run_sql(
    "sc", "combo, min_days, max_step, property", "max_step") + f"""
, f AS (SELECT combo, property, CAST(sum(n_obs) AS BIGINT) AS n_observed, CAST(coalesce(sum(n_obs) FILTER (WHERE n_obs >= min_days AND span_days >= min_days), 0) AS BIGINT) AS n_on_plateau,
 coalesce(max(span_days) FILTER (WHERE n_obs >= min_days AND span_days >= min_days), 0) AS longest_plateau_days FROM runs GROUP BY combo, property)
, g AS (SELECT *, n_on_plateau / n_observed AS pf FROM f)
, h AS (SELECT combo, max(pf) FILTER (WHERE property = '{SUBJECT}') AS mine, median(pf) FILTER (WHERE property <> '{SUBJECT}') AS peers FROM g GROUP BY combo)
SELECT g.combo, property, n_observed, n_on_plateau, {R('pf', 'pct_flat')}, longest_plateau_days, {R('peers', 'peer_median_pct')},
 {R('CASE WHEN peers > 0 THEN mine / peers END', 'subject_ratio')}, coalesce(peers > 0 AND mine / peers >= 2, false) OR (coalesce(mine > 0, false) AND (peers IS NULL OR peers = 0)) AS combo_passes
FROM g JOIN h USING (combo)""")
add("flat_ceiling", lambda s, d: S.below_ceiling(S.flatness_combos(series(s, d), SUBJECT), ["NATION_1", "NATION_4"]), MED + run_sql("s", "property", "0.1") + f"""
, f AS (SELECT property, coalesce(sum(n_obs) FILTER (WHERE {FLAT}), 0) / sum(n_obs) AS pf FROM runs WHERE property IN ('NATION_1','NATION_4') GROUP BY property)
SELECT property, {R('pf', 'pct_flat')}, pf < 0.10 AS below FROM f""")
STRETCH = MED + ", own AS (SELECT * FROM s WHERE property = '" + SUBJECT + "')" + run_sql("own") + f"""
, fl AS (SELECT * FROM runs WHERE {FLAT})
, st AS (SELECT f.property, CAST(round_even(median_usd, 0) AS INT) AS rate_usd, start_date, end_date, span_days AS days, n_obs AS n_observed,
  (SELECT median(a.rate_usd) FROM av a WHERE a.property <> '{SUBJECT}' AND a.arrival_date BETWEEN f.start_date AND f.end_date) AS peer_median_during FROM fl f)
"""
add("flat_stretches", stretches, STRETCH + f"SELECT property, rate_usd, start_date, end_date, days, n_observed, {R('peer_median_during')} FROM st")
add("panel_overlap", lambda s, d: S.panel_overlap(stretches(s, d), P.quarter_lines(rows(s, d), QUARTERS)), STRETCH + ", q(panel, a, b) AS (VALUES " + ", ".join(
    f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in QUARTERS) + """)
, lab AS (SELECT DISTINCT panel, arrival_date FROM av JOIN q ON arrival_date BETWEEN a AND b)
SELECT panel, start_date, end_date, rate_usd, min(arrival_date) AS first_label, max(arrival_date) AS last_label
FROM st JOIN lab ON arrival_date BETWEEN start_date AND end_date GROUP BY ALL""")
add("dual_baseline", lambda s, d: S.dual_baseline(series(s, d), 1).select(
    "property", "arrival_date", "rate_usd", "baseline_usd", "on_plateau", "pct"), MED + base_sql("s", 1, "y") +
    f"SELECT property, arrival_date, {R('rate_usd')}, {R('baseline_usd')}, on_plateau, {R('pct')} FROM y")
add("yield_series", yields, YIELD + f"SELECT property, arrival_date, {R('rate_usd')}, {R('baseline_usd')}, on_plateau, {R('pct_smoothed', 'pct_above_baseline')} FROM y")
add("yield_composite", lambda s, d: S.yield_composite(yields(s, d), SUBJECT), COMPOSITE + f"""SELECT arrival_date, {R('subject_pct')}, {R('peer_median_pct')},
 {R('peer_min_pct')}, {R('peer_max_pct')}, n_peers FROM comp""")
add("diagnostic_dates", lambda s, d: S.diagnostic_dates(S.yield_composite(yields(s, d), SUBJECT), 0.02).select("arrival_date", "n_peers"),
    COMPOSITE + "SELECT arrival_date, n_peers FROM comp WHERE peer_median_pct - subject_pct >= 0.02")
PROFILE = YIELD + f""", rk AS (SELECT property, pct_smoothed AS v, row_number() OVER (PARTITION BY property ORDER BY pct_smoothed) AS rn, count(*) OVER (PARTITION BY property) AS n FROM y)
, prof AS (SELECT y.property, count(*) AS n, avg(pct_smoothed) AS mean_pct, median(pct_smoothed) AS median_pct, min(pct_smoothed) AS min_pct, max(pct_smoothed) AS max_pct,
 count(*) FILTER (WHERE on_plateau) AS n_on_plateau, max(rk.v) AS p95_pct FROM y JOIN rk ON rk.property = y.property AND rk.rn = CAST(round_even(0.95::DOUBLE * (rk.n - 1), 0) AS BIGINT) + 1 GROUP BY y.property)
"""
add("series_profile", lambda s, d: S.series_profile(yields(s, d)), PROFILE + f"""SELECT property, n, {R('mean_pct')}, {R('median_pct')}, {R('min_pct')}, {R('max_pct')}, n_on_plateau, {R('p95_pct')} FROM prof""")

# ------------------------------------------------------------------ rules and verdicts
ST_OUT = "property, n_total, n_used, " + R("r") + ", sold_out, los_restricted, room_na, blank, not_loaded, no_flex, third_party_only, one_guest_only, other"
add("corr_levels", lambda s, d: S.corr_levels(panel(s, d), "market_demand_frac", 0.3, 30),
    RP + f", c AS ({corr_sql('market_demand_frac', 0.3, 30)}) " + corr_out("c", 0.3, 30, ST_OUT))
add("corr_diffs", lambda s, d: S.corr_diffs(panel(s, d), "market_otb_frac", KEY, 0.1, 100), RP + DIFFS + corr_out("dif", 0.1, 100, ST_OUT))
add("weekly_range", lambda s, d: S.weekly_range(panel(s, d)), RP + WEEKS + f"""SELECT wr.*, {R('value')}, coalesce(n_full_weeks, 0) AS n_full_weeks, coalesce(n_used, 0) AS n_used,
 coalesce(value > 0.1, false) AS passes, (value IS NULL OR coalesce(n_full_weeks, 0) < 30) AS low_power FROM wr LEFT JOIN wv USING (property)""")


def verdicts(s, d):
    return V.rm_verdicts(panel(s, d), KEY)


add("rm_verdict", lambda s, d: verdicts(s, d).select(
    "property", "r_1a", "r_1b", "r_1b_levels", "dow_range", "n_1a", "n_1b", "n_1b_levels", "n_dow", "rule1_pass", "rule2_pass",
    "n_rules_passed", "n_rules_observed", "n_rules_skipped", "classification", "display_label"), VERDICT + f"""SELECT property, {R('r_1a')}, {R('r_1b')}, {R('r_1b_levels')},
 {R('dow_range')}, n_1a, n_1b, n_1b_levels, n_dow, rule1_pass, rule2_pass, n_rules_passed, n_rules_observed, n_rules_skipped, classification, display_label FROM verdict""")
add("comp_verdicts", lambda s, d: V.comp_verdicts(verdicts(s, d)), VERDICT + f"""SELECT property, classification, display_label, {R('r_1a')}, {R('r_1b')}, {R('r_1b_levels')}, {R('dow_range')},
 {R('composite')}, row_number() OVER (ORDER BY verdict.composite DESC, property) AS rank, rule1_pass, rule2_pass FROM verdict""")
add("median_range", lambda s, d: V.median_range(verdicts(s, d)), VERDICT + f"SELECT {R('median(dow_range)', 'median_dow_range')}, count(dow_range) AS n FROM verdict")

# ------------------------------------------------------------------ subject against peers
add("spread_rows", lambda s, d: spread(s, d).drop(*KEY), SPREAD + f"""SELECT arrival_date, {R('rate_usd')}, {R('market_demand_frac')}, length_of_stay_nights, n_peers,
 {R('peer_median_usd')}, {R('delta_usd')}, bucket FROM sp""")
add("spread_by_bucket", lambda s, d: X.spread_by_bucket(day_spread(days(s, d)), D.N_ROWS), SPREAD + f"""SELECT bucket, count(*) AS n_rows, count(delta_usd) AS n_deltas,
 count(DISTINCT arrival_date) AS n_dates, {R('median(delta_usd)', 'median_delta_usd')} FROM sp GROUP BY bucket""")
add("spread_headline", lambda s, d: X.spread_headline(day_spread(days(s, d)), D.N_ROWS).drop("label"), SPREAD + f""", h AS (SELECT median(delta_usd) FILTER (WHERE bucket = 'normal') AS a,
 median(delta_usd) FILTER (WHERE bucket = 'high') AS b, count(delta_usd) FILTER (WHERE bucket = 'normal') AS n_normal, count(delta_usd) FILTER (WHERE bucket = 'shoulder') AS n_shoulder,
 count(delta_usd) FILTER (WHERE bucket = 'high') AS n_high, count(DISTINCT arrival_date) FILTER (WHERE bucket = 'high') AS n_high_dates FROM sp)
SELECT {R('a', 'delta_typical_usd')}, {R('b', 'delta_high_usd')}, n_normal, n_shoulder, n_high, n_high_dates, {R('b - a', 'spread_movement_usd')},
 CASE WHEN n_high < 5 OR b - a IS NULL THEN 'INSUFFICIENT_DEMAND_WINDOW' WHEN b - a >= 50 THEN 'YIELDS_WITH_MARKET' WHEN abs(b - a) < 25 THEN 'ANCHORED'
 WHEN b - a <= -25 THEN 'ANTI_YIELDS' ELSE 'PARTIALLY_DYNAMIC' END AS classification FROM h""")
add("by_date_collapse", lambda s, d: X.collapse_dates(day_spread(days(s, d)), D.N_ROWS), SPREAD + f"""SELECT arrival_date, {R('min(market_demand_frac)', 'market_demand_frac')}, min(bucket) AS bucket, min(n_peers) AS n_peers,
 {R('median(rate_usd)', 'rate_usd')}, {R('median(peer_median_usd)', 'peer_median_usd')}, {R('median(delta_usd)', 'delta_usd')} FROM sp GROUP BY arrival_date""")
add("audit_grid", audit, AUDIT + f"SELECT arrival_date, n_rows, property, availability_status, {R('rate_usd')} FROM grid")
add("audit_dates", lambda s, d: X.audit_dates(audit(s, d)).select(
    "arrival_date", "n_rows", "n_included", F.array_join("included.property", ",").alias("included"),
    F.array_join(F.transform("excluded", lambda x: F.concat_ws(":", x["property"], x["availability_status"])), ",").alias("excluded")), AUDIT + """
SELECT arrival_date, n_rows, count(*) FILTER (WHERE availability_status = 'available') AS n_included,
 coalesce(string_agg(property, ',' ORDER BY property) FILTER (WHERE availability_status = 'available'), '') AS included,
 coalesce(string_agg(property || ':' || availability_status, ',' ORDER BY property) FILTER (WHERE availability_status <> 'available'), '') AS excluded FROM grid GROUP BY arrival_date, n_rows""")
add("audit_panel_sizes", lambda s, d: X.audit_panel_sizes(audit(s, d)), AUDIT + "SELECT n_included, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM sizes GROUP BY n_included")
add("audit_status_tally", lambda s, d: X.audit_status_tally(audit(s, d)), AUDIT + """SELECT availability_status, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM grid
 WHERE availability_status <> 'available' GROUP BY ALL""")
add("audit_sensitivity", lambda s, d: day_sensitivity(days(s, d)), AUDIT + f""", z AS (SELECT median(delta_usd) AS a, median(delta_usd) FILTER (WHERE n_included >= 12) AS b,
 count(delta_usd) AS n_asis, count(delta_usd) FILTER (WHERE n_included >= 12) AS n_full FROM sp JOIN sizes USING (arrival_date) WHERE bucket = 'high' AND delta_usd IS NOT NULL)
SELECT n_asis, n_full, {R('a', 'delta_high_asis')}, {R('b', 'delta_high_full')}, {R('b - a', 'shift_usd')} FROM z""")
CMP_COLS = f"""arrival_date, {R('market_demand_frac')}, {R('subject_rate_usd')}, {R('subject_baseline_usd')}, {R('subject_pct')}, subject_on_plateau,
 {R('peer_rate_usd')}, {R('peer_baseline_usd')}, {R('peer_pct')}, peer_on_plateau"""
add("compression", compression, COMPRESSION + f"SELECT {CMP_COLS} FROM cmp")
add("anti_yield", lambda s, d: X.anti_yield(compression(s, d), -0.01), COMPRESSION + f"SELECT {CMP_COLS} FROM cmp WHERE cmp.subject_pct < -0.01")
add("spread_recheck", lambda s, d: day_recheck(days(s, d)), SPREAD + f"""
, f AS (SELECT bucket, arrival_date, rate_usd, peer_median_usd, delta_usd FROM sp WHERE delta_usd IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY arrival_date, length_of_stay_nights, {K}) = 1)
SELECT bucket, arrival_date, {R('rate_usd')}, {R('peer_median_usd')}, {R('delta_usd')}, {R('peer_median_usd', 'again_peer_usd')}, {R('rate_usd', 'again_rate_usd')}, true AS matches FROM f""")
