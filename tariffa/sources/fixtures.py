"""The panel shapes as SQL views over the driver tables.

Each text runs unchanged in Spark and in DuckDB. `load` reads the tables it needs and
registers nothing: it returns the view as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROPERTIES = tuple(f"NATION_{i}" for i in range(25))
SUBJECT = "NATION_7"
PEERS = tuple(p for p in PROPERTIES if p != SUBJECT)
CHANNELS = ("direct", "hotels_com", "booking")
ROW_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

_DAY_CODE = "(extract(year FROM l_shipdate)*372 + extract(month FROM l_shipdate)*31 + extract(day FROM l_shipdate))"
_STAY = "CASE l_linenumber % 3 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 7 END"

RATE_PANEL = f"""
SELECT CAST(o_orderdate AS DATE) AS as_of_date, CAST(l_shipdate AS DATE) AS arrival_date, n_name AS property,
       CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'brandcom'
            WHEN o_orderpriority IN ('3-MEDIUM','4-NOT SPECIFIED') THEN 'bookingcom' ELSE 'expedia' END AS source,
       CASE WHEN p_type IN ('STANDARD','SMALL') THEN 'standard'
            WHEN p_type IN ('MEDIUM','LARGE') THEN 'premium' ELSE 'suite' END AS room_tier,
       {_STAY} AS length_of_stay_nights,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'sold_out'
            WHEN l_discount >= 0.1 THEN 'not_loaded'
            WHEN l_tax = 0 THEN 'los_restricted' ELSE 'available' END AS availability_status,
       CASE WHEN (l_returnflag = 'R' AND l_linestatus = 'F') OR l_discount >= 0.1 OR l_tax = 0
            THEN NULL ELSE p_retailprice * (1 - l_discount) END AS rate_usd,
       CASE WHEN NOT (l_returnflag = 'R' AND l_linestatus = 'F') AND l_discount < 0.1 AND l_tax = 0
            THEN 2 + l_linenumber % 3 END AS los_restriction,
       CASE WHEN extract(day FROM l_shipdate) % 6 = 0 THEN NULL
            ELSE CAST(({_DAY_CODE}*37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS market_demand_frac,
       CAST(({_DAY_CODE}*53 + 11) % 97 AS DOUBLE) / CAST(96 AS DOUBLE) AS market_otb_frac,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
"""

QUOTES = f"""
SELECT CAST(o_orderdate AS DATE) AS arrival_date, n_name AS property_id,
       CASE l_returnflag WHEN 'A' THEN 'direct' WHEN 'N' THEN 'hotels_com' ELSE 'booking' END AS channel,
       {_STAY} AS nights, p_type AS marketing_name, p_brand AS sub_code,
       CASE l_linenumber WHEN 1 THEN 'Pay Now and Save' WHEN 2 THEN 'Best Rate - Free cancellation'
            WHEN 3 THEN 'Standard Rate' WHEN 4 THEN 'Advance Purchase + Parking'
            WHEN 5 THEN 'Visa Offer' WHEN 6 THEN 'Fully refundable, includes breakfast'
            ELSE 'Genius member' END AS rate_plan_label,
       CASE WHEN l_linenumber IN (1,4) THEN 'Non-refundable'
            WHEN l_linenumber IN (2,6) THEN 'Free cancellation' END AS cancellation_phrase,
       p_retailprice * (1 - l_discount) AS rate_per_night_usd,
       p_retailprice * (1 - l_discount) * (1 + l_tax) * {_STAY} AS total_stay_usd,
       (l_linenumber = 7) AS is_genius_member_rate,
       (l_quantity >= 45) AS mapped_ada,
       CASE WHEN l_linenumber = 5 THEN p_retailprice * CAST(1.25 AS DOUBLE) END AS strikethrough_orig_rate,
       CASE WHEN l_linestatus = 'O' THEN 'ok' ELSE 'non_bar_rate' END AS status,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
"""

_SHEET_CELLS = f"""SELECT arrival_date, property, market_demand_frac,
             CASE WHEN l_orderkey % 29 = 0 THEN 'Mystery'
                  WHEN l_orderkey % 31 = 0 THEN ' NO FLEX '
                  WHEN l_orderkey % 37 = 0 THEN '0'
                  WHEN l_orderkey % 41 = 0 THEN 'Room n/a'
                  WHEN availability_status = 'sold_out' THEN 'Sold out'
                  WHEN availability_status = 'not_loaded' THEN '--'
                  WHEN availability_status = 'los_restricted' THEN concat('LOS', los_restriction)
                  ELSE CAST(CAST(floor(rate_usd) AS INT) AS STRING) END AS cell
      FROM ({RATE_PANEL}) p"""

SHEET_WIDE = """
SELECT arrival_date, max(market_demand_frac) AS market_demand,
       """ + ",\n       ".join(
    f"max(CASE WHEN property = '{p}' THEN cell END) AS c{i}" for i, p in enumerate(PROPERTIES)) + f"""
FROM ({_SHEET_CELLS}) x
GROUP BY arrival_date
"""

PAGE_TEXT = """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'booking' ELSE 'hotels_com' END AS channel,
       source AS property_id,
       concat(CASE doc_id % 9
         WHEN 0 THEN 'Access Denied. '
         WHEN 1 THEN '404 Not Found. '
         WHEN 2 THEN 'Grand Hotel: we have no availability here between these dates. '
         WHEN 3 THEN 'no availability '
         WHEN 4 THEN 'Visa offer up to 10pct off. Pay now and save up to 15pct. $1,234 nightly '
         WHEN 5 THEN '15% off and a reduced weekly rate. $348Reserve '
         WHEN 6 THEN 'Sign in to see member prices. Showing 5 of 6 rooms. $295 '
         WHEN 7 THEN 'Weekly rate - $1,900.50 you get a reduced weekly rate. Non-refundable 1234 and 2026 rooms '
         ELSE '' END, text) AS markdown,
       CAST(200 + (doc_id * 37) % 400 AS INT) AS claimed_rate
FROM documents
"""

CELL_LOG = """
SELECT event_id, ts, concat('P', user_id % 25) AS property,
       CASE user_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'booking' ELSE 'hotels_com' END AS channel,
       CAST(ts AS DATE) AS arrival, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 7 END AS los,
       CASE event_type WHEN 'error' THEN 'extract_failed' WHEN 'signup' THEN 'no_inventory'
            WHEN 'purchase' THEN 'bot_blocked' WHEN 'view' THEN 'FAIL_NO_BAR_FLEX' ELSE 'ok' END AS kind,
       CASE WHEN user_id % 3 = 2 THEN 25 ELSE 5 END AS credits
FROM events
"""

VERIFY_CELLS = """
SELECT p_partkey AS cell_id, p_type AS channel, p_retailprice AS exp_rate,
       p_retailprice * (CAST(100 + (p_partkey * 7) % 9 - 4 AS DOUBLE) / CAST(100 AS DOUBLE)) AS act_rate,
       p_brand AS exp_name, CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE p_brand END AS act_name,
       (p_size > 10) AS exp_promo_asserted,
       CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS exp_promo_pct,
       CASE WHEN p_size > 45 THEN 1 WHEN p_size > 40 THEN NULL ELSE p_size END AS act_promo_pct,
       CASE WHEN p_partkey % 11 = 0 THEN 'FAIL' ELSE 'PASS' END AS report_verdict
FROM part
"""

#: How Spark lays the sheet out: the largest cell of a property and date as a number, which hash aggregation keeps in place. So rows go no further
#: than the task that joined them; a largest text would sort every row, and distinct cells would be shuffled, of which there are almost as many as rows.
#: The number has the byte order of the texts: its kind, then for whole numbers the digits from the left and how many they are.
_WORDS = {0: " NO FLEX ", 1: "--", 2: "-", 3: "", 4: "LOS", 5: "Mystery", 6: "Room n/a", 7: "Sold out"}  # kinds 2 to 4 go on with digits
_KIND = 1 << 40


def _digits(v: str) -> str:
    n = f"length(CAST({v} AS STRING))"
    return f"CAST({v} AS BIGINT) * CAST(substr('10000000000', 1, 11 - {n}) AS BIGINT) * 16 + {n}"


#: Rows are narrowed before they are joined: the key of a cell that needs no price, else the discount. The price comes with the first join.
_NARROW = f"""SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS arrival_date,
             CASE WHEN l_orderkey % 29 = 0 THEN {5 * _KIND}
                  WHEN l_orderkey % 31 = 0 THEN 0
                  WHEN l_orderkey % 37 = 0 THEN {3 * _KIND} + {_digits("0")}
                  WHEN l_orderkey % 41 = 0 THEN {6 * _KIND}
                  WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN {7 * _KIND}
                  WHEN l_discount >= 0.1 THEN {_KIND}
                  WHEN l_tax = 0 THEN CASE WHEN NOT (l_returnflag = 'R' AND l_linestatus = 'F') AND l_discount < 0.1
                       THEN {4 * _KIND} + {_digits("(2 + l_linenumber % 3)")} END END AS k,
             CASE WHEN NOT coalesce((l_returnflag = 'R' AND l_linestatus = 'F') OR l_discount >= 0.1 OR l_tax = 0, false) THEN l_discount END AS discount
FROM lineitem
"""
_CELL_KEYS = f"""SELECT l_orderkey, l_suppkey, arrival_date, CASE WHEN k IS NOT NULL THEN k
                  WHEN price < 0 THEN {2 * _KIND} + {_digits("abs(CAST(price AS BIGINT))")}
                  ELSE {3 * _KIND} + {_digits("price")} END AS k
      FROM (SELECT l_orderkey, l_suppkey, arrival_date, k, CASE WHEN k IS NULL THEN CAST(floor(p_retailprice * (1 - discount)) AS INT) END AS price
            FROM ({_NARROW}) n
            JOIN part ON l_partkey = p_partkey) p"""
_JOINED_KEYS = f"""SELECT arrival_date, n_name AS property, max(k) AS k FROM ({_CELL_KEYS}) c
JOIN orders ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
GROUP BY arrival_date, n_name"""
_FEW_CELLS = f"""SELECT arrival_date, property, CASE WHEN extract(day FROM arrival_date) % 6 = 0 THEN NULL
                  ELSE CAST(({_DAY_CODE.replace("l_shipdate", "arrival_date")}*37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS market_demand_frac,
             concat(CASE k div {_KIND} {" ".join(f"WHEN {i} THEN '{w}'" for i, w in _WORDS.items())} END,
             CASE WHEN k div {_KIND} BETWEEN 2 AND 4 THEN CAST(k % {_KIND} div 16 div CAST(substr('10000000000', 1, 11 - CAST(k % 16 AS INT)) AS BIGINT) AS STRING) ELSE '' END) AS cell
FROM ({_JOINED_KEYS}) d"""
STEPS = {"sheet_wide": SHEET_WIDE.replace(_SHEET_CELLS, _FEW_CELLS)}

VIEWS = {
    "rate_panel": (RATE_PANEL, ("lineitem", "orders", "part", "supplier", "nation")),
    "quotes": (QUOTES, ("lineitem", "orders", "part", "supplier", "nation")),
    "sheet_wide": (SHEET_WIDE, ("lineitem", "orders", "part", "supplier", "nation")),
    "page_text": (PAGE_TEXT, ("documents",)),
    "cell_log": (CELL_LOG, ("events",)),
    "verify_cells": (VERIFY_CELLS, ("part",)),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, tables = VIEWS[name]
    sql = STEPS.get(name, sql)
    for t in tables:
        sql = sql.replace(f"FROM {t}\n", f"FROM {{{t}}}\n").replace(f"JOIN {t} ON", f"JOIN {{{t}}} ON")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def cte(*names: str) -> str:
    """`WITH` clause that defines the named views, for plain SQL engines."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][0]})" for n in names) + "\n"
