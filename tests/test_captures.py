from pyspark.sql import functions as F

from tariffa import schemas
from tariffa.operators import captures as C, gates as G
from tariffa.plans import capture_queries as CQ

PAGE = """
### View all photos for Suite, 1 Bedroom

### Suite, 1 Bedroom

Non-Refundable
\\+ $0Reserve now, pay depositReserve now, pay deposit

Fully refundable before Sep 23
\\+ $163Reserve now, pay depositReserve now, pay deposit

Non-Refundable
\\+ $242Reserve now, pay laterReserve now, pay later

$348 nightly

The current price is $1,257 total

### Penthouse
Non-Refundable
\\+ $0Reserve now, pay later

price is $832 total

## Have a question?
$99 nightly
"""


def capture(spark, markdown, names, nights=1):
    rooms = [(n, None, None, None, None, [("Old", 1.0, None, None, None, None, None, None, None, None)]) for n in names]
    row = ("p", "hotels_com", None, nights, None, None, markdown, ("Grand Hotel", "", nights, rooms))
    return spark.createDataFrame([row], schemas.CAPTURE)


def test_tiers_replace_plans_of_rendered_rooms(spark):
    out = C.rewrite_tiers(capture(spark, PAGE, ["Suite, 1  bedroom", "Penthouse", "Absent"], 2)).first()
    suite, pent, absent = out.extract.rooms
    assert [(p.rate_per_night_usd, p.refundable, p.rate_plan_label) for p in suite.rate_plans] == [
        (348.0, False, "Non-Refundable + $0 (pay deposit)"), (511.0, True, "Fully refundable before Sep 23 + $163 (pay deposit)"),
        (590.0, False, "Non-Refundable + $242 (pay later)")]
    assert [p.rate_per_night_usd for p in pent.rate_plans] == [416.0] and pent.rate_plans[0].total_stay_usd == 832.0
    assert absent.rate_plans[0].rate_plan_label == "Old"
    assert [(t.n_tiers, t.lead_in, t.skip_reason) for t in out.tiers] == [(3, 348, None), (1, 416, None), (0, None, "no_room_block")]


def test_rows_equal_plans_plus_missing_picks(spark):
    caps = CQ.captures(spark, "/root/testdata/sf0.001")
    n_plans = caps.select(F.sum(F.aggregate(C.capture_rooms(), F.lit(0), lambda a, r: a + F.size(r["rate_plans"]))).alias("n")).first().n
    assert C.flatten_plans(caps).count() == n_plans
    flat = C.flatten(caps.withColumn("missed", F.array().cast("array<string>")))
    by = {r.status: r["count"] for r in flat.groupBy("status").count().collect()}
    assert by["ok"] + by["non_bar_rate"] == n_plans
    assert [f.name for f in C.quote_rows(flat).schema.fields] == [f.name for f in schemas.QUOTES.fields]


def test_null_extract_and_rooms(spark):
    df = spark.createDataFrame([("p", "direct", None, 1, None, None, "text", None), ("p", "direct", None, 1, None, None, None, ("Grand Hotel", None, 1, None))], schemas.CAPTURE)
    out = G.gate(df.withColumn("expected_tokens", F.array(F.lit("grand hotel")))).select("status", "reason").collect()
    assert [tuple(r) for r in out] == [("extract_failed", "no_extract"), ("ok", "")]
    assert C.flatten_plans(df).count() == 0


def test_chain_page_and_api_capture(spark):
    df = capture(spark, "Hotel One and Hotel Two", ["Penthouse"]).withColumn("expected_tokens", F.array(F.lit("grand")))
    assert G.gate(df, chain_markers=["Hotel One", "Hotel Two"]).first().status == "FAIL_CHAIN_PAGE_SOFT"
    api = G.gate(df.withColumn("property_id", F.lit("s")), subject_properties=["s"], skus={"Penthouse": "ph"}, api_channel="hotels_com").first()
    assert (api.status, api.keep) == ("compression_short", "rows")


def test_name_must_be_in_the_page_word_for_word(spark):
    df = capture(spark, "penthouse", ["Penthouse"])
    assert df.select(G.room_anchor_fails().alias("x")).first().x is True
    assert capture(spark, "", ["Penthouse"]).select(G.room_anchor_fails().alias("x")).first().x is True
    assert capture(spark, "", []).select(G.room_anchor_fails().alias("x")).first().x is False


def test_from_page_to_stored_rows(spark):
    """Tiers on the named channel, gates, rows and sentinels, then the upsert, which a second run leaves as it is."""
    from tariffa.operators import upsert as U
    sf = "/root/testdata/sf0.001"
    pages = CQ.captures(spark, sf).where("doc_id < 120").cache()
    settings = dict(subject_properties=["src1", "src2", "src3", "src4"], expected=(("direct", 1), ("booking", 2), ("hotels_com", 2)), detailed_properties=["src5", "src6"])
    rows = G.capture_rows(pages, "hotels_com", **settings)
    other = G.gate(pages.where("channel <> 'hotels_com'"), **settings)
    want = C.quote_rows(C.flatten(other.where("keep = 'rows'"), (), settings["detailed_properties"])).unionByName(C.cell_sentinels(other))
    seen = rows.collect()
    assert sorted(map(str, (r for r in seen if r.channel != "hotels_com"))) == sorted(map(str, want.collect())) and rows.columns == [f.name for f in schemas.QUOTES.fields]
    tiers = [r for r in seen if r.channel == "hotels_com" and r.rate_plan_label and "(pay " in r.rate_plan_label]
    assert tiers and {r.status for r in tiers} <= {"ok", "non_bar_rate", "extract_incomplete"}
    assert not [r for r in seen if r.channel != "hotels_com" and r.rate_plan_label and "(pay " in r.rate_plan_label]
    stored = U.upsert(rows.limit(0), rows)
    assert sorted(map(str, U.upsert(stored, rows).collect())) == sorted(map(str, stored.collect())) and stored.count() == len(seen)
    chained = G.capture_rows(pages, "hotels_com", chain_markers=["Have a question?"], **settings)
    assert chained.count() == 0  # every page holds the marker, so none is rewritten or kept
    pages.unpersist()
