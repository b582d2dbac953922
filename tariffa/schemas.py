"""Fixed schemas. New columns are only ever added, with null as their default."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    BooleanType, DateType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampType,
)

_TYPES = {
    "STRING": StringType(), "DATE": DateType(), "INT": IntegerType(), "DOUBLE": DoubleType(),
    "BOOLEAN": BooleanType(), "TIMESTAMP": TimestampType(),
}


def _flat(columns: str) -> StructType:
    """Schema from 'name TYPE, name TYPE' (needs no session)."""
    return StructType([StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(","))])


def _one_line(ddl: str) -> str:
    return " ".join(ddl.split())


PANEL = _flat("""
    as_of_date DATE, arrival_date DATE, dow STRING, source STRING, room_tier STRING, property STRING,
    rate_usd DOUBLE, availability_status STRING, los_restriction INT, market_demand_frac DOUBLE,
    market_otb_frac DOUBLE, length_of_stay_nights INT""")

QUOTES_V1 = _flat("""
    property_id STRING, channel STRING, arrival_date DATE, nights INT, scraped_property_name STRING,
    scraped_marketing_name STRING, sub_description STRING, bed_config STRING, occupancy_max INT,
    rate_plan_label STRING, rate_per_night_usd DOUBLE, total_stay_usd DOUBLE, refundable BOOLEAN,
    is_genius_member_rate BOOLEAN, includes_breakfast BOOLEAN, rate_plan_confidence STRING,
    availability_status STRING, is_bar BOOLEAN, mapped_internal_code STRING, mapped_tier STRING,
    mapped_view STRING, mapped_bedrooms INT, mapped_ada BOOLEAN, mapping_source STRING, status STRING,
    missed_patterns STRING, scrape_timestamp_utc TIMESTAMP, source_url STRING""")

QUOTES_ADDED = _flat("""
    room_type_canonical STRING, rate_plan_canonical STRING, strikethrough_orig_rate DOUBLE,
    strikethrough_pct DOUBLE, promo_banner_text STRING, promo_banner_pct DOUBLE,
    weekly_rate_disclosure STRING, member_rate_gated BOOLEAN, member_or_card_offer_text STRING,
    bundle_inclusions STRING, penthouse_variant STRING""")

QUOTES = StructType(QUOTES_V1.fields + QUOTES_ADDED.fields)

PLAN = _one_line("""struct<rate_plan_label:string, rate_per_night_usd:double, total_stay_usd:double, refundable:boolean,
    is_genius_member_rate:boolean, includes_breakfast:boolean, rate_plan_confidence:string,
    availability_status:string, cancellation_phrase:string, strikethrough_orig_rate:double>""")
ROOM = f"""struct<marketing_name:string, sub_description:string, bed_config:string, occupancy_max:int,
    rate_per_night_usd:double, rate_plans:array<{PLAN}>>"""
EXTRACT = f"struct<property_name:string, arrival_date:string, nights:int, rooms:array<{ROOM}>>"
CAPTURE = _one_line(f"""
    property_id STRING, channel STRING, arrival_date DATE, nights INT, source_url STRING,
    captured_at TIMESTAMP, markdown STRING, extract {EXTRACT}""")

_TOTAL = "struct<Total:struct<AmountWithFees:double, Amount:double>>"
_PRICE = f"""struct<Available:boolean, Product:struct<Room:struct<Code:string>, Rate:struct<Code:string>,
    Prices:struct<Total:struct<Price:{_TOTAL}>, PerNight:struct<Price:{_TOTAL}>>>>"""
CRS = _one_line(f"""
    property_id STRING, arrival_date DATE, nights INT,
    ContentLists struct<RoomList:array<struct<Code:string, Name:string, Details:struct<Description:string>>>,
      RateList:array<struct<Code:string, Name:string, CategoryCode:string,
        Details:struct<DisplayName:string, Description:string, DetailedDescription:string>>>>,
    ProductAvailabilityDetail array<struct<Prices:array<{_PRICE}>>>,
    ProductAvailabilityList array<struct<Prices:array<{_PRICE}>>>""")

LOG = _flat("""
    ts TIMESTAMP, kind STRING, property STRING, channel STRING, arrival STRING, los INT,
    credits_nominal INT, rooms_count INT, reason STRING""")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in order: extra columns dropped, missing ones null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def upgrade_quotes(df: DataFrame) -> DataFrame:
    """Rows of the first schema to the present one. The first schema's columns must be there."""
    missing = [f.name for f in QUOTES_V1.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns of the first schema are missing: {missing}")
    return conform(df, QUOTES)


def union_all(frames) -> DataFrame:
    """Union by name; columns that a frame lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
