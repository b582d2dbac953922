"""Wide rate sheets to the long panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tariffa import fixed_values as fv
from tariffa.functions import cells
from tariffa.operators.rank import join_on
from tariffa.schemas import PANEL, conform


def melt(wide: DataFrame, slugs: dict, ids=("arrival_date",), drop=()) -> DataFrame:
    """One row per (ids, property column), with the cell as text.

    `slugs` maps a header to the property name; other columns are left out. The rows are
    laid out from each sheet row in one pass.
    """
    cells_ = [
        F.struct(F.lit(slugs[h]).alias("property"), F.col(f"`{h}`").cast("string").alias("cell"))
        for h in wide.columns if h in slugs and h not in drop]
    return wide.select(*ids, F.inline(F.array(*cells_)))


def typed(melted: DataFrame) -> DataFrame:
    """Type the mixed cells of a melted sheet."""
    return melted.withColumn("t", cells.typed_cell("cell")).select("*", "t.*").drop("t", "cell")


#: A CSV field: in quotes, where a doubled quote counts once and line ends are text, then what follows the closing quote; or plain.
#: Every repetition is possessive, so the pattern runs as a loop: its time is linear, its stack the same for a cell of any length.
_QUOTED = r'"([^"]*+(?:""[^"]*+)*+)"([^,\r\n]*+)'
_FIELD = '(?:' + _QUOTED.replace('(["^', '(?:["^').replace('([^', '(?:[^') + r'|[^,\r\n]*+)'
_LINE = rf'(?:\r\n|\n|\r)({_FIELD}(?:,{_FIELD})*+)'


def csv_lines(text: Column) -> Column:
    """Lines of a CSV text; a line end within a quoted field does not end a line. A quote that never closes is plain text."""
    return F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(_LINE), F.lit(1))


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line as text; quotes around a field go, doubled quotes inside it count once."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f"(,{_FIELD})"), F.lit(1))
    quoted = rf'\A,{_QUOTED}\z'
    return F.transform(parts, lambda p: F.when(
        p.startswith(',"') & p.rlike(quoted), F.concat(F.replace(F.regexp_extract(p, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(p, quoted, 2)))
        .otherwise(F.substr(p, F.lit(2))))


def sheet_rows(files: DataFrame) -> DataFrame:
    """Lay out whole CSV sheets (file, file_time, value) as rows with their file's own headers.

    The as-of day is the one in the file name, else the day of an 'Updated' stamp above the
    headers, else the file's day. Without a number in the name the stay is one night.
    """
    lines = F.transform(csv_lines(F.regexp_replace("value", "^\ufeff", "")), csv_fields)
    at = F.coalesce(F.array_position(F.transform("lines", lambda f: F.array_contains(f, fv.SHEET_DATE_HEADER)), True), F.lit(0))
    above = F.flatten(F.slice("lines", F.lit(1), F.greatest(F.col("at") - 1, F.lit(0)).cast("int")))
    stamp = F.filter(above, lambda c: c.rlike(fv.SHEET_UPDATED_PATTERN))
    laid = files.withColumn("lines", lines).withColumn("at", at)
    los = F.regexp_extract("file", fv.SHEET_LOS_PATTERN, 1).try_cast("int")
    day = F.regexp_extract("file", fv.SHEET_AS_OF_PATTERN, 1).try_cast("date")
    tagged = laid.withColumn("stamp", F.get(stamp, 0)).select(
        "file", F.col("lines")[F.greatest(F.col("at") - 1, F.lit(0)).cast("int")].alias("headers"), F.posexplode("lines").alias("line", "cells"), "at",
        F.coalesce(los, F.lit(1)).alias("length_of_stay_nights"),
        F.coalesce(day, cells.updated_day("stamp", "file_time"), F.to_date("file_time")).alias("as_of_date"))
    n = F.size("headers")
    padded = F.transform(F.slice("cells", F.lit(1), n), lambda c: F.nullif(c, F.lit("")))
    return tagged.where((F.col("at") > 0) & (F.col("line") >= F.col("at")) & (F.array_join("cells", "") != "")).select(
        "file", "line", "headers", F.concat(padded, F.array_repeat(F.lit(None).cast("string"), F.greatest(n - F.size("cells"), F.lit(0)))).alias("cells"),
        "length_of_stay_nights", "as_of_date")


def named_cell(name: str) -> Column:
    """The cell under the first header of that name, null if the file has none."""
    return F.get("cells", (F.array_position("headers", name) - 1).cast("int"))


def sheet_headers(rows: DataFrame) -> DataFrame:
    """(file, header) of every file, the input of `header_drift`."""
    return rows.select("file", "headers").distinct().select("file", F.explode("headers").alias("header"))


def melt_rows(rows: DataFrame, slugs: dict, ids=("arrival_date",), drop=()) -> DataFrame:
    """One row per (ids, property column) of sheet rows; each cell goes by the header of its own file."""
    names = F.create_map(*[F.lit(x) for h, p in slugs.items() if h not in drop for x in (h, p)]) if slugs else F.create_map().cast("map<string,string>")
    pairs = F.transform(F.arrays_zip("headers", "cells"), lambda z: F.struct(
        F.try_element_at(names, F.nullif(z["headers"], F.lit(""))).alias("property"), z["cells"].alias("cell")))
    return rows.select(*ids, F.inline(F.filter(pairs, lambda z: z["property"].isNotNull())))


def checked_sheets(rows: DataFrame, slugs: dict, drop=(), required=fv.SHEET_REQUIRED_HEADERS, shown=20) -> DataFrame:
    """The sheet rows, once every header is mapped, dropped or known and every file has the required ones.

    Anything else raises before a cell is read: a renamed column must not go missing silently.
    """
    spark, headers = rows.sparkSession, sheet_headers(rows)
    one = lambda values: spark.createDataFrame([(v,) for v in values], "header string")
    drift = header_drift(headers.where(F.col("header") != ""), one(slugs), one(drop)).limit(shown).collect()
    gaps = rows.select("file", F.explode(F.array_except(F.array(*[F.lit(r) for r in required]), "headers")).alias("header")).distinct().limit(shown).collect()
    if drift or gaps:
        raise ValueError(f"sheet headers: unknown {[tuple(r) for r in drift]}, missing {[tuple(r) for r in gaps]}")
    return rows


def asserted_sheets(rows: DataFrame, slugs: dict, drop=(), required=fv.SHEET_REQUIRED_HEADERS) -> DataFrame:
    """The sheet rows with the same check in the rows themselves, for streams: a file with an unknown or missing header
    fails the batch that reads it, before any of its cells is written."""
    known = F.array(*[F.lit(h) for h in dict.fromkeys([*fv.SHEET_METADATA_HEADERS, *slugs, *drop, ""])])
    unknown = F.filter(F.array_except("headers", known), lambda h: ~h.startswith("Unnamed:"))
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), "headers")
    said = F.concat(F.lit("sheet headers of "), F.col("file"), F.lit(": unknown ["), F.array_join(unknown, ", "), F.lit("], missing ["), F.array_join(missing, ", "), F.lit("]"))
    return rows.withColumn("headers", F.when((F.size(unknown) == 0) & (F.size(missing) == 0), F.col("headers")).otherwise(F.raise_error(said)))


def sheet_rows_panel(rows: DataFrame, slugs: dict, source: str, tier="any", drop=(), strict=True) -> DataFrame:
    """Panel rows of sheet rows, after the header check (unless strict is False). Rows without a date are left out."""
    if strict:
        rows = (asserted_sheets if rows.isStreaming else checked_sheets)(rows, slugs, drop)
    dated = rows.withColumn("arrival_date", cells.sheet_date(named_cell(fv.SHEET_DATE_HEADER))).where("arrival_date is not null")
    ids = {"dow": cells.day_label(named_cell("Day"), "arrival_date"), "market_demand_frac": cells.number(named_cell("Market demand")),
           "market_otb_frac": cells.number(named_cell("Market OTB"))}
    long = melt_rows(dated.withColumns(ids), slugs, ("as_of_date", "arrival_date", "length_of_stay_nights", *ids), drop)
    return conform(typed(long).withColumn("source", F.lit(source)).withColumn("room_tier", F.lit(tier)), PANEL)


def sheet_panel(sheets: DataFrame, slugs: dict, source: str, tier="any", drop=()) -> DataFrame:
    """Panel rows of wide sheets that carry `as_of_date` and `length_of_stay_nights`.

    Rows without a date are left out; `undated` counts them.
    """
    date = cells.sheet_date("Date")
    dated = sheets.withColumn("arrival_date", date).where("arrival_date is not null")
    ids = {"dow": cells.day_label("Day", "arrival_date"), "market_demand_frac": cells.number("`Market demand`"),
           "market_otb_frac": cells.number("`Market OTB`")}
    long = melt(dated.withColumns(ids), slugs, ("as_of_date", "arrival_date", "length_of_stay_nights", *ids), drop)
    return conform(typed(long).withColumn("source", F.lit(source)).withColumn("room_tier", F.lit(tier)), PANEL)


def undated(sheets: DataFrame) -> DataFrame:
    return sheets.agg(F.count_if(cells.sheet_date("Date").isNull()).alias("n_undated"), F.count(F.lit(1)).alias("n_rows"))


def unknown_statuses(panel: DataFrame) -> DataFrame:
    """Cell texts that no status word covers, counted."""
    prefix = fv.UNKNOWN_STATUS_PREFIX
    return panel.where(F.col("availability_status").startswith(prefix)).groupBy(
        F.substr(F.col("availability_status"), F.lit(len(prefix) + 1)).alias("cell_text")).agg(
        F.count(F.lit(1)).alias("n"))


def header_drift(headers: DataFrame, slugs: DataFrame, drop: DataFrame, metadata=fv.SHEET_METADATA_HEADERS) -> DataFrame:
    """Headers of each file that are neither mapped, dropped nor known metadata.

    An empty result means that the map covers the sheets.
    """
    named = headers.where(F.col("header").isNotNull() & ~F.col("header").startswith("Unnamed:")
                          & ~F.col("header").isin(*metadata))
    return named.join(slugs.select("header"), "header", "left_anti").join(
        drop.select("header"), "header", "left_anti").select("file", "header").distinct()


def map_preflight(slugs: DataFrame, drop: DataFrame, subject: str, peers: DataFrame) -> DataFrame:
    """Problems of a header map before any sheet is read, as (problem, name) rows.

    An empty map has no problems.
    """
    wanted = peers.select(F.col("property").alias("slug"), F.lit("peer_missing").alias("problem")).unionByName(
        slugs.sparkSession.range(1).select(F.lit(subject).alias("slug"), F.lit("subject_missing").alias("problem")))
    missing = wanted.join(slugs.select("slug"), "slug", "left_anti")
    twice = slugs.groupBy("slug").count().where("count > 1").select("slug", F.lit("duplicate_slug").alias("problem"))
    both = slugs.join(drop.select("header"), "header", "left_semi").select(
        F.col("header").alias("slug"), F.lit("mapped_and_dropped").alias("problem"))
    orphan = slugs.where(F.col("slug") != subject).select("slug").distinct().join(
        wanted.select("slug"), "slug", "left_anti").withColumn("problem", F.lit("orphan_slug"))
    found = missing.unionByName(twice).unionByName(both).unionByName(orphan).distinct()
    has_map = slugs.select(F.lit(1).alias("one")).limit(1)
    return found.where(has_map.exists()).select("problem", F.col("slug").alias("name"))


def sample_recheck(sample: DataFrame, source: DataFrame, keys=("property", "arrival_date"), tolerance=1e-6) -> DataFrame:
    """Sampled prices beside the price read again from the source; null or another price is a mismatch."""
    again = source.select(*keys, F.col("rate_usd").alias("source_usd"))
    same = F.abs(F.col("rate_usd") - F.col("source_usd")) <= tolerance
    return join_on(sample, again, list(keys), "left").withColumn("matches", F.coalesce(same, F.lit(False)))
