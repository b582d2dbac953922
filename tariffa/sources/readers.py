"""Sources: panels, quotes, wide sheets, captures and logs, all with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tariffa import schemas
from tariffa.operators.ingest import sheet_rows


def read_table(spark: SparkSession, path, schema, fmt="parquet") -> DataFrame:
    """Parquet, or CSV with a header, with the types of a fixed schema."""
    if fmt == "csv":
        names = [f.name for f in schema.fields]
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
        return raw.select(*[
            (F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields]).select(*names)
    return spark.read.schema(schema).format(fmt).load(path)


def read_panel(spark: SparkSession, path, fmt="parquet") -> DataFrame:
    return read_table(spark, path, schemas.PANEL, fmt)


def read_quotes(spark: SparkSession, path, fmt="parquet") -> DataFrame:
    return read_table(spark, path, schemas.QUOTES, fmt)


def read_sheets(spark: SparkSession, glob) -> DataFrame:
    """Rows of many CSV sheets, each with the headers of its own file.

    Columns: file, line, headers and cells (arrays of text, as long as that file's header
    row), length_of_stay_nights and as_of_date. Files may have other columns, in another
    order. Quoted cells may hold commas, line ends and doubled quotes, and be of any length.
    The header row is the first line with a date header; lines above it hold no
    cells, but one of them may show the 'Updated' stamp. A sheet covers a calendar, so each
    file is read whole into one row and then laid out.
    """
    return _sheets(spark.read.text(glob, wholetext=True))


def stream_sheets(spark: SparkSession, folder, glob="*", files_a_batch=1000) -> DataFrame:
    """The same rows of every sheet that is dropped into a folder, as a stream; each file still goes by its own headers."""
    return _sheets(spark.readStream.option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).text(str(folder), wholetext=True))


def _sheets(whole: DataFrame) -> DataFrame:
    return sheet_rows(whole.select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("file_time"), "value"))


def read_captures(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.CAPTURE).json(path)


def parse_log(lines: DataFrame) -> DataFrame:
    """Text lines to log rows; lines that are not JSON objects are skipped."""
    ok = F.try_parse_json("value").isNotNull()
    rows = lines.where(ok).select(F.from_json("value", schemas.LOG).alias("r"))
    return rows.where(F.col("r").isNotNull()).select("r.*")


def read_log(spark: SparkSession, path) -> DataFrame:
    return parse_log(spark.read.text(path))
