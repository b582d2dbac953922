"""Helpers of the training-data operators: shared folder, stored tables, skew-safe lookups, word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tariffa.session import work_folder

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is hot if it holds over this part of all rows; so there are at most as many hot keys.
HOT_SHARE = 1000

#: A new folder in the place that the cluster names in spark.checkpoint.dir; unset, it is allowed only in a session of one process.
shared_folder = work_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: later jobs don't depend on lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lower_ascii(c: Column) -> Column:
    """A to Z in lower case, all else unchanged."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def bucket(c: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n: the rule of the folds."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def lookup(rows: DataFrame, entries: DataFrame, key: str, count: str, total: int, spread: Column) -> DataFrame:
    """Left join of rows to entries, which have one row per key and say in `count` how many rows share it.

    Keys with over 1 / HOT_SHARE of all rows are at most HOT_SHARE many, so their entries are broadcast.
    All others are joined by a shuffle in which no key holds more than that part; rows of hot keys go
    through it spread by the hash of `spread` and meet no partner there.
    """
    names = [c for c in entries.columns if c != key]
    hot = F.broadcast(entries.where(F.col(count) * HOT_SHARE > total).select(F.col(key).alias("_hot"), F.struct(*names).alias("_h")))
    cold = entries.where(F.col(count) * HOT_SHARE <= total).select(
        F.col(key).alias("_cold"), F.pmod(F.col(count), F.lit(1)).cast("long").alias("_zero"), F.struct(*names).alias("_c"))  # a literal would leave the join keys
    out = rows.join(hot, F.col(key) == F.col("_hot"), "left")
    own = F.when(F.col("_h").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(spread).bitwiseOR(F.lit(1)))
    out = out.withColumn("_at", own).join(cold, (F.col(key) == F.col("_cold")) & (F.col("_at") == F.col("_zero")), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_h.{c}"), F.col(f"_c.{c}")).alias(c) for c in names])
