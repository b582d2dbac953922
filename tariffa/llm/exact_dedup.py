"""Exact dedup by a persistent digest index, bucketed and sorted by digest.

The index is a Parquet folder in shared storage: one row per distinct text with its SHA-256 digest, the id
that stays, and the rows that bore the text in the batch that brought it. New data is digested and grouped,
freed of known digests by a sort-merge anti-join that reads the index in its buckets, and appended.

Defined results: a null text counts as empty. Of equal texts in one batch the largest id stays, and null ids
lose to any other; a text known from an earlier batch stays with the id of that batch. Rows that repeat both
id and text are one document: each says it is kept, and `kept_rows` returns it once. Extra columns are not read.
An empty table adds nothing and returns no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from tariffa.llm.common import free, lookup, shared_folder, stored, table

ENTRY = "digest binary, keep_id long, group_size long, repeats long"


class DigestIndex:
    """The index at a path. `buckets` is fixed when the index is made and must be given alike later."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}'")

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, batch: DataFrame) -> None:
        """Add the entries whose digest the index lacks. Run again for the same batch, it adds nothing.

        Each bucket is gathered before it is written, so a batch adds one file a bucket, however many tasks the join had.
        """
        new = batch.repartition(self.buckets, "digest").hint("merge").join(self.entries(), "digest", "left_anti")
        new = new.repartition(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))
        (new.select(*self.entries().columns).write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", self.path).mode("append").saveAsTable(self.name))


def digests(docs: DataFrame) -> DataFrame:
    """Id and SHA-256 digest of each row's whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """One entry per digest. Equal ids are counted first, so a group of copies is summed up before it meets."""
    by_id = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_id.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.max_by("n", F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).alias("repeats"))


def dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Add the documents to the index; returns per row: doc_id, digest, keep_id, group_size, repeats, kept."""
    rows = stored(digests(docs), "digests")
    index.append(grouped(rows))
    out = lookup(rows, index.entries(), "digest", "group_size", rows.count(), F.col("doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def kept_rows(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The documents that stay, each once, with all their columns."""
    rows = stored(digests(docs), "digests")
    index.append(grouped(rows))
    digest, keep, repeats = (free(docs, c) for c in ("_digest", "_keep", "_repeats"))
    stays = index.entries().select(F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.col("repeats").alias(repeats))
    own = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    kept = docs.join(stays, (own == F.col(digest)) & F.col("doc_id").cast("long").eqNullSafe(F.col(keep)))
    if not stays.where(F.col(repeats) > 1).isEmpty():
        kept = kept.where(F.col(repeats) == 1).unionByName(kept.where(F.col(repeats) > 1).dropDuplicates([digest]))
    return kept.select(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, shared_folder(spark, "digest-index"))
    out = dedup(table(spark, sf_dir, "documents"), index)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, text_sha256
  FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents))
"""
