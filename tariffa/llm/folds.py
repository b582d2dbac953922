"""Bounded, documented samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """(doc_id, text, y, weight) of at most `most` training ids of each class: those with the least hash of the id.

    A class that is cut to the bound gets the weight that restores its share. Labels without a value, and ids
    without a document, give no row; of labels that contradict each other the larger counts. Rows that repeat an
    id count once, with any of their texts.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & train).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [ids.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most).withColumn("weight", F.lit(max(1.0, k / most))) for y, k in sorted(n.items())]
    if not parts:
        parts = [ids.withColumn("weight", F.lit(1.0))]
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # at most 2 * most ids, whatever the size of the tables
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y", "weight")
