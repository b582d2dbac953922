"""Substring dedup: words covered by a window of WINDOW words that also stands elsewhere.

Each window is filed under the least hash of its GRAM-word stretches (leftmost of equal ones), so equal windows are
filed alike. Neighbouring windows with the same stretch form a unit. Units are counted by stretch, then by content; a
content that stands alone under its stretch needs no search: its windows are repeated if it stands twice. All other
units of a stretch go to one shard, collapsed to distinct contents with their number. Each shard builds a compressed
FM-index (fm_index.py) of its units and streams the same units through it: backward search gives, per place, the
longest match that stands at least twice, and windows within matches of WINDOW words or more are repeated. So every
window meets all its equals in one shard, and texts without any repeated stretch meet none.

A stretch with over HOT distinct contents (a very common line in ever new surroundings) would fill a shard. Its windows
are compared instead by a 128-bit digest in a grouped count, spread over all tasks.

Defined results: a null text has no words; words are bytes between ASCII white space, unchanged. Rows that repeat id
and text count as two texts. Repeats within a document count, also overlapping ones. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tariffa.llm.common import lookup, stored, table
from tariffa.llm.fm_index import FMIndex

WINDOW, GRAM, HOT, SHARD, PART = 35, 8, 4096, 20_000, 1_000_000
CACHE = 500_000
K = 0x9E3779B97F4A7C15
_INVERSE = pow(K, -1, 1 << 64)
_NO_ID = -(2**63)


class Words:
    """Hashes of words, kept for those met so far."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.seen) > CACHE:
            self.seen.clear()
        get, out = self.seen.get, []
        out = list(map(get, words))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    w = words[i]
                    out[i] = self.seen[w] = xxhash.xxh64_intdigest(w) | 1  # zero separates texts
        return np.array(out, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def units(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch hash, content hash, first word, number of words) of each unit of a text of word hashes."""
    n = len(w) - WINDOW + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    g = np.zeros(len(w) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        g = g * np.uint64(K) + w[j:len(w) - GRAM + 1 + j]
    g = _mix(g)
    least, at, span = g, np.arange(len(g)), 1

    def joined(a, pa_, b, pb):
        left = a <= b
        return np.where(left, a, b), np.where(left, pa_, pb)
    width = WINDOW - GRAM + 1
    while span * 2 <= width:
        least, at = joined(least[:-span], at[:-span], least[span:], at[span:])
        span *= 2
    least, at = joined(least[:n], at[:n], least[width - span:][:n], at[width - span:][:n])
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], n] - 1
    size = last - first + WINDOW
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(w) - 1, K, np.uint64)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(w) - 1, _INVERSE, np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(w * power)]
    content = _mix((sums[first + size] - sums[first]) * back[first] + size.astype(np.uint64))
    return least[first].view(np.int64), content.view(np.int64), first, size


def _units(batches):
    words = Words()
    for b in batches:
        for i, h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            own = x.as_buffer().to_pybytes().split() if x.is_valid else []
            for lo in range(0, max(len(own) - WINDOW + 1, 0), PART):
                stretch, content, first, size = units(words(own[lo:lo + PART + WINDOW - 1]))
                n = len(stretch)
                yield pa.RecordBatch.from_arrays([pa.array(stretch), pa.array(content), pa.array(np.full(n, i)), pa.array(np.full(n, h)), pa.array(first + lo), pa.array(size.astype(np.int32))],
                                                 ["stretch", "content", "i", "h", "first", "size"])


def _contents(batches):
    """Word hashes of the wanted units of each text; of hot ones, a digest per window instead."""
    words = Words()
    for b in batches:
        rows = []
        for x, wanted in zip(b.column(0), b.column(1).to_pylist()):
            own = x.as_buffer().to_pybytes().split() if x.is_valid else []
            for u in wanted:
                w = words(own[u["first"]:u["first"] + u["size"]])
                if u["hot"]:
                    digests = [hashlib.blake2b(w[k:k + WINDOW].tobytes(), digest_size=16).digest() for k in range(u["size"] - WINDOW + 1)]
                    rows.append((u["stretch"], u["content"], u["n"], None, digests))
                else:
                    rows.append((u["stretch"], u["content"], u["n"], w.tobytes(), []))
        kinds = [pa.int64()] * 3 + [pa.binary(), pa.list_(pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["stretch", "content", "n", "words", "digests"])


def spans(statistics: np.ndarray, window: int = WINDOW) -> list[dict]:
    """Joined (a, b) stretches of words covered by matches of at least the window's length."""
    starts = np.flatnonzero(statistics >= window)
    if not len(starts):
        return []
    new = np.r_[True, np.diff(starts) > window]
    ends = np.r_[starts[:-1][new[1:]], starts[-1]] + window
    return [{"a": int(a), "b": int(e)} for a, e in zip(starts[new], ends)]


def _search(batches):
    """One shard: index all its distinct units and stream them through."""
    found: dict[tuple[int, int], tuple[int, bytes]] = {}
    for b in batches:
        for s, c, n, w in zip(*[b.column(i).to_pylist() for i in range(4)]):
            found[s, c] = (n, w)
    if not found:
        return
    texts = [np.frombuffer(w, np.uint64) for _, w in found.values()]
    index = FMIndex(texts, np.array([n for n, _ in found.values()]))
    matches = index.matching_statistics(texts, 2)
    keys = list(found)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([spans(m) for m in matches], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
                                     ["stretch", "content", "spans"])


SPANS = "array<struct<a:bigint,b:bigint>>"


def repeated(docs: DataFrame) -> DataFrame:
    """(i, h, spans): per text with repeated windows the stretches of words that they cover. docs: (i, h, text binary)."""
    spark = docs.sparkSession
    filed = stored(docs.mapInArrow(_units, "stretch long, content long, i long, h long, first long, size int"), "units")
    counts = filed.groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = stored(lookup(filed, counts, "stretch", "n", filed.count(), F.col("content")).where("n is not null").drop("n"), "repeated-units")
    by_content = pairs.groupBy("stretch", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("i", "h", "first", "size")).alias("r"))
    by_content = stored(by_content, "contents")
    kinds = by_content.groupBy("stretch").agg(F.count(F.lit(1)).alias("kinds"))
    total = by_content.count()
    by_content = stored(lookup(by_content, kinds, "stretch", "kinds", total, F.col("content")), "contents-counted")
    whole = by_content.where("kinds = 1").select("stretch", "content", "n", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("r.size").cast("long").alias("b"))).alias("spans"))
    wanted = by_content.where("kinds > 1").groupBy("r.i", "r.h").agg(
        F.collect_list(F.struct("stretch", "content", "n", "r.first", "r.size", (F.col("kinds") > HOT).alias("hot"))).alias("units"))
    texts = docs.join(wanted, ["i", "h"]).select("text", "units")
    texts = stored(texts.mapInArrow(_contents, "stretch long, content long, n long, words binary, digests array<binary>"), "unit-texts")
    cold = texts.where("words is not null").select("stretch", "content", "n", "words")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    searched = cold.repartition(shards, "stretch").mapInArrow(_search, f"stretch long, content long, spans {SPANS}")
    windows = texts.where("words is null").dropDuplicates(["stretch", "content"]).select("stretch", "content", "n", F.posexplode("digests").alias("at", "digest"))
    twice = windows.groupBy("digest").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("rows")).where("t > 1")
    hot = lookup(windows, twice, "digest", "rows", total, F.col("content")).where("t is not null").groupBy("stretch", "content").agg(
        F.collect_list(F.struct(F.col("at").cast("long").alias("a"), (F.col("at") + WINDOW).cast("long").alias("b"))).alias("spans"))
    found = searched.unionByName(hot).where(F.size("spans") > 0).join(by_content.select("stretch", "content", "n"), ["stretch", "content"])
    found = stored(whole.unionByName(found.select("stretch", "content", "n", "spans")), "found")
    keyed = lambda df: df.withColumn("key", F.struct("stretch", "content")).drop("stretch", "content")
    hits = lookup(keyed(pairs), keyed(found), "key", "n", pairs.count(), F.col("i")).where("spans is not null")
    placed = F.transform("spans", lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b")))
    return hits.groupBy("i", "h").agg(F.flatten(F.collect_list(placed)).alias("spans"))


def _kept(batches):
    for b in batches:
        rows = []
        for i, x, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            own = x.as_buffer().to_pybytes().split() if x.is_valid else []
            gone = np.zeros(len(own) + 1, np.int64)
            for s in found or []:
                gone[s["a"]] += 1
                gone[s["b"]] -= 1
            covered = np.cumsum(gone[:-1]) > 0
            kept = [w for w, g in zip(own, covered.tolist()) if not g] if covered.any() else own
            rows.append((i, len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 4, [pa.int64()] * 3 + [pa.string()])], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("i"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    out = rows.join(repeated(rows.select("i", "h", "text")), ["i", "h"], "left")
    return out.select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_W} AS w FROM documents),
 win AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d WHERE len(w) >= {WINDOW})),
 rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY md5(g)) AS n FROM win) WHERE n > 1),
 cov AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM rep),
 gone AS (SELECT r, list(p) AS p, count(*) AS n FROM cov GROUP BY r),
 kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN cov USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
