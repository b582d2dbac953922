"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents: each segment holds the postings of about SEGMENT bytes of text, as one row with
its term list and, per term, the sorted positions of all its tokens in the segment (positions count on from
document to document, with a gap). The table of segments is written to the shared folder; every token is in it.

A phrase is looked up in each segment from its rarest term: its list, moved by the term's offset, is intersected
with the moved lists of the next rarer terms. With a slop, a term may stand that many words off its place, which
gives proximity matches.

Which segments an item is looked up in is decided by a join: every window of an item is anchored at its word that is rarest in the
whole index, and (item, segment) pairs are those whose segment holds an anchor. So an item meets only segments that may hold
it, a window with a word that no document has meets none, and neither items nor terms go through the driver or a broadcast. The items of a segment
are streamed to the task that has it open.

Defined results: a null or empty text has no words; an item without words has no window. Items that share an
id are one item. A null item id counts as the empty string. Repeated documents return repeatedly. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tariffa.llm.common import free, lookup, stored, table

WINDOW, SHARE = 13, 20
SEGMENT, GAP = 4_000_000, 64
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "segment string, doc_ids array<long>, n_words array<int>, terms binary, starts binary, positions binary"


def words(text: bytes) -> list[bytes]:
    """Words of the contract: ASCII letters in lower case, digits and all beyond ASCII; all else separates."""
    return text.translate(KEPT).split()


def _packed(ids: list, lengths: list[int], code: np.ndarray, terms: dict, name: str) -> pa.RecordBatch:
    n = np.array(lengths, np.int64)
    base = np.cumsum(n + GAP) - n - GAP
    at = np.arange(len(code)) + np.repeat(base - (np.cumsum(n) - n), n)
    order = np.argsort(code, kind="stable")
    starts = np.r_[0, np.cumsum(np.bincount(code, minlength=len(terms)))].astype(np.int32)
    delta = np.diff(at[order], prepend=0).astype(np.int32)
    blob = [b" ".join(terms), starts.tobytes(), pa.compress(delta.tobytes(), codec="zstd", asbytes=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), *[pa.array([x], pa.binary()) for x in blob]],
        ["segment", "doc_ids", "n_words", "terms", "starts", "positions"])


def _segments(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, lengths, codes, terms, size, k = [], [], [], {}, 0, 0
        task = TaskContext.get().partitionId()
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                text = x.as_buffer().to_pybytes() if x.is_valid else b""
                own = words(text)
                ids.append(i)
                lengths.append(len(own))
                codes.append(np.fromiter((terms.setdefault(w, len(terms)) for w in own), np.int64, len(own)))
                size += len(text)
                if size >= most:
                    yield _packed(ids, lengths, np.concatenate(codes), terms, f"{task}-{k}")
                    ids, lengths, codes, terms, size, k = [], [], [], {}, 0, k + 1
        if ids:
            yield _packed(ids, lengths, np.concatenate(codes), terms, f"{task}-{k}")
    return run


def build_index(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Write the positional index of all tokens of docs; returns the table of segments of about so many bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(_segments(segment), INDEX), "postings")


class Segment:
    """One segment, opened: postings by term."""

    def __init__(self, row: dict):
        self.terms = {t: i for i, t in enumerate(row["terms"].split())}
        self.starts = np.frombuffer(row["starts"], np.int32)
        n = int(self.starts[-1])
        self.at = np.cumsum(np.frombuffer(pa.decompress(row["positions"], 4 * n, codec="zstd", asbytes=True), np.int32), dtype=np.int64)
        self.n = np.array(row["n_words"], np.int64)
        self.base = np.cumsum(self.n + GAP) - self.n - GAP

    def postings(self, term: bytes) -> np.ndarray:
        i = self.terms.get(term)
        return self.at[:0] if i is None else self.at[self.starts[i]:self.starts[i + 1]]


def _there(list_: np.ndarray, at: np.ndarray, slop: int) -> np.ndarray:
    """Whether the sorted list has an entry within slop of each place."""
    i = np.searchsorted(list_, at - slop)
    return (i < len(list_)) & (list_[np.minimum(i, len(list_) - 1)] <= at + slop)


def find(seg: Segment, item: list[bytes], slop: int = 0, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) places in the segment where windows of the item stand, each term within slop of its offset from the rarest."""
    k = min(window, len(item))
    lists = [seg.postings(t) for t in item]
    df = np.array([len(x) for x in lists])
    starts: list[np.ndarray] = []
    groups: dict[int, list[int]] = {}
    for s in range(len(item) - k + 1 if k else 0):
        j = s + int(df[s:s + k].argmin())
        if df[j]:
            groups.setdefault(j, []).append(s)
    for j, own in groups.items():
        at = lists[j] - j  # where the item's first word would stand
        shared = range(max(own), min(own) + k)
        for t in sorted(shared, key=df.__getitem__):
            if t != j and len(at):
                at = at[_there(lists[t], at + t, slop)] if df[t] else at[:0]
        if not len(at):
            continue
        fits = {t: _there(lists[t], at + t, slop) if df[t] else np.zeros(len(at), bool) for t in range(min(own), max(own) + k) if t not in shared}
        for s in own:
            ok = np.ones(len(at), bool)
            for t in range(s, s + k):
                if t in fits:
                    ok &= fits[t]
            if ok.any():
                starts.append(at[ok] + s)
    first = np.unique(np.concatenate(starts)) if starts else seg.at[:0]
    return first, first + k


def _term(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _segment_terms(batches):
    """(h, segment, n): the terms of each segment and how many tokens they have there."""
    for b in batches:
        for name, terms, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            h = np.array([_term(t) for t in terms.split()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([name] * len(h), pa.string()), pa.array(np.diff(np.frombuffer(starts, np.int32)).astype(np.int64))], ["h", "segment", "n"])


def _item_terms(batches):
    """(h, iid, at) of every word of items (iid, text)."""
    for b in batches:
        for iid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            h = np.array([_term(w) for w in words(text)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([iid] * len(h), pa.string()), pa.array(np.arange(len(h)))], ["h", "iid", "at"])


def _anchors(window: int):
    """(iid, h): the rarest term of each window of the items, from rows (iid, w) with w the (at, h, n) of all words."""
    def run(batches):
        for b in batches:
            for iid, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = sorted((x["at"], x["h"], x["n"]) for x in w)
                h, n, k = np.array([x[1] for x in w]), np.array([x[2] for x in w]), min(window, len(w))
                view = np.lib.stride_tricks.sliding_window_view(n, k)
                rarest = np.unique((view.argmin(axis=1) + np.arange(len(view)))[view.min(axis=1) > 0])
                own = np.unique(h[rarest])
                yield pa.RecordBatch.from_arrays([pa.array([iid] * len(own), pa.string()), pa.array(own, pa.int64())], ["iid", "h"])
    return run


def meeting(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(segment, iid) of all segments that may hold a window of an item (iid, text)."""
    there = index.select("segment", "terms", "starts").mapInArrow(_segment_terms, "h long, segment string, n long")
    own = stored(items.select("iid", F.col("text").cast("binary").alias("text")).mapInArrow(_item_terms, "h long, iid string, at long"), "item-terms")
    used = own.groupBy("h").agg(F.count(F.lit(1)).alias("rows"))
    postings = stored(there.join(used.select("h"), "h", "left_semi"), "item-postings")
    entries = postings.groupBy("h").agg(F.sum("n").alias("n")).join(used, "h")
    counted = lookup(own, entries, "h", "rows", own.count(), F.xxhash64("iid", "at"))
    whole = counted.groupBy("iid").agg(F.collect_list(F.struct("at", "h", F.coalesce("n", F.lit(0).cast("long")).alias("n"))).alias("w"))
    anchors = whole.mapInArrow(_anchors(window), "iid string, h long")
    return anchors.join(postings.select("h", "segment"), "h").select("segment", "iid").distinct()


def _search(slop: int, window: int):
    """Rows sorted by segment: the segment itself first, then the items to look up in it."""
    def ended(row, spans, found):
        return pa.RecordBatch.from_arrays(
            [pa.array([row["segment"]] * len(spans)), pa.array(range(len(spans)), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_words"], pa.int64()),
             pa.array([[{"a": a, "b": e} for a, e in sorted(set(s))] for s in spans], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
             pa.array([sorted(f) for f in found], pa.list_(pa.string()))], ["segment", "k", "doc_id", "n_words", "spans", "items"])

    def run(batches):
        row = seg = None
        for b in batches:
            for at in range(len(b)):
                own = {c: b.column(k)[at].as_py() for k, c in enumerate(b.schema.names)}
                if own["item_id"] is None:
                    if row is not None:
                        yield ended(row, spans, found)
                    row, seg = own, None
                    spans, found = [[] for _ in row["doc_ids"]], [set() for _ in row["doc_ids"]]
                    continue
                seg = seg or Segment(row)  # opened once an item is there
                first, end = find(seg, words(own["text"].encode()), slop, window)
                if len(first):
                    d = np.searchsorted(seg.base, first, "right") - 1
                    for k, lo, hi in zip(d.tolist(), (first - seg.base[d]).tolist(), (end - seg.base[d]).tolist()):
                        found[k].add(own["item_id"])
                        spans[k].append((max(lo, 0), min(hi, int(seg.n[k]))))
        if row is not None:
            yield ended(row, spans, found)
    return run


HITS = "segment string, k int, doc_id long, n_words long, spans array<struct<a:int,b:int>>, items array<string>"


def search(index: DataFrame, items: DataFrame, slop: int = 0, window: int = WINDOW) -> DataFrame:
    """Per document of the index: the spans (a, b) where windows of items (item_id, text) stand, and those items' ids.

    slop 0 gives exact phrases; else each term may stand that many words (at most GAP - WINDOW) off its place.
    """
    item_id, text = F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = items.select(item_id.alias("item_id"), text.alias("text")).distinct()
    own = stored(own.withColumn("iid", F.md5(F.concat(F.length("item_id").cast("string"), F.lit(":"), "item_id", "text").cast("binary"))), "items")
    asked = meeting(index, own, window).join(own, "iid").select("segment", "item_id", "text")
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema.fields if f.name != "segment"}
    rows = index.select("*", F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("string").alias("text")).unionByName(asked.select("segment", *none.values(), "item_id", "text"))
    laid = rows.repartition("segment").sortWithinPartitions("segment", F.asc_nulls_first("item_id"))
    return laid.mapInArrow(_search(slop, window), HITS)


def contamination(docs: DataFrame, items: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """segment, k, doc_id, n_words, n_hit, items, contaminated of every document."""
    out = search(build_index(docs, segment), items)
    covered = F.expr("aggregate(array_sort(spans), named_struct('n', 0L, 'to', 0), (c, s) -> named_struct("
                     "'n', c.n + greatest(0, s.b - greatest(s.a, c.to)), 'to', greatest(c.to, s.b)), c -> c.n)")
    out = out.withColumn("n_hit", covered).withColumn("items", F.array_sort(F.array_distinct("items")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def kept_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns. Verdicts are joined by a hash of id and text; they are
    stored first, so that Spark knows their size and shuffles the documents only where they are many."""
    key = F.xxhash64("doc_id", "text")
    bad = stored(contamination(docs.select(key.alias("doc_id"), "text"), items).where("contaminated").select(F.col("doc_id").alias("_bad")).distinct(), "verdicts")
    name = free(docs, "_key")
    return docs.withColumn(name, key).join(bad.withColumnRenamed("_bad", f"{name}_bad"), F.col(name) == F.col(f"{name}_bad"), "left_anti").select(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS w FROM benchmark),
 bw AS (SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
   SELECT item_id, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
 ks AS (SELECT DISTINCT k FROM bw),
 dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
 m AS (SELECT DISTINCT doc_id, dw.i, dw.k, item_id FROM dw JOIN bw USING (k, g)),
 h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
 t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
