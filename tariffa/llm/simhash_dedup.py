"""SimHash near-duplicates by deletion variants.

A fingerprint has 64 bits, cut into three segments of 21, 21 and 22 bits. Two fingerprints that differ in at
most four bits differ in at most one bit of some segment. So each segment is indexed once for every one of its
bits with that bit left out: 64 variants per distinct fingerprint. Fingerprints that meet in a variant are
verified by their whole distance. Equal fingerprints are one class before that, so copies cost nothing.

A variant shared by more than BUCKET distinct fingerprints is cut further: the bits outside the segment differ in
at most four places, so of five parts of them one is equal. Runs of the same variant (and part) are read as a
sorted stream. Of a long run only a spanning forest of its links is returned, of a short one each pair once:
components are whole, and no group is written out as all its pairs.

Defined results: a null or empty text has no words and fingerprint zero, which links like any other. A null id
never is the smallest, unless all ids of a component are null. Repeated rows return repeatedly. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tariffa.llm.common import free, lookup, stored, table
from tariffa.llm.components import components

SEGMENTS = ((0, 21), (21, 42), (42, 64))
DISTANCE, SHINGLE, SEED = 4, 4, 42
BUCKET, SHORT = 4096, 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes) -> int:
    """Signed 64-bit SimHash of a text's word shingles; words end at the ASCII white space."""
    words = text.translate(LOWER).split()
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), max(n, 1)
    if n < 1:
        n, words = 1, [b" ".join(words)]
    for at in range(0, n, 65536):
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + SHINGLE]), SEED) for i in range(at, min(n, at + 65536))], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """All columns of docs, and the fingerprint."""
    text = docs.columns.index("text")

    def run(batches):
        for b in batches:
            fp = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column(text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp, pa.int64())], schema=b.schema.append(pa.field(name, pa.int64())))
    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0).cast("long")).schema)


def variants(fp: np.ndarray) -> np.ndarray:
    """(64, n) keys: the bit left out, then the segment with that bit zero."""
    u = fp.view(np.uint64)
    keys = []
    for lo, hi in SEGMENTS:
        seg = (u >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        keys += [(np.uint64(b) << np.uint64(22)) | (seg & ~np.uint64(1 << (b - lo))) for b in range(lo, hi)]
    return np.array(keys).view(np.int64)


def _variants(batches):
    for b in batches:
        fp = np.asarray(b.column(0), np.int64)
        for at in range(0, len(fp), 4096):
            part = fp[at:at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(variants(part).ravel()), pa.array(np.tile(part, 64))], ["key", "fp"])


def _parts(batches):
    """The five parts of the bits outside the segment of each key."""
    for b in batches:
        key, fp = np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64)
        bit, u = key >> 22, fp.view(np.uint64)
        rest = np.select([bit < 21, bit < 42], [u >> np.uint64(21), (u & np.uint64((1 << 21) - 1)) | ((u >> np.uint64(42)) << np.uint64(21))], u & np.uint64((1 << 42) - 1))
        sub = np.array([(np.uint64(p) << np.uint64(9)) | ((rest >> np.uint64(9 * p)) & np.uint64(511)) for p in range(5)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(key, 5)), pa.array(sub.ravel()), pa.array(np.tile(fp, 5))], ["key", "sub", "fp"])


def _distance(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(x, y).view(np.uint64))


def _first_key(x: np.ndarray) -> np.ndarray:
    """The bit left out in the first variant that two fingerprints with difference x share."""
    out, u = np.full(len(x), -1, np.int64), x.view(np.uint64)
    for lo, hi in reversed(SEGMENTS):
        seg = (u >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        n = np.bitwise_count(seg)
        at = lo + np.where(n == 1, np.bitwise_count(seg - np.uint64(1)), 0).astype(np.int64)
        out = np.where(n <= 1, at, out)
    return out


def _short_runs(key: np.ndarray, fp: np.ndarray, low: int) -> list[np.ndarray]:
    """All links of runs of equal keys, each in the first variant that its two ends share; low: bits below the bit left out."""
    found, i, d = [], np.arange(len(key) - 1), 1
    while True:
        i = i[i + d < len(key)]
        i = i[key[i] == key[i + d]]
        if not len(i):
            return found
        near = i[_distance(fp[i], fp[i + d]) <= DISTANCE]
        near = near[_first_key(np.bitwise_xor(fp[near], fp[near + d])) == key[near] >> low]
        if len(near):
            found.append(np.stack([fp[near], fp[near + d]]))
        d += 1


def _forest(fp: np.ndarray) -> list[np.ndarray]:
    """A spanning forest of the links within one run."""
    found, left = [], np.unique(fp)
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            for x in queue.pop():
                near = _distance(left, x) <= DISTANCE
                if near.any():
                    hit, left = left[near], left[~near]
                    found.append(np.stack([np.full(len(hit), x), hit]))
                    queue.append(hit)
    return found


def _links(batches, level: int):
    """Links of sorted rows (key, [sub,] fp). At the first level, rows of a run over BUCKET are passed on (kind 1)."""
    def out(pairs, kind):
        if pairs:
            a, b = np.concatenate(pairs, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "kind"])

    def ended(key, fp):
        if not len(key):
            return
        ends = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        sizes = np.repeat(np.diff(ends), np.diff(ends))
        short = sizes <= SHORT
        yield from out(_short_runs(key[short], fp[short], 22 if level == 1 else 34), 0)
        for lo, hi in zip(ends[:-1], ends[1:]):
            if hi - lo > SHORT:
                yield from out(_forest(fp[lo:hi]), 0)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    open_key, n, passed = None, 0, False
    for b in batches:
        key, fp = np.asarray(b.column(0), np.int64), np.asarray(b.column(b.num_columns - 1), np.int64)
        run = key if level == 1 else (key << 12) | np.asarray(b.column(1), np.int64)
        if not len(run):
            continue
        same = int(np.searchsorted(run != open_key, True)) if open_key is not None else 0
        if same:  # the open run goes on
            if passed:
                yield from out([np.stack([key[:same], fp[:same]])], 1)
            else:
                held.append((run[:same], fp[:same]))
        if same < len(run):
            if held:
                yield from ended(*map(np.concatenate, zip(*held)))
            last = int(np.searchsorted(run[same:], run[-1])) + same
            whole_r, whole_f, whole_k = run[same:last], fp[same:last], key[same:last]
            if level == 1 and len(whole_r):
                ends = np.flatnonzero(np.r_[True, whole_r[1:] != whole_r[:-1], True])
                big = np.repeat(np.diff(ends) > BUCKET, np.diff(ends))
                if big.any():
                    yield from out([np.stack([whole_k[big], whole_f[big]])], 1)
                    whole_r, whole_f = whole_r[~big], whole_f[~big]
            yield from ended(whole_r, whole_f)
            held, open_key, passed = [(run[last:], fp[last:])], run[-1], False
        n = sum(len(r) for r, _ in held)
        if level == 1 and n > BUCKET:
            k = open_key
            for _, f in held:
                yield from out([np.stack([np.full(len(f), k), f])], 1)
            held, passed = [], True
    if held:
        yield from ended(*map(np.concatenate, zip(*held)))


def _links_1(batches):
    return _links(batches, 1)


def _links_2(batches):
    return _links(batches, 2)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp); their components are those of all pairs within the distance."""
    keyed = distinct.select("fp").mapInArrow(_variants, "key long, fp long")
    first = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links_1, "a long, b long, kind int"), "simhash-links")
    found, hot = first.where("kind = 0").select("a", "b"), first.where("kind = 1")
    if hot.isEmpty():
        return found
    parts = hot.select(F.col("a").alias("key"), F.col("b").alias("fp")).mapInArrow(_parts, "key long, sub long, fp long")
    second = parts.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(_links_2, "a long, b long, kind int")
    return found.unionByName(second.select("a", "b"))


def grouped(rows: DataFrame) -> DataFrame:
    """doc_id, fp, root, component_id of every row (doc_id, fp): root is a fingerprint of the component, component_id
    the smallest id reachable over links."""
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    roots = components(links(classes))
    member = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = stored(member, "members")
    smallest = member.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("m"))
    owned = lookup(member, smallest, "root", "m", classes.count(), F.col("fp")).select("fp", "n", "root", "component_id")
    return lookup(rows, owned, "fp", "n", rows.count(), F.col("doc_id")).select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, root, component_id of every row of docs (doc_id, text)."""
    return grouped(stored(fingerprints(docs), "fingerprints"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest id (and fingerprint)."""
    fp, keep, keep_fp = (free(docs, c) for c in ("_fp", "_keep", "_keep_fp"))
    marked = stored(_with_fingerprint(docs, fp), "fingerprinted")
    own = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"))
    one = grouped(own).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("r"))
    one = stored(one.select(F.col("r.doc_id").alias(keep), F.col("r.fp").alias(keep_fp)), "kept")
    out = marked.join(one, F.col("doc_id").cast("long").eqNullSafe(F.col(keep)) & (F.col(fp) == F.col(keep_fp)))
    if own.groupBy("doc_id", "fp").count().where("count > 1").join(one, F.col("doc_id").eqNullSafe(F.col(keep)) & (F.col("fp") == F.col(keep_fp))).isEmpty():
        return out.select(*docs.columns)
    return out.dropDuplicates([keep, keep_fp]).select(*docs.columns)  # rows that share both id and fingerprint


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
