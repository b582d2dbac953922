"""Periodic runs of words, by online dyadic square catching.

A run of period q is a longest stretch in which words q apart are identical, with q the least such number and a length
of at least `times` * q and `least`. The words arrive as one stream. When a block of B = 2^k words at a multiple of B
is complete, it becomes a catcher: it watches for itself at the distances q of B to 2B - 1. So each appended word
ends one suffix of B words for every k, and that suffix is compared with one catcher, the block
that lies before the one in which the suffix begins; comparisons are of 64-bit names that double by levels. A hit says that
B words repeat at distance q. Hits of neighbouring blocks at the same distance merge. The run around c merged blocks reaches
less than B words further on either side, since the next block would have hit; so it has less than (c + 2) * B + q words, and
only where that is enough for a run are its ends searched. So all work is O(n log n), whatever the words are.

Blocks inside a known run of a smaller period p hit at every multiple of p; these hits say nothing new and are left out as
they arrive. Two different runs cannot both cover 2B words with periods up to B (their greatest common divisor would be a
period), so one run a block decides this.

All words that are appended in one call advance together, level by level, as arrays: the same comparisons as word by
word. Documents follow each other in the stream with a separator that equals nothing, so no run crosses them. Accepted
runs are compared word by word; a clash of names costs time, never a result.

Defined results: words are what ASCII white space separates; a null or blank text has none. Repeated rows return
repeatedly. Columns of docs are kept, new ones take free names beside clashing ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tariffa.llm.common import free, table

TIMES, LEAST = 4, 6
#: Documents advance together until they hold so many words; a longer one advances alone.
TOGETHER = 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    h = (x * _A) ^ (y * _B + _A)
    h ^= h >> np.uint64(29)
    h *= _B
    return h ^ (h >> np.uint64(32))


def _caught(names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of every suffix that equals its catcher; names are of windows of `size` words by their start."""
    whole = len(names) // size
    if not whole:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blocks = names[:whole * size].reshape(whole, size)
    hit = np.flatnonzero(blocks[1:] == blocks[:-1, :1])
    rest = np.flatnonzero(names[whole * size:] == names[(whole - 1) * size])  # the last, open block
    hit = np.concatenate([hit, rest + (whole - 1) * size])
    return hit // size, size + hit % size


def _covered(block: np.ndarray, distance: np.ndarray, size: int, whole: int, runs: np.ndarray) -> np.ndarray:
    """Hits that lie in a known run whose period divides the distance."""
    if not len(runs) or not len(block):
        return np.zeros(len(block), bool)
    start, length, period = runs.T
    first, last = -(-start // size), (start + length - 2 * size) // size
    own = last >= first
    first, last, period, end = first[own], np.minimum(last[own], whole - 1), period[own], (start + length)[own]
    counts = np.maximum(last - first + 1, 0)
    at = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    by, to = np.ones(whole, np.int64), np.zeros(whole, np.int64)
    by[at], to[at] = np.repeat(period, counts), np.repeat(end, counts)
    return (distance % by[block] == 0) & (block * size + distance + size <= to[block])


def _merged(block: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block, blocks, distance) of hits that follow each other at one distance."""
    if not len(block):
        return block, block, distance
    order = np.lexsort((block, distance))
    block, distance = block[order], distance[order]
    new = np.flatnonzero(np.r_[True, (distance[1:] != distance[:-1]) | (block[1:] != block[:-1] + 1)])
    return block[new], np.diff(np.r_[new, len(block)]), distance[new]


def _moved(ids: np.ndarray, at: np.ndarray, distance: np.ndarray, most: int, step: int) -> np.ndarray:
    """By how many words, up to `most`, each place can go on while the words at the distance stay identical."""
    moved, open_, n = np.zeros(len(at), np.int64), np.arange(len(at)), len(ids)
    wide = 1
    while len(open_) and wide <= most:
        ahead = at[open_, None] + step * (moved[open_, None] + np.arange(wide))
        beyond = ahead + distance[open_, None]
        inside = (ahead >= 0) & (beyond < n)
        same = inside & (ids[np.where(inside, ahead, 0)] == ids[np.where(inside, beyond, 0)])
        run = np.where(same.all(axis=1), wide, np.argmin(same, axis=1))
        moved[open_] += run
        open_ = open_[run == wide]
        wide = min(2 * wide, max(1, (1 << 20) // max(len(open_), 1)))
        over = moved[open_] >= most
        moved[open_[over]] = most
        open_ = open_[~over]
    return moved


class Catchers:
    """The runs of one stream of words, given as whole numbers; each negative number equals nothing else."""

    def __init__(self, times: int = TIMES, least: int = LEAST):
        self.times, self.least = times, least
        self.parts: list[np.ndarray] = []
        self.longest = 0

    def append(self, ids: np.ndarray) -> None:
        """The words of one document."""
        self.parts += [ids, np.array([-1 - len(self.parts)])]
        self.longest = max(self.longest, len(ids))

    def advance(self) -> np.ndarray:
        """(start, length, period) of all runs of the words appended so far, by period."""
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        runs, size, n = np.zeros((0, 3), np.int64), 1, len(ids)
        names = _mix(ids.view(np.uint64), np.full(n, _B))
        while self.times * size <= self.longest:
            if size > 1:
                names = _mix(names[:len(names) - size // 2], names[size // 2:])
            block, distance = _caught(names, size)
            new = ~_covered(block, distance, size, n // size + 1, runs)
            runs = np.concatenate([runs, self._runs(ids, size, *_merged(block[new], distance[new]))])
            size *= 2
        return runs

    def _runs(self, ids, size, block, count, distance) -> np.ndarray:
        could = count * size + 2 * (size - 1) + distance >= np.maximum(self.times * distance, self.least)
        block, count, distance = block[could], count[could], distance[could]
        left = _moved(ids, block * size - 1, distance, size, -1)
        right = _moved(ids, (block + count) * size, distance, size, 1)
        start = block * size - left
        length = left + count * size + right + distance
        own = length >= np.maximum(self.times * distance, self.least)
        found = np.unique(np.stack([start, length, distance], axis=1)[own], axis=0)
        exact = [np.array_equal(ids[s:s + n - q], ids[s + q:s + n]) for s, n, q in found]
        return found[np.array(exact, bool)]


def _grouped(texts: list[bytes | None]):
    """(place of the first text, words of each) of texts that advance together."""
    first, held, n = 0, [], 0
    for k, t in enumerate(texts):
        words = (t or b"").split()
        if held and n + len(words) > TOGETHER:
            yield first, held
            first, held, n = k, [], 0
        held.append(words)
        n += len(words)
    if held:
        yield first, held


def runs_of(texts: list[list[bytes]], times: int = TIMES, least: int = LEAST) -> list[np.ndarray]:
    """(start, length, period) of the runs of each list of words, by start and period."""
    number: dict[bytes, int] = {}
    catchers, begin, at = Catchers(times, least), [], 0
    for words in texts:
        catchers.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        begin.append(at)
        at += len(words) + 1
    runs = catchers.advance()
    of = np.searchsorted(begin, runs[:, 0], "right") - 1
    runs[:, 0] -= np.array(begin, np.int64)[of] if len(runs) else 0
    order = np.lexsort((runs[:, 2], runs[:, 0], of))
    runs, of = runs[order], of[order]
    return np.split(runs, np.searchsorted(of, np.arange(1, len(texts)))) if texts else []


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def find(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> tuple[DataFrame, list[str]]:
    """All columns of docs with the number of words, the runs by start and period, and the kept words joined by one
    space; and the names of these three columns."""
    names: list[str] = []
    typed = docs
    for c, kind in (("n_words", "long"), ("runs", "array<struct<start:long,length:long,period:long>>"), ("collapsed", "string")):
        names.append(free(typed, c))
        typed = typed.withColumn(names[-1], F.lit(None).cast(kind))
    at = docs.columns.index("text")
    pair = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for b in batches:
            for first, texts in _grouped(b.column(at).cast(pa.binary()).to_pylist()):
                found = runs_of(texts, times, least)
                kept = [b" ".join(w for w, k in zip(words, kept_words(len(words), r)) if k) if len(r) else b" ".join(words) for words, r in zip(texts, found)]
                rows = np.concatenate(found)
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(pair)))
                added = [pa.array([len(w) for w in texts], pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())]
                part = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *names])
    return docs.mapInArrow(run, typed.schema), names


def planted(doc_id: Column, text: Column) -> Column:
    """The text, of which one in ten ids repeats a stretch of its words from a place on, both chosen by crc32 of the id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), repeated), " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out, (_, runs, collapsed) = find(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    out = out.withColumn("_best", best).withColumn("_lines", F.transform(line, lambda x: F.concat(x, F.lit("\n"))))
    start, length, period = -F.col("_best.col2"), F.col("_best.length"), -F.col("_best.col3")
    return out.select("doc_id", F.size(runs).cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
                      F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join("_lines", ""), 256).alias("runs_sha256"),
                      F.sha2(collapsed, 256).alias("collapsed_sha256"))
