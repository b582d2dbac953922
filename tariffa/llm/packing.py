"""Packing of token sequences by minimum bin slack.

Each document (its ids and an end id) is cut into full windows and a remainder. Only the remainders need packing: their
lengths are counted over all documents into one histogram (at most CAPACITY - 1 numbers, whatever the size of the
corpus). From it a plan is made: the longest remaining length opens a window, and a subset-sum dynamic program over
bitsets (lengths taken in powers of two up to their counts) finds the multiset that fills it closest to capacity;
its counts are backtracked, and the pattern is repeated as often as the counts allow, so the plan is short. If slack is
left while remainders remain, one of them is cut to fill it, and its rest goes back to the histogram.

A remainder finds its window by its rank among all remainders of its length: documents are numbered within the
task that tokenizes them, and prefix sums over tasks make the ranks global. The plan is broadcast; texts, ids and pieces
never pass the driver. Each window but the last is full.

Defined results: a null or empty text is the end id alone. Rows that repeat an id are packed each. No documents
give no rows. Extra columns are not read. Whole texts are read and every id lies in exactly one piece.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tariffa.llm.common import stored, table

CAPACITY, END = 2048, 1
CACHE = 600_000
VOCABULARY = "word_bpe_49k.json"


class Encoder:
    """Token ids of texts as bytes of little-endian unsigned numbers, word by word, with the words met so far kept.

    The tokenizer drops white space and never joins over it, so a text's ids are those of its words. Words of plain
    Latin letters, digits and marks take a short way: lower case, the tokenizer's own split, its own model. All
    others (and those with `<|`, as in special tokens) are encoded by the tokenizer itself.
    """

    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    PLAIN = regex.compile(r"[!-~¡-¬®-įı-ɏ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4"
        self.packers = [struct.Struct(f"<{n}{'H' if self.kind == '<u2' else 'I'}").pack for n in range(40)]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.letters = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}  # the byte-level alphabet
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return self.packers[len(ids)](*ids) if len(ids) < len(self.packers) else np.array(ids, self.kind).tobytes()

    def piece(self, p: str) -> bytes:
        own = self.pieces.get(p)
        if own is None:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            text = p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode()))
            own = self.pieces[p] = self.packed([t.id for t in self.model.tokenize(text)])
        return own

    def word(self, w: str) -> bytes:
        if w.isascii() and w.isalpha():
            return self.piece(w.lower())
        if self.PLAIN.fullmatch(w) and "<|" not in w:
            return b"".join(map(self.piece, self.SPLIT.findall(w.lower())))
        return self.packed(self.tokenizer.encode(w, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        own = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        out = list(map(self.words.get, own))
        if None in out:
            if len(self.words) >= CACHE:
                self.words.clear()
            for i, x in enumerate(out):
                if x is None:
                    w = own[i]
                    x = self.words.get(w)  # met earlier in this text
                    out[i] = self.words.setdefault(w, self.word(w) if w else b"") if x is None else x
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def fill(counts: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of available lengths whose sum is closest to room without exceeding it."""
    items, reach, seen, mask = [], [1], 1, (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[:room + 1])[::-1].tolist():
        left, k = min(int(counts[length]), room // length), 1
        while left and not seen >> room & 1:
            take = min(k, left)
            seen |= (seen << (take * length)) & mask
            items.append((length, take))
            reach.append(seen)
            left, k = left - take, 2 * k
        if seen >> room & 1:
            break
    at, used = seen.bit_length() - 1, defaultdict(int)
    for i in range(len(items), 0, -1):
        if not reach[i - 1] >> at & 1:
            used[items[i - 1][0]] += items[i - 1][1]
            at -= items[i - 1][0] * items[i - 1][1]
    return dict(used)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict, int]:
    """((length, start in the remainder) -> placements sorted by rank, number of windows).

    A placement is (first rank, end rank, piece length, first window, pieces per window, number of its first piece
    among those, offset of the first). The pieces of ranks r that it holds follow each other through the windows.
    """
    counts, lots = np.zeros(capacity + 1, np.int64), defaultdict(list)
    for length, n in histogram.items():
        counts[length] += n
        lots[length].append((length, 0, n, 0))  # length, first rank, how many, start in the remainder
    out, window = defaultdict(list), 0

    def take(length: int, n: int, per: int, offset: int, cut: int = 0):
        """Place n pieces of a length; with cut, only their first part, and the rest becomes a shorter length."""
        counts[length] -= n
        number = 0
        while n:
            whole, rank, have, start = lots[length].pop()
            k = min(have, n)
            if have > k:
                lots[length].append((whole, rank + k, have - k, start))
            out[whole, start].append((rank, rank + k, cut or length, window, per, number, offset))
            if cut:
                lots[length - cut].append((whole, rank, k, start + cut))
                counts[length - cut] += k
            number, n = number + k, n - k

    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        counts[longest] -= 1
        pattern = fill(counts, capacity - longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        slack = capacity - sum(k * n for k, n in pattern.items())
        times = min(int(counts[k]) // n for k, n in pattern.items())
        spare = 0
        if slack:  # all other lengths are longer than the slack: one of them is cut
            left = counts.copy()
            for k, n in pattern.items():
                left[k] -= n
            spare = int(left.argmax()) if left.any() else 0
            if spare:
                times = max(1, min(times, int(counts[spare]) // (pattern.get(spare, 0) + 1)))
        offset = 0
        for k, n in sorted(pattern.items()):
            take(k, n * times, n, offset)
            offset += k * n
        if spare:
            take(spare, times, 1, offset, slack)
        window += times
    return {key: sorted(rows) for key, rows in out.items()}, window


def _tokens(path: str):
    def run(batches):
        from pyspark import TaskContext

        encode, task, full = encoder(path), TaskContext.get().partitionId(), 0
        ranks: dict[int, int] = defaultdict(int)
        end = np.array([END], encode.kind).tobytes()
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(encode(text or "") + end, encode.kind)
                n, rest = divmod(len(ids), CAPACITY)
                crc = [zlib.crc32(ids[k * CAPACITY:(k + 1) * CAPACITY].astype("<u4").tobytes()) for k in range(n)]
                rows.append((task, i, len(ids), full, crc, rest, ranks[rest], ids[n * CAPACITY:].tobytes()))
                full, ranks[rest] = full + n, ranks[rest] + 1
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] + [pa.int64()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["task", "doc_id", "doc_tokens", "full", "crcs", "rest", "rank", "ids"])
    return run


TOKENS = "task long, doc_id long, doc_tokens long, full long, crcs array<long>, rest long, rank long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces(shared, kind: str):
    def run(batches):
        placed, windows = shared.value
        starts = {key: [r[0] for r in rows] for key, rows in placed.items()}
        for b in batches:
            out = []
            for r in b.to_pylist():
                base = windows + (r["task"] << 36) + r["full"]
                for k, crc in enumerate(r["crcs"]):
                    out.append((r["doc_id"], k * CAPACITY, CAPACITY, crc, r["doc_tokens"], base + k, 0))
                at, rest, rank = 0, r["rest"], r["base"] + r["rank"]
                ids = np.frombuffer(r["ids"], kind)
                while at < rest:
                    first, _, length, window, per, number, offset = placed[rest, at][bisect_right(starts[rest, at], rank) - 1]
                    w, slot = divmod(number + rank - first, per)
                    out.append((r["doc_id"], len(r["crcs"]) * CAPACITY + at, length, zlib.crc32(ids[at:at + length].astype("<u4").tobytes()), r["doc_tokens"], window + w, offset + slot * length))
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], PIECES.replace(" long", "").split(", "))
    return run


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The pieces of all documents (doc_id, text) in windows of CAPACITY ids; path: the tokenizer's file on every machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = stored(rows.mapInArrow(_tokens(path), TOKENS), "tokens")
    own = tokens.groupBy("rest", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["rest"]: r["n"] for r in own.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(plan(histogram))
    base = own.select("rest", "task", (F.sum("n").over(W.partitionBy("rest").orderBy("task")) - F.col("n")).alias("base"))
    return tokens.join(base, ["rest", "task"]).mapInArrow(_pieces(shared, encoder(path).kind), PIECES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
