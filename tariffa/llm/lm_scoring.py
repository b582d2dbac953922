"""Language-model scores by logistic context mixing.

A text is one stream of bytes, in its own order: each word, then a space; the end of a text is a space alone, its beginning
follows blanks. Every byte is eight binary choices. For each choice, bit predictors keyed by hashed contexts (no byte, the last
one to four bytes of the stream, also those of the words before, the whole beginning of the word, each with the bits known so far)
give counts of zeros and ones over all training tokens. Their stretched probabilities are mixed by weights that a gate (how much
the two longest contexts have seen) selects, learned online by gradient steps as the training tokens stream by; each choice is
predicted from the counts of all other tokens. A last table, keyed by the mixed probability and the bits of the byte, refines it.
Within a document the score adapts to its own words: for each of a few strengths a (ADAPT), a word seen k times among
t tokens so far has probability (k + a p) / (t + a) with p from the mixture; these and p itself are averaged per document.

No context is longer than four bytes or the word. So of the bytes of a token only the first HEAD depend on what stands before the
word: on the HEAD bytes before its space. Such a pair (bytes before, first bytes) has one code length wherever it stands, and so
have all later bytes of a word. Words and pairs are counted first, over all texts; each distinct one is coded once, with its count
as weight, and a token costs its pair and its word. This is the code of every occurrence in its place, without coding it again.
Words that make up at least 1 / HOT of all tokens (at most HOT of them) are looked up by broadcast; rarer ones by a join, per
document and occurrence. Pairs of at least 1 / HOT_PAIRS of all are broadcast; a task codes rarer ones from the same model. The
count tables have a fixed size (SIZES), the vocabulary grows with the texts. Learners of separate parts of it are averaged.

Defined results: a null or empty text is the end token alone. Without training texts every bit costs one bit and the
base has no counts. Rows that repeat an id are scored each. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from tariffa.llm.common import bucket, stored, table

FOLDS, HELD = 7, 2
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bits of the table of each context: none, one to four bytes, the whole beginning.
SIZES = (8, 16, 20, 20, 20, 21)
OFFSETS = np.cumsum([0, *(1 << b for b in SIZES)])
BLOCKS, INPUTS, HOT = 256, len(SIZES) + 1, 1 << 18
LEVELS = (0.5, 1.5, 3.5, 15.5, 255.5)
GATES, STEPS, PRIOR, RATE, REFINE = 6 * 6 * 3 + 64, 24, 0.4, 0.05, 20.0
MIX = np.uint64(0x9E3779B97F4A7C15)
PART, COUNTED, SLICE, SLICE_BYTES = 8192, 400_000, 500, 4 << 20
#: Bytes of a word that contexts from before it reach, and as many bytes before it; pairs to broadcast at most.
HEAD, HOT_PAIRS = 3, 1 << 21
ADAPT = (30.0, 3000.0)
SUMS = ("base", "cost", *[f"rise{i}" for i in range(len(ADAPT))])
LN2 = float(np.log(2))


def contexts(words: list[bytes], tails: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words with their spaces, the position of each in its word, and a hash per context and byte.

    tails: the HEAD bytes before the space before each word (blanks if it begins a text, as without tails).
    """
    lead = HEAD + 1
    n = np.array([len(w) + 1 + lead for w in words])
    blank = b" " * HEAD
    flat = np.frombuffer(b"".join([x for w, t in zip(words, tails or repeat(blank)) for x in (t, b" ", w, b" ")]), np.uint8).astype(np.uint64)
    first = np.repeat(np.cumsum(n) - n, n) + lead
    at = np.arange(len(flat)) - first
    coded = at >= 0
    out, h = np.zeros((len(SIZES), len(flat)), np.uint64), np.zeros(len(flat), np.uint64)
    for k in range(1, 5):
        before = np.zeros(len(flat), np.uint64)
        before[k:] = flat[:-k] + np.uint64(1)
        h = h * np.uint64(257) + before
        out[k] = h
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(n.max()), 0x100000001B3, np.uint64)])[np.maximum(at, 0)]
    sums = np.cumsum(np.where(coded, (flat + np.uint64(1)) * power, np.uint64(0)))
    out[5] = np.where(at > 0, np.r_[np.uint64(0), sums[:-1]] - sums[first - 1], np.uint64(0))
    out[2:] = (out[2:] ^ (out[2:] >> np.uint64(29))) * MIX + np.arange(2, len(SIZES), dtype=np.uint64)[:, None]
    return flat[coded], at[coded], out[:, coded]


def coded(words: list[bytes], tails: list[bytes] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of the bytes of a word behind its head, or (with tails) of its head alone; and the number of each byte's word."""
    flat, at, h = contexts(words, tails)
    keep = at >= HEAD if tails is None else at < HEAD
    return flat[keep], at[keep], h[:, keep], (np.cumsum(at == 0) - 1)[keep]


def pair_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pair of each token of texts (words joined by one space), their ends included, as one number; and the tokens of each text."""
    pieces = [b" " * (HEAD + 1) + x + b" " if x else b" " * (HEAD + 1) for x in texts]
    ends = np.cumsum([len(x) for x in pieces])
    flat = np.frombuffer(b"".join(pieces) + b" " * HEAD, np.uint8)
    blank = flat == 32
    begins = np.zeros(len(flat), bool)
    begins[1:] = blank[:-1] & ~blank[1:]
    begins[ends] = True
    at = np.flatnonzero(begins)
    key, open_ = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for k in range(HEAD):
        key = key << 8 | flat[at - HEAD - 1 + k]
    for k in range(HEAD):  # a head ends with its first space
        key = key << 8 | np.where(open_, flat[at + k], 32)
        open_ &= ~blank[at + k]
    return key, np.diff(np.searchsorted(at, ends, "right"), prepend=0)


def pair_texts(keys: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(first bytes, bytes before) of pairs."""
    raw = keys.astype(">i8").tobytes()
    return [raw[i - HEAD:i].split(b" ", 1)[0] for i in range(8, len(raw) + 1, 8)], [raw[i - 2 * HEAD:i - HEAD] for i in range(8, len(raw) + 1, 8)]


def slots(hashes: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Table places of each context for the bits known so far (node: a one, then those bits)."""
    out = np.empty(hashes.shape, np.int64)
    out[0] = node
    out[1] = OFFSETS[1] + ((hashes[1] << np.uint64(8)) | node).astype(np.int64) % (1 << SIZES[1])
    for i in range(2, len(SIZES)):
        h = (hashes[i] + node * np.uint64(0xD6E8FEB86659FD93)) * MIX
        out[i] = OFFSETS[i] + (h >> np.uint64(64 - SIZES[i])).astype(np.int64)
    return out


def _bits(flat: np.ndarray):
    """(number, node, bit) of each of the eight choices of all bytes."""
    for k in range(8):
        yield k, (flat | np.uint64(256)) >> np.uint64(8 - k), ((flat >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)


def _cuts(words: list[bytes]):
    """Parts of bounded bytes (a longer word is a part of its own)."""
    at = size = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= PART or i + 1 == len(words):
            yield at, i + 1
            at, size = i + 1, 0


def _parts(batches):
    """(words, tails, rows, batch) of batches (word, pair, ...), in parts: words without tails, then the heads of pairs."""
    for b in batches:
        paired_rows = np.asarray(b.column(1).is_valid())
        for tails, own in ((False, ~paired_rows), (True, paired_rows)):
            rows = np.flatnonzero(own)
            if tails:
                words, before = pair_texts(np.asarray(b.column(1).take(pa.array(rows)), np.int64))
            else:
                words, before = b.column(0).take(pa.array(rows)).to_pylist(), None
            for lo, hi in _cuts(words):
                yield words[lo:hi], before and before[lo:hi], rows[lo:hi], b


def _count_tables(batches):
    """Dense counts of one part of the vocabulary, cut into blocks."""
    counts = np.zeros((2, OFFSETS[-1]), np.float32)
    flat_counts = counts.ravel()
    for words, tails, rows, b in _parts(batches):
        flat, _, h, of = coded(words, tails)
        own = np.asarray(b.column(2), np.float32)[rows][of]
        for _, node, bit in _bits(flat):
            for place in slots(h, node):
                np.add.at(flat_counts, place + bit * OFFSETS[-1], own)
    edges = np.linspace(0, OFFSETS[-1], BLOCKS + 1).astype(int)
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        block = counts[:, lo:hi]
        if block.any():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pa.compress(block.tobytes(), codec="zstd", asbytes=True)]), pa.array([block.nbytes])], ["block", "counts", "size"])


def _sum_blocks(key, rows):
    """The sum of one block over the parts of the vocabulary, of which there are at most BLOCKS."""
    parts = (np.frombuffer(pa.decompress(c.as_py(), n.as_py(), codec="zstd", asbytes=True), np.float32) for c, n in zip(rows["counts"], rows["size"]))
    return pa.table({"block": [key[0].as_py()], "counts": [sum(parts).tobytes()]})


def paired(counts: np.ndarray) -> np.ndarray:
    """Counts of zeros and ones (2, places) as one 8-byte number per place."""
    return np.ascontiguousarray(counts.T).view(np.float64).ravel()


def _level(n: np.ndarray) -> np.ndarray:
    """How many LEVELS a count is over."""
    return sum((n > x).view(np.int8) for x in LEVELS).astype(np.int64)


def _inputs(counts: np.ndarray, h: np.ndarray, node: np.ndarray, k: int, at: np.ndarray, seen: np.ndarray | None):
    """Stretched probabilities of all contexts (and a constant), and two gates. seen: bits that don't count themselves."""
    # both counts of a place lie side by side, so one look-up fetches them
    both = counts[slots(h, node)].view(np.float32).reshape(*h.shape, 2)
    n0, n1 = both[..., 0], both[..., 1]
    if seen is not None:
        seen = seen.astype(np.float32)
        n0, n1 = np.maximum(n0 - (1 - seen), 0), np.maximum(n1 - seen, 0)
    x = np.empty((INPUTS, h.shape[1]), np.float32)
    x[:-1] = np.clip(np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR))), -12, 12)
    x[-1] = 0.3
    one_way = np.where(n0[5] == 0, 1, np.where(n1[5] == 0, 2, 0))
    first = (_level(n0[5] + n1[5]) * 6 + _level(n0[3] + n1[3])) * 3 + one_way
    return x, (first, 6 * 6 * 3 + np.minimum(at, 7) * 8 + k)


def _mixed(w: np.ndarray, gates, x: np.ndarray) -> np.ndarray:
    """Weights of both gates add up."""
    return np.clip(np.einsum("ij,ji->i", w[gates[0]] + w[gates[1]], x), -12, 12)


def _step(z: np.ndarray) -> np.ndarray:
    return np.clip((z + 12) * (STEPS / 24), 0, STEPS - 1).astype(np.int64)


def _learn(shared):
    def run(batches):
        counts = shared.value
        w, sq, seen = np.full((GATES, INPUTS), 0.15), np.full((GATES, INPUTS), 1e-4), 0.0
        refine = np.zeros((2, 256 * STEPS))
        for words, tails, rows, b in _parts(batches):
            flat, at, h, of = coded(words, tails)
            own = np.asarray(b.column(2), np.float64)[rows][of]
            seen += own.sum()
            for k, node, bit in _bits(flat):
                x, gates = _inputs(counts, h, node, k, at, bit)
                z = _mixed(w, gates, x)
                err = (bit - 1 / (1 + np.exp(-z))) * own
                mass = np.maximum(sum(np.bincount(gate, own, GATES) for gate in gates), 1e-9)
                g = np.stack([sum(np.bincount(gate, err * v, GATES) for gate in gates) / mass for v in x], axis=1)
                sq += g * g
                w += RATE * g / np.sqrt(sq)
                place = node.astype(np.int64) * STEPS + _step(z)
                refine += np.bincount(bit * refine.shape[1] + place, own, refine.size).reshape(refine.shape)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (w, refine)] + [pa.array([seen])], ["w", "refine", "seen"])
    return run


def _cost(model: dict, flat: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Code length of each byte, in bits."""
    cost = np.zeros(len(flat))
    for k, node, bit in _bits(flat):
        x, gates = _inputs(model["counts"], h, node, k, at, None)
        z = _mixed(model["w"], gates, x)
        p = 1 / (1 + np.exp(-z))
        place = node.astype(np.int64) * STEPS + _step(z)
        n0, n1 = model["refine"][0, place], model["refine"][1, place]
        p = np.clip((p + (n1 + REFINE * p) / (n0 + n1 + REFINE)) / 2, 1e-6, 1 - 1e-6)
        cost -= np.log2(np.where(bit == 1, p, 1 - p))
    return cost


def bits(words: list[bytes], model: dict, tails: list[bytes] | None = None) -> np.ndarray:
    """Code length of each word and its space, in bits."""
    flat, at, h = contexts(words, tails)
    return np.add.reduceat(_cost(model, flat, at, h), np.flatnonzero(at == 0))


def part_bits(words: list[bytes], model: dict, tails: list[bytes] | None) -> np.ndarray:
    """Code length of what lies behind the head of each word, or (with tails) of its head."""
    out = [np.zeros(0)]
    for lo, hi in _cuts(words):
        flat, at, h, of = coded(words[lo:hi], tails and tails[lo:hi])
        out.append(np.bincount(of, _cost(model, flat, at, h), hi - lo))
    return np.concatenate(out)


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their sums of parts (keys, training counts, counts)."""
    keys, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *[np.bincount(of, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (1, 2)]


def _count_words(batches):
    """(word, pair, training count, count) of the words, then the pairs of a task's texts; the end of text is the empty word."""
    train: Counter = Counter()
    held: Counter = Counter()
    pairs, open_ = [], 0

    def rows(words, keys, c, t):
        kinds = [pa.array(words, pa.binary()), pa.nulls(len(c), pa.int64())] if keys is None else [pa.nulls(len(c), pa.binary()), pa.array(keys, pa.int64())]
        return pa.RecordBatch.from_arrays([*kinds, pa.array(c, pa.int64()), pa.array(t, pa.int64())], ["word", "pair", "c", "t"])

    def out():
        words = list(train.keys() | held.keys())
        c = [train.get(w, 0) for w in words]
        for i in range(0, len(words), 20000):
            yield rows(words[i:i + 20000], None, c[i:i + 20000], [a + held.get(w, 0) for w, a in zip(words[i:i + 20000], c[i:i + 20000])])
        train.clear()
        held.clear()

    def pairs_out():
        keys, c, t = pairs[0]
        for i in range(0, len(keys), 20000):
            yield rows(None, keys[i:i + 20000], c[i:i + 20000], t[i:i + 20000])
        pairs.clear()
    for b in batches:
        for texts, held_rows in _slices(b):
            joined = []
            for x, h in zip(texts, held_rows):
                own, words = held if h else train, _words(x)
                own.update(words)
                own[b""] += 1
                joined.append(b" ".join(words))
                if len(train) + len(held) > COUNTED:
                    yield from out()
            keys, n = pair_keys(joined)
            pairs.append((keys, np.repeat([not h for h in held_rows], n).astype(float), np.ones(len(keys))))
            open_ += len(keys)
            if open_ > 4 * COUNTED:
                pairs[:], open_ = [_merged(pairs)], 0
                if len(pairs[0][0]) > COUNTED:
                    yield from pairs_out()
    yield from out()
    if pairs:
        pairs[:] = [_merged(pairs)]
        yield from pairs_out()


def _slices(b):
    """(texts, second column) of a batch, in slices of at most SLICE rows and about SLICE_BYTES."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(0)), 0), np.int64)
    at = 0
    while at < b.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(size[at:at + SLICE]), SLICE_BYTES)))
        yield b.column(0)[at:at + n], b.column(1)[at:at + n].to_pylist()
        at += n


def _words(x) -> list[bytes]:
    return x.as_buffer().to_pybytes().translate(LOWER).split() if x.is_valid else []


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, pair, c, t) of all words and then all pairs of docs (text, held_out), the other one null: counts in training texts
    and in all; written to the shared folder."""
    rows = docs.select(F.col("text").cast("binary").alias("text"), "held_out").mapInArrow(_count_words, "word binary, pair long, c long, t long")
    return stored(rows.groupBy("word", "pair").agg(F.sum("c").alias("c"), F.sum("t").alias("t")), "vocabulary")


def train(words: DataFrame, distinct: int) -> dict:
    """The model of (word, pair, c): count tables first, then mixing weights and refinement from a second pass."""
    sc = words.sparkSession.sparkContext
    parts = words.where("c > 0").select("word", "pair", "c").coalesce(min(256, max(4, distinct >> 18)))
    summed = parts.mapInArrow(_count_tables, "block long, counts binary, size long").groupBy("block").applyInArrow(_sum_blocks, "block long, counts binary")
    counts, edges = np.zeros((2, OFFSETS[-1]), np.float32), np.linspace(0, OFFSETS[-1], BLOCKS + 1).astype(int)
    for r in summed.collect():  # at most BLOCKS rows of a fixed size
        k = r["block"]
        counts[:, edges[k]:edges[k + 1]] = np.frombuffer(r["counts"], np.float32).reshape(2, -1)
    shared = sc.broadcast(paired(counts))
    learned = parts.mapInArrow(_learn(shared), "w binary, refine binary, seen double").collect()
    model = {"shared": shared, "w": np.zeros((GATES, INPUTS)), "refine": np.zeros((2, 256 * STEPS))}
    total = sum(r["seen"] for r in learned) or 1.0
    for r in learned:
        model["w"] += np.frombuffer(r["w"]).reshape(GATES, INPUTS) * (r["seen"] / total)
        model["refine"] += np.frombuffer(r["refine"]).reshape(2, -1)
    return model


def word_scores(words: DataFrame, model: dict) -> DataFrame:
    """(word, pair, c, t, cost): the bits of each word behind its head, and of the head of each pair."""
    shared, small = model["shared"], {k: v for k, v in model.items() if k != "shared"}

    def run(batches):
        full = small | {"counts": shared.value}
        for b in batches:
            cost = np.zeros(b.num_rows)
            for own, tails, rows, _ in _parts([b]):
                cost[rows] = part_bits(own, full, tails)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cost)], ["word", "pair", "c", "t", "cost"])
    return words.mapInArrow(run, "word binary, pair long, c long, t long, cost double")


def _log_gamma(y: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for y >= 1, by Stirling's series from y + 7 on."""
    z = y + 7
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) - np.log(y * (y + 1) * (y + 2) * (y + 3) * (y + 4) * (y + 5) * (y + 6))


def rise(n: np.ndarray, a: float, cost: np.ndarray) -> np.ndarray:
    """Logarithm of the product of k + a p for k from 0 to n - 1, where p is 2 to the minus cost."""
    once = np.log(a) - cost * LN2
    many = n > 1
    if many.any():
        x = a * np.exp(-cost[many] * LN2)
        once[many] += _log_gamma(n[many] + x) - _log_gamma(1 + x)
    return once


def _packed(batches):
    """Pairs and their costs, a batch as one row."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(b.column(i), kind).tobytes()], pa.binary()) for i, kind in ((0, np.int64), (1, np.float64))], ["pair", "cost"])


def _seen(ids: np.ndarray) -> np.ndarray:
    """How often each value stood earlier."""
    own, order = np.divmod(np.sort(ids * len(ids) + np.arange(len(ids))), max(len(ids), 1))  # place within value
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
    return out


def _heads(keys: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], model: dict) -> np.ndarray:
    """The cost of the head of each token; of pairs that are not among the frequent ones by the model."""
    own, of = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(pairs[0], own), max(len(pairs[0]) - 1, 0))
    met = pairs[0][at] == own if len(pairs[0]) else np.zeros(len(own), bool)
    cost = np.zeros(len(own))
    cost[met] = pairs[1][at[met]]
    words, tails = pair_texts(own[~met])
    cost[~met] = part_bits(words, model, tails)
    return cost[of]


def _documents(frequent, model: dict):
    shared, small = model["shared"], {k: v for k, v in model.items() if k != "shared"}

    def run(batches):
        from pyspark import TaskContext

        hot, entries, pairs = frequent.value  # word to number; (known, base, cost) by number; pairs in order and their costs
        full = small | {"counts": shared.value}
        k = TaskContext.get().partitionId() << 40
        for b in batches:
            for texts, ids in _slices(b):
                words, joined, tokens, local = [], [], [], {}
                for x in texts:
                    own = _words(x)
                    words += own
                    words.append(b"")
                    joined.append(b" ".join(own))
                    tokens.append(len(own) + 1)
                docs, n = len(tokens), np.array(tokens)
                of, head = np.repeat(np.arange(docs), n), _heads(pair_keys(joined)[0], pairs, full)
                number = np.fromiter(map(hot.get, words, repeat(-1)), np.int64, len(words))
                met, rest = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
                rare = [words[i] for i in rest.tolist()]
                number[rest] = [len(hot) + local.setdefault(w, len(local)) for w in rare]
                seen = _seen(of * (len(hot) + len(local)) + number)
                number[rest] = -1
                e, of_met, cost = entries[number[met]], of[met], entries[number[met], 2] + head[met]
                total = lambda v: np.bincount(of_met, v, docs).astype(float)  # noqa: B023, E731
                sums = [total(e[:, 1]), total(cost)]
                for a in ADAPT:
                    with np.errstate(divide="ignore"):
                        again = np.log(seen[met] + a * np.exp(-cost * LN2))
                    sums.append(total(np.where(seen[met] > 0, again, np.log(a) - cost * LN2)) - rise(n.astype(float), a, np.zeros(docs)))
                offsets = np.r_[0, np.cumsum(np.bincount(of[rest], minlength=docs))].astype(np.int32)
                left = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(seen[rest].astype(np.int32)), pa.array(head[rest].astype(np.float32))], ["word", "seen", "head"])
                size = [len(x) + 2 if x else 1 for x in joined]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(k, k + docs)), pa.array(ids, pa.int64()), pa.array(tokens, pa.int64()), pa.array(size, pa.int64()), pa.array(total(e[:, 0]).astype(np.int64)),
                     *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(offsets), left)], ["k", "doc_id", "n_tokens", "bytes", "known", *SUMS, "rest"])
                k += docs
    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of docs (doc_id, text, held_out)."""
    spark = docs.sparkSession
    words = vocabulary(docs)
    is_word, known = F.col("pair").isNull(), F.col("c") > 0
    n, v, total, units = words.agg(F.coalesce(F.sum(F.when(is_word, F.col("c"))), F.lit(0)), F.count_if(is_word & known), F.coalesce(F.sum(F.when(is_word, F.col("t"))), F.lit(0)), F.count_if(known)).first()
    model, often_pair = train(words, units), F.col("t") * HOT_PAIRS >= total
    scored = stored(word_scores(words.where(is_word | often_pair), model), "word-scores")
    packed = scored.where(~is_word).select("pair", "cost").mapInArrow(_packed, "pair binary, cost binary").collect()  # at most HOT_PAIRS numbers each
    keys, costs = (np.frombuffer(b"".join(r[i] for r in packed), kind) for i, kind in ((0, np.int64), (1, np.float64)))
    order = np.argsort(keys)
    scored = scored.where(is_word).select("word", "t", known.cast("int").alias("known"), F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("base"), "cost")
    often = scored.where(F.col("t") * HOT >= total).select("word", "known", "base", "cost").collect()  # at most HOT words
    hot = {bytes(r["word"]): i for i, r in enumerate(often)}, np.array([r[1:] for r in often], float).reshape(-1, 3), (keys[order], costs[order])
    rows = docs.select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    sums_type = ", ".join(f"{c} double" for c in SUMS)
    rows = stored(rows.mapInArrow(_documents(spark.sparkContext.broadcast(hot), model), f"k long, doc_id long, n_tokens long, bytes long, known long, {sums_type}, rest array<struct<word:binary,seen:int,head:float>>"), "documents")
    rest = rows.select("k", F.explode("rest").alias("r")).select("k", "r.*")
    rare = scored.where(F.col("t") * HOT < total).select("word", "known", "base", F.col("cost").alias("behind"))
    met = rest.join(rare, "word").withColumn("cost", F.col("behind") + F.col("head"))
    terms = {"known": F.col("known"), "base": F.col("base"), "cost": F.col("cost")}
    for i, a in enumerate(ADAPT):
        terms[f"rise{i}"] = F.when(F.col("seen") > 0, F.log(F.col("seen") + a * F.exp(-F.col("cost") * LN2))).otherwise(float(np.log(a)) - F.col("cost") * LN2)
    sums = met.groupBy("k").agg(*[F.sum(x).alias(f"_{c}") for c, x in terms.items()])
    out = rows.drop("rest").join(sums, "k", "left")
    whole = {c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in terms}
    logs = [-whole["cost"] * LN2, *[whole[f"rise{i}"] for i in range(len(ADAPT))]]
    top = F.greatest(*logs)
    mean = top + F.log(sum(F.exp(x - top) for x in logs) / len(logs))
    return out.select("doc_id", "n_tokens", whole["known"].cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), whole["base"].alias("base_score"),
                      (mean / float(np.log(10))).alias("score"), (-mean / LN2 / F.col("bytes")).alias("bits_per_byte"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = (bucket(F.col("doc_id"), FOLDS) == HELD)
    out = score(table(spark, sf_dir, "documents").withColumn("held_out", held))
    return out.withColumn("held_out", held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
