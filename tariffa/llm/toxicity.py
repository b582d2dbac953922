"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a logistic score over hashed features of its words (the word and its
beginnings of three to six letters), and the document's score is the noisy-or of its sentences: one minus the
product of their complements. Weights are learned from document labels alone, by AdaGrad on the likelihood of the
noisy-or, in one task on a bounded sample (MOST labelled training rows per class, only their features). The model
is one weight per hash slot. Sentences whose own score reaches a threshold are the offending ones.

Sentences end at `.`, `!`, `?` and line ends. Defined results: a null text counts as empty; a text without words has
score 0, unless there are no labels of both classes: then every score is their share (0.5 if there are none).
Extra columns are not read; repeated rows return repeatedly.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tariffa.llm.common import bucket, table
from tariffa.llm.folds import labelled_sample

MOST = 4000
FOLDS, HELD = 5, 0
SLOTS, EPOCHS, BATCH, RATE, DECAY, START = 1 << 18, 20, 64, 0.3, 5e-3, -5.0
LEAST_DOCS = 10
_END = re.compile(r"[.!?\n]+")
_EDGE = ",;:|\"'()[]{}<>-_*#$%&"
CACHE = 500_000


def word_slots(word: str) -> list[int]:
    w = word.strip(_EDGE)
    if not w:
        return []
    keys = {w, *(f"{w[:k]}^" for k in (3, 4, 5, 6) if len(w) >= k)}
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) & (SLOTS - 1) for k in sorted(keys)]


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each stretch between sentence ends that holds a word."""
    out, at = [], 0
    for m in _END.finditer(text):
        if text[at:m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    return out + [(at, len(text))] if text[at:].strip() else out


def _bag(text: str, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words, and the number of slots of each sentence; a slot counts once in a sentence."""
    slots, sizes = [], []
    for s in _END.split(text.lower()):
        own = set()
        for w in s.split():
            if w not in cache:
                if len(cache) >= CACHE:
                    cache.clear()
                cache[w] = word_slots(w)
            own.update(cache[w])
        if own:
            slots.append(sorted(own))
            sizes.append(len(own))
    return np.array([x for s in slots for x in s], np.int32), np.array(sizes, np.int32)


def _bags(batches):
    cache: dict = {}
    for b in batches:
        bags = [_bag(t or "", cache) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[k].tobytes() for x in bags], pa.binary()) for k in (0, 1)], b.column(2), b.column(3)], ["doc_id", "slots", "sizes", "y", "weight"])


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray) -> dict:
    """Weights by AdaGrad on the noisy-or likelihood."""
    share = float((y * weight).sum() / weight.sum()) if len(y) else 0.5
    if len(np.unique(y)) < 2:
        return {"share": share}
    # a slot of a few documents would only learn those documents by heart
    df = np.zeros(SLOTS, np.int64)
    for slots, _ in bags:
        df[np.unique(slots)] += 1
    w, bias, seen = np.zeros(SLOTS), START, df >= LEAST_DOCS
    sq, sq_bias = np.full(SLOTS, 1e-3), 1e-3
    rng = np.random.default_rng(0)
    scale = weight / weight.mean()
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            own = [k for k in order[at:at + BATCH] if len(bags[k][1])]
            if not own:
                continue
            slots, sizes = np.concatenate([bags[k][0] for k in own]), np.concatenate([bags[k][1] for k in own])
            n = np.array([len(bags[k][1]) for k in own])
            z = np.add.reduceat(w[slots], np.r_[0, np.cumsum(sizes)[:-1]]) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            first = np.r_[0, np.cumsum(n)[:-1]]
            clean = np.exp(-np.add.reduceat(np.logaddexp(0, z), first))  # product of the complements
            pull = np.where(y[own] == 1, -clean / np.maximum(1 - clean, 1e-6), 1.0) * scale[own]
            g = np.repeat(pull, n) * p  # slope of the loss by each sentence's score
            used, inverse = np.unique(slots, return_inverse=True)
            gw = (np.bincount(inverse, np.repeat(g, sizes)) + DECAY * w[used]) * seen[used]
            sq[used] += gw * gw
            w[used] -= RATE * gw / np.sqrt(sq[used])
            sq_bias += g.sum() ** 2
            bias -= RATE * g.sum() / np.sqrt(sq_bias)
    return {"share": share, "w": w.astype(np.float32), "bias": float(bias)}


def _fit(batches):
    rows = pd.concat([b.to_pandas() for b in batches] or [pd.DataFrame({c: [] for c in ("doc_id", "slots", "sizes", "y", "weight")})]).sort_values("doc_id")
    bags = [(np.frombuffer(s, np.int32), np.frombuffer(n, np.int32)) for s, n in zip(rows["slots"], rows["sizes"])]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(bags, rows["y"].to_numpy(float), rows["weight"].to_numpy(float)))])], ["model"])


def train(docs: DataFrame, labels: DataFrame, fold, most: int = MOST) -> dict:
    """The model of a bounded sample of labelled rows with `fold` true; labels: (doc_id, toxic)."""
    sample = labelled_sample(docs, labels, "toxic", fold, most)
    rows = sample.mapInArrow(_bags, "doc_id long, slots binary, sizes binary, y int, weight double").dropDuplicates(["doc_id"])
    return pickle.loads(rows.repartition(1).mapInArrow(_fit, "model binary").first()[0])


class Scorer:
    """Sentence scores of texts, with the sum of each word's weights kept for the words met so far."""

    def __init__(self, model: dict):
        self.model, self.cache, self.slots = model, {}, {}

    def sentence(self, words: list[str]) -> float:
        """The logistic score before squashing; every slot counts once."""
        own: set[int] = set()
        for x in set(words):
            s = self.slots.get(x)
            if s is None:
                if len(self.slots) >= CACHE:
                    self.slots.clear()
                # a slot without weight adds nothing
                s = self.slots[x] = tuple(k for k in word_slots(x) if self.model["w"][k])
            own.update(s)
        return float(self.model["w"][list(own)].sum()) if own else 0.0

    def document(self, text: str) -> tuple[float, np.ndarray]:
        """Noisy-or of the sentences, and the score of each."""
        if "w" not in self.model:
            return self.model["share"], np.zeros(0)
        z = np.array([self.sentence(s) for s in map(str.split, _END.split(text.lower())) if s]) + self.model["bias"]
        return float(-np.expm1(-np.logaddexp(0, z).sum())), 1 / (1 + np.exp(-z))


def score(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, n_sentences and n_offending of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            out = [scorer.document(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([len(p) for _, p in out], pa.int64()),
                                              pa.array([int((p >= threshold).sum()) for _, p in out], pa.int64())], ["doc_id", "score", "n_sentences", "n_offending"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_sentences long, n_offending long")


def locate(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, sentence, score of each offending sentence; start and end count code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for lo, hi in sentences(t or "") if "w" in shared.value else []:
                    p = 1 / (1 + np.exp(-(scorer.sentence(t[lo:hi].lower().split()) + shared.value["bias"])))
                    if p >= threshold:
                        rows.append((i, lo, hi, t[lo:hi], float(p)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()))], ["doc_id", "start", "end", "sentence", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, end long, sentence string, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels"), bucket(F.col("doc_id"), FOLDS) != HELD))
    return out.select("doc_id", (bucket(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_offending")
