"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes a row of surface features of its whole text. Every feature is cut into bins at quantiles of
the training sample; cyclic boosting with shallow trees (at most four leaves, one feature at a time) learns a table
of additions per feature. Then the pairs of features whose joint bins explain most of what is left get
two-dimensional tables in the same way. A score is the sum of one entry per table: vectorised look-ups.

The model is fitted in one task on a bounded sample (MOST labelled training rows per class, only their features) and
is a few thousand numbers. Defined results: a null text counts as empty, and an empty text has all features zero and
is scored like any other. Without labels of both classes the score is their share (0.5 if there are none).
Extra columns are not read; repeated rows return repeatedly.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tariffa.llm.common import bucket, free, table
from tariffa.llm.folds import labelled_sample

MOST = 8000
FOLDS, HELD = 3, 1
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, PAIR_BINS = 32, 150, 60, 6, 0.1, 8
FEATURES = ("log_words", "word_length", "longest_word", "distinct_words", "top_word", "single_letters", "upper", "lower", "digit", "stops", "commas", "marks",
            "bars", "symbols", "beyond_ascii", "space", "line_length", "distinct_lines", "capitalised", "compressed", "same_as_before", "marked_words")
_SYMBOLS = [ord(c) for c in "#$%&*+/<=>@\\^_`{}~"]
_PUNCTUATION = b".,;:!?#$%&*+/<=>@\\^_`{}~|\"'()[]-"


def features(text: bytes) -> list[float]:
    """Features of a whole text; all zero if it has no word."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / len(text)
    count, n = Counter(words), len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = list(map(len, words))
    size = sum(len(zlib.compress(text[i:i + 65536], 1)) for i in range(0, len(text), 65536))
    return [np.log1p(n), sum(lengths) / n, float(np.log1p(max(lengths))), len(count) / n ** 0.9, max(count.values()) / n, sum(x == 1 for x in lengths) / n,
            c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[46], c[44], c[33] + c[63], c[124], c[_SYMBOLS].sum(), c[128:].sum(), c[32] + c[9:14].sum(),
            np.log1p(len(text) / len(lines)), len(set(lines)) / len(lines), sum(x[:1].isupper() for x in words) / n, size / len(text),
            sum(a == b for a, b in zip(words, words[1:])) / n, sum(x[-1] in _PUNCTUATION for x in words) / n]


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values per bin of a tree with few leaves along one ordered axis, by gradient and curvature sums per bin."""
    gain = lambda a, b: a * a / (b + 1.0)
    G, H = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (lo, hi) in enumerate(parts):
            if hi - lo > 1:
                s = np.arange(lo + 1, hi)
                w = gain(G[s] - G[lo], H[s] - H[lo]) + gain(G[hi] - G[s], H[hi] - H[s]) - gain(G[hi] - G[lo], H[hi] - H[lo])
                i = int(w.argmax())
                if w[i] > best[0]:
                    best = (w[i], k, int(s[i]))
        if best[1] is None:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = (G[hi] - G[lo]) / (H[hi] - H[lo] + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree on two axes: the better axis first, then each half along the other."""
    best = None
    for axis in (0, 1):
        first = _tree(g.sum(axis=1 - axis), h.sum(axis=1 - axis), 2)
        out = np.zeros_like(g)
        for v in np.unique(first):
            half = np.flatnonzero(first == v)
            own = _tree(np.take(g, half, axis).sum(axis=axis), np.take(h, half, axis).sum(axis=axis), 2)
            out[(half[:, None], np.arange(len(own))[None]) if axis == 0 else (np.arange(len(own))[:, None], half[None])] = own[None] if axis == 0 else own[:, None]
        score = float((out * g).sum())
        if best is None or score > best[0]:
            best = (score, out)
    return best[1]


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
    """The tables of the model from rows of features, labels and weights."""
    share = float((y * w).sum() / w.sum()) if len(y) else 0.5
    model = {"base": float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), "cuts": [], "tables": [], "pairs": []}
    if len(np.unique(y)) < 2:
        return model
    model["cuts"] = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    b = [np.searchsorted(c, v, "right") for c, v in zip(model["cuts"], x.T)]
    model["tables"] = [np.zeros(len(c) + 1) for c in model["cuts"]]
    z = np.full(len(y), model["base"])

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return w * (y - p), w * p * (1 - p)
    for _ in range(ROUNDS):
        for f, t in enumerate(model["tables"]):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[f], g, len(t)), np.bincount(b[f], h, len(t)))
            t += step
            z += step[b[f]]
    coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
    cb = [np.searchsorted(c, v, "right") for c, v in zip(coarse, x.T)]
    g, h = slopes()
    ranked = []
    for i in range(x.shape[1]):
        for j in range(i):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            cell, n = cb[i] * shape[1] + cb[j], shape[0] * shape[1]
            G, H = np.bincount(cell, g, n).reshape(shape), np.bincount(cell, h, n).reshape(shape)
            ranked.append((float((_pair_tree(G, H) * G).sum()), i, j))
    for _, i, j in sorted(ranked, reverse=True)[:PAIRS]:
        model["pairs"].append([i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))])
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, t in model["pairs"]:
            g, h = slopes()
            cell = cb[i] * t.shape[1] + cb[j]
            step = RATE * _pair_tree(np.bincount(cell, g, t.size).reshape(t.shape), np.bincount(cell, h, t.size).reshape(t.shape))
            t += step
            z += step.ravel()[cell]
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.full(len(x), model["base"])
    for c, t, v in zip(model["cuts"], model["tables"], x.T):
        z += t[np.searchsorted(c, v, "right")]
    for i, j, ci, cj, t in model["pairs"]:
        z += t[np.searchsorted(ci, x[:, i], "right"), np.searchsorted(cj, x[:, j], "right")]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _texts(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def _sample_features(batches):
    for b in batches:
        x = [features(t) for t in _texts(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2), b.column(3)], ["doc_id", "x", "y", "weight"])


def _fit(batches):
    rows = pd.concat([b.to_pandas() for b in batches] or [pd.DataFrame({"doc_id": [], "x": [], "y": [], "weight": []})]).sort_values("doc_id")
    x = np.array(rows["x"].tolist()).reshape(-1, len(FEATURES))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(x, rows["y"].to_numpy(float), rows["weight"].to_numpy(float)))])], ["model"])


def train(docs: DataFrame, labels: DataFrame, fold, most: int = MOST) -> dict:
    """The model of a bounded sample of labelled rows with `fold` true; labels: (doc_id, quality)."""
    sample = labelled_sample(docs, labels, "quality", fold, most).withColumn("text", F.col("text").cast("binary"))
    rows = sample.mapInArrow(_sample_features, "doc_id long, x array<double>, y int, weight double").dropDuplicates(["doc_id"])
    return pickle.loads(rows.repartition(1).mapInArrow(_fit, "model binary").first()[0])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All rows and columns of docs, and _score as the last one: the probability of quality 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep, name = docs.columns, free(docs, "_score")
    text = keep.index("text")

    def run(batches):
        for b in batches:
            x = np.array([features(v) for v in _texts(b.column(text))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(predict(shared.value, x))], schema=b.schema.append(pa.field(name, pa.float64())))
    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


def _is_training():
    return bucket(F.col("doc_id"), FOLDS) != HELD


def trained_scores(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """docs[columns] with the score as last column, from a model of the training fold."""
    model = train(docs, labels, _is_training())
    return score(docs.select(*columns, *([] if "text" in columns else ["text"])), model)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trained_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", (bucket(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
