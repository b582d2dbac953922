"""The two classifiers beside plain loops: noisy-or fit and scores, sums of table entries."""
import bisect
import math
import re
import zlib

import numpy as np
import pytest

from tariffa.llm import quality, toxicity as tox

WORDS = "the quick brown fox knave jumps over lazy fool dogs again until night falls".split()


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(n):
        own = [" ".join(rng.choice(WORDS, rng.integers(1, 7))) for _ in range(rng.integers(1, 5))]
        texts.append("".join(s + rng.choice([". ", "! ", "\n"]) for s in own))
    texts[:3] = ["", " .!\n", "one"]
    return texts, np.array([float("knave" in t or "fool" in t) for t in texts])


def plain_slots(sentence):
    keys = set()
    for w in sentence.split():
        w = w.strip(",;:|\"'()[]{}<>-_*#$%&")
        if w:
            keys |= {w} | {w[:k] + "^" for k in (3, 4, 5, 6) if len(w) >= k}
    return {zlib.crc32(k.encode()) % tox.SLOTS for k in keys}


def plain_fit(bags, y, weight, epochs):
    """AdaGrad on the noisy-or likelihood, a sentence at a time; the same order of documents."""
    df = {}
    for b in bags:
        for s in set().union(*b):
            df[s] = df.get(s, 0) + 1
    w, sq, bias, sq_bias = {}, {}, tox.START, 1e-3
    mean, rng = sum(weight) / len(weight), np.random.default_rng(0)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), tox.BATCH):
            slope, total = {}, 0.0
            for k in order[at:at + tox.BATCH]:
                if not bags[k]:
                    continue
                z = [sum(w.get(s, 0.0) for s in b) + bias for b in bags[k]]
                p = [1 / (1 + math.exp(-x)) for x in z]
                clean = math.prod(1 - x for x in p)
                pull = (-clean / max(1 - clean, 1e-6) if y[k] == 1 else 1.0) * weight[k] / mean
                for b, x in zip(bags[k], p):
                    total += pull * x
                    for s in b:
                        slope[s] = slope.get(s, 0.0) + pull * x
            for s, g in slope.items():
                g = (g + tox.DECAY * w.get(s, 0.0)) * (df[s] >= tox.LEAST_DOCS)
                sq[s] = sq.get(s, 1e-3) + g * g
                w[s] = w.get(s, 0.0) - tox.RATE * g / math.sqrt(sq[s])
            sq_bias += total ** 2
            bias -= tox.RATE * total / math.sqrt(sq_bias)
    return w, bias


def test_noisy_or_fit_and_scores(monkeypatch):
    monkeypatch.setattr(tox, "EPOCHS", 3)
    texts, y = corpus(150, 1)
    weight = np.where(y == 1, 1.0, 2.5)
    model = tox.fit([tox._bag(t, {}) for t in texts], y, weight)
    bags = [[s for s in map(plain_slots, re.split("[.!?\n]+", t.lower())) if s] for t in texts]
    w, bias = plain_fit(bags, y, weight, 3)
    assert model["bias"] == pytest.approx(bias, abs=1e-6)
    used = {s: v for s, v in w.items() if abs(v) > 1e-9}
    assert set(np.flatnonzero(np.abs(model["w"]) > 1e-9).tolist()) == set(used)
    assert all(model["w"][s] == pytest.approx(v, abs=1e-5) for s, v in used.items())
    scorer = tox.Scorer(model)
    for t, b in zip(texts, bags):
        score, each = scorer.document(t)
        p = [1 / (1 + math.exp(-(sum(float(model["w"][s]) for s in x) + model["bias"]))) for x in b]
        assert score == pytest.approx(1 - math.prod(1 - x for x in p), abs=1e-6)
        assert sorted(each)[-len(p):] == pytest.approx(sorted(p), abs=1e-6) if p else score < 0.05


def test_labels_against_awkward_rows(spark, docs):
    """Labels on null, empty, very long and repeated rows: the fit stands and every row is scored."""
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(-4, 12)] + [(1, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scored = tox.score(docs, tox.train(docs, labels, quality._is_training())).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    scored = quality.score(docs, quality.train(docs, labels, quality._is_training())).collect()
    assert len(scored) == docs.count() and all(0 <= r["_score"] <= 1 for r in scored)
    same = {}
    for r in scored:
        same.setdefault(r["text"], set()).add(r["_score"])
    assert all(len(s) == 1 for s in same.values())  # a score depends on the text alone


def test_table_sums():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    x[:, 1] = np.round(x[:, 1])
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(float)
    model = quality.fit(x, y, np.ones(len(y)))
    got = quality.predict(model, x)
    for row, p in zip(x, got):
        z = model["base"]
        for f, (cuts, tab) in enumerate(zip(model["cuts"], model["tables"])):
            z += tab[bisect.bisect_right(cuts.tolist(), row[f])]
        for i, j, ci, cj, tab in model["pairs"]:
            z += tab[bisect.bisect_right(ci.tolist(), row[i])][bisect.bisect_right(cj.tolist(), row[j])]
        assert p == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    assert ((got > 0.5) == y).mean() > 0.85  # the pair of features is found
