import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tariffa.llm import lm_scoring as lm

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) + [""]


def brute(rows):
    """n_tokens, n_known, N and base score per row, by plain counting."""
    train = Counter(w for _, t, h in rows if not h for w in tokens(t))
    n, v = sum(train.values()), len(train)
    return [(i, len(tokens(t)), sum(w in train for w in tokens(t)), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t, _ in rows]


def test_whole_table_counts_equal_brute_force_and_model_is_sound(spark):
    got = {r["doc_id"]: r for r in lm.op9_lm_scoring(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in docs]
    for i, n, known, total, base in brute(rows):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0 and 0 < r["bits_per_byte"] < 8
    assert [r["held_out"] for r in got.values()] == [{i: h for i, _, h in rows}[i] for i in got]
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(-len(" ".join(tokens(t)).encode()) * 3.3 * math.log10(2) for i, t, h in rows if h)


def test_awkward_rows(spark, docs, no_docs):
    rows = docs.withColumn("held_out", F.col("doc_id") == 9)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm.score(rows).collect()), key=str)
    want = brute([(r["doc_id"], r["text"], r["doc_id"] == 9) for r in docs.collect()])
    assert got == sorted(((i, n, k, t, round(b, 6)) for i, n, k, t, b in want), key=str)
    assert lm.score(no_docs.withColumn("held_out", F.lit(False))).collect() == []
    untrained = lm.score(docs.where("doc_id in (1, 6)").withColumn("held_out", F.lit(True))).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in untrained)


def test_probabilities_sum_to_one():
    """Over all next bytes after some beginnings, with counts and weights of no special kind."""
    rng = np.random.default_rng(1)
    model = {"counts": lm.paired(rng.integers(0, 5, (2, lm.OFFSETS[-1])).astype(np.float32)), "w": rng.normal(0.2, 0.2, (lm.GATES, lm.INPUTS)), "refine": rng.integers(0, 9, (2, 256 * lm.STEPS)).astype(float)}
    for start in (b"", b"t", b"th", "wör".encode(), b"abcdefgh"):
        # a word's cost splits into its bytes: compare words that share the beginning and differ in the last byte
        flat, at, h = lm.contexts([start + bytes([b]) for b in range(256)])
        p = np.ones(len(flat))
        for k, node, bit in lm._bits(flat):
            x, gates = lm._inputs(model["counts"], h, node, k, at, None)
            q = 1 / (1 + np.exp(-lm._mixed(model["w"], gates, x)))
            place = node.astype(int) * lm.STEPS + lm._step(np.log(q / (1 - q)))
            n0, n1 = model["refine"][0, place], model["refine"][1, place]
            q = np.clip((q + (n1 + lm.REFINE * q) / (n0 + n1 + lm.REFINE)) / 2, 1e-6, 1 - 1e-6)
            p *= np.where(bit == 1, q, 1 - q)
        assert p[at == len(start)].sum() == pytest.approx(1, abs=1e-6)
        assert -np.log2(p[at == 0][0]) < lm.bits([start + b"x"], model)[0] + 1e-9


def test_contexts_do_not_reach_over_words():
    for words in ([b"abcde", b"abcde", b"xabcde"], [b"", b"a", b"", b"ab"]):
        alone = [lm.contexts([w])[2] for w in words]
        assert (np.concatenate(alone, axis=1) == lm.contexts(words)[2]).all()


def test_rise_equals_log_gamma():
    n, cost = np.array([1.0, 2, 7, 1000, 1e6]), np.array([3.0, 20, 500, 2000, 1])
    for a in lm.ADAPT:
        for k, c, r in zip(n, cost, lm.rise(n, a, cost)):
            x = a * 2.0**-c
            want = math.log(a) - c * lm.LN2 + math.lgamma(k + x) - math.lgamma(1 + x)
            assert r == pytest.approx(want, rel=1e-6)


def plain_score(text, model):
    """The log10 score of a text, each token coded in its place: the last bytes before it, then its own words so far."""
    words = [w.encode() for w in tokens(text)]
    p, seen, logs, before = [], Counter(), [0.0] * len(lm.ADAPT), b"    "
    for t, w in enumerate(words):
        p.append(-lm.bits([w], model, [before[-4:-1]])[0] * lm.LN2)
        logs = [s + math.log((seen[w] + a * math.exp(p[-1])) / (t + a)) for s, a in zip(logs, lm.ADAPT)]
        seen[w] += 1
        before += w + b" "
    logs.append(sum(p))
    return (max(logs) + math.log(sum(math.exp(x - max(logs)) for x in logs) / len(logs))) / math.log(10)


def test_contexts_reach_over_the_space_before_a_word():
    order = [f for f in range(1, 5)]
    same, other = lm.contexts([b"word"], [b"the"])[2], lm.contexts([b"word"], [b"ofa"])[2]
    assert (same[order] != other[order]).any() and (same[[0, 5]] == other[[0, 5]]).all()
    assert (same[:, lm.HEAD:] == other[:, lm.HEAD:]).all() and (same[4, :lm.HEAD] != other[4, :lm.HEAD]).all()


def test_pairs_of_a_text():
    keys, n = lm.pair_keys([b"of a cats w\xc3\xa4r", b"", b"x"])
    heads, tails = lm.pair_texts(keys)
    assert n.tolist() == [5, 1, 2]
    assert list(zip(tails, heads)) == [(b"   ", b"of"), (b" of", b"a"), (b"f a", b"cat"), (b"ats", b"w\xc3\xa4"), (b"\xc3\xa4r", b""), (b"   ", b""), (b"   ", b"x"), (b"  x", b"")]


def test_scores_are_those_of_every_token_in_its_place(spark, monkeypatch):
    texts = ["the cat sat on the mat and the cat ran", "ran cat the and mat the on sat cat the", "a b a b a b of a cat", "", None, "Ünïcode wörds  the\tcats " + "x" * 50 + " x"]
    rows = [(i, t, i == 1) for i, t in enumerate(texts)]
    docs, kept = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.setdefault("model", train(*a)))
    for hot, hot_pairs in ((lm.HOT, lm.HOT_PAIRS), (8, 8), (1, 1)):
        monkeypatch.setattr(lm, "HOT", hot), monkeypatch.setattr(lm, "HOT_PAIRS", hot_pairs)
        got = {r["doc_id"]: r["score"] for r in lm.score(docs).collect()}
        model = kept["model"] | {"counts": kept["model"]["shared"].value}
        for i, t, _ in rows:
            assert got[i] == pytest.approx(plain_score(t, model), rel=1e-6)
        assert got[0] != pytest.approx(got[1], rel=1e-4)  # the same words in another order
