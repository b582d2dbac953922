import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from tariffa.llm import periodic_runs as pr

SF = "/root/testdata/sf0.001"


def brute(words, times=4, least=6):
    """Every period by one pass over all words; a stretch counts with its smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                s, e = i, j + q
                if not any(q % p == 0 and a <= s and e <= a + m for a, m, p in found):
                    found[s, e - s, q] = True
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_kept(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]


def as_lists(found):
    return [[tuple(map(int, r)) for r in x] for x in found]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=4), st.integers(2, 9), st.integers(1, 12))
def test_runs_of_few_words(texts, times, piece):
    texts = [*texts, *[(t[:piece] * times + t)[:90] for t in texts]]
    assert as_lists(pr.runs_of(texts)) == [brute(t) for t in texts]


def fibonacci(n):
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_nested_and_long_runs():
    rng = np.random.default_rng(1)
    texts = [[b"a"] * 500, ([b"a"] * 20 + [b"b"]) * 7, (([b"x", b"y"] * 6 + [b"z"]) * 5 + [b"a"] * 8) * 4, fibonacci(400),
             [b"%d" % x for x in rng.integers(0, 2, 700)], [b"%d" % x for x in range(90)] * 6, ([b"abcbad"[k:k + 1] for k in (0, 1, 2, 0, 1, 2, 0, 1)] * 9)]
    for shift in range(5):
        own = [[b"-"] * shift + t for t in texts]
        assert as_lists(pr.runs_of(own)) == [brute(t) for t in own]
    assert as_lists(pr.runs_of([[b"a", b"b"] * 300000])) == [[(0, 600000, 2)]]


def test_separated_documents_and_groups(monkeypatch):
    texts = [b"a a a", b"a a a", b"", None, b"a a a a a a b", b"b b b b b b"]
    whole = [(k, w) for k, w in pr._grouped(texts)]
    assert len(whole) == 1 and as_lists(pr.runs_of(whole[0][1])) == [[], [], [], [], [(0, 6, 1)], [(0, 6, 1)]]
    monkeypatch.setattr(pr, "TOGETHER", 7)
    assert [(k, len(w)) for k, w in pr._grouped(texts)] == [(0, 4), (4, 1), (5, 1)]


def online(words):
    """Catchers one appended word at a time, as the module states it: the suffixes that hit, by level."""
    hits = set()
    for end in range(1, len(words) + 1):
        size = 1
        while 4 * size <= len(words):
            start = end - size
            x = (start // size - 1) * size
            if start >= 0 and x >= 0 and words[x:x + size] == words[start:end]:
                hits.add((size, x // size, start - x))
            size *= 2
    return hits


def test_all_words_at_once_make_the_comparisons_of_word_by_word():
    rng = np.random.default_rng(5)
    for n in (3, 17, 64, 131):
        words = [int(x) for x in rng.integers(0, 2, n)]
        names, size, got = pr._mix(np.array(words, np.int64).view(np.uint64), np.full(n, pr._B)), 1, set()
        while 4 * size <= n:
            if size > 1:
                names = pr._mix(names[:len(names) - size // 2], names[size // 2:])
            got |= {(size, int(b), int(q)) for b, q in zip(*pr._caught(names, size))}
            size *= 2
        assert got == online(words)


def plain_planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_planted_words_of_short_texts(spark):
    rows = [(i, t) for i in range(60) for t in (None, "", " \t ", "a", "a b", " a  b\nc d e f g\u00a0h \x0b i ")] + [(None, "a b c"), (None, None)]
    got = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", pr.planted(F.col("doc_id"), F.col("text"))).collect()
    for r in got:
        words = (r["text"] or "").encode().split()
        assert (r["own"] or "").encode().split() == (words if r["doc_id"] is None else plain_planted(r["doc_id"], words))
        assert (r["own"] is None) == (r["text"] is None)


def test_query_against_brute_force(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got, with_runs = pr.op13_periodic_runs(spark, SF).collect(), 0
    assert len(got) == len(rows)
    for r in got:
        words = re.findall("[^\x20\x09-\x0D]+", rows[r["doc_id"]] or "")
        words = plain_planted(r["doc_id"], words)
        runs = brute(words)
        with_runs += bool(runs)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(plain_kept(words, runs)).encode()).hexdigest()
    assert with_runs > 5


def test_awkward_rows(spark, docs, no_docs):
    own = docs.selectExpr("*", "1 as n_words", "2 as runs", "3 as collapsed").union(docs.selectExpr("*", "1", "2", "3").limit(1).selectExpr(
        "doc_id", "repeat('a b ', 40000) as text", *docs.columns[2:], "1", "2", "3"))
    out, names = pr.find(own)
    assert out.columns == own.columns + names and len(set(out.columns)) == len(out.columns)
    got = out.collect()
    assert len(got) == own.count()
    for r in got:
        words = (r["text"] or "").encode().split()
        assert r[names[0]] == len(words)
        if len(words) == 80000:
            assert [tuple(x) for x in r[names[1]]] == [(0, 80000, 2)] and r[names[2]] == "a b"
        elif len(words) < 100:
            assert r[names[2]] == b" ".join(plain_kept(words, brute(words))).decode()
    assert pr.find(no_docs)[0].collect() == []
