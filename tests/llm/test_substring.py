import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from tariffa.llm import fm_index as fm, substring_dedup as sd


def brute(rows, window=sd.WINDOW):
    texts = [re.findall("[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[k:k + window]) for w in texts for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = {p for k in range(len(w) - window + 1) if seen[tuple(w[k:k + window])] > 1 for p in range(k, k + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def planted(rng):
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 4) + str(rng.randint(0, 60))
    passage = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 200, 20)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 80))]
        for p in rng.sample(passage, rng.randint(0, 3)):
            k = rng.randint(0, len(w))
            p = list(p)
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit" + str(i)
            w[k:k] = p
        rows.append((i, " ".join(w)))
    return rows + [(100, "same " * 40), (101, "same " * 35), (102, "same " * 34), (103, "x y " * 50), (104, rows[3][1]), (104, rows[3][1]), (105, None), (106, " \n ")]


def test_planted_passages_equal_brute_force(spark, monkeypatch):
    rows = planted(random.Random(3))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert rows_of(sd.dedup(df)) == want
    monkeypatch.setattr(sd, "HOT", 2)  # most stretches now go by window digests
    assert rows_of(sd.dedup(df)) == want


def test_awkward_rows(spark, docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(sd.dedup(docs)) == brute(rows)
    assert sd.dedup(no_docs).collect() == []


def test_parts_of_long_texts_overlap(spark, monkeypatch):
    rng = random.Random(9)
    words = [str(rng.randrange(10**6)) for _ in range(700)]
    words[400:450] = words[100:150]
    want = [u for u in zip(*[x.tolist() for x in sd.units(sd.Words()([w.encode() for w in words]))])]
    import pyarrow as pa
    monkeypatch.setattr(sd, "PART", 64)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([" ".join(words).encode()])], ["i", "h", "text"])
    starts = lambda rows: sorted((s, f + k) for s, _, f, n in rows for k in range(n - sd.WINDOW + 1))
    got = [(r["stretch"], r["content"], r["first"], r["size"]) for b in sd._units([batch]) for r in b.to_pylist()]
    assert starts(got) == starts(want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=30), min_size=1, max_size=6), st.lists(st.integers(1, 3), min_size=6, max_size=6), st.lists(st.lists(st.integers(1, 5), max_size=20), min_size=1, max_size=3))
def test_matching_statistics(texts, weights, patterns):
    index = fm.FMIndex([np.array(t, np.uint64) for t in texts], np.array(weights[:len(texts)]))
    for least in (1, 2):
        got = index.matching_statistics([np.array(p, np.uint64) for p in patterns], least)
        for p, m in zip(patterns, got):
            for i in range(len(p)):
                n = 0
                while i + n < len(p):
                    g = p[i:i + n + 1]
                    hits = sum(w * sum(t[k:k + len(g)] == g for k in range(len(t) - len(g) + 1)) for t, w in zip(texts, weights))
                    if hits < least:
                        break
                    n += 1
                assert m[i] == n
