import hashlib
import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tariffa.llm import fill_in_middle as fim

SF = "/root/testdata/sf0.001"


def brute(doc_id, text):
    """By lists of tokens, without bytes."""
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abZé€😀<PSM> 1\ń", max_size=60), st.integers(-5, 10**12))
def test_cuts_follow_the_tokens(text, doc_id):
    c = fim.cut(text.encode(), doc_id)
    assert (c.n, c.form, c.prefix, c.middle, c.output.decode()) == brute(doc_id, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=50))
def test_positions(text):
    data = np.frombuffer(text.encode(), np.uint8)
    index = fim.ByteIndex(data)
    assert index.chars == len(text) and len(index.points) == sum(ord(c) > 127 for c in text)
    for k in range(len(text) + 1):
        at = len(text[:k].encode())
        assert index.to_byte(k) == at and index.to_point(at) == k


def test_steps_of_long_texts(monkeypatch):
    text = "abc déf€ 😀x" * 9
    want = [fim.cut(text.encode(), i) for i in range(40)]
    monkeypatch.setattr(fim, "STEP", 5)
    assert [fim.cut(text.encode(), i) for i in range(40)] == want


def test_query_against_brute_force(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = fim.op12_fill_in_middle(spark, SF).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        n, form, p, m, out = brute(r["doc_id"], rows[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((rows[r["doc_id"]] or "").encode()).hexdigest()


def test_round_trip_of_awkward_rows(spark, docs, no_docs):
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(["<", "a<", "<P", "x<S>y", ">M>", "<<<", "P>S>M>", "é" * 99, "a<P" + "S>" * 9, "\x00\U0001F600"] * 6)], "doc_id long, text string")
    own = docs.select("*", F.lit("f").alias("form"), F.lit("o").alias("output")).unionByName(extra, allowMissingColumns=True)
    out, names = fim.transform(own)
    assert out.columns == own.columns + names and len(set(out.columns)) == len(out.columns)
    back = out.withColumn("_back", fim.restored(F.col(names[4]), F.col(names[1]))).collect()
    assert len(back) == own.count() and all(r["_back"] == (r["text"] or "") for r in back)
    assert {r[names[1]] for r in back if not r["text"]} == {"plain"}
    for r in back:
        assert tuple(r[c] for c in names) == brute(r["doc_id"], r["text"])
    assert fim.transform(no_docs)[0].collect() == []
