import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tariffa.llm import packing as pk

PATH = public_tokenizers.path(pk.VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(pieces, ids):
    """Every id in exactly one piece, windows gapless and within capacity; returns the padding."""
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_window[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        copies, lists = len(ids[i]), sorted((p["start"], p["length"], p["ids_crc32"]) for p in own)
        assert sum(n for _, n, _ in lists) == sum(map(len, ids[i])) and sorted({p["doc_tokens"] for p in own}) == sorted({len(x) for x in ids[i]})
        if copies == 1:
            at = 0
            for start, n, crc in lists:
                assert start == at and crc == zlib.crc32(np.array(ids[i][0][at:at + n], "<u4").tobytes())
                at += n
    padding = 0
    for own in by_window.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= pk.CAPACITY
        padding += pk.CAPACITY - at
    return padding


def encoded(tokenizer, rows):
    out = defaultdict(list)
    for i, t in rows:
        out[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [pk.END])
    return out


def test_whole_table(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    pieces = pk.op4_packing(spark, sf).collect()
    assert check(pieces, encoded(tokenizer, rows)) < pk.CAPACITY


def test_awkward_rows(spark, docs, no_docs, tokenizer):
    rows = docs.select("doc_id", "text").collect()
    assert check(pk.pack(docs).collect(), encoded(tokenizer, rows)) < pk.CAPACITY
    assert pk.pack(no_docs).collect() == []


@pytest.mark.parametrize("lengths", [[1500] * 999, [1025] * 10, [2047] * 7 + [1] * 3, [1], [700, 700, 700], list(range(1, 2048)) * 3, [1] * 5000 + [2000] * 40])
def test_plan_fills_all_windows_but_the_last(lengths):
    hist = Counter(lengths)
    placed, windows = pk.plan(hist)
    filled = defaultdict(list)
    for length, n in hist.items():
        for rank in range(n):
            at = 0
            while at < length:
                hits = [r for r in placed[length, at] if r[0] <= rank < r[1]]
                assert len(hits) == 1
                first, _, size, window, per, number, offset = hits[0]
                w, slot = divmod(number + rank - first, per)
                filled[window + w].append((offset + slot * size, size))
                at += size
            assert at == length
    assert sorted(filled) == list(range(windows))
    for own in filled.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= pk.CAPACITY
    assert windows == -(-sum(lengths) // pk.CAPACITY)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=9), st.integers(1, 60))
def test_fill_is_the_best_subset(lengths, room):
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    used = pk.fill(np.bincount(lengths, minlength=61), room)
    assert sum(k * n for k, n in used.items()) == max(sums)
    assert all(n <= lengths.count(k) for k, n in used.items())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), st.sampled_from("'sdtmre<|> \ń ΣςİẞæÆ½² 中\U0001f600")), max_size=40))
def test_encoder_equals_tokenizer(tokenizer, text):
    own = pk.Encoder(PATH) if not hasattr(pk, "_e") else pk._e
    pk._e = own
    assert np.frombuffer(own(text), own.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_tokens_as_the_tokenizer_reads_them(tokenizer):
    for t in ("a<|endoftext|>b", "<|startoftext|>", "x <| y |>"):
        e = pk.Encoder(PATH)
        assert np.frombuffer(e(t), e.kind).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
