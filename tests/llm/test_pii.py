import hashlib
import re
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from tariffa.llm import pii

SF = "/root/testdata/sf0.01"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    d = [int(c) for c in digits]
    return (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0


def brute_base(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (
                    kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15):
                found.append((m.start(), list(PLAIN).index(kind), m.end()))
    return sorted(found)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aB1.@-+ (0é", max_size=40) | st.from_regex(r"[a.]{0,3}@[a.]{0,4}@?[a.@]{0,6}", fullmatch=True)
       | st.from_regex(r"[+]?(4111[ -]?1111[ -]?1111[ -]?1111|1[.]2[.]3[.]25[56]|[0-9 ]{9,21}|\(12\) 34567 890)[.]?[0-9+]{0,3}", fullmatch=True))
def test_base_spans(text):
    assert sorted((s, k, e) for k, s, e in pii.detect(text)) == brute_base(text)


class Dense:
    """A tape that keeps the source stretch of every character."""

    def __init__(self, text):
        self.text, self.of = text, [(i, i + 1, False) for i in range(len(text))]

    def apply(self, edits):
        for s, e, new in reversed(edits):
            lo = self.of[s][0] if s < len(self.of) else 0
            hi = self.of[e - 1][1] if e > s else lo
            self.text = self.text[:s] + new + self.text[e:]
            self.of[s:e] = [(lo, hi, True)] * len(new)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["one ", "two-", "three", " ", "at", " (at) ", "[dot]", " dot ", "com", "john", "4111", "O", "l", "1", "​", "а", "．", "@", "+", "plus ", "double ", "five,", ".", "é"]), max_size=25))
def test_sparse_layers_map_like_dense_ones(parts):
    text = "".join(parts)
    tape, dense = pii.Tape(text), Dense(text)
    for transducer in pii.TRANSDUCERS:
        edits = transducer(tape.text)
        assert all(a[1] <= b[0] for a, b in zip(edits, edits[1:])) and all(s < e for s, e, _ in edits)
        tape.apply(edits)
        dense.apply(edits)
        assert tape.text == dense.text
    n = len(tape.text)
    for s in range(n):
        for e in range(s + 1, min(n, s + 12) + 1):
            start, end, touched = tape.source(s, e)
            assert (start, end) == (dense.of[s][0], dense.of[e - 1][1])
            if any(x[2] for x in dense.of[s:e]):
                assert touched


@pytest.mark.parametrize("kind, shown", [
    ("email", "john.doe (at) example (dot) com"), ("email", "john dot doe at example dot com"), ("email", "jоhn@exаmple.com"), ("email", "john[at]mail[.]example[.]org"),
    ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("email", "jo​hn@exam­ple.com"), ("email", "john @ example.com"), ("email", "maria arroba ejemplo punto es"),
    ("email", "john@example dot com"), ("email", "JOHN AT EXAMPLE DOT COM"), ("email", "j.doe at example.com"), ("email", "𝐣𝐨𝐡𝐧@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.𝐜𝐨𝐦"),
    ("ip", "192[.]168[.]10[.]1"), ("ip", "192 dot 168 dot 10 dot 1"), ("ip", "one nine two dot one six eight dot one dot one"), ("ip", "１９２.168.10.1"), ("ip", "l92.168.1O.1"),
    ("card", "four one one one one one one one one one one one one one one one"), ("card", "４１１１ １１１１ １１１１ １１１１"), ("card", "4111 l111 1111 11I1"),
    ("card", "4111–1111–1111–1111"), ("card", "four triple one, one double one one 1111 1111"), ("card", "4111 1111 1111 1111"), ("card", "٤١١١١١١١١١١١١١١١"),
    ("phone", "plus one five five five zero one two three four five six"), ("phone", "+1 (five five five) 010 1234"), ("phone", "＋1 555 010 1234"), ("phone", "+1 555 O1O 1234"),
    ("phone", "plus vier neun drei null eins zwei drei vier fünf sechs"), ("phone", "+33 un deux trois quatre cinq six sept huit neuf"),
])
def test_disguises_map_to_their_source(kind, shown):
    for before, after in (("", ""), ("Écris à: ", ", merci."), ("see​ this one: ", "\nNext two lines")):
        text = before + shown + after
        got = [(text[s:e], base) for s, k, e, base in pii.spans(text) if pii.KINDS[k] == kind]
        assert got == [(shown, False)], text


@pytest.mark.parametrize("text", [
    "We met at noon and looked at the dot on the map.", "It is at that. The end, one two three.", "Look at google.com or at example.org today", "version 2.0 at rest",
    "one of two or three, four score and seven", "I bought 10 or 11 o'clock 12 o 13 l", "the @ sign", "a @ b", "@user hello", "Zwei Leute, drei Tage, vier", "été à la plage à l'hôtel",
    "Привет как дела", "Ilooool Ollo 1", "0x04dbebab91ab85687d33", "he said (at) last", "meet me at ten dot", ""])
def test_clean_text_stays(text):
    assert pii.spans(text) == []


def test_base_spans_stay_beside_wider_ones():
    text = "john dot doe@example.com and 1.2.3.4 and x at y dot com"
    found = [(text[s:e], b) for s, _, e, b in pii.spans(text)]
    assert found == [("john dot doe@example.com", False), ("doe@example.com", True), ("1.2.3.4", True), ("x at y dot com", False)]
    assert pii.redacted(text, pii.spans(text)) == "<EMAIL> and <IP> and <EMAIL>"


def test_tables():
    assert all(len(c) == 1 and ord(c) > 127 for c in pii.LOOKALIKES) and sum(map(len, pii._ALIKE.values())) == len(pii.LOOKALIKES)
    assert pii.folded("é") is None and pii.folded("٣") == "3" and pii.folded("⑦") == "7" and pii.folded("‍") == ""
    assert all(unicodedata.normalize("NFC", w) == w for w in pii.DIGITS)


def test_linear_in_long_texts():
    for piece in ("a" * 200000, "1" * 200000, "1 " * 100000, "1." * 100000, "@" * 100000, "a@" * 100000, "+1" * 100000, "+1 " * 70000, " at a" * 50000, " dot" * 50000, "one " * 60000, "O1 " * 70000, "(" * 100000, "о" * 100000, "a dot " * 40000 + "at b dot com", "l|" * 90000):
        for text in (piece, piece + "x", "1" + piece):
            pii.spans(text)


def as_text(found):
    return ",".join(f"{list(PLAIN)[k]}:{s}:{e}" for s, k, e in found)


def test_query_against_plain_patterns(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pii.op11_pii(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute_base(rows[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[1] == i for x in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(as_text(base).encode()).hexdigest()
        assert r["n_added"] == 0 and r["spans"] == as_text(base)
    assert all(sum(r[f"n_{k}"] for r in got) > 0 for k in ("email", "ip", "card", "phone"))


def test_awkward_rows(spark, docs, no_docs):
    own = docs.selectExpr("*", "1 as spans", "2 as redacted").union(docs.limit(1).selectExpr(
        "doc_id", "concat(repeat('lorem ipsum 1 ', 90000), 'a (at) b (dot) com') as text", *docs.columns[2:], "1", "2"))
    out, names = pii.find(own, redact=True)
    assert out.columns == own.columns + names and len(set(out.columns)) == len(out.columns)
    got = out.collect()
    assert len(got) == own.count()
    for r in got:
        if (r["text"] or "").startswith("lorem"):
            assert [(x["kind"], x["base"]) for x in r[names[0]]] == [("email", False)] and r[names[1]].endswith(" 1 <EMAIL>"[1:])
        else:
            assert r[names[0]] == [] and r[names[1]] == (r["text"] or "")
    assert pii.find(no_docs)[0].collect() == []
