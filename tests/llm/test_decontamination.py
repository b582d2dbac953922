import re

from tariffa.llm import decontamination as dc


def brute(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = [(str(i) if i is not None else "", tuple(w[s:s + 13])) for i, t in items for w in [split(t)] if w for s in range(max(1, len(w) - 12))]
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for i, g in windows:
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s:s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    found.add(i)
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_awkward_rows_equal_brute_force(spark, docs, no_docs):
    phrase = [f"t{i}" for i in range(40)]
    extra = [(100, "x " + " ".join(phrase[3:20]) + " y " + " ".join(phrase[20:32]) + " z ONE!"), (101, " ".join(phrase + phrase)), (102, "t0 " * 50), (103, "one one, One")]
    rows = spark.createDataFrame(extra, "doc_id long, text string").unionByName(docs.where("doc_id is null or doc_id not in (7, 8)").select("doc_id", "text"))
    items = [("a", " ".join(phrase)), ("a", "lazy-dog"), ("b", "ONE"), ("c", None), ("d", "..."), (None, "wörds Ünïcode"), ("e", "t0 " * 14), ("f", "absent " + " ".join(phrase[:11])), ("b", "ONE")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute([(r[0], r[1]) for r in rows.collect()], items)
    for size in (dc.SEGMENT, 60):  # the small size cuts the index into many segments
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in dc.contamination(rows, bench, size).collect()), key=str)
        assert got == want
    assert dc.contamination(no_docs, bench).collect() == []
    assert all(r["n_hit"] == 0 for r in dc.contamination(rows, bench.limit(0)).collect())


def test_long_documents_cross_no_border(spark, docs):
    long = docs.where("doc_id in (7, 8)")
    item = spark.createDataFrame([("a", "w976x1 " + "w0x2 w1x3 w2x4"), ("b", "end w0x0")], "item_id string, text string")
    got = {r["doc_id"]: r["items"] for r in dc.contamination(long, item).collect()}
    split = [r["text"] for r in long.orderBy("doc_id").collect()]
    assert got == {i: [k for k, t in (("a", "w976x1 w0x2 w1x3 w2x4"), ("b", "end w0x0")) if t in x] for i, x in zip((7, 8), split)}


def test_proximity(spark):
    text = "alpha beta gamma delta epsilon"
    rows = spark.createDataFrame([(1, "alpha beta x gamma delta epsilon"), (2, "epsilon delta gamma beta alpha"), (3, text), (4, "alpha beta x x x x x gamma delta epsilon")], "doc_id long, text string")
    index = dc.build_index(rows)
    item = spark.createDataFrame([("a", text)], "item_id string, text string")
    near = {s: sorted(r["doc_id"] for r in dc.search(index, item, s).collect() if r["items"]) for s in (0, 1, 4)}
    assert near == {0: [3], 1: [1, 3], 4: [1, 3]}  # measured from the rarest term, so a reversed phrase lies further off


def test_items_meet_only_segments_that_may_hold_them(spark):
    rows = spark.createDataFrame([(i, f"common words here and own{i}") for i in range(20)] + [(50, "common"), (51, None)], "doc_id long, text string").coalesce(2)
    index = dc.build_index(rows, 1)  # a segment a document, but for those without text
    items = [("rare", "here and own3"), ("absent", "own3 and nowhere"), ("all", "common words"), ("two", "own4 " + "x " * 12 + "own5"), ("none", "")]
    df = spark.createDataFrame([(i, i, t) for i, t in items], "iid string, item_id string, text string")
    met = {}
    for r in dc.meeting(index, df).collect():
        met.setdefault(r["iid"], set()).add(r["segment"])
    assert {k: len(v) for k, v in met.items()} == {"rare": 1, "all": 20}
    got = {r["doc_id"]: r["items"] for r in dc.search(index, df).collect() if r["items"]}
    assert got == {i: ["all", "rare"] if i == 3 else ["all"] for i in range(20)}
