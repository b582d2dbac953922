import numpy as np
import xxhash

from tariffa.llm import components as components_module, simhash_dedup as sh
from tariffa.llm.components import components

SF = "/root/testdata/sf0.01"


def brute(rows):
    """Smallest id reachable, by all pairs of fingerprints."""
    fps = sorted({f for _, f in rows})
    u = np.array(fps, np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= sh.DISTANCE
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in np.argwhere(near):
        root[find(int(j))] = find(int(i))
    least = {}
    for d, f in rows:
        if d is not None:
            r = find(fps.index(f))
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f, least.get(find(fps.index(f)))) for d, f in rows), key=str)


def plain_fingerprint(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "")
    import re
    w = re.findall("[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    s = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    v = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return v - (1 << 64) if v >> 63 else v


def test_whole_table_equals_brute_force(spark):
    from pyspark.sql import functions as F
    got = [(r[0], int(np.uint64(int(r[1], 16)).astype(np.int64)), r[2]) for r in sh.op6_simhash_dedup(spark, SF).collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((d, f) for d, f, _ in got) == sorted((r[0], plain_fingerprint(r[1])) for r in docs)
    assert sorted(got, key=str) == brute([(d, f) for d, f, _ in got])
    native = spark.createDataFrame([("the cat sat on",)], "s string").select(F.xxhash64("s")).first()[0]
    assert native == np.uint64(xxhash.xxh64_intdigest(b"the cat sat on", 42)).astype(np.int64)


def test_awkward_rows(spark, docs, no_docs):
    out = sh.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in out), key=str) == brute([(r["doc_id"], r["fp"]) for r in out])
    assert len(out) == docs.count() and sh.near_duplicates(no_docs).collect() == []


def test_links_near_the_distance_and_long_runs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(-2**63, 2**63, 40, np.int64)
    fps = []
    for b in base.tolist():
        for _ in range(30):
            fps.append(int(np.int64(b) ^ np.bitwise_or.reduce(np.int64(1) << rng.choice(64, rng.integers(0, 6), replace=False).astype(np.int64), initial=np.int64(0))))
    fps = sorted(set(fps))
    want = {(d, c) for d, _, c in brute([(i, f) for i, f in enumerate(fps)])}
    for bucket, short in ((sh.BUCKET, sh.SHORT), (8, 2)):  # the small sizes send runs through both levels, in this process
        monkeypatch.setattr(sh, "BUCKET", bucket), monkeypatch.setattr(sh, "SHORT", short)
        import pyarrow as pa
        v = next(sh._variants([pa.RecordBatch.from_arrays([pa.array(fps)], ["fp"])]))
        order = np.argsort(np.asarray(v.column(0)), kind="stable")
        first = [v.take(pa.array(order[i:i + 777])) for i in range(0, len(order), 777)]
        one = [r for b in sh._links_1(first) for r in b.to_pylist()]
        found = [(r["a"], r["b"]) for r in one if r["kind"] == 0]
        over = [r for r in one if r["kind"] == 1]
        assert bool(over) == (bucket == 8)
        if over:
            p = next(sh._parts([pa.RecordBatch.from_pylist([{"key": r["a"], "fp": r["b"]} for r in over])]))
            order = np.lexsort((np.asarray(p.column(1)), np.asarray(p.column(0))))
            found += [(r["a"], r["b"]) for b in sh._links_2([p.take(pa.array(order[i:i + 500])) for i in range(0, len(order), 500)]) for r in b.to_pylist()]
        label = {f: i for i, f in enumerate(fps)}
        changed = True
        while changed:
            changed = False
            for a, b in found:
                m = min(label[a], label[b])
                if (label[a], label[b]) != (m, m):
                    label[a] = label[b] = m
                    changed = True
        assert {(i, label[f]) for i, f in enumerate(fps)} == want


def test_rounds_of_few_links_are_few_files(spark, monkeypatch):
    """Many shuffle partitions must not make as many files and tasks a round."""
    rounds = []
    stored = components_module.stored
    monkeypatch.setattr(components_module, "stored", lambda df, name: rounds.append((name, out := stored(df, name))) or out)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = components(spark.range(300).selectExpr("id + 1 AS a", "id - id % 10 AS b"))
        assert {(r["node"], r["root"]) for r in got.collect()} == {(i, 0) for i in range(301)}
        monkeypatch.setattr(components_module, "BROADCAST", 0)  # the join of many links gives the same
        assert {(r["node"], r["root"]) for r in components(spark.range(300).selectExpr("id + 1 AS a", "id - id % 10 AS b")).collect()} == {(i, 0) for i in range(301)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    stars = [len(df.inputFiles()) for name, df in rounds if name.endswith("-star")]
    assert stars and max(stars) <= components_module.LEAST_PARTS


def test_components_of_chain_and_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1300)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1300)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
