from collections import defaultdict

import corpus_pipeline as cp
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tariffa.llm import packing as pk, quality, toxicity
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_near_copies import brute as near
from tests.llm.test_packing import check, encoded

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in cp.STAGES:
        after = cp.stored(stage(spark, docs, SF), "step")
        out.append((docs.collect(), after.collect()))
        assert after.columns == docs.columns or stage is cp.packing_stage
        docs = after
    return out


def test_quality_stage_follows_the_query(spark, steps):
    before, after = steps[0]
    bad = {r["doc_id"] for r in quality.op8_quality_classifier(spark, SF).collect() if not r["predicted"]}
    assert sorted(after) == sorted(r for r in before if r["doc_id"] not in bad) and bad


def test_exact_stage(steps):
    before, after = steps[1]
    last = {}
    for r in sorted(before):
        last[r["text"]] = r
    assert sorted(after) == sorted(last.values()) and len(after) < len(before)


def test_near_stage(steps):
    before, after = steps[2]
    keep = near([(r["doc_id"], r["text"]) for r in before])[1]
    assert sorted(after) == sorted(r for r in before if r["doc_id"] in keep) and len(after) < len(before)


def test_benchmark_stage(spark, steps):
    before, after = steps[3]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in contaminated([(r["doc_id"], r["text"]) for r in before], items) if r[4]}
    assert sorted(after) == sorted(r for r in before if r["doc_id"] not in bad) and bad


def test_packing_stage(steps):
    before, after = steps[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(pk.VOCABULARY))
    assert check(after, encoded(tokenizer, [(r["doc_id"], r["text"]) for r in before])) < pk.CAPACITY


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES])
def test_stages_take_awkward_rows(spark, docs, no_docs, stage):
    own = docs.selectExpr("*", "doc_id as _digest", "doc_id as _fp", "text as _text", "1 as _score", "2 as _key", "3 as _keep")
    out = stage(spark, own, SF)
    got = out.collect()
    if stage is cp.packing_stage:
        assert sum(r["length"] for r in got) > 100
    else:
        assert out.columns == own.columns
        texts = defaultdict(int)
        for r in docs.collect():
            texts[r["text"]] += 1
        assert all(r["text"] in texts for r in got)
        if stage is cp.exact_stage:
            assert sorted(r["text"] or "" for r in got) == sorted({t or "" for t in texts})
        if stage is cp.near_stage:
            assert len([r for r in got if r["text"] == "one"]) == 1 and len([r for r in got if not (r["text"] or "").strip()]) == 1
        if stage is cp.benchmark_stage:
            assert len(got) == docs.count()
    assert stage(spark, no_docs, SF).collect() == []


def test_classifiers_learn_and_stand_without_labels(spark, docs):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for fn, name, least in ((quality.op8_quality_classifier, "quality", 0.95), (toxicity.op2_toxicity, "toxic", 0.85)):
        got = fn(spark, sf).collect()
        assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
        held = [(r["predicted"], labels[r["doc_id"]][name]) for r in got if r["held_out"] and r["doc_id"] in labels]
        assert sum(p == y for p, y in held) >= least * len(held) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = quality.score(docs.select("doc_id", "text"), quality.train(docs, none, quality._is_training())).collect()
    assert {r["_score"] for r in scores} == {0.5} and len(scores) == docs.count()
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, none, quality._is_training())).collect()} == {0.5}


def test_offending_sentences(spark):
    rows = [(i, f"Fine words here {i}. " + ("you are a fool and a knave! " if i % 3 == 0 else "nothing of the kind. ") + f"More text {i}.", int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df, toxicity.bucket(df["doc_id"], 5) != 0)
    found = toxicity.locate(df, model).collect()
    assert {r["doc_id"] for r in found} == {i for i, _, y in rows if y}
    assert all(dict((i, t) for i, t, _ in rows)[r["doc_id"]][r["start"]:r["end"]] == r["sentence"] and "knave" in r["sentence"] for r in found)
