"""The pipeline against a plain reading of its stages, and its awkward cases."""
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from conftest import SF_MID
from sitemill.llm import toxicity
from test_jaccard_join import brute as near_brute


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_MID}/documents.parquet"), []
    for name, stage in C.STAGES:
        after = stage(spark, docs, SF_MID).persist()
        out.append((name, docs, after))
        docs = after
    return out


def test_names_and_columns(stages):
    assert [n for n, *_ in stages] == ["quality classifier", "toxicity", "exact dedup", "n-gram Jaccard join", "best-fit packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_each_stage_decides(stages, spark):
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    good = stages[0][2].join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    assert good > 0.97
    assert stages[0][2].join(labels.where("quality = 1"), "doc_id").count() == labels.where("quality = 1").count()
    # the stage keeps what the operator, fitted on the same documents, predicts as clean
    _, before, after = stages[1]
    clean = toxicity.toxicity(before, labels).where("predicted = 0")
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(r.doc_id for r in clean.select("doc_id").collect())
    share = lambda df: df.join(labels, "doc_id").agg(F.avg("toxic")).first()[0]
    assert share(after) < share(before) / 3


def test_exact_stage(stages):
    _, before, after = stages[2]
    first = {}
    for r in before.collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[key] = min(r.doc_id, first.get(key, r.doc_id))
    assert sorted(r.doc_id for r in after.collect()) == sorted(first.values())


def test_near_stage(stages):
    _, before, after = stages[3]
    rows = [(r.doc_id, r.text) for r in before.where(F.length("text") < 2500).collect()]
    kept = {r.doc_id for r in after.collect()}
    component = {d: c for d, _, c in near_brute(rows, C.WORDS, C.PERCENT)}
    for d, c in component.items():
        if c == d:
            assert d in kept
        else:
            assert d not in kept


def test_packing_stage(stages):
    _, before, after = stages[4]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == start.columns
        assert C.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 0


def test_rows_of_one_id_are_decided_by_their_texts(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    near = lambda c: text(c) + " more"
    rows = [(7, text("a")), (None, near("a")), (None, text("b")), (None, text("c")), (None, ""), (5, text("d")), (9, near("d")), (9, text("e")), (9, near("e")), (8, ""), (8, None)]
    got = C.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    of = {r.text: r.doc_id for r in got if r.text}
    assert of.pop(text("e"), None) == 9 or of.pop(near("e")) == 9  # one of the two
    assert of == {text("a"): 7, text("b"): None, text("c"): None, text("d"): 5} and len(got) == 8
    rows = [(1, "x"), (None, "x"), (None, "y"), (3, "y"), (4, "z"), (4, "x"), (4, "z"), (None, "w"), (None, "w")]
    got = C.exact_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.text, r.doc_id or 0) for r in got) == [("w", 0), ("x", 1), ("y", 3), ("z", 4)]


def test_run_is_the_stages(spark, stages):
    got = C.run(spark, SF_MID)
    assert got.groupBy().agg(F.sum("length")).first()[0] == stages[-1][2].agg(F.sum("length")).first()[0]
