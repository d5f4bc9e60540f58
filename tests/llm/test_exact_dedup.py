"""Exact duplicates against a dictionary, with and without hash collisions."""
import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from sitemill.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, norm))
    return sorted(out, key=str)


def result(df):
    return [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()]


def _expected(rows):
    return sorted(((i, k, n, kept, hashlib.sha256(t.encode()).hexdigest()) for i, k, n, kept, t in brute(rows)), key=str)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(result(X.exact_duplicates(odd_docs)), key=str) == _expected(rows)
    assert X.exact_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("key,digest", [(lambda t: F.length(t).cast("long"), lambda t: F.lit("same")),
                                        (lambda t: F.lit(7).cast("long"), lambda t: F.substring(F.sha2(t, 256), 1, 1))])
def test_colliding_hashes_are_told_apart_by_bytes(spark, key, digest):
    rows = [(k, f"text {k % 13}{'  ' if k % 2 else ' '}end") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(result(X.exact_duplicates(df, 4, key, digest)), key=str) == _expected(rows)


def test_directory_splits_overfull_buckets(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    index = X.build_index(X.slots(rows).drop("norm"), capacity=100)
    assert index.count() == 5000
    assert index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 100
    # buckets are ranges of keys: leading bits of a key, its local depth of them, name its bucket
    depths = index.select("bucket", "local_depth").distinct().groupBy("bucket").count()
    assert depths.agg(F.max("count")).first()[0] == 1


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    # keys of few different leading bits: one region is split far deeper than the rest
    keys = spark.range(3000).select(F.expr("if(id < 2900, id, shiftleft(id, 50))").alias("key"))
    cells, depth = X.directory(keys, 16)
    assert depth > 2 * X.BITS
    placed = X.to_bucket(keys, cells, depth)
    assert placed.count() == 3000
    sizes = placed.groupBy("bucket", "local_depth").count().collect()
    assert max(r["count"] for r in sizes) <= 16
    assert len({r["bucket"] for r in sizes}) == len(sizes) and min(r["local_depth"] for r in sizes) < depth


def test_one_key_cannot_be_split(spark):
    keys = spark.range(50).select(F.lit(7).cast("long").alias("key"))
    cells, depth = X.directory(keys, 4)
    assert depth == 64 and cells.count() == 1


def test_answers_are_those_of_directory_and_chain(spark):
    df = spark.createDataFrame([(k, f"text {k % 5}") for k in range(20)], "doc_id long, text string")
    narrow = X.slots(df).drop("norm").withColumn("member", F.lit(0))
    entries = narrow.groupBy(*X.ENTRY).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    cells, depth = X.directory(entries, 2)
    index = X.write_index(entries, cells, depth)
    good = X.look_up(narrow, index, cells, depth)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in good.collect()} == {(k, k % 5, 4) for k in range(20)}
    wrong = index.withColumn("keep_id", F.col("keep_id") + 100)
    assert {r.keep_id for r in X.look_up(narrow, wrong, cells, depth).collect()} == set(range(100, 105))
    astray = cells.withColumn("bucket", F.col("bucket") + 1)
    assert X.look_up(narrow, index, astray, depth).count() == 0


@pytest.mark.parametrize("name,value", [("LARGE", 2), ("BROADCAST_KEYS", 0)])
def test_large_groups_and_tables_beyond_the_bounds(spark, monkeypatch, name, value):
    monkeypatch.setattr(X, name, value)
    rows = [(k, f"text {min(k % 40, 9)}") for k in range(300)] + [(None, "text 1"), (5, "text 5"), (5, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(result(X.exact_duplicates(df)), key=str) == _expected(rows)


def test_columns_of_any_name_go_through_the_stage(spark):
    names = ["_text", "_id", "_sha", "_gone", "_again", "key", "digest", "norm", "kept", "id", "sha", "row", "bucket", "id_", "text_sha256"]
    rows = [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "c"), (1, "b")]
    df = spark.createDataFrame([(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(rows)], ["doc_id", "text", *names])
    left = X.without_copies(df)
    assert left.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("1", "a"), ("1", "b"), ("None", "c")]
    assert all({r[n][:-1] for n in names} == set(names) for r in left.collect())


def test_stage_keeps_one_of_equal_rows(spark, odd_docs):
    left = X.without_copies(odd_docs)
    assert left.columns == odd_docs.columns
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = sorted((str(i), n) for i, _, _, kept, n in brute(rows) if kept)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted((str(r.doc_id), norm(r.text)) for r in left.collect()) == want


def test_matches_sql(spark):
    from compare import compare, duck
    from sitemill.llm.queries import LLM_ORACLES, LLM_QUERIES

    con = duck(SF_MID)
    for name, sql in LLM_ORACLES.items():
        info = compare(spark, SF_MID, name, LLM_QUERIES[name], sql, con)
        assert info["ok"], info
