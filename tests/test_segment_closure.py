"""Segmentation and crawl closure against brute force on small fixtures."""
import math

from pyspark.sql import functions as F

from sitemill.operators import frontier as FR
from sitemill.operators import segment as SG
from sitemill.sources import archive as A
from conftest import SF_SMALL


def _dp(s, cost, unknown):
    best = [(0.0, 0)]
    for i in range(1, len(s) + 1):
        cands = []
        for k in range(1, i + 1):
            w = s[i - k:i]
            if w in cost:
                cands.append((best[i - k][0] + cost[w], k))
            elif k == 1:
                cands.append((best[i - 1][0] + unknown, 1))
        best.append(min(cands))
    out, i = [], len(s)
    while i > 0:
        k = best[i][1]
        out.insert(0, s[i - k:i])
        i -= k
    return out


def test_word_costs_zipf(spark):
    docs = A.read_table(spark, SF_SMALL, "documents")
    wc = SG.word_costs(docs).collect()
    n = len(wc)
    ranks = sorted(r["word_rank"] for r in wc)
    assert ranks == list(range(1, n + 1))
    by_rank = sorted(wc, key=lambda r: r["word_rank"])
    assert all(a["n"] >= b["n"] for a, b in zip(by_rank, by_rank[1:]))
    r0 = by_rank[0]
    assert abs(r0["cost"] - math.log(1 * math.log(n))) < 1e-9


def test_segmentation_matches_brute_force(spark):
    docs = A.read_table(spark, SF_SMALL, "documents")
    costs_df = SG.word_costs(docs)
    cost = {r["word"]: r["cost"] for r in costs_df.collect()}
    words = sorted(cost, key=lambda w: cost[w])[:40]
    parts = ["".join(words[i:i + 3]) for i in range(0, 30, 3)] + ["qzxqzx", "a", "implantfaq"]
    got = {r["part"]: r["words"] for r in SG.segment(spark.createDataFrame([(p,) for p in parts], "part string"), costs_df).collect()}
    for p in parts:
        assert got[p] == _dp(p, cost, SG.UNKNOWN_COST), p


def test_closure_matches_bfs(spark):
    edges = [(1, 2), (1, 3), (2, 4), (4, 1), (3, 5), (6, 7), (5, 8), (8, 9)]
    start = spark.createDataFrame([(1,), (6,)], "page_id long")
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {r["page_id"]: r["round"] for r in FR.closure(start, e).collect()}
    want, frontier, r = {1: 0, 6: 0}, {1, 6}, 0
    while frontier:
        r += 1
        nxt = {d for s, d in edges if s in frontier} - set(want)
        want.update({p: r for p in nxt})
        frontier = nxt
    assert got == want


def test_long_chain_writes_each_hop_a_few_times(spark, monkeypatch):
    """70 hops of one page each: what is rewritten stays a small multiple of the pages."""
    rows = []
    write = FR.Visited._write
    monkeypatch.setattr(FR.Visited, "_write", lambda self, df: (out := write(self, df), rows.append(out[1]["n"]))[0])
    e = spark.createDataFrame([(k, k + 1) for k in range(70)] + [(5, 2), (70, 0)], "src long, dst long")
    got = {r["page_id"]: r["round"] for r in FR.closure(spark.createDataFrame([(0,)], "page_id long"), e).collect()}
    assert got == {k: k for k in range(71)}
    assert sum(rows) <= 3 * 71


def test_closure_without_pages_or_links(spark):
    none = spark.createDataFrame([], "page_id long")
    assert FR.closure(none, spark.createDataFrame([(1, 2)], "src long, dst long")).count() == 0
    lone = spark.createDataFrame([(4,), (4,), (None,)], "page_id long")
    assert [tuple(r) for r in FR.closure(lone, spark.createDataFrame([], "src long, dst long")).collect()] == [(4, 0)]


def test_starts_grow_only_while_their_prefix_occurs(spark):
    costs = spark.createDataFrame([("implant", 1.0), ("implants", 1.0), ("im", 1.0), ("a", 1.0), ("internationalisation", 1.0)], "word string, cost double")
    got = {(r["i"], r["j"]) for r in SG.candidates(spark.createDataFrame([("implantsxq",), ("internationalq",)], "part string"), costs).where("part = 'implantsxq'").collect()}
    # only the first start has a prefix of the table, and no word with it is longer than eight letters
    assert got == {(1, j) for j in range(1, 9)} | {(i, j) for i in range(2, 11) for j in (i, i + 1) if j <= 10}


def test_url_key(spark):
    df = spark.createDataFrame([("http://h/a/#x",), ("http://h/a",)], "u string")
    assert [r[0] for r in df.select(FR.url_key("u")).collect()] == ["http://h/a", "http://h/a"]
