"""Lexical search against scoring every document, and the filter audit against applying every order."""
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitemill.llm import filter_audit as A
from sitemill.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items):
    """Rows (item_id, rank, doc_id, score) from the scores of all documents."""
    counted = [(d, Counter(words_of(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, n_words = len(counted), sum(n for _, _, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, text in sorted(set(items), key=str):
        asked = Counter(words_of(text))
        scored = []
        for d, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // n_words
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, k in asked.items() if c[w])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scored)[:20])]
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def some_texts(seed, n):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Élan", "漢字", "under_score", "IT's"]
    return [" ".join(draw.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=draw.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("slice_bytes", [4_000_000, 150])
def test_search_is_the_ranking_of_all_documents(spark, slice_bytes):
    docs = [(k, t) for k, t in enumerate(some_texts(1, 400) + some_texts(2, 30) * 3)]
    items = [(k, t) for k, t in enumerate(some_texts(3, 12))] + [(90, None), (91, "absent words"), (92, "w0 w0 W0 w5")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(L.search(df, spark.createDataFrame(items, "item_id long, text string"), slice_bytes)) == brute_search(docs, items)


def test_search_of_odd_documents(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "alpha words b"), (1, "alpha words b"), (None, "null héllo"), (3, ""), (4, None)]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, q int")
    assert found(L.search(odd_docs, asked)) == brute_search(docs, items)
    assert L.search(no_docs, asked).count() == 0
    assert found(L.search(odd_docs, asked.limit(0))) == []


def test_best_positions_stop_early_and_lose_nothing():
    draw = np.random.default_rng(7)
    n_docs, n_terms = 5000, 4
    t, doc = (x.ravel() for x in np.meshgrid(np.arange(n_terms), np.arange(n_docs), indexing="ij"))
    some = draw.random(len(t)) < 0.7
    t, doc = t[some], doc[some]
    impact = (1000 * draw.random(len(t)) ** 8).astype(np.int64) + 1
    block = L.Block(t, doc, impact, n_terms, n_docs)
    weights = {0: 5, 1: 3, 3: 9}
    total = np.zeros(n_docs, np.int64)
    for k, w in weights.items():
        np.add.at(total, doc[t == k], w * impact[t == k])
    least = np.sort(total)[-20]
    docs, scores, depth = L.best_positions(block, weights, 0)
    assert depth < 2000  # of lists of about 3500
    assert {(d, s) for d, s in zip(docs.tolist(), scores.tolist()) if s >= least} == {(d, s) for d, s in enumerate(total.tolist()) if s >= least}
    # a bound from elsewhere stops sooner, and nothing that reaches it is lost
    high = int(np.sort(total)[-5])
    docs, scores, sooner = L.best_positions(block, weights, high)
    assert sooner <= depth and sorted(scores.tolist()) == sorted(total[total >= high].tolist())


def brute_audit(docs, labels):
    """Every order applied to the rows themselves."""
    quality, toxic = defaultdict(int), defaultdict(int)
    for d, q, t in labels:
        quality[d], toxic[d] = max(quality[d], q or 0), max(toxic[d], t or 0)
    smallest = {}
    for d, text, _ in docs:
        if d is not None:
            smallest[text or ""] = min(smallest.get(text or "", d), d)
    rows = defaultdict(list)
    for d, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and smallest[text] < d}
        rows[lang or ""].append((d, {f for f, x in fails.items() if x}))
    out = []
    for part, all_rows in rows.items():
        removed_by = Counter()
        part_rows = []
        for order in map("".join, permutations("ABCDE")):
            left = all_rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_by[f] += len(gone)
                failing = [r for r in all_rows if f in r[1]]
                part_rows.append((part, order, step, len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in all_rows),
                                  sum(d is not None and quality[d] == 1 for d, _ in gone), sum(d is not None and toxic[d] == 1 for d, _ in gone)))
        out += [(*r, removed_by[r[1][r[2] - 1]]) for r in part_rows]
    return sorted(out)


COUNTS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(df):
    assert df.columns == COUNTS
    return sorted(tuple(r[c] for c in COUNTS) for r in df.collect())


def audit_rows():
    draw = random.Random(4)
    words = [f"w{k}" for k in range(150)] + ["CAPS", "X", "a#b", "é|"]
    docs = [(k, " ".join(draw.sample(words, draw.randint(1, 150)) if k % 3 else draw.choices(words, k=draw.randint(1, 120))), draw.choice(["en", "de", "", None])) for k in range(90)]
    docs += [(200 + k, docs[draw.randint(0, 20)][1], "en") for k in range(60)] + [(5, docs[5][1], "en"), (5, docs[6][1], "fr"), (None, docs[0][1], "en"), (None, None, None)]
    docs += [(300, "", "de"), (301, None, "de"), (302, " \t\n", "de"), (299, LONG_TEXT, "de"), (298, LONG_TEXT, None), (-4, "w1 w2", "de")]
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 1])) for k in draw.sample(range(260), 150)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    return docs, labels


LONG_TEXT = "Alpha BETA  gamma\t" * 20000


@pytest.mark.parametrize("key", [F.xxhash64, lambda t: F.pmod(F.length(t), F.lit(3)).cast("long")])
def test_audit_is_the_application_of_every_order(spark, monkeypatch, key):
    """With equal hashes for different texts too, and with groups of one hash in several blocks."""
    monkeypatch.setattr(A, "BLOCK", 7)
    docs, labels = audit_rows()
    df = spark.createDataFrame([(*d, 1, "x", None) for d in docs], "doc_id long, text string, lang string, key int, bits string, n long").repartition(4)
    labelled = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    assert audited(A.audit(df, labelled, key)) == brute_audit(docs, labels)


def test_audit_of_empty_tables(spark, no_docs, no_labels):
    assert A.audit(no_docs, no_labels).count() == 0
    one = no_docs.unionByName(spark.createDataFrame([(1, "a", "en", "s", 1)], no_docs.schema))
    rows = A.audit(one, no_labels).collect()
    assert len(rows) == 600 and {r.good_lost for r in rows} == {0}
