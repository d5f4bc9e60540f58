"""Fitted operators: held-out figures on the test tables, and the awkward cases."""
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from sitemill.llm import importance as I
from sitemill.llm import toxicity as T
from sitemill.llm.toxicity import LexiconAutomaton


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_quality_keeps_clean_documents(tables):
    docs, labels = tables
    got = I.resample(docs, labels, fit_rows=1500).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in got.collect()}
    assert kept[1] >= 0.999 and kept[0] <= 0.02


def test_quality_filter_is_the_report(tables):
    docs, labels = tables
    draw = I.Draw(docs, labels, fit_rows=1500)
    ids = {r.doc_id for r in draw.table.where(draw.kept(F.col("rank"))).collect()}
    assert {r.doc_id for r in draw.filter(docs).select("doc_id").collect()} == ids


def test_quality_odd_rows(spark, odd_docs, no_docs, no_labels):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, 0, None), (5, None, 1), (None, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert I.resample(odd_docs, labels).count() == odd_docs.count()
    assert I.Draw(odd_docs, labels).filter(odd_docs).columns == odd_docs.columns
    assert I.resample(odd_docs, no_labels).where("kept").count() == odd_docs.count()
    assert I.resample(no_docs, no_labels).count() == 0


@pytest.mark.parametrize("k", [1, 2, 57, 999, 1000])
def test_kth_largest(spark, k):
    values = [(x * 7919 - 4_000_000_000) * (1 if x % 3 else 1 << 28) for x in range(1000)]
    assert I.kth_largest(spark.createDataFrame([(v,) for v in values], "v long"), "v", k) == sorted(values, reverse=True)[k - 1]


def test_forms_tell_junk():
    a, n = I.form_hashes(["Word word word THE!! the### x | x", "", "the"])
    assert n.tolist() == [8, 0, 1]
    assert len(set(a[[0, 1, 3, 4, 6]].tolist())) == 5 and a[5] == a[7] and a[1] == a[8] != a[2]


def test_words_tell_salad_from_prose(spark):
    """Plain lower-case words on both sides: only the words and their order differ, and half the documents have no label."""
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    vocabulary, foreign = ([word(rnd.randrange(3, 8)) for _ in range(300)] for _ in range(2))
    follows = {w: rnd.sample(vocabulary, 4) for w in vocabulary}

    def prose():
        ws = [rnd.choice(vocabulary)]
        while len(ws) < 120:
            ws.append(rnd.choice(follows[ws[-1]]))
        return ws

    makers = [prose, prose, lambda: rnd.sample(vocabulary, 120), lambda: [rnd.choice(foreign) for _ in range(120)]]
    rows = [(i, " ".join(makers[i % 4]()), int(i % 4 < 2)) for i in range(800)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 8 < 4], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in I.resample(docs, labels).collect()}
    for part in (range(4), range(4, 8)):
        share = {y: [kept[i] for i, _, q in rows if q == y and i % 8 in part] for y in (0, 1)}
        assert sum(share[1]) / len(share[1]) >= 0.95 and sum(share[0]) / len(share[0]) <= 0.05


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    rows = T.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits / sum(r.toxic for r in rows) >= 0.9 and hits / sum(r.predicted for r in rows) >= 0.95


def test_held_out_labels_change_nothing(tables):
    docs, labels = tables
    docs = docs.where("doc_id < 3000")
    other = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (T.fit(docs, l)[1] for l in (labels, other))
    assert abs(a - b).max() < 1e-9


def test_scores_depend_on_texts_alone(spark, tables):
    docs, labels = tables
    scorer, beta = T.fit(docs, labels)
    score = T.scoring(scorer, beta)
    rows = docs.limit(200).select(score("text").alias("a"), score(F.concat("text", F.lit(""))).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_toxicity_odd_rows(spark, odd_docs, no_docs, no_labels):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (5, None, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for l in (labels, no_labels):
        rows = T.toxicity(odd_docs, l).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert T.without_toxic(odd_docs, no_labels).columns == odd_docs.columns
    assert T.toxicity(no_docs, no_labels).count() == 0


@pytest.mark.parametrize("times", [1, 4])
def test_ordinary_near_forms_leave_other_misspellings(spark, times):
    """Clean documents with 'thrash' say nothing about 'traash', however many rows there are."""
    rnd = random.Random(3)
    words = ["field", "river", "stone", "cloud", "green", "paper", "quiet", "window", "garden", "yellow"]
    text = lambda *extra: " ".join(w for x in extra for w in (*rnd.sample(words, 4), x)) + " " + rnd.choice(words)
    rows = [(text("trash", "trash"), 1) for _ in range(60 * times)] + [(text("thrash"), 0) for _ in range(3 * times)] + [(text("moon"), 0) for _ in range(400 * times)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    scorer, beta = T.fit(docs, labels)
    none, ordinary, misspelled = (scorer.features(f, 5) for f in scorer.hits(["the green moon by night", "they thrash the green field", "you are traash to me"]))
    assert ordinary == none and misspelled[1] > none[1] and misspelled[2] > none[2]
    assert sum(b * (m - n) for b, m, n in zip(beta, misspelled, none)) > 0


def _distances(a, b):
    """Edits from each beginning of ``a`` to each of ``b``; two neighbours in each other's place are one."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d


def _edits(word, entry):
    """Of the whole word, or of a beginning whose last letters are the entry's last ones."""
    d, n = _distances(word, entry), len(entry)
    ends = [d[len(word), n]]
    for i in range(1, len(word) + 1):
        if word[i - 1] == entry[-1]:
            ends.append(d[i - 1, n - 1])
        if i > 1 and word[i - 2] == entry[-1] and word[i - 1] == entry[-2]:
            ends.append(d[i - 2, n - 2] + 1)
    return min(ends)


def test_automaton_is_edit_distance():
    entries = ["idiot", "moron", "worthless", "disgusting", "scum", "pathetic", "trash"]
    automaton = LexiconAutomaton(entries)
    letters = "idotmrnwhlesuc"
    words = {e[:k] + x + e[k + d:] for e in entries for k in range(len(e) + 1) for d in (0, 1, 2) for x in ("", "x", "o", "ss")} | {a + b for a in letters for b in letters}
    words |= {e[:k] + e[k:k + 2][::-1] + e[k + 2:] + x for e in entries for k in range(len(e) - 1) for x in ("", "s", "ing")}
    words |= {w + "ly" for w in words}
    for w in words:
        want = {k: d for k, e in enumerate(entries) if (d := _edits(w, e)) <= automaton.allowed(e)}
        assert automaton.hits(w) == want, w


def test_usual_misspellings_hit():
    automaton = LexiconAutomaton(["disgust", "idiot", "stupid", "trash"])
    for word, entry in {"idoit": 1, "stuipd": 2, "trahs": 3, "digusting": 0, "idiiots": 1, "disgsutingly": 0}.items():
        assert automaton.hits(word) == {entry: 1}, word
    assert automaton.form("digusting", 0, 1) == "digust" and automaton.form("trahs", 3, 1) == "trah" and automaton.form("idoit", 1, 1) == "idoit"
    assert not any(automaton.hits(w) for w in ("transit", "idea", "studio", "dish", "fresh"))


def test_ordinary_forms_cover_their_inflections():
    scorer = T.Scorer({"trash": 4.0})
    scorer.misread = {"crash"}
    none, ordinary, misspelled = (scorer.features(f, 4) for f in scorer.hits(["the green moon rose", "it crashed at noon", "you trahs of moon"]))
    assert ordinary == none and misspelled != none


def test_quotation_and_misspelling_are_told():
    scorer = T.Scorer({"idiot": 4.0, "worthless": 4.0})
    found = scorer.hits(['they wrote "idiot" in it', "you idiott are worthles", "calm words"])
    assert [h[2] for h in found[0]] == [True] and [h[1] for h in found[1]] == [0, 1] and found[2] == []
