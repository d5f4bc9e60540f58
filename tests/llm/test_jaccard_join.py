"""Jaccard components against all pairs."""
import random
import re

import pytest
from pyspark.sql import functions as F

from sitemill.llm import jaccard_join as J
from sitemill.llm import shingles as S
from sitemill.llm.graph import components


def word_sets(rows, k):
    low = {i: i + 32 for i in range(65, 91)}
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append(frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def brute(rows, k, percent):
    sets, root = word_sets(rows, k), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for a, (d, _) in enumerate(rows):
        if sets[a] and d is not None:
            low[find(a)] = min(d, low.get(find(a), d))
    return sorted(((d, len(sets[a]), low.get(find(a)) if sets[a] else d) for a, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=220):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rnd.choices(words, k=25)
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.5 and texts:
            w = rnd.choice(texts).split(" ")
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                at = rnd.randrange(len(w))
                w[at:at + rnd.choice([0, 1])] = [rnd.choice(words)] * rnd.choice([0, 1])
            texts.append(" ".join(w) or "w0")
        else:
            w = rnd.choices(words, k=rnd.choice([1, 2, 3, 8, 30, 60, 90]))
            texts.append(" ".join(w + (passage if kind > 0.8 else [])))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 90), (2, 5, 80), (3, 3, 60)])
def test_components_match_all_pairs(spark, seed, k, percent):
    rows = corpus(seed)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k, percent)


def test_large_group_of_near_copies(spark):
    """A chain-like group: many members link only through others."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for d in range(260):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3])):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(40)}"
        rows.append((d, " ".join(w)))
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 90)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = J.jaccard_components(odd_docs, 3, 90).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 90)
    assert J.jaccard_components(no_docs).count() == 0


def test_null_ids_link(spark):
    words = [f"w{i}" for i in range(80)]
    rows = [(None, " ".join(words)), (4, " ".join(words[1:])), (None, "alone " * 3), (9, " ".join(words[:-1]))]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 90)


def test_word_hashes_split_at_ascii_white_space_only():
    h, n = S.word_hashes(["a b c", "", "A\x0bB", "\x1cx"])
    assert n.tolist() == [2, 0, 2, 1]
    assert S.word_hashes(["Abc"])[0][0] == S.word_hashes(["aBC"])[0][0]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 90)] + [(200, 200 + i) for i in range(1, 60)] + [(400, 399), (399, 400), (7, 7)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(91)) and all(got[200 + i] == 200 for i in range(60)) and got[400] == got[399] == 399
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns_of_any_name_go_through_the_stage(spark):
    names = ["_sid", "_id", "_stays", "_again", "sid", "id", "row", "stay_id", "n_shingles", "component_id", "root"]
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (1, "b c d e f g"), (2, words), (None, words), (None, "x y z"), (1, "b c d e f g"), (3, None)]
    df = spark.createDataFrame([(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(rows)], ["doc_id", "text", *names])
    left = J.without_near_copies(df)
    assert left.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)[:1]) for r in left.collect()) == [("1", "b"), ("1", "w"), ("3", "N"), ("None", "x")]
    assert all({r[n][:-1] for n in names} == set(names) for r in left.collect())
