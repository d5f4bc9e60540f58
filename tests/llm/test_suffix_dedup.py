"""Removal of repeated byte strings against a dictionary of all windows."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from conftest import SF_SMALL
from sitemill.llm import suffix_dedup as S


def brute(rows, window):
    """One result row per document, from counts of all windows of all texts."""
    data = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(x[i:i + window] for _, x in data for i in range(len(x) - window + 1))
    out = []
    for d, x in data:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - window + 1):
            if counts[x[i:i + window]] > 1:
                gone[i:i + window] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((d, len(x), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def pieces(seed, n):
    """Texts made of shared passages, own words, runs of one byte and copies of each other."""
    draw = random.Random(seed)
    passages = ["".join(draw.choices("abcé ", k=draw.randint(5, 60))) for _ in range(6)] + ["z" * 40, "xy" * 15]
    texts = []
    for k in range(n):
        parts = [draw.choice(passages)[draw.randint(0, 4):] if draw.random() < 0.6 else "".join(draw.choices("abcdé\n", k=draw.randint(0, 25))) for _ in range(draw.randint(0, 8))]
        texts.append("".join(parts))
    texts += draw.choices(texts, k=n // 4)
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed,group,chunk", [(1, 4096, 1 << 18), (2, 3, 1 << 18), (3, 0, 50), (4, 4096, 37)])
def test_small_windows(spark, seed, group, chunk):
    """Whole groups, groups split by content, and texts in many chunks give the same."""
    rows = pieces(seed, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(S.remove_repeats(df, 20, 4, group, chunk)) == brute(rows, 20)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    # the longest texts are repeats of themselves: counting all their windows is slow, so they are shortened here
    rows = [(d, t and t[:3000]) for d, t in rows]
    df = spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in rows], "doc_id long, text string, key string, n int, h int, row int")
    assert result(S.remove_repeats(df)) == brute(rows, S.WINDOW)
    assert S.remove_repeats(no_docs).count() == 0


def test_long_text_of_one_word_goes_whole(spark, odd_docs):
    found = {r.doc_id: r for r in S.remove_repeats(odd_docs).collect()}
    assert (found[3].n_removed, found[3].n_spans) == (found[3].n_bytes, 1)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(S.remove_repeats(docs)) == brute(rows, S.WINDOW)


def test_merge_is_the_order_of_all_suffixes():
    """The merged shards' repeated windows are those of one transform of all contexts."""
    draw = np.random.default_rng(5)
    columns = draw.integers(0, 2, (30, 60)).astype(np.uint16)
    columns[8:, 10:50] = columns[8:, [0]]
    group = np.sort(draw.integers(0, 4, 60))
    shard = draw.integers(0, 3, 60)
    members = [np.flatnonzero(shard == s) for s in range(3)]
    found = np.empty((20, 60), bool)
    for m, f in zip(members, S.merge([(*S.transform(np.ascontiguousarray(columns[:, m]), group[m]), group[m]) for m in members], 10, 20)):
        found[:, m] = f
    for k in range(20):
        same = Counter((g, *columns[k:k + 10, i]) for i, g in enumerate(group))
        assert found[k].tolist() == [same[(g, *columns[k:k + 10, i])] > 1 for i, g in enumerate(group)]


def test_shard_order_is_sorted():
    columns = np.random.default_rng(6).integers(0, 3, (12, 40)).astype(np.uint16)
    bwt, orders = S.transform(columns, np.zeros(40, int))
    for k in range(12):
        suffixes = [columns[k:, i].tolist() for i in orders[k]]
        assert suffixes == sorted(suffixes)


def test_outputs_are_texts_and_spans(spark):
    """The operator gives the bytes that stay and the places of the others; the query's columns follow from them."""
    rows = [(d, t) for d, t in pieces(7, 60)] + [(None, None)]
    data = {d: (t or "").encode() for d, t in rows}
    found = S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20, 4).collect()
    assert len(found) == len(rows)
    for r in found:
        cuts = [0, *(x for span in zip(r.starts, r.ends) for x in span), len(data[r.doc_id])]
        assert bytes(r.text) == b"".join(data[r.doc_id][a:b] for a, b in zip(cuts[::2], cuts[1::2]))
        assert cuts == sorted(cuts) and r.n_bytes == len(data[r.doc_id])
    digest = sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.text), len(r.starts), hashlib.sha256(r.text).hexdigest()) for r in found), key=str)
    assert digest == brute(rows, 20)


def test_passages_of_over_50_words(spark):
    """A planted passage goes where it has the window's bytes, however many words; shorter ones and clean texts stay whole."""
    draw = random.Random(8)
    words = lambda n, size: " ".join("".join(draw.choices("abcdefghij", k=size)) for _ in range(n))
    long, short = words(60, 9), words(60, 4)
    assert len(short) < S.WINDOW < len(long)
    own = [words(80, 7) for _ in range(6)]
    texts = [f"{own[0]}\n{long}\n{own[1]}", f"{own[2]}\n{long}\n", f"{own[3]}\n{short}\n{own[4]}", f"{short}\n", own[5]]
    found = {r.doc_id: r for r in S.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[k].n_bytes for k in range(5)] == [len(t) for t in texts]
    # the line ends on both sides are the same too
    assert [(found[k].n_removed, found[k].n_spans) for k in range(5)] == [(len(long) + 2, 1)] * 2 + [(0, 0)] * 3
