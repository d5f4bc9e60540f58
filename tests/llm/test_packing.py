"""Packing: ids against the tokenizer, sequences against sequential best fit decreasing."""
import bisect
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from sitemill.llm import packing as K

PATH = P.path("word_bpe_49k.json")


def sequential(lengths, capacity):
    """Best fit decreasing, one piece at a time: the number of sequences and their loads."""
    rooms, loads = [], []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return len(rooms), sorted(capacity - r for r in rooms)


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_sequential_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 50, 200])
    lengths = [rnd.randint(1, capacity) for _ in range(rnd.choice([1, 40, 900]))] + [capacity // 2] * rnd.randint(0, 200)
    histogram = {n: lengths.count(n) for n in set(lengths)}
    loads = {}
    for length, first, n, per, sequence, offset in K.best_fit_runs(histogram, capacity):
        for k in range(n):
            s, at = sequence + k // per, offset + length * (k % per)
            assert loads.get(s, 0) == at
            loads[s] = at + length
            assert loads[s] <= capacity
    assert sum(loads.values()) == sum(lengths)
    assert (len(loads), sorted(loads.values())) == sequential(lengths, capacity)


def _check(rows, docs, capacity):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    expected = []
    for d, x in docs:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        expected += [(d, k // capacity, k, len(p := ids[k:k + capacity]), zlib.crc32(p.tobytes())) for k in range(0, len(ids), capacity)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(expected, key=key)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values(), default=0) <= capacity
    assert len(ends) == sequential([e[3] for e in expected], capacity)[0]


@pytest.mark.parametrize("capacity", [16, 2048])
def test_odd_documents(spark, odd_docs, no_docs, capacity):
    rows = K.packed_documents(odd_docs, PATH, capacity).collect()
    _check(rows, [(r.doc_id, r.text) for r in odd_docs.collect()], capacity)
    assert K.packed_documents(no_docs, PATH, capacity).count() == 0


def test_words_and_endings():
    texts = ["Don't STOP... (really?) it's 3.14!!", "a,b;c", "x''", "Été, ❤ love❤ ❤.", "!!! ???", "café. naïve!", "a b  c", "<|endoftext|> end"]
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    assert [np.frombuffer(b, "<u4").tolist() for b in K._texts_ids(texts, PATH)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_lengths_outside_the_capacity_are_refused(spark):
    with pytest.raises(ValueError):
        K.pack(spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long"), 8)


def test_forgotten_words_are_encoded_again(monkeypatch):
    """A memo of a few words, long words, and words that differ in their ending punctuation only."""
    monkeypatch.setattr(K, "MEMO_WORDS", 40)
    monkeypatch.setattr(K, "YOUNG_WORDS", 10)
    monkeypatch.setattr(K, "_memos", {})
    texts = ["", " ", "a", "A. a, a!? 'tis it's e.g. ...", "?!x y#", "x" * 64 + " " + "x" * 65 + " " + "y" * 5000, "straße 漢字 é.", "end.\n.start"]
    texts += [" ".join(f"w{(7 * i + j) % 90}x{j % 4}{',' if j % 3 else ''}" for j in range(60)) for i in range(40)]
    want = [np.array(e.ids, "<u4").tobytes() for e in K._tokenizer(PATH).encode_batch_fast(texts, add_special_tokens=False)]
    for size in (len(texts), 3, 1):
        assert [x for at in range(0, len(texts), size) for x in K._texts_ids(texts[at:at + size], PATH)] == want
    assert len(K._memos[PATH].main["hash"]) <= 40 + 10


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(K, "mix", lambda h: h & np.uint64(3))
    monkeypatch.setattr(K, "_memos", {})
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)] * 2
    want = [np.array(e.ids, "<u4").tobytes() for e in K._tokenizer(PATH).encode_batch_fast(texts, add_special_tokens=False)]
    assert K._texts_ids(texts[:20], PATH) + K._texts_ids(texts[20:], PATH) == want
