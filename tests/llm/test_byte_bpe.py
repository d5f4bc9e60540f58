"""Byte-level BPE against the library's encoding of whole texts."""
import hashlib

import public_tokenizers as P
import pytest

from sitemill.llm import byte_bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")
HARD = ["", None, "a" * 5000, "héllo wörld  \n\n  it's we're 123 " * 300, " \n" * 900, "漢字かな " * 700, "don't" * 400 + "  x", "x \n\n y" * 500]


def _sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (200, 50), (1000, 10), (32768, 1024)])
def test_pieces_give_the_ids_of_whole_texts(spark, chunk, overlap):
    df = spark.createDataFrame(list(enumerate(HARD)) + [(3, HARD[3]), (None, HARD[3])], "doc_id long, text string")
    rows = B.digests(df, PATH, P.PATTERN, chunk, overlap).collect()
    assert len(rows) == len(HARD) + 2
    enc = B._encoding(PATH, P.PATTERN)
    for r in rows:
        text = (HARD[r.doc_id] if r.doc_id is not None else HARD[3]) or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), _sha(",".join(map(str, ids)).encode()), _sha(text.encode()))


def test_pieces_round_trip(spark):
    df = spark.createDataFrame([(1, HARD[3])], "doc_id long, text string")
    pieces = B.encode(df, PATH, P.PATTERN, 200, 50).orderBy("piece").collect()
    assert len(pieces) > 5 and {p.n_pieces for p in pieces} == {len(pieces)}
    assert b"".join(B.decode(bytes(p.ids), PATH, P.PATTERN) for p in pieces).decode() == HARD[3]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = B.digests(odd_docs, PATH, P.PATTERN).collect()
    assert len(rows) == odd_docs.count()
    assert B.digests(no_docs, PATH, P.PATTERN).count() == 0


def test_cuts_avoid_white_space():
    for text in filter(None, HARD):
        for e in B.boundaries(text, P.PATTERN):
            assert not text[e - 1].isspace()
