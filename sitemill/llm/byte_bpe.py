"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of up to ``chunk`` characters is one piece. Longer texts are cut into chunks that
overlap by ``overlap`` characters, and each chunk is pre-tokenised on its own, in parallel.
A chunk's first pre-tokens may be wrong, as it starts anywhere; from the first boundary on
that it shares with the chunk before it both go on alike, since the pattern reads from left
to right. There the text is cut, and each piece between two cuts is encoded by itself. Where
two neighbours share no boundary in their overlap (one pre-token of thousands of characters)
there is no cut, and their piece is encoded as one. The encoder gives the ids of a piece as if
the whole text had been encoded; decoding concatenates the bytes of the ids in order.

Defined results: a null text counts as empty and has one empty piece; rows equal in doc_id
and text are encoded once and reported as often as they occur; a null doc_id is an id as any
other; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.llm.slices import slices, prepare_workers

#: A boundary counts only this far from a chunk's end: the pattern looks no further ahead than a contraction.
AHEAD = 4
_encodings: dict = {}


def _encoding(path: str, pattern: str):
    if (path, pattern) not in _encodings:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens of ``text`` after which it may be cut.

    After white space it may not: a run of white space is split differently at the end of a text.
    """
    import regex

    return [e for m in regex.finditer(pattern, text) if not text[(e := m.end()) - 1].isspace()]


def cuts(docs: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, text, copies, cuts): where each long text is cut, ascending, without 0 and its length."""

    def ends(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, k, last in zip(b["part"], b["k"], b["last"]):
                found = boundaries(text, pattern)
                if not last:
                    found = [e for e in found if e <= len(text) - AHEAD]
                at = k * chunk
                head = [at + e for e in found if e <= overlap] if k else []
                tail = [at + e for e in found if chunk <= e <= chunk + overlap] if not last else []
                rows.append((head, tail))
            yield pd.DataFrame({"row": b["row"], "k": b["k"], "head": [r[0] for r in rows], "tail": [r[1] for r in rows]})

    parts = (docs.withColumn("n", F.char_length("text"))
             .withColumn("last_k", F.greatest(F.ceil((F.col("n") - overlap) / chunk) - 1, F.lit(0)).cast("int"))
             .select("row", "text", "last_k", F.explode(F.sequence(F.lit(0), F.col("last_k"))).alias("k"))
             .select("row", "k", (F.col("k") == F.col("last_k")).alias("last"),
                     F.expr(f"substring(text, k * {chunk} + 1, if(k = last_k, char_length(text), {chunk + overlap}))").alias("part")))
    found = parts.mapInPandas(ends, "row string, k int, head array<long>, tail array<long>")
    # a chunk's tail and the next one's head lie in the same stretch of the text
    shared = (found.select("row", (F.col("k") + 1).alias("k"), "tail").join(found.select("row", "k", "head"), ["row", "k"])
              .select("row", F.array_min(F.array_intersect("tail", "head")).alias("cut")).where("cut IS NOT NULL")
              .groupBy("row").agg(F.sort_array(F.collect_set("cut")).alias("cuts")))
    return docs.join(shared, "row", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<long>")))


def _split(docs: DataFrame, pattern: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Texts of one piece, and the pieces of the longer ones: (row, doc_id, copies, piece, n_pieces, text)."""
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be from 1 to the chunk's length")
    prepare_workers(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = chunk + overlap
    short = rows.where(F.char_length("text") <= size).select(
        F.lit(None).cast("string").alias("row"), "doc_id", F.lit(1).cast("long").alias("copies"), F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), "text")
    long = (rows.where(F.char_length("text") > size).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
            .withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2("text", 256))))
    cut = (cuts(long, pattern, chunk, overlap)
           .withColumn("from", F.concat(F.array(F.lit(0).cast("long")), F.col("cuts"))).withColumn("to", F.concat(F.col("cuts"), F.array(F.char_length("text").cast("long"))))
           .select("row", "doc_id", "copies", "text", F.size("from").alias("n_pieces"), F.posexplode(F.arrays_zip("from", "to")).alias("piece", "span"))
           .select("row", "doc_id", "copies", "piece", "n_pieces", F.expr("substring(text, int(span.from + 1), int(span.to - span.from))").alias("text")))
    return short, cut


def _encoded(pieces: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(ranks_path, pattern)
        for b in batches:
            for part in slices(b):
                part = part.astype({"row": object, "doc_id": object})
                part["ids"] = [np.asarray(enc.encode_ordinary(t), "<u4").tobytes() for t in part.pop("text")]
                yield part

    # ids pass through Python as text: pandas would make a nullable long a double
    kind = "row string, doc_id string, copies long, piece int, n_pieces int, ids binary"
    return pieces.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, kind).withColumn("doc_id", F.col("doc_id").cast("long"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = 32768, overlap: int = 1024) -> DataFrame:
    """(row, doc_id, copies, piece, n_pieces, ids): little-endian 32-bit ids of each piece of each text.

    ``row`` is null for one-piece texts; it names the distinct (doc_id, text) of the others.
    """
    short, cut = _split(docs, pattern, chunk, overlap)
    return _encoded(short.unionByName(cut), ranks_path, pattern)


def decode(ids: bytes, ranks_path: str, pattern: str) -> bytes:
    """The bytes of little-endian 32-bit ids."""
    return _encoding(ranks_path, pattern).decode_bytes(np.frombuffer(ids, "<u4").tolist())


def digests(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = 32768, overlap: int = 1024) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(ranks_path, pattern)
        for b in batches:
            rows = []
            for ids in b["ids"]:
                a = np.frombuffer(ids, "<u4").tolist()
                rows.append((len(a), hashlib.sha256(",".join(map(str, a)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(a)).hexdigest()))
            yield pd.concat([b[["doc_id", "copies"]].astype({"doc_id": object}).reset_index(drop=True), pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])], axis=1)

    short, cut = _split(docs, pattern, chunk, overlap)
    whole = _encoded(short, ranks_path, pattern).select("doc_id", "copies", "ids")
    joined = (_encoded(cut, ranks_path, pattern).groupBy("row", "doc_id", "copies")
              .agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))  # the pieces of one text
              .select("doc_id", "copies", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids")))
    kind = "doc_id string, copies long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = whole.unionByName(joined).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, kind).withColumn("doc_id", F.col("doc_id").cast("long"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")
