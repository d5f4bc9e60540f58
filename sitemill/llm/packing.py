"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Pieces of one length are interchangeable, so best fit decreasing over *all* pieces
needs only the histogram of their lengths (at most ``capacity`` rows, whatever the
corpus). The packing runs over that histogram with a segment tree over remaining
capacities that finds the tightest open sequences in O(log capacity); it yields
runs "the pieces of length L with ranks r..r+n go to sequences s.. at offset o".
Spark gives every piece its rank among the pieces of its length and looks its run
up. The number of sequences is that of sequential best fit decreasing over the
whole corpus, with no loss at partition borders.

Defined results: a null text counts as empty; an empty text is one piece holding
only the end id; repeated rows are packed as often as they occur; an empty table
gives an empty result; a null doc_id is kept as any other value.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitemill.llm.shingles import mix
from sitemill.llm.slices import slices, prepare_workers
from sitemill.session import materialise

#: Ids pass through Python as text: pandas would make a nullable long a double.
PIECES = "doc_id string, piece int, start long, length long, ids binary"
#: A Python worker keeps the ids of so many words, about 40 bytes each; beyond it those used least often go. Results don't depend on it.
MEMO_WORDS = 400_000
#: New words are kept apart until there are so many.
YOUNG_WORDS = 32_768
#: Longer words are encoded as they come.
LONGEST = 64
#: One id in the vocabularies this is used with; where it isn't, or a word holds it, words are encoded one by one.
MARK = "\u2764"
#: ASCII punctuation that ends a word. The apostrophe is left out: contractions are tokens of their own.
TAIL = b".,;:!?#$%&*|"
_SPACE, _ENDS, _ALPHA = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ENDS[list(TAIL)] = True
_ALPHA[[*range(65, 91), *range(97, 123)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(LONGEST + 1, _STEP, np.uint64))
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_tokenizers: dict = {}
_memos: dict[str, Memo] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].encode_special_tokens = True
    return _tokenizers[path]


def _encoded(words: list[bytes], path: str) -> list[bytes]:
    """Ids of new words, in few calls: the words stand between marks of one id that none of them holds."""
    tokenizer, out = _tokenizer(path), []
    ids_of = lambda t: np.array(tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, "<u4")
    mark = ids_of(MARK)
    for at in range(0, len(words), 4096):
        part = [w.decode("utf-8", "replace") for w in words[at:at + 4096]]
        ids = ids_of(f" {MARK} ".join(part))
        ends = np.flatnonzero(ids == mark[0])
        if len(mark) == 1 and len(ends) == len(part) - 1:
            raw, b = ids.tobytes(), (4 * ends).tolist()
            out += [raw[i:j] for i, j in zip([0, *(e + 4 for e in b)], [*b, len(raw)])]
        else:
            out += [ids_of(w).tobytes() for w in part]
    return out


def _pieces(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text (runs without ASCII white space), those that end a letter's run with punctuation cut before it."""
    byte = np.frombuffer(buffer, np.uint8)
    space, tail = _SPACE[byte], _ENDS[byte]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    run = np.flatnonzero(tail & np.r_[False, ~tail[:-1]])
    run_end = np.flatnonzero(tail & np.r_[~tail[1:], True]) + 1
    run_end = run_end[len(run_end) - len(run):]  # a run at the text's start has nothing before it
    cut = run[space[run_end] & _ALPHA[byte[run - 1]]]
    return np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))


class Memo:
    """Ids of words: columns sorted by the words' hashes, and one array that holds all ids, told apart by offsets.

    A word is known by its hash, its first eight bytes and its length.
    """
    COLUMNS = {"hash": np.uint64, "head": np.uint64, "size": np.uint8, "at": np.int32, "n": np.int32, "uses": np.int32}

    def __init__(self):
        self.main, self.young = ({c: np.empty(0, t) for c, t in self.COLUMNS.items()} for _ in range(2))
        self._room, self._used = np.empty(1 << 16, "<u4"), 0

    def append(self, ids: np.ndarray) -> np.ndarray:
        """All ids, those appended last; what was returned before stays as it is."""
        if self._used + len(ids) > len(self._room):
            self._room = np.concatenate((self._room[:self._used], np.empty(self._used + len(ids), "<u4")))
        self._room[self._used:self._used + len(ids)] = ids
        self._used += len(ids)
        return self._room[:self._used]

    @property
    def used(self) -> int:
        return self._used

    @staticmethod
    def _merged(a: dict, b: dict) -> dict:
        order = np.argsort(np.concatenate((a["hash"], b["hash"])), kind="stable")
        return {c: np.concatenate((a[c], b[c]))[order].astype(t, copy=False) for c, t in Memo.COLUMNS.items()}

    def find(self, words: dict) -> np.ndarray:
        """Which of the different words are known; their ``at`` and ``n`` are filled in."""
        known = np.zeros(len(words["hash"]), bool)
        for table in (self.main, self.young):
            if len(table["hash"]):
                place = np.minimum(np.searchsorted(table["hash"], words["hash"]), len(table["hash"]) - 1)
                hit = np.logical_and.reduce([table[c][place] == words[c] for c in ("hash", "head", "size")])
                place = place[hit]
                table["uses"][place] += 1
                words["at"][hit], words["n"][hit] = table["at"][place], table["n"][place]
                known |= hit
        return known

    def add(self, words: dict) -> None:
        """Keep new words, whose ids are appended already."""
        self.young = self._merged(self.young, words)
        if len(self.young["hash"]) >= YOUNG_WORDS:
            self.main = self._merged(self.main, self.young)
            self.young = {c: x[:0] for c, x in self.young.items()}
            if len(self.main["hash"]) > MEMO_WORDS:
                self._shrink()

    def _shrink(self) -> None:
        """Keep the half of the words that was used most often lately."""
        kept = np.sort(np.argsort(-self.main["uses"], kind="stable")[:MEMO_WORDS // 2])
        main = {c: x[kept] for c, x in self.main.items()}
        self._room = self._room[_ranges(main["at"], main["n"])]
        self._used = len(self._room)
        main["at"] = (np.cumsum(main["n"]) - main["n"]).astype(np.int32)
        main["uses"] //= 2
        self.main = main


def _ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers at[0], at[0] + 1, ... n[0] of them, then those from at[1] on, and so on."""
    return np.repeat((at - (np.cumsum(n) - n)).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)


def _texts_ids(texts: list[str], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text.

    The tokenizer lowers the case, drops white space and joins nothing across it, so a text's ids
    are those of its words (runs without ASCII white space) in order; and it splits between
    a letter and punctuation, so a word's ids are those of its stem and of the punctuation that ends it.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    buffer = b" ".join([*raw, b" " * 8])
    starts, ends = _pieces(buffer)
    size = ends - starts
    ids, at, n = _words_ids(buffer, starts, size, path)
    tokens = np.r_[0, np.cumsum(n)]
    cuts = tokens[np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raw]))].tolist()
    out = ids[_ranges(at, n)]
    return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def _words_ids(buffer: bytes, starts: np.ndarray, size: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An array of ids, and each word's place and number of ids in it."""
    memo = _memos.setdefault(path, Memo())
    at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    short = np.flatnonzero(size <= LONGEST)
    byte = np.frombuffer(buffer, np.uint8)
    encoded: list[bytes] = []
    extra: list[bytes] = []
    if len(short):
        first, length = starts[short], size[short]
        offset = np.cumsum(length) - length
        place = np.arange(length.sum(), dtype=np.int32) - np.repeat(offset.astype(np.int32), length)
        value = (byte[place + np.repeat(first.astype(np.int32), length)] + np.uint64(1)) * _POWERS[place]
        hashes = mix(np.add.reduceat(value, offset) + length.astype(np.uint64) * _STEP)
        head = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))[first] & _HEADS[np.minimum(length, 8)]
        code, unique = pd.factorize(hashes)
        once = np.empty(len(unique), np.int64)
        once[code[::-1]] = np.arange(len(code))[::-1]
        if not ((head == head[once][code]) & (length == length[once][code])).all():  # different words of one hash
            code, unique = pd.factorize(pd.Series([buffer[s:s + k] for s, k in zip(first.tolist(), length.tolist())]))
            once = np.empty(len(unique), np.int64)
            once[code[::-1]] = np.arange(len(code))[::-1]
        words = {"hash": hashes[once], "head": head[once], "size": length[once], "at": np.zeros(len(once), np.int64), "n": np.zeros(len(once), np.int64), "uses": np.ones(len(once), np.int32)}
        new = np.flatnonzero(~memo.find(words))
        encoded = _encoded([buffer[s:s + k] for s, k in zip(first[once[new]].tolist(), length[once[new]].tolist())], path)
        words["n"][new] = np.array([len(x) // 4 for x in encoded], np.int64)
        words["at"][new] = memo.used + np.cumsum(words["n"][new]) - words["n"][new]
        at[short], n[short] = words["at"][code], words["n"][code]
    ids = memo.append(np.frombuffer(b"".join(encoded), "<u4"))
    if len(short):
        memo.add({c: x[new] for c, x in words.items()})
    for w in np.flatnonzero(size > LONGEST).tolist():
        extra += _encoded([buffer[starts[w]:starts[w] + size[w]]], path)
        n[w] = len(extra[-1]) // 4
        at[w] = len(ids) + sum(map(len, extra[:-1])) // 4
    return (np.concatenate((ids, np.frombuffer(b"".join(extra), "<u4"))) if extra else ids), at, n


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids): each text's ids plus ``end_id``, cut into pieces of ``capacity``."""
    prepare_workers(docs)
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, ids in zip(part["doc_id"].tolist(), _texts_ids(part["text"].tolist(), tokenizer_path)):
                    ids += tail
                    rows += [(doc, k, k * capacity, min(capacity, len(ids) // 4 - k * capacity), ids[4 * k * capacity:4 * (k + 1) * capacity])
                             for k in range(-(-len(ids) // (4 * capacity)))]
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"]).astype({"doc_id": object})

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInPandas(run, PIECES).withColumn("doc_id", F.col("doc_id").cast("long"))


class OpenSequences:
    """Sequences by remaining capacity: a segment tree whose leaves 0..capacity hold runs of equally filled sequences."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.any = bytearray(2 * self.leaves)
        self.runs: list[deque] = [deque() for _ in range(self.leaves)]

    def put(self, room: int, first: int, n: int) -> None:
        self.runs[room].append((first, n))
        at = room + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at //= 2

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to ``most`` sequences with just this room: (first, how many)."""
        first, n = self.runs[room].popleft()
        if n > most:
            self.runs[room].appendleft((first + most, n - most))
            n = most
        at = room + self.leaves
        if not self.runs[room]:
            self.any[at] = 0
            while at > 1 and not self.any[at ^ 1]:
                at //= 2
                self.any[at] = 0
        return first, n

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open sequence has."""
        at = need + self.leaves
        if self.any[at]:
            return need
        while at > 1 and not (at % 2 == 0 and self.any[at + 1]):
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at + (not self.any[2 * at])
        return at - self.leaves


def best_fit_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over a histogram of lengths.

    Returns runs (length, first_rank, n, per_sequence, first_sequence, offset): the piece
    of rank r of that length (first_rank <= r < first_rank + n) goes to sequence
    first_sequence + k // per_sequence at offset + length * (k % per_sequence), k = r - first_rank.
    """
    open_, runs, made = OpenSequences(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        while rank < n:
            left = n - rank
            room = open_.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, got = made, -(-left // each)
                made += got
            else:
                each = room // length  # the tightest one stays the tightest until no more fits
                first, got = open_.take(room, -(-left // each))
            placed = min(left, got * each)
            full, rest = divmod(placed, each)
            if full:
                open_.put(room - each * length, first, full)
            if rest:
                open_.put(room - rest * length, first + full, 1)
            runs.append((length, rank, placed, each, first, capacity - room))
            rank += placed
    return runs


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (doc_id, piece, length, ...; 1 <= length <= capacity).

    ``pieces`` is read three times: hand over a written table. Ranks come from two
    windows, one per (bucket, length) and one over the buckets' counts, so that a
    length which a third of all pieces share is not gathered in one task.
    """
    spark = pieces.sparkSession
    if "_bucket" in pieces.columns or {"sequence_id", "offset"} & set(pieces.columns):
        raise ValueError("pieces must not have the columns _bucket, sequence_id, offset")
    counted = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    if bad := [r["length"] for r in counted if not 1 <= (r["length"] or 0) <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {sorted(map(str, bad))[:5]}")
    histogram = {r["length"]: r["count"] for r in counted}
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(histogram.values()) // 100_000, 1)
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
            .select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    order = Window.partitionBy("_bucket", "length").orderBy(*[c for c in pieces.columns if c != "length"])
    runs = spark.createDataFrame(best_fit_runs(histogram, capacity), "length long, r long, n long, per long, s long, o long")
    runs = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("r", "n", "per", "s", "o"))).alias("_runs"))
    ranked = (keyed.withColumn("_k", F.row_number().over(order) - 1)
              .join(base, ["length", "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_k"))
              .join(F.broadcast(runs), "length")  # runs follow from at most `capacity` counts
              .withColumn("_run", F.filter("_runs", lambda x: (x["r"] <= F.col("_rank")) & (F.col("_rank") < x["r"] + x["n"]))[0])
              .withColumn("_at", F.col("_rank") - F.col("_run.r")))
    return ranked.select(
        *pieces.columns,
        (F.col("_run.s") + F.floor(F.col("_at") / F.col("_run.per"))).cast("long").alias("sequence_id"),
        (F.col("_run.o") + F.col("length") * (F.col("_at") % F.col("_run.per"))).cast("long").alias("offset"))


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Digest of the packing of all documents: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = tokenise(docs, tokenizer_path, capacity, end_id)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(materialise(digest, "pieces"), capacity)
