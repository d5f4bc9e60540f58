"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every byte covered by a ``WINDOW``-byte string that also starts elsewhere goes. Equal strings are
brought together by their content, so that the suffixes to order are few and lie in bounded groups:

1. Anchors. The anchor of a window is the leftmost smallest hash among its ``GRAM``-byte grams, so
   equal windows have equal anchors at equal places. One pass over the texts finds, for each run
   of windows with one anchor, a narrow row (anchor's hash, digest of the run's bytes, place).
   Runs whose hash occurs once hold no repeated window and are left out; this loses none.
2. Equal runs, however many, are one context with a count. Contexts of one hash are cut from the
   texts and brought to the task that owns the hash, all aligned at their anchor, dealt to
   ``SHARDS`` shards by their document.
3. Shard transforms. From the last column to the first, a shard's contexts are kept in the order
   of their suffixes from that column on. The bytes that precede the suffixes, in that order, are
   the shard's Burrows-Wheeler transform, column by column; a stable partition by them gives the
   order of the column before.
4. Merge. The interleave says, for each place of the merged order, from which shard its suffix
   comes. Each refinement step reads the shards' next transform bytes through the interleave and
   partitions it stably by them, so it is in turn in the order of one byte more; no suffix is
   sorted or compared again. As contexts are aligned, a step moves one column on. Common prefixes
   come along: a pair of neighbours that a step parts ends at this column; a pair that becomes
   neighbours ends at the least end in between. Neighbours with ``WINDOW`` bytes in common form
   the repeated intervals, and the shards' suffix orders name their windows.
5. Hashes with more than ``GROUP`` contexts (a passage that very many documents continue in their
   own ways) are split by the whole content of their windows instead, where a repeated interval
   is a group of equal strings, counted with map-side combine.
6. Documents collect the byte ranges of their windows; overlapping ranges are one span.

Defined results: a null text counts as empty; texts below ``WINDOW`` bytes lose nothing; matches
never cross documents; a text's own repeats count, overlapping ones too. Repeated rows, and equal
texts under different ids, are documents of their own: each one's windows occur in the other, so
both lose what they share. Null doc_ids are kept as any other value. An empty table gives an empty
result. Long texts are worked on in overlapping chunks, with the same result. Further columns are
never read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.llm.shingles import mix
from sitemill.llm.slices import prepare_workers
from sitemill.session import materialise

WINDOW, GRAM = 400, 32
SHARDS = 8
#: Contexts of one hash that are merged in one task; beyond it the hash is split by its windows' content.
GROUP = 4096
#: Contexts that a task merges at a time: whole groups until there are so many.
BATCH = 4096
#: Ids (16 bytes each) up to this number go to every task: 16 MB; beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Bytes that are hashed at a time.
CHUNK = 1 << 18
PAD = 256
_BASE = 0x9E3779B97F4A7C15


def _grams(byte: np.ndarray, size: int, powers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(byte) + 1, np.uint64)
    np.cumsum(byte * powers[:len(byte)] + powers[:len(byte)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * inverse[:len(byte) - size + 1])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b % 2**64, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 2**64)))


def windows(buffer: bytes, ends: list[int], window: int, gram: int, powers) -> tuple[np.ndarray, ...]:
    """(hash, anchor, first and last start) of each run of windows with one anchor; no window crosses one of the texts' ``ends``."""
    n, width = len(buffer) - window + 1, window - gram + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 4
    grams = _grams(np.frombuffer(buffer, np.uint8), gram, *powers)
    # the hash's leading bits, then the place: the minimum is the leftmost smallest
    low = np.uint64((1 << 20) - 1)
    code = np.full(-(-len(grams) // width) * width, ~np.uint64(0))
    code[:len(grams)] = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    blocks = code.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:n], ahead[width - 1:width - 1 + n]) & low).astype(np.int64)
    inside = np.ones(n, bool)
    for end in ends:
        inside[max(end - window + 1, 0):end] = False
    start = np.flatnonzero(inside)
    anchor = anchor[start]
    if not len(start):
        return (np.empty(0, np.int64),) * 4
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    return grams[anchor[first]].view(np.int64), anchor[first], start[first], start[last]


def _buffers(texts: list[bytes], window: int, chunk: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of pieces (text's number, from, to) with about ``chunk`` bytes; pieces of a long text overlap by a window less one byte."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - window + 1, 0), chunk):
            end = min(at + chunk + window - 1, len(text))
            if size + end - at > chunk + window:
                yield held
                held, size = [], 0
            held.append((i, at, end))
            size += end - at
    if held:
        yield held


def occurrences(texts: DataFrame, window: int, gram: int, chunk: int = CHUNK) -> DataFrame:
    """(id0, h, key, digest, pos, lo, n): runs of ``n`` windows from ``pos + lo`` on, whose anchor with hash ``key`` is at ``pos``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _powers(chunk + window)
        for batch in batches:
            rows, data = batch[["id0", "h"]].to_numpy(), batch["text"].tolist()
            for pieces in _buffers(data, window, chunk):
                buffer = b"".join(data[i][a:b] for i, a, b in pieces)
                ends = np.cumsum([b - a for _, a, b in pieces])
                key, anchor, first, last = windows(buffer, ends.tolist(), window, gram, powers)
                if not len(key):
                    continue
                view, lo = memoryview(buffer), first - anchor
                digest = [xxhash.xxh3_128_digest(view[f:t + window], s) for f, t, s in zip(first.tolist(), last.tolist(), (lo + window).tolist())]
                piece = np.searchsorted(ends, first, "right")
                own, at, _ = np.array(pieces).T[:, piece]
                pos = anchor - (ends - np.array([b - a for _, a, b in pieces]))[piece] + at
                yield pd.DataFrame({"id0": rows[own, 0], "h": rows[own, 1], "key": key, "digest": digest, "pos": pos, "lo": lo, "n": last - first + 1})
    prepare_workers(texts)
    return texts.mapInPandas(run, "id0 long, h long, key long, digest binary, pos long, lo int, n int")


def _partition(group: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the groups that hold different bytes, their order by group and byte, stable); both empty where none does."""
    differ = np.flatnonzero((byte[1:] != byte[:-1]) & (group[1:] == group[:-1]))
    if not len(differ):
        return differ, differ
    mixed = np.zeros(int(group[-1]) + 1, bool)
    mixed[group[differ]] = True
    places = np.flatnonzero(mixed[group])
    return places, places[np.argsort(group[places] * np.int64(512) + byte[places], kind="stable")]


def transform(columns: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(transform, orders) of a shard: by column, the bytes there in the order of the suffixes behind it, and the suffixes' order from it on.

    ``columns`` holds the aligned contexts, one a column of the array; ``group``, ascending, their groups.
    """
    bwt, orders = np.empty_like(columns), np.empty(columns.shape, np.int32)
    order = np.arange(columns.shape[1], dtype=np.int32)
    for k in range(len(columns) - 1, -1, -1):
        bwt[k] = columns[k][order]
        places, by = _partition(group, bwt[k])
        if len(places):
            order = order.copy()
            order[places] = order[by]
        orders[k] = order
    return bwt, orders


def merge(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], window: int, starts: int) -> list[np.ndarray]:
    """Of each shard (transform, orders, groups): which windows (column, context) of the first ``starts`` columns occur elsewhere too."""
    sizes = [len(g) for _, _, g in shards]
    offsets = np.cumsum([0, *sizes])
    shard = np.repeat(np.arange(len(shards)), sizes)
    group = np.concatenate([g for _, _, g in shards])
    first = np.argsort(group, kind="stable")
    interleave, group = shard[first].astype(np.uint8), group[first]
    columns = len(shards[0][0])
    # by place of the merged order: the column at which the suffix and the one before it first differ
    end = np.where(np.r_[True, group[1:] != group[:-1]], -1, columns).astype(np.int32)
    where = np.argsort(interleave, kind="stable")
    found = np.zeros((starts, offsets[-1]), bool)
    byte = np.empty(offsets[-1], shards[0][0].dtype)
    for k in range(columns - 1, -1, -1):
        byte[where] = np.concatenate([b[k] for b, _, _ in shards])
        places, by = _partition(group, byte)
        if len(places):
            same = (byte[by[1:]] == byte[by[:-1]]) & (group[by[1:]] == group[by[:-1]])
            new = np.where(np.r_[True, group[by[1:]] != group[by[:-1]]], -1, k).astype(np.int32)
            # neighbours now, with others in between before: the least end up to the later one's
            bounds = np.stack([by[:-1][same] + 1, by[1:][same] + 1], axis=1).ravel()
            new[1:][same] = np.minimum.reduceat(np.r_[end, 0], bounds)[::2] if len(bounds) else 0
            end[places] = new
            interleave[places] = interleave[by]
            where = np.argsort(interleave, kind="stable")
        if k < starts:
            long = end - k >= window
            long[:-1] |= long[1:]
            of = np.concatenate([orders[k] + at for (_, orders, _), at in zip(shards, offsets)])
            found[k, of] = long[where]
    return np.split(found, offsets[1:-1], axis=1)


def repeated_windows(rows: pd.DataFrame, window: int, gram: int) -> pd.DataFrame:
    """(key, digest, starts, ends): ranges of repeated window starts, relative to the anchor, of the contexts of whole groups that have no copy."""
    width = window - gram + 1
    rows = rows.sort_values("key", kind="stable", ignore_index=True)
    group = rows["key"].rank(method="dense").to_numpy().astype(np.int64) - 1
    lo, n = rows["lo"].to_numpy(), rows["n"].to_numpy()
    text = np.frombuffer(b"".join(rows["ctx"].tolist()), np.uint8)
    length = n + window - 1
    begin = np.cumsum(length) - length
    # the anchor stands at column width - 1; what a context lacks is padded
    at = np.arange(len(text)) - np.repeat(begin - lo - (width - 1), length)
    columns = np.full((width + window - 1, len(rows)), PAD, np.uint16)
    columns[at, np.repeat(np.arange(len(rows)), length)] = text
    members = [m for m in (np.flatnonzero(rows["shard"].to_numpy() == s) for s in range(SHARDS)) if len(m)]
    shards = [(*transform(np.ascontiguousarray(columns[:, m]), group[m]), group[m]) for m in members]
    found = np.empty((width, len(rows)), bool)
    for m, f in zip(members, merge(shards, window, width)):
        found[:, m] = f
    start = np.arange(width)[:, None] - (width - 1)
    found &= (start >= lo) & (start < lo + n)
    edge = np.diff(np.pad(found, ((1, 1), (0, 0))).astype(np.int8), axis=0).T
    context, opens = np.nonzero(edge == 1)
    closes = np.nonzero(edge == -1)[1]
    cuts = np.searchsorted(context, np.arange(1, len(rows)))
    out = pd.DataFrame({"key": rows["key"], "digest": rows["digest"], "starts": np.split(opens - (width - 1), cuts), "ends": np.split(closes - (width - 1), cuts)})
    return out[rows["copies"] == 1]


def merged_contexts(contexts: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, digest, starts, ends) over contexts (key, digest, copies, lo, n, shard, ctx), whose keys each come to one task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if sum(map(len, held)) >= BATCH:
                # the group that was cut by the batch's end is completed first
                own = batch["key"].to_numpy() == held[-1]["key"].iloc[-1]
                rest = len(batch) if own.all() else int(np.argmin(own))
                held.append(batch.iloc[:rest])
                if rest == len(batch):
                    continue
                yield repeated_windows(pd.concat(held, ignore_index=True), window, gram)
                held, batch = [], batch.iloc[rest:]
            held.append(batch)
        if held:
            yield repeated_windows(pd.concat(held, ignore_index=True), window, gram)
    return contexts.repartition("key").sortWithinPartitions("key").mapInPandas(run, "key long, digest binary, starts array<int>, ends array<int>")


def cut(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_bytes, text, starts, ends) of (doc_id, text, b, e), whose ranges may overlap: the bytes that stay, the removed spans."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, b, e in zip(batch["doc_id"], batch["text"], batch["b"], batch["e"]):
                order = np.argsort(b, kind="stable")
                b, reach = b[order], np.maximum.accumulate(e[order])
                new = np.r_[True, b[1:] > reach[:-1]]
                opens, closes = b[new], reach[np.r_[new[1:], True]]
                kept = b"".join(text[f:t] for f, t in zip([0, *closes.tolist()], [*opens.tolist(), len(text)]))
                out.append((doc_id, len(text), kept, opens, closes))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "text", "starts", "ends"])
    return texts.mapInPandas(run, "doc_id string, n_bytes long, text binary, starts array<long>, ends array<long>")


def _marks(runs: DataFrame, texts: DataFrame, window: int, gram: int, group: int) -> DataFrame:
    """(key, digest, starts, ends) of all contexts of ``runs`` that hold a repeated window."""
    place = F.min(F.struct("id0", "h", "pos")).alias("place")
    facts = materialise(runs.groupBy("key", "digest").agg(F.count("*").alias("copies"), place, F.first("lo").alias("lo"), F.first("n").alias("n")), "contexts")
    keys = materialise(facts.groupBy("key").agg(F.count("*").alias("contexts")).where("contexts > 1"), "merged-keys")
    whole = facts.where("copies > 1").select("key", "digest", F.array("lo").alias("starts"), F.array(F.col("lo") + F.col("n")).alias("ends"))
    asked = facts.join(keys, "key").groupBy("place.id0", "place.h").agg(F.collect_list(F.struct("key", "digest", "copies", "place.pos", "lo", "n", "contexts")).alias("asked"))
    # of repeated rows one gives the bytes
    one = texts.groupBy("id0", "h").agg(F.min("row").alias("row"))
    bytes_of = texts.join(asked.join(one, ["id0", "h"]), ["id0", "h", "row"]).select("h", "text", F.explode("asked").alias("c")).select(
        "c.key", "c.digest", "c.copies", "c.lo", "c.n", "c.contexts", F.pmod("h", F.lit(SHARDS)).cast("int").alias("shard"),
        F.expr(f"substring(text, cast(c.pos + c.lo + 1 as int), c.n + {window - 1})").alias("ctx"))
    bytes_of = materialise(bytes_of, "context-bytes")
    merged = merged_contexts(bytes_of.where(F.col("contexts") <= group).drop("contexts"), window, gram)
    many = bytes_of.where(F.col("contexts") > group).select("key", "digest", "copies", "lo", "ctx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    string = F.expr(f"substring(ctx, i + 1, {window})")
    many = materialise(many.select("key", "digest", "copies", (F.col("lo") + F.col("i")).alias("start"), F.xxhash64(string).alias("w1"), F.xxhash64(string, F.lit(1)).alias("w2")), "windows")
    twice = materialise(many.groupBy("key", "start", "w1", "w2").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "repeated-windows")
    split = many.where("copies = 1").join(twice, ["key", "start", "w1", "w2"], "left_semi").groupBy("key", "digest").agg(F.collect_list("start").alias("starts"))
    split = split.select("key", "digest", "starts", F.transform("starts", lambda s: s + 1).alias("ends"))
    return whole.unionByName(merged.where("size(starts) > 0")).unionByName(split)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_bytes (of the whole text), text (the bytes that stay), starts and ends (the removed spans)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a row's key: without nulls, and the same for rows equal in doc_id and text only
    texts = texts.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id0"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("h"), F.col("text").cast("binary").alias("text"))
    runs = materialise(occurrences(texts.where(F.length("text") >= window).select("id0", "h", "text"), window, gram, chunk), "runs")
    again = materialise(runs.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "repeated-keys")
    runs = materialise(runs.join(again, "key", "left_semi"), "repeated-runs")
    ids = materialise(runs.select("id0", "h").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if few else ids
    some = materialise(texts.join(ids, ["id0", "h"], "left_semi").withColumn("row", F.monotonically_increasing_id()), "texts")
    marks = materialise(_marks(runs, some.drop("doc_id"), window, gram, group), "marks")
    ranges = runs.join(marks, ["key", "digest"]).select("id0", "h", "pos", F.explode(F.arrays_zip("starts", "ends")).alias("r"))
    ranges = ranges.groupBy("id0", "h").agg(F.collect_list(F.col("pos") + F.col("r.starts")).alias("b"), F.collect_list(F.col("pos") + F.col("r.ends") + (window - 1)).alias("e"))
    ranges = materialise(ranges, "ranges")
    changed = cut(some.join(ranges, ["id0", "h"]).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "b", "e"), window)
    done = ranges.select("id0", "h")
    same = texts.join(F.broadcast(done) if few else done, ["id0", "h"], "left_anti")
    none = F.array().cast("array<long>")
    same = same.select("doc_id", F.length("text").cast("long").alias("n_bytes"), "text", none.alias("starts"), none.alias("ends"))
    return same.unionByName(changed.withColumn("doc_id", F.col("doc_id").cast("long")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """Digest of ``without_repeats``, one row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    left = without_repeats(docs, window, gram, group, chunk)
    removed = (F.col("n_bytes") - F.length("text")).alias("n_removed")
    return left.select("doc_id", "n_bytes", removed, F.size("starts").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
