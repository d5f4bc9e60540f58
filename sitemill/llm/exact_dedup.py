"""Exact de-duplication by an extendible-hash index on shared files (DataFrame functions only).

1. Slots: one narrow row per document (hash key, SHA-256, byte length) of the normalised
   text, written to the shared folder.
2. Entries: slots pre-aggregated by task, then by (key, SHA-256, length): smallest doc_id and
   number of rows. A group of copies, however large, is one entry.
3. Directory: one bucket at first; a bucket of more than ``capacity`` entries is split by its
   keys' next bit, until none is overfull or all 64 bits are used (entries of one key can't be
   split; they are a chain). The directory is doubled with its deepest bucket: a cell for each
   value of the keys' leading bits points to the bucket, which several cells may share.
4. Compare: the whole texts of keys with several rows are aggregated by their bytes within
   (bucket, key, SHA-256, length), in each task first, so that a large group is one text a task
   when it reaches its owner. An entry whose texts differ (both hashes collide) becomes several.
5. Index: the entries of a key in order are its chain; entries are written in ranges of buckets
   and keys, one range an owner task.
6. Look-up: a row finds its bucket by its cell in the directory and its entry in the chain of
   its key there; the answer is the entry's. Rows of the largest groups meet them in the task
   where they are.

Defined results: a null text counts as empty; very long texts are hashed and compared whole; a
null doc_id is larger than any other; of rows equal in doc_id and text one is kept; an empty table
gives an empty result; other columns of the documents, whatever their names, play no part.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemill.session import materialise

ENTRY = ["key", "digest", "n_bytes"]
#: Keys (longs, 8 MB) and directory cells (three longs, 24 MB) up to this number go to every task.
BROADCAST_KEYS = 1_000_000
#: Bits by which overfull buckets are split in one round.
BITS = 8
#: A group above LARGE rows and above one of MOST_LARGE parts of all rows is large: at most MOST_LARGE are (5 MB).
LARGE, MOST_LARGE = 65_536, 50_000


def normalise(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    """The digest's 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def slots(docs: DataFrame, key=F.xxhash64, digest=sha256) -> DataFrame:
    """(doc_id, norm, key, digest, n_bytes); ``key`` and ``digest`` can be weakened to test collisions."""
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalise(F.col("text")).alias("norm"))
    return norm.select("doc_id", "norm", key(F.col("norm")).alias("key"), digest(F.col("norm")).alias("digest"), F.octet_length("norm").cast("long").alias("n_bytes"))


def bucket_of(key: str, bits: str) -> Column:
    """A bucket is named by its leading ``bits``, then zeros; shifts by 64 would be shifts by none."""
    return F.expr(f"if({bits} = 0, 0L, shiftleft(shiftrightunsigned({key}, 64 - {bits}), 64 - {bits}))")


def buckets(keys: DataFrame, capacity: int) -> DataFrame:
    """(bucket, local_depth): the split of ``keys`` (key; one row an entry) into buckets of ``capacity``."""
    whole, deep = [], 0
    while True:
        to = min(deep + BITS, 64)
        cells = keys.groupBy(bucket_of("key", str(to)).alias("cell")).agg(F.count("*").alias("n"))
        steps = cells.withColumn("depth", F.explode(F.sequence(F.lit(deep), F.lit(to)))).withColumn("bucket", bucket_of("cell", "depth"))
        overfull = steps.groupBy("depth", "bucket").agg((F.sum("n") > capacity).alias("overfull"))
        # one bit more than the deepest prefix that is overfull
        local = F.coalesce(F.max(F.when(F.col("overfull"), F.col("depth") + 1)), F.lit(deep))
        found = materialise(steps.join(overfull, ["depth", "bucket"]).groupBy("cell").agg(local.alias("local_depth")), "cells")
        done = found if to == 64 else found.where(f"local_depth <= {to}")
        whole.append(done.withColumn("local_depth", F.least("local_depth", F.lit(64))).select(bucket_of("cell", "local_depth").alias("bucket"), "local_depth").distinct())
        left = found.where(f"local_depth > {to}").select("cell")
        if to == 64 or left.isEmpty():
            break
        keys, deep = keys.withColumn("cell", bucket_of("key", str(to))).join(left, "cell", "left_semi").drop("cell"), to
    out = whole[0]
    for more in whole[1:]:
        out = out.unionByName(more)
    return materialise(out, "buckets")


def directory(entries: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(cell, bucket, local_depth) for each cell that holds entries, and the global depth: a cell is the keys' leading bits."""
    keys = entries.select("key")
    split = buckets(keys, capacity)
    depths = sorted(r[0] for r in split.select("local_depth").distinct().collect())  # 65 numbers at most
    depth = depths[-1] if depths else 0
    cells = keys.select(bucket_of("key", str(depth)).alias("cell")).distinct()
    pointed = cells.withColumn("local_depth", F.explode(F.array(*[F.lit(d) for d in depths] or [F.lit(0)]))).withColumn("bucket", bucket_of("cell", "local_depth"))
    return materialise(pointed.join(split, ["bucket", "local_depth"]).select("cell", "bucket", "local_depth"), "directory"), depth


def to_bucket(rows: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    """``rows`` (key, ..) with the bucket that the directory names."""
    few = cells.count() <= BROADCAST_KEYS
    return rows.withColumn("cell", bucket_of("key", str(depth))).join(F.broadcast(cells) if few else cells, "cell").drop("cell")


def by_bytes(rows: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Compares the texts of ``rows`` (slots) within their entries byte by byte.

    None if each entry has one text. Else the texts of the others, (key, digest, n_bytes, member,
    own_id, own_size), and their rows, (doc_id, text_sha256, key, digest, n_bytes, member).
    """
    crowded = entries.groupBy("key").agg(F.sum("group_size").alias("n")).where("n > 1").select("key")
    few = crowded.count() <= BROADCAST_KEYS
    found = rows.join(F.broadcast(crowded), "key", "left_semi") if few else rows  # else each text moves once at most
    texts = found.groupBy(*ENTRY, "norm").agg(F.min("doc_id").alias("own_id"), F.count("*").alias("own_size"))
    several = materialise(texts.groupBy(*ENTRY).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "collisions")
    if several.isEmpty():
        return None
    member = F.row_number().over(Window.partitionBy(*ENTRY).orderBy(F.col("own_id").asc_nulls_last(), "norm")) - 1
    told = materialise(texts.join(several, ENTRY, "left_semi").withColumn("member", member), "texts")
    ids = rows.join(told.select(*ENTRY, "norm", "member"), [*ENTRY, "norm"]).select("doc_id", F.sha2("norm", 256).alias("text_sha256"), *ENTRY, "member").distinct()
    return told.drop("norm"), materialise(ids, "members")


def write_index(entries: DataFrame, cells: DataFrame, depth: int, told: DataFrame | None = None) -> DataFrame:
    """Written index (bucket, local_depth, key, chain, digest, n_bytes, member, keep_id, group_size)."""
    if told is None:
        members = entries.withColumn("member", F.lit(0))
    else:
        split = entries.join(told, ENTRY, "left")
        members = split.select(*ENTRY, F.coalesce("member", F.lit(0)).alias("member"), F.when(F.col("own_size").isNull(), F.col("keep_id")).otherwise(F.col("own_id")).alias("keep_id"),
                               F.coalesce("own_size", "group_size").alias("group_size"))
    chain = F.row_number().over(Window.partitionBy("key").orderBy("digest", "n_bytes", "member")) - 1
    placed = to_bucket(members, cells, depth).withColumn("chain", chain)
    return materialise(placed.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "chain"), "index")


def build_index(narrow: DataFrame, capacity: int = 65536) -> DataFrame:
    """The index of slot rows whose hashes don't collide."""
    entries = materialise(narrow.groupBy(ENTRY).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "entries")
    return write_index(entries, *directory(entries, capacity))


def look_up(rows: DataFrame, index: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    """``rows`` (key, digest, n_bytes, member, ..) with chain, keep_id and group_size of their entries in the index."""
    at = ["bucket", *ENTRY, "member"]
    rows = to_bucket(rows, cells, depth).drop("local_depth")
    answer = index.select(*at, "chain", "keep_id", "group_size")
    total = index.agg(F.sum("group_size")).first()[0] or 0
    large = answer.where(F.col("group_size") > max(LARGE, total // MOST_LARGE))
    if large.isEmpty():
        return rows.join(answer, at)
    here = rows.join(F.broadcast(large), at)
    return here.unionByName(rows.join(F.broadcast(large.select(at)), at, "left_anti").join(answer, at))


def exact_duplicates(docs: DataFrame, capacity: int = 65536, key=F.xxhash64, digest=sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = slots(docs, key, digest)
    if digest is sha256:
        narrow = materialise(rows.drop("norm"), "slots").withColumn("text_sha256", F.lower(F.hex("digest")))
    else:
        narrow = materialise(rows.withColumn("text_sha256", F.sha2("norm", 256)).drop("norm"), "slots")
    entries = materialise(narrow.groupBy(ENTRY).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "entries")
    cells, depth = directory(entries, capacity)
    apart = by_bytes(rows, entries)
    if apart is None:
        index, asked = write_index(entries, cells, depth), narrow.withColumn("member", F.lit(0))
    else:
        told, ids = apart
        index = write_index(entries, cells, depth, told)
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "text_sha256", *ENTRY)]
        asked = narrow.alias("a").join(ids.alias("b"), same, "left").select("a.*", F.coalesce("b.member", F.lit(0)).alias("member"))
    # equal rows are told apart by number; doc_id spreads the rows of a large group
    copy = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.lit(0)))
    found = look_up(asked, index, cells, depth)
    return found.select("doc_id", "keep_id", "group_size", ((F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (copy == 1)).alias("kept"), "text_sha256")


def _unused(docs: DataFrame) -> str:
    """A name that no column of ``docs`` has."""
    return "id_" + "_" * max(map(len, docs.columns))


def minus(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose doc_id is not among ``ids`` (doc_id); null is a value."""
    ids = ids.select(F.col("doc_id").alias(_unused(docs))).distinct()
    few = ids.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].cast("long").eqNullSafe(F.col(ids.columns[0])), "left_anti")


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose doc_id is among ``ids`` (doc_id); null is a value."""
    name = _unused(docs)
    return docs.join(ids.select(F.col("doc_id").alias(name)), docs["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_semi")


def without_copies(docs: DataFrame, capacity: int = 65536) -> DataFrame:
    """The rows of ``docs``, all columns, that stay; of rows equal in doc_id and text one."""
    found = materialise(exact_duplicates(docs, capacity).select("doc_id", "kept", "text_sha256"), "copies")
    by_id = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    left = minus(docs, by_id.where(~F.col("kept")))
    again = by_id.where("kept AND n > 1").select("doc_id")
    if again.isEmpty():
        return left
    # an id of several rows doesn't say which of them stays: its text does; the row is held whole, so that its names don't clash
    own = rows_of(left, again)
    held = own.select(F.struct(*[own[c] for c in own.columns]).alias("row"), own["doc_id"].cast("long").alias("id"), F.sha2(normalise(own["text"]), 256).alias("sha"))
    stay = found.where("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha"))
    one = held.join(stay, held["id"].eqNullSafe(F.col("stay_id")) & (F.col("sha") == F.col("stay_sha")), "left_semi").dropDuplicates(["id", "sha"]).select("row.*")
    return minus(left, again).unionByName(one)


ORACLE = r"""
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
keyed AS (SELECT doc_id, sha256(norm) AS text_sha256, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
                 count(*) OVER (PARTITION BY norm) AS group_size FROM norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM keyed
"""
