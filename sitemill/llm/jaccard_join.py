"""Exact Jaccard self-join of shingle sets by set-relation skipping; results are components.

Equal sets are one set. Then

1. Sets that can have no partner go: a set with more than |x| - ceil(t |x|) shingles that no
   other set has shares too few with any. A first round counts a fixed range of the hash space
   (enough for most sets), a second round all shingles of those still there.
2. Index: the remaining sets' shingles in ascending order of frequency; a set is entered in the
   lists of its first |x| - ceil(t |x|) + 1 shingles, each entry with size and position. Two
   linked sets share an entry list, and at the first shingle they share, at positions i and j,
   min(|x| - i, |y| - j) is at least the overlap they need. Lists are in blocks by size class
   and position, and a set visits only the blocks that can hold such an entry.
3. Answers from answers: of each list, the set with the fewest shingles of its own leads. All
   sets of the list are compared with their leader first. Sets linked to one leader have one
   answer, the component; a list all of whose sets have the same answer is done, and else only
   pairs of different answers are compared. No list is expanded into all pairs, and a large
   group of near copies costs one comparison each.
4. Components of the links.

Every comparison is the exact intersection of whole sets. Shingles are compared by 64-bit hash.

Defined results: a null or blank text has the empty set and links with nothing, not even with
another empty one; a null doc_id is an id as any other, larger than all; repeated rows are
reported as often as they occur; an empty table gives an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.llm.exact_dedup import minus, rows_of
from sitemill.llm.graph import components
from sitemill.llm.shingles import set_id, shingle_sets
from sitemill.llm.slices import slices, prepare_workers
from sitemill.session import materialise

#: Ids up to this number go to every task (8 MB of longs); beyond it the semi join is shuffled.
BROADCAST_IDS = 1_000_000


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def sets(docs: DataFrame, k: int, share: float = 1.0) -> DataFrame:
    """(doc_id, sid, n, shingles): set id, size, and the shingles in the lowest ``share`` of the hash space."""
    prepare_workers(docs)
    top = min(int(share * 2**64), 2**64 - 1)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in slices(b):
                found = shingle_sets(part["text"].tolist(), k)
                yield pd.DataFrame({"doc_id": pd.Series(part["doc_id"].tolist(), dtype=object), "sid": [set_id(s) for s in found], "n": [len(s) for s in found],
                                    "shingles": [s[:s.searchsorted(top, "right")].view("int64") for s in found]})

    # ids pass through Python as text: pandas would make a nullable long a double
    texts = _texts(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    return texts.mapInPandas(run, "doc_id string, sid long, n int, shingles array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))


def lone(listed: DataFrame) -> DataFrame:
    """(sid, own): how many of the listed shingles (sid, shingles) no other set lists; 0 is left out."""
    by_shingle = listed.select("sid", F.explode("shingles").alias("t")).groupBy("t").agg(F.min("sid").alias("sid"), F.max("sid").alias("other"))
    return by_shingle.where("sid = other").groupBy("sid").agg(F.count("*").alias("own"))


class Join:
    """Linked when ``100 * intersection >= percent * union``."""

    def __init__(self, percent: int, k: int):
        self.p, self.k = int(percent), k

    def slack(self, n: Column) -> Column:
        """How many shingles of a set of size n a partner may lack."""
        return n - F.ceil(n * self.p / F.lit(100)).cast("int")

    def need(self, n: Column, m: Column) -> Column:
        """The least intersection of linked sets of sizes n and m."""
        return F.ceil((n + m) * self.p / F.lit(100 + self.p)).cast("int")

    def size_class(self, n: Column) -> Column:
        """Partners' classes differ by 1 at most."""
        return F.floor(F.log(n.cast("double")) / -math.log(self.p / 100 - 0.01)).cast("int")

    def partners_possible(self, docs: DataFrame, members: DataFrame) -> DataFrame:
        """Written table (sid, n, shingles) of the sets that the first round leaves, whole."""
        listed = members.where("n > 0")
        own = lone(listed)
        one = listed.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
        left = materialise(one.join(own, "sid", "left").where(F.coalesce("own", F.lit(0)) <= self.slack(F.col("n"))).select("doc_id", "sid"), "left")
        ids = left.select(F.col("doc_id").alias("_id")).distinct()
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        texts = _texts(docs)
        whole = sets(texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"), self.k)
        # repeated doc_ids may bring in other texts: only the sets asked for count
        return materialise(whole.join(left.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "sets")

    def entries(self, whole: DataFrame) -> DataFrame:
        """Written index rows (t, sid, n, pos, own, cls, blk)."""
        rows = whole.select("sid", "n", F.explode("shingles").alias("t"))
        shared = rows.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
        kept = (rows.join(shared, "t").groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("list"))  # one set's shingles
                .withColumn("own", F.col("n") - F.size("list")).where(F.col("own") <= self.slack(F.col("n")))
                .select("sid", "n", "own", F.posexplode(F.expr("slice(list, 1, int(n - own))")).alias("at", "e"))
                .withColumn("pos", F.col("own") + F.col("at")).where(F.col("pos") <= self.slack(F.col("n"))))
        return materialise(kept.select(F.col("e.t").alias("t"), "sid", "n", "pos", "own", self.size_class(F.col("n")).alias("cls"), self.block(F.col("pos")).alias("blk")), "entries")

    @staticmethod
    def block(pos: Column) -> Column:
        """Position block: 0, 1-2, 3-6, 7-14, ..."""
        return F.floor(F.log2(pos + 1)).cast("int")

    def fits(self, x: str, y: str) -> Column:
        """Whether entries x and y of one list can be the first shingle that two linked sets share."""
        n, m, i, j = (F.col(f"{a}.{c}") for c in ("n", "pos") for a in (x, y))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * self.p) & (F.least(n - i, m - j) >= self.need(n, m))

    def linked(self, pairs: DataFrame, whole: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by the exact intersection."""
        y = whole.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("shingles").alias("y"))
        x = whole.select(F.col("sid").alias("a"), "n", F.col("shingles").alias("x"))
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(y, "b").join(x, "a").where(both >= self.need(F.col("n"), F.col("m"))).select("a", "b")

    def links(self, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Written links that connect all linked sets: those with leaders, and those between different answers."""
        e = self.entries(whole)
        leads = (e.groupBy("t").agg(F.min(F.struct("own", "sid", "n", "pos")).alias("l"), F.count("*").alias("c")).where("c > 1").select("t", "l.*"))
        asked = materialise(e.alias("x").join(leads.alias("y"), "t").where((F.col("x.sid") != F.col("y.sid")) & self.fits("x", "y"))
                            .select(F.col("y.sid").alias("a"), F.col("x.sid").alias("b")).distinct(), "asked")
        first = materialise(self.linked(asked, whole), "answers")
        roots = components(first)
        named = e.join(roots.withColumnRenamed("id", "sid"), "sid", "left").withColumn("answer", F.coalesce("root", "sid")).drop("root")
        by_list = (named.groupBy("t", "answer").agg(F.count("*").alias("c")).groupBy("t")
                   .agg(F.count("*").alias("answers"), F.max_by("answer", F.struct("c", "answer")).alias("main")).where("answers > 1").select("t", "main"))
        open_ = materialise(named.join(by_list, "t"), "open")
        # the farthest position that a partner in each class can have: for its largest size that x still reaches
        n, i = F.col("n"), F.col("pos")
        reach = F.floor((n - i) * (100 + self.p) / F.lit(self.p)) - n
        most = F.least(F.floor(n * 100 / F.lit(self.p)), reach)
        probe = (open_.where("answer != main").withColumn("most", most).where(most * 100 >= n * self.p)
                 .withColumn("far", (F.col("most") - self.need(n, F.col("most"))).cast("int")).where("far >= 0")
                 .withColumn("cls", F.explode(F.sequence(F.col("cls") - 1, F.col("cls") + 1)))
                 .withColumn("blk", F.explode(F.sequence(F.lit(0), self.block(F.col("far"))))))
        pairs = (probe.alias("x").join(open_.alias("y"), ["t", "cls", "blk"]).where((F.col("x.answer") != F.col("y.answer")) & self.fits("x", "y"))
                 .select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct())
        done = asked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = materialise(pairs.join(done, ["a", "b"], "left_anti"), "rest")
        return first, materialise(self.linked(rest, whole), "answers")


def set_ids(k: int):
    """A column function text -> the id of its set."""

    @F.pandas_udf("long")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([set_id(s) for part in slices(texts) for s in shingle_sets(part.fillna("").tolist(), k)], dtype="int64")

    return ids


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach)."""
    return component_rows(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component one row of its smallest doc_id, and all empty sets."""
    rows = materialise(component_rows(docs, k, percent), "groups")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    again = materialise(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    left = minus(docs, rows.where(~first).select("doc_id").unionByName(again))
    if again.isEmpty():
        return left
    # an id of several rows doesn't say which of them stays: its set does
    stay = rows.where(first & (F.col("n_shingles") > 0)).groupBy("root").agg(F.min(F.struct("sid", "doc_id")).alias("s"))
    stay = stay.select(F.col("s.doc_id").alias("stay_id"), F.col("s.sid").alias("stay_sid")).unionByName(rows.where("n_shingles = 0").select(F.col("doc_id").alias("stay_id"), F.col("sid").alias("stay_sid")))
    own = rows_of(docs, again)  # held whole, so that its names don't clash
    own = own.select(F.struct(*[own[c] for c in own.columns]).alias("row"), own["doc_id"].cast("long").alias("id"), set_ids(k)(own["text"].cast("string")).alias("sid"))
    own = own.join(stay, own["id"].eqNullSafe(F.col("stay_id")) & (F.col("sid") == F.col("stay_sid")), "left_semi")
    empty = F.col("sid") == set_id(np.empty(0, np.uint64))
    return left.unionByName(own.where(~empty).dropDuplicates(["id", "sid"]).unionByName(own.where(empty)).select("row.*"))


def component_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, sid, and root, a sid that stands for the component."""
    join = Join(percent, k)
    members = materialise(sets(docs, k, min(1.0, 1.9 * (1 - percent / 100))), "members")
    whole = join.partners_possible(docs, members)
    first, second = join.links(whole)
    roots = components(first.unionByName(second)).withColumnRenamed("id", "sid")
    named = members.select("doc_id", "n", "sid").where("n > 0").join(roots, "sid", "left").select("doc_id", "n", "sid", F.coalesce("root", "sid").alias("root"))
    # written, so that the join deals out its rows itself and a large component can be split
    least = materialise(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    empty = members.where("n = 0").select("doc_id", F.lit(0).alias("n_shingles"), F.col("doc_id").alias("component_id"), "sid", F.col("sid").alias("root"))
    return named.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "sid", "root").unionByName(empty)
