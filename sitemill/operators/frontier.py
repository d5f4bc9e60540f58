"""Crawl closure (J7): pages reachable from the start set through link edges.

A driver loop of delta iteration. Edges are de-duplicated, sorted by source and
written once. Each round joins only the newest frontier to them, drops what is
visited, and appends the rest as a folder of its own: nothing that is written
is written again each round. So that a long chain of pages doesn't leave a folder
per hop to be opened, every ``TIER`` folders of one size class are rewritten as
one of the next, which costs each row a logarithmic number of writes in all.

A round's count and the range of its ids come with its write, as observed
metrics; the range goes to the scan of the sorted edges as a pushed filter. The
number of rounds is the graph's depth, not a cap: the loop ends only when the
frontier is empty. Folders are in the cluster's checkpoint directory, so a lost
executor costs its tasks only.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sitemill.session import ensure_checkpoint_dir, materialise

#: Folders of one size class that are rewritten as one of the next.
TIER = 8


def url_key(c):
    """Archive lookup key: the URL without fragment and without one trailing slash."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(col, "#[\\s\\S]*$", ""), "/$", "")


class Visited:
    """The visited pages ``(page_id, round)`` as folders, each in a size class."""

    def __init__(self, spark):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/visited-{uuid.uuid4().hex}"
        self.tiers: list[list[str]] = [[]]
        self.written = 0

    def _write(self, df: DataFrame) -> tuple[str, dict]:
        path, seen = f"{self.root}/{self.written}", Observation()
        self.written += 1
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.min("page_id").alias("low"), F.max("page_id").alias("high")).write.parquet(path)
        return path, seen.get

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("page_id long, round int").parquet(*paths)

    def all(self) -> DataFrame:
        return self._read([p for tier in self.tiers for p in tier])

    def append(self, df: DataFrame) -> tuple[DataFrame, dict]:
        """The written rows, and their number and range of ids."""
        path, facts = self._write(df)
        if facts["n"]:
            self.tiers[0].append(path)
        for k, tier in enumerate(self.tiers):
            if len(tier) == TIER:
                merged, _ = self._write(self._read(tier).coalesce(max(1, self.spark.sparkContext.defaultParallelism // 2) if k else 1))
                self.tiers[k] = []
                if k + 1 == len(self.tiers):
                    self.tiers.append([])
                self.tiers[k + 1].append(merged)
        return self._read([path]), facts


def closure(start: DataFrame, edges: DataFrame) -> DataFrame:
    """``start(page_id)``, ``edges(src, dst)`` -> ``(page_id, round)`` reachable set.

    ``round`` is the number of link hops from the start set (0 for start pages).
    """
    edges = materialise(edges.select("src", "dst").distinct().repartitionByRange("src").sortWithinPartitions("src"), "edges")
    visited = Visited(start.sparkSession)
    frontier, facts = visited.append(start.select(F.col("page_id").cast("long").alias("page_id")).where("page_id IS NOT NULL").distinct().withColumn("round", F.lit(0)))
    r = 0
    while facts["n"]:
        r += 1
        out = edges.where(F.col("src").between(facts["low"], facts["high"]))
        reached = out.join(frontier.select(F.col("page_id").alias("src")), "src").select(F.col("dst").cast("long").alias("page_id")).distinct()
        frontier, facts = visited.append(reached.join(visited.all().select("page_id"), "page_id", "left_anti").withColumn("round", F.lit(r)))
    return visited.all()
