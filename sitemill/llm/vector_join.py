"""Cosine near duplicates by an epsilon grid order join.

1. Vectors of a label that are equal to the bit are one class; only its first vector is joined.
2. Principal axes from the second moments of all usable vectors (one row per task, d * d numbers).
   Unit vectors within cosine c of each other lie within eps = sqrt(2 - 2 c).
3. Epsilon grid order: vectors are sorted by label and by the grid cells, of width eps, of their
   leading principal coordinates; the sequence is cut into blocks, each with the bounding box of
   its coordinates. Blocks of a label whose boxes are further apart than eps are skipped.
4. Each pair of blocks that is left is joined by recursion: two intervals whose boxes are further
   apart than eps are skipped, long ones are halved, short ones compared by their dot products in
   double precision. A task sends, for each vector, its number of links and, as links connect,
   only a spanning forest of them; a group of n near copies leaves as 2 n rows.
5. Components of the forests.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, or
whose label is null, links with nothing; vectors of different lengths don't link; a null vec_id
links as any other and is larger than all; repeated rows are different vectors with equal id.
"""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitemill.llm.graph import components
from sitemill.llm.slices import prepare_workers
from sitemill.session import materialise

#: Vectors of a block, and of an interval that is compared without further halving.
BLOCK, LEAF = 1024, 64
#: Leading principal coordinates that the grid and the boxes use.
AXES = 8


def _vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, usable): whether a vector can link."""
    v = F.col("v")
    usable = (F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
            .withColumn("usable", F.coalesce(usable, F.lit(False))))


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(classes: DataFrame, dims: int, axes: int) -> np.ndarray:
    """The leading principal axes (dims, axes) of the classes' unit vectors of length ``dims``."""

    def moments(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, np.zeros(dims), np.zeros((dims, dims))
        for b in batches:
            if len(b):
                x = _unit(b["v"].tolist())
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        yield pd.DataFrame({"at": np.arange(1 + dims + dims * dims), "x": np.r_[n, s, ss.ravel()]})

    got = classes.where(F.size("v") == dims).select("v").mapInPandas(moments, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    m = got.sort_values("at")["x"].to_numpy()
    n, s, ss = max(m[0], 1.0), m[1:1 + dims], m[1 + dims:].reshape(dims, dims)
    return np.linalg.eigh(ss / n - np.outer(s / n, s / n))[1][:, ::-1][:, :axes]


def join_blocks(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, least: float, eps: float, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(i, j, links) for intervals of x and y that may hold links: links[a, b] tells whether x[i + a] and y[j + b] link.

    ``same``: x and y are one block; each pair is met once.
    """
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, k, j, m = todo.pop()
        gap = np.maximum(0, np.maximum(px[i:k].min(0) - py[j:m].max(0), py[j:m].min(0) - px[i:k].max(0)))
        if gap @ gap > eps * eps:
            continue
        if same and i == j and k - i > LEAF:
            h = (i + k) // 2
            todo += [(i, h, i, h), (i, h, h, k), (h, k, h, k)]
        elif k - i > LEAF:
            todo += [(i, (i + k) // 2, j, m), ((i + k) // 2, k, j, m)]
        elif m - j > LEAF:
            todo += [(i, k, j, (j + m) // 2), (i, k, (j + m) // 2, m)]
        else:
            found = x[i:k] @ y[j:m].T >= least
            if same and i == j:
                found = np.triu(found, 1)
            if found.any():
                yield i, j, found


def forest(edges: Iterable[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among 0..n-1."""
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    out = []
    for a, b in edges:
        a_, b_ = find(a), find(b)
        if a_ != b_:
            root[max(a_, b_)] = min(a_, b_)
            out.append((a, b))
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.98, block: int = BLOCK, axes: int = AXES) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    prepare_workers(vectors)
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    rows = _vectors(vectors).where("usable").withColumn("class", F.sha2(F.to_json(F.struct("label", "v")), 256))
    members = materialise(rows.select("vec_id", "class"), "members")
    classes = rows.groupBy("class").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialise(classes.withColumn("d", F.size("v")), "classes")
    out = [_joined(classes.where(F.col("d") == r["d"]), r["d"], least, eps, block, axes) for r in classes.select("d").distinct().collect()]  # vector lengths in use
    spark = vectors.sparkSession
    counts, links = spark.createDataFrame([], "class string, n_links long"), spark.createDataFrame([], "a string, b string")
    for c, l in out:
        counts, links = counts.unionByName(c), links.unionByName(l)
    roots = components(links)
    summed = counts.groupBy("class").agg(F.sum("n_links").alias("n_links"))
    named = (classes.select("class", "id", "n").join(summed, "class", "left").join(roots.select(F.col("id").alias("class"), "root"), "class", "left")
             .withColumn("root", F.coalesce("root", "class")).withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("n") - 1))
    # written, so that the join deals out its rows itself and a large component can be split
    low = materialise(named.groupBy("root").agg(F.min("id").alias("component_id")), "low")
    answer = materialise(named.join(low, "root").select("class", "n_links", "component_id"), "answers")
    linked = members.join(answer, "class").select("vec_id", "n_links", "component_id")
    alone = _vectors(vectors).where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _joined(classes: DataFrame, dims: int, least: float, eps: float, block: int, axes: int) -> tuple[DataFrame, DataFrame]:
    """(class, n_links) parts and (a, b) spanning links among classes of one vector length."""
    axes = min(axes, dims)
    basis = principal_axes(classes, dims, axes)

    def project(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                u = _unit(b.pop("v").tolist())
                p = u @ basis
                b = b.astype({"class": object, "label": object})
                yield b.assign(u=[r.tobytes() for r in u], p=[r.tolist() for r in p], cells=[r.tolist() for r in np.floor(p / eps).astype(int)])

    placed = classes.select("class", "n", "label", "v").mapInPandas(project, "class string, n long, label string, u binary, p array<double>, cells array<int>")
    # sequence numbers of the epsilon grid order, without sorting a label in one task: range partitions, then counts before each
    order = materialise(placed.repartitionByRange("label", "cells", "class").sortWithinPartitions("label", "cells", "class").withColumn("part", F.spark_partition_id()), "order")
    sizes = order.groupBy("part", "label").agg(F.count("*").alias("c"))
    before = sizes.select("part", "label", F.coalesce(F.sum("c").over(Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("part", "label").orderBy("cells", "class")) - 1
    blocked = order.withColumn("local", local).join(before, ["part", "label"]).withColumn("block", F.floor((F.col("before") + F.col("local")) / block).cast("long"))
    members = materialise(blocked.groupBy("label", "block").agg(F.sort_array(F.collect_list(F.struct("cells", "class", "n", "u"))).alias("rows"),  # `block` rows
                          *[F.min(F.col("p")[a]).alias(f"lo{a}") for a in range(axes)], *[F.max(F.col("p")[a]).alias(f"hi{a}") for a in range(axes)]), "blocks")
    boxes = members.select("label", "block", *[c for a in range(axes) for c in (f"lo{a}", f"hi{a}")])
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"x.lo{a}") - F.col(f"y.hi{a}"), F.col(f"y.lo{a}") - F.col(f"x.hi{a}")), 2) for a in range(axes)), F.lit(0.0))
    pairs = boxes.alias("x").join(boxes.alias("y"), "label").where((F.col("x.block") <= F.col("y.block")) & (gap <= eps * eps)).select("label", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    left = members.select("label", F.col("block").alias("i"), F.col("rows").alias("x"))
    right = members.select("label", F.col("block").alias("j"), F.col("rows").alias("y"))
    # pairs are spread over tasks by both blocks
    work = pairs.join(left, ["label", "i"]).join(right, ["label", "j"]).select("i", "j", "label", "x.class", "x.n", "x.u", F.col("y.class").alias("class2"), F.col("y.n").alias("n2"), F.col("y.u").alias("u2"))

    def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j, xc, xn, xu, yc, yn, yu in zip(b["i"], b["j"], b["class"], b["n"], b["u"], b["class2"], b["n2"], b["u2"]):
                x, y = (np.frombuffer(b"".join(u), np.float64).reshape(-1, dims) for u in (xu, yu))
                xn, yn, same = np.asarray(xn, np.int64), np.asarray(yn, np.int64), i == j
                to_x, to_y, edges = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
                shift = 0 if same else len(x)
                for a, c, found in join_blocks(x, y, x @ basis, y @ basis, least, eps, same):
                    to_x[a:a + len(found)] += found @ yn[c:c + found.shape[1]]
                    to_y[c:c + found.shape[1]] += xn[a:a + len(found)] @ found
                    r, s = np.nonzero(found)
                    edges += forest(zip((r + a).tolist(), (s + c + shift).tolist()), len(x) + len(y))
                names = list(xc) if same else [*xc, *yc]
                tree = forest(edges, len(names))
                totals = to_x + to_y if same else np.r_[to_x, to_y]
                at = np.flatnonzero(totals)
                rows = [(names[k], int(totals[k]), None, None) for k in at.tolist()] + [(None, None, names[k], names[m]) for k, m in tree]
                yield pd.DataFrame(rows, columns=["class", "n_links", "a", "b"], dtype=object)

    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = materialise(work.repartition(tasks, "label", "i", "j").mapInPandas(compare, "class string, n_links long, a string, b string"), "compared")
    return got.where("class IS NOT NULL").select("class", "n_links"), got.where("a IS NOT NULL").select("a", "b")
