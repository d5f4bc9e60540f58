r"""Ranked lexical search by the Best Position Algorithm over impact lists.

1. Term counts: one pass over the whole texts gives each document its number of terms and the
   frequencies of the terms that any item asks for; corpus counts N, L and df are aggregated
   from them over all documents.
2. Search: a task takes its documents in blocks. A block's impact lists hold, for each term, its
   documents by falling impact. For each item the lists are read in step from the top (sorted
   access); a document met in one list is looked up in the item's other lists at once (direct
   access), which also marks its positions there as seen. A list's best position is the last one
   that is seen together with all before it. No document unseen so far scores more than the
   weighted impacts at the best positions, a tighter bound than the positions last read give. An
   item is done in a block once that bound is strictly below its 20th score, so that equal scores
   are all met. The 20 best of earlier blocks of the task are kept and stop later blocks sooner.
3. The tasks' best rows are ranked in two steps: by item and group of tasks, then by item.

Items go through in slices of ``SLICE_BYTES`` of text, each with a pass over the term counts, so
what is sent to tasks has a bound whatever the number of items.

Terms are the maximal matches of [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+ with only A-Z
lower-cased. A weight is floor(1000 * ln((2N + 2) / (2 df + 1))); m is 75 + (25 n N) div L; a
document's score sums, over the item's terms with repeats, weight * ((10**9 tf) div (1000 tf + 12 m)).

Defined results: null and empty texts have no terms: such documents are in no list and not in N,
such items have no rows. Equal scores rank by ascending doc_id, null last; rows repeated with one
doc_id rank one after the other. Items repeated with the same id and text count once; different
texts under one item_id are ranked each on its own, in the order of their texts. Empty tables give
an empty result. Texts are read whole, whatever their length. Further columns are never read.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitemill.llm.slices import prepare_workers, slices
from sitemill.session import materialise

TOP = 20
#: Characters of items that go to the tasks at a time.
SLICE_BYTES = 4_000_000
#: A block ends with the batch that brings it to so many postings.
BLOCK_POSTINGS = 1_000_000
#: Positions read from each list before the bound is looked at again; doubled each time up to the second number.
DEPTH, DEEPEST = 32, 4096
#: Groups of tasks in the first of the two ranking steps.
GROUPS = 64
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def count_terms(docs: DataFrame, wanted: dict[bytes, int]) -> DataFrame:
    """(doc_id text, n, t, tf): terms with repeats, and numbers and frequencies of the wanted ones, of each document that has any term."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part["doc_id"], part["text"]):
                    words = terms(text)
                    if words:
                        found = Counter(filter(None.__ne__, map(wanted.get, words)))
                        rows.append((doc_id, len(words), list(found), list(found.values())))
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "n", "t", "tf"])
    prepare_workers(docs)
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(run, "doc_id string, n long, t array<int>, tf array<int>")


class Block:
    """Impact lists of a block of documents."""

    def __init__(self, t: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((doc, -impact, t))
        self.start = np.searchsorted(t[order], np.arange(n_terms + 1))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        # the same postings by (term, doc), with their places in the lists
        self.by_doc = np.lexsort((self.doc, t[order]))
        self.key = t[order][self.by_doc].astype(np.int64) * n_docs + self.doc[self.by_doc]

    def direct(self, term: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(impacts, places in the list) of documents in a term's list; 0 and -1 where it lacks them."""
        a, b = self.start[term], self.start[term + 1]
        keys = self.key[a:b]
        at = np.searchsorted(keys, term * np.int64(self.n_docs) + docs)
        at = np.minimum(at, max(b - a - 1, 0))
        hit = keys[at] == term * np.int64(self.n_docs) + docs if b > a else np.zeros(len(docs), bool)
        place = np.where(hit, self.by_doc[a + at] if b > a else -1, -1)
        return np.where(hit, self.impact[place], 0), np.where(hit, place - a, -1)


def best_positions(block: Block, weights: dict[int, int], kth: int, top: int = TOP) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, positions read) that can be among the ``top``, given that only scores of at least ``kth`` can.

    ``weights`` maps an item's terms to weight times repeats. Every document of the block that is
    among the ``top`` of its scores and scores ``kth`` or more is returned.
    """
    lists = [t for t in weights if block.start[t + 1] > block.start[t] and weights[t] > 0]
    if not lists:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    at = {t: (int(block.start[t]), int(block.start[t + 1])) for t in lists}
    seen = {t: np.zeros(b - a + 1, bool) for t, (a, b) in at.items()}  # one more, never seen
    best = dict.fromkeys(lists, 0)  # number of leading positions that are all seen
    met = np.zeros(block.n_docs, bool)
    docs, scores = [], []
    highest = np.empty(0, np.int64)
    depth, step = 0, DEPTH
    while True:
        read = [block.doc[a + depth:min(a + depth + step, b)] for a, b in at.values()]
        new = np.unique(np.concatenate(read))
        new = new[~met[new]]
        met[new] = True
        if len(new):
            score = np.zeros(len(new), np.int64)
            for t in lists:
                impact, place = block.direct(t, new)
                score += weights[t] * impact
                seen[t][place[place >= 0]] = True
            docs.append(new)
            scores.append(score)
            highest = np.sort(np.concatenate((highest, score)))[-top:]
        depth, step = depth + step, min(2 * step, DEEPEST)
        bound = 0
        for t, (a, b) in at.items():
            best[t] += int(np.argmin(seen[t][best[t]:]))
            # beyond a list that is seen to its end no document gains from it
            bound += weights[t] * int(block.impact[a + best[t] - 1]) if best[t] < b - a else 0
        least = max(kth, int(highest[0]) if len(highest) == top else 0)
        if bound < least or bound == 0:
            break
    docs, scores = np.concatenate(docs), np.concatenate(scores)
    keep = (scores >= least) & (scores > 0)
    return docs[keep], scores[keep], depth


def search_blocks(counts: DataFrame, items: list[dict[int, int]], n_terms: int, n_docs: int, n_words: int) -> DataFrame:
    """(q, doc_id, score, task): each task's best documents for each item, by its number ``q``."""
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, postings = [], 0
        for batch in batches:
            held.append(batch)
            postings += int(batch["t"].map(len).sum())
            if postings >= BLOCK_POSTINGS:
                yield pd.concat(held, ignore_index=True)
                held, postings = [], 0
        if postings:
            yield pd.concat(held, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple[int, float, str | None]]] = [[] for _ in items]
        for rows in blocks(batches):
            sizes = rows["t"].map(len).to_numpy()
            t, tf = (np.concatenate([*rows[c].tolist()]).astype(np.int64) for c in ("t", "tf"))
            m = 75 + (25 * rows["n"].to_numpy() * n_docs) // n_words
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes))
            block = Block(t, np.repeat(np.arange(len(rows)), sizes), impact, n_terms, len(rows))
            ids = rows["doc_id"].tolist()
            for q, weights in enumerate(items):
                kth = -best[q][TOP - 1][0] if len(best[q]) == TOP else 0
                docs, scores, _ = best_positions(block, weights, kth)
                if len(docs):
                    found = [(-s, np.inf if ids[d] is None else int(ids[d]), ids[d]) for d, s in zip(docs.tolist(), scores.tolist())]
                    best[q] = sorted(best[q] + found, key=lambda x: x[:2])[:TOP]
        out = [(q, d, -s) for q, rows in enumerate(best) for s, _, d in rows]
        if out:
            yield pd.DataFrame(out, columns=["q", "doc_id", "score"])
    return (counts.where(F.size("t") > 0).mapInPandas(run, "q int, doc_id string, score long")
            .withColumn("task", F.spark_partition_id()).withColumn("doc_id", F.col("doc_id").cast("long")))


def item_slices(items: DataFrame, size: int) -> Iterator[list]:
    """Lists of (item_id, text) rows, different ones only, with about ``size`` characters at a time."""
    items = materialise(items.select("item_id", F.col("text").cast("string").alias("text")).where("length(text) > 0").distinct(), "items")
    n = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // size)
    for i in range(n):
        yield sorted(items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect(), key=lambda r: (r[0] is None, r))


def search(docs: DataFrame, items: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``TOP`` highest-scoring documents with a score above 0."""
    spark, out = docs.sparkSession, None
    for rows in item_slices(items, slice_bytes):
        words = [Counter(terms(r["text"])) for r in rows]
        wanted = {w: i for i, w in enumerate(sorted(set().union(*words)))}
        counts = materialise(count_terms(docs, wanted), "term-counts")
        n_docs, n_words = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["t"]: r["count"] for r in counts.select(F.explode("t").alias("t")).groupBy("t").count().collect()}
        weigh = {t: int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * n + 1)))) for t, n in df.items()}
        weighted = [{wanted[w]: weigh[wanted[w]] * n for w, n in c.items() if wanted[w] in weigh} for c in words]
        found = search_blocks(counts, weighted, len(wanted), n_docs, n_words)
        for by in (["q", F.pmod("task", F.lit(GROUPS))], ["q"]):
            order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= TOP)
        schema = items.select(F.lit(0).alias("q"), "item_id").schema
        known = F.broadcast(spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], schema))  # of SLICE_BYTES at most
        part = found.join(known, "q").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)


ORACLE = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
item_terms AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM item_terms) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, docs),
impacts AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms))) AS impact FROM tfs JOIN lengths USING (doc_id), totals),
scores AS (SELECT item_id, doc_id, CAST(sum(w * impact) AS BIGINT) AS score FROM item_terms JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
