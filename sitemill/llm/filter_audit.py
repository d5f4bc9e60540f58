"""Filter interaction audit: what each of five filters removes, in every order of application.

1. Failures: one pass over the texts gives each document's bits for the filters A to D, and a
   hash of its text.
2. Existential self-join for E: rows whose hash occurs again meet, by a left-semi join on hash,
   exact text and a smaller doc_id, the smallest id of each of those texts. That side is
   aggregated before the join and dealt to blocks of the hash's rows, so a text that a third of
   all rows share neither gathers in one task nor forms pairs.
3. Union of E's ids with the other failures, aggregated to one bit combination per document.
4. Combinations are counted by part (at most 32 rows a part); all orders and steps are read off
   these counts, never off documents.

Defined results: a null text counts as empty, a null part as the empty string. Comparisons with
a null doc_id are unknown: such a row neither fails E nor makes another fail it, and has no
labels. Rows repeated with the same doc_id and text are counted each, and none of them fails E
for another. Of repeated label rows for one doc_id the larger value counts. Parts are those that
occur, so an empty table gives an empty result. Texts are judged whole, whatever their length.
Further columns of either table are never read, whatever their names.
"""
from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemill.session import materialise

FILTERS = "ABCDE"
#: Rows of one hash that meet one copy of each of the hash's texts.
BLOCK = 1024
#: Hashes (16 bytes each with their count) up to this number go to every task: 16 MB; beyond it the join is shuffled.
BROADCAST_KEYS = 1_000_000


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def judged(docs: DataFrame, key=F.xxhash64) -> DataFrame:
    """(doc_id, part, key, n_bytes, bits): the failures A to D of each row, as bits 1, 2, 4 and 8."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), _text().alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    n_words, capitals = F.size("words"), F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    failed = [n_words < 100, 100 * F.size(F.array_distinct("words")) < 80 * n_words, 100 * capitals > 10 * F.length("text"), F.rlike("text", F.lit(r"[#$%&*|]"))]
    bits = sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    return rows.select("doc_id", "part", key(F.col("text")).alias("key"), F.octet_length("text").alias("n_bytes"), bits.alias("bits"))


def repeated(docs: DataFrame, rows: DataFrame, key=F.xxhash64) -> DataFrame:
    """(doc_id, part, key, n_bytes): rows whose exact text a smaller doc_id has too."""
    again = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    again = materialise(again.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "audit-keys")
    few = again.count() <= BROADCAST_KEYS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), _text().alias("text"))
    texts = texts.withColumn("key", key(F.col("text"))).join(F.broadcast(again) if few else again, "key")
    texts = materialise(texts, "audit-texts")
    first = texts.groupBy("key", "text").agg(F.min("doc_id").alias("first_id"), F.max("blocks").alias("blocks"))
    first = first.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).alias("l")
    smaller = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "block", "text")] + [F.col("r.first_id") < F.col("l.doc_id")]
    return dealt.join(first.alias("r"), smaller, "left_semi").select("doc_id", "part", "key", F.octet_length("text").alias("n_bytes"))


def combinations(docs: DataFrame, labels: DataFrame, key=F.xxhash64) -> DataFrame:
    """(part, bits, n, good, toxic): documents, and labelled ones, by part and combination of failures."""
    rows = materialise(judged(docs, key), "audit-rows")
    own = [*rows.columns[:-1]]
    failures = (rows.withColumn("n", F.lit(1))
                .unionByName(repeated(docs, rows, key).distinct().withColumns({"bits": F.lit(16), "n": F.lit(0)})))
    rows = failures.groupBy(*own).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = rows.join(known, "doc_id", "left")
    of = lambda label: F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0))
    return rows.groupBy("part", "bits").agg(F.sum("n").alias("n"), of("quality").alias("good"), of("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, key=F.xxhash64) -> DataFrame:
    """One row per part, order of the filters and step; see the module for the counts' meaning."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)
    steps = (combinations(docs, labels, key).withColumn("filter_order", F.explode(F.lit(orders)))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
             .withColumn("filter", F.expr("substring(filter_order, step, 1)")))
    before = F.aggregate(F.split(F.expr("left(filter_order, step - 1)"), ""), F.lit(0), lambda mask, letter: F.when(letter == "", mask).otherwise(mask.bitwiseOR(bit(letter))))
    steps = steps.withColumns({"own": F.col("bits").bitwiseAND(bit(F.col("filter"))) != 0, "gone": F.col("bits").bitwiseAND(before) != 0})
    removed = F.col("own") & ~F.col("gone")
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(
        count(~F.col("own") & ~F.col("gone")).alias("kept"), count(removed).alias("removed"), count(F.col("own") & F.col("gone")).alias("redundant"),
        count(F.col("own") & (F.bit_count("bits") == 1)).alias("unique_fails"), count(removed, "good").alias("good_lost"), count(removed, "toxic").alias("toxic_lost"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter")).cast("long")
    return out.withColumn("shapley", shapley).drop("filter")


ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals FROM texts),
fails AS (
  SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * capitals > 10 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 16 ELSE 0 END AS bits
  FROM worded),
known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, bits, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
          FROM fails LEFT JOIN known USING (doc_id) GROUP BY part, bits),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM letters a, letters b, letters c, letters d, letters e
           WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bit, (SELECT coalesce(sum(p.bit), 0) FROM letters p WHERE strpos(filter_order, p.letter) < step) AS before
          FROM orders, range(1, 6) r(step), letters WHERE strpos(filter_order, letter) = step),
counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
         coalesce(sum(n) FILTER (bits & bit = 0 AND bits & before = 0), 0) AS kept, coalesce(sum(n) FILTER (bits & bit <> 0 AND bits & before = 0), 0) AS removed,
         coalesce(sum(n) FILTER (bits & bit <> 0 AND bits & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (bits = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (bits & bit <> 0 AND bits & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (bits & bit <> 0 AND bits & before = 0), 0) AS toxic_lost
  FROM (SELECT part, bits, n, good, toxic, filter_order, step, bit, CAST(before AS INTEGER) AS before FROM cells, steps) GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
