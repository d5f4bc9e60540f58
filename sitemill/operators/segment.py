"""Word segmentation of run-together page names.

T6 learns a Zipf cost per word from the ``documents`` corpus, its letters folded
to ASCII as in slugs:
``cost = ln(rank * ln(N))`` with rank by frequency (ties by word) and N the
vocabulary size.  The global rank never sorts the vocabulary in one
task (see ``word_costs``).

T7 splits every distinct name part with a minimum-cost dynamic programme over
the lattice of its words.  A table of the vocabulary's prefixes (of ``PROBES``
letters) says how long a word with that beginning can get; each start in a part
is probed once per prefix length and grows only while its prefix occurs, so the
substrings that meet the cost table are few.  Edges are grouped by their end;
one fold over the ends keeps costs and back-pointers (tie: shorter last word, as
the original splitter did).  Characters that are not words cost
``UNKNOWN_COST`` each.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitemill.functions.text import fold_letters
from sitemill.sources.archive import spread

WORD_RX = "[a-z]+"
# Runs of ASCII letters and characters beyond ASCII: folding a run never joins it to another.
LETTER_RX = r"[^\x00-@\[-`{-\x7F]+"
BUCKET_CHARS = 3
UNKNOWN_COST = 1.0e4
# Letters of the prefixes that a start is probed with; words shorter than the first are tried anyway.
PROBES = (3, 6, 12)


def word_counts(documents: DataFrame) -> DataFrame:
    """Occurrences of every folded word; letters are folded once per different word, not per occurrence."""
    runs = spread(documents.select("text")).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTER_RX), 0)).alias("run")).groupBy("run").agg(F.count("*").alias("k"))
    words = runs.select("k", F.explode(F.regexp_extract_all(F.lower(fold_letters("run")), F.lit(WORD_RX), 0)).alias("word"))
    return words.groupBy("word").agg(F.sum("k").alias("n"))


def word_costs(documents: DataFrame) -> DataFrame:
    """``(word, n, word_rank, cost)`` for every word of the corpus.

    The global rank (count descending, then word) is assembled from three
    windows, none of which sees more than a provably small table:

    * offset of each count ``n``: running sum over the *distinct counts* (one
      partition; there are at most sqrt(2 * tokens) distinct counts);
    * offset of each three-letter prefix bucket within its count: running sum
      partitioned by ``n`` (at most 18 278 buckets per count);
    * rank within a (count, bucket): ``row_number`` partitioned by both.
    """
    counts = word_counts(documents).withColumn("_bucket", F.left(F.col("word"), F.lit(BUCKET_CHARS)))
    per_n = counts.groupBy("n").agg(F.count("*").alias("_nn"))
    before_n = W.orderBy(F.col("n").desc()).rowsBetween(W.unboundedPreceding, -1)
    per_n = per_n.select(
        "n",
        F.coalesce(F.sum("_nn").over(before_n), F.lit(0)).alias("_off_n"),
        F.sum("_nn").over(W.partitionBy(F.lit(1))).alias("_vocab"),
    )
    sizes = counts.groupBy("n", "_bucket").agg(F.count("*").alias("_size"))
    before_b = W.partitionBy("n").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("n", "_bucket", F.coalesce(F.sum("_size").over(before_b), F.lit(0)).alias("_off_b"))
    ranked = counts.join(sizes, ["n", "_bucket"]).join(per_n, "n")
    within = W.partitionBy("n", "_bucket").orderBy("word")
    ranked = ranked.withColumn(
        "word_rank", (F.col("_off_n") + F.col("_off_b") + F.row_number().over(within)).cast("bigint"))
    return ranked.select(
        "word", "n", "word_rank",
        F.log(F.col("word_rank") * F.log(F.col("_vocab").cast("double"))).alias("cost"),
    )


def prefixes(costs: DataFrame) -> DataFrame:
    """``(prefix, reach)``: the vocabulary's beginnings of ``PROBES`` letters, and the most letters of a word with each."""
    cut = F.explode(F.array(*[F.lit(p) for p in PROBES])).alias("p")
    words = costs.select("word", cut).where(F.length("word") >= F.col("p"))
    return words.groupBy(F.expr("left(word, p)").alias("prefix")).agg(F.max(F.length("word")).alias("reach"))


def candidates(parts: DataFrame, costs: DataFrame) -> DataFrame:
    """``(part, i, j)``: starts and ends (from 1) of the substrings of each part that can be words."""
    starts = parts.select("part", F.explode(F.sequence(F.lit(1), F.length("part"))).alias("i")).withColumn("rest", F.length("part") - F.col("i") + 1)
    probes = starts.select("part", "i", "rest", F.explode(F.array(*[F.lit(p) for p in PROBES])).alias("p")).where("p <= rest")
    probes = probes.withColumn("prefix", F.expr("substring(part, i, p)")).join(prefixes(costs), "prefix")
    # of the longest prefix that occurs; a longer one of the next size would have occurred too
    found = probes.groupBy("part", "i").agg(F.max(F.struct("p", "reach")).alias("f"))
    beyond = F.lit(1 << 30)
    for p, q in zip(PROBES, PROBES[1:]):
        beyond = F.when(F.col("f.p") == p, F.lit(q - 1)).otherwise(beyond)
    grown = starts.join(found, ["part", "i"], "left").withColumn("length", F.least("rest", F.when(F.col("f").isNotNull(), F.least("f.reach", beyond)).otherwise(PROBES[0] - 1)))
    return grown.select("part", "i", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("length") - 1)).alias("j"))


def segment(parts: DataFrame, costs: DataFrame, col: str = "part") -> DataFrame:
    """``parts(part)`` (distinct lower-case letters) -> ``(part, words array<string>)``."""
    p = parts.select(F.col(col).alias("part")).where(F.length("part") > 0).distinct()
    subs = candidates(p, costs).withColumn("sub", F.expr("substring(part, i, j - i + 1)"))
    known = subs.join(costs.select(F.col("word").alias("sub"), "cost"), "sub", "left")
    edges = known.where(F.col("cost").isNotNull() | (F.col("i") == F.col("j"))).select(
        "part", F.col("j").alias("e"), F.struct((F.col("i") - 1).alias("s"), F.coalesce(F.col("cost"), F.lit(UNKNOWN_COST)).alias("c")).alias("edge"))
    ends = edges.groupBy("part", "e").agg(F.collect_list("edge").alias("edges"))
    # every end has an edge, that of its last letter, so the lists are all ends in order
    g = ends.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("e", "edges"))).alias("ends"))
    init = F.array(F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("k")))
    best = F.aggregate(
        F.col("ends"), init,
        lambda acc, end: F.array_append(acc, F.array_min(F.transform(
            end["edges"], lambda e: F.struct((F.element_at(acc, e["s"] + 1)["c"] + e["c"]).alias("c"), (end["e"] - e["s"]).alias("k"))))),
    )
    g = g.withColumn("_best", best)
    back = F.aggregate(
        F.sequence(F.lit(1), F.length("part")),
        F.struct(F.length("part").alias("at"), F.array().cast("array<string>").alias("w")),
        lambda acc, _: F.when(
            acc["at"] > 0,
            F.struct(
                (acc["at"] - F.element_at(F.col("_best"), acc["at"] + 1)["k"]).alias("at"),
                F.concat(
                    F.array(F.substring(
                        F.col("part"),
                        acc["at"] - F.element_at(F.col("_best"), acc["at"] + 1)["k"] + 1,
                        F.element_at(F.col("_best"), acc["at"] + 1)["k"],
                    )),
                    acc["w"],
                ).alias("w"),
            ),
        ).otherwise(acc),
    )
    return g.select("part", back["w"].alias("words"))


def split_slug_parts(df: DataFrame, slug_col: str) -> DataFrame:
    """Explode a hyphen-free slug into its ordered digit / letter runs."""
    from sitemill.functions.text import digit_runs

    return df.select("*", F.posexplode(digit_runs(F.col(slug_col))).alias("_pi", "part"))


def derive_words(slugs: DataFrame, costs: DataFrame, slug_col: str = "slug") -> DataFrame:
    """T4: ``slugs(slug)`` distinct hyphen-free slugs -> ``(slug, words)``.

    Letter runs are segmented; digit runs stay whole.
    """
    s = slugs.select(slug_col).distinct()
    exploded = split_slug_parts(s, slug_col)
    letters = exploded.where(F.col("part").rlike("^[a-z]+$")).select("part").distinct()
    seg = segment(letters, costs)
    j = exploded.join(seg, "part", "left")
    words = F.when(F.col("words").isNull(), F.array(F.col("part"))).otherwise(F.col("words"))
    g = j.groupBy(slug_col).agg(F.array_sort(F.collect_list(F.struct(F.col("_pi").alias("i"), words.alias("w")))).alias("_parts"))
    return g.select(slug_col, F.flatten(F.transform("_parts", lambda x: x["w"])).alias("words"))
