"""Registered domains by a relation of public suffix rules.

Rules are those of the public suffix list, one a row: ``com``, ``co.uk``, wildcards (``*.ck``: any
label below ``ck``) and exceptions to wildcards (``!www.ck``). A host is exploded into its label
suffixes, which meet the rules in one equi join; an exception wins over all others, else the
longest rule does; a host that no rule fits has an empty suffix.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.functions import urls as U


def seed_rules(spark: SparkSession) -> DataFrame:
    """The rules used where no list is given."""
    return spark.createDataFrame([(s,) for s in U.PUBLIC_SUFFIXES], "rule string")


def _clean(rules: DataFrame) -> DataFrame:
    """Rules as a list file has them: without comments and blank lines, lower-case, each once."""
    rule = F.lower(F.regexp_extract(F.col("rule"), r"^\s*(\S*)", 1))
    return rules.select(rule.alias("rule")).where((F.length("rule") > 0) & ~F.startswith("rule", F.lit("//"))).distinct()


def registered_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts(host)`` -> ``(host, suffix, domain)``, one row per different host; domain = label before the suffix, '.', suffix.

    Hosts are lower-cased; a last dot doesn't count. Null hosts are left out.
    """
    hosts = hosts.select(F.regexp_replace(F.lower("host"), r"\.$", "").alias("host")).where("host IS NOT NULL").distinct()
    labels = F.split("host", r"\.")
    tail = lambda k: F.array_join(F.slice(F.col("labels"), F.col("n") - k + 1, k), ".")
    tails = (hosts.withColumn("labels", labels).withColumn("n", F.size("labels"))
             .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("tail", tail(F.col("k"))))
    # a suffix of k labels fits a rule as it stands, as an exception, or, without its first label, as a wildcard
    below = F.when(F.col("k") > 1, F.concat(F.lit("*."), tail(F.col("k") - 1)))
    asked = tails.select("host", "labels", "n", F.explode(F.array(
        F.struct("k", F.col("tail").alias("rule"), F.lit(False).alias("exception")),
        F.struct("k", F.concat(F.lit("!"), "tail").alias("rule"), F.lit(True).alias("exception")),
        F.struct("k", below.alias("rule"), F.lit(False).alias("exception")))).alias("a")).select("host", "labels", "n", "a.*")
    fits = asked.where("rule IS NOT NULL").join(_clean(rules), "rule")
    best = fits.groupBy("host").agg(F.max(F.when(F.col("exception"), F.col("k") - 1)).alias("exception"), F.max("k").alias("longest"))
    best = best.select("host", F.coalesce("exception", "longest").alias("k"))
    found = hosts.withColumn("labels", labels).withColumn("n", F.size("labels")).join(best, "host", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    own = F.when(F.col("n") > F.col("k"), F.get("labels", F.col("n") - F.col("k") - 1)).otherwise(F.lit(""))
    return found.select("host", tail(F.col("k")).alias("suffix"), F.concat(own, F.lit("."), tail(F.col("k"))).alias("domain"))


def with_domain(df: DataFrame, url: str, rules: DataFrame, name: str = "domain") -> DataFrame:
    """``df`` with the registered domain of its URLs (scheme optional); the rules are met once per different host."""
    host = U.domain_host(F.col(url))
    found = registered_domains(df.select(host.alias("host")), rules).select(F.col("host").alias("_host"), F.col("domain").alias(name))
    return df.withColumn("_host", F.regexp_replace(host, r"\.$", "")).join(found, "_host", "left").drop("_host")
