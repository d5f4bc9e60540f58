"""Legacy business documents derived from the ``supplier`` and ``nation`` tables.

One JSON document per (nation, block of ``DOC_BLOCK`` supplier keys) (site
``nation-<key>-<block>``), so no document grows with the table: every supplier
of the block is a location; hours, coordinates and social accounts are derived
from the keys so that every branch of L1-L4 occurs (empty coordinates, no
hours, duplicate days, a half-hour opening, unknown social tokens).
The same derivation is written as SQL in the oracle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.sources.archive import read_table

WEEKDAY_HOURS = "2:08:00:AM:05:00:PM,3:08:00:AM:05:00:PM,4:08:00:AM:05:00:PM,5:08:00:AM:05:00:PM,6:08:00:AM:05:00:PM"
SATURDAY_HOURS = "7:00:30:AM:12:00:PM"
DUPLICATE_MONDAY = "2:09:00:AM:01:00:PM"
DOC_BLOCK = 100


def location_columns(k, name, nation_name):
    """Location fields from a supplier key (Column expressions)."""
    ks = k.cast("string")
    coord = lambda m, d: F.concat((k % m).cast("string"), F.lit("."), F.lpad((k % d).cast("string"), 3, "0"))
    hours = (
        F.when(k % 4 == 0, F.lit(""))
        .when(k % 5 == 0, F.lit(WEEKDAY_HOURS + "," + SATURDAY_HOURS + "," + DUPLICATE_MONDAY))
        .otherwise(F.lit(WEEKDAY_HOURS))
    )
    return [
        name.alias("name"),
        F.concat(F.lit("Street "), ks).alias("address1"),
        F.when(k % 2 == 0, F.concat(F.lit("Suite "), (k % 100).cast("string"))).otherwise(F.lit("")).alias("address2"),
        nation_name.alias("city"),
        F.lit("ST").alias("state"),
        F.lpad((k % 100000).cast("string"), 5, "0").alias("zip"),
        F.lit("US").alias("country"),
        F.concat(F.lit("555-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("phone1"),
        F.lit("").alias("fax"),
        F.concat(F.lit("office"), ks, F.lit("@example.test")).alias("email"),
        F.when(k % 3 == 0, F.lit("")).otherwise(coord(90, 1000)).alias("map_lat"),
        F.when(k % 3 == 0, F.lit("")).otherwise(coord(180, 997)).alias("map_long"),
        hours.alias("hours"),
    ]


def site_docs(spark: SparkSession, sf_dir: str, homes: DataFrame) -> DataFrame:
    """``(site, doc_json)`` for ``homes(site, nation)``: every document of the site's nation, under the site's own key."""
    docs = business_docs(spark, sf_dir).select("nation", "doc_json")
    return homes.join(docs, "nation").select("site", "doc_json")


def business_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(nation, site, doc_json)``: one legacy document per nation and key block."""
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).withColumn("block", F.floor(F.col("s_suppkey") / DOC_BLOCK))
    loc = F.struct(*location_columns(F.col("s_suppkey"), F.col("s_name"), F.col("n_name")))
    locs = j.groupBy("n_nationkey", "n_name", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("k"), loc.alias("l")))), lambda x: x["l"]).alias("locations")
    )
    slug = F.lower(F.col("n_name"))
    social = F.array(
        F.struct(F.lit("facebook_domain").alias("token"), slug.alias("value")),
        F.struct(F.lit("twitter_username").alias("token"), F.concat(slug, F.lit("_dental")).alias("value")),
        F.struct(F.lit("instagram").alias("token"), slug.alias("value")),
        F.struct(F.lit("Yelp_url").alias("token"), F.concat(F.lit("https://yelp.example.test/"), slug).alias("value")),
        F.struct(F.lit("YouTube_url").alias("token"), F.concat(F.lit("https://video.example.test/"), slug).alias("value")),
    )
    doc = F.struct(F.struct(F.col("locations").alias("locations"), social.alias("socialMedia")).alias("data"))
    return locs.select(
        F.col("n_nationkey").alias("nation"),
        F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string"), F.lit("-"), F.col("block").cast("string")).alias("site"),
        F.to_json(doc).alias("doc_json"),
    )
