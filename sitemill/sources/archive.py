"""Scans: the page archive (S1/S2) and the per-page site context."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.functions import urls as U

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of fetched pages, schema fixed (never inferred)."""
    return spark.read.schema(PAGES_SCHEMA).parquet(f"{sf_dir}/pages.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over the cores where its scan has fewer parts than there are cores; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def origin(url) -> F.Column:
    """scheme://host/ of a URL (the home URL of the page's own site)."""
    c = F.col(url) if isinstance(url, str) else url
    return F.concat(U.scheme(c), F.lit("://"), U.netloc(c), F.lit("/"))


def with_page_site(pages: DataFrame) -> DataFrame:
    """Site context computed from each page's own URL (no join, no shuffle).

    Used when no registry is supplied: the site is the host and the home URL
    is the page's origin.
    """
    return (
        pages.withColumn("site", U.host("url"))
        .withColumn("site_url", origin("url"))
        .withColumn("domain", U.registered_domain(F.col("url")))
        .withColumn("media_base", F.concat(origin("url"), F.lit(U.MEDIA_PATH)))
    )
