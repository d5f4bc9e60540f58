"""G1: each URL is taken in once, also when a later file repeats it."""
import glob
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from sitemill.sources import archive as A
from sitemill.plans.migration import Migration
from sitemill.streaming.intake import follow, intake, write_batch
from conftest import SF_SMALL


def test_duplicates_across_batches_are_dropped(spark):
    src = tempfile.mkdtemp(prefix="sitemill-stream-src-", dir="/tmp")
    pages = A.read_pages(spark, SF_SMALL)
    n = pages.count()
    pages.where(F.col("page_id") < 30).coalesce(1).write.parquet(f"{src}/a")
    # second delivery repeats URLs 20..29 under new ids, plus new pages
    again = pages.where(F.col("page_id") >= 20).withColumn("page_id", F.col("page_id") + 1000)
    again.coalesce(1).write.parquet(f"{src}/b")
    files = [f"{src}/a", f"{src}/b"]
    # stream both part files from one directory, one file per micro-batch
    flat = tempfile.mkdtemp(prefix="sitemill-stream-flat-", dir="/tmp")
    for i, d in enumerate(files):
        for j, f in enumerate(sorted(glob.glob(f"{d}/*.parquet"))):
            shutil.copy(f, f"{flat}/part-{i}-{j}.parquet")
    sink = intake(spark, flat, uuid.uuid4().hex, file_glob="*.parquet", max_files_per_trigger=1)
    out = spark.read.parquet(sink)
    assert out.count() == n
    assert out.select("url").distinct().count() == n
    assert out.select("batch_id").distinct().count() == 2
    # repeated URLs keep the first delivery's page ids
    assert out.where(F.col("page_id") >= 1000).count() == n - 30


def test_a_batch_tried_again_is_there_once(spark):
    sink = tempfile.mkdtemp(prefix="sitemill-stream-sink-", dir="/tmp")
    pages = A.read_pages(spark, SF_SMALL)
    for _ in range(2):
        write_batch(pages.where(F.col("page_id") < 10), 0, sink)
    write_batch(pages.where(F.col("page_id") >= 10), 1, sink)
    out = spark.read.parquet(sink)
    assert out.count() == pages.count() == out.select("page_id").distinct().count()


def test_watermark_bounds_the_seen_pages(spark):
    src = tempfile.mkdtemp(prefix="sitemill-stream-late-", dir="/tmp")
    pages = A.read_pages(spark, SF_SMALL).withColumn("arrived", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    again = pages.withColumn("url", F.concat("url", F.lit("#again")))
    pages.unionByName(again).coalesce(1).write.mode("overwrite").parquet(src)
    out = spark.read.parquet(intake(spark, src, uuid.uuid4().hex, file_glob="*.parquet", arrival=("arrived", "1 hour"), crawl_key=True))
    keys = pages.select(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/$", "").alias("k")).distinct().count()
    assert out.count() == keys


def test_pages_to_follow_are_emitted_once_as_pages_arrive(spark):
    m = Migration.from_fixture(spark, SF_SMALL)
    want = {(r.site, r.lookup) for r in m.dispositions.where("action = 'follow'").select("site", "lookup").collect()}
    src, run, sizes = tempfile.mkdtemp(prefix="sitemill-follow-", dir="/tmp"), uuid.uuid4().hex, []
    pages = m.pages.select("page_id", "url", "html")
    # the last delivery repeats the first one's pages under new ids
    for k, part in enumerate((pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1"), pages.where("page_id % 2 = 0").withColumn("page_id", F.col("page_id") + 100000))):
        part.coalesce(1).write.mode("append").parquet(src)
        out = spark.read.parquet(follow(spark, src, m, run)).collect()
        sizes.append(len(out))
        assert len({(r.site, r.page_url) for r in out}) == len(out)
    assert want and {(r.site, r.page_url) for r in out} == want
    assert 0 < sizes[0] <= sizes[1] == sizes[2] == len(want)


def test_intake_reads_a_table_that_is_a_folder(spark):
    """the pages as one file and as a folder of parts give the same rows."""
    from sitemill.plans.catalog import stream_page_intake

    root = tempfile.mkdtemp(prefix="sitemill-stream-table-", dir="/tmp")
    A.read_pages(spark, SF_SMALL).repartition(3).write.parquet(f"{root}/pages.parquet")
    want = sorted(stream_page_intake(spark, SF_SMALL).collect())
    assert len(want) == 50 and sorted(stream_page_intake(spark, root).collect()) == want
