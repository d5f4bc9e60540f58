"""Payload builders and the outbox sink.

Every request becomes a row ``outbox(site_id, step, seq, method, endpoint, body)``; the
body is ``to_json`` of a struct whose fields are in alphabetical order (the
original sorted its keys) with nulls kept.  ``step`` is the request's place in the order
in which the original sent its kinds, ``seq`` its number within the site.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitemill.session import materialise
from sitemill.sources import rules as R

JSON_OPTS = {"ignoreNullFields": "false"}
OUTBOX_COLUMNS = ["site_id", "method", "endpoint", "body"]
OUTBOX_SCHEMA = "site_id string, step int, seq long, method string, endpoint string, body string"
# The order of requests: files stand before what refers to them, redirects before pages.
STEPS = {"navigation": 1, "files": 2, "stylesheets": 3, "redirects": 4, "logos": 5, "pages": 6, "locations": 7, "hours": 8, "social": 9}
#: Requests of one site that are written by one task.
SITE_BLOCK = 100_000


def _visible() -> Column:
    return F.struct(F.lit("true").alias("desktop"), F.lit("true").alias("mobile"), F.lit("true").alias("tablet"))


def body(**fields: Column) -> Column:
    """JSON body from named columns, keys sorted."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), JSON_OPTS)


def _rows(df: DataFrame, method: str, endpoint: Column, payload: Column) -> DataFrame:
    return df.select(F.col("site").alias("site_id"), F.lit(method).alias("method"), endpoint.alias("endpoint"), payload.alias("body"))


def aliases_of(component: str) -> list[str]:
    return [a for c, a in R.COMPONENT_ALIASES if c == component]


def _explode_aliases(df: DataFrame, component: str) -> DataFrame:
    """Every site gets the component's fixed aliases (literal array, no cross join)."""
    return df.withColumn("alias", F.explode(F.array(*[F.lit(a) for a in aliases_of(component)])))


def navigation_payloads(nested: DataFrame) -> DataFrame:
    """``nested(site, items)``, items as JSON text -> PUT /navigations/{alias}."""
    d = _explode_aliases(nested, "navigation")
    named = F.concat(F.lit('{"items":'), F.col("items"), F.lit(","), F.substring(body(name=F.col("alias")), 2, 1 << 30))
    return _rows(d, "PUT", F.concat(F.lit("/navigations/"), F.col("alias")), named)


def file_payloads(files: DataFrame) -> DataFrame:
    """``files(site, url, file_name)`` -> POST /files/ (url already scheme-prefixed)."""
    return _rows(files, "POST", F.lit("/files/"), body(filename=F.col("file_name"), url=F.col("url")))


def css_payloads(sites_with_css: DataFrame) -> DataFrame:
    """One PUT on the site per site whose stylesheets matched; header tags stay empty."""
    return _rows(sites_with_css.select("site").distinct(), "PUT", F.lit(""), body(headerTags=F.lit("")))


def redirect_payloads(redirects: DataFrame) -> DataFrame:
    """``redirects(site, from_url, to_url)`` -> POST /page_redirects/."""
    return _rows(redirects, "POST", F.lit("/page_redirects/"), body(
        fromUrl=F.col("from_url"), matchType=F.lit("0"), toUrl=F.col("to_url"), type=F.lit("0")))


def page_payloads(pages: DataFrame) -> DataFrame:
    """P5: ``pages(site, title, url_slug, layout, content, meta_*)`` -> POST /pages/."""
    return _rows(pages, "POST", F.lit("/pages/"), body(
        content=F.col("content"), layout=F.col("layout"),
        meta_description=F.col("meta_description"), meta_keywords=F.col("meta_keywords"),
        meta_title=F.col("meta_title"), title=F.col("title"), url=F.col("url_slug")))


def logo_payloads(logos: DataFrame) -> DataFrame:
    """``logos(site, title, description, image_path)`` -> PUT /logos/{alias} x3."""
    d = _explode_aliases(logos, "logo")
    return _rows(d, "PUT", F.concat(F.lit("/logos/"), F.col("alias")), body(
        alt_text=F.lit("Logo"), description=F.col("description"), imagePath=F.col("image_path"),
        moduleVisibility=_visible(), showDescription=F.lit("true"), showImage=F.lit("true"),
        showTitle=F.lit("true"), title=F.col("title")))


def location_component_payloads(sites: DataFrame) -> DataFrame:
    """PUT /locations/{alias} x4 with fixed display flags."""
    d = _explode_aliases(sites.select("site").distinct(), "locations")
    return _rows(d, "PUT", F.concat(F.lit("/locations/"), F.col("alias")), body(
        locations=F.array(F.lit("location1")), moduleVisibility=_visible(),
        showAddress=F.lit("true"), showAddress2=F.lit("true"), showPhone=F.lit("true"),
        showState=F.lit("true"), showZip=F.lit("true")))


def map_component_payloads(sites: DataFrame) -> DataFrame:
    """PUT /maps/{alias} x4 with fixed display settings."""
    d = _explode_aliases(sites.select("site").distinct(), "maps")
    return _rows(d, "PUT", F.concat(F.lit("/maps/"), F.col("alias")), body(
        alwaysShowInfoWindow=F.lit("true"), autoFit=F.lit("true"), height=F.lit("100"),
        hue=F.lit("none"), icon=F.lit("spindle"), iconColor=F.lit("red"),
        locations=F.array(F.lit("location1")), moduleVisibility=_visible(),
        showAddressOnHover=F.lit("false"), showCaption=F.lit("true"), showTitle=F.lit("true"),
        width=F.lit("100"), zoom=F.lit("14"), zoomControl=F.lit("true")))


def location_payloads(locs: DataFrame) -> DataFrame:
    """POST /locations/ per legacy location."""
    cols = ["address", "address2", "city", "country", "email", "fax", "latitude", "longitude", "name", "phone",
            "state", "useCoordinates", "zip"]
    return _rows(locs, "POST", F.lit("/locations/"), body(**{c: F.col(c) for c in cols}))


def hours_payloads(hours: DataFrame) -> DataFrame:
    """POST /hours/ per location with hours."""
    return _rows(hours, "POST", F.lit("/hours/"), body(days=F.col("days"), name=F.col("name")))


def social_payloads(social: DataFrame) -> DataFrame:
    """P10: POST /socialmedia/ per known account."""
    return _rows(social, "POST", F.lit("/socialmedia/"), body(
        iconClass=F.col("iconClass"), label=F.col("label"), url=F.col("url")))


def outbox(frames: dict[str, DataFrame]) -> DataFrame:
    """X2 + A1: one request set, each request once, numbered within its site.

    ``frames`` has the requests of each of ``STEPS``.  All are written once, with
    the digests of their bodies; what is compared, counted and sorted is narrow rows of
    (site, step, endpoint, digest), and bodies only follow the numbers of the rows
    that stay.  Numbers never sort a site in one task: a row's is the count of the
    rows in earlier (step, leading digest byte) cells of its site, of which there are
    a few thousand at most, plus its rank within its cell.
    """
    parts = [f.select(*OUTBOX_COLUMNS).withColumn("step", F.lit(STEPS[kind])) for kind, f in frames.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = materialise(rows.withColumns({"digest": F.unhex(F.sha2("body", 256)), "row": F.monotonically_increasing_id()}), "requests")
    own = ["site_id", "step", "method", "endpoint", "digest"]
    once = materialise(rows.groupBy(*own).agg(F.min("row").alias("row")).withColumn("cell", F.substring("digest", 1, 1)), "request-digests")
    cells = once.groupBy("site_id", "step", "cell").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("site_id").orderBy("step", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("site_id", "step", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("site_id", "step", "cell").orderBy("digest", "method", "endpoint"))
    alike = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("site_id", "step", "cell")]
    numbers = once.withColumn("rank", rank).alias("l").join(cells.alias("r"), alike).select("row", (F.col("before") + F.col("rank")).alias("seq"))
    return rows.join(numbers, "row").select("site_id", "step", "seq", "method", "endpoint", "body")


def _exists(df_or_spark, path: str) -> bool:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name)


def write_outbox(out: DataFrame, path: str, batch: str = "0", fmt: str = "parquet") -> None:
    """A batch of requests, partitioned by site and in order within it, so that each site's requests replay together.

    A large site is shared out in blocks of numbers.  The batch counts once its manifest
    (each site's requests and range of numbers) is there, which is written last;
    a batch that has one is left as it is, and what a failed attempt left is overwritten.
    """
    manifest, data = f"{path}/manifest/batch={batch}", f"{path}/data/batch={batch}"
    if _exists(out, f"{manifest}/_SUCCESS"):
        return
    dealt = out.repartition("site_id", F.floor(F.col("seq") / SITE_BLOCK)).sortWithinPartitions("site_id", "seq")
    dealt.write.mode("overwrite").partitionBy("site_id").format(fmt).save(data)
    written = out.sparkSession.read.schema(OUTBOX_SCHEMA).format(fmt).load(data)
    facts = written.groupBy("site_id").agg(F.count("*").alias("requests"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    facts.write.mode("overwrite").format(fmt).save(manifest)


def read_outbox(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The requests of all batches that are complete."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/batch=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    batches = sorted(f.getPath().getParent().getName() for f in found)
    read = lambda b: spark.read.schema(OUTBOX_SCHEMA).option("basePath", f"{path}/data/{b}").format(fmt).load(f"{path}/data/{b}")
    out = spark.createDataFrame([], OUTBOX_SCHEMA)
    for b in batches:
        out = out.unionByName(read(b))
    return out
