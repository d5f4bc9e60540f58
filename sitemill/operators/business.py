"""Legacy business data: locations, weekly hours, social accounts.

The legacy document is JSON ``{"data": {"locations": [...], "socialMedia": [...]}}``
parsed with an explicit schema (never inferred), one document per site.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.sources import rules as R

LOCATION_FIELDS = ["name", "address1", "address2", "city", "state", "zip", "country", "phone1", "fax", "email",
                   "map_lat", "map_long", "hours"]
BUSINESS_SCHEMA = (
    "data STRUCT<locations: ARRAY<STRUCT<" + ", ".join(f"{f}: STRING" for f in LOCATION_FIELDS) + ">>, "
    "socialMedia: ARRAY<STRUCT<token: STRING, value: STRING>>>"
)
HOURS_NAME_CHARS = 40
HOURS_SUFFIX = " Hours"


def parse_docs(docs: DataFrame) -> DataFrame:
    """``docs(site, doc_json)`` -> ``(site, data)`` with the fixed schema."""
    return docs.select("site", F.from_json(F.col("doc_json"), BUSINESS_SCHEMA)["data"].alias("data"))


def locations(parsed: DataFrame) -> DataFrame:
    """L1 + L2: one row per location with renamed fields and coordinates."""
    loc = parsed.select("site", F.posexplode("data.locations").alias("loc_idx", "l"))
    lat, lng = F.col("l.map_lat"), F.col("l.map_long")
    present = F.coalesce(F.length(lat) > 0, F.lit(False)) & F.coalesce(F.length(lng) > 0, F.lit(False))
    return loc.select(
        "site", "loc_idx",
        F.col("l.name").alias("name"), F.col("l.address1").alias("address"), F.col("l.address2").alias("address2"),
        F.col("l.city").alias("city"), F.col("l.state").alias("state"), F.col("l.zip").alias("zip"),
        F.col("l.country").alias("country"), F.col("l.phone1").alias("phone"), F.col("l.fax").alias("fax"),
        F.col("l.email").alias("email"),
        F.when(present, "true").otherwise("false").alias("useCoordinates"),
        F.when(lat != "", lat.try_cast("double")).alias("latitude"),
        F.when(lng != "", lng.try_cast("double")).alias("longitude"),
    )


def day_name_expr(num):
    expr = F.lit(None).cast("string")
    for n, name in R.DAY_NAMES:
        expr = F.when(num == n, F.lit(name)).otherwise(expr)
    return expr


def hours_days(parsed: DataFrame) -> DataFrame:
    """L3 flat form: one row per (site, location, day), last duplicate day wins."""
    loc = parsed.select("site", F.posexplode("data.locations").alias("loc_idx", "l"))
    loc = loc.where(F.length(F.col("l.hours")) > 0)
    d = loc.select("site", "loc_idx", F.col("l.name").alias("loc_name"),
                   F.posexplode(F.split(F.col("l.hours"), ",")).alias("entry_idx", "entry"))
    parts = F.split(F.col("entry"), ":")
    g = lambda i: F.get(parts, i)
    d = d.select(
        "site", "loc_idx", "loc_name", "entry_idx",
        day_name_expr(g(0)).alias("day"),
        F.concat(F.regexp_replace(g(1), "^0+", ""), F.lit(":"), g(2), F.lit(" "), g(3)).alias("time1_open"),
        F.concat(F.regexp_replace(g(4), "^0+", ""), F.lit(":"), g(5), F.lit(" "), g(6)).alias("time1_close"),
    ).where(F.col("day").isNotNull())
    last = d.groupBy("site", "loc_idx", "loc_name", "day").agg(
        F.max_by(F.struct("time1_open", "time1_close"), "entry_idx").alias("t")
    )
    return last.select(
        "site", "loc_idx", "loc_name", "day",
        F.initcap("day").alias("day_name"), F.col("t.time1_open").alias("time1_open"), F.col("t.time1_close").alias("time1_close"),
    )


def hours_sets(days: DataFrame) -> DataFrame:
    """L3 payload form: ``(site, loc_idx, name, days MAP<day, struct>)``, keys sorted."""
    entry = F.struct(
        F.col("day").alias("key"),
        F.struct(
            F.col("day_name").alias("day_name"), F.lit("true").alias("open"),
            F.col("time1_close").alias("time1_close"), F.col("time1_open").alias("time1_open"),
            F.lit("").alias("time2_close"), F.lit("").alias("time2_open"),
            F.lit("").alias("time3_close"), F.lit("").alias("time3_open"),
        ).alias("value"),
    )
    g = days.groupBy("site", "loc_idx", "loc_name").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return g.select(
        "site", "loc_idx",
        F.concat(F.left(F.col("loc_name"), F.lit(HOURS_NAME_CHARS)), F.lit(HOURS_SUFFIX)).alias("name"),
        F.map_from_entries("_e").alias("days"),
    )


def social(parsed: DataFrame) -> DataFrame:
    """L4: known social tokens -> (url, label, icon); others dropped.

    The five-row dimension is a literal CASE chain rather than a join.
    """
    s = parsed.select("site", F.posexplode("data.socialMedia").alias("sm_idx", "s"))
    tok, val = F.col("s.token"), F.col("s.value")
    url = label = icon = F.lit(None).cast("string")
    for t, prefix, lab, ic in R.SOCIAL_MEDIA:
        url = F.when(tok == t, F.concat(F.lit(prefix), val)).otherwise(url)
        label = F.when(tok == t, F.lit(lab)).otherwise(label)
        icon = F.when(tok == t, F.lit(ic)).otherwise(icon)
    return s.select("site", "sm_idx", url.alias("url"), label.alias("label"), icon.alias("iconClass")).where(F.col("label").isNotNull())
