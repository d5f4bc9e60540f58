"""URL map, redirects, link dispositions and page identity."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitemill.functions import text as T
from sitemill.functions import urls as U

# Titles that denote the home page (fixed values).
HOME_TITLES = ["Home", "Welcome"]
# Identity given to the home page (fixed values).
HOME_SLUG, HOME_TITLE, HOME_LAYOUT, PAGE_LAYOUT = "/", "Welcome!", "home", "fullwidth"


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


# ---------------------------------------------------------------------------
# J8 link disposition
# ---------------------------------------------------------------------------
def classify_links(lk: DataFrame) -> DataFrame:
    """First half of J8: everything that needs no map lookup.

    Input: links with ``tag, link, site_url, domain, media_base``.  Adds
    ``stage`` (anchor / article / external / file / page), ``path`` (after the
    trailing-slash cut), ``lookup`` (the map key for pages), ``file_url``,
    ``file_name`` and ``new_value`` for files.
    """
    link = F.col("link")
    path = F.when((F.col("tag") == "a") & F.endswith(link, F.lit("/")), F.left(link, F.length(link) - 1)).otherwise(link)
    lk = U.with_parts(lk.withColumn("path", path), "path", "_p")
    lk = U.with_parts(lk, "site_url", "_b")
    pp, bp = U.Parts.cols("_p"), U.Parts.cols("_b")
    p = F.col("path")
    lk = lk.withColumn("relative", U.is_relative(p, pp))
    rel = F.col("relative")
    stage = (
        F.when(F.startswith(link, F.lit("#")), "anchor")
        .when(U.is_article(link), "article")
        .when(~U.is_internal(p, F.col("domain"), pp), "external")
        .when(U.is_file(p), "file")
        .otherwise("page")
    )
    lk = lk.withColumn("stage", T.settled(stage))
    lk = lk.withColumn(
        "_abs",
        F.when(F.col("stage").isin("file", "page"), T.settled(F.when(rel, U.absolute(F.col("site_url"), p, bp, pp)).otherwise(p))),
    )
    absu = F.col("_abs")
    is_file = F.col("stage") == "file"
    lk = lk.withColumn("file_name", T.settled(F.when(is_file, U.sanitize_filename(U.file_name(absu)))))
    file_url = F.when(rel, U.encode_spaces(absu)).otherwise(U.gallery_source(p))
    out = (
        lk.withColumn("lookup", F.when(F.col("stage") == "page", absu))
        .withColumn("file_url", F.when(is_file, U.with_scheme(file_url, F.col("site_url"))))
        .withColumn("new_value", F.when(is_file, U.media_url(F.col("media_base"), F.col("file_name"))))
    )
    return out.drop(*[c for c in out.columns if c.startswith("_p_") or c.startswith("_b_")], "_abs")


def resolve_links(classified: DataFrame, url_map: DataFrame | None) -> DataFrame:
    """Second half of J8 (J4): look pages up in the URL map, decide the action.

    ``action``: leave (anchor, article, external, absolute unmapped), file,
    mapped, follow.  ``new_value`` is the rewritten attribute value, except for
    ``follow`` whose derived slug comes from the segmentation job (``stem``).
    """
    if url_map is None:
        joined = classified.withColumn("map_slug", F.lit(None).cast("string"))
    else:
        m = url_map.select(F.col("site").alias("_msite"), F.col("legacy_url").alias("_mkey"), F.col("slug").alias("map_slug"))
        joined = classified.join(
            m, (classified["site"] == m["_msite"]) & (classified["lookup"] == m["_mkey"]), "left"
        ).drop("_msite", "_mkey")
    p = F.col("path")
    both_schemes = F.contains(p, F.lit("https:")) & F.contains(p, F.lit("http:"))
    action = (
        F.when(F.col("stage").isin("anchor", "article", "external"), "leave")
        .when(F.col("stage") == "file", "file")
        .when(F.col("map_slug").isNotNull(), "mapped")
        .when(F.col("relative") | both_schemes, "follow")
        .otherwise("leave")
    )
    return (
        joined.withColumn("action", action)
        .withColumn(
            "new_value",
            F.when(F.col("action") == "mapped", F.substring_index(F.col("map_slug"), "/", -1)).otherwise(F.col("new_value")),
        )
        .withColumn("stem", T.settled(F.when(F.col("action") == "follow", T.slugify(T.path_stem(F.col("lookup"))))))
    )


def disposition_counts(resolved: DataFrame) -> DataFrame:
    """Per-page count of links by stage/action (flagship metric)."""
    a, s = F.col("action"), F.col("stage")

    def cnt(cond: Column, name: str) -> Column:
        return F.count(F.when(cond, 1)).alias(name)

    return resolved.groupBy("page_id").agg(
        F.count("*").alias("n_links"),
        cnt(s == "anchor", "n_anchor"),
        cnt(s == "article", "n_article"),
        cnt(s == "external", "n_external"),
        cnt(a == "file", "n_file"),
        cnt(a == "mapped", "n_mapped"),
        cnt(a == "follow", "n_follow"),
        cnt((s == "page") & (a == "leave"), "n_left"),
    )


# ---------------------------------------------------------------------------
# J1 / J2 URL map and J3 redirects
# ---------------------------------------------------------------------------
def map_entries(menu_rows: DataFrame, sites: DataFrame) -> DataFrame:
    """J1 before J2: ``(site, legacy_url, slug, title, first_pos)``, last write wins.

    Skips '#' and external URLs; relative URLs become absolute (keeping the
    slug); absolute files map to their media URL (slug and title alike).
    """
    m = menu_rows.join(sites.select("site", "site_url", "domain", "media_base"), "site")
    m = U.with_link_facts(m.where(F.col("url").isNotNull() & (F.col("url") != "#")), "url", "site_url", "domain", "f")
    u = F.col("url")
    m = m.where(F.col("f_internal"))
    rel = F.col("f_rel")
    abs_file = ~rel & F.col("f_file")
    media = U.media_url(F.col("media_base"), U.sanitize_filename(U.file_name(u)))
    key = U.with_scheme(F.col("f_abs"), F.col("site_url"))
    m = m.select(
        "site", "site_url", "pos", key.alias("legacy_url"),
        F.when(abs_file, media).otherwise(F.col("url_slug")).alias("slug"),
        F.when(abs_file, media).otherwise(F.col("title")).alias("title"),
    )
    return m.groupBy("site", "site_url", "legacy_url").agg(
        F.max_by("slug", "pos").alias("slug"), F.max_by("title", "pos").alias("title"), F.min("pos").alias("first_pos")
    )


def redirect_decision(legacy_url: Column, slug: Column, site_url: Column) -> tuple[Column, Column]:
    """J3's ordered tests -> (decision, from_path).  decision: skip / home / emit."""
    from_path = F.concat(F.lit("/"), F.substring_index(U.url_path(legacy_url), "/", -1))
    article = F.contains(legacy_url, F.lit("articles/")) | F.contains(legacy_url, F.lit("articles_dear_doctor"))
    decision = (
        F.when(U.is_file(legacy_url), "skip")
        .when(from_path == slug, "skip")
        .when(legacy_url == site_url, "skip")
        .when(legacy_url == F.left(site_url, F.length(site_url) - 1), "skip")
        .when(article, "skip")
        .when(F.contains(legacy_url, F.lit("index")), "home")
        .otherwise("emit")
    )
    return decision, from_path


def url_map_and_redirects(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J2 + J3: final map (index entries re-pointed to '/') and menu redirects."""
    decision, from_path = redirect_decision(F.col("legacy_url"), F.col("slug"), F.col("site_url"))
    d = entries.withColumn("_decision", decision).withColumn("_from", from_path)
    final = d.select(
        "site", "legacy_url",
        F.when(F.col("_decision") == "home", F.lit(HOME_SLUG)).otherwise(F.col("slug")).alias("slug"),
        "title",
    )
    redirects = d.where(F.col("_decision") == "emit").select(
        "site", F.col("_from").alias("from_url"), F.col("slug").alias("to_url")
    )
    return final, redirects


# ---------------------------------------------------------------------------
# J6 page identity
# ---------------------------------------------------------------------------
def page_identity(processed: DataFrame, url_map: DataFrame, words: DataFrame | None) -> DataFrame:
    """Slug, title and layout of every processed page, plus its redirect.

    ``processed(page_id, site, site_url, url)``; ``url_map`` after J2;
    ``words(slug, words)`` from the segmentation job for hyphen-free slugs.
    Output: ``page_id, site, url_slug, title, layout, from_url, to_url``
    (from/to null when no redirect is due).
    """
    ru = F.regexp_replace(F.col("url"), "/$", "")
    p = processed.withColumn("_ru", ru)
    m = url_map.select(F.col("site").alias("_ms"), F.col("legacy_url").alias("_mk"), F.col("slug").alias("_mslug"), F.col("title").alias("_mtitle"))
    p = p.join(m, (p["site"] == m["_ms"]) & (p["_ru"] == m["_mk"]), "left").drop("_ms", "_mk")
    stem_slug = T.slugify(T.path_stem(F.col("_ru")))
    p = p.withColumn("_slug0", stem_slug)
    if words is not None:
        wv = words.select(F.col("slug").alias("_slug0"), F.col("words").alias("_words"))
        p = p.join(wv, "_slug0", "left")
    else:
        p = p.withColumn("_words", F.lit(None).cast("array<string>"))
    hyphen = F.contains(F.col("_slug0"), F.lit("-"))
    wds = F.coalesce(F.col("_words"), F.array().cast("array<string>"))
    d_slug = F.when(hyphen, F.concat(F.lit("/"), F.col("_slug0"))).otherwise(F.concat(F.lit("/"), F.array_join(wds, "-")))
    d_title = F.when(hyphen, T.title_case(F.replace(F.col("_slug0"), F.lit("-"), F.lit(" ")))).otherwise(T.title_case(F.array_join(wds, " ")))
    site_url = F.col("site_url")
    is_home = (F.col("_ru") == site_url) | (F.concat(F.col("_ru"), F.lit("/")) == site_url) | F.contains(U.url_path(F.col("_ru")), F.lit("index"))
    kind = F.when(is_home, "home").when(F.col("_mslug").isNotNull(), "mapped").otherwise("derived")
    p = p.withColumn("_kind", kind)
    slug = F.when(F.col("_kind") == "home", F.lit(HOME_SLUG)).when(F.col("_kind") == "mapped", F.col("_mslug")).otherwise(d_slug)
    title = F.when(F.col("_kind") == "home", F.lit(HOME_TITLE)).when(F.col("_kind") == "mapped", F.col("_mtitle")).otherwise(d_title)
    layout = F.when(F.col("_kind") == "home", F.lit(HOME_LAYOUT)).otherwise(F.lit(PAGE_LAYOUT))
    p = p.withColumn("url_slug", slug).withColumn("title", title).withColumn("layout", layout)
    decision, from_path = redirect_decision(F.col("_ru"), F.col("url_slug"), site_url)
    emit = (F.col("_kind") == "derived") & (decision == "emit")
    return p.select(
        "page_id", "site", "url_slug", "title", "layout",
        F.when(emit, from_path).alias("from_url"), F.when(emit, F.col("url_slug")).alias("to_url"),
    )
