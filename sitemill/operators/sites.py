"""Site-level extraction from home pages: registry (S3), family (H3),
SEO metadata (H5, all pages), stylesheets (H11) and logos (H12).

Home-page work is grouped by the home page's ``page_id`` (one per site), so
it reuses the token relation's ``page_id`` partitioning instead of
re-shuffling tokens by site (sites can be heavily skewed).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitemill.functions import text as TX
from sitemill.functions import urls as U
from sitemill.operators import domains as D
from sitemill.operators import html as H
from sitemill.operators.frontier import url_key
from sitemill.sources import rules as R

SITE_JSON_SCHEMA = "sites ARRAY<STRUCT<editor_url: STRING>>"


def parse_registry(registry: DataFrame, suffixes: DataFrame) -> DataFrame:
    """S3: ``registry(site, site_url, site_json)`` -> adds editor_url, media_base, domain (by the ``suffixes`` rules)."""
    editor = F.get(F.from_json(F.col("site_json"), SITE_JSON_SCHEMA)["sites"], 0)["editor_url"]
    reg = registry.withColumn("editor_url", F.regexp_replace(editor, "^http:", "https:")).withColumn("media_base", U.media_base_from_editor(F.col("editor_url")))
    return D.with_domain(reg, "site_url", suffixes)


def home_pages(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """The page whose URL is the site's home URL, with the site context.

    URLs are compared by crawl key, so a fragment or a missing last slash makes no difference.
    """
    reg = registry.select("site", "site_url", "domain", "media_base", url_key("site_url").alias("_home"))
    return pages.join(reg, url_key(pages["url"]) == reg["_home"], "inner").drop("_home")


def _marker(kind: str, key: str) -> Column:
    start = F.col("kind").isin("open", "raw")
    if kind == "id":
        return start & F.coalesce(F.col("id") == key, F.lit(False))
    return start & H.has_class(F.col("class"), key)


def family_by_home(home_tok: DataFrame) -> DataFrame:
    """H3: first marker family present on each home page, else X."""
    prio = None
    for fam, p, kind, key in sorted(R.FAMILY_MARKERS, key=lambda r: r[1]):
        prio = (F.when(_marker(kind, key), p) if prio is None else prio.when(_marker(kind, key), p))
    best = home_tok.withColumn("_prio", prio).groupBy("page_id").agg(F.min("_prio").alias("_prio"))
    fam = F.lit(R.UNKNOWN_FAMILY)
    for f, p, _, _ in R.FAMILY_MARKERS:
        fam = F.when(F.col("_prio") == p, f).otherwise(fam)
    return best.select("page_id", fam.alias("family"))


def content_rule(family: Column) -> tuple[Column, Column]:
    """Main-content selector of a family as (kind, key) columns (null for X)."""
    kind, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f, _, k, v in R.FAMILY_MARKERS:
        kind = F.when(family == f, F.lit(k)).otherwise(kind)
        key = F.when(family == f, F.lit(v)).otherwise(key)
    return kind, key


def sites(pages: DataFrame, registry: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``sites(site, site_url, domain, family, content_kind, content_key, media_base, home_page_id)``."""
    reg = parse_registry(registry, suffixes)
    # one home page per site even if the archive holds the home URL twice
    first = home_pages(pages.select("page_id", "url"), reg).groupBy("site").agg(F.min("page_id").alias("page_id"))
    # the archive's HTML is cut down to the home pages before it is dealt out
    homes = H.partition_pages(pages.select("page_id", "html").join(first, "page_id"))
    tok = H.tokens(homes.select("page_id", "html"), partitioned=True)
    fam = family_by_home(tok)
    out = reg.join(homes.select("site", F.col("page_id").alias("home_page_id")), "site", "left").join(
        fam.withColumnRenamed("page_id", "home_page_id"), "home_page_id", "left"
    )
    out = out.withColumn("family", F.coalesce(F.col("family"), F.lit(R.UNKNOWN_FAMILY)))
    kind, key = content_rule(F.col("family"))
    return out.select(
        "site", "site_url", "domain", "family", kind.alias("content_kind"), key.alias("content_key"),
        "media_base", "home_page_id",
    )


# ---------------------------------------------------------------------------
# H5 SEO metadata (every page, whole document)
# ---------------------------------------------------------------------------
def seo_prepare(tok: DataFrame) -> DataFrame:
    """Marks the text token right after each <title> start tag (window keyed by page)."""
    by_pos = W.partitionBy("page_id").orderBy("pos")
    return tok.withColumn("_after_title", (F.lag("kind").over(by_pos) == "open") & (F.lag("tag").over(by_pos) == "title"))


def seo_aggs() -> list[Column]:
    """Per-page aggregates behind H5 (use after ``seo_prepare``, grouped by page_id)."""
    is_meta = (F.col("kind") == "open") & (F.col("tag") == "meta") & F.col("content").isNotNull()

    def first_meta(name: str) -> Column:
        return F.min_by(F.when(is_meta & (F.col("name") == name), F.col("content")),
                        F.when(is_meta & (F.col("name") == name), F.col("pos")))

    title_text = F.min_by(
        F.when(F.col("_after_title") & (F.col("kind") == "text"), TX.decode_references(F.col("raw"))),
        F.when(F.col("_after_title") & (F.col("kind") == "text"), F.col("pos")),
    )
    return [first_meta("title").alias("_mt"), title_text.alias("_tt"),
            first_meta("keywords").alias("_kw"), first_meta("description").alias("_ds")]


def seo_finish(g: DataFrame) -> DataFrame:
    """meta title (else <title> text), truncated keywords and description."""
    kw = F.when(F.length("_kw") > 0, TX.truncate_keywords(F.col("_kw"))).otherwise(F.col("_kw"))
    ds = F.when(F.length("_ds") > 0, TX.truncate_description(F.col("_ds"))).otherwise(F.col("_ds"))
    return g.select("page_id", F.coalesce("_mt", "_tt").alias("meta_title"), kw.alias("meta_keywords"), ds.alias("meta_description"))


def seo(tok: DataFrame) -> DataFrame:
    """H5: meta title (else <title> text), keywords (W2), description (W2) per page."""
    return seo_finish(seo_prepare(tok).groupBy("page_id").agg(*seo_aggs()))


# ---------------------------------------------------------------------------
# H11 stylesheets (home page of each site)
# ---------------------------------------------------------------------------
def stylesheets(home_tok: DataFrame) -> DataFrame:
    """First matching stylesheet per matcher; only sites where every matcher matched.

    ``home_tok`` carries ``site, site_url, family``.  Output:
    ``site, matcher, url, file_name`` (url absolute, name sanitised).
    """
    fams = sorted({f for f, _, _ in R.STYLESHEET_MATCHERS})
    req = F.lit(0)
    arr = F.array().cast("array<struct<idx:int,text:string>>")
    for f in fams:
        items = [F.struct(F.lit(i).alias("idx"), F.lit(t).alias("text")) for ff, i, t in R.STYLESHEET_MATCHERS if ff == f]
        arr = F.when(F.col("family") == f, F.array(*items)).otherwise(arr)
        req = F.when(F.col("family") == f, F.lit(len(items))).otherwise(req)
    links = home_tok.where((F.col("kind") == "open") & (F.col("tag") == "link") & F.col("href").isNotNull())
    m = links.withColumn("_m", F.explode(arr)).where(F.contains(F.col("href"), F.col("_m.text")))
    first = m.groupBy("page_id", "site", "site_url", F.col("_m.idx").alias("matcher")).agg(
        F.min_by("href", "pos").alias("href"), F.first(req).alias("_req")
    )
    w = W.partitionBy("page_id")
    first = first.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == F.col("_req"))
    first = U.with_link_facts(first, "href", "site_url", None, "f")
    return first.select("site", "site_url", "matcher", F.col("f_abs").alias("url")).withColumn(
        "file_name", U.sanitize_filename(U.file_name(F.col("url")))
    )


# ---------------------------------------------------------------------------
# H12 logos (home page of each site)
# ---------------------------------------------------------------------------
def _family_marker(rows, family: Column) -> Column:
    m = F.lit(False)
    for f, kind, key, *_ in rows:
        m = F.when(family == f, _marker(kind, key)).otherwise(m)
    return m


def logos(home_ext: DataFrame) -> DataFrame:
    """Logo facts per site: title, description, logo_src, image_path, file url/name.

    ``home_ext`` = home tokens with extents and ``site, site_url, domain,
    media_base, family``.
    """
    fam = F.col("family")
    root = _family_marker(R.LOGO_ROOTS, fam)
    img_is_root = F.lit(False)
    for f, _, _, is_root in R.LOGO_ROOTS:
        img_is_root = F.when(fam == f, F.lit(is_root)).otherwise(img_is_root)
    t = home_ext.withColumn("_in_root", H.covered_by(root)).withColumn("_root", root)
    cand = F.when(img_is_root, F.col("_root")).otherwise(F.col("_in_root") & (F.col("tag") == "img"))
    cand = cand & F.col("src").isNotNull()
    aggs = [F.min_by(F.when(cand, F.col("src")), F.when(cand, F.col("pos"))).alias("logo_src")]
    for purpose in ("title", "description"):
        rows = [(f, "class", key) for f, p, key in R.LOGO_TEXT if p == purpose]
        col = f"_in_{purpose}"
        t = t.withColumn(col, H.covered_by(_family_marker(rows, fam)))
        ok = F.col(col) & (F.col("kind") == "text") & (F.length(F.trim(F.col("raw"), )) > 0)
        ok = ok & (F.length(F.regexp_replace(F.col("raw"), r"\s+", "")) > 0)
        aggs.append(F.min_by(F.when(ok, TX.decode_references(F.col("raw"))), F.when(ok, F.col("pos"))).alias(purpose))
    g = t.groupBy("page_id", "site", "site_url", "domain", "media_base", "family").agg(*aggs)
    src = U.logo_cdn_rewrite(F.coalesce(F.col("logo_src"), F.lit("")), F.col("site_url"), R.LOGO_CDN)
    g = g.withColumn("logo_src", F.when(F.col("family") == "W", src).otherwise(F.coalesce(F.col("logo_src"), F.lit(""))))
    g = U.with_link_facts(g, "logo_src", "site_url", "domain", "f")
    s = F.col("logo_src")
    is_file = F.col("f_internal") & F.col("f_file")
    name = F.when(is_file, U.sanitize_filename(U.file_name(s))).otherwise(F.lit(""))
    file_url = F.when(is_file, U.with_scheme(F.col("f_abs"), F.col("site_url")))
    return g.select(
        "site", "family",
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        "logo_src",
        F.when(s != "", F.concat(F.lit("/"), F.coalesce(name, F.lit("")))).otherwise(F.lit("")).alias("image_path"),
        file_url.alias("file_url"),
        F.when(is_file, name).alias("file_name"),
    )
