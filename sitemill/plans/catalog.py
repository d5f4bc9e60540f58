"""Registered queries: one Spark plan per operator group, each with a DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> str``.
Every query reads the whole given tables (or relations Spark derives from
them); nothing is sampled, capped or filtered by id.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.operators import html as H
from sitemill.operators import mapping as M
from sitemill.plans import sqlfrag as S
from sitemill.session import materialise
from sitemill.sources import archive as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------------------
# Flagship: link disposition counts per page
# ---------------------------------------------------------------------------
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = A.with_page_site(A.spread(A.read_pages(spark, sf_dir)))
    tok = H.tokens(pages, keep=["site", "site_url", "domain", "media_base"], partitioned=True)
    return H.links(tok)


_TOK_CTE = f"""
tok AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, {S.TOKEN_RX})) AS raw FROM pages
),
el AS (
  SELECT page_id, url, raw, {S.tag_name('raw')} AS tag, {S.kind('raw')} AS kind FROM tok
)"""

_LINKS_CTE = f"""{_TOK_CTE},
lk0 AS (
  SELECT page_id, url, tag, {S.attribute('raw', 'href')} AS href, {S.attribute('raw', 'src')} AS src
  FROM el WHERE kind = 'open' AND tag IN ('a', 'img')
),
lk AS (
  SELECT page_id, url, tag, CASE WHEN tag = 'a' THEN href ELSE src END AS link FROM lk0 WHERE NOT {S.is_denied('href')}
  UNION ALL
  SELECT page_id, url, tag, CASE WHEN tag = 'a' THEN href ELSE src END AS link FROM lk0 WHERE NOT {S.is_denied('src')}
),
lk1 AS (
  SELECT page_id, url, tag, link, {S.registered_domain('url')} AS domain,
         CASE WHEN tag = 'a' AND ends_with(link, '/') THEN left(link, length(link) - 1) ELSE link END AS path
  FROM lk WHERE link IS NOT NULL
),
st AS (
  SELECT *, CASE WHEN starts_with(link, '#') THEN 'anchor'
                 WHEN {S.is_article('link')} THEN 'article'
                 WHEN NOT {S.is_internal('path', 'domain')} THEN 'external'
                 WHEN {S.is_file('path')} THEN 'file' ELSE 'page' END AS stage,
            {S.is_relative('path')} AS relative
  FROM lk1
)"""

ORACLE_LINK_COUNTS = f"""
WITH {_LINKS_CTE}
SELECT page_id,
       count(*) AS n_links,
       count(CASE WHEN stage = 'anchor' THEN 1 END) AS n_anchor,
       count(CASE WHEN stage = 'article' THEN 1 END) AS n_article,
       count(CASE WHEN stage = 'external' THEN 1 END) AS n_external,
       count(CASE WHEN stage = 'file' THEN 1 END) AS n_file,
       CAST(0 AS BIGINT) AS n_mapped,
       count(CASE WHEN stage = 'page' AND (relative OR (contains(path, 'https:') AND contains(path, 'http:'))) THEN 1 END) AS n_follow,
       count(CASE WHEN stage = 'page' AND NOT (relative OR (contains(path, 'https:') AND contains(path, 'http:'))) THEN 1 END) AS n_left
FROM st GROUP BY page_id
"""


@register("link_disposition_counts", ORACLE_LINK_COUNTS)
def link_disposition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = M.resolve_links(M.classify_links(page_links(spark, sf_dir)), None)
    return M.disposition_counts(resolved)


# ---------------------------------------------------------------------------
# Everything below runs on the decorated archive (FIXTURES.md section 2) or on
# relations Spark derives from the given tables.
# ---------------------------------------------------------------------------
from sitemill.functions import text as TX  # noqa: E402
from sitemill.functions import urls as U  # noqa: E402
from sitemill.operators import business as B  # noqa: E402
from sitemill.operators import domains as D  # noqa: E402
from sitemill.operators import menus as MN  # noqa: E402
from sitemill.operators import sites as ST  # noqa: E402
from sitemill.operators import segment as SG  # noqa: E402
from sitemill.plans import oracles as OR  # noqa: E402
from sitemill.plans import outbox as O  # noqa: E402
from sitemill.plans.migration import Migration  # noqa: E402
from sitemill.sources import fixtures as FX  # noqa: E402
from sitemill.sources import legacy as LG  # noqa: E402


def _mig(spark: SparkSession, sf_dir: str) -> Migration:
    return Migration.from_fixture(spark, sf_dir)


@register("token_relation", OR.TOKEN_RELATION)
def token_relation(spark, sf_dir):
    """H1: every token of every page with its kind, tag and attributes."""
    t = H.tokens(A.spread(A.read_pages(spark, sf_dir)), partitioned=True)
    return t.select("page_id", "pos", "kind", "tag", "raw", "id", "class", "href", "src", "name", "content", "rel")


@register("element_extents", OR.ELEMENT_EXTENTS)
def element_extents(spark, sf_dir):
    """H2: start/end position and per-tag nesting level of every element."""
    e = H.with_extents(H.tokens(A.read_pages(spark, sf_dir)))
    e = e.where((F.col("kind") == "open") & ~F.col("tag").isin(H.VOID_TAGS))
    return e.select("page_id", "tag", F.col("pos").alias("start_pos"), "end_pos", "level")


def _archive(spark, sf_dir) -> DataFrame:
    return materialise(FX.decorated_pages(spark, sf_dir), "archive")


def _deco_links(spark, sf_dir) -> DataFrame:
    deco = _archive(spark, sf_dir)
    pages = A.with_page_site(deco.select("page_id", "url", "html"))
    tok = H.tokens(pages, keep=["site_url", "domain"])
    both = tok.where((F.col("kind") == "open") & (F.col("tag").isin("a", "img", "link")))
    return both.select("site_url", "domain", F.explode(F.array("href", "src")).alias("link")).where(F.col("link").isNotNull()).distinct()


@register("url_rules", OR.URL_RULES)
def url_rules(spark, sf_dir):
    """U1, U3-U17 on every distinct (site, link) of the decorated archive."""
    d = U.with_link_facts(_deco_links(spark, sf_dir), "link", "site_url", "domain", "f")
    link = F.col("link")
    return d.select(
        "site_url", "link",
        U.scheme(link).alias("scheme"), U.netloc(link).alias("netloc"), U.url_path(link).alias("path"),
        U.url_query(link).alias("query"), U.url_fragment(link).alias("fragment"),
        F.col("f_rel").alias("is_relative"), F.col("f_internal").alias("is_internal"), F.col("f_file").alias("is_file"),
        U.file_name(link).alias("file_name"), U.sanitize_filename(U.file_name(link)).alias("sanitized"),
        F.col("f_abs").alias("absolute"), U.with_scheme(link, F.col("site_url")).alias("with_scheme"),
        U.is_denied(link).alias("denied"), U.is_library(link).alias("library"), U.is_article(link).alias("article"),
        U.cut_trailing_slash(link).alias("no_slash"), U.encode_spaces(link).alias("encoded"),
        U.gallery_source(link).alias("gallery"), U.logo_cdn_rewrite(link, F.col("site_url")).alias("cdn_logo"),
    )


@register("registered_domain", OR.REGISTERED_DOMAIN)
def registered_domain(spark, sf_dir):
    """U2 on every page URL, every document source, their hosts, and the hosts moved below other suffixes, by a relation of rules."""
    pages = A.read_pages(spark, sf_dir).select(F.col("url").alias("input"))
    docs = A.read_table(spark, sf_dir, "documents").select(F.col("source").alias("input"))
    hosts = A.read_pages(spark, sf_dir).select(U.host("url").alias("input"))
    moved = hosts.distinct().withColumn("end", F.explode(F.lit(list(FX.OTHER_SUFFIXES)))).select(F.concat(F.element_at(F.split("input", r"\."), 1), F.lit("."), "end").alias("input"))
    d = pages.unionByName(docs).unionByName(hosts).unionByName(moved).where(F.col("input").isNotNull()).distinct()
    rules = D.seed_rules(spark).unionByName(spark.createDataFrame([(r,) for r in FX.SUFFIX_RULES], "rule string"))
    return D.with_domain(d, "input", rules)


@register("slug_text", OR.SLUG_TEXT)
def slug_text(spark, sf_dir):
    """T1-T3, T5 on anchor texts and link path stems of the archive."""
    t = H.tokens(_archive(spark, sf_dir).select("page_id", "html"))
    texts = t.where(F.col("kind") == "text").select(TX.decode_references(F.col("raw")).alias("input"))
    stems = t.where(F.col("href").isNotNull()).select(TX.path_stem(F.col("href")).alias("input"))
    d = texts.unionByName(stems).distinct()
    s = TX.slugify(F.col("input"))
    return d.select(
        "input", s.alias("slug"), TX.path_stem(F.col("input")).alias("stem"),
        TX.digit_runs(s).alias("runs"), TX.title_case(F.replace(s, F.lit("-"), F.lit(" "))).alias("title"),
    )


@register("template_family", OR.TEMPLATE_FAMILY)
def template_family(spark, sf_dir):
    """H3 + S3 + U2: family, content selector and media base of every site."""
    s = _mig(spark, sf_dir).sites
    return s.select("site", "site_url", "domain", "family", "content_kind", "content_key", "media_base")


@register("seo_metadata", OR.SEO_METADATA)
def seo_metadata(spark, sf_dir):
    """H5 + W2 on every decorated page."""
    deco = _archive(spark, sf_dir)
    return ST.seo(H.tokens(deco.select("page_id", "html")))


@register("main_content", OR.MAIN_CONTENT)
def main_content(spark, sf_dir):
    """H4 + H10: the family's content element(s) of every page, as text."""
    m = _mig(spark, sf_dir)
    return H.assemble(m.tokens.where(F.col("in_content")), "raw", "content")


@register("cleaned_content", OR.CLEANED_CONTENT)
def cleaned_content(spark, sf_dir):
    """H4 + H7 + H10: content with forms and legacy widgets removed."""
    m = _mig(spark, sf_dir)
    return H.assemble(m.tokens.where(F.col("in_content") & ~F.col("removed")), "raw", "content")


@register("stylesheet_manifest", OR.STYLESHEETS)
def stylesheet_manifest(spark, sf_dir):
    """H11 + A2: stylesheets to migrate per site."""
    return _mig(spark, sf_dir).stylesheets.select("site", "matcher", "url", "file_name")


@register("logo_facts", OR.LOGOS)
def logo_facts(spark, sf_dir):
    """H12 + U16: logo source, title, subtitle and image path per site."""
    return _mig(spark, sf_dir).logos.select("site", "family", "title", "description", "logo_src", "image_path", "file_url", "file_name")


@register("menu_rows", OR.MENU_ROWS)
def menu_rows(spark, sf_dir):
    """M1-M3 + H13: menu items as adjacency rows."""
    return _mig(spark, sf_dir).menu.select("site", "pos", "level", "parent_pos", "url", "title", "url_slug", "is_parent")


@register("menu_page_list", OR.MENU_PAGES)
def menu_page_list(spark, sf_dir):
    """M7: pages to process from each menu."""
    m = _mig(spark, sf_dir)
    return MN.menu_pages(m.menu, m.sites)


@register("menu_files", OR.MENU_FILES)
def menu_files(spark, sf_dir):
    """M8: internal files linked from menus."""
    m = _mig(spark, sf_dir)
    return MN.menu_files(m.menu, m.sites)


@register("url_map", OR.URL_MAP)
def url_map(spark, sf_dir):
    """J1 + J2 + A4: legacy URL -> new slug and title."""
    return _mig(spark, sf_dir).url_map


@register("redirects", OR.REDIRECTS)
def redirects(spark, sf_dir):
    """J3 + P4 input: redirects of menu pages."""
    return _mig(spark, sf_dir).menu_redirects


@register("link_dispositions", OR.LINK_DISPOSITIONS)
def link_dispositions(spark, sf_dir):
    """J4 + J8: decision for every link in the content of every page."""
    d = _mig(spark, sf_dir).dispositions
    return d.select("page_id", "pos", "pass", "tag", "link", "stage", "action", "lookup", "file_url", "file_name",
                    F.when(F.col("action") != "follow", F.col("new_value")).alias("new_value"), "stem")


@register("new_pages", OR.NEW_PAGES)
def new_pages(spark, sf_dir):
    """Pages discovered through links (followed, not in the map)."""
    d = _mig(spark, sf_dir).dispositions.where(F.col("action") == "follow")
    return d.select("site", F.col("lookup").alias("page_url")).distinct()


@register("crawl_closure", OR.CRAWL_CLOSURE)
def crawl_closure(spark, sf_dir):
    """Every page reachable from home and menu pages, with its hop count."""
    return _mig(spark, sf_dir).processed


@register("word_costs", OR.WORD_COSTS)
def word_costs(spark, sf_dir):
    """Zipf cost of every corpus word."""
    return SG.word_costs(A.read_table(spark, sf_dir, "documents"))


@register("segmented_slugs", OR.SEGMENTED_SLUGS)
def segmented_slugs(spark, sf_dir):
    """T4 + T7: minimum-cost split of every hyphen-free stem of the archive's links."""
    t = H.tokens(A.spread(A.read_pages(spark, sf_dir)), partitioned=True)
    hrefs = t.where(F.col("href").isNotNull()).select("href").distinct()
    slugs = hrefs.select(TX.settled(TX.slugify(TX.path_stem(F.col("href")))).alias("slug")).distinct()
    slugs = slugs.where((F.length("slug") > 0) & ~F.contains(F.col("slug"), F.lit("-")))
    costs = materialise(SG.word_costs(A.read_table(spark, sf_dir, "documents")), "word-costs")
    return SG.derive_words(materialise(slugs, "slugs"), costs, "slug")


@register("page_identity", OR.PAGE_IDENTITY)
def page_identity(spark, sf_dir):
    """J6 + T4 + T5: slug, title, layout and redirect of every processed page."""
    return _mig(spark, sf_dir).identity


@register("rewritten_content", OR.REWRITTEN_CONTENT)
def rewritten_content(spark, sf_dir):
    """H8 + H9 + H7 + H10: migrated content of every processed page."""
    m = _mig(spark, sf_dir)
    return m.content.join(m.processed.select("page_id"), "page_id", "left_semi")


@register("page_payload", OR.PAGE_PAYLOAD)
def page_payload(spark, sf_dir):
    """P5: page requests."""
    return O.page_payloads(_mig(spark, sf_dir).page_rows)


@register("file_manifest", OR.FILE_MANIFEST)
def file_manifest(spark, sf_dir):
    """A1 + P2 + P3: every file to upload, once per (site, url, name)."""
    return _mig(spark, sf_dir).files


@register("outbox_counts", OR.OUTBOX_COUNTS)
def outbox_counts(spark, sf_dir):
    """X2 + P12 + A1: requests per site, method and endpoint."""
    ob = _mig(spark, sf_dir).outbox
    return ob.groupBy("site_id", "method", "endpoint").agg(F.count("*").alias("n"))


@register("payload_bodies", OR.PAYLOAD_BODIES)
def payload_bodies(spark, sf_dir):
    """Request bodies of menu files, stylesheets, menu redirects, hours and social accounts."""
    m, legacy = _mig(spark, sf_dir), _legacy(spark, sf_dir)
    frames = [O.file_payloads(MN.menu_files(m.menu, m.sites)), O.css_payloads(m.stylesheets), O.redirect_payloads(m.menu_redirects),
              O.hours_payloads(B.hours_sets(B.hours_days(legacy))), O.social_payloads(B.social(legacy))]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _customer_menus(spark, sf_dir) -> DataFrame:
    """A menu per nation and block of 100 customer keys: the nation, its customers under it, and their segments under them; pos in document order."""
    r = A.read_table(spark, sf_dir, "region")
    n = A.read_table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    c = A.read_table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    site = F.concat(F.col("n_name"), F.lit("-"), F.floor(F.col("c_custkey") / 100).cast("string"))
    c = c.select(site.alias("site"), "r_name", "n_name", "c_custkey", "c_name", "c_mktsegment")
    none, big = F.lit(None).cast("bigint"), lambda x: F.lit(x).cast("bigint")
    pos = (F.col("c_custkey") + 1) * 10
    home = c.select("site").distinct().select("site", big(0).alias("pos"), big(1).alias("level"), none.alias("parent_pos"), F.lit("#").alias("url"), F.lit("Home").alias("title"))
    nation = c.select("site", "n_name").distinct().select(
        "site", big(1).alias("pos"), big(1).alias("level"), none.alias("parent_pos"), F.concat(F.lit("/nations/"), F.lower("n_name"), F.lit(".html")).alias("url"), F.col("n_name").alias("title"))
    url = (F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("/files/"), F.col("c_name"), F.lit(".pdf")))
           .otherwise(F.concat(F.lit("/customers/"), F.col("c_custkey").cast("string"))))
    customer = c.select("site", pos.cast("bigint").alias("pos"), big(2).alias("level"), big(1).alias("parent_pos"), url.alias("url"),
                        F.when(F.col("c_custkey") % 7 == 0, F.lit("Welcome")).otherwise(F.col("c_name")).alias("title"))
    segment = c.select("site", (pos + 1).cast("bigint").alias("pos"), big(3).alias("level"), pos.cast("bigint").alias("parent_pos"),
                       F.concat(F.lit("https://segments.example.test/"), F.lower("c_mktsegment")).alias("url"), F.col("c_mktsegment").alias("title"))
    region = c.select("site", "r_name").distinct().select(
        "site", big(1 << 60).alias("pos"), big(1).alias("level"), none.alias("parent_pos"), F.concat(F.lit("/regions/"), F.lower("r_name")).alias("url"), F.col("r_name").alias("title"))
    rows = home.unionByName(nation).unionByName(customer).unionByName(segment).unionByName(region)
    return rows.withColumn("url_slug", F.concat(F.lit("/"), TX.slugify(F.col("title"))))


@register("menu_payload", OR.MENU_PAYLOAD)
def menu_payload(spark, sf_dir):
    """M5 + M6 + P1 on menus of nations, customers and segments derived from the tables."""
    rows = _customer_menus(spark, sf_dir)
    sites = rows.select("site").distinct().select(
        "site", F.lit("example.test").alias("domain"),
        F.concat(F.lit("https://"), F.lower("site"), F.lit(".example.test/storage/app/media/")).alias("media_base"))
    nested = MN.nest(MN.payload_targets(rows, sites))
    return O.navigation_payloads(nested)


@register("component_rows", OR.COMPONENT_ROWS)
def component_rows(spark, sf_dir):
    """J9 + P6 + P7 + P11 + L5: fixed component requests of every site."""
    m = _mig(spark, sf_dir)
    known = m.sites.where(F.col("family") != "X")
    return O.logo_payloads(m.logos).unionByName(O.location_component_payloads(known)).unionByName(O.map_component_payloads(known))


def _legacy(spark, sf_dir):
    return B.parse_docs(LG.business_docs(spark, sf_dir))


@register("locations", OR.LOCATIONS)
def locations(spark, sf_dir):
    """S4 + L1 + L2 + P8 body: one row per legacy location."""
    loc = B.locations(_legacy(spark, sf_dir))
    return O.location_payloads(loc).select("site_id", "body")


@register("weekly_hours", OR.WEEKLY_HOURS)
def weekly_hours(spark, sf_dir):
    """L3 + A4: opening hours per location and day (last duplicate wins)."""
    return B.hours_days(_legacy(spark, sf_dir))


@register("social_accounts", OR.SOCIAL_ACCOUNTS)
def social_accounts(spark, sf_dir):
    """L4 + P10: known social accounts."""
    return B.social(_legacy(spark, sf_dir))


@register("stream_page_intake", OR.STREAM_PAGE_INTAKE)
def stream_page_intake(spark, sf_dir):
    """G1: pages taken in as a file stream, each URL once, facts per page."""
    import uuid

    from sitemill.streaming.intake import intake

    sink = intake(spark, f"{sf_dir}/pages.parquet", uuid.uuid4().hex, file_glob="*")
    return spark.read.parquet(sink).drop("batch_id")


@register("stream_new_pages", OR.NEW_PAGES)
def stream_new_pages(spark, sf_dir):
    """Pages to follow, each emitted once, while the archive arrives in three micro-batches."""
    import uuid

    from sitemill.session import ensure_checkpoint_dir
    from sitemill.streaming.intake import FOLLOW_SCHEMA, follow

    run, m = uuid.uuid4().hex, _mig(spark, sf_dir)
    arriving = f"{ensure_checkpoint_dir(spark).rstrip('/')}/arriving-{run}"
    m.pages.select("page_id", "url", "html").repartition(3, "page_id").write.parquet(arriving)
    return spark.read.schema(FOLLOW_SCHEMA).parquet(follow(spark, arriving, m, run, max_files_per_trigger=1))


@register("outbox_sink", OR.OUTBOX_SINK)
def outbox_sink(spark, sf_dir):
    """The outbox in order, written twice as one batch under the checkpoint dir, read back."""
    import uuid

    from sitemill.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/outbox-{uuid.uuid4().hex}"
    requests = _mig(spark, sf_dir).outbox
    O.write_outbox(requests, path)
    O.write_outbox(requests, path)
    return O.read_outbox(spark, path)
