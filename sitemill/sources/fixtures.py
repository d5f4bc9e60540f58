"""Decorated pages: the archive with template families, menus, metadata,
images, forms and an internal link graph added by nested ``replace``.

The derivation is one SQL text that Spark SQL and DuckDB run alike.  It avoids backslashes,
single quotes inside literals and lambdas (the two dialects differ there).
``{pages}`` is the pages relation: ``parquet.`path``` in Spark, ``pages`` in DuckDB.
``decorated_pages`` takes its expressions from that text and numbers the pages in a way that scales.

Families: ``min(page_id) over host % 5`` -> 0 B, 1 O, 2 T, 3 W, 4 X.
Row ``r = 1`` of each host becomes the home page ``scheme://host/``.
Page ``r`` links to pages ``2r`` and ``2r+1`` of its host unless ``r % 7 = 0``.
"""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitemill.operators import html as H
from sitemill.session import materialise
from sitemill.sources.archive import read_pages

# Page ids of one cell, within which a host's pages are ranked.
CELL = 1 << 16
# Fixed decoration values ---------------------------------------------------
MENU_ITEMS = (
    '<li><a href="/index.html">Home</a></li>'
    '<li><a href="#">Services</a><ul>'
    '<li><a href="/services/implants.html">Implants &amp; Crowns</a>'
    '<ul><li><a href="/services/faq2.html">Faq</a></li></ul></li></ul></li>'
    '<li><a href="/files/New  Patient_Form.PDF?v=1">Forms</a></li>'
    '<li><a href="https://other.test/x">Partner</a></li>'
    '<li><a href="/welcome.html">Welcome</a></li>'
    '<li><a href="/a.html?x=1&copy=2&amp;y=3">&Aacute;rea &copy 2020 &#38;lt; Stra&szlig;e</a></li>'
)
# Hosts whose smallest page_id has 5 to 9 as its last digit leave out the end tags of items and paragraphs.
UNCLOSED_MENU_ITEMS = MENU_ITEMS.replace("</li>", "") + '<li><p>Team<li><p><a href="/team.html">Our team</a>'
NAV_OPEN = {
    "B": '<nav><ul id="mainMenu"><li class="sep"></li>',
    "O": '<nav id="slot-navigation"><ul>',
    "T": '<nav><ul id="nav">',
    "W": '<nav id="navigation_header"><ul>',
}
ARTICLE_OPEN = {
    "B": '<article class="x columnsContent">',
    "O": '<article id="slot-main">',
    "T": '<article id="content">',
    "W": '<article class="wrap__page-content--inner">',
}
STYLESHEETS = {
    "B": '<link rel="stylesheet" href="/css/global.css?v=2">',
    "O": '<link rel="stylesheet" href="/css/layout.css"><link rel="stylesheet" href="/css/customer.css?v=3">',
    "W": '<link rel="stylesheet" href="https://cdn.example.test/themes/custom.css">',
}
LOGOS = {
    "B": '<div class="headerPkg"><a href="/"><img src="/img/Logo Main.png"></a></div>',
    "O": '<div class="logo-phone-wrapper-inner"><img src="/img/logo_o.jpg"><img src="/img/second.jpg"></div>',
    "T": ('<div id="headerWrapper"><div class="website-title"><span> </span><span>Smile Studio</span></div>'
          '<div class="website-subtitle">Gentle care</div><img src="/img/logo-t.gif"></div>'),
    "W": '<div class="logo"><img class="logo__image" src="https://cdcssl.ibsrv.net/ib/logo-w.png"></div>',
}
KEYWORDS = "alpha,bravo,charlie,delta,echo,foxtrot,golf,hotel,india,juliet"
BODY_EXTRA = (
    '<img src="/img/a b_c.png"><img src="/img/-logo-.gif">'
    '<img src="/art/logo.svg"><img src="/thumb.php?id=3"><img alt="a > b" src="/img/quoted.png">'
    '<a href="/library/x">lib</a><a href="/Library/y.pdf">Lib pdf</a><a href="#top">top</a>'
    '<a href="mailto:info@example.test">mail</a><a href="/articles/z">article</a>'
    '<a href="/implantfaq2.html/">faq</a><a href="/große-straße.html">Große Straße, Ελλάδα, Москва</a><a href="/praxisgröße.html">Größe</a>'
    '<p>one<p>two<table><tr><td>a<td>b<tr><th>c</table><dl><dt>d<dd>e<dt>f</dl><select><option>g<option>h</select>'
    '<form class="feature_form"><img src="/img/form.png"><a href="/form-target">f</a></form>'
    '<div class="feature_map"><div>map</div></div>'
)


# Public suffix rules beside the seed: wildcards, an exception to each, comments; and endings that meet them or no rule.
SUFFIX_RULES = ["// comment", "", "*.ck", "!www.ck", "*.kobe.jp", "!city.kobe.jp", "  com.XY  trailing words"]
OTHER_SUFFIXES = ["ck", "a.ck", "www.ck", "b.kobe.jp", "c.b.kobe.jp", "city.kobe.jp", "com.xy", "xy", "nowhere.invalid", "org.uk", "uk", "com"]


def _case(mapping: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE fam {whens} ELSE {default} END"


_FAMS = {0: "B", 1: "O", 2: "T", 3: "W", 4: "X"}

EDGES_SQL = """  SELECT a.page_id,
         CASE WHEN a.r % 7 = 0 THEN ''
              ELSE coalesce('<a href="' || b.path || '">next a</a>', '') || coalesce('<a href="' || c.path || '">next b</a>', '')
         END AS edges
  FROM p a
  LEFT JOIN p b ON b.host = a.host AND b.r = 2 * a.r
  LEFT JOIN p c ON c.host = a.host AND c.r = 2 * a.r + 1"""

HTML_SQL = f"""replace(replace(replace(replace(replace(p.html,
    '<article>', {_case(ARTICLE_OPEN, "'<article>'")}),
    '<nav><ul>', {_case(NAV_OPEN, "'<nav><ul>'")} || CASE WHEN p.unclosed THEN '{UNCLOSED_MENU_ITEMS}' ELSE '{MENU_ITEMS}' END),
    '</title>', ' &Aacute;rzte &copy 2020 &#38;lt;</title>'
      || CASE WHEN p.page_id % 2 = 0 THEN '<meta name="title" content="Meta title ' || CAST(p.page_id AS STRING) || '">' ELSE '' END
      || '<meta name="keywords" content="{KEYWORDS}">'
      || '<meta name="description" content="' || repeat('Lorem ipsum ', 50) || '">'
      || {_case(STYLESHEETS, "''")}),
    '<body>', '<body>' || {_case(LOGOS, "''")}),
    '</h1>', '</h1>{BODY_EXTRA}'
      || '<a href="' || p.scheme || '://' || p.host || '/services/implants.html">mapped</a>'
      || '<a href="' || p.scheme || '://' || p.host || '/about-us.html">unmapped</a>'
      || e.edges)"""

DECORATED_SQL = f"""
WITH base AS (
  SELECT page_id, url, html,
         regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
         regexp_extract(url, '^(https?)://', 1) AS scheme,
         row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1) ORDER BY page_id) AS r,
         CASE min(page_id) OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1)) % 5
           WHEN 0 THEN 'B' WHEN 1 THEN 'O' WHEN 2 THEN 'T' WHEN 3 THEN 'W' ELSE 'X' END AS fam,
         min(page_id) OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1)) % 10 >= 5 AS unclosed
  FROM {{pages}}
),
u AS (
  SELECT page_id, html, host, scheme, r, fam, unclosed,
         CASE WHEN r = 1 THEN scheme || '://' || host || '/' ELSE url END AS url
  FROM base
),
p AS (
  SELECT page_id, html, host, scheme, r, fam, unclosed, url,
         regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path
  FROM u
),
e AS (
{EDGES_SQL}
)
SELECT p.page_id, p.host, p.fam, p.r, p.url,
  {HTML_SQL} AS html
FROM p JOIN e ON e.page_id = p.page_id
"""

SITES_SQL = """
SELECT host AS site, url AS site_url, fam AS expected_family,
       '{"sites":[{"editor_url":"http://' || host || '/backend/editor/"}]}' AS site_json
FROM decorated WHERE r = 1
"""


def spark_pages_ref(sf_dir: str) -> str:
    return f"parquet.`{sf_dir}/pages.parquet`"


def decorated_sql(pages_ref: str = "pages") -> str:
    return DECORATED_SQL.replace("{pages}", pages_ref)


def decorated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``decorated(page_id, host, fam, r, url, html)`` derived from the archive: the rows of ``DECORATED_SQL``.

    Pages are numbered without their HTML, which comes back by its place in the files. A
    page's number is the count of its host's pages in earlier cells of page ids plus its rank in
    its cell, so that no task sorts a host.
    """
    place = ["file_path", "row_index"]
    archive = read_pages(spark, sf_dir).select("*", "_metadata.file_path", "_metadata.row_index")
    part = lambda rx: F.regexp_extract("url", rx, 1)
    rows = archive.select("page_id", "url", *place, part("^https?://([^/?#]+)").alias("host"), part("^(https?)://").alias("scheme"))
    rows = rows.withColumn("cell", F.floor(F.col("page_id") / CELL))
    cells = rows.groupBy("host", "cell").agg(F.count("*").alias("n"), F.min("page_id").alias("low"))
    earlier = W.partitionBy("host").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    hosts = cells.groupBy("host").agg(F.min("low").alias("low"))
    cells = cells.select("host", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    alike = lambda *names: reduce(and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names])
    cells = cells.alias("l").join(hosts.alias("r"), alike("host")).select("l.*", "low")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("host", "cell").orderBy("page_id", *place)))
    rows = rows.alias("l").join(cells.alias("r"), alike("host", "cell")).select("l.*", "low", (F.col("before") + F.col("rank")).cast("int").alias("r"))
    fam = " ".join(f"WHEN {k} THEN '{v}'" for k, v in list(_FAMS.items())[:-1])
    rows = rows.withColumn("url", F.when(F.col("r") == 1, F.concat("scheme", F.lit("://"), "host", F.lit("/"))).otherwise(F.col("url")))
    p = materialise(rows.select("page_id", *place, "host", "scheme", "r", F.expr(f"CASE low % 5 {fam} ELSE 'X' END").alias("fam"),
                                (F.col("low") % 10 >= 5).alias("unclosed"), "url", part("^https?://[^/?#]+([^?#]*)").alias("path")), "numbered-pages")
    e = spark.sql(EDGES_SQL.replace("FROM p a", "FROM {p} a").replace("JOIN p ", "JOIN {p} "), p=p)
    numbered = p.drop("path").join(e, "page_id")
    whole = H.partition_pages(archive.select("html", *place), by=tuple(place)).join(numbered, place)
    whole = whole.withColumns({"p": F.struct("html", "unclosed", "page_id", "scheme", "host"), "e": F.struct("edges")})
    return whole.select("page_id", "host", "fam", "r", "url", F.expr(HTML_SQL).alias("html"))


def site_registry(decorated: DataFrame) -> DataFrame:
    """S3 input: one row per site with its site JSON (as an API would return it)."""
    return decorated.where(F.col("r") == 1).select(
        F.col("host").alias("site"),
        F.col("url").alias("site_url"),
        F.col("fam").alias("expected_family"),
        F.concat(F.lit('{"sites":[{"editor_url":"http://'), F.col("host"), F.lit('/backend/editor/"}]}')).alias("site_json"),
    )
