"""The whole migration as one DAG of DataFrames (entry points 1-3 of the tool).

``Migration(spark, pages, registry, documents, legacy_docs)`` exposes every
relation lazily: ``sites``, ``tokens``, ``menu``, ``url_map``, ``redirects``,
``dispositions``, ``processed``, ``identity``, ``content``, ``files``,
``outbox`` ...  Nothing is collected; the only driver round trips are the
crawl-closure rounds (a few numbers each).

Partitioning: the archive is hash-partitioned by ``page_id`` once before
tokenising.  Extents, coverage, SEO and reassembly are windows/aggregates
keyed by ``page_id`` and reuse that exchange.  Per-page context (site URL,
domain, media base) is joined to the few link rows, not carried on every
token.  Joins against per-site tables are left to AQE (broadcast when
small at runtime, skew-split otherwise); only fixed literal rule tables are
inlined as CASE expressions.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.functions import text as TX
from sitemill.functions import urls as U
from sitemill.operators import business as B
from sitemill.operators import domains as D
from sitemill.operators import frontier as FR
from sitemill.operators import html as H
from sitemill.operators import mapping as M
from sitemill.operators import menus as MN
from sitemill.operators import segment as SG
from sitemill.operators import sites as S
from sitemill.plans import outbox as O
from sitemill.session import ensure_checkpoint_dir, materialise
from sitemill.sources import archive as A
from sitemill.sources import fixtures as FX
from sitemill.sources import legacy as LG

CONTEXT = ["site", "site_url", "domain", "media_base", "family"]


class Migration:
    def __init__(self, spark: SparkSession, pages: DataFrame, registry: DataFrame,
                 documents: DataFrame | None = None, legacy_docs: DataFrame | None = None,
                 materialize: bool = True, suffixes: DataFrame | None = None):
        """``suffixes(rule)`` holds public suffix rules; without it the seed rules are used."""
        self.spark = spark
        self.pages = pages.select("page_id", "url", "html")
        self.registry = registry
        self.documents = documents
        self.legacy_docs = legacy_docs
        self.materialize = materialize
        self.suffixes = suffixes if suffixes is not None else D.seed_rules(spark)
        if materialize:
            ensure_checkpoint_dir(spark)

    def _cut(self, df: DataFrame) -> DataFrame:
        """A Parquet table in the shared checkpoint folder for relations that loops or
        several consumers reuse: lineage stays short, lost executors re-read the
        table, and each consumer reads only the columns it needs."""
        return materialise(df, "relation") if self.materialize else df

    @classmethod
    def from_fixture(cls, spark: SparkSession, sf_dir: str) -> "Migration":
        ensure_checkpoint_dir(spark)
        deco = materialise(FX.decorated_pages(spark, sf_dir), "archive")
        homes = deco.where("r = 1").select(F.col("host").alias("site"), (F.col("page_id") % 25).alias("nation"))
        return cls(spark, deco, FX.site_registry(deco), A.read_table(spark, sf_dir, "documents"),
                   LG.site_docs(spark, sf_dir, homes))

    def arriving(self, pages: DataFrame) -> "Migration":
        """The migration of ``pages`` that are fetched later, within the sites and the URL map known here."""
        later = Migration(self.spark, pages, self.registry, self.documents, self.legacy_docs, suffixes=self.suffixes, materialize=self.materialize)
        later.sites, later._map_and_redirects = self.sites, self._map_and_redirects
        return later

    # -- sites and per-page context -------------------------------------------------
    @cached_property
    def sites(self) -> DataFrame:
        return self._cut(S.sites(self.pages, self.registry, self.suffixes))

    @cached_property
    def page_ctx(self) -> DataFrame:
        """(page_id, url, site, site_url, domain, media_base, family, content_kind, content_key) for known families."""
        p = self.pages.select("page_id", "url", U.host("url").alias("host"))
        s = self.sites.where(F.col("family") != "X").drop("home_page_id")
        return self._cut(p.join(self.hosts, "host").drop("host").join(s, "site"))

    @cached_property
    def hosts(self) -> DataFrame:
        """(host, site): the site that each host of the archive belongs to.

        A host is a site's own, with or without ``www.``; else it belongs to the site
        that alone has its registered domain; hosts of no site are left out.
        """
        known = self.sites.select("site", "domain")
        bare = lambda c: F.regexp_replace(c, r"^www\.", "")
        found = D.with_domain(self.pages.select(U.host("url").alias("host")).distinct(), "host", self.suffixes, "host_domain")
        exact = known.select(F.col("site").alias("exact"))
        plain = known.groupBy(bare("site").alias("bare")).agg(F.min("site").alias("plain"))
        alone = known.groupBy(F.col("domain").alias("host_domain")).agg(F.min("site").alias("only"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
        return self._cut(found.join(exact, found["host"] == exact["exact"], "left")
                         .join(plain, bare(found["host"]) == plain["bare"], "left").join(alone, "host_domain", "left")
                         .select("host", F.coalesce("exact", "plain", "only").alias("site")).where("site IS NOT NULL"))

    @cached_property
    def partitions(self) -> int:
        """In how many partitions the archive is tokenised."""
        return H.partitions(self.pages)

    # -- the token relation ------------------------------------------------------------
    def _tokens_of(self, pages: DataFrame) -> DataFrame:
        """Tokens of ``pages(page_id, content_kind, content_key)``, with extents and region flags."""
        # dealt out before the join, which then keeps the partitions
        pages = H.partition_pages(self.pages.select("page_id", "html"), self.partitions).join(pages, "page_id")
        tok = H.with_extents(H.tokens(pages, keep=["content_kind", "content_key"], partitioned=True))
        marker = H.content_marker(F.col("content_kind"), F.col("content_key"))
        return (tok.withColumn("in_content", H.covered_by(marker))
                .withColumn("removed", H.covered_by(H.removal_marker())))

    @cached_property
    def tokens(self) -> DataFrame:
        """Tokens of every page of a known family, with extents and region flags."""
        return self._tokens_of(self.page_ctx.select("page_id", "content_kind", "content_key"))

    @cached_property
    def home_tokens(self) -> DataFrame:
        homes = self.sites.where(F.col("family") != "X").select(
            F.col("home_page_id").alias("page_id"), *CONTEXT)
        # few pages of the archive: cut down first, tokenised once for menus, stylesheets and logos
        src = H.partition_pages(self.pages.select("page_id", "html").join(homes, "page_id"))
        return self._cut(H.with_extents(H.tokens(src, keep=CONTEXT, partitioned=True)))

    # -- site-level relations ---------------------------------------------------------
    @cached_property
    def menu(self) -> DataFrame:
        return self._cut(MN.menu(self.home_tokens))

    @cached_property
    def map_entries(self) -> DataFrame:
        return self._cut(M.map_entries(self.menu, self.sites))

    @cached_property
    def _map_and_redirects(self):
        return M.url_map_and_redirects(self.map_entries)

    @property
    def url_map(self) -> DataFrame:
        return self._map_and_redirects[0]

    @property
    def menu_redirects(self) -> DataFrame:
        return self._map_and_redirects[1]

    @cached_property
    def stylesheets(self) -> DataFrame:
        return self._cut(S.stylesheets(self.home_tokens))

    @cached_property
    def logos(self) -> DataFrame:
        return self._cut(S.logos(self.home_tokens))

    @cached_property
    def page_facts(self) -> DataFrame:
        """One pass over the token relation: SEO aggregates and the content links
        of every page (per-page arrays), checkpointed for both consumers."""
        t = S.seo_prepare(self.tokens)
        return self._cut(t.groupBy("page_id").agg(*S.seo_aggs(), *H.link_aggs(F.col("in_content"))))

    @cached_property
    def seo(self) -> DataFrame:
        return S.seo_finish(self.page_facts)

    # -- links ------------------------------------------------------------------------
    @cached_property
    def links(self) -> DataFrame:
        lk = self.page_facts.select("page_id", F.explode(F.concat("_links0", "_links1")).alias("l"))
        lk = lk.select("page_id", "l.pos", "l.pass", "l.tag", "l.link")
        ctx = self.page_ctx.select("page_id", "site", "site_url", "domain", "media_base")
        return self._cut(lk.join(ctx, "page_id"))

    @cached_property
    def dispositions(self) -> DataFrame:
        return self._cut(M.resolve_links(M.classify_links(self.links), self.url_map))

    @cached_property
    def word_costs(self) -> DataFrame:
        return self._cut(SG.word_costs(self.documents))

    # -- crawl ------------------------------------------------------------------------
    @cached_property
    def archive_keys(self) -> DataFrame:
        return self.page_ctx.select("page_id", "site", FR.url_key("url").alias("key"))

    @cached_property
    def edges(self) -> DataFrame:
        follow = self.dispositions.where(F.col("action") == "follow").select(
            F.col("page_id").alias("src"), "site", FR.url_key("lookup").alias("key"))
        return follow.join(self.archive_keys.withColumnRenamed("page_id", "dst"), ["site", "key"]).select("src", "dst")

    @cached_property
    def start_pages(self) -> DataFrame:
        mp = MN.menu_pages(self.menu, self.sites).select("site", FR.url_key("page_url").alias("key"))
        from_menu = mp.join(self.archive_keys, ["site", "key"]).select("page_id")
        homes = self.sites.where(F.col("family") != "X").select(F.col("home_page_id").alias("page_id"))
        return homes.unionByName(from_menu).distinct()

    @cached_property
    def processed(self) -> DataFrame:
        return FR.closure(self._cut(self.start_pages), self.edges)

    # -- identity, content, payloads -------------------------------------------------
    @cached_property
    def processed_ctx(self) -> DataFrame:
        return self.page_ctx.join(self.processed.select("page_id"), "page_id", "left_semi")

    def _slugs_to_segment(self) -> DataFrame:
        page_slugs = self.processed_ctx.select(TX.slugify(TX.path_stem(F.regexp_replace("url", "/$", ""))).alias("slug"))
        link_slugs = self.dispositions.where(F.col("action") == "follow").select(F.col("stem").alias("slug"))
        s = page_slugs.unionByName(link_slugs)
        return s.where(~F.contains(F.col("slug"), F.lit("-")) & (F.length("slug") > 0)).distinct()

    @cached_property
    def words(self) -> DataFrame:
        return self._cut(SG.derive_words(self._slugs_to_segment(), self.word_costs, "slug"))

    @cached_property
    def identity(self) -> DataFrame:
        return self._cut(M.page_identity(self.processed_ctx.select("page_id", "site", "site_url", "url"), self.url_map, self.words))

    @cached_property
    def link_values(self) -> DataFrame:
        """Final attribute value per rewritten link (H8 input), follow slugs resolved."""
        d = self.dispositions.join(self.words.select(F.col("slug").alias("stem"), "words"), "stem", "left")
        follow_val = F.when(F.contains(F.col("stem"), F.lit("-")), F.col("stem")).otherwise(
            F.array_join(F.coalesce(F.col("words"), F.array().cast("array<string>")), "-"))
        val = F.when(F.col("action") == "follow", follow_val).otherwise(F.col("new_value"))
        return self._cut(d.where(F.col("action").isin("file", "mapped", "follow")).select("page_id", "pos", "pass", "tag", val.alias("value"), (F.col("action") == "file").alias("is_file")))

    @cached_property
    def rewritten_tokens(self) -> DataFrame:
        """H8 + H9 + H7: content tokens with link values rewritten, library links
        pointed at articles, removed elements dropped."""
        # one value per element: an element seen by both passes keeps its first (href) pass
        first = self.link_values.groupBy("page_id", "pos").agg(F.min_by(F.struct("value", "is_file"), "pass").alias("v"))
        per_page = first.groupBy("page_id").agg(
            F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("_vals"))
        # only the reached pages are rewritten, so only they are tokenised again
        t = self._tokens_of(self.processed_ctx.select("page_id", "content_kind", "content_key")).where(F.col("in_content") & ~F.col("removed")).join(per_page, "page_id", "left")
        new = F.when(F.col("_vals").isNotNull(), F.element_at(F.col("_vals"), F.col("pos")))
        t = t.withColumn("_new", new["value"]).withColumn("_src", F.coalesce(~(F.col("tag") == "a") & new["is_file"], F.lit(False)))
        # a file goes to an image's src; a page link always becomes href, and an image's src stays
        href = F.when(F.col("_new").isNotNull() & ~F.col("_src"), F.col("_new"))
        lib = F.coalesce(F.contains(F.coalesce(href, F.col("href")), F.lit("library")), F.lit(False)) & (F.col("kind") == "open")
        t = t.withColumn("_href", F.when(lib, F.lit("articles")).otherwise(href))
        esc = lambda v: F.regexp_replace(v, r"([\\$])", r"\\$1")
        with_src = F.when(F.col("_src"), F.regexp_replace("raw", H._attr_rx("src"), F.concat(F.lit(' src="'), esc(F.col("_new")), F.lit('"')))).otherwise(F.col("raw"))
        t = t.withColumn("out", with_src)
        t = t.withColumn("out", F.when(F.col("_href").isNull(), F.col("out"))
                         .when(F.col("href").isNotNull(), F.regexp_replace("out", H._attr_rx("href"), F.concat(F.lit(' href="'), esc(F.col("_href")), F.lit('"'))))
                         .otherwise(F.concat(F.rtrim(F.regexp_replace("out", r"/?>$", "")), F.lit(' href="'), F.col("_href"), F.lit('">'))))
        return t.select("page_id", "pos", "out")

    @cached_property
    def content(self) -> DataFrame:
        return H.assemble(self.rewritten_tokens, "out", "content")

    @cached_property
    def page_rows(self) -> DataFrame:
        idt = self.identity
        return (idt.join(self.content, "page_id", "left").join(self.seo, "page_id", "left")
                .withColumn("content", F.coalesce(F.col("content"), F.lit(""))))

    @cached_property
    def redirects(self) -> DataFrame:
        pr = self.identity.where(F.col("from_url").isNotNull()).select("site", "from_url", "to_url")
        return self._cut(self.menu_redirects.unionByName(pr).distinct())

    @cached_property
    def files(self) -> DataFrame:
        menu_files = MN.menu_files(self.menu, self.sites)
        css = self.stylesheets.select("site", U.with_scheme(F.col("url"), F.col("site_url")).alias("url"), "file_name")
        logo = self.logos.where(F.col("file_url").isNotNull()).select("site", F.col("file_url").alias("url"), "file_name")
        content = (self.dispositions.join(self.processed.select("page_id"), "page_id", "left_semi")
                   .where(F.col("action") == "file").select("site", F.col("file_url").alias("url"), "file_name"))
        return self._cut(menu_files.unionByName(css).unionByName(logo).unionByName(content).distinct())

    @cached_property
    def nested_menu(self) -> DataFrame:
        return self._cut(MN.nest(MN.payload_targets(self.menu, self.sites)))

    @cached_property
    def legacy(self) -> DataFrame | None:
        """Legacy business documents of family-O sites (the tool fetched them only for O); a site may have several."""
        if self.legacy_docs is None:
            return None
        o = self.sites.where(F.col("family") == "O").select("site")
        return B.parse_docs(o.join(self.legacy_docs.select("site", "doc_json"), "site"))

    @cached_property
    def outbox(self) -> DataFrame:
        known = self.sites.where(F.col("family") != "X")
        frames = {
            "navigation": O.navigation_payloads(known.select("site").join(self.nested_menu, "site", "left")
                                                .withColumn("items", F.coalesce(F.col("items"), F.lit("[]")))),
            "files": O.file_payloads(self.files),
            "stylesheets": O.css_payloads(self.stylesheets),
            "redirects": O.redirect_payloads(self.redirects),
            "logos": O.logo_payloads(self.logos),
            "pages": O.page_payloads(self.page_rows),
        }
        if self.legacy is not None:
            frames |= {"locations": O.location_payloads(B.locations(self.legacy)),
                       "hours": O.hours_payloads(B.hours_sets(B.hours_days(self.legacy))),
                       "social": O.social_payloads(B.social(self.legacy))}
        return O.outbox(frames)
