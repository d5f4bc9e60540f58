"""Navigation menus as adjacency rows.

Tree descent uses element depth: a global running depth over every start
and end tag of the page (void elements excluded).  Element ``c`` is a direct
child of ``p`` when ``depth(c) = depth(p) + 1`` and ``c`` lies inside ``p``'s
extent; parents come from one window keyed by ``(page_id, depth)``, so the
whole tree (any depth) is computed without joins or driver loops.  Only home
pages (one per site) take part.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitemill.functions import text as TX
from sitemill.functions import urls as U
from sitemill.operators import html as H
from sitemill.operators.mapping import HOME_TITLES
from sitemill.sources import rules as R



def with_depth(ext: DataFrame) -> DataFrame:
    """Global element depth (start tags: depth including themselves), with the end tags that HTML leaves out."""
    run = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return ext.withColumn("depth", F.sum("nesting").over(run))


def with_item_facts(ext: DataFrame) -> DataFrame:
    """For every token, the next non-blank text and the next ``a[href]`` after it.

    Scans in reverse document order with a growing frame (linear), so an
    ``li`` finds its first descendant text/link without a range join; the
    caller checks that the found position lies inside the extent.
    """
    nonblank = (F.col("kind") == "text") & (F.length(F.regexp_replace(F.col("raw"), r"\s+", "")) > 0)
    anchor = (F.col("kind") == "open") & (F.col("tag") == "a") & F.col("href").isNotNull()
    rev = W.partitionBy("page_id").orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, -1)
    return (
        ext.withColumn("_next_text", F.last(F.when(nonblank, F.struct(F.col("pos").alias("p"), TX.decode_references(F.col("raw")).alias("v"))), True).over(rev))
        .withColumn("_next_a", F.last(F.when(anchor, F.struct(F.col("pos").alias("p"), F.col("href").alias("v"))), True).over(rev))
    )


def _marker(kind: str, key: str) -> Column:
    start = F.col("kind").isin("open", "raw")
    if kind == "id":
        return start & F.coalesce(F.col("id") == key, F.lit(False))
    return start & H.has_class(F.col("class"), key)


def with_parents(opens: DataFrame, carry: list[str]) -> DataFrame:
    """Parent and grandparent of every start tag, by window only.

    Each start tag is emitted three times: as itself under key ``depth`` and
    as a candidate ancestor under keys ``depth + 1`` and ``depth + 2``.  Within
    a (page, key) partition ordered by position, the latest candidate before a
    tag is its parent (resp. grandparent) in well-nested markup.  Keyed by
    page first, so the archive's partitioning is reused; no join.
    """
    fields = ["pos", "tag"] + carry
    me = F.struct(*[F.col(c) for c in fields])
    roles = F.array(
        F.struct(F.lit(0).alias("role"), F.col("depth").alias("key")),
        F.struct(F.lit(1).alias("role"), (F.col("depth") + 1).alias("key")),
        F.struct(F.lit(2).alias("role"), (F.col("depth") + 2).alias("key")),
    )
    x = opens.withColumn("_me", me).withColumn("_r", F.explode(roles))
    w = W.partitionBy("page_id", F.col("_r.key")).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumns({
        "parent": F.last(F.when(F.col("_r.role") == 1, F.col("_me")), True).over(w),
        "grand": F.last(F.when(F.col("_r.role") == 2, F.col("_me")), True).over(w),
    })
    return x.where(F.col("_r.role") == 0).drop("_me", "_r")


def menu(home_ext: DataFrame) -> DataFrame:
    """M1-M3: ``menu(site, page_id, pos, level, parent_pos, url, title, url_slug, is_parent)``.

    ``home_ext``: home-page tokens with extents and ``site, family`` columns.

    No iteration: an ``li`` is a menu item when it lies inside a root list
    and no element between it and the root breaks the ``li > ul > li`` chain
    (such elements are marked *bad*; coverage by a bad element is the same
    running-maximum window used for content regions).  Its level follows from
    the depth difference to the root list, its parent item is its grandparent.
    """
    t = with_item_facts(with_depth(home_ext))
    fam = F.col("family")
    # M1 roots: family rule with the best priority present on the page
    root_prio, root_is_list = F.lit(None).cast("int"), F.lit(None).cast("boolean")
    for f, p, kind, key, is_list in R.NAV_ROOTS:
        hit = (fam == f) & _marker(kind, key)
        root_prio = F.when(hit, F.lit(p)).otherwise(root_prio)
        root_is_list = F.when(hit, F.lit(is_list)).otherwise(root_is_list)
    t = t.withColumns({"_root_prio": root_prio, "_root_is_list": root_is_list})
    t = t.withColumn("_best", F.min("_root_prio").over(W.partitionBy("page_id")))
    opens = t.where((F.col("kind") == "open") & ~F.col("tag").isin(H.VOID_TAGS))
    opens = opens.withColumns({
        "_is_root": F.coalesce(F.col("_root_prio") == F.col("_best"), F.lit(False)),
        "_is_list_root": F.coalesce(F.col("_root_is_list"), F.lit(False)),
    })
    o = with_parents(opens, ["_is_root", "_is_list_root"])
    par, grand = F.col("parent"), F.col("grand")
    root_list = (F.col("tag") == "ul") & (
        (F.col("_is_root") & F.col("_is_list_root"))
        | (F.coalesce(par["_is_root"], F.lit(False)) & ~F.coalesce(par["_is_list_root"], F.lit(True)))
    )
    o = o.withColumn("_root_list", root_list)
    o = o.withColumns({
        "_in_region": H.covered_by(F.col("_root_list")) & ~F.col("_root_list"),
        "_root_depth": F.last(F.when(F.col("_root_list"), F.col("depth")), True).over(
            W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)),
    })
    excl = F.lit(False)
    for f, cls in R.NAV_EXCLUDED_CLASS.items():
        excl = excl | ((fam == f) & H.has_class(F.col("class"), cls))
    chain_ok = ((F.col("tag") == "li") & (par["tag"] == "ul")) | ((F.col("tag") == "ul") & (par["tag"] == "li"))
    is_level1 = (F.col("tag") == "li") & (F.col("depth") == F.col("_root_depth") + 1)
    bad = F.col("_in_region") & (~F.coalesce(chain_ok, F.lit(False)) | (is_level1 & excl))
    o = o.withColumn("_bad", bad)
    o = o.withColumn("_broken", H.covered_by(F.col("_bad")))
    items = o.where((F.col("tag") == "li") & F.col("_in_region") & ~F.col("_broken"))
    level = ((F.col("depth") - F.col("_root_depth") + 1) / 2).cast("bigint")
    items = items.withColumns({
        "level": level,
        "parent_pos": F.when(level > 1, grand["pos"]).cast("int"),
    })
    # M3: an item is a parent when it has a direct child list
    child_lists = o.where((F.col("tag") == "ul") & (par["tag"] == "li")).select(
        F.col("page_id").alias("_hp"), par["pos"].alias("_hpos")).distinct()
    items = items.join(child_lists, (items["page_id"] == child_lists["_hp"]) & (items["pos"] == child_lists["_hpos"]), "left")
    inside = lambda s: F.when(F.col(s)["p"] <= F.col("end_pos"), F.col(s)["v"])
    title = inside("_next_text")
    return items.select(
        "site", "page_id", "pos", "level", "parent_pos",
        inside("_next_a").alias("url"), title.alias("title"),
        F.when(title.isNotNull(), F.concat(F.lit("/"), TX.slugify(title))).alias("url_slug"),
        F.when(F.col("_hp").isNotNull(), 1).otherwise(0).alias("is_parent"),
    )


def menu_pages(menu_rows: DataFrame, sites: DataFrame) -> DataFrame:
    """M7: pages to fetch from the menu: not '#', internal, not a file, absolute.

    Family W prefixes the scheme to every URL and skips articles.
    """
    m = menu_rows.join(sites.select("site", "site_url", "domain", "family"), "site")
    u = F.col("url")
    w_url = F.concat(U.http_prefix(F.col("site_url")), u)
    url = F.when(F.col("family") == "W", w_url).otherwise(u)
    m = U.with_link_facts(m.withColumn("_u", url), "_u", "site_url", "domain", "f")
    u = F.col("_u")
    keep = (u != "#") & F.col("f_internal") & ~F.col("f_file")
    m = m.where(keep).withColumn("page_url", F.col("f_abs"))
    m = m.where(~((F.col("family") == "W") & U.is_article(F.col("page_url"))))
    return m.select("site", "page_url").distinct()


def menu_files(menu_rows: DataFrame, sites: DataFrame) -> DataFrame:
    """M8: menu links that are internal files -> (site, url, file_name)."""
    m = menu_rows.join(sites.select("site", "site_url", "domain"), "site")
    m = U.with_link_facts(m, "url", "site_url", "domain", "f")
    u = F.col("url")
    m = m.where(F.col("f_internal") & F.col("f_file"))
    return m.select(
        "site", U.with_scheme(F.col("f_abs"), F.col("site_url")).alias("url"),
        U.sanitize_filename(U.file_name(u)).alias("file_name"),
    ).distinct()


def payload_targets(menu_rows: DataFrame, sites: DataFrame) -> DataFrame:
    """M5 + M6 per item: home de-duplication among siblings and the target URL."""
    m = menu_rows.join(sites.select("site", "domain", "media_base"), "site")
    sib = W.partitionBy("site", "parent_pos").orderBy("pos")
    m = m.withColumn("_rn", F.row_number().over(sib))
    # an item without a title is no home item
    home = F.coalesce(F.col("title").isin(HOME_TITLES), F.lit(False))
    m = m.where(~(home & (F.col("_rn") > 1)))
    m = m.withColumn("_internal", U.is_internal(F.col("url"), F.col("domain"), U.Parts.of(F.col("url"))))
    u = F.col("url")
    target = (
        F.when(u == "#", F.lit("#"))
        .when(F.col("_internal"),
              F.when(U.is_file(u), U.media_url(F.col("media_base"), U.sanitize_filename(U.file_name(u))))
              .when(home, F.lit("/"))
              .otherwise(F.col("url_slug")))
        .otherwise(u)
    )
    return m.withColumn("target", target)


def _rest_of_json(*fields: Column) -> Column:
    """The JSON object of ``fields`` without its opening brace."""
    return F.substring(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 2, 1 << 30)


def _kept_with_ancestors(targets: DataFrame, key: str) -> DataFrame:
    """The items all of whose ancestors are items: a dropped parent takes its descendants along.

    In document order an item's ancestor of level l is the last item of that level before it, and an
    item's parent was dropped if that one, one level up, isn't the parent it names. Each item asks
    for its ancestors once per level above it.
    """
    own = targets.withColumn("_own", F.lit(True)).withColumn("_at", F.col("level"))
    asked = (targets.withColumn("_own", F.lit(False)).where("level > 1")
             .withColumn("_at", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("level")))))
    # the ancestor at level _at (the item itself at its own) and the one before it, as they follow each other
    rows = own.unionByName(asked)
    at = W.partitionBy(key, "_at").orderBy("pos", F.col("_own").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_named", F.last(F.when(F.col("_own"), F.struct("pos", "parent_pos")), True).over(at))
    asked = rows.where(~F.col("_own")).select(key, "pos", F.col("_at"), "_named")
    up = W.partitionBy(key, "_level").orderBy("pos", "_role").rowsBetween(W.unboundedPreceding, W.currentRow)
    probes = asked.select(key, "pos", (F.col("_at") - 1).alias("_level"), F.lit(1).alias("_role"), F.col("_named.parent_pos").alias("_parent"))
    nodes = targets.select(key, "pos", F.col("level").alias("_level"), F.lit(0).alias("_role"), F.lit(None).cast(targets.schema["parent_pos"].dataType).alias("_parent"))
    found = nodes.unionByName(probes).withColumn("_last", F.last(F.when(F.col("_role") == 0, F.col("pos")), True).over(up))
    lost = found.where((F.col("_role") == 1) & ~F.col("_last").eqNullSafe(F.col("_parent"))).select(key, "pos").distinct()
    return targets.join(lost, [key, "pos"], "left_anti")


#: Pieces of one menu that are put together by one task before the menu's blocks are.
MENU_BLOCK = 1000


def nest(targets: DataFrame, key: str = "site") -> DataFrame:
    """M6 nesting as the bracket sequence of the tree: ``(key, items)``, items as JSON text.

    ``targets(key, pos, level, parent_pos, title, target)`` has its items in document order of
    ``pos``. An item opens where it stands; after an item as many close as the levels drop to the
    next one. The text that closes a level is that of its last item so far, a window keyed by
    (key, level). The pieces are put in order and joined in blocks, then by key: a tree of
    any depth without a join per level or an action. Items whose parent was dropped (M5) are
    dropped with it.
    """
    t = _kept_with_ancestors(targets, key).withColumn("level", F.col("level").cast("bigint"))
    order = W.partitionBy(key).orderBy("pos")
    close = F.concat(F.lit("],"), _rest_of_json(F.lit("0").alias("newTab"), F.col("title").alias("title"), F.col("target").alias("url")))
    t = t.withColumns({"_next": F.coalesce(F.lead("level").over(order), F.lit(1)), "_before": F.lag("level").over(order), "_close": close})
    opening = F.concat(F.when(F.col("_before") >= F.col("level"), ",").otherwise(""), F.lit('{"items":['))
    opens = t.select(key, "pos", F.lit(0).alias("role"), F.col("level").alias("at"), opening.alias("open"), F.col("_close").alias("close"))
    closes = t.where("_next <= level").select(key, "pos", F.lit(1).alias("role"), F.explode(F.sequence("_next", "level")).alias("at"),
                                              F.lit(None).cast("string").alias("open"), F.lit(None).cast("string").alias("close"))
    level = W.partitionBy(key, "at").orderBy("pos", "role").rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = opens.unionByName(closes).withColumn("close", F.last("close", True).over(level))
    pieces = pieces.select(key, "pos", "role", (-F.col("at")).alias("up"), F.when(F.col("role") == 0, F.col("open")).otherwise(F.col("close")).alias("text"))
    number = F.row_number().over(W.partitionBy(key).orderBy("pos", "role", "up"))
    text = lambda of: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*of))), lambda s: s["text"]), "")
    blocks = (pieces.withColumn("number", number).withColumn("block", F.floor(F.col("number") / MENU_BLOCK))
              .groupBy(key, "block").agg(text(["number", "text"]).alias("text")))
    return blocks.groupBy(key).agg(F.concat(F.lit("["), text(["block", "text"]), F.lit("]")).alias("items"))
