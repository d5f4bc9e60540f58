"""HTML as a relation.

A document becomes ordered tokens with one regular expression
(``regexp_extract_all`` + ``posexplode``); element nesting becomes window
arithmetic over ``pos``.  The page archive is hash-partitioned by
``page_id`` once, before tokenising; ``Generate`` keeps that partitioning, so
every per-page window and aggregate below runs without another exchange.
"""
from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitemill.functions import text as T

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------
# One token per match, alternatives in priority order: comment, declaration,
# whole script element, whole style element, any tag (a quoted attribute value
# may hold '>'), text run, lone '<'.  What is never closed runs to the end of the
# page, so every alternative succeeds on its first way through: the quantifiers
# are possessive, which keeps matching linear and its stack flat whatever a tag's
# size or number of attributes.
TOKEN_RX = (
    r"<!--[\s\S]*?(?:-->|\z)|<![^>]*+(?:>|\z)"
    r"|(?i:<script[\s/>][\s\S]*?(?:</script\s*+>|\z))|(?i:<style[\s/>][\s\S]*?(?:</style\s*+>|\z))"
    r"|</?[A-Za-z][^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?+[^>=]*+)*+(?:>|\z)|[^<]++|<"
)
# HTML of one partition of tokens.
PARTITION_BYTES = 8 << 20
# Elements that never have content, so they never open a nesting level.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
# Attributes extracted from start tags.
ATTRIBUTES = ["id", "class", "href", "src", "name", "content", "rel"]
# Elements removed from migrated content: classes, then tag names.
REMOVED_CLASSES = ["feature_form", "library_wrapper", "librarySearchForm", "feature_map", "feature_gallery"]
REMOVED_TAGS = ["form"]

# Optional end tags: elements that their list, and the items that end one another in it.
# Rank 1 ends items of rank 1 and above, and so on; a list's own tags are rank 0.
LISTS = {"ul": "list", "ol": "list", "menu": "list", "dl": "terms", "select": "options", "datalist": "options", "table": "table"}
ITEMS = {"li": ("list", 1), "dt": ("terms", 1), "dd": ("terms", 1), "option": ("options", 1),
         "thead": ("table", 1), "tbody": ("table", 1), "tfoot": ("table", 1), "tr": ("table", 2), "td": ("table", 3), "th": ("table", 3)}
RANKS = (1, 2, 3)
# Start or end tags of these end an open paragraph.
BLOCKS = ["address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
          "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "pre", "section",
          "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]

TAG_NAME_RX = r"^</?([A-Za-z][A-Za-z0-9-]*)"


def _attr_rx(name: str) -> str:
    return r"\s(?i:" + name + r")\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"


def _unquote(v: Column) -> Column:
    """Raw attribute match -> value: quotes stripped; '' or null -> null."""
    quoted = F.startswith(v, F.lit('"')) | F.startswith(v, F.lit("'"))
    return F.when(v == "", F.lit(None).cast("string")).when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


@cache
def _attribute_columns() -> tuple[dict[str, Column], dict[str, Column], Column, dict[str, Column]]:
    """Steps from ``_start`` to attribute values: matches, unquoted ones, those of tags with references decoded, and the values.

    One regex per attribute and one decoder for all; tags without a '&' never enter it.
    """
    matches = {f"_v_{a}": F.regexp_extract(F.col("_start"), _attr_rx(a), 1) for a in ATTRIBUTES}
    plain = {f"_u_{a}": _unquote(F.col(f"_v_{a}")) for a in ATTRIBUTES}
    decoded = F.when(F.contains("_start", F.lit("&")), F.transform(F.array(*plain), lambda v: T.decode_references(v, attribute=True)))
    values = {a: T.settled(F.when(F.col("_decoded").isNotNull(), F.get("_decoded", F.lit(i))).otherwise(F.col(f"_u_{a}"))) for i, a in enumerate(ATTRIBUTES)}
    return matches, plain, decoded, values


def has_class(cls: Column, key) -> Column:
    """Word-wise class test (``.key`` selector)."""
    k = key if isinstance(key, Column) else F.lit(key)
    return F.coalesce(F.array_contains(F.split(F.trim(cls), r"\s+"), k), F.lit(False))


def partitions(pages: DataFrame) -> int:
    """A partition for every ``PARTITION_BYTES`` of HTML, which one pass over that column adds up.

    Tokens and the sorts of their windows take many times a page's size, and the compressed
    bytes of an exchange, by which Spark merges partitions, don't tell it.
    """
    size = pages.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    return max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))


def partition_pages(pages: DataFrame, num_partitions: int | None = None, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Hash-partition the archive by page_id once; all per-page work reuses it."""
    return pages.repartition(num_partitions or partitions(pages), *by)


def tokens(pages: DataFrame, keep: list[str] | None = None, partitioned: bool = False) -> DataFrame:
    """H1: ``pages(page_id, html, ...)`` -> ``tokens(page_id, pos, kind, tag, raw, <attrs>)``.

    ``keep`` lists extra page columns carried onto every token (e.g. site keys).
    ``partitioned`` leaves the pages where they are: by page_id already, or wherever
    their scan has them, if nothing keyed by page follows.
    A tag that the page's end cuts off is of kind ``cut`` and has no tag.
    """
    keep = keep or []
    src = pages if partitioned else partition_pages(pages)
    t = src.select(
        "page_id", *keep,
        F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN_RX), 0)).alias("pos", "raw"),
    )
    raw = F.col("raw")
    t = t.withColumn("_tag", T.settled(F.lower(F.regexp_extract(raw, TAG_NAME_RX, 1))))
    tag = F.col("_tag")
    is_tag = F.startswith(raw, F.lit("<")) & (F.length(tag) > 0) & ~F.startswith(raw, F.lit("</"))
    whole_element = is_tag & tag.isin("script", "style") & F.contains(raw, F.lit(">"))
    kind = (
        F.when(F.startswith(raw, F.lit("<!--")), "comment")
        .when(F.startswith(raw, F.lit("<!")), "decl")
        .when(whole_element, "raw")
        .when((F.length(tag) > 0) & ~F.endswith(raw, F.lit(">")), "cut")
        .when(F.startswith(raw, F.lit("</")) & (F.length(tag) > 0), "close")
        .when(is_tag, "open")
        .otherwise("text")
    )
    t = t.withColumn("kind", kind).withColumn("tag", F.when(F.col("kind").isin("open", "close", "raw"), tag))
    # the start tag of a whole-element token is everything up to its first '>'
    is_start = F.col("kind").isin("open", "raw")
    t = t.withColumn("_start", F.when(F.col("kind") == "raw", F.substring_index(raw, ">", 1)).when(is_start, raw))
    matches, plain, decoded, values = _attribute_columns()
    t = t.withColumns(matches).withColumns(plain).withColumn("_decoded", decoded)
    return t.select("page_id", "pos", *keep, "kind", "tag", "raw", *[v.alias(a) for a, v in values.items()])


def with_extents(tok: DataFrame) -> DataFrame:
    """H2: add ``level``, ``end_pos`` and ``nesting`` to tags.

    Depth is a running sum per (page, group of tags); within one depth, the tags from
    a start tag to the next one of that depth are its scope, and the scope's
    first end tag is its own.  Elements never closed end at the page's last token.

    End tags that HTML leaves out are put in first.  Lists form one group per kind
    (``LISTS``); items are events of the scope of their list, so nested lists
    don't disturb them: an item ends at the next event of its rank or a lower
    one, which is its own end tag or implies it.  A paragraph ends at the next
    block's start or end.  ``nesting`` is what a tag adds to the depth of all that
    follows: its own start or end, less the ends it implies; end tags of items
    that are not open count nothing.

    Windows are all keyed by page_id first, so they reuse the archive's partitioning.
    """
    scoped, t = _extent_columns(), tok
    for columns in scoped:
        t = t.withColumns(columns)
    return t.select(*tok.columns, "level", "end_pos", "nesting")


@cache
def _extent_columns() -> list[dict[str, Column]]:
    """The columns of ``with_extents``, step by step."""
    tag, kind = F.col("tag"), F.col("kind")
    opens, closes = F.col("_open"), kind == "close"
    rank, holds = F.col("_rank"), F.col("_rank") == 0
    names = lambda values: ", ".join(f"'{v}'" for v in values)
    group = " ".join(f"WHEN '{t}' THEN '<{g}'" for t, g in [*LISTS.items(), *((t, g) for t, (g, _) in ITEMS.items())])
    ranks = " ".join(f"WHEN '{t}' THEN {r}" for t, (_, r) in ITEMS.items())
    marks = {
        "_group": F.expr(f"CASE tag {group} ELSE tag END"), "_rank": F.expr(f"CASE tag {ranks} ELSE 0 END"),
        "_open": F.expr(f"kind = 'open' AND tag NOT IN ({names(VOID_TAGS)})"),
        "_block": F.expr(f"coalesce(kind IN ('open', 'close') AND tag IN ('p', {names(BLOCKS)}), false)"),
    }
    depth = F.sum(F.when(holds & opens, 1).when(holds & closes, -1).otherwise(0)).over(
        W.partitionBy("page_id", "_group").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    level = F.when(opens | (~holds & closes), F.col("_depth")).when(closes, F.col("_depth") + 1).cast("bigint")
    own_scope = F.max(F.when(holds & opens, F.col("pos"))).over(
        W.partitionBy("page_id", "_group", "level").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    scope = W.partitionBy("page_id", "_group", "level", "_scope")
    before = scope.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    after = scope.orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, -1)
    # the nearest event of rank r or lower on either side; text and other tokens of no tag have no level
    event = {r: F.when(F.col("level").isNotNull() & (rank <= r), F.struct("pos", "tag", "_open", "_rank")) for r in RANKS}
    blocks = W.partitionBy("page_id", "_block").orderBy("pos")
    around = {f"_next{r}": F.last(event[r], True).over(after) for r in RANKS}
    around |= {f"_prev{r}": F.last(event[r], True).over(before) for r in RANKS}
    around |= {
        "_own_end": F.min(F.when(holds & closes, F.col("pos"))).over(scope),
        "_next_block": F.lead(F.struct("pos", ((tag == "p") & closes).alias("p_close"))).over(blocks),
        "_in_p": F.col("_block") & F.coalesce(F.lag((tag == "p") & opens).over(blocks), F.lit(False)),
        "_last": F.max("pos").over(W.partitionBy("page_id")),
    }
    of_rank = lambda side: F.coalesce(*[F.when(rank == r, F.col(f"_{side}{r}")) for r in RANKS])
    own = {"_next": of_rank("next"), "_prev": of_rank("prev")}
    nxt, prev = F.col("_next"), F.col("_prev")
    item_end = F.when((nxt["tag"] == tag) & ~nxt["_open"], nxt["pos"]).otherwise(nxt["pos"] - 1)
    p_end = F.when(F.col("_next_block.p_close"), F.col("_next_block.pos")).otherwise(F.col("_next_block.pos") - 1)
    end = F.when(tag == "p", p_end).when(holds, F.col("_own_end")).otherwise(item_end)
    implied = F.lit(0)
    for r in RANKS:
        is_open = F.coalesce(F.col(f"_prev{r}")["_open"] & (F.col(f"_prev{r}")["_rank"] == r), F.lit(False))
        ends = (opens & ~holds & (rank <= r)) | (closes & (rank < r))
        implied = implied + F.when(is_open & ends, 1).otherwise(0)
    implied = implied + F.when(F.col("_in_p") & ~((tag == "p") & closes), 1).otherwise(0)
    matched = F.when(tag == "p", F.col("_in_p")).when(holds, F.lit(True)).otherwise(F.coalesce((prev["tag"] == tag) & prev["_open"], F.lit(False)))
    out = {
        "end_pos": F.when(opens, F.coalesce(end, "_last")).when(kind.isin("open", "raw"), F.col("pos")),
        "nesting": F.coalesce(F.when(opens, 1).when(closes & matched, -1), F.lit(0)) - F.coalesce(implied, F.lit(0)),
        "level": F.when(tag == "p", F.when(opens | closes, 1)).otherwise(F.col("level")).cast("bigint"),
    }
    return [marks, {"_depth": depth}, {"level": level}, {"_scope": own_scope}, around, own, out]


def covered_by(marked: Column) -> Column:
    """True for tokens inside an element whose start token satisfies ``marked``.

    Running maximum of the marked elements' end positions: a token is covered
    when some marked element started at or before it and ends at or after it.
    """
    run = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    reach = F.max(F.when(marked, F.col("end_pos"))).over(run)
    return F.coalesce(reach >= F.col("pos"), F.lit(False))


def content_marker(kind_col: Column, key_col: Column) -> Column:
    """H4 marker: start token whose id (kind 'id') or class word (kind 'class') is the key."""
    is_start = F.col("kind").isin("open", "raw")
    by_id = (kind_col == "id") & (F.col("id") == key_col)
    by_class = (kind_col == "class") & has_class(F.col("class"), key_col)
    return is_start & F.coalesce(by_id | by_class, F.lit(False))


def removal_marker() -> Column:
    """H7 marker: forms and the legacy widget containers."""
    is_start = F.col("kind").isin("open", "raw")
    m = F.col("tag").isin(REMOVED_TAGS)
    for c in REMOVED_CLASSES:
        m = m | has_class(F.col("class"), c)
    return is_start & F.coalesce(m, F.lit(False))


def links(tok: DataFrame) -> DataFrame:
    """H6 + X1: link candidates, pass 0 (kept href) then pass 1 (kept src).

    Only ``a`` (path from href) and ``img`` (path from src) take part.
    """
    from sitemill.functions.urls import is_denied

    base = tok.where(F.col("kind") == "open").where(F.col("tag").isin("a", "img"))
    path = F.when(F.col("tag") == "a", F.col("href")).otherwise(F.col("src"))
    # both passes from one scan: explode a two-element pass list instead of a union
    both = base.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    tested = F.when(F.col("pass") == 0, F.col("href")).otherwise(F.col("src"))
    return both.where(~is_denied(tested)).withColumn("link", path).where(F.col("link").isNotNull())


def assemble(tok: DataFrame, text_col: str = "raw", name: str = "content") -> DataFrame:
    """Concatenate tokens per page in document order."""
    return tok.groupBy("page_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", text_col))), lambda s: s[text_col]),
            "",
        ).alias(name)
    )


def link_aggs(scope: Column) -> list[Column]:
    """H6 as per-page aggregates: the page's link candidates of both passes as
    arrays of ``struct(pos, pass, tag, link)`` (bounded by one page), so that
    link harvesting can share a pass over the tokens with other per-page work.
    ``explode(concat(_links0, _links1))`` gives the rows of ``links``.
    """
    from sitemill.functions.urls import is_denied

    base = scope & (F.col("kind") == "open") & F.col("tag").isin("a", "img")
    path = F.when(F.col("tag") == "a", F.col("href")).otherwise(F.col("src"))
    out = []
    for p, attr in ((0, "href"), (1, "src")):
        cond = base & ~is_denied(F.col(attr)) & path.isNotNull()
        item = F.struct(F.col("pos").alias("pos"), F.lit(p).alias("pass"), F.col("tag").alias("tag"), path.alias("link"))
        out.append(F.collect_list(F.when(cond, item)).alias(f"_links{p}"))
    return out
