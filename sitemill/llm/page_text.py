"""Main text of web pages, by site template removal.

1. Each page is read into elements once (implied end tags, unclosed and cut elements included).
   The containers, and the paragraphs outside article and main elements, are hashed by their source.
2. Spark counts, per host, with how many different main contents a hash occurs. A container is
   site template when it recurs with at least ``MIN_PAGES`` of them and ``MIN_SHARE`` of the
   host's, of which ``ENOUGH_PAGES`` are enough however large the host. Copies of one page count once, so an article isn't a template because it was copied.
3. The second reading leaves out template containers and those whose tag, role, class or id
   names them as menu, header, footer, sidebar, notice, advert, form or comments, and joins the
   text blocks of what remains of the body. Names are whole classes or ids of containers, never of
   headings or paragraphs, and drop nothing that holds most of a page's text. Only where the main elements, or else the articles,
   hold ``MOST`` of that text, what is outside them goes too.

Paragraphs of an article are never template, however often they recur. Defined results: a null
or empty page has an empty text; a null url is a host of its own; repeated rows are read as often
as they occur but count as one content; an empty table gives an empty result.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.llm.slices import prepare_workers
from sitemill.session import materialise

MIN_PAGES, MIN_SHARE, ENOUGH_PAGES = 5, 0.1, 50
#: The share of a page's remaining text from which article or main elements stand for the page.
MOST = 0.8
#: Template hashes up to this number are sent to every task; beyond it pages are joined with theirs.
BROADCAST_HASHES = 500_000

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_set = lambda text: frozenset(text.split())
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title noscript iframe template xmp noembed noframes svg math canvas")
BLOCK = _set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul")
CLOSES_P = BLOCK - _set("caption dd dt head html body legend option select tbody td tfoot th thead tr")
#: What a start tag closes, and within what.
IMPLIED = {"li": (_set("li"), _set("ul ol menu dir")), "dt": (_set("dt dd"), _set("dl")), "dd": (_set("dt dd"), _set("dl")), "option": (_set("option"), _set("select")),
           "tr": (_set("tr td th"), _set("table")), "td": (_set("td th"), _set("tr table")), "th": (_set("td th"), _set("tr table")),
           "tbody": (_set("tr td th tbody thead tfoot"), _set("table")), "tfoot": (_set("tr td th tbody thead tfoot"), _set("table")), "thead": (_set("caption"), _set("table"))}
DROPPED = _set("head nav footer aside form button select input dialog menu search fieldset object embed audio video map")
CONTAINER = _set("div section nav header footer aside form ul ol dl table center details dialog menu figure")
ROLES = _set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
#: Whose class or id can name them as boilerplate: containers, not text blocks.
NAMEABLE = CONTAINER | _set("li article main")
#: Words that may stand beside a name in a class or id.
BESIDE = _set("a the site page global main primary secondary top bottom left right header box bar block container wrapper wrap inner outer area list item items link links button buttons "
              "icon icons section panel form field group slot unit module post posts article articles column row mobile desktop sticky fixed")
NAMES = _set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
             "footer header masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing "
             "social related recommended comment comments disqus replies widget pagination pager search")


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


class Page:
    """The elements of a page: tag, attributes, start and end in the source, parent; and its texts with block breaks."""

    def __init__(self, html: str):
        self.html = html
        self.tag, self.attrs, self.start, self.end, self.parent = ["#page"], [""], [0], [len(html)], [-1]
        self.items: list[tuple[int, str] | None] = []  # (element, raw text), None for a break
        open_ = [0]
        at, low = 0, None

        def close(n: int, end: int) -> None:
            while len(open_) > n:
                e = open_.pop()
                self.end[e] = end
                if self.tag[e] in BLOCK:
                    self.items.append(None)

        def depth(tags: frozenset, within: frozenset) -> int:
            """Where the lowest of ``tags`` is open, not beyond one of ``within``; 0 if nowhere."""
            found = 0
            for n in range(len(open_) - 1, 0, -1):
                t = self.tag[open_[n]]
                if t in within:
                    break
                if t in tags:
                    found = n
            return found

        for m in iter(lambda: TOKEN.search(html, at), None):
            if m.start() > at:
                self.items.append((open_[-1], html[at:m.start()]))
            at = max(m.end(), m.start() + 1)
            slash, name, attrs = m[1], m[2], m[3]
            if name is None:
                if m[5] is None or m.end() == len(html) and html[-1:] != ">":
                    continue  # a comment, or a tag that the page's end cuts
                slash, name, attrs = m[4], m[5], m[6]
            name = name.lower()
            if slash:
                n = next((n for n in range(len(open_) - 1, 0, -1) if self.tag[open_[n]] == name), 0)
                # an inline end tag doesn't close the blocks opened since
                if n and (name in BLOCK or not any(self.tag[e] in BLOCK for e in open_[n + 1:])):
                    close(n, at)
                continue
            if name in CLOSES_P and (n := depth(frozenset(("p",)), frozenset(("table", "td", "th", "button", "object")))):
                close(n, m.start())
            if name in IMPLIED and (n := depth(*IMPLIED[name])):
                close(n, m.start())
            if name in BLOCK:
                self.items.append(None)
            elif name == "br":
                self.items.append((open_[-1], " "))
            if name in VOID:
                continue
            k = len(self.tag)
            self.tag.append(name)
            self.attrs.append(attrs)
            self.start.append(m.start())
            self.end.append(len(html))
            self.parent.append(open_[-1])
            if name in RAW:
                if attrs.rstrip().endswith("/"):
                    continue
                low = html.lower() if low is None else low
                end = low.find(f"</{name}", at)
                at = len(html) if end < 0 else (html.find(">", end) + 1 or len(html))
                self.end[k] = at
                continue
            open_.append(k)
        if at < len(html):
            self.items.append((open_[-1], html[at:]))
        close(1, len(html))
        self.mark()

    def mark(self) -> None:
        """Which elements are dropped by name, and which hold the main content."""
        n = len(self.tag)
        self.named = [False] * n
        mains = [k for k in range(n) if self.tag[k] == "main" or "main" in self.attrs[k] and re.search(r"role\s*=\s*[\"']?main", self.attrs[k])]
        articles = [k for k in range(n) if self.tag[k] == "article"]
        # what holds most of the text is no boilerplate by its name, unless an article or main element lies elsewhere
        by_tag, size = [False] * n, [0] * n
        inside = [False] * n
        for k in range(1, n):
            p = self.parent[k]
            inside[k] = inside[p] or self.tag[p] in ("article", "main")
            by_tag[k] = by_tag[p] or self.by_tag(k, inside[k]) and self.tag[k] not in ("form", "fieldset")
        for item in self.items:
            if item is not None and not by_tag[item[0]]:
                size[item[0]] += len("".join(item[1].split()))
        hints = [0] * n
        for k in articles + mains:
            hints[k] += not by_tag[k]
        total = sum(size)
        for k in range(n - 1, 0, -1):
            size[self.parent[k]] += size[k]
            hints[self.parent[k]] += hints[k]
        headed = {self.parent[k] for k in range(1, n) if self.tag[k] in HEADINGS}
        for k in range(1, n):
            most = 2 * size[k] > total and hints[k] == hints[0]
            self.named[k] = self.named[self.parent[k]] or by_tag[k] or not most and (self.by_tag(k, inside[k]) or self.by_name(k, inside[k], k in headed))
        holds = [False] * n
        for k in articles + mains:
            p = -1 if self.named[k] else self.parent[k]
            while p > 0 and not holds[p]:
                holds[p] = True
                p = self.parent[p]
        self.holds, self.inside = holds, inside
        self.hints = [{k for k in some if not self.named[k]} for some in (mains, articles)]

    def under(self, roots: set[int]) -> list[bool]:
        """Which elements are ``roots`` or below them."""
        out = [False] * len(self.tag)
        for k in range(len(out)):
            out[k] = k in roots or (k > 0 and out[self.parent[k]])
        return out

    def attributes(self, k: int) -> dict[str, str]:
        attrs = self.attrs[k]
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)} if attrs and not attrs.isspace() else {}

    def by_tag(self, k: int, inside: bool) -> bool:
        """Dropped for its tag or role, or hidden."""
        tag = self.tag[k]
        if tag in ("html", "body"):
            return False
        if tag in DROPPED or tag == "header" and not inside:
            return True
        a = self.attributes(k)
        return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES

    def by_name(self, k: int, inside: bool, headed: bool) -> bool:
        """A container that a whole class or its id names as boilerplate: a name, and besides only words that say nothing else."""
        tag = self.tag[k]
        if tag not in NAMEABLE or not (a := self.attributes(k)):
            return False
        if tag in ("article", "main") and "comment" not in self.attrs[k].lower():
            return False
        # generators give a section of an article its heading as id
        id_ = "" if inside and tag == "section" and headed else a.get("id", "")
        names = NAMES - {"header"} if inside else NAMES
        for token in (*a.get("class", "").split(), *id_.split()):
            words = {w.lower() for w in NAME_WORD.findall(token)}
            if words & names and words <= NAMES | BESIDE:
                return True
        return False

    def hashes(self) -> list[tuple[int, int]]:
        """(element, hash of its source) of the containers that may be template."""
        return [(k, xxhash.xxh64_intdigest(self.html[self.start[k]:self.end[k]].encode("utf-8", "surrogatepass")) - (1 << 63))
                for k in range(1, len(self.tag)) if self.tag[k] in CONTAINER and not self.holds[k] or not self.inside[k] and self.tag[k] == "p"]

    def text(self, template: frozenset | set = frozenset()) -> str:
        drop = list(self.named)
        if template:
            for k, h in self.hashes():
                if h in template:
                    drop[k] = True
        for k in range(1, len(drop)):
            drop[k] = drop[k] or drop[self.parent[k]]
        size = [0] * len(drop)  # characters of text straight below
        for item in self.items:
            if item is not None and not drop[item[0]]:
                size[item[0]] += len("".join(item[1].split()))
        content = [True] * len(drop)
        for hint in filter(None, self.hints):
            below = self.under(hint)
            if (held := sum(x for x, y in zip(size, below) if y)) and held >= MOST * sum(size):
                content = below
                break
        blocks, block = [], []
        for item in [*self.items, None]:
            if item is None:
                if block and (line := " ".join("".join(block).split())):
                    blocks.append(line)
                block = []
            elif content[item[0]] and not drop[item[0]]:
                block.append(unescape(item[1]) if "&" in item[1] else item[1])
        return "\n".join(blocks)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Written (host, hash): the container hashes that are template on each host."""

    def containers(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for url, html in zip(b["url"].tolist(), b["html"].tolist()):
                page, host = Page(html or ""), host_of(url)
                content = xxhash.xxh64_intdigest(page.text().encode("utf-8", "surrogatepass")) - (1 << 63)
                rows.add((host, None, content))
                rows.update((host, h, content) for _, h in page.hashes())
            host, hash_, content = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"host": pd.Series(host, dtype=object), "hash": pd.array(hash_, dtype="Int64"), "content": pd.array(content, dtype="int64")})

    found = materialise(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
                        .mapInPandas(containers, "host string, hash long, content long").distinct(), "containers")
    counts = found.groupBy("host", "hash").agg(F.count("*").alias("n"))
    size = counts.where("hash IS NULL").select("host", F.col("n").alias("contents"))
    bar = F.least(F.col("contents") * min_share, F.lit(ENOUGH_PAGES))
    many = counts.where(f"hash IS NOT NULL AND n >= {int(min_pages)}").join(size, "host").where(F.col("n") >= bar)
    return materialise(many.select("host", "hash"), "templates")


def own_templates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (host, html, ...) with the template hashes of each page itself, joined by host and hash."""

    @F.pandas_udf("array<long>")
    def containers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield pd.Series([list({x for _, x in Page(h).hashes()}) for h in html], dtype=object)

    page = [F.xxhash64("html").alias("_page"), F.sha2("html", 256).alias("_sha")]
    held = rows.select("host", *page, F.explode(containers("html")).alias("hash")).join(known, ["host", "hash"])
    held = held.groupBy("host", "_page", "_sha").agg(F.collect_set("hash").alias("hashes"))  # a page's containers at most
    return rows.select("*", *page).join(held, ["host", "_page", "_sha"], "left").drop("_page", "_sha")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    prepare_workers(pages)
    known = templates(pages, min_pages, min_share)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("host", host)
    few = known.count() <= BROADCAST_HASHES
    sent: dict[str, set[int]] = {}
    for r in known.toLocalIterator() if few else ():
        sent.setdefault(r["host"], set()).add(r["hash"])
    rows = rows.withColumn("hashes", F.lit(None).cast("array<long>")) if few else own_templates(rows, known)

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, hosts, hashes in batches:
            yield pd.Series([Page(h).text(sent.get(o, frozenset()) if t is None else frozenset(t.tolist())) for h, o, t in zip(html, hosts, hashes)], dtype=object)

    return rows.select("page_id", "url", extract("html", "host", "hashes").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
