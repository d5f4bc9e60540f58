"""URL and file-name rules as Column expressions (built-ins only, no UDF).

Every function takes and returns ``pyspark.sql.Column`` so it stays inside
whole-stage codegen and can be pushed below joins by Catalyst.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitemill.functions.text import settled

# ---------------------------------------------------------------------------
# Fixed values that must equal the migrated tool's behaviour.
# ---------------------------------------------------------------------------
# File extensions recognised as downloadable files (compared lower-case).
FILE_EXTENSIONS = ["png", "jpeg", "jpg", "gif", "tif", "pdf", "doc", "docx", "js", "css", "mp3", "mp4", "rtf"]
# Substrings that make a link ineligible for processing (case-sensitive).
DENY_SUBSTRINGS = ["library", "blog", "email-protection", "mailto:", "tel:", "captcha", "category"]
# Hosting-company domains whose links always count as internal (case-sensitive).
COMPANY_DOMAINS = ["baystonemedia.com", "officite.com", "therapysites.com"]
# Gallery images: URLs matching the first pattern get the second replaced by 'source'.
GALLERY_URL_PATTERN = "baystonemedia.*?image/gallery"
GALLERY_SIZE_PATTERN = "gallery.*?slide"
# Articles are never migrated as pages.
ARTICLE_MARKERS = ["articles/", "articles_dear_doctor/"]
# Media manager path appended to the site's media base.
MEDIA_PATH = "storage/app/media/"
# Suffix length stripped from the editor URL to get the site base (the editor
# URL ends in a 15-character path).
EDITOR_SUFFIX_LEN = 15
# Public suffixes known to the domain extractor (seed list; longest match wins).
PUBLIC_SUFFIXES = [
    "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "io", "co", "us", "ca",
    "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk",
    "au", "com.au", "net.au", "org.au", "nz", "co.nz", "de", "fr", "es", "it", "nl", "be", "ch", "at",
    "ie", "jp", "co.jp", "br", "com.br", "mx", "com.mx", "in", "co.in", "health", "dental", "dentist",
    "care", "clinic", "doctor", "online", "site", "website", "xyz", "test", "example", "local",
]

# RFC 3986 appendix B, with the scheme restricted to valid scheme characters
# (as Python's urlsplit does).
_URL_RX = r"^(([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#([\s\S]*))?$"


def _lit(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


# ---------------------------------------------------------------------------
# U1 URL split
# ---------------------------------------------------------------------------
def scheme(link) -> Column:
    """Lower-cased scheme, '' when absent."""
    return F.lower(F.regexp_extract(_lit(link), _URL_RX, 2))


def netloc(link) -> Column:
    """Authority part, '' when absent."""
    return F.regexp_extract(_lit(link), _URL_RX, 4)


def url_path(link) -> Column:
    return F.regexp_extract(_lit(link), _URL_RX, 5)


def url_query(link) -> Column:
    return F.regexp_extract(_lit(link), _URL_RX, 7)


def has_query(link) -> Column:
    return F.regexp_extract(_lit(link), _URL_RX, 6) != ""


def url_fragment(link) -> Column:
    return F.regexp_extract(_lit(link), _URL_RX, 9)


def host(link) -> Column:
    """Lower-cased host: netloc without userinfo and port."""
    n = netloc(link)
    n = F.substring_index(n, "@", -1)
    return F.lower(F.regexp_replace(n, r":[0-9]*$", ""))


# ---------------------------------------------------------------------------
# U2 registered domain
# ---------------------------------------------------------------------------
def domain_host(url) -> Column:
    """Lower-cased host of a URL whose scheme may be missing; userinfo and port dropped."""
    h = F.regexp_replace(_lit(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    h = F.regexp_extract(h, r"^([^/?#]*)", 1)
    h = F.substring_index(h, "@", -1)
    return F.lower(F.regexp_replace(h, r":[0-9]*$", ""))


def registered_domain(url) -> Column:
    """Registered domain by the seed suffixes alone, without a join.

    For a site context read off each page's own URL; where the suffix rules are
    a relation, see ``operators.domains``.
    """
    h = domain_host(url)
    labels = F.split(h, r"\.")
    n = F.size(labels)

    def suffix(k: int) -> Column:
        return F.array_join(F.slice(labels, -k, k), ".")

    def dom(k: int) -> Column:
        return F.concat(F.coalesce(F.try_element_at(labels, n - F.lit(k)), F.lit("")), F.lit("."), suffix(k))

    out = F.lit(None).cast("string")
    # longest matching suffix wins: check short ones first so long ones override
    for k in (1, 2, 3):
        out = F.when((n >= k) & suffix(k).isin(PUBLIC_SUFFIXES), dom(k)).otherwise(out)
    return F.coalesce(out, F.concat(F.try_element_at(labels, F.lit(-1)), F.lit(".")))


# ---------------------------------------------------------------------------
# U3 - U9 predicates
# ---------------------------------------------------------------------------
def is_relative(link, parts: "Parts | None" = None) -> Column:
    """True when the link has no network location."""
    return (parts.netloc if parts else netloc(link)) == ""


def is_internal(link, domain, parts: "Parts | None" = None) -> Column:
    """Ordered internal test (U4): domain or company host substring, then scheme, then relative."""
    n = parts.netloc if parts else netloc(link)
    s = parts.scheme if parts else scheme(link)
    by_host = F.lit(False)
    for d in COMPANY_DOMAINS:
        by_host = by_host | F.contains(n, F.lit(d))
    by_host = (n != "") & (F.contains(F.lower(n), _lit(domain)) | by_host)
    return (
        F.when(by_host, True)
        .when((s != "") & ~s.isin("http", "https"), False)
        .when(n == "", True)
        .otherwise(False)
    )


def file_name(link) -> Column:
    """Last '/' segment cut at '?' then '&' (U6)."""
    seg = F.substring_index(_lit(link), "/", -1)
    seg = F.substring_index(seg, "?", 1)
    return F.substring_index(seg, "&", 1)


def is_file(link) -> Column:
    """Extension of the last segment is a known file type."""
    ext = F.lower(F.substring_index(file_name(link), ".", -1))
    return F.contains(_lit(link), F.lit(".")) & ext.isin(FILE_EXTENSIONS)


def is_denied(link) -> Column:
    """Negation of the keep filter (U8): null/empty or containing a deny word."""
    c = _lit(link)
    bad = F.lit(False)
    for w in DENY_SUBSTRINGS:
        bad = bad | F.contains(c, F.lit(w))
    return c.isNull() | (F.length(c) == 0) | bad


def is_library(link) -> Column:
    """Link mentions the legacy library."""
    c = _lit(link)
    return c.isNotNull() & F.contains(c, F.lit("library"))


def is_article(link) -> Column:
    """Article links are never migrated."""
    c = _lit(link)
    return F.contains(c, F.lit(ARTICLE_MARKERS[0])) | F.contains(c, F.lit(ARTICLE_MARKERS[1]))


# ---------------------------------------------------------------------------
# U7 absolute URL (urljoin against the site home URL)
# ---------------------------------------------------------------------------
def _remove_dot_segments(segments: Column) -> Column:
    """Resolve '.' and '..' segments with a fold (no recursion, no UDF)."""
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.array_append(acc, seg)),
    )
    last = F.try_element_at(segments, F.lit(-1))
    return F.when(last.isin(".", ".."), F.array_append(folded, F.lit(""))).otherwise(folded)


class Parts:
    """The five URL components as Columns."""

    def __init__(self, scheme, netloc, path, query, has_query, fragment):
        self.scheme, self.netloc, self.path = scheme, netloc, path
        self.query, self.has_query, self.fragment = query, has_query, fragment

    @staticmethod
    def of(link) -> "Parts":
        """Parts computed inline (fine for one-off use)."""
        c = _lit(link)
        return Parts(scheme(c), netloc(c), url_path(c), url_query(c), has_query(c), url_fragment(c))

    @staticmethod
    def cols(prefix: str) -> "Parts":
        """Parts read from columns added by ``with_parts``."""
        return Parts(*(F.col(f"{prefix}_{n}") for n in ("scheme", "netloc", "path", "query", "hasq", "frag")))


def with_parts(df, link_col: str, prefix: str):
    """Materialise a URL's components as columns once, so later rules refer to
    them instead of re-running the split regex (keeps generated code small)."""
    c = F.col(link_col)
    parts = {"scheme": scheme(c), "netloc": netloc(c), "path": url_path(c), "query": url_query(c), "hasq": has_query(c), "frag": url_fragment(c)}
    return df.withColumns({f"{prefix}_{name}": settled(part) for name, part in parts.items()})


def absolute(base, link, base_parts: Parts | None = None, link_parts: Parts | None = None) -> Column:
    """Join ``link`` onto ``base`` the way a browser (RFC 3986) resolves it."""
    b, l_ = _lit(base), _lit(link)
    bp_ = base_parts or Parts.of(b)
    lp_ = link_parts or Parts.of(l_)
    bs, bn, bp, bq = bp_.scheme, bp_.netloc, bp_.path, bp_.query
    ls, ln, lp, lq, lf = lp_.scheme, lp_.netloc, lp_.path, lp_.query, lp_.fragment
    eff_scheme = F.when(ls == "", bs).otherwise(ls)

    def unsplit(sch, net, path, query, frag) -> Column:
        path = F.when((net != "") & (path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
        return F.concat(
            sch, F.lit(":"),
            F.when(net != "", F.concat(F.lit("//"), net)).otherwise(F.lit("")),
            path,
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
            F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")),
        )

    base_dir = F.split(bp, "/")
    base_dir = F.when(F.try_element_at(base_dir, F.lit(-1)) != "", F.slice(base_dir, 1, F.size(base_dir) - 1)).otherwise(base_dir)
    rel_segments = F.concat(base_dir, F.split(lp, "/"))
    # drop empty segments strictly between the first and the last
    n = F.size(rel_segments)
    rel_segments = F.concat(
        F.slice(rel_segments, 1, 1),
        F.filter(F.slice(rel_segments, 2, F.greatest(n - 2, F.lit(0))), lambda s: s != ""),
        F.when(n > 1, F.slice(rel_segments, -1, 1)).otherwise(F.array().cast("array<string>")),
    )
    segments = F.when(F.startswith(lp, F.lit("/")), F.split(lp, "/")).otherwise(rel_segments)
    joined = F.array_join(_remove_dot_segments(segments), "/")
    joined = F.when(joined == "", F.lit("/")).otherwise(joined)

    return (
        F.when(l_.isNull(), F.lit(None))
        .when(l_ == "", b)
        .when((eff_scheme != bs) | ~eff_scheme.isin("http", "https"), l_)
        .when(ln != "", unsplit(eff_scheme, ln, lp, lq, lf))
        .when(lp == "", unsplit(eff_scheme, bn, bp, F.when(lp_.has_query & (lq != ""), lq).otherwise(bq), lf))
        .otherwise(unsplit(eff_scheme, bn, joined, lq, lf))
    )


# ---------------------------------------------------------------------------
# U10 - U16 rewrites
# ---------------------------------------------------------------------------
def sanitize_filename(name) -> Column:
    """Media-manager-safe file name (U10); null for an empty result instead of failing."""
    s = F.regexp_replace(_lit(name), r"\s+", "-")
    s = F.regexp_replace(s, "_+", "-")
    s = F.regexp_replace(s, "-+", "-")
    s = F.regexp_replace(s, r"[^a-zA-Z0-9.\-]", "")
    cut = (
        F.when(F.startswith(s, F.lit("-")), F.substring(s, 2, 1 << 30))
        .when(F.endswith(s, F.lit("-")), F.left(s, F.length(s) - 1))
        .otherwise(s)
    )
    return F.when(F.length(s) == 0, F.lit(None)).otherwise(F.lower(cut))


def http_prefix(url) -> Column:
    """'https:' when the URL mentions it, else 'http:' (U11)."""
    return F.when(F.contains(_lit(url), F.lit("https:")), F.lit("https:")).otherwise(F.lit("http:"))


def with_scheme(link, site_url) -> Column:
    """Prefix the site's scheme when 'http' is not in the link."""
    c = _lit(link)
    return F.when(~F.contains(c, F.lit("http")), F.concat(http_prefix(site_url), c)).otherwise(c)


def cut_trailing_slash(c) -> Column:
    """Remove one trailing '/' (U13)."""
    return F.regexp_replace(_lit(c), "/$", "")


def encode_spaces(c) -> Column:
    """Spaces to %20."""
    return F.replace(_lit(c), F.lit(" "), F.lit("%20"))


def gallery_source(c) -> Column:
    """Full-size gallery image instead of the slide rendition."""
    x = _lit(c)
    return F.when(F.regexp_like(x, F.lit(GALLERY_URL_PATTERN)), F.regexp_replace(x, GALLERY_SIZE_PATTERN, "source")).otherwise(x)


def logo_cdn_rewrite(logo_src, site_url, cdn: str = "cdcssl.ibsrv.net") -> Column:
    """Logos served from the CDN become media paths under the site (U16)."""
    src, site = _lit(logo_src), _lit(site_url)
    base = F.when(F.endswith(site, F.lit("/")), site).otherwise(F.concat(site, F.lit("/")))
    return F.when(
        F.contains(src, F.lit(cdn)),
        F.concat(base, F.lit(MEDIA_PATH), F.substring_index(src, "/", -1)),
    ).otherwise(src)


def media_url(media_base, name) -> Column:
    """Media-manager URL of a sanitised file name."""
    return F.concat(_lit(media_base), _lit(name))


def media_base_from_editor(editor_url) -> Column:
    """Editor URL minus its 15-character suffix, plus the media path (S3).

    The scheme is forced to https by rewriting a leading 'http:' only (the
    original replaced every 'http', turning 'https' into 'httpss').
    """
    e = F.regexp_replace(_lit(editor_url), "^http:", "https:")
    return F.concat(F.left(e, F.length(e) - EDITOR_SUFFIX_LEN), F.lit(MEDIA_PATH))


def with_link_facts(df, link_col: str, base_col: str, domain_col: str | None, prefix: str):
    """Add ``{prefix}_rel``, ``_internal``, ``_file`` and ``_abs`` for a link column.

    The URL components of the link and of the base are materialised once as
    columns (``settled``), so the rules below reuse them instead of
    re-running the split regex per rule.
    """
    lp, bp = f"_{prefix}_l", f"_{prefix}_b"
    lc, bc = F.col(link_col), F.col(base_col)
    parts = {}
    for pre, c in ((lp, lc), (bp, bc)):
        parts.update({f"{pre}_scheme": scheme(c), f"{pre}_netloc": netloc(c), f"{pre}_path": url_path(c),
                      f"{pre}_query": url_query(c), f"{pre}_hasq": has_query(c), f"{pre}_frag": url_fragment(c)})
    d = df.withColumns({k: settled(v) for k, v in parts.items()})
    L, Bp = Parts.cols(lp), Parts.cols(bp)
    facts = {f"{prefix}_rel": is_relative(lc, L), f"{prefix}_file": is_file(lc)}
    if domain_col is not None:
        facts[f"{prefix}_internal"] = is_internal(lc, F.col(domain_col), L)
    d = d.withColumns({k: settled(v) for k, v in facts.items()})
    d = d.withColumn(f"{prefix}_abs", settled(F.when(F.col(f"{prefix}_rel"), absolute(bc, lc, Bp, L)).otherwise(lc)))
    return d.drop(*[c for c in d.columns if c.startswith(lp + "_") or c.startswith(bp + "_")])
