"""DuckDB SQL fragments for the oracle queries.

These mirror the Column rules in ``sitemill.functions`` as plain SQL text so
each registered query can be checked by an independent engine.  Every
function takes a SQL expression string and returns one.
"""
from __future__ import annotations

from html.entities import name2codepoint

from sitemill.functions import text as TX
from sitemill.functions import urls as U
from sitemill.operators import html as H


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


URL_RX = q(U._URL_RX)
#: H1 as this engine's patterns have it: the same alternatives, without possessive quantifiers.
TOKEN_RX = q(r"<!--[\s\S]*?(?:-->|\z)|<![^>]*(?:>|\z)|(?i:<script[\s/>][\s\S]*?(?:</script\s*>|\z))|(?i:<style[\s/>][\s\S]*?(?:</style\s*>|\z))"
             r"|</?[A-Za-z][^>=]*(?:=\s*(?:\"[^\"]*\"|'[^']*')?[^>=]*)*(?:>|\z)|[^<]+|<")


def scheme(x): return f"lower(regexp_extract({x}, {URL_RX}, 2))"
def netloc(x): return f"regexp_extract({x}, {URL_RX}, 4)"
def path(x): return f"regexp_extract({x}, {URL_RX}, 5)"
def query(x): return f"regexp_extract({x}, {URL_RX}, 7)"
def has_query(x): return f"(regexp_extract({x}, {URL_RX}, 6) <> '')"
def fragment(x): return f"regexp_extract({x}, {URL_RX}, 9)"
def last_seg(x, sep): return f"string_split({x}, {q(sep)})[-1]"
def first_seg(x, sep): return f"string_split({x}, {q(sep)})[1]"


def host(x):
    return f"lower(regexp_replace({last_seg(netloc(x), '@')}, ':[0-9]*$', ''))"


def registered_domain(x):
    h = (f"lower(regexp_replace({last_seg(regexp_extract_prefix(x), '@')}, ':[0-9]*$', ''))")
    labels = f"string_split({h}, '.')"
    n = f"len({labels})"

    def suffix(k):
        return f"array_to_string({labels}[{n}-{k}+1:], '.')"

    def dom(k):
        return f"(coalesce({labels}[{n}-{k}], '') || '.' || {suffix(k)})"

    ps = inlist(U.PUBLIC_SUFFIXES)
    return (
        f"coalesce(CASE WHEN {n} >= 3 AND {suffix(3)} IN {ps} THEN {dom(3)} "
        f"WHEN {n} >= 2 AND {suffix(2)} IN {ps} THEN {dom(2)} "
        f"WHEN {n} >= 1 AND {suffix(1)} IN {ps} THEN {dom(1)} END, {labels}[-1] || '.')"
    )


def regexp_extract_prefix(x):
    return f"regexp_extract(regexp_replace({x}, '^[A-Za-z][A-Za-z0-9+.\\-]*://', ''), '^([^/?#]*)', 1)"


def is_relative(x): return f"({netloc(x)} = '')"


def is_internal(x, domain):
    n = netloc(x)
    comp = " OR ".join(f"contains({n}, {q(d)})" for d in U.COMPANY_DOMAINS)
    return (
        f"(CASE WHEN {n} <> '' AND (contains(lower({n}), {domain}) OR {comp}) THEN true "
        f"WHEN {scheme(x)} <> '' AND {scheme(x)} NOT IN ('http', 'https') THEN false "
        f"WHEN {n} = '' THEN true ELSE false END)"
    )


def file_name(x):
    return first_seg(first_seg(last_seg(x, "/"), "?"), "&")


def is_file(x):
    return f"(contains({x}, '.') AND lower({last_seg(file_name(x), '.')}) IN {inlist(U.FILE_EXTENSIONS)})"


def is_denied(x):
    bad = " OR ".join(f"contains({x}, {q(w)})" for w in U.DENY_SUBSTRINGS)
    return f"({x} IS NULL OR length({x}) = 0 OR {bad})"


def is_article(x):
    return f"(contains({x}, {q(U.ARTICLE_MARKERS[0])}) OR contains({x}, {q(U.ARTICLE_MARKERS[1])}))"


def _bound(x, name, body):
    """``body`` with ``name`` standing for ``x``, which is written once."""
    return f"list_transform([{x}], lambda {name}: {body})[1]"


#: The names of HTML 4, which all of the tables' references are among; those below U+0100 need no ';'.
_NAMES = "MAP {" + ", ".join(f"{q(k)}: {q(chr(v))}" for k, v in name2codepoint.items()) + "}"


def decode_references(x, attribute=False):
    code = ("(CASE WHEN lower(substring(_p, 3, 1)) = 'x' THEN try_cast('0x' || regexp_extract(_p, '[xX]([0-9a-fA-F]+)', 1) AS BIGINT) "
            "ELSE try_cast(regexp_extract(_p, '([0-9]+)', 1) AS BIGINT) END)")
    char = _bound(code, "_k", "CASE WHEN (_k > 0 AND _k < 55296) OR (_k > 57343 AND _k <= 1114111) THEN chr(CAST(_k AS INTEGER)) ELSE chr(65533) END")
    sizes = "[100]" if attribute else "[6, 5, 4, 3, 2]"
    begins = (f"list_filter(list_transform({sizes}, lambda _n: CASE WHEN unicode(_m[substring(_p, 2, _n)]) < 256 OR substring(_p, 2, _n) IN ('lt', 'gt') "
              f"THEN _m[substring(_p, 2, _n)] || substring(_p, _n + 2) END), lambda _d: _d IS NOT NULL)[1]")
    named = _bound(_NAMES, "_m", f"coalesce(CASE WHEN ends_with(_p, ';') THEN _m[rtrim(substring(_p, 2), ';')] END, {begins}, _p)")
    piece = f"CASE WHEN starts_with(_p, '&#') THEN {char} WHEN NOT starts_with(_p, '&') OR length(_p) = 1 THEN _p ELSE {named} END"
    rx = q(r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*[;=]?)|[^&]+|&")
    return _bound(x, "_s", f"CASE WHEN contains(_s, '&') THEN array_to_string(list_transform(regexp_extract_all(_s, {rx}), lambda _p: {piece}), '') ELSE _s END")


def attribute(raw, name):
    v = f"regexp_extract({raw}, {q(H._attr_rx(name))}, 1)"
    unq = "(CASE WHEN starts_with(_v, '\"') OR starts_with(_v, '''') THEN substring(_v, 2, length(_v) - 2) ELSE _v END)"
    return _bound(v, "_v", f"CASE WHEN _v = '' THEN NULL ELSE {decode_references(unq, attribute=True)} END")


def tag_name(raw):
    return f"lower(regexp_extract({raw}, {q(H.TAG_NAME_RX)}, 1))"


def kind(raw):
    t = tag_name(raw)
    return (
        f"(CASE WHEN starts_with({raw}, '<!--') THEN 'comment' WHEN starts_with({raw}, '<!') THEN 'decl' "
        f"WHEN {t} IN ('script', 'style') AND NOT starts_with({raw}, '</') AND contains({raw}, '>') THEN 'raw' "
        f"WHEN length({t}) > 0 AND NOT ends_with({raw}, '>') THEN 'cut' "
        f"WHEN length({t}) > 0 AND starts_with({raw}, '</') THEN 'close' WHEN length({t}) > 0 THEN 'open' ELSE 'text' END)"
    )


def sanitize_filename(x):
    s = f"regexp_replace({x}, '\\s+', '-', 'g')"
    s = f"regexp_replace({s}, '_+', '-', 'g')"
    s = f"regexp_replace({s}, '-+', '-', 'g')"
    s = f"regexp_replace({s}, '[^a-zA-Z0-9.\\-]', '', 'g')"
    cut = f"(CASE WHEN starts_with({s}, '-') THEN substring({s}, 2) WHEN ends_with({s}, '-') THEN left({s}, length({s}) - 1) ELSE {s} END)"
    return f"(CASE WHEN length({s}) = 0 THEN NULL ELSE lower({cut}) END)"


def http_prefix(x):
    return f"(CASE WHEN contains({x}, 'https:') THEN 'https:' ELSE 'http:' END)"


def with_scheme(x, site_url):
    return f"(CASE WHEN NOT contains({x}, 'http') THEN {http_prefix(site_url)} || {x} ELSE {x} END)"


def gallery_source(x):
    return (f"(CASE WHEN regexp_matches({x}, {q(U.GALLERY_URL_PATTERN)}) "
            f"THEN regexp_replace({x}, {q(U.GALLERY_SIZE_PATTERN)}, 'source', 'g') ELSE {x} END)")


def encode_spaces(x):
    return f"replace({x}, ' ', '%20')"


def fold_letters(x):
    """Lower-cased, without accents, other letters as their ASCII ones."""
    s = f"strip_accents(lower({x}))"
    for letter, ascii_letters in TX.LETTERS.items():
        s = f"replace({s}, {q(letter)}, {q(ascii_letters)})"
    return s


def slugify(x):
    s = f"regexp_replace({fold_letters(x)}, '[^a-z0-9]+', '-', 'g')"
    return f"regexp_replace({s}, '^-+|-+$', '', 'g')"


def path_stem(x):
    return first_seg(last_seg(path(x), "/"), ".")


def title_case(x):
    runs = f"regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+')"
    return f"array_to_string(list_transform({runs}, lambda r: upper(left(r, 1)) || substring(r, 2)), '')"


def origin(x):
    return f"({scheme(x)} || '://' || {netloc(x)} || '/')"


def absolute(base, link):
    """urljoin in SQL: same case analysis as ``urls.absolute``."""
    bs, bn, bp, bq = scheme(base), netloc(base), path(base), query(base)
    ls, ln, lp, lq, lf = scheme(link), netloc(link), path(link), query(link), fragment(link)
    eff = f"(CASE WHEN {ls} = '' THEN {bs} ELSE {ls} END)"

    def unsplit(sch, net, pth, qry, frag):
        pth2 = f"(CASE WHEN {net} <> '' AND {pth} <> '' AND NOT starts_with({pth}, '/') THEN '/' || {pth} ELSE {pth} END)"
        return (f"({sch} || ':' || (CASE WHEN {net} <> '' THEN '//' || {net} ELSE '' END) || {pth2} "
                f"|| (CASE WHEN {qry} <> '' THEN '?' || {qry} ELSE '' END) "
                f"|| (CASE WHEN {frag} <> '' THEN '#' || {frag} ELSE '' END))")

    bdir0 = f"string_split({bp}, '/')"
    bdir = f"(CASE WHEN {bdir0}[-1] <> '' THEN {bdir0}[1:len({bdir0})-1] ELSE {bdir0} END)"
    rel0 = f"list_concat({bdir}, string_split({lp}, '/'))"
    rel = (f"(CASE WHEN len({rel0}) > 1 THEN list_concat({rel0}[1:1], "
           f"list_filter({rel0}[2:len({rel0})-1], lambda s: s <> ''), {rel0}[len({rel0}):len({rel0})]) ELSE {rel0} END)")
    segs = f"(CASE WHEN starts_with({lp}, '/') THEN string_split({lp}, '/') ELSE {rel} END)"
    folded = (f"list_reduce({segs}, lambda acc, s: CASE WHEN s = '..' THEN acc[1:greatest(len(acc) - 1, 0)] "
              f"WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])")
    folded = f"(CASE WHEN {segs}[-1] IN ('.', '..') THEN list_append({folded}, '') ELSE {folded} END)"
    joined0 = f"array_to_string({folded}, '/')"
    joined = f"(CASE WHEN {joined0} = '' THEN '/' ELSE {joined0} END)"
    qsel = f"(CASE WHEN {has_query(link)} AND {lq} <> '' THEN {lq} ELSE {bq} END)"
    return (
        f"(CASE WHEN {link} IS NULL THEN NULL WHEN {link} = '' THEN {base} "
        f"WHEN {eff} <> {bs} OR {eff} NOT IN ('http', 'https') THEN {link} "
        f"WHEN {ln} <> '' THEN {unsplit(eff, ln, lp, lq, lf)} "
        f"WHEN {lp} = '' THEN {unsplit(eff, bn, bp, qsel, lf)} "
        f"ELSE {unsplit(eff, bn, joined, lq, lf)} END)"
    )
