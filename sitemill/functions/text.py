"""Text scalars: character references, slugs, stems, title case, SEO truncation."""
from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------
# Letters, without their accents, that are no ASCII letter: what stands for them in slugs.
LETTERS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ŋ": "ng", "ħ": "h", "ŧ": "t", "ĸ": "k", "ŀ": "l", "ĳ": "ij",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o",
    "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "ph", "χ": "ch", "ψ": "ps", "ω": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia",
    "є": "ie", "і": "i", "ґ": "g", "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz", "ѕ": "z",
}
# Blocks whose letters are folded: Latin with accents, combining marks, Greek, Cyrillic, further Latin and Greek.
FOLDED_BLOCKS = [(0xC0, 0x250), (0x300, 0x370), (0x370, 0x400), (0x400, 0x500), (0x1E00, 0x2000)]
# SEO limits: at most 8 comma phrases and 299 characters of keywords,
# 495 characters of description; hours set names use 40 characters + ' Hours'.
KEYWORD_PHRASES = 8
KEYWORD_CHARS = 299
DESCRIPTION_CHARS = 495
# Character references: named ones with or without ';', and numeric ones. A '=' is taken along because it
# keeps an unfinished reference in an attribute from being one.
REFERENCE_RX = r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*[;=]?)|[^&]+|&"
# The names that need no ';' have at most so many letters, at least so many.
LEGACY_LETTERS, LEAST_LETTERS = 6, 2


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def settled(value: Column) -> Column:
    """``value``, computed where it stands, once.

    The optimizer copies an expression into each filter and projection above it, which for chains of
    regular expressions multiplies their cost. It doesn't move what depends on the partition,
    and still drops the column where nothing reads it.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _dictionary(table: dict[str, str]) -> Column:
    """A constant map, from two literals."""
    words = [F.split(F.lit("\x01".join(x)), "\x01") for x in (table.keys(), table.values())]
    return F.map_from_arrays(*words)


def _numeric(ref: Column) -> Column:
    """The character of a numeric reference; what is no character becomes U+FFFD."""
    hexadecimal = F.lower(F.substring(ref, 3, 1)) == "x"
    # of longer numbers the leading digits are too large already
    code = F.when(hexadecimal, F.conv(F.regexp_extract(ref, "[xX]0*([0-9a-fA-F]{1,8})", 1), 16, 10)).otherwise(F.regexp_extract(ref, "0*([0-9]{1,10})", 1)).cast("long")
    return _once(code, lambda c: F.decode(F.unhex(F.lpad(F.hex(F.when(((c > 0) & (c < 0xD800)) | ((c > 0xDFFF) & (c <= 0x10FFFF)), c).otherwise(F.lit(0xFFFD).cast("long"))), 8, "0")), "UTF-32"))


def _named(ref: Column, names: Column, attribute: bool) -> Column:
    """A named reference by the longest name it begins with; in an attribute the name must end it, and no '=' may follow."""
    name = lambda k: F.element_at(names, F.substring(ref, 2, k))
    common = F.when(ref == "&amp;", "&").when(ref == "&nbsp;", "\u00a0").when(ref == "&quot;", '"').when(ref == "&lt;", "<").when(ref == "&gt;", ">")
    # names that need a ';' have it in the table, so nothing else can begin with one
    if attribute:
        begins = [name(1 << 30)]
    else:
        begins = [name(1 << 30)] + [F.concat(name(k), F.substring(ref, k + 2, 1 << 30)) for k in range(LEGACY_LETTERS, LEAST_LETTERS - 1, -1)]
    return F.coalesce(common, *begins, ref)


def decode_references(c, attribute: bool = False) -> Column:
    """Character references of HTML, each decoded once; what is none stays as it is."""
    def decoded(text: Column, names: Column) -> Column:
        piece = lambda p: F.when(F.startswith(p, F.lit("&#")), _numeric(p)).when(F.startswith(p, F.lit("&")) & (F.length(p) > 1), _named(p, names, attribute)).otherwise(p)
        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE_RX), 0), piece), "")
    return _once(_c(c), lambda text: F.when(F.contains(text, F.lit("&")), _once(_dictionary(html5), lambda names: decoded(text, names))).otherwise(text))


def _folding() -> dict[str, str]:
    """Letter -> lower-case ASCII letters, for every letter of ``FOLDED_BLOCKS`` that has some."""
    out = {}
    for ch in (chr(c) for a, b in FOLDED_BLOCKS for c in range(a, b)):
        bare = "".join(x for x in unicodedata.normalize("NFD", ch) if not unicodedata.combining(x)).lower()
        folded = "".join(LETTERS.get(x, x) for x in bare)
        if folded.isascii() and (folded.isalpha() or not bare or bare in LETTERS):
            out[ch] = folded
    return out


def fold_letters(c) -> Column:
    """Accents removed, letters of other alphabets in ASCII (``straße`` -> ``strasse``); other characters stay."""
    table = _folding()
    piece = lambda p: F.coalesce(F.element_at(_dictionary(table), p), p)
    return _once(_c(c), lambda text: F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), 0), piece), "")).otherwise(text))


def slugify(text) -> Column:
    """Letters to ASCII, lower, non-alphanumeric runs to '-', trim '-' (T1)."""
    s = F.regexp_replace(F.lower(fold_letters(text)), "[^a-z0-9]+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def path_stem(url_or_path) -> Column:
    """Last path segment up to its first '.' (T2)."""
    from sitemill.functions.urls import url_path

    seg = F.substring_index(url_path(url_or_path), "/", -1)
    return F.substring_index(seg, ".", 1)


def digit_runs(c) -> Column:
    """Split at digit runs, keeping both kinds of run, no empties."""
    return F.regexp_extract_all(_c(c), F.lit(r"[0-9]+|[^0-9]+"), 0)


def title_case(c) -> Column:
    """Upper-case each letter that follows a non-letter, lower the rest (T5).

    Matches Python's ``str.title`` on ASCII: ``top10tips`` -> ``Top10Tips``.
    """
    runs = F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z]+|[^a-z]+"), 0)
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, 2, 1 << 30))),
        "",
    )


def truncate_keywords(c) -> Column:
    """First 8 comma phrases, then at most 299 characters."""
    parts = F.split(_c(c), ",")
    return F.left(F.array_join(F.slice(parts, 1, KEYWORD_PHRASES), ","), F.lit(KEYWORD_CHARS))


def truncate_description(c) -> Column:
    return F.left(_c(c), F.lit(DESCRIPTION_CHARS))
