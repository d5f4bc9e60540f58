"""Golden vectors for the URL and text rules (derived by reading the original code)."""
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from sitemill.functions import text as TX
from sitemill.functions import urls as U

SITE = "https://www.example.com/"


def one(spark, col_fn, values, col_type="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {col_type}")
    return [r[0] for r in df.select(col_fn(F.col("v"))).collect()]


def test_registered_domain_shapes(spark):
    got = one(spark, U.registered_domain, [
        "brightsmile.org",
        "https://shop.north.harbour-dental.com/team/index.php?id=7&lang=en%20gb",
        "desk:secret@mail.harbour-dental.com",
        "sftp://files.oakroad.org.uk/a/b.txt",
    ])
    assert got == ["brightsmile.org", "harbour-dental.com", "harbour-dental.com", "oakroad.org.uk"]


def test_is_internal(spark):
    links = ["#", "", "/a", "HTTP://EXAMPLE.com/a", "http://notexample.com/", "mailto:a@b.c", "javascript:x",
             "http://other.com/", "https://cdn.officite.com/x"]
    got = one(spark, lambda c: U.is_internal(c, F.lit("example.com")), links)
    assert got == [True, True, True, True, True, False, False, False, True]


def test_is_file(spark):
    links = ["/docs/a.PDF?x=1", "/a.pdf#p2", "http://x.com/pdf", "/pdf", "/a.svg", "/a?f=x/b.png"]
    assert one(spark, U.is_file, links) == [True, False, True, False, False, True]


def test_file_name(spark):
    assert one(spark, U.file_name, ["/x/a.png?v=1&w=2"]) == ["a.png"]


def test_absolute_golden(spark):
    got = one(spark, lambda c: U.absolute(F.lit(SITE), c), ["", "#", "../x", "//h/a", "?q=1"])
    assert got == [SITE, SITE, "https://www.example.com/x", "https://h/a", "https://www.example.com/?q=1"]


@pytest.mark.parametrize("base", ["https://www.example.com/", "http://h.test/a/b/", "http://h.test/a/b?q=2"])
def test_absolute_matches_urljoin(spark, base):
    """Brute force: the column rule agrees with the standard library on many shapes."""
    links = ["a", "a/b", "./a", "../a", "../../../a", "/a/./b/../c", "a//b", "a/", ".", "..", "?x", "#f",
             "//other.test/p", "https://other.test/p?q#f", "mailto:x@y.z", "a?b#c", "/", "b/../../c", "x/./y/",
             "http://www.example.com/z", "tel:123", "a b.png", "/a b/c"]
    got = one(spark, lambda c: U.absolute(F.lit(base), c), links)
    assert got == [urljoin(base, link) for link in links]


def test_deny_and_library(spark):
    links = ["/Library", "/library/x", "/blogger", "", "/ok", "tel:1", "/x?captcha=1"]
    assert one(spark, lambda c: ~U.is_denied(c), links) == [True, False, False, False, True, False, False]
    assert one(spark, U.is_library, ["/library/x", "/Library"]) == [True, False]


def test_sanitize_filename(spark):
    names = ["My  File__name.PDF", "-a-.png", "-a-", "a-%-b.png", "%%"]
    assert one(spark, U.sanitize_filename, names) == ["my-file-name.pdf", "a-.png", "a-", "a--b.png", None]


def test_scheme_rules(spark):
    df = spark.createDataFrame([("/x", "https://s.test/"), ("http://a/x", "https://s.test/"), ("/y", "http://s.test/")], "l string, s string")
    got = [r[0] for r in df.select(U.with_scheme(F.col("l"), F.col("s"))).collect()]
    assert got == ["https:/x", "http://a/x", "http:/y"]


def test_gallery_and_cdn(spark):
    got = one(spark, U.gallery_source, ["http://baystonemedia.com/image/gallery/a/slide/x.jpg", "http://x/gallery/slide"])
    assert got == ["http://baystonemedia.com/image/source/x.jpg", "http://x/gallery/slide"]
    got = one(spark, lambda c: U.logo_cdn_rewrite(c, F.lit("https://s.test")), ["https://cdcssl.ibsrv.net/a/logo.png", "/x.png"])
    assert got == ["https://s.test/storage/app/media/logo.png", "/x.png"]


def test_media_base_fixes_double_s(spark):
    got = one(spark, U.media_base_from_editor, ["http://h.test/backend/editor/", "https://h.test/backend/editor/"])
    assert got == ["https://h.test/storage/app/media/"] * 2


def test_text_rules(spark):
    assert one(spark, TX.slugify, ["Implants & Crowns", "  Über Café!! ", "top10tips"]) == ["implants-crowns", "uber-cafe", "top10tips"]
    assert one(spark, TX.title_case, ["top10 tips", "top10tips a"]) == ["Top10 Tips", "Top10Tips A"]
    assert one(spark, TX.path_stem, ["http://h/a/b/services.html?x", "/x/faq2.html/"]) == ["services", ""]
    assert one(spark, TX.digit_runs, ["implantfaq2x"]) == [["implantfaq", "2", "x"]]
    kw = ",".join("abcdefghij")
    assert one(spark, TX.truncate_keywords, [kw, "x" * 400]) == ["a,b,c,d,e,f,g,h", "x" * 299]
    assert one(spark, TX.decode_references, ["a &amp;lt; &lt;b&gt; &quot;c&quot; &#39;"]) == ["a &lt; <b> \"c\" '"]


def test_character_references(spark):
    from sitemill.functions import text as T

    got = one(spark, T.decode_references, ["Patient&#8217;s&nbsp;Info", "a &amp;#39; b", "&#x1F600;&#X41;", "&#0;&#xD800;&#1114112;x", "no refs", "&lt;b&gt; &amp;lt;", "&# &#; &#x;", "caf&eacute; &#233;"])
    assert got == ["Patient\u2019s\u00a0Info", "a &#39; b", "\U0001F600A", "\ufffd\ufffd\ufffdx", "no refs", "<b> &lt;", "&# &#; &#x;", "caf\u00e9 \u00e9"]


def test_references_are_decoded_once_by_the_longest_name(spark):
    cases = {"&Aacute;&aacute": "Áá", "&copy 2020": "© 2020", "&#38;lt;": "&lt;", "&amp;copy;": "&copy;", "&notit; &notin;": "¬it; ∉", "&nosuch; &": "&nosuch; &",
             "&CounterClockwiseContourIntegral;": "∳", "&#00000000000065;&#x0000000000042;": "AB", "&#99999999999999999999;&#xFFFFFFFFFFFF;": "��", "&#;&#x;&;": "&#;&#x;&;",
             "x&gt": "x>", "&ampersand": "&ersand", "&frac12x": "½x"}
    assert one(spark, TX.decode_references, list(cases)) == list(cases.values())
    inside = {"?a=1&copy=2": "?a=1&copy=2", "?a=1&copy2": "?a=1&copy2", "?a&copy": "?a©", "?a&copy;=2": "?a©=2", "?a&amp;b=&lt": "?a&b=<", "&notit;": "&notit;"}
    assert one(spark, lambda c: TX.decode_references(c, attribute=True), list(inside)) == list(inside.values())


def test_letters_of_other_alphabets(spark):
    cases = {"Straße": "strasse", "Œuvre Ærø": "oeuvre-aero", "ŁÓDŹ": "lodz", "Ελλάδα": "ellada", "Щука Жёлтый": "shchuka-zheltyi", "Ω漢字a": "o-a",
             "Việt Nam": "viet-nam", "été": "ete", "İstanbul ıı": "istanbul-ii", "объект": "obekt"}
    assert one(spark, TX.slugify, list(cases)) == list(cases.values())
    assert one(spark, TX.fold_letters, [None, "", "plain"]) == [None, "", "plain"]


def test_suffix_rules(spark):
    from sitemill.operators import domains as D

    rules = ["// list", "com", "uk", "co.uk", "*.ck", "!www.ck", "", "jp", "kobe.jp", "*.kobe.jp", "!city.kobe.jp", "CO.UK", "a.b.c.d"]
    hosts = {"example.com": "example.com", "a.b.example.com": "example.com", "x.co.uk": "x.co.uk", "co.uk": ".co.uk", "uk": ".uk", "shop.x.ck": "shop.x.ck", "x.ck": ".x.ck",
             "www.ck": "www.ck", "a.www.ck": "www.ck", "x.b.kobe.jp": "x.b.kobe.jp", "city.kobe.jp": "city.kobe.jp", "y.city.kobe.jp": "city.kobe.jp",
             "nowhere": "nowhere.", "a.nowhere": "nowhere.", "z.a.b.c.d": "z.a.b.c.d", "EXAMPLE.com.": "example.com", "": ".", "127.0.0.1": "1."}
    df = spark.createDataFrame([(h,) for h in hosts] * 2 + [(None,)], "host string")
    got = {r["host"]: r["domain"] for r in D.registered_domains(df, spark.createDataFrame([(r,) for r in rules], "rule string")).collect()}
    assert got == {h.lower().rstrip("."): d for h, d in hosts.items()}
    urls = spark.createDataFrame([(1, "https://u:p@a.x.co.uk:8080/p"), (2, None), (3, "x.ck")], "k int, url string")
    joined = D.with_domain(urls, "url", spark.createDataFrame([(r,) for r in rules], "rule string"))
    assert sorted(map(tuple, joined.select("k", "domain").collect())) == [(1, "x.co.uk"), (2, None), (3, ".x.ck")]
