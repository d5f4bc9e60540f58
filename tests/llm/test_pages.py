"""URL verdicts, main text and licence notices."""
import random
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from sitemill.llm import license_scan as L
from sitemill.llm import page_text as P
from sitemill.llm import url_filter as U

PAGE = "page_id long, url string, html string, host string, n int"


def _rule(url):
    """The rules, read plainly."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [None, "", "nothing", "http://", "http:///x", "https://A.EXAMPLE.org/en/12", "http://example.org/es/1", "http://example.org/es", "http://b.example.org/en/1?x=/es/", "x://com/de/",
        "ftp://u@x.com:80/fr/#a", "http://org", "http://org/", "http://notorg/x", "http://a.b.com/de/7://y", "http://Z.net/en/1/2/3/4/5/6", "http://z.net?q", "http://é.net/é/É",
        "mail\nx://q.org/\n"]


def test_rules(spark):
    rows = [(i, u, None, None, None) for i, u in enumerate(URLS * 2)] + [(None, URLS[5], None, None, None)]
    got = U.judge(spark.createDataFrame(rows, PAGE)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = _rule(URLS[r.page_id % len(URLS)] if r.page_id is not None else URLS[5])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert U.judge(spark.createDataFrame([], PAGE)).count() == 0


def test_unruled_urls_follow_their_likes(spark):
    rnd = random.Random(2)
    rows = [(i, f"http://{rnd.choice('ab')}.{rnd.choice(['example.org', 'example.net'])}/{rnd.choice(['es', 'fr', 'en'])}/{rnd.randrange(20000, 90000)}", "", None, None) for i in range(1500)]
    got = U.judge(spark.createDataFrame(rows, PAGE)).where("rule IS NULL").groupBy(F.split("path", "/")[1].alias("l"), "verdict").count().collect()
    assert {(r.l, r.verdict) for r in got} == {("es", "block"), ("fr", "allow"), ("en", "allow")}


def test_all_urls_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet")
    url = {r.page_id: r.url for r in pages.collect()}
    for r in U.judge(pages).collect():
        host, path, rule, verdict = _rule(url[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def _article(html):
    at = html.find("<article>")
    if at < 0:
        return ""
    end = html.find("</article>")
    body = re.sub(r"<[^>]*$", "", html[at + 9:end if end >= 0 else len(html)])
    lines = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in lines if x)


def test_articles_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = P.main_text(pages).collect()
    assert len(got) == len(html)
    for r in got:
        assert r.text == _article(html[r.page_id]) and r.n_chars == len(r.text)


MESSY = """<html><body class="has-sidebar"><header>H</header><div class="cookie-notice">C</div><article><header><h1>T &amp; x</h1></header><p>a<b>b</b>  c&nbsp;d
<ul><li>1<li>2</ul><div class="ad-box">AD</div><aside>s</aside><p hidden>no</p><p>x &lt; y<form>f</form><script>if (a<b) "</p>"</script><!-- <p>no</p> --><img alt="a > b">z</article>
<section id="comments"><article class="comment">no</article></section><footer>f"""


def test_messy_pages():
    assert P.Page(MESSY).text() == "T & x\na b c d\n1\n2\nx < y\nz".replace("a b c", "ab c")
    assert P.Page("<body><div>plain <i>text</i><br>more</div><nav>n</nav><p>two").text() == "plain text more\ntwo"
    assert [P.Page(x).text() for x in ("", "no tags &amp; all <3 x", "<p>cut <a hre", "<article>a</article><article>b</article>")] == ["", "no tags & all <3 x", "cut", "a\nb"]


def test_site_templates_go_and_content_stays(spark):
    shell = "<body><div>Our shop is open daily</div>{}<div>Call us <b>now</b></div></body>"
    rows = [(i, f"http://a.test/{i}", shell.format(f"<div><p>The same line.</p><p>Text {i}</p></div>"), None, None) for i in range(30)]
    rows += [(100 + i, "http://b.test/", "<body><div>Our shop is open daily</div><div>copied</div></body>", None, None) for i in range(30)]
    rows += [(200, None, None, None, None), (200, None, "", None, None), (201, "http://a.test/x", "<article><p>The same line.</p><div>Call us <b>now</b></div></article>", None, None)]
    got = {r.page_id: r.text for r in P.main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[7] == "Text 7"
    assert got[101] == "Our shop is open daily\ncopied"  # thirty copies are one content
    assert got[200] == "" and got[201] == "The same line."
    assert P.main_text(spark.createDataFrame([], PAGE)).count() == 0


def test_article_is_a_hint(spark):
    assert P.Page('<main><p>body</p><article class="card">teaser</article></main>').text() == "body\nteaser"
    long = "the long text of this page " * 20
    assert P.Page(f'<p>{long}</p><article class="card">teaser</article>').text() == f"{long.strip()}\nteaser"
    assert P.Page(f"<p>skip to content</p><article>{long}</article>").text() == long.strip()
    # what surrounds the articles goes as template, not for being outside of them
    rows = [(i, f"http://a.test/{i}", f"<body><div>Our shop is open daily and all of the week</div><p>Text {i}</p><article>Card {i}</article></body>", None, None) for i in range(9)]
    assert {r.page_id: r.text for r in P.main_text(spark.createDataFrame(rows, PAGE)).collect()} == {i: f"Text {i}\nCard {i}" for i in range(9)}


def test_names_drop_containers_alone():
    inside = ['<h2 id="related-work">A</h2>', '<section id="social-security">B</section>', '<p class="notice">C</p>', '<h3 id="search">D</h3>', '<section id="menu"><h2>E</h2><p>e</p></section>']
    assert P.Page(f"<article><p>one</p>{''.join(inside)}</article>").text().split() == ["one", *"ABCDEe"]
    assert P.Page('<body><div class="content with-sidebar"><p>whole page</p></div><div class="sidebar">s</div></body>').text() == "whole page"
    assert P.Page('<body><div class="widget"><p>whole page</p></div><div class="sidebar">s</div></body>').text() == "whole page"
    gone = "".join(f'<div class="{c}">x</div>' for c in ("ad-box", "cookie-notice", "siteFooter", "left sidebar", "share-buttons", "post-comments"))
    assert P.Page(f"<body><p>some text to read</p>{gone}</body>").text() == "some text to read"


def test_template_of_a_large_host(spark, monkeypatch):
    """A notice on 60 of 900 contents is template as on a small host, whichever way its hash reaches the pages."""
    rows = [(i, "http://a.test/", f"<body>{'<div>A notice of one section</div>' if i < 60 else ''}<div><p>Text {i}</p></div></body>", None, None) for i in range(900)]
    pages = spark.createDataFrame(rows, PAGE)
    for bound in (P.BROADCAST_HASHES, 0):
        monkeypatch.setattr(P, "BROADCAST_HASHES", bound)
        assert {r.page_id: r.text for r in P.main_text(pages).collect()} == {i: f"Text {i}" for i in range(900)}


def test_license_lines(spark):
    short = {k: v for k, v in L.TEMPLATES.items() if len(v) < 80}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    found = {}
    for r in L.scan_licenses(docs).collect():
        found.setdefault(r.doc_id, []).append((r.license, r.start, r.end))
    for d, t in text.items():
        exact = {(k, m.start()) for k, v in short.items() for m in re.finditer(re.escape(v), t)}
        assert exact <= {(k, a) for k, a, _ in found.get(d, [])}, d
    assert all(re.search(r"(?i)licen[sc]e|warrant", text[d][a:b]) for d, fs in found.items() for _, a, b in fs)


def test_license_alignment():
    s = L.Scanner(L.TEMPLATES)
    mit = L.TEMPLATES["MIT text"]
    broken = mit.replace("free of charge, ", "").replace("sublicense", "sub-license").upper()
    got = s.scan("x y z " * 400 + broken + " tail " + mit + " end")
    assert [g[0] for g in got] == ["MIT text", "MIT text"] and 0.8 <= got[0][1] < 1 and got[1][1] == 1.0
    line = L.TEMPLATES["Apache-2.0"]
    assert [g[0] for g in s.scan(" ".join([line] * 5))] == ["Apache-2.0"] * 5
    assert s.scan("the license of the work is public") == [] and s.scan("") == []
    at = s.scan("İİ " + line)[0]
    assert ("İİ " + line)[at[2]:at[3]] == line[:-1]


@pytest.mark.parametrize("notice, want", [
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]), ("This work is licensed under the GNU General Public License, version 3.0.", ["GPL-3.0"]),
    ("This work is licensed under the GNU General Public License, version 1.", []), ("Licensed under the Apache License, Version 1.1.", []), ("Licensed under the Apache License 2.0.", ["Apache-2.0"]),
    ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]), ("Licensed under CC BY 3.0.", []), ("Released under the BSD License.", ["BSD"]), ("Released under the Foo License.", []),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]), ("It was released under an MIT License.", ["MIT"]),
    (L.TEMPLATES["GPL-3.0-or-later header"].replace("version 3", "version 2"), ["GPL-2.0-or-later header"])])
def test_licenses_by_name_and_version(notice, want):
    assert [g[0] for g in L.Scanner(L.TEMPLATES).scan(f"Some words before. {notice} Some words behind.")] == want


def test_identifying_words_are_in_their_templates():
    s = L.Scanner(L.TEMPLATES)
    assert L.IDENTITY.keys() == L.TEMPLATES.keys() - {"MIT text", "ISC text", "BSD conditions"}
    assert all(len(s.identity[k]) == len(v) for k, v in L.IDENTITY.items())
    assert all([(g[0], g[1]) for g in s.scan(t)] == [(k, 1.0)] for k, t in L.TEMPLATES.items())


@pytest.mark.parametrize("seed", range(20))
def test_increasing(seed):
    rnd = random.Random(seed)
    v = rnd.sample(range(50), rnd.randrange(0, 14))
    best = max((len(c) for m in range(1 << len(v)) if (c := [v[i] for i in range(len(v)) if m >> i & 1]) == sorted(c)), default=0) if len(v) <= 12 else None
    got = L.increasing(v)
    assert [v[i] for i in got] == sorted(v[i] for i in got) and got == sorted(got) and (best is None or len(got) == best)


def test_license_odd_rows(spark, odd_docs, no_docs):
    assert L.scan_licenses(odd_docs).count() == 0 and L.scan_licenses(no_docs).count() == 0
    rows = [(None, "Released under the MIT License."), (1, "Released under the MIT License.")] * 2
    assert L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4
