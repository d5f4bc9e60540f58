"""Hand-written cases of the whole migration: expected values come from reading the tool, not from the engine."""
import json

import pytest
from pyspark.sql import functions as F

from sitemill.operators import html as H
from sitemill.operators import menus as MN
from sitemill.plans.migration import Migration

HOME = """<html><head><title>Clinic</title></head><body><nav id="slot-navigation"><ul><li><a href="/index.html">Home</a></li>
<li><a href="/services.html">Services</a></li></ul></nav><div id="slot-main"><p>Hi</p><img src="/art/logo.svg"><img src="/thumb.php?id=3"><img alt="a > b" src="/img/Big Tooth.png">
<a href="/services.html">S</a><a href="/price-list.html">P</a></div></body></html>"""
SERVICES = """<html><body><div id="slot-main"><h1>Services</h1><a href="/index.html">back</a></div></body></html>"""
DOC = {"data": {"locations": [{"name": "Main", "address1": "1 Road", "hours": "2:08:00:AM:05:00:PM", "map_lat": "", "map_long": ""}],
                "socialMedia": [{"token": "facebook_domain", "value": "clinic"}]}}


@pytest.fixture(scope="module")
def clinic(spark):
    pages = spark.createDataFrame([(1, "https://www.clinic.com/", HOME), (2, "https://clinic.com/services.html", SERVICES),
                                   (3, "https://www.clinic.com/price-list.html", SERVICES), (4, "https://other.org/", SERVICES)], "page_id long, url string, html string")
    registry = spark.createDataFrame([("www.clinic.com", "https://www.clinic.com", json.dumps({"sites": [{"editor_url": "http://ed.test/clinic/wysiwyg-editor"}]}))],
                                     "site string, site_url string, site_json string")
    words = spark.createDataFrame([("art logo thumb price list services",)], "text string")
    docs = spark.createDataFrame([("www.clinic.com", json.dumps(DOC)), ("nation-1-0", json.dumps(DOC))], "site string, doc_json string")
    return Migration(spark, pages, registry, words, docs)


def test_home_url_without_last_slash(clinic):
    row = clinic.sites.first()
    assert (row.family, row.home_page_id) == ("O", 1)


def test_pages_of_the_site_under_another_host_name(clinic):
    assert {r.page_id for r in clinic.page_ctx.collect()} == {1, 2, 3}


def test_legacy_documents_are_found_by_site(clinic):
    bodies = [json.loads(r.body) for r in clinic.outbox.where(F.col("body").contains("1 Road") | F.col("body").contains("clinic")).collect()]
    assert any(b.get("address") == "1 Road" or "1 Road" in json.dumps(b) for b in bodies)
    assert clinic.legacy.count() == 1


def test_images_that_are_no_files_keep_their_source(clinic):
    content = clinic.content.where("page_id = 1").first().content
    assert '<img src="/art/logo.svg" href="logo">' in content
    assert 'src="/thumb.php?id=3"' in content and 'src="thumb' not in content
    media = clinic.sites.first().media_base
    assert f'<img alt="a > b" src="{media}big-tooth.png">' in content
    assert '<a href="services">S</a>' in content and '<a href="price-list">P</a>' in content


def test_quoted_greater_than_stays_in_its_tag(spark):
    html = '<p title=it\'s>x<img alt="a > b" data-x=\'>\' src="/x.png"><a title="' + "long " * 4000 + '>" href=/y>z</a><b class="open'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = H.tokens(df).orderBy("pos").collect()
    assert "".join(r.raw for r in rows) == html
    assert [(r.tag, r.src, r.href) for r in rows if r.kind == "open" and r.tag in ("img", "a")] == [("img", "/x.png", None), ("a", None, "/y")]


def test_untitled_menu_items_and_their_children_stay(spark):
    kind = "site string, pos long, level long, parent_pos long, url string, title string, url_slug string"
    menu = spark.createDataFrame([("s", 1, 1, None, "/a", None, None), ("s", 2, 2, 1, "/b", "B", "/b"), ("s", 3, 1, None, "/c", "Home", "/home"), ("s", 4, 1, None, "#", "Last", "/last")], kind)
    sites = spark.createDataFrame([("s", "s.com", "m/")], "site string, domain string, media_base string")
    items = json.loads(MN.nest(MN.payload_targets(menu, sites)).first()["items"])
    assert [(i["title"], [c["title"] for c in i["items"]]) for i in items] == [(None, ["B"]), ("Last", [])]


def test_archive_is_numbered_without_its_html(spark):
    """The decorated pages are the rows of the SQL, over several cells and files, with null and repeated keys; no host's HTML meets in a task."""
    import re
    import tempfile

    from pyspark.sql import functions as F

    from sitemill.sources import fixtures as FX

    cell = FX.CELL
    ids = [0, 1, 5, cell - 1, cell, 3 * cell, -2, -cell - 1, 10**15, None]
    html = "<html><head><title>t</title></head><body><nav><ul></ul></nav><article><h1>h</h1></article></body></html>"
    rows = [(k, f"https://{h}.test/{h}{k}?q#f", None if k and k % 7 == 0 else html) for h in "abc" for k in (x if x is None else x * 3 + ord(h) for x in ids)]
    rows += [rows[0], rows[0], (77, None, html), (78, "no scheme", html)]
    root = tempfile.mkdtemp(prefix="sitemill-numbered-", dir="/tmp")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4, F.rand(1)).write.parquet(f"{root}/pages.parquet")
    got, want = FX.decorated_pages(spark, root), spark.sql(FX.decorated_sql(FX.spark_pages_ref(root)))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert got.dtypes == want.dtypes and want.count() > len(rows)
    windows = re.findall(r"^.*\bWindow \[.*$", got._jdf.queryExecution().optimizedPlan().toString(), re.M)
    assert not any("html" in w for w in windows)


def test_no_task_holds_more_tokens_than_its_share_of_the_html(spark, monkeypatch):
    """Both passes over the tokens, of all pages and of the reached ones, have partitions by bytes of HTML beyond the join with the pages' context."""
    share, n = 1 << 16, 200
    monkeypatch.setattr(H, "PARTITION_BYTES", share, raising=False)
    text = "<p>" + "alike " * 600 + "</p>"
    page = lambda links: f'<html><body><nav id="slot-navigation"><ul></ul></nav><div id="slot-main">{text}{links}</div></body></html>'
    rows = [(0, "https://clinic.com/", page("".join(f'<a href="/page-{k}.html">p</a>' for k in range(1, n))))]
    rows += [(k, f"https://clinic.com/page-{k}.html", page("")) for k in range(1, n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    registry = spark.createDataFrame([("clinic.com", "https://clinic.com/", "{}")], "site string, site_url string, site_json string")
    m = Migration(spark, pages, registry, spark.createDataFrame([("page",)], "text string"))
    assert m.processed.count() == n
    for tok, raw in ((m.tokens, "raw"), (m.rewritten_tokens, "out")):
        held = tok.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.octet_length(raw)).alias("n"), F.countDistinct("page_id").alias("pages"))
        most, parts, seen = held.agg(F.max("n"), F.count("*"), F.sum("pages")).first()
        assert seen == n and most < 3 * share and parts >= n * len(text) // share
