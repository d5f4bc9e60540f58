"""Golden vectors for hours (L3), social tokens (L4) and menu home de-duplication (M5)."""
import json

import json

from pyspark.sql import functions as F

from sitemill.operators import business as B
from sitemill.operators import menus as MN
from sitemill.plans import outbox as O


def _doc(spark, hours, social):
    loc = {f: "" for f in B.LOCATION_FIELDS}
    loc.update({"name": "Main Office", "hours": hours, "map_lat": "12.5", "map_long": ""})
    doc = {"data": {"locations": [loc], "socialMedia": [{"token": t, "value": v} for t, v in social]}}
    return B.parse_docs(spark.createDataFrame([("s1", json.dumps(doc))], "site string, doc_json string"))


def test_hours(spark):
    d = _doc(spark, "1:08:00:AM:05:00:PM,2:00:30:AM:11:00:AM,2:09:00:AM:01:00:PM,9:01:00:AM:02:00:PM", [])
    rows = {r["day"]: r for r in B.hours_days(d).collect()}
    assert set(rows) == {"sunday", "monday"}
    assert (rows["sunday"]["day_name"], rows["sunday"]["time1_open"], rows["sunday"]["time1_close"]) == ("Sunday", "8:00 AM", "5:00 PM")
    assert rows["monday"]["time1_open"] == "9:00 AM"  # last duplicate wins
    hs = B.hours_sets(B.hours_days(d))
    assert hs.select(F.map_keys("days")).collect()[0][0] == ["monday", "sunday"]
    body = O.hours_payloads(hs).collect()[0]["body"]
    assert body.startswith('{"days":{"monday":{"day_name":"Monday","open":"true","time1_close":"1:00 PM","time1_open":"9:00 AM"')
    assert json.loads(body)["name"] == "Main Office Hours"
    d2 = _doc(spark, "2:00:30:AM:11:00:AM", [])
    assert B.hours_days(d2).collect()[0]["time1_open"] == ":30 AM"


def test_locations_and_social(spark):
    d = _doc(spark, "", [("facebook_domain", "acme"), ("instagram", "x"), ("Yelp_url", "https://y/acme")])
    loc = B.locations(d).collect()[0]
    assert loc["useCoordinates"] == "false" and loc["latitude"] == 12.5 and loc["longitude"] is None
    assert B.hours_days(d).count() == 0
    s = sorted((r["label"], r["url"], r["iconClass"]) for r in B.social(d).collect())
    assert s == [("Facebook", "https://www.facebook.com/acme", "icon-facebook"), ("Yelp", "https://y/acme", "icon-yelp")]
    body = json.loads(O.location_payloads(B.locations(d)).collect()[0]["body"])
    assert list(body) == sorted(body) and body["latitude"] == 12.5 and body["longitude"] is None


def _menu(spark, rows):
    df = spark.createDataFrame(rows, "site string, pos bigint, level bigint, parent_pos bigint, url string, title string")
    df = df.withColumn("url_slug", F.concat(F.lit("/"), F.lower("title")))
    sites = spark.createDataFrame([("s", "example.com", "https://m/")], "site string, domain string, media_base string")
    nested = MN.nest(MN.payload_targets(df, sites)).collect()
    return [{"items": json.loads(r["items"])} for r in nested]


def test_home_dedup_first_sibling_only(spark):
    a = _menu(spark, [("s", 1, 1, None, "/home", "Home"), ("s", 2, 1, None, "/a", "A"), ("s", 3, 1, None, "/w", "Welcome")])
    assert [i["title"] for i in a[0]["items"]] == ["Home", "A"]
    b = _menu(spark, [("s", 1, 1, None, "/a", "A"), ("s", 2, 1, None, "/home", "Home"), ("s", 3, 2, 2, "/x", "X")])
    assert [i["title"] for i in b[0]["items"]] == ["A"]


def test_menu_targets(spark):
    m = _menu(spark, [("s", 1, 1, None, "#", "S"), ("s", 2, 2, 1, "/f/My Doc.pdf", "D"), ("s", 3, 2, 1, "http://other.org/", "E"),
                      ("s", 4, 1, None, "/index.html", "Home")])
    items = m[0]["items"]
    assert [(i["title"], i["url"]) for i in items] == [("S", "#")]  # a later Home sibling is dropped
    h = _menu(spark, [("s", 0, 1, None, "/index.html", "Home")])[0]["items"]
    assert [(i["title"], i["url"]) for i in h] == [("Home", "/")]
    assert [(i["title"], i["url"]) for i in items[0]["items"]] == [("D", "https://m/my-doc.pdf"), ("E", "http://other.org/")]


def test_menus_of_any_depth(spark, monkeypatch):
    """Random trees, some of whose items are dropped with all below them, against recursion; in small blocks too."""
    import random

    monkeypatch.setattr(MN, "MENU_BLOCK", 7)
    draw, rows, want = random.Random(8), [], {}
    for site in range(25):
        def tree(level, parent, site=site):
            out = []
            for _ in range(draw.randint(0, 3) if level < 9 else 0):
                pos = len([r for r in rows if r[0] == str(site)])
                title, gone = f'"{pos}\\é', draw.random() < 0.15
                rows.append((str(site), pos, level, parent, title, "u%d" % pos, gone))
                below = tree(level + 1, pos)
                if not gone:
                    out.append({"items": below, "newTab": "0", "title": title, "url": "u%d" % pos})
            return out
        found = tree(1, None)
        if found:
            want[str(site)] = found
    df = spark.createDataFrame(rows, "site string, pos long, level int, parent_pos long, title string, target string, gone boolean").where("NOT gone").repartition(5)
    assert {r["site"]: json.loads(r["items"]) for r in MN.nest(df).collect()} == want
    assert max(r[2] for r in rows) > 5
