"""Token relation properties: lossless, extents agree with a per-tag stack,
order-invariant, and one exchange for all per-page work."""
import re

from pyspark.sql import functions as F

from sitemill.operators import html as H
from sitemill.sources import archive as A
from conftest import SF_MID, SF_SMALL


def test_tokens_are_lossless(spark):
    pages = A.read_pages(spark, SF_MID)
    joined = H.assemble(H.tokens(pages), "raw", "h").join(pages, "page_id")
    assert joined.where(F.col("h") != F.col("html")).count() == 0
    assert joined.count() == pages.count()


def _stack_extents(tokens):
    """Brute force: pair start and end tags per tag name with a stack (for pages whose items all have end tags)."""
    last = max(t["pos"] for t in tokens)
    stacks, out = {}, {}
    for t in tokens:
        if t["kind"] == "open" and t["tag"] not in H.VOID_TAGS:
            stacks.setdefault(t["tag"], []).append(t["pos"])
        elif t["kind"] == "close" and stacks.get(t["tag"]):
            out[stacks[t["tag"]].pop()] = t["pos"]
    for st in stacks.values():
        for p in st:
            out[p] = last
    return out


def test_extents_match_stack(spark):
    pages = A.read_pages(spark, SF_SMALL)
    ext = H.with_extents(H.tokens(pages)).select("page_id", "pos", "kind", "tag", "end_pos").collect()
    by_page = {}
    for r in ext:
        by_page.setdefault(r["page_id"], []).append(r.asDict())
    checked = 0
    for rows in by_page.values():
        rows.sort(key=lambda r: r["pos"])
        expect = _stack_extents(rows)
        for r in rows:
            # the pages leave out end tags of paragraphs, which end with their block
            if r["kind"] == "open" and r["tag"] not in [*H.VOID_TAGS, "p"]:
                assert r["end_pos"] == expect[r["pos"]], (r, expect[r["pos"]])
                checked += 1
    assert checked > 1000


def test_same_output_after_random_repartition(spark):
    pages = A.read_pages(spark, SF_SMALL)
    a = H.assemble(H.tokens(pages).where(F.col("kind") == "text"), "raw", "t")
    b = H.assemble(H.tokens(pages.repartition(7, F.rand(3))).where(F.col("kind") == "text"), "raw", "t")
    assert sorted(a.collect()) == sorted(b.collect())


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange", plan))


def test_per_page_work_reuses_one_exchange(spark):
    """Extents (two windows), coverage and reassembly add no exchange beyond
    the single repartition of the archive by page_id."""
    pages = A.read_pages(spark, SF_SMALL)
    ext = H.with_extents(H.tokens(pages))
    ext = ext.withColumn("c", H.covered_by(F.col("tag") == "article"))
    out = H.assemble(ext.where("c"), "raw", "content")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert _exchanges(out) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_scan_prunes_columns(spark):
    pages = A.read_pages(spark, SF_SMALL)
    plan = pages.select("page_id", "url")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


# ---------------------------------------------------------------------------
# Tags of any size, and pages that are cut off
# ---------------------------------------------------------------------------
def _tokens(spark, html):
    rows = H.tokens(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()
    assert "".join(r["raw"] for r in rows) == html
    return rows


def test_tags_of_any_size_on_the_default_stack(spark):
    many = "<a " + " ".join(f'k{i}="v>{i}"' for i in range(100_000)) + ' href="/x?a=1&amp;b=2">t</a>'
    assert [(r["kind"], r["href"]) for r in _tokens(spark, many)] == [("open", "/x?a=1&b=2"), ("text", None), ("close", None)]
    bare = "<a " + "k= " * 800_000 + "==" * 400_000 + ' href=/y>'
    assert [(r["kind"], r["href"]) for r in _tokens(spark, bare)] == [("open", "/y")]
    huge = '<img title="' + "x>" * 2_500_000 + '" src="/z.png"><b>'
    assert [(r["kind"], r["src"]) for r in _tokens(spark, huge)] == [("open", "/z.png"), ("open", None)]


def test_what_is_never_closed_runs_to_the_end_once(spark):
    cut = lambda html: [(r["kind"], r["tag"]) for r in _tokens(spark, html)]
    assert cut("<p>a<a href='x>y' ") == [("open", "p"), ("text", None), ("cut", None)]
    assert cut('<p>a<a href="x>y') == [("open", "p"), ("text", None), ("open", "a"), ("text", None)]
    assert cut("a</di") == [("text", None), ("cut", None)]
    assert cut("a<scrip") == cut("a<script") == [("text", None), ("cut", None)]
    assert cut("<script>if (a<b) '</p>'") == [("raw", "script")]
    assert cut("<!-- <a> <b>") == [("comment", None)]
    assert cut("<!doctype html") == [("decl", None)]
    assert cut("a < b <") == [("text", None)] * 4
    assert len(_tokens(spark, "<!--" * 200_000)) == 1
    assert len(_tokens(spark, "<script " * 200_000)) == 1
    assert len(_tokens(spark, "< " * 100_000)) == 200_000


# ---------------------------------------------------------------------------
# End tags that HTML leaves out
# ---------------------------------------------------------------------------
class Writer:
    """Writes a random tree as tokens, leaving out optional end tags, and notes each element's true end and depth."""

    def __init__(self, seed):
        import random

        self.draw, self.tokens, self.ends, self.depths = random.Random(seed), [], {}, {}

    def element(self, tag, depth, body, optional=False):
        start = len(self.tokens)
        self.depths[start] = depth
        self.tokens.append(f"<{tag}>")
        body()
        if optional and self.draw.random() < 0.6:
            self.ends[start] = len(self.tokens) - 1
        else:
            self.ends[start] = len(self.tokens)
            self.tokens.append(f"</{tag}>")

    def text(self):
        if self.draw.random() < 0.5:
            self.tokens.append(f"t{len(self.tokens)}")

    def flow(self, depth, budget):
        for _ in range(self.draw.randint(0, 3)):
            kind = self.draw.choice(["list", "terms", "table", "select", "p", "div", "a"] if budget else ["p", "a"])
            getattr(self, kind)(depth, budget - 1)
            if kind != "p":
                self.text()

    def several(self, tags, depth, budget, flow=True):
        for _ in range(self.draw.randint(0, 3)):
            def body():
                self.text()
                if flow:
                    self.flow(depth + 1, budget)
            self.element(self.draw.choice(tags), depth, body, True)

    def list(self, depth, budget):
        self.element(self.draw.choice(["ul", "ol"]), depth, lambda: self.several(["li"], depth + 1, budget))

    def terms(self, depth, budget):
        self.element("dl", depth, lambda: self.several(["dt", "dd"], depth + 1, budget))

    def select(self, depth, budget):
        self.element("select", depth, lambda: self.several(["option"], depth + 1, budget, False))

    def table(self, depth, budget):
        def rows(d):
            for _ in range(self.draw.randint(0, 3)):
                self.element("tr", d, lambda: self.several(["td", "th"], d + 1, budget), True)

        def body():
            if self.draw.random() < 0.5:
                rows(depth + 1)
            else:
                for _ in range(self.draw.randint(1, 2)):
                    self.element(self.draw.choice(["thead", "tbody"]), depth + 1, lambda: rows(depth + 2), True)
        self.element("table", depth, body)

    def p(self, depth, budget):
        # what follows in the same parent is a block or the parent's end, or the end tag stands
        self.element("p", depth, lambda: (self.text(), self.a(depth + 1, 0)), False)
        if self.draw.random() < 0.5:
            self.element("p", depth, self.text, False)
            start = max(s for s in self.ends if self.tokens[s] == "<p>")
            if self.tokens[-1] == "</p>":
                self.tokens.pop()
                self.ends[start] = len(self.tokens) - 1
                self.div(depth, 0)

    def div(self, depth, budget):
        self.element("div", depth, lambda: self.flow(depth + 1, budget) if budget > 0 else self.text())

    def a(self, depth, budget):
        self.element("a", depth, self.text)


def test_implied_end_tags_are_those_of_the_tree(spark):
    from sitemill.operators import menus as MN

    writers = []
    for seed in range(150):
        w = Writer(seed)
        w.element("body", 1, lambda w=w: (w.flow(2, 4), w.flow(2, 3)))
        writers.append(w)
    pages = spark.createDataFrame([(k, "".join(w.tokens)) for k, w in enumerate(writers)], "page_id long, html string")
    rows = MN.with_depth(H.with_extents(H.tokens(pages))).where("kind = 'open'").select("page_id", "pos", "tag", "end_pos", "depth").collect()
    assert len(rows) == sum(len(w.ends) for w in writers) > 3000
    for r in rows:
        w = writers[r["page_id"]]
        assert (r["end_pos"], r["depth"]) == (w.ends[r["pos"]], w.depths[r["pos"]]), (r, "".join(w.tokens))


def test_unclosed_items_are_siblings(spark):
    from sitemill.operators import menus as MN

    html = '<nav><ul id="nav"><li><a href="/a">A</a><li><a href="/b">B</a><ul><li><a href="/c">C</a></ul><li><p><a href="/d">D</a></ul></nav><div>after</div>'
    tok = H.with_extents(H.tokens(spark.createDataFrame([(1, html)], "page_id long, html string")))
    menu = MN.menu(tok.withColumns({"site": F.lit("s"), "family": F.lit("T")})).orderBy("pos").collect()
    by_pos = {m["pos"]: m["title"] for m in menu}
    assert [(m["title"], m["level"], by_pos.get(m["parent_pos"])) for m in menu] == [("A", 1, None), ("B", 1, None), ("C", 2, "B"), ("D", 1, None)]


def test_stray_end_tags_count_nothing(spark):
    from sitemill.operators import menus as MN

    html = "<div><p>a<div>b</div></p><ul><li>x</li></li><li>y</td></ul></div><i>"
    tok = MN.with_depth(H.with_extents(H.tokens(spark.createDataFrame([(1, html)], "page_id long, html string"))))
    assert {r["tag"]: r["depth"] for r in tok.where("kind = 'open'").collect()} == {"div": 2, "p": 2, "ul": 2, "li": 3, "i": 1}


def test_partitions_follow_the_size_of_the_html(spark, monkeypatch):
    """what a task holds of tokens is bounded by HTML, however well the exchange compresses."""
    monkeypatch.setattr(H, "PARTITION_BYTES", 1 << 20)
    rows = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), F.repeat(F.lit("alike "), 600), F.lit("</p>")).alias("html"))
    bytes_of = H.tokens(rows).groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.octet_length("raw")).alias("n")).agg(F.max("n"), F.count("*")).first()
    assert bytes_of[0] < 2 << 20 and bytes_of[1] == -(-4000 * 3607 // (1 << 20))
    assert H.partitions(spark.createDataFrame([(1, None)], "page_id long, html string")) == spark.sparkContext.defaultParallelism
