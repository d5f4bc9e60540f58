"""URL verdicts by rules, and beyond them by path-template trees.

A rule is a host and a path prefix; it fits its host and all subdomains when the path starts with
its path; the longest fitting rule wins (of equally long ones that with the longer host, then block).

URLs without a rule are judged by the templates of their host. A path's segments are reduced to
shapes (digit and hex runs become marks), and distinct shape paths are counted per host with their
rows, the rows that a rule labels, and those it blocks. From the root down, a branch of a host's
tree keeps its own name only if it is frequent there and its labelled purity differs from its
parent's by more than two standard errors; all others are variable or statistically alike and
merge into the wildcard branch. A branch without labels on its host is tested with those that the
same branch has over all hosts. A template's purity is its blocked share, smoothed by ``STRENGTH`` rows of
the purity that its shapes have over all hosts (itself smoothed towards shorter paths); templates
of purity 0.5 or more are rejected.

All counts cover all rows; the tree works on distinct shape paths, and rows meet their template by
one join. Defined results: a null url, or one without ``://``, has empty host and path; a null
page_id is kept; repeated rows are judged and counted as often as they occur; without any labels
the verdict is allow.
"""
from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.session import materialise

#: (host, path, verdict): the rules that hold here.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Segments told apart; what follows is one more.
DEPTH = 3
#: A branch is frequent from so many rows on, on a host of any size.
MIN_ROWS = 5
STRENGTH = 10.0
BROADCAST_PATHS = 200_000


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; null where none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block"))
    fits = [(F.concat(F.lit("."), host_).endswith("." + h) & path_.startswith(p), h + p, v) for h, p, v in ranked]
    return tuple(F.coalesce(*[F.when(f, F.lit(x[k])) for f, *x in fits], F.lit(None).cast("string")) for k in (0, 1))


def shapes(path_: Column) -> list[Column]:
    """The first ``DEPTH`` segments' shapes, and the shape of the rest; '' where a path is shorter."""
    marked = F.regexp_replace(F.regexp_replace(path_, r"(?i)\b(?=[a-f0-9-]*[0-9])[a-f0-9][a-f0-9-]{11,}\b", "{x}"), r"[0-9]+", "{n}")
    parts = F.filter(F.split(marked, "/"), lambda s: s != "")
    rest = F.array_join(F.slice(parts, DEPTH + 1, 2**31 - 1), "/")
    return [F.coalesce(F.get(parts, F.lit(k)), F.lit("")).alias(f"s{k + 1}") for k in range(DEPTH)] + [rest.alias(f"s{DEPTH + 1}")]


SHAPES = [f"s{k + 1}" for k in range(DEPTH + 1)]


def _purity(blocked: str, labelled: str, prior: Column) -> Column:
    return (F.col(blocked) + F.lit(STRENGTH) * prior) / (F.col(labelled) + F.lit(STRENGTH))


def pooled_purity(paths: DataFrame) -> DataFrame:
    """(s1.., prior): blocked share of each shape path over all hosts, smoothed towards that of shorter paths."""
    whole = paths.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    found = paths.select(*SHAPES).distinct().withColumn("prior", F.lit((whole["b"] or 0) / whole["l"] if whole["l"] else 0.0))
    for k in range(1, len(SHAPES) + 1):
        level = paths.groupBy(*SHAPES[:k]).agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
        found = found.join(level, SHAPES[:k]).withColumn("prior", _purity("b", "l", F.col("prior"))).drop("b", "l")
    return found


def template_tree(paths: DataFrame) -> DataFrame:
    """(host, s1.., template, purity) for distinct shape paths (host, s1.., n, labelled, blocked)."""
    paths = paths.withColumn("template", F.substring("host", 1, 0))  # empty, but no constant: the joins below keep their keys
    counts = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    own = paths.groupBy("host").agg((F.sum("labelled") > 0).alias("own"))
    paths = paths.join(own, "host")
    for s in SHAPES:
        child = paths.groupBy("host", "own", "template", s).agg(*counts)
        # the branch over all hosts, and its parent there
        pooled = paths.groupBy("template", s).agg(*counts)
        both = {}
        for name, rows, keys in (("h", child, ["host", "template"]), ("a", pooled, ["template"])):
            sums = [F.sum(c).alias(f"{name}_{c}0") for c in ("n", "labelled", "blocked")]
            if name == "a" and s == SHAPES[0]:  # the root of all hosts is one row: no key that all branches share
                whole = rows.agg(*sums).first()
                met = rows.withColumns({c: F.lit(whole[c] or 0) for c in whole.asDict()})
            else:
                met = rows.join(rows.groupBy(*keys).agg(*sums), keys)
            both[name] = met.select(*keys, *(["own"] if name == "h" else []), s, *[F.col(c).alias(f"{name}_{c}") for c in ("n", "labelled", "blocked")], *[f"{name}_{c}0" for c in ("n", "labelled", "blocked")])
        seen = both["h"].join(both["a"], ["template", s])
        # a branch without labels on its host is held against its like on all hosts
        use = lambda c: F.when(F.col("own") & (F.col("h_labelled") > 0), F.col(f"h_{c}")).otherwise(F.col(f"a_{c}"))
        parent = use("blocked0") / F.greatest(use("labelled0"), F.lit(1))
        error = F.sqrt(parent * (1 - parent) / F.greatest(use("labelled"), F.lit(1)))
        differs = (use("labelled") > 0) & (F.abs(use("blocked") / F.greatest(use("labelled"), F.lit(1)) - parent) > 2 * error)
        frequent = F.col("h_n") >= MIN_ROWS
        named = F.when(F.col(s) == "", F.lit("")).when(frequent & differs, F.concat(F.lit("/"), F.col(s))).otherwise(F.lit("/*"))
        step = seen.select("host", "template", s, F.concat("template", named).alias("next"))
        paths = materialise(paths.join(step, ["host", "template", s]).drop("template").withColumnRenamed("next", "template"), "paths")
    priors = pooled_purity(paths)
    full = paths.join(priors, SHAPES)
    purity = (full.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"), (F.sum(F.col("prior") * F.col("n")) / F.sum("n")).alias("prior"))
              .select("host", "template", _purity("b", "l", F.col("prior")).alias("purity")))
    return paths.select("host", *SHAPES, "template").join(purity, ["host", "template"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    rows = materialise(rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), *shapes(F.col("path"))), "urls")
    paths = materialise(rows.groupBy("host", *SHAPES).agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked")), "shapes")
    tree = materialise(template_tree(paths), "templates")
    few = tree.count() <= BROADCAST_PATHS
    return (rows.join(F.broadcast(tree) if few else tree, ["host", *SHAPES])
            .select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") >= 0.5, "block").otherwise("allow")).alias("verdict"), "template", "purity"))
