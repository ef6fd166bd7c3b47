"""URL filter: host and path rules first, then a path-template tree per host, with DataFrame functions only.

Rules: each fits its host and all subdomains where the url's path starts with the rule's path; the longest wins.

Templates judge the urls that no rule fits; the urls that a rule judged are the labels. Distinct (host, shape) pairs are
counted first; a shape is the path's segments with digits, hex and encoded strings generalised by their form. The tree is built level
by level. A node's children with little support become its ``*`` branch. The labelled ones are laid in BINS bins by their block rate, and going up the bins
each joins those below it unless a two-proportion test parts them; what joined is one branch (``~`` and its first name), so siblings with like rates merge with each other. Children
without labels merge if their own children look alike (an equal min-hash; ``=`` and the first name). Counts are sums by (host, node, segment or bin) with
map-side sums, joined back by joins that may be split by size: of a node no more than BINS rows meet anywhere, and the driver sees no row, only whether a level has any.

A path ends as ``**`` below a node with fewer urls than ``support`` or without labels, where no verdict can change any more; where all urls below a node
go on alike, what is left of them is one step. So levels are built only where labels part, and a deep path costs no more than a short one.

A node's purity is its share of blocked labels, smoothed by ``weight`` towards its parent's, and a host's towards ``prior``. A template is
a node at which urls end, with its own purity smoothed towards the node's. Templates at or above ``threshold`` are rejected; templates
without a label of their own are allowed.

Edge cases: a null url, or one without ``://``, has an empty host and path and fits no rule; an empty table gives no
rows; repeated rows are judged alike, each one returned; other columns are dropped, whatever their names; paths
of any length and depth are matched whole, by rules and templates; of rules of equal length the one last in the alphabet wins, but no two equal ones should differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.llm._shared import ascii_lower
from assetlens.scratch import Scratch, written

#: (verdict, host, path) of the production rules; fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def with_host_and_path(pages: DataFrame) -> DataFrame:
    rest = F.when(F.instr("url", "://") > 0, F.substr("url", F.instr("url", "://") + 3)).otherwise("")
    df = pages.select("page_id", "url", rest.alias("rest"))
    raw = F.regexp_extract("rest", "^[^/?#]*", 0)
    df = df.withColumns({"host": ascii_lower(raw), "tail": F.substr("rest", F.length(raw) + 1)})
    return df.select("page_id", "host", F.regexp_extract("tail", "^[^?#]*", 0).alias("path"))


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict: those of the longest rule that fits, else null."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def with_shape(df: DataFrame) -> DataFrame:
    """Adds shape: the path's segments by form."""

    def form(x):
        return (
            F.when(x.rlike("^[0-9]+$"), "<n>")
            .when(x.rlike("^[0-9]{4}[-_.][0-9]{1,2}([-_.][0-9]{1,2})?$"), "<date>")
            .when(x.rlike("^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "<hex>")
            .otherwise(F.regexp_replace(x, "[0-9]+", "<n>"))
        )

    return df.withColumn("shape", F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), form))


_COUNTS = ("n", "blocked", "labelled")
#: Bins of block rates, and the kinds of branches: rare children, labelled ones of like rates, unlabelled ones with like children.
BINS, RARE, LIKE_RATE, LIKE_CHILDREN = 32, 0, 1, 2


def _sums(*columns: str) -> list:
    return [F.sum(c).alias(c) for c in columns]


def _clusters(bins, z: float):
    """(bin, cluster) of bins (bin, blocked, labelled) in order: a bin joins the cluster below it unless their block rates differ by a two-proportion test."""

    def step(a, x):
        pooled = (a["b"] + x["blocked"]) / (a["m"] + x["labelled"])
        gap = F.abs(x["blocked"] / x["labelled"] - a["b"] / a["m"])
        apart = (a["m"] > 0) & (gap > z * F.sqrt(pooled * (1 - pooled) * (1 / a["m"] + 1 / x["labelled"])))
        cluster = a["cluster"] + apart.cast("int")
        total = lambda old, new: (F.when(apart, 0).otherwise(old) + new).cast("long")
        return F.struct(total(a["b"], x["blocked"]).alias("b"), total(a["m"], x["labelled"]).alias("m"), cluster.alias("cluster"), F.concat(a["out"], F.array(F.struct(x["bin"].alias("bin"), cluster.alias("cluster")))).alias("out"))

    none = F.array().cast("array<struct<bin:int,cluster:int>>")
    return F.aggregate(bins, F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("m"), F.lit(0).alias("cluster"), none.alias("out")), step, lambda a: a["out"])


def _level(active: DataFrame, level: int, scratch: Scratch, support: int, share: float, weight: float, z: float) -> DataFrame:
    """active with the segment's branch added: template, node, node_n, node_m, alike (all that is left of its urls' paths is equal) and purity are the branch's."""
    here = active.withColumn("seg", F.get("shape", F.lit(level)))
    below, left = F.coalesce(F.get("shape", F.lit(level + 1)), F.lit("")), F.xxhash64(F.slice("shape", level + 2, 1 << 30))
    kids = here.groupBy("host", "node", "seg").agg(*_sums(*_COUNTS), F.min(F.xxhash64(below)).alias("sign"), F.min(left).alias("lo"), F.max(left).alias("hi"))
    kids = scratch.written(kids, f"kids{level}")
    parents = kids.groupBy("host", "node").agg(F.sum("n").alias("pn"))
    rare = (F.col("n") < support) | (F.col("n") < share * F.col("pn"))
    kind = F.when(rare, RARE).when(F.col("labelled") > 0, LIKE_RATE).otherwise(LIKE_CHILDREN)
    rate = F.when(kind == LIKE_RATE, F.least(F.lit(BINS - 1), F.floor(F.col("blocked") / F.col("labelled") * BINS)).cast("int"))
    k = scratch.written(kids.join(parents, ["host", "node"]).withColumns({"kind": kind, "bin": rate}), f"kinds{level}")
    bins = k.where("bin is not null").groupBy("host", "node", "bin").agg(*_sums("blocked", "labelled"))
    bins = bins.groupBy("host", "node").agg(F.sort_array(F.collect_list(F.struct("bin", "blocked", "labelled"))).alias("bins"))
    clusters = bins.select("host", "node", F.explode(_clusters(F.col("bins"), z)).alias("c")).select("host", "node", "c.bin", "c.cluster")
    k = k.join(clusters, ["host", "node", "bin"], "left").withColumn("part", F.when(F.col("kind") == LIKE_RATE, F.col("cluster").cast("long")).when(F.col("kind") == LIKE_CHILDREN, F.col("sign")).otherwise(0))
    k = scratch.written(k.select("host", "node", "seg", "kind", "part", *_COUNTS, "lo", "hi"), f"parts{level}")
    sums = k.groupBy("host", "node", "kind", "part").agg(F.sum("n").alias("bn"), F.sum("blocked").alias("bb"), F.sum("labelled").alias("bm"), F.count(F.lit(1)).alias("many"), F.min("seg").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = scratch.written(k.select("host", "node", "seg", "kind", "part").join(sums, ["host", "node", "kind", "part"]), f"found{level}")
    out = here.join(found, ["host", "node", "seg"])
    name = F.when(F.col("kind") == RARE, "*").when(F.col("many") == 1, F.col("first")).otherwise(F.concat(F.when(F.col("kind") == LIKE_RATE, "~").otherwise("="), "first"))
    return out.select(
        "host", "shape", *_COUNTS,
        F.concat("template", F.lit("/"), name).alias("template"),
        F.xxhash64("node", "kind", "part").alias("node"),
        F.col("bn").alias("node_n"), F.col("bm").alias("node_m"), (F.col("lo") == F.col("hi")).alias("alike"),
        ((F.col("bb") + weight * F.col("purity")) / (F.col("bm") + weight)).alias("purity"),
    )


def template_verdicts(judged: DataFrame, support: int = 3, share: float = 0.005, prior: float = 0.2, weight: float = 4.0, z: float = 1.96, threshold: float = 0.8) -> DataFrame:
    """host, shape, template, template_purity, template_verdict for each shape of each host. judged: host, shape, rule_verdict."""
    scratch = Scratch(judged.sparkSession, "templates")
    counts = [F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("rule_verdict") == "block", 1)).alias("blocked"), F.count("rule_verdict").alias("labelled")]
    t = scratch.written(judged.groupBy("host", "shape").agg(*counts), "shapes")
    hosts = t.groupBy("host").agg(F.sum("n").alias("node_n"), F.sum("blocked").alias("bb"), F.sum("labelled").alias("node_m"))
    root = ((F.col("bb") + weight * prior) / (F.col("node_m") + weight)).alias("purity")
    at = scratch.written(t.join(hosts, "host").select("host", "shape", *_COUNTS, F.lit("").alias("template"), F.xxhash64("host").alias("node"), "node_n", "node_m", F.lit(False).alias("alike"), root), "level0")
    every, level = None, 0
    while True:
        over = F.size("shape") <= level
        known = (F.col("node_n") >= support) & (F.col("node_m") > 0)
        rest = F.array_join(F.slice("shape", level + 1, 1 << 30), "/")
        step = F.when(over, F.lit(None).cast("string")).when(~known, "**").when(F.col("alike"), rest)
        ended = at.where(over | ~known | F.col("alike")).withColumns({"template": F.concat_ws("/", "template", step), "node": F.when(step.isNull(), F.col("node")).otherwise(F.xxhash64("node", step))})
        every = ended if every is None else every.unionByName(ended)
        active = at.where(~over & known & ~F.col("alike"))
        if active.isEmpty():
            break
        at = scratch.written(_level(active, level, scratch, support, share, weight, z), f"level{level + 1}")
        scratch.drop(*[f"{x}{level}" for x in ("kids", "kinds", "parts", "found")])
        level += 1
    every = scratch.written(every, "ended")
    leaves = every.groupBy("host", "node", "template").agg(F.sum("blocked").alias("lb"), F.sum("labelled").alias("lm"))
    purity = (F.col("lb") + weight * F.col("purity")) / (F.col("lm") + weight)
    out = every.join(leaves, ["host", "node", "template"]).select(
        "host", "shape", F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"), purity.alias("template_purity"),
        F.when((purity >= threshold) & (F.col("lm") > 0), "block").otherwise("allow").alias("template_verdict"),
    )
    out = written(out, "template-verdicts")
    scratch.close()
    return out


def judge_urls(pages: DataFrame, rules=RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, template, template_purity for each row of pages (page_id, url)."""
    judged = with_shape(with_rule(with_host_and_path(pages), rules))
    templates = template_verdicts(judged, **options)
    ruled = judged.where(F.col("rule").isNotNull())
    ruled = ruled.select("page_id", "host", "path", "rule", F.col("rule_verdict").alias("verdict"), F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("template_purity"))
    rest = judged.where(F.col("rule").isNull()).join(templates, ["host", "shape"], "left")
    rest = rest.select("page_id", "host", "path", "rule", F.col("template_verdict").alias("verdict"), "template", "template_purity")
    return ruled.unionByName(rest)
