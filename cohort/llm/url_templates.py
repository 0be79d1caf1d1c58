"""URL filter: domain rules first, then a path-template tree.

Rules block or allow a host with all its subdomains below a path; the longest rule that fits wins.  What no
rule fits is judged by its path template.  The tree is built per host, level by level:

* a segment of digits (with or without an extension) is a wildcard, ``*``;
* the children of a node with too many different ones are another, ``?`` - but those with enough labelled pages
  to be judged by them stay as they are, so they neither colour the wildcard nor are diluted by it;
* the labelled children of any other node are taken in the order of their share of blocked pages, and a child
  that a two-proportion test can't tell apart from all that its branch holds so far joins that branch;
* from ``DEPTH`` on, only nodes that hold labelled pages and pages to be judged go on, to their paths' full depth;
  what other nodes hold below is one open tail, as no split of it can change a verdict.

A template's purity is the share of blocked pages among its labelled ones, smoothed towards its parent node's
purity, a host's towards the share in the whole table.  Templates with labelled pages of their own whose purity
reaches a threshold are rejected; one without is allowed, whatever stands around it.  Labels are a given column (1
blocked, 0 fine, null unknown), which may label pages that no rule fits, or else the verdicts of the rules.

Defined cases: a null url, or one without ``://``, has an empty host and an empty path, fits no rule whose path
isn't empty, and shares one template; repeated rows each count and each give a row; equal rates merge; extra
columns are dropped unless named in ``keep``, and may not be named like the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import written

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Levels that the tree has everywhere.
DEPTH = 3
#: A node with more different children is variable; so is one with over FEW children of which half are unique.
MOST_BRANCHES = 64
FEW = 8
#: A child whose difference from its branch is below this z value belongs to it.
Z = 1.96
#: Pseudo-counts of the smoothing, and the purity that rejects.
PRIOR_ROWS = 5.0
LEAST_PURITY = 0.9
#: Labelled pages with which a child of a variable node stands for itself: its labels outweigh the pseudo-counts.
SUPPORT = PRIOR_ROWS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(F.translate(host, _UPPER, _LOWER), empty), F.coalesce(path, empty)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(the longest fitting rule as host + path, its verdict), null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # shortest first, so that the longest is asked first; of equally long ones the earlier
    for kind, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _segment(d: int) -> Column:
    """The path's segment at depth d, null below its end."""
    return F.expr(f"try_element_at(segs, {d + 1})")


def _level(paths: DataFrame, d: int) -> DataFrame:
    """``paths`` with the segment at depth d appended to ``node`` in its general form, ``closed`` where there is
    none or it belongs to the tail, and with the new nodes' ``purity`` and number of labelled pages ``own``."""
    rows = paths.withColumn("seg", _segment(d)).withColumn("number", F.col("seg").rlike(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$"))
    child = rows.where("seg IS NOT NULL AND NOT number").groupBy("host", "node", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    nodes = child.groupBy("host", "node").agg(F.count("*").alias("k"), F.sum("n").alias("all"))
    variable = nodes.select("host", "node", ((F.col("k") > MOST_BRANCHES) | (F.col("k") > FEW) & (2 * F.col("k") >= F.col("all"))).alias("variable"))
    known = child.join(variable, ["host", "node"])
    stays = known.where("variable").where(F.col("labelled") >= SUPPORT).select("host", "node", "seg", F.lit(True).alias("stays"))
    rate = F.col("blocked") / F.col("labelled")
    kids = F.sort_array(F.collect_list(F.struct(rate.alias("rate"), "seg", F.col("labelled").alias("l"), F.col("blocked").alias("b"))))  # at most MOST_BRANCHES
    groups = known.where("NOT variable AND labelled > 0").groupBy("host", "node").agg(kids.alias("kids"))
    groups = groups.select("host", "node", F.explode(_branches(F.col("kids"))).alias("segs"))
    merged = groups.where("size(segs) > 1").select("host", "node", F.explode("segs").alias("seg"), F.array_join(F.sort_array("segs"), "|").alias("merged"))
    rows = rows.join(variable.where("variable"), ["host", "node"], "left").join(merged, ["host", "node", "seg"], "left")
    rows = rows.join(stays, ["host", "node", "seg"], "left")
    ends = F.lit(False)
    if d >= DEPTH:
        mixed = paths.groupBy("host", "node").agg((F.max("open") & (F.sum("labelled") > 0)).alias("mixed"))
        rows, ends = rows.join(mixed, ["host", "node"]), ~F.col("mixed")
    token = (F.when(F.col("seg").isNull(), F.lit("")).when(ends, F.lit("/**")).when(F.col("number"), F.lit("/*"))
             .when(F.col("variable") & F.col("stays").isNull(), F.lit("/?")).otherwise(F.concat(F.lit("/"), F.coalesce("merged", "seg"))))
    rows = rows.withColumn("node", F.concat("node", token)).withColumn("closed", F.col("seg").isNull() | ends)
    return _smoothed(rows.select(*paths.columns))


def _branches(kids: Column) -> Column:
    """array<array<string>>: the children, sorted by rate, in branches; each is tested against its branch's pooled counts."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("segs"),
                     F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("b"))

    def step(acc, x):
        l, b = acc["l"] + x["l"], acc["b"] + x["b"]
        pooled = b / l
        gap = (x["rate"] - acc["b"] / acc["l"]) / F.sqrt(pooled * (1 - pooled) * (1 / x["l"] + 1 / acc["l"]))
        apart = F.when((acc["l"] == 0) | (pooled <= 0) | (pooled >= 1), F.lit(False)).otherwise(gap >= Z)
        one = F.array(x["seg"])
        return F.struct(F.when(apart, F.concat(acc["done"], F.array(acc["segs"]))).otherwise(acc["done"]).alias("done"),
                        F.when(apart, one).otherwise(F.concat(acc["segs"], one)).alias("segs"),
                        F.when(apart, x["l"]).otherwise(l).alias("l"), F.when(apart, x["b"]).otherwise(b).alias("b"))

    return F.aggregate(kids, start, step, lambda acc: F.concat(acc["done"], F.array(acc["segs"])))


def _smoothed(rows: DataFrame) -> DataFrame:
    """``purity`` of each (host, node), smoothed towards the one it had as part of its parent, and its ``own`` labels."""
    sums = rows.groupBy("host", "node").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.first("purity").alias("p"))
    purity = (F.col("b") + PRIOR_ROWS * F.col("p")) / (F.col("l") + F.lit(PRIOR_ROWS))
    nodes = sums.select("host", "node", purity.alias("purity"), F.col("l").alias("own"))
    return rows.drop("purity", "own").join(nodes, ["host", "node"]).select(*rows.columns)


def templates(paths: DataFrame, prior: float) -> DataFrame:
    """(host, path, template, purity, own) of distinct paths given as (host, path, n, labelled, blocked, open); ``prior``
    is the blocked share of the whole table."""
    tree = paths.withColumn("segs", F.expr("filter(split(path, '/'), s -> s <> '')")).withColumn("node", F.lit(""))
    tree = tree.withColumns({"closed": F.lit(False), "purity": F.lit(prior), "own": F.lit(0).cast("long")})
    tree, out, d = written(_smoothed(tree), "paths"), None, 0
    while out is None or not tree.isEmpty():
        level = written(_level(tree, d), "paths")
        done, tree, d = level.where("closed"), level.where("NOT closed"), d + 1
        out = done if out is None else out.unionByName(done)
    return out.select("host", "path", F.col("node").alias("template"), "purity", "own")


def judge(df: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None, keep: list[str] | None = None,
          label: str | None = None) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict, template and its purity (null where a rule decides).

    ``label`` names a column of 1 (blocked), 0 (fine) or null; without it the rules' verdicts are the labels."""
    keep, rules = list(keep or []), RULES if rules is None else rules
    host, path = host_and_path(F.col(f"`{url}`"))
    given = F.lit(None).cast("int") if label is None else F.col(f"`{label}`").cast("int")
    rows = df.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"), given.alias("__label"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", verdict)
    mark = F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0) if label is None else F.col("__label")
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count(mark).alias("labelled"), F.coalesce(F.sum(mark), F.lit(0)).alias("blocked"),
                                             F.max(F.col("rule").isNull()).alias("open"))
    paths = written(paths, "paths")
    total = paths.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n")).first()
    prior = (total["b"] or 0) / total["n"] if total["n"] else 0.0
    tree = written(templates(paths, prior), "templates")
    judged = tree.join(paths.where("open").select("host", "path"), ["host", "path"], "left_semi")
    out = rows.join(judged, ["host", "path"], "left")
    by_tree = F.when((F.col("own") > 0) & (F.col("purity") >= LEAST_PURITY), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule", F.coalesce("by_rule", by_tree).alias("verdict"), "template", "purity")
