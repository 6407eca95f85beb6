"""URL filter: a tree of path templates for each host, rejected by smoothed labelled purity (DataFrame functions only).

1. Segments that vary by nature (numbers, dates, long mixed names) become wildcards; equal shapes of a host are then counted with
   their labels, and all further work is on these counts.
2. From the root of each host down, all nodes of a round together: a node is followed along what its shapes have in common to the
   place where they part. If its labelled pages are all good or all bad, or it has one shape, it is a leaf.
3. Otherwise each segment found there is held against all its siblings (z of two shares of bad labels). Segments that do not differ,
   or have no label, vary without meaning: they become one wildcard. Those that differ stay branches, and neighbours of them in the
   order of their shares that do not differ from each other are one branch. A branch goes on with all that lies below it.
4. A template is rejected if its share of bad labels, smoothed by its host's share and that by the overall share, is at least one half.

No depth, number of branches or number of pages is capped: rounds go on as long as some node has mixed labels and several shapes.
Names of branches: the segment, ``*`` for the wildcard, ``least#count`` for merged ones, nothing for pages that end there, ``**`` for
whatever is below a leaf.

Curated rules come first: the longest rule that fits decides. Labels are those of the document that the last number of the path
names; a document is bad if it is of low quality or toxic.

Defined results: a null url or one without ``://`` has an empty host and path and is allowed; hosts without labels are judged by the
overall share, and all are allowed if there are no labels at all; repeated rows are judged alike; conflicting labels of a document
count as bad; very long paths are shapes like others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dipwatch.session import stage

# Fixed values of the contract: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SIGNIFICANT = 1.96
STRENGTH = 20.0
REJECT = 0.5
VARIABLE = r"^(?:[0-9][0-9._-]*|[0-9a-f]{8}-?[0-9a-f-]{4,}|(?=[^/]*[0-9])[A-Za-z0-9_-]{12,})(\.[A-Za-z]{2,5})?$"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, verdict), or null."""
    out = None
    for verdict, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def shape_of(path: Column) -> Column:
    """Segments of the path, those that vary by nature as ``*``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))


def named_document(path: Column) -> Column:
    return F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1).try_cast("long")


def _apart(b: str, k: str, other_b: Column, other_k: Column) -> Column:
    """z of the difference between two shares of bad labels; null if one side has no label."""
    pooled = (F.col(b) + other_b) / F.nullif(F.col(k) + other_k, F.lit(0))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(F.col(k), F.lit(0)) + 1 / F.nullif(other_k, F.lit(0))))
    gap = F.abs(F.col(b) / F.nullif(F.col(k), F.lit(0)) - other_b / F.nullif(other_k, F.lit(0)))
    return F.when(gap == 0, F.lit(0.0)).otherwise(gap / F.nullif(spread, F.lit(0.0)))


def _parting(rows: DataFrame) -> DataFrame:
    """Add to each row its node's sums, what all that is left below the node begins with, and whether the node is a leaf."""
    eq = F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(eq, F.lit(False)).cast("int")
    nodes = rows.groupBy("host", "template").agg(
        F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.sum("bad").alias("fb"), F.sum("known").alias("fk"))
    nodes = nodes.select("host", "template", "fb", "fk", (F.col("lo") == F.col("hi")).alias("one"),
                         F.slice("lo", F.lit(1), F.when(first == 0, F.size("lo")).otherwise(first - 1)).alias("common"))
    leaf = F.col("one") | (F.col("fb") == 0) | (F.col("fb") == F.col("fk"))
    return rows.join(nodes, ["host", "template"]).withColumn("leaf", leaf)


def _branch_names(rows: DataFrame) -> DataFrame:
    """(host, template, own, name) of the segments ``own`` that differ from their siblings."""
    kids = rows.groupBy("host", "template", "own").agg(
        F.sum("bad").alias("b"), F.sum("known").alias("k"), F.first("fb").alias("fb"), F.first("fk").alias("fk"))
    differ = kids.filter(_apart("b", "k", F.col("fb") - F.col("b"), F.col("fk") - F.col("k")) >= SIGNIFICANT)
    differ = differ.withColumn("worse", F.col("b") * F.col("fk") > F.col("fb") * F.col("k"))
    # Segments of equal counts are one row, so few rows of a node stand in order, however many segments it has.
    key = ["host", "template", "worse"]
    alike = differ.groupBy(*key, "b", "k").agg(F.count("*").alias("m"), F.min("own").alias("least"))
    order = Window.partitionBy(*key).orderBy(F.col("b") / F.col("k"), "b", "k")
    z = _apart("b", "k", F.lag("b").over(order), F.lag("k").over(order))
    alike = alike.withColumn("opens", F.coalesce(z >= SIGNIFICANT, F.lit(True)).cast("int")).withColumn("group", F.sum("opens").over(order))
    groups = alike.groupBy(*key, "group").agg(F.sum("m").alias("size"), F.min("least").alias("first"))
    named = alike.select(*key, "b", "k", "group").join(groups, [*key, "group"])
    # A segment that is a wildcard by nature and differs is told apart from the wildcard of those that do not.
    plain = (F.col("size") == 1) & (F.col("first") != "*")
    name = F.when(plain, F.col("first")).otherwise(F.concat("first", F.lit("#"), "size"))
    return differ.join(named.select(*key, "b", "k", name.alias("name")), [*key, "b", "k"]).select("host", "template", "own", "name")


def _tree(counted: DataFrame) -> DataFrame:
    """host, shape, bad, known and the template (list of branch names) of every shape."""
    known = ["host", "shape", "bad", "known"]
    rows = counted.select(*known, F.col("shape").alias("rest"), F.array().cast("array<string>").alias("template"))
    leaves = None
    while True:
        parted = stage(_parting(rows), "nodes")
        below = F.when(F.col("one"), F.array().cast("array<string>")).otherwise(F.array(F.lit("**")))
        done = parted.filter("leaf").select(*known, F.concat("template", "common", below).alias("template"))
        leaves = done if leaves is None else leaves.unionAll(done)
        at = F.size("common")
        going = parted.filter("NOT leaf").select(
            *known, "fb", "fk", F.concat("template", "common").alias("template"), F.coalesce(F.get("rest", at), F.lit("")).alias("own"),
            F.slice("rest", at + 2, F.size("rest")).alias("rest"))
        if going.isEmpty():
            return leaves
        rows = going.join(_branch_names(going), ["host", "template", "own"], "left").select(
            *known, "rest", F.concat("template", F.array(F.coalesce("name", F.lit("*")))).alias("template"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, shape, template, rejected) from (host, path, bad), where ``bad`` is 1, 0 or null for no label."""
    counted = stage(pages.select("host", shape_of(F.col("path")).alias("shape"), "bad").groupBy("host", "shape").agg(
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("known")), "shapes")
    tree = stage(_tree(counted), "tree")
    total = counted.agg(F.sum("bad").alias("bad"), F.sum("known").alias("known")).first()
    overall = F.lit(total["bad"] / total["known"] if total["known"] else 0.0)
    hosts = counted.groupBy("host").agg(F.sum("bad").alias("hb"), F.sum("known").alias("hk"))
    leaves = tree.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("known").alias("k"))
    of_host = (F.col("hb") + STRENGTH * overall) / (F.col("hk") + STRENGTH)
    share = (F.col("b") + STRENGTH * of_host) / (F.col("k") + STRENGTH)
    judged = leaves.join(hosts, "host").select("host", "template", (share >= REJECT).alias("rejected"))
    return tree.join(judged, ["host", "template"]).select("host", "shape", "template", "rejected")


def judged_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the template of every row."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_doc")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(1)).when(
            F.col("quality").isNotNull() | F.col("toxic").isNotNull(), F.lit(0))).alias("bad"))
    rows = rows.withColumn("_named", named_document(F.col("path")))
    rows = stage(rows.join(bad, F.col("_named") == F.col("_doc"), "left").drop("_named", "_doc"), "urls")
    known = templates(rows).withColumnsRenamed({"host": "_host", "shape": "_shape"})
    rows = rows.withColumns({"_rule": rule_of(F.col("host"), F.col("path"), rules), "_own": shape_of(F.col("path"))})
    joined = rows.join(known, (F.col("host") == F.col("_host")) & (F.col("_own") == F.col("_shape")), "left")
    return joined.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("rejected") & (F.col("host") != ""), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.concat(F.col("host"), F.lit("/"), F.array_join("template", "/")).alias("template"))


def op7_url_filter(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judged_urls(pages, labels)
