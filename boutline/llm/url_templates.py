"""URL filter: fixed host and path rules first, then a tree of path templates judged by labelled purity.

The tree is built level by level over distinct (host, path) with counts. At each node a child becomes a wildcard if its
segment is variable (runs of digits are, and so are rare children of a node with too many different ones), or if its labels
do not differ from its siblings' beyond a Hoeffding bound: such branches are merged. A template is rejected if its smoothed
share of bad labels is at least one half; the share is smoothed towards its host's, and that towards all hosts'.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from boutline.llm.stored import spread_join, stored


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


class Tree(NamedTuple):
    """Parameters: levels below the host (deeper segments are one ``**``), rows from which a node may be too varied, the share
    of its rows that keeps a child of such a node, the error rate of the merge test, and the weight of the smoothing."""

    levels: int = 3
    varied: int = 8
    share: float = 0.1
    error: float = 0.05
    weight: float = 4.0

    @property
    def bound(self) -> float:
        return math.sqrt(0.5 * math.log(2 / self.error))


def host_and_path(url):
    """Columns host (A-Z lower-cased) and path of a url column; both empty for null and without ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit("")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_columns(host, path, rules: list[Rule]):
    """Columns (rule, verdict) of the longest rule that fits, null without one; of rules as long the first listed wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def templates(urls: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """(host, path, template, purity) of distinct ``urls`` (host, path, label: 1 bad, 0 good, null unknown; a row per page).

    ``purity`` is the smoothed share of bad labels. No group is brought together: every step is a sum by key, or a join with
    one row per key that spreads frequent keys.
    """
    parts = F.split("path", "/", -1)
    nodes = (urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
             .withColumn("parts", parts).withColumn("t", F.lit("")))
    nodes = stored(nodes, "nodes")
    for i in range(1, tree.levels + 1):
        word = F.regexp_replace(F.try_element_at("parts", F.lit(i + 1)), "[0-9]+", "#")
        own = nodes.withColumn("w", word)
        child = own.where("w is not null").groupBy("host", "t", "w").agg(*[F.sum(c).alias(c) for c in ("n", "known", "bad")])
        node = child.groupBy("host", "t").agg(F.sum("n").alias("all_n"), F.count("*").alias("kinds"), F.sum("known").alias("all_known"), F.sum("bad").alias("all_bad"))
        others = F.col("all_known") - F.col("known")
        varied = (F.col("all_n") >= tree.varied) & (F.col("kinds") * 2 > F.col("all_n")) & (F.col("n") < F.col("all_n") * tree.share)
        apart = F.abs(F.col("bad") / F.nullif("known", F.lit(0)) - (F.col("all_bad") - F.col("bad")) / F.nullif(others, F.lit(0)))
        margin = F.lit(tree.bound) * (1 / F.sqrt(F.nullif(F.col("known").cast("double"), F.lit(0.0))) + 1 / F.sqrt(F.nullif(others.cast("double"), F.lit(0.0))))
        literal = child.join(node, ["host", "t"]).where(~varied & (apart >= margin)).select("host", "t", "w", F.lit(True).alias("literal"))
        joined = spread_join(own, literal, ["host", "t", "w"], "path", how="left")
        step = F.when(F.col("w").isNull(), F.col("t")).otherwise(F.concat("t", F.lit("/"), F.when(F.col("literal"), F.col("w")).otherwise(F.lit("*"))))
        nodes = stored(joined.withColumn("t", step).drop("w", "literal"), "nodes")
    nodes = nodes.withColumn("t", F.when(F.size("parts") > tree.levels + 1, F.concat("t", F.lit("/**"))).otherwise(F.col("t"))).drop("parts")
    every = nodes.agg(F.sum("known").alias("k"), F.sum("bad").alias("b")).first()
    base = ((every.b or 0) + 0.5) / ((every.k or 0) + 1.0)
    hosts = nodes.groupBy("host").agg(F.sum("known").alias("hk"), F.sum("bad").alias("hb"))
    kinds = nodes.groupBy("host", "t").agg(F.sum("known").alias("tk"), F.sum("bad").alias("tb"))
    prior = (F.col("hb") + F.lit(tree.weight) * F.lit(base)) / (F.col("hk") + F.lit(tree.weight))
    judged = kinds.join(hosts, "host").select("host", "t", ((F.col("tb") + F.lit(tree.weight) * prior) / (F.col("tk") + F.lit(tree.weight))).alias("purity"))
    return spread_join(nodes.select("host", "path", "t"), judged, ["host", "t"], "path").select("host", "path", F.concat("host", "t").alias("template"), "purity")


def judge_urls(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, page_id: str = "page_id", url: str = "url",
               tree: Tree = Tree()) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every row of ``pages``.

    A page that a rule fits has the rule's verdict. The others are blocked if their template's purity is at least one half.
    Labels are the rules' own verdicts, and those in ``labels`` (page_id, bad 0/1) for pages without a rule. Null urls and urls
    without ``://`` have an empty host and path and one template of their own. Rows that share an id have each their result;
    a null id has no label of its own; other columns are ignored.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("__id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "fixed": verdict})
    rows = rows.withColumn("label", F.when(F.col("fixed") == "block", 1).when(F.col("fixed") == "allow", 0))
    if labels is not None:
        given = labels.groupBy(F.col(page_id).alias("__id")).agg(F.max("bad").cast("int").alias("bad"))
        rows = rows.join(given, "__id", "left").withColumn("label", F.coalesce("label", "bad")).drop("bad")
    judged = templates(rows.select("host", "path", "label"), tree)
    found = F.when(F.col("purity") >= 0.5 - 1e-9, "block").otherwise("allow")
    return (spread_join(rows, judged, ["host", "path"], "__id")
            .select(F.col("__id").alias(page_id), "host", "path", "rule", F.coalesce("fixed", found).alias("verdict"), "template"))


def oracle(rules: list[Rule], tree: Tree = Tree()) -> str:
    """The same in plain SQL over ``pages``."""
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    cases = {"rule": "", "fixed": ""}
    for r in sorted(rules, key=lambda r: -len(r.host + r.path)):
        when = f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN "
        cases["rule"] += f"{when}'{r.host + r.path}' "
        cases["fixed"] += f"{when}'{r.verdict}' "
    sql = f"""WITH rest AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), {lower}) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, CASE {cases['rule']}END AS rule, CASE {cases['fixed']}END AS fixed FROM cut),
n0 AS (SELECT host, path, string_split(path, '/') AS parts, '' AS t, count(*) AS n, count(fixed) AS known,
  count(*) FILTER (WHERE fixed = 'block') AS bad FROM ruled GROUP BY host, path)"""
    for i in range(1, tree.levels + 1):
        sql += f""",
o{i} AS (SELECT *, regexp_replace(CASE WHEN len(parts) >= {i + 1} THEN parts[{i + 1}] END, '[0-9]+', '#', 'g') AS w FROM n{i - 1}),
c{i} AS (SELECT host, t, w, sum(n) AS n, sum(known) AS known, sum(bad) AS bad FROM o{i} WHERE w IS NOT NULL GROUP BY 1, 2, 3),
a{i} AS (SELECT *, sum(n) OVER p AS an, count(*) OVER p AS kinds, sum(known) OVER p AS ak, sum(bad) OVER p AS ab FROM c{i} WINDOW p AS (PARTITION BY host, t)),
l{i} AS (SELECT host, t, w FROM a{i} WHERE NOT (an >= {tree.varied} AND kinds * 2 > an AND n < an * {tree.share}) AND known > 0 AND ak > known
  AND abs(CAST(bad AS DOUBLE) / known - CAST(ab - bad AS DOUBLE) / (ak - known)) >= {tree.bound!r} * (1 / sqrt(CAST(known AS DOUBLE)) + 1 / sqrt(CAST(ak - known AS DOUBLE)))),
n{i} AS (SELECT host, path, parts, n, known, bad, CASE WHEN w IS NULL THEN t WHEN EXISTS (SELECT 1 FROM l{i} WHERE l{i}.host = o{i}.host AND l{i}.t = o{i}.t
  AND l{i}.w = o{i}.w) THEN t || '/' || w ELSE t || '/*' END AS t FROM o{i})"""
    return sql + f""",
z AS (SELECT host, path, known, bad, CASE WHEN len(parts) > {tree.levels + 1} THEN t || '/**' ELSE t END AS t FROM n{tree.levels}),
h AS (SELECT host, (sum(bad) + {tree.weight} * (SELECT (sum(bad) + 0.5e0) / (sum(known) + 1e0) FROM z)) / (sum(known) + {tree.weight}) AS prior FROM z GROUP BY host),
p AS (SELECT host, t, (sum(bad) + {tree.weight} * any_value(prior)) / (sum(known) + {tree.weight}) AS purity FROM z JOIN h USING (host) GROUP BY host, t)
SELECT page_id, ruled.host, ruled.path, rule, coalesce(fixed, CASE WHEN purity >= 0.5 - 1e-9 THEN 'block' ELSE 'allow' END) AS verdict, z.host || z.t AS template
FROM ruled JOIN z ON z.host = ruled.host AND z.path = ruled.path JOIN p ON p.host = z.host AND p.t = z.t"""
