"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boutline.llm.stored import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges, for nodes that have an edge.

    Every round links each node's larger neighbours, then its smaller ones, to the least of them; rounds grow with the
    logarithm of the longest chain. Each round is one table in the shared folder, so a lost executor costs one round only.
    The edge list never reaches the driver: it sees two numbers a round. Null ends and loops are ignored.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                 .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), F.col("v") > F.col("u"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _star(down, down.groupBy("u").agg(F.min("v").alias("m")), F.lit(True), own=True)
        now = stored(small, "edges")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _star(edges: DataFrame, least: DataFrame, which, own: bool = False) -> DataFrame:
    out = edges.where(which).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if own:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 24)))).first()
    return row[0], row[1]
