"""Isotonic fits whose parts are pooled apart and merged in a tree, and their application as step functions."""

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

#: A leaf pools the distinct scores of one of these many even parts of 0..1; a task merges the blocks of ``FAN`` neighbours.
RANGES, FAN = 1024, 32

Blocks = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def pooled(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray) -> Blocks:
    """Pool adjacent violators: (first score, weighted label sum, weight, rows) of each block, means ascending.

    ``x`` ascends. Every run of means that do not ascend becomes one block at once, until none is left.
    """
    while len(x):
        mean = y / w
        starts = np.flatnonzero(np.concatenate([[True], mean[1:] > mean[:-1]]))
        if len(starts) == len(x):
            break
        x, (y, w, n) = x[starts], (np.add.reduceat(v, starts) for v in (y, w, n))
    return x, y, w, n


def merged(left: Blocks, right: Blocks) -> Blocks:
    """The blocks of two neighbouring fits as one fit.

    Both ascend, so only a tail of ``left`` and a head of ``right`` pool, into one block. Its mean is the root of a function that falls
    with v: what left blocks lie above v less what right blocks lie below it; prefix sums give it at every mean at once.
    """
    if not len(left[0]) or not len(right[0]):
        return left if len(left[0]) else right
    a, b = left[1] / left[2], right[1] / right[2]
    if a[-1] < b[0]:
        return tuple(np.concatenate(p) for p in zip(left, right))
    at = np.unique(np.concatenate([a, b]))
    over, under = np.searchsorted(a, at, "right"), np.searchsorted(b, at, "left")

    def tail(v, k):
        return v.sum() - np.concatenate([[0.0], np.cumsum(v)])[k]

    def head(v, k):
        return np.concatenate([[0.0], np.cumsum(v)])[k]

    excess = tail(left[1], over) - at * tail(left[2], over) + head(right[1], under) - at * head(right[2], under)
    mean = at[max(np.flatnonzero(excess >= 0), default=0)]
    i, j = np.searchsorted(a, mean, "right"), np.searchsorted(b, mean, "right")
    i, j = min(i, len(a) - 1), max(j, 1)
    one = (left[0][i:i + 1], *(np.array([u[i:].sum() + v[:j].sum()]) for u, v in zip(left[1:], right[1:])))
    blocks = tuple(np.concatenate([u[:i], m, v[j:]]) for u, m, v in zip(left, one, right))
    return pooled(*blocks)  # equal means and rounding beside the new block


def on_grid(p: Column, digits: int) -> Column:
    """The score rounded to ``digits`` places; a tie sits just off the exact half, so that noise in the last bit cannot move it."""
    return F.floor(p * F.lit(10.0 ** digits) + F.lit(0.5000001)) / F.lit(10.0 ** digits)


def _range(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), F.floor(x * RANGES))).cast("int")


def fit_steps(train: DataFrame, by: Sequence[str] = (), p: str = "p", label: str = "y", weight: str | None = None,
              digits: int = 6) -> DataFrame:
    """(by..., lo, value, n): the isotonic fit of the label on the score, one row per block from its least score ``lo`` on.

    Rows are added up per distinct score, rounded to ``digits`` places, so a group has at most 10^digits + 1 points however many rows it
    has, and rows of one score are combined before the shuffle. The points of each range are pooled by themselves, then ``FAN``
    neighbours' blocks are merged until one is left; no task sees more than the blocks of its part. Rows without score, label or weight,
    or with a weight that is not above 0, are no examples; an empty table has no blocks.
    """
    by = list(by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = train.filter(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")) & F.col(label).isNotNull() & (w > 0))
    rows = rows.select(*by, on_grid(F.col(p).cast("double"), digits).alias("__x"), F.col(label).cast("double").alias("__y"), w.alias("__w"))
    points = rows.groupBy(*by, "__x").agg(F.sum(F.col("__y") * F.col("__w")).alias("__sy"), F.sum("__w").alias("__sw"),
                                          F.count(F.lit(1)).alias("__n"))
    kinds = [train.schema[c] for c in by]
    shape = StructType([*kinds, StructField("__node", IntegerType()), StructField("__part", IntegerType()), StructField("__x", DoubleType()),
                        StructField("__sy", DoubleType()), StructField("__sw", DoubleType()), StructField("__n", LongType())])

    def level(blocks: DataFrame, join) -> DataFrame:
        def task(key, frame):
            frame = frame.sort_values(["__part", "__x"], kind="stable")
            parts = [tuple(f[c].to_numpy() for c in ("__x", "__sy", "__sw", "__n")) for _, f in frame.groupby("__part", sort=True)]
            x, sy, sw, n = join(parts)
            out = pd.DataFrame({"__node": int(key[-1]) // FAN, "__part": int(key[-1]), "__x": x, "__sy": sy, "__sw": sw, "__n": n})
            for c, v in zip(by, key):
                out[c] = v
            return out[[*by, "__node", "__part", "__x", "__sy", "__sw", "__n"]]

        return blocks.groupBy(*by, "__node").applyInPandas(task, shape)

    def tree(parts: list[Blocks]) -> Blocks:
        while len(parts) > 1:
            parts = [reduce(merged, parts[k:k + 2]) for k in range(0, len(parts), 2)]
        return parts[0]

    blocks = level(points.withColumns({"__node": _range(F.col("__x")), "__part": F.lit(0)}), lambda parts: pooled(*parts[0]))
    nodes = RANGES
    while nodes > 1:
        blocks, nodes = level(blocks, tree), -(-nodes // FAN)
    return blocks.select(*by, F.col("__x").alias("lo"), (F.col("__sy") / F.col("__sw")).alias("value"), F.col("__n").alias("n"))


def apply_steps(df: DataFrame, steps: DataFrame, by: Sequence[str] = (), p: str = "p", name: str = "calibrated", digits: int = 6) -> DataFrame:
    """Add the value of the last block that starts at or below the row's score; the first one's below all.

    The blocks and the distinct scores asked for are put in order within ranges of the score; a block stands in every range that it reaches.
    Rows get their value by equality of the score. Rows without a score, or of a group without blocks, get null.
    """
    by = list(by)
    order = Window.partitionBy(*by).orderBy("lo")  # at most 10^digits + 1 blocks a group
    first = F.row_number().over(order) == 1
    reach = steps.select(*by, F.when(first, F.lit(float("-inf"))).otherwise(F.col("lo")).alias("__x"), F.col("value").alias(name),
                         F.when(first, F.lit(0)).otherwise(_range(F.col("lo"))).alias("__from"),
                         F.coalesce(_range(F.lead("lo").over(order)), F.lit(RANGES - 1)).alias("__to"))
    reach = reach.select(*by, "__x", name, F.explode(F.sequence("__from", F.greatest("__from", "__to"))).alias("__r"))
    x = on_grid(F.col(p).cast("double"), digits)
    rows = df.withColumn("__x", x)
    asked = rows.filter(F.col("__x").isNotNull() & ~F.isnan("__x")).select(*by, "__x").distinct()
    asked = asked.select(*by, "__x", F.lit(None).cast("double").alias(name), _range(F.col("__x")).alias("__r"), F.lit(True).alias("__ask"))
    upto = Window.partitionBy(*by, "__r").orderBy("__x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    table = asked.unionByName(reach.withColumn("__ask", F.lit(False)))
    table = table.withColumn(name, F.last(name, ignorenulls=True).over(upto)).filter("__ask").select(*by, "__x", name)
    same = [F.col(f"__l.{c}").eqNullSafe(F.col(f"__t.{c}")) for c in by] + [F.col("__l.__x") == F.col("__t.__x")]
    found = rows.alias("__l").join(table.alias("__t"), reduce(Column.__and__, same), "left")
    return found.select(*[F.col(f"__l.{c}") for c in df.columns if c != name], F.col(f"__t.{name}"))
