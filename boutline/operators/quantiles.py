"""Exact quantiles and rank statistics without sorting everything in one task."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from boutline.session import stored

ACCURACY = 100_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles, one row per (by, name, prob): columns name, prob, n, value.

    A sketch brackets each quantile; only the values inside the bracket (a few in a hundred
    thousand) are counted per distinct value and ordered.
    """
    by = list(by)
    long = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("__v")) for c in columns]))).filter("__v is not null")
    slack = 3.0 / ACCURACY
    marks = [m for p in probs for m in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = long.groupBy(*by, "name").agg(
        F.count(F.lit(1)).alias("n"), F.min("__v").alias("__lowest"), F.max("__v").alias("__highest"),
        F.percentile_approx("__v", marks, ACCURACY).alias("__m"))
    # Below this size one rank is wider than the bracket, and ordering every value is cheap.
    few = F.col("n") < 2 * ACCURACY
    brackets = sketch.select(*by, "name", "n", F.inline(F.array(*[
        F.struct(F.lit(p).alias("prob"),
                 F.when(few, F.col("__lowest")).otherwise(F.col("__m")[2 * i]).alias("__lo"),
                 F.when(few, F.col("__highest")).otherwise(F.col("__m")[2 * i + 1]).alias("__hi")) for i, p in enumerate(probs)])))
    # A row per group, column and probability: Spark sends it to every task if it is small, by its measured size.
    # Everything below a bracket only matters as a count, so it is folded into one value per bracket.
    near = (long.join(stored(brackets, "brackets"), [*by, "name"])
            .filter(F.col("__v") <= F.col("__hi"))
            .withColumn("__v", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")))
            .groupBy(*by, "name", "prob", "n", "__v").agg(F.count(F.lit(1)).alias("__k")))
    w = Window.partitionBy(*by, "name", "prob").orderBy(F.asc_nulls_first("__v"))
    upto = near.withColumn("__upto", F.sum("__k").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = (F.col("n") - 1) * F.col("prob")

    def at(k):
        return F.min(F.when(F.col("__upto") > k, F.col("__v")))

    low, high = F.floor(rank), F.ceil(rank)
    found = upto.groupBy(*by, "name", "prob", "n").agg(
        at(low).alias("__a"), at(high).alias("__b"), F.max(F.when(F.col("__v").isNull(), F.col("__upto"))).alias("__below"), F.max("__upto").alias("__reached"))
    # Both ranks must stand inside the bracket: above what was folded away below it, and not beyond what was counted.
    inside = (F.coalesce("__below", F.lit(0)) <= low) & (F.col("__reached") > high)
    found = found.withColumn("__a", F.when(inside, F.col("__a")).otherwise(F.raise_error(F.lit("a quantile fell outside its bracket")).cast("double")))
    return (found
            .select(*by, "name", "prob", "n",
                    (F.col("__a") + (F.col("__b") - F.col("__a")) * (rank - low)).alias("value")))


def quantile_row(df: DataFrame, columns: Sequence[str], probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """The same quantiles as one wide row per group: <column>_<label>."""
    long = exact_quantiles(df, columns, list(probs.values()), by)
    aggs = [F.max(F.when((F.col("name") == c) & (F.col("prob") == p), F.col("value"))).alias(f"{c}_{label}")
            for c in columns for label, p in probs.items()]
    return long.groupBy(*by).agg(*aggs) if by else long.agg(*aggs)


def robust_stats(df: DataFrame, columns: Sequence[str], variant: str = "iqr", by: Sequence[str] = ()) -> DataFrame:
    """Median and robust scale per column, and per group ``by``; ``spread`` also allows half the standard deviation."""
    by = list(by)
    wide = quantile_row(df, columns, {"q1": 0.25, "med": 0.5, "q3": 0.75}, by)
    sd = df.groupBy(*by).agg(*[F.stddev_pop(c).alias(f"{c}_sd") for c in columns])
    both = wide.join(sd, by) if by else wide.join(F.broadcast(sd))
    rows = []
    for c in columns:
        scale = (F.col(f"{c}_q3") - F.col(f"{c}_q1")) / 1.349
        if variant == "spread":
            scale = F.greatest(scale, F.col(f"{c}_sd") * 0.5)
        rows.append(F.struct(F.lit(c).alias("name"), F.col(f"{c}_med").alias("median"),
                             F.greatest(scale, F.lit(1e-6)).alias("scale")))
    return both.select(*by, F.inline(F.array(*rows)))


def auc(pred: DataFrame, by: Sequence[str], p: str = "p", y: str = "y", buckets: int = 65_536) -> DataFrame:
    """Exact ROC AUC per group: ties count one half.

    Scores are counted per distinct value, then ordered inside score buckets whose lower
    neighbours are known from a table of bucket totals.
    """
    by = list(by)
    value = pred.groupBy(*by, F.col(p).alias("p")).agg(
        F.sum(F.col(y)).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    value = value.withColumn("bucket", F.floor(F.col("p") * buckets))
    totals = value.groupBy(*by, "bucket").agg(F.sum("neg").alias("neg_b"))
    lower = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(*by, "bucket", F.coalesce(F.sum("neg_b").over(lower), F.lit(0)).alias("neg_before"))
    inside = Window.partitionBy(*by, "bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("neg_before") + F.coalesce(F.sum("neg").over(inside), F.lit(0))
    scored = value.join(start, [*by, "bucket"]).withColumn("won", F.col("pos") * (below + F.col("neg") * 0.5))
    return scored.groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))
