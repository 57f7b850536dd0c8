"""Data-quality checks: every check is one aggregation with a row per finding."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row and key counts; counted in two steps so no distinct is expanded."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.sum("k").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.max("k").alias("max_copies"))


def balanced_totals(log: DataFrame) -> DataFrame:
    """Seasons whose wins and losses, or home and away rows, do not balance."""
    s = log.groupBy("season").agg(
        F.sum("win").alias("wins"), F.sum(1 - F.col("win")).alias("losses"),
        F.sum("is_home").alias("home_rows"), F.sum(1 - F.col("is_home")).alias("away_rows"))
    return s.withColumn("balanced", ((F.col("wins") == F.col("losses")) & (F.col("home_rows") == F.col("away_rows"))).cast("int"))


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each rule (rules say what must hold)."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(n) for n, c in rules.items()])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col("__n").alias("checked"), F.col(n).alias("broken")) for n in rules])))


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with the reason of the first rule they break."""
    reason = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    tagged = df.withColumn("reason", reason)
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null")


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with at most one distinct value: minimum equals maximum, in one pass."""
    one = df.agg(*[x for c in columns for x in (F.min(c).cast("string").alias(f"{c}_lo"), F.max(c).cast("string").alias(f"{c}_hi"))])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"{c}_lo").eqNullSafe(F.col(f"{c}_hi")).cast("int").alias("constant")) for c in columns])))


def spot_check(df: DataFrame, keys: Sequence[str], expected: DataFrame, values: Sequence[str]) -> DataFrame:
    """Expected rows with a flag telling whether the table holds exactly those values."""
    got = df.select(*keys, *[F.col(v).alias(f"got_{v}") for v in values])
    ok = F.lit(True)
    for v in values:
        ok = ok & F.col(v).eqNullSafe(F.col(f"got_{v}"))
    return expected.join(got, list(keys), "left").withColumn("ok", ok.cast("int"))


def exclude_synthetic(df: DataFrame, flag: Column, market_columns: Sequence[str]) -> DataFrame:
    """Drop flagged rows and the columns that carry prices."""
    return df.filter(~F.coalesce(flag, F.lit(False))).drop(*market_columns)


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    from boutline.operators.quantiles import quantile_row

    med = quantile_row(df, columns, {"med": 0.5})
    return df.join(F.broadcast(med)).withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}_med")) for c in columns}).drop(*[f"{c}_med" for c in columns])


def season_scope(tables: Sequence[tuple[DataFrame, str, int]]) -> DataFrame:
    """Season best covered by all tables: (table, entity column, least entity count) each."""
    out = None
    for i, (df, entity, least) in enumerate(tables):
        c = (df.select("season", entity).distinct().groupBy("season").agg(F.count(F.lit(1)).alias(f"n{i}"))
             .filter(F.col(f"n{i}") >= least))
        out = c if out is None else out.join(c, "season")
    return out.orderBy(*[F.desc(f"n{i}") for i in range(len(tables))], F.desc("season")).limit(1)
