"""Fitted models: MLlib estimators over feature tables, one fit per walk-forward fold."""

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from boutline.functions.odds import clamp, hit, log_loss, logit
from boutline.operators.isotonic import apply_steps, fit_steps
from boutline.operators.joins import attach_row
from boutline.operators.quantiles import quantile_row
from boutline.operators.timeline import with_running
from boutline.session import stored


def fold_stats(df: DataFrame, columns: Sequence[str], seasons: Sequence[int]) -> DataFrame:
    """Median, mean and spread of every column over the seasons before each fold's, one row per fold.

    All folds come from one pass over the rows; a column's mean and spread count a gap as its median.
    """
    folds = F.array(*[F.lit(s) for s in seasons])
    train = df.select(*columns, F.explode(F.filter(folds, lambda s: s > F.col("season"))).alias("fold"))
    med = quantile_row(train, columns, {"med": 0.5}, ["fold"])
    rows = train.join(F.broadcast(med), "fold")  # one row per fold
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}_med"), F.lit(0.0)) for c in columns}
    stats = rows.withColumns(filled).groupBy("fold").agg(*[x for c in columns for x in (
        F.first(f"{c}_med").alias(f"{c}_med"), F.avg(c).alias(f"{c}_mu"), F.stddev_pop(c).alias(f"{c}_sd"))])
    return stats.withColumns({f"{c}_sd": F.coalesce(F.nullif(F.col(f"{c}_sd"), F.lit(0.0)), F.lit(1.0)) for c in columns})


def scale(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill gaps with the median and standardise, by one row of statistics."""
    rows = attach_row(df, stats)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}_med"), F.lit(0.0)) for c in columns}
    rows = rows.withColumns({c: (v - F.col(f"{c}_mu")) / F.col(f"{c}_sd") for c, v in filled.items()})
    return rows.drop(*stats.columns)


def prep(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Median imputation and standardisation, both learned on the training rows only."""
    learn = train.select(*columns, F.lit(0).alias("season"))
    stats = stored(fold_stats(learn, columns, [1]), "scaling")
    return scale(train, stats, columns), scale(test, stats, columns)


def logistic(columns: Sequence[str], label: str, strength: float, weight: str | None = None, intercept: bool = True) -> Pipeline:
    """L2 logistic regression on already scaled columns; ``strength`` is the penalty per row."""
    lr = LogisticRegression(featuresCol="x", labelCol=label, regParam=strength, elasticNetParam=0.0,
                            standardization=False, fitIntercept=intercept, maxIter=50)
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="x"), lr])


def trees(columns: Sequence[str], label: str, kind: str = "boosted", weight: str | None = None, size: int = 120) -> Pipeline:
    """Boosted (``size`` rounds) or bagged (``size`` trees) trees; each round of boosting is a pass over the rows."""
    cls = {"boosted": lambda: GBTClassifier(featuresCol="x", labelCol=label, maxDepth=3, maxIter=size, stepSize=0.2, seed=7),
           "bagged": lambda: RandomForestClassifier(featuresCol="x", labelCol=label, maxDepth=4, numTrees=size, seed=7)}[kind]()
    if weight:
        cls = cls.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="x"), cls])


def predict(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("x", "rawPrediction", "probability", "prediction")


def walk_forward(df: DataFrame, columns: Sequence[str], label: str, seasons: Sequence[int],
                 build: Callable[[int], Pipeline], min_train: int = 2) -> DataFrame:
    """Out-of-fold probabilities: each season scored by a fit on all earlier seasons."""
    tests = sorted(seasons)[min_train:]
    stats = stored(fold_stats(df, columns, tests), "scaling")
    out = None
    for season in tests:
        one = stats.filter(F.col("fold") == season)
        train = scale(df.filter(F.col("season") < season), one, columns).persist()
        part = predict(build(train.count()).fit(train), scale(df.filter(F.col("season") == season), one, columns))
        train.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def coefficients(model: PipelineModel, columns: Sequence[str], n: int) -> DataFrame:
    """Largest coefficients by size."""
    lr = model.stages[-1]
    spark = SparkSession.active()
    rows = [(c, float(w)) for c, w in zip(columns, lr.coefficients)]
    return spark.createDataFrame(rows, "feature string, weight double").orderBy(F.desc(F.abs("weight")), "feature").limit(n)


def platt(train: DataFrame, test: DataFrame, p: str = "p", label: str = "y", weight: str | None = None) -> DataFrame:
    """Logistic curve on the logit of p."""
    model = logistic(["z"], label, 1e-3, weight).fit(train.withColumn("z", logit(p)))
    return predict(model, test.withColumn("z", logit(p)), "calibrated").drop("z")


def beta_calibration(train: DataFrame, test: DataFrame, p: str = "p", label: str = "y") -> DataFrame:
    """Logistic on ln p and -ln(1-p)."""
    def parts(df):
        q = clamp(p, 1e-6, 1 - 1e-6)
        return df.withColumns({"b1": F.log(q), "b2": -F.log(1.0 - q)})

    return predict(logistic(["b1", "b2"], label, 1e-3).fit(parts(train)), parts(test), "calibrated").drop("b1", "b2")


def isotonic(train: DataFrame, test: DataFrame, p: str = "p", label: str = "y", weight: str | None = None,
             by: Sequence[str] = ()) -> DataFrame:
    """Isotonic fit (per ``by``) applied as a step function: the value of the last block at or below p, the first one's below all.

    Blocks stay a table, from the fit to the rows that look their value up.
    """
    steps = stored(fit_steps(train, by, p, label, weight), "steps")
    return apply_steps(test, steps, by, p)


def stack(train: DataFrame, test: DataFrame, models: Sequence[str], label: str = "y", intercept: bool = True) -> DataFrame:
    """Logistic stack on the logits of several models."""
    def z(df):
        return df.withColumns({f"z_{m}": logit(f"p_{m}") for m in models})

    fit = logistic([f"z_{m}" for m in models], label, 1e-4, intercept=intercept).fit(z(train))
    return predict(fit, z(test), "stacked").drop(*[f"z_{m}" for m in models])


def vote(models: Sequence[str]):
    """Mean probability of several models."""
    return sum((F.col(f"p_{m}") for m in models[1:]), F.col(f"p_{models[0]}")) / float(len(models))


def kfold_stack(df: DataFrame, groups: dict[str, Sequence[str]], label: str, k: int = 3) -> DataFrame:
    """Out-of-fold base models, then a logistic stack of them; folds come from a hash of the contest."""
    fold = F.pmod(F.xxhash64("game_id"), F.lit(k))
    rows = df.withColumn("fold", fold)
    out = None
    for i in range(k):
        train, test = rows.filter(F.col("fold") != i), rows.filter(F.col("fold") == i)
        part = test
        for name, columns in groups.items():
            part = predict(logistic(columns, label, 1e-3).fit(train), part, f"p_{name}")
        out = part if out is None else out.unionByName(part)
    return stack(out, out, list(groups), label)


def shuffled_places(df: DataFrame, salt: str, key: str = "game_id") -> DataFrame:
    """Column ``i``: the row's place, from 1, in the order of a salted hash over all rows.

    Places come from counts of hash prefixes and an order within each prefix, so that no task sorts everything.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(salt)))
    rows = df.withColumns({"__all": F.lit(0), "__h": h, "__b": F.substring(h, 1, 4)})
    return with_running(rows, ["__all"], "__b", ["__h", key], totals={}).withColumnRenamed("seq", "i").drop("__all", "__h", "__b")


def permutation_importance(model: PipelineModel, df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Loss increase when one column is shuffled over all rows."""
    placed = stored(shuffled_places(df, "fixed"), "placed")
    base = predict(model, df).agg(F.avg(log_loss("p", label)).alias("base"))
    out = None
    for c in columns:
        donor = shuffled_places(df.select("game_id", F.col(c).alias("__v")), c).select("__v", "i")
        swapped = placed.join(donor, "i").withColumn(c, F.col("__v"))
        part = predict(model, swapped).agg(F.avg(log_loss("p", label)).alias("loss"), F.avg(hit("p", label)).alias("accuracy"))
        part = part.select(F.lit(c).alias("feature"), "loss", "accuracy")
        out = part if out is None else out.unionByName(part)
    return attach_row(out, base).select("feature", (F.col("loss") - F.col("base")).alias("importance"), "accuracy")


def score_batch(path: str, df: DataFrame, bounds: tuple[float, float]) -> DataFrame:
    """Score with a saved pipeline; probabilities stay inside the bounds."""
    out = predict(PipelineModel.load(path), df, "raw")
    p = clamp("raw", *bounds)
    return out.withColumns({"p": F.round(p, 6), "pick_home": (p >= 0.5).cast("int")})


def leakage_r2(train: DataFrame, test: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """How well a linear fit of the final margin works out of sample, and how often it hits exactly."""
    a, b = prep(train, test, columns)
    stages = [VectorAssembler(inputCols=list(columns), outputCol="x"),
              LinearRegression(featuresCol="x", labelCol=target, predictionCol="fit", regParam=1e-6, solver="normal")]
    out = Pipeline(stages=stages).fit(a).transform(b)
    mean = out.agg(F.avg(target).alias("__m"))
    e, d = F.col(target) - F.col("fit"), F.col(target) - F.col("__m")
    return attach_row(out, mean).agg(
        F.count(F.lit(1)).alias("n"), (1.0 - F.try_divide(F.sum(e * e), F.sum(d * d))).alias("r2"),
        F.avg((F.round("fit") == F.col(target)).cast("double")).alias("exact_rate"))


def poly_correction(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Degree-2 correction of an analytic probability's features."""
    stages = [VectorAssembler(inputCols=list(columns), outputCol="v"), PolynomialExpansion(degree=2, inputCol="v", outputCol="e"),
              StandardScaler(withMean=True, withStd=True, inputCol="e", outputCol="x"),
              LogisticRegression(featuresCol="x", labelCol=label, regParam=1e-4, standardization=False, maxIter=50)]
    return predict(Pipeline(stages=stages).fit(train), test, "corrected").drop("v", "e")
