"""Forecast evaluation over long predictions (model_id, season, game_id, y, p)."""

import math
from collections.abc import Mapping, Sequence
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from boutline.functions.odds import brier, confidence, hit, log_loss, normal_cdf, wilson
from boutline.operators.joins import attach_row
from boutline.session import stored

Z95 = 1.959963984540054


def metric_columns(p="p", y="y", eps: float = 1e-6) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.avg(hit(p, y)).alias("accuracy"),
            F.avg(log_loss(p, y, eps)).alias("log_loss"), F.avg(brier(p, y)).alias("brier")]


def score(pred: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    return pred.groupBy(*by).agg(*metric_columns())


def metrics_rollup(pred: DataFrame) -> DataFrame:
    """Overall and by-season metrics in one pass; season is NULL on the overall row."""
    return pred.rollup("model_id", "season").agg(*metric_columns()).filter("model_id is not null")


def with_wilson(df: DataFrame, k: str, n: str) -> DataFrame:
    lo, hi = wilson(k, n)
    return df.withColumns({"wilson_low": lo, "wilson_high": hi})


def reliability(pred: DataFrame, by: Sequence[str], bins: int = 10, min_n: int = 150) -> DataFrame:
    """Reliability table on equal bins (right-open, the last one closed); empty bins are kept."""
    by = list(by)
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    got = pred.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted"), F.avg(F.col("y").cast("double")).alias("actual"))
    frame = got.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = frame.join(got, [*by, "bin"], "left").fillna({"n": 0})
    return out.withColumns({"gap": F.col("actual") - F.col("predicted"), "small": (F.col("n") < min_n).cast("int")})


def calibration_error(pred: DataFrame, by: Sequence[str], bins: int = 10, min_n: int = 30) -> DataFrame:
    table = reliability(pred, by, bins).filter("n > 0")
    gap = F.abs("gap")
    return table.groupBy(*by).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"),
        F.max(F.when(F.col("n") >= min_n, gap)).alias("max_gap"))


def confidence_tiers(pred: DataFrame, by: Sequence[str], cuts: Sequence[float], banded: bool = False,
                     small: int = 150) -> DataFrame:
    """Accuracy by confidence: at least each cut, or inside the band up to the next cut."""
    conf = F.col("conf")
    rows = pred.withColumns({"conf": confidence("p"), "hit": hit("p", "y")})
    edges = list(cuts) + [1.01]
    tiers = [F.when((conf >= lo) & ((conf < edges[i + 1]) if banded else F.lit(True)), F.lit(lo))
             for i, lo in enumerate(cuts)]
    total = Window.partitionBy(*by)
    out = (rows.select(*by, "hit", F.explode(F.array(*tiers, F.lit(-1.0))).alias("tier")).filter("tier is not null")
           .groupBy(*by, "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("correct")))
    size = F.max(F.when(F.col("tier") < 0, F.col("n"))).over(total)
    out = out.withColumn("total", size).filter("tier > 0")
    out = out.withColumns({"coverage": F.col("n") / F.col("total"), "accuracy": F.col("correct") / F.col("n"),
                           "small_sample": (F.col("n") < small).cast("int")})
    return with_wilson(out, "correct", "n")


def baselines(games: DataFrame, picks: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Pickers given as 1/0/NULL columns, scored against home_win; NULL picks and ties are skipped."""
    long = games.select(*by, "home_win", F.inline(F.array(*[
        F.struct(F.lit(n).alias("baseline"), c.cast("int").alias("pick")) for n, c in picks.items()])))
    scored = F.col("pick").isNotNull() & F.col("home_win").isNotNull()
    out = long.groupBy(*by, "baseline").agg(
        F.count(F.when(scored, 1)).alias("games"),
        F.count(F.when(scored & (F.col("pick") == F.col("home_win")), 1)).alias("correct"),
        F.count(F.when(~scored, 1)).alias("skipped"))
    return with_wilson(out.withColumn("accuracy", F.try_divide("correct", "games")), "correct", "games")


def noise_floor(games: DataFrame, p: float, spans: Mapping[str, int]) -> DataFrame:
    """Standard error and smallest detectable difference for the last n seasons."""
    seasons = games.filter("home_win is not null").groupBy("season").agg(F.count(F.lit(1)).alias("k"))
    latest = seasons.agg(F.max("season").alias("latest"))
    rows = attach_row(seasons, latest).agg(*[
        F.sum(F.when(F.col("season") > F.col("latest") - n, F.col("k"))).alias(s) for s, n in spans.items()])
    out = rows.select(F.inline(F.array(*[F.struct(F.lit(s).alias("span"), F.col(s).alias("n")) for s in spans])))
    var = p * (1.0 - p)
    return out.withColumns({"std_error": F.sqrt(F.lit(var) / F.col("n")),
                            "detectable": Z95 * F.sqrt(F.lit(2.0 * var) / F.col("n"))})


def compare_models(pred: DataFrame, models: Sequence[str]) -> DataFrame:
    """Pairwise accuracy differences against the pooled 95% threshold, for the named models."""
    totals = pred.agg(*[c for m in models for c in (
        F.sum(F.when(F.col("model_id") == m, hit("p", "y"))).alias(f"k_{m}"),
        F.count(F.when(F.col("model_id") == m, 1)).alias(f"n_{m}"))])
    rows = []
    for a, b in combinations(sorted(models), 2):
        ka, na, kb, nb = (F.col(c) for c in (f"k_{a}", f"n_{a}", f"k_{b}", f"n_{b}"))
        pooled = (ka + kb) / (na + nb)
        diff = F.abs(ka / na - kb / nb)
        limit = Z95 * F.sqrt(pooled * (1.0 - pooled) * (1.0 / na + 1.0 / nb))
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), diff.alias("diff"), limit.alias("threshold"),
                             (diff < limit).cast("int").alias("same")))
    return totals.select(F.inline(F.array(*rows)))


def common_sample(pred: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per contest all models predicted: y and p_<model>."""
    wide = pred.filter(F.col("model_id").isin(list(models))).groupBy("season", "game_id", "y").agg(
        *[F.max(F.when(F.col("model_id") == m, F.col("p"))).alias(f"p_{m}") for m in models])
    return wide.dropna(subset=[f"p_{m}" for m in models])


def paired_diff(wide: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference in correctness (a minus b) on the same contests, with a 95% interval."""
    d = hit(f"p_{a}", "y") - hit(f"p_{b}", "y")
    out = wide.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("diff"),
                   (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return out.withColumns({"low": F.col("diff") - 1.96 * F.col("se"), "high": F.col("diff") + 1.96 * F.col("se")})


def slice_metrics(pred: DataFrame, slices: Mapping[str, Column], by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Metrics on named, possibly overlapping slices."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in slices.items()]))
    return pred.withColumn("slice", F.explode(tags)).groupBy(*by, "slice").agg(*metric_columns())


def slice_test(pred: DataFrame, slices: Mapping[str, Column], min_n: int = 100, alpha: float = 0.05) -> DataFrame:
    """Favourite win rate against its price per slice: z, two-sided p, Bonferroni flag."""
    fav = confidence("p")
    won = F.when(F.col("p") >= 0.5, F.col("y")).otherwise(1 - F.col("y"))
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in slices.items()]))
    out = (pred.select(F.explode(tags).alias("slice"), fav.alias("fav"), won.cast("double").alias("won"))
           .groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.avg("fav").alias("implied"), F.avg("won").alias("actual"))
           .filter(F.col("n") >= min_n))
    se = F.sqrt(F.col("implied") * (1.0 - F.col("implied")) / F.col("n"))
    out = out.withColumns({"gap": F.col("actual") - F.col("implied"),
                           "z": F.coalesce(F.try_divide(F.col("actual") - F.col("implied"), se), F.lit(0.0))})
    out = out.withColumn("p_value", 2.0 * (1.0 - normal_cdf(F.abs("z"))))
    tests = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return out.withColumn("significant", (F.col("p_value") < alpha / tests).cast("int"))


def disagreement(wide: DataFrame, market: str, other: str) -> DataFrame:
    """Share of market misses the other model disagreed with, and its accuracy when disagreeing."""
    m, o = F.col(f"p_{market}") >= 0.5, F.col(f"p_{other}") >= 0.5
    miss, differ = m.cast("int") != F.col("y"), m != o
    right = (o.cast("int") == F.col("y")).cast("double")
    return wide.agg(
        F.count(F.when(miss, 1)).alias("misses"), F.avg(F.when(miss, differ.cast("double"))).alias("flagged"),
        F.count(F.when(differ, 1)).alias("disagreements"), F.avg(F.when(differ, right)).alias("accuracy_when_differs"))


def bucket_gap(pred: DataFrame, ours: str, theirs: str, buckets: Mapping[str, Column], min_n: int = 100) -> DataFrame:
    """Log-loss and Brier gap to an outside benchmark per bucket family."""
    tagged = pred.filter(F.col(theirs).isNotNull()).select("y", ours, theirs, F.inline(F.array(*[
        F.struct(F.lit(k).alias("family"), c.cast("string").alias("bucket")) for k, c in buckets.items()])))
    out = tagged.filter("bucket is not null").groupBy("family", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg(brier(ours, "y")).alias("our_brier"), F.avg(brier(theirs, "y")).alias("their_brier"),
        (F.avg(log_loss(ours, "y")) - F.avg(log_loss(theirs, "y"))).alias("log_loss_gap"))
    return out.filter(F.col("n") >= min_n)


def state_band(states: DataFrame, margins: tuple[int, int], centre: float, width: float) -> DataFrame:
    """What happened in comparable states: a margin range around a time left."""
    near = states.filter(F.col("margin").between(*margins) & (F.abs(F.col("frac") - centre) <= width))
    return near.agg(F.count(F.lit(1)).alias("n"), F.sum("home_won").alias("home_wins"),
                    F.avg(F.col("home_won").cast("double")).alias("actual"), F.avg("p").alias("predicted"))


def leakage_dates(df: DataFrame, day: str, sources: Sequence[str], forbidden: Sequence[str] = ("score",)) -> DataFrame:
    """Rows whose source date is not before the contest, per column; and forbidden column names."""
    counted = df.agg(*[F.sum(F.when(F.col(c) >= F.col(day), 1).otherwise(0)).alias(c) for c in sources],
                     F.count(F.lit(1)).alias("__n"))
    bad = sorted(c for c in df.columns if any(f in c.lower() for f in forbidden))
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("source"), F.col("__n").alias("rows_checked"), F.col(c).alias("violations"),
                 F.lit(",".join(bad)).alias("forbidden")) for c in sources])))


def lift_table(metrics: DataFrame, baseline: str) -> DataFrame:
    """Metric differences to the baseline model's row."""
    base = metrics.filter(F.col("model_id") == baseline).select(
        F.col("accuracy").alias("b_acc"), F.col("log_loss").alias("b_ll"), F.col("brier").alias("b_br"))
    return attach_row(metrics, base).select(
        "model_id", (F.col("accuracy") - F.col("b_acc")).alias("accuracy_lift"),
        (F.col("log_loss") - F.col("b_ll")).alias("log_loss_delta"), (F.col("brier") - F.col("b_br")).alias("brier_delta"))


def slice_override(pred: DataFrame, rule: Column, alternative: Column) -> DataFrame:
    """Replace the probability where the rule holds."""
    return pred.withColumn("p", F.when(F.coalesce(rule, F.lit(False)), alternative).otherwise(F.col("p")))


_PRIME = (1 << 31) - 1
#: Cumulative Poisson(1) probabilities of the counts 0, 1, ... 10.
_POISSON = list(accumulate(math.exp(-1) / math.factorial(k) for k in range(11)))
_SLICE = 2048


def bootstrap_counts(block: np.ndarray, draws: int) -> np.ndarray:
    """(block x draw): how often each draw takes a block, a Poisson(1) count out of whole-number arithmetic on both."""
    mixed = np.fmod(np.fmod(block.astype(np.int64), _PRIME)[:, None] * 2654435761 + np.arange(draws) * 40503 + 12345, _PRIME)
    for _ in range(3):
        mixed = np.fmod(mixed * 48271 + 11, _PRIME)
    return np.searchsorted(_POISSON, mixed / _PRIME, side="right")


def block_bootstrap(pred_wide: DataFrame, a: str, b: str, draws: int, block: str = "game_id") -> DataFrame:
    """Bootstrap of the log-loss difference (a minus b), resampling whole contests.

    Contests are summed first; each draw weights a contest by a count that depends on (contest, draw) alone, so a rerun of any task, or
    another engine, gives the same draw. A task adds its contests up into one array for all draws; those arrays are all that is shuffled.
    Contests without a number or without a loss are left out.
    """
    sums = pred_wide.groupBy(F.col(block).cast("long").alias("__block")).agg(
        F.sum(log_loss(f"p_{a}", "y") - log_loss(f"p_{b}", "y")).alias("d"), F.count(F.lit(1)).cast("double").alias("k"))
    sums = stored(sums.filter("__block is not null and d is not null"), "blocks")

    def task(batches):
        total = np.zeros((2, draws))
        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                part = batch.iloc[at:at + _SLICE]
                total += part[["d", "k"]].to_numpy().T @ bootstrap_counts(part["__block"].to_numpy(), draws)
        yield pd.DataFrame({"draw": np.arange(draws), "d": total[0], "k": total[1]})

    arrays = sums.mapInPandas(task, "draw long, d double, k double")
    per_draw = arrays.groupBy("draw").agg(F.try_divide(F.sum("d"), F.sum("k")).alias("diff"))
    point = sums.agg(F.try_divide(F.sum("d"), F.sum("k")).alias("point"))
    spread = per_draw.agg(F.count(F.lit(1)).alias("draws"), F.avg("diff").alias("mean"),
                          F.percentile("diff", F.lit(0.025)).alias("low"), F.percentile("diff", F.lit(0.975)).alias("high"))
    return attach_row(spread, point)


def log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! by Stirling's series, exact to rounding."""
    n = np.asarray(n, float)
    small = np.cumsum(np.concatenate([[0.0], np.log(np.arange(1.0, 32.0))]))
    x = np.maximum(n, 31.0)
    series = (x + 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5)
    return np.where(n < 32, small[np.minimum(n, 31).astype(int)], series)


def hypergeometric(good: int, bad: int, taken: int, u: np.ndarray) -> np.ndarray:
    """Quantiles at ``u`` of the number of good ones among ``taken``; sizes have no upper limit.

    Probabilities are summed over twelve standard deviations around the mean, beyond which nothing is left in double precision.
    """
    n = good + bad
    low, high = max(0, taken - bad), min(good, taken)
    mean = taken * good / max(n, 1)
    sd = math.sqrt(max(mean * (bad / max(n, 1)) * (n - taken) / max(n - 1, 1), 0.0))
    k = np.arange(max(low, int(mean - 12 * sd) - 2), min(high, int(mean + 12 * sd) + 2) + 1)
    lp = -(log_factorial(k) + log_factorial(good - k) + log_factorial(taken - k) + log_factorial(bad - taken + k))
    p = np.exp(lp - lp.max())
    return k[np.minimum(np.searchsorted(np.cumsum(p) / p.sum(), u), len(k) - 1)]


def permutation_check(pred: DataFrame, draws: int, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy under shuffled labels, per ``by``: mean, maximum, and the share of draws at least as good.

    With fixed picks, a random permutation of all labels only moves how many picked-home contests are home wins, which is
    hypergeometric. So the rows are counted once, and each draw is one random number; the same at every size.
    """
    picked = (F.col("p") >= 0.5).cast("long")
    counts = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(picked).alias("picked"), F.sum("y").cast("long").alias("wins"),
                                   F.sum(hit("p", "y")).alias("hits"))
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*by).schema)

    def shuffled(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                n, k, w = int(row.n), int(row.picked), int(row.wins)
                both = hypergeometric(w, n - w, k, np.random.default_rng(20).random(draws))
                acc = (2.0 * both + n - k - w) / n
                real = row.hits / n
                out.append((*[getattr(row, b) for b in by], real, draws, acc.mean(), acc.max(), float((acc >= real).mean())))
            yield pd.DataFrame(out, columns=[*by, "accuracy", "draws", "mean_shuffled", "max_shuffled", "p_value"])

    return counts.where("n > 0").mapInPandas(shuffled, (keys + ", " if keys else "")
                                            + "accuracy double, draws long, mean_shuffled double, max_shuffled double, p_value double")
