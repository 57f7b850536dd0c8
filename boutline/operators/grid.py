"""Many logistic fits in one pass: every fold and every setting of a grid descends together."""

from collections.abc import Sequence
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from boutline.operators.models import fold_stats
from boutline.session import ship

#: Values added up beyond which a logistic curve is flat, and the least and greatest probability that is scored.
FLAT, LEAST = 35.0, 1e-6


class Grid(NamedTuple):
    """All combinations of these; a longer descent passes through the shorter ones, so ``epochs`` cost no fits of their own."""

    rates: Sequence[float]
    penalties: Sequence[float]
    epochs: Sequence[int]

    def settings(self) -> list[tuple[float, float, int]]:
        return list(product(self.rates, self.penalties, self.epochs))


def _design(x: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Columns with gaps filled and scaled by one fold's (median, mean, spread), and a column of ones."""
    filled = (np.where(np.isnan(x), stats[0], x) - stats[1]) / stats[2]
    return np.concatenate([filled, np.ones((len(x), 1))], 1)


def _probabilities(logits: np.ndarray) -> np.ndarray:
    """The logistic curve, in place."""
    np.clip(logits, -FLAT, FLAT, out=logits)
    np.negative(logits, out=logits)
    np.exp(logits, out=logits)
    logits += 1.0
    return np.divide(1.0, logits, out=logits)


def _numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Columns as numbers; null is NaN."""
    return [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]


class Fits(NamedTuple):
    """``weights`` by (fold, rate, penalty, epochs, column and intercept), and ``slopes``, the size of each fit's last gradient."""

    folds: list[int]
    columns: list[str]
    grid: Grid
    stats: np.ndarray
    weights: np.ndarray
    slopes: np.ndarray


def fit_grid(df: DataFrame, columns: Sequence[str], label: str, folds: Sequence[int], grid: Grid, weight: str | None = None) -> Fits:
    """Gradient descent of weighted logistic regressions with an L2 penalty (not on the intercept), from zero.

    Fold f learns from the rows with ``season`` below f, scaled by their own medians, means and spreads; without such rows its weights stay
    0. Rows without label or season are no examples. A step sums one table (fold x setting x column) over blocks of a persisted table in a
    tree; that table's size is that of the grid, whatever the rows are.

    A block is scaled once, as for the last fold, with its gaps apart and its seasons in order. Another fold's scaling is a factor and a
    shift of that, which go into the weights before a step and into the sums after it.
    """
    grid, folds, columns = Grid(*map(tuple, grid)), sorted(folds), list(columns)
    found = {r.fold: r for r in fold_stats(df.where("season is not null"), columns, folds).collect()}  # one row per fold
    stats = np.array([[[0.0 if f not in found or found[f][f"{c}_{k}"] is None else found[f][f"{c}_{k}"] for c in columns] for k in ("med", "mu", "sd")] for f in folds])
    stats[:, 2][stats[:, 2] == 0] = 1.0
    rows = df.where(F.col(label).isNotNull() & F.col("season").isNotNull()).select(
        *[F.col(c).cast("double") for c in columns], F.col(label).cast("double").alias("__y"), F.col("season").cast("double"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("__w"))
    ship(df.sparkSession)
    med, mu, sd = stats[:, 0], stats[:, 1], stats[:, 2]
    base = max([k for k, f in enumerate(folds) if f in found], default=len(folds) - 1)
    # A value v, scaled as for the last fold, is v * factor + shift in a fold; a gap is 0 there and gap in the fold.
    factor, shift, gap = sd[base] / sd, (mu[base] - mu) / sd, (med - mu) / sd

    def tables(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"t": [np.stack(_numbers(batch)).tobytes()]}, schema=pa.schema([("t", pa.binary())]))

    def block(row):
        """(columns, gaps or None, labels, weights, rows below each fold) of rows in order of their seasons."""
        table = np.frombuffer(row[0], float).reshape(len(columns) + 3, -1)
        table = table[:, np.argsort(table[-2], kind="stable")]
        x, seasons = (table[:-3] - mu[base][:, None]) / sd[base][:, None], table[-2]
        gaps = np.isnan(x)
        x[gaps] = 0.0
        return np.ascontiguousarray(x), gaps.astype(float) if gaps.any() else None, table[-3].copy(), table[-1].copy(), np.searchsorted(seasons, folds)

    # Blocks of numbers stay with their executors from step to step: this is what a row-wise DataFrame cannot hold. A lost block is made again.
    blocks = rows.mapInArrow(tables, "t binary").rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)
    pairs = list(product(grid.rates, grid.penalties))
    depth = 1 if blocks.getNumPartitions() <= 32 else 2 if blocks.getNumPartitions() <= 1024 else 3
    rate, penalty = (np.array([p[k] for p in pairs])[None, :, None] for k in (0, 1))
    width, n = len(columns) + 1, len(columns)

    def weight_sums(part):
        yield sum((np.array([w[:m].sum() for m in upto]) for *_, w, upto in part), np.zeros(len(folds)))

    def slope(weights):
        """Gradient sums of every fold and setting, in the fold's own scale."""
        of_x = weights[:, :, :-1] * factor[:, None]
        of_gap = weights[:, :, :-1] * (gap - shift)[:, None]
        always = (weights[:, :, :-1] * shift[:, None]).sum(2) + weights[:, :, -1]

        def own(part):
            out = np.zeros((len(folds), len(pairs), 2 * n + 1))
            for x, gaps, y, w, upto in part:
                for k, m in enumerate(upto):
                    if not m:
                        continue
                    z = of_x[k] @ x[:, :m]
                    if gaps is not None:
                        z += of_gap[k] @ gaps[:, :m]
                    z += always[k][:, None]
                    z = _probabilities(z)
                    z -= y[:m]
                    z *= w[:m]
                    out[k, :, :n] += z @ x[:, :m].T
                    if gaps is not None:
                        out[k, :, n:-1] += z @ gaps[:, :m].T
                    out[k, :, -1] += z.sum(1)
            yield out

        sums = blocks.mapPartitions(own).treeAggregate(np.zeros((len(folds), len(pairs), 2 * n + 1)), np.add, np.add, depth)
        one = sums[:, :, -1:]
        return np.concatenate([sums[:, :, :n] * factor[:, None] + sums[:, :, n:-1] * (gap - shift)[:, None] + one * shift[:, None], one], 2)

    try:
        now, kept, slopes = np.zeros((len(folds), len(pairs), width)), {}, {}
        total = np.maximum(blocks.mapPartitions(weight_sums).treeAggregate(np.zeros(len(folds)), np.add, np.add, depth), 1e-12)[:, None, None]
        for epoch in range(1, max(grid.epochs) + 1):
            gradient = slope(now) / total
            gradient[:, :, :-1] += penalty * now[:, :, :-1]
            now = now - rate * gradient
            if epoch in grid.epochs:
                kept[epoch], slopes[epoch] = now, np.sqrt((gradient ** 2).sum(2))
    finally:
        blocks.unpersist()
    shape = (len(folds), len(grid.rates), len(grid.penalties))
    return Fits(folds, columns, grid, stats, np.stack([kept[e].reshape(*shape, width) for e in grid.epochs], 3),
                np.stack([slopes[e].reshape(shape) for e in grid.epochs], 3))


def score_grid(df: DataFrame, fits: Fits, label: str) -> DataFrame:
    """(season, rate, penalty, epochs, n, log_loss, accuracy, slope): each fold's fits on the season after its last.

    Every task adds up its rows for all settings at once; a season that is no fold has no row.
    """
    settings, place = fits.grid.settings(), {f: k for k, f in enumerate(fits.folds)}
    flat = fits.weights.reshape(len(fits.folds), len(settings), -1)

    kinds = pa.schema([("season", pa.int64()), ("setting", pa.int32()), ("n", pa.int64()), ("loss", pa.float64()), ("hits", pa.int64())])
    ship(df.sparkSession)

    def task(batches):
        sums = {}
        for batch in batches:
            seasons, y, *x = _numbers(batch)
            for season in np.unique(seasons).astype(int).tolist():
                at, k = seasons == season, place[season]
                p, label_ = _probabilities(flat[k] @ _design(np.stack(x, 1)[at], fits.stats[k]).T), y[at]
                np.clip(p, LEAST, 1 - LEAST, out=p)
                loss = -(np.log(p) * label_ + np.log(1 - p) * (1 - label_)).sum(1)
                n, lost, hits = sums.get(season, (0, 0.0, 0))
                sums[season] = n + len(label_), lost + loss, hits + ((p >= 0.5) == (label_ == 1)).sum(1)
        for season, (n, lost, hits) in sums.items():
            yield pa.RecordBatch.from_pydict({"season": [season] * len(settings), "setting": list(range(len(settings))), "n": [n] * len(settings),
                                              "loss": lost, "hits": hits}, schema=kinds)

    own = df.where(F.col(label).isNotNull() & F.col("season").isin(fits.folds)).select(
        F.col("season").cast("long"), F.col(label).cast("double").alias("__y"), *[F.col(c).cast("double") for c in fits.columns])
    sums = own.mapInArrow(task, "season long, setting int, n long, loss double, hits long").groupBy("season", "setting").agg(
        F.sum("n").alias("n"), (F.sum("loss") / F.sum("n")).alias("log_loss"), (F.sum("hits") / F.sum("n")).alias("accuracy"))
    # As many rows as the grid has fits.
    named = pd.DataFrame([(f, i, *s, float(fits.slopes.reshape(len(fits.folds), -1)[k, i])) for k, f in enumerate(fits.folds) for i, s in enumerate(settings)],
                         columns=["season", "setting", "rate", "penalty", "epochs", "slope"])
    grid = df.sparkSession.createDataFrame(named, "season long, setting int, rate double, penalty double, epochs int, slope double")
    return sums.join(grid, ["season", "setting"])


def choose_setting(scores: DataFrame, default: tuple[float, float, int]) -> DataFrame:
    """``scores`` with ``chosen``: the setting that was best on the season before, by log loss, then accuracy, then its place in the grid.

    The first season, of which nothing came before, takes ``default``.
    """
    order = Window.partitionBy("season").orderBy("log_loss", F.desc("accuracy"), "setting")
    seasons = scores.groupBy("season").agg(F.count("*").alias("settings"))
    after = seasons.select("season", F.lag("season").over(Window.orderBy("season")).alias("before"))  # one row per season
    best = scores.withColumn("place", F.row_number().over(order)).where("place = 1").select(F.col("season").alias("before"), F.col("setting").alias("best"))
    rate, penalty, epochs = default
    usual = (F.col("rate") == rate) & (F.col("penalty") == penalty) & (F.col("epochs") == epochs)
    return (scores.join(after, "season").join(best, "before", "left")
            .withColumn("chosen", F.when(F.col("best").isNull(), usual).otherwise(F.col("setting") == F.col("best"))).drop("before", "best"))
