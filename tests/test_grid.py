"""Grid fits beside plain gradient descent, one fit at a time."""

import inspect
import math
import random

import numpy as np

from boutline.operators.grid import Grid, choose_setting, fit_grid, score_grid

COLUMNS = ["a", "b"]
GRID = Grid((0.1, 0.4), (0.0, 0.2), (3, 9))


def descend(rows, rate, penalty, epochs):
    """Plain descent over (x, y, weight)."""
    w, total = [0.0] * 3, sum(r[2] for r in rows)
    for _ in range(epochs):
        grad = [0.0] * 3
        for x, y, weight in rows:
            e = (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, [*x, 1.0])))) - y) * weight
            grad = [g + e * v for g, v in zip(grad, [*x, 1.0])]
        grad = [g / total + (penalty * v if k < 2 else 0) for k, (g, v) in enumerate(zip(grad, w))]
        w = [v - rate * g for v, g in zip(w, grad)]
    return w


def table(n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        a, b = rng.gauss(3, 2), None if rng.random() < 0.1 else rng.gauss(-1, 5)
        season = 2 if i % 3 else rng.choice([0, 1, 3, 4])  # two thirds of the rows are one season's
        rows.append((season, a, b, int(rng.random() < 1 / (1 + math.exp(3 - a))), rng.random() + 0.1))
    return rows + [(1, 1.0, 1.0, None, 1.0), (None, 1.0, 1.0, 1, 1.0)]


def scaled(rows, fold):
    """Design and scaling of the rows below the fold."""
    train = [r for r in rows if r[0] is not None and r[0] < fold]
    out = []
    for k in (1, 2):
        have = [r[k] for r in train if r[k] is not None]
        med = float(np.median(have))
        full = [med if r[k] is None else r[k] for r in train]
        out.append((med, float(np.mean(full)), float(np.std(full))))
    return lambda r: [((out[k][0] if r[k + 1] is None else r[k + 1]) - out[k][1]) / out[k][2] for k in (0, 1)]


def test_every_fit(spark):
    rows = table()
    df = spark.createDataFrame(rows, "season long, a double, b double, y int, w double").repartition(5)
    fits = fit_grid(df, COLUMNS, "y", [4, 2, 3], GRID, "w")
    assert fits.folds == [2, 3, 4] and fits.weights.shape == (3, 2, 2, 2, 3)
    for k, fold in enumerate(fits.folds):
        design = scaled(rows, fold)
        train = [(design(r), r[3], r[4]) for r in rows if r[0] is not None and r[3] is not None and r[0] < fold]
        for i, rate in enumerate(GRID.rates):
            for j, penalty in enumerate(GRID.penalties):
                for e, epochs in enumerate(GRID.epochs):
                    assert np.allclose(fits.weights[k, i, j, e], descend(train, rate, penalty, epochs), atol=1e-9)
    # Longer descents are flatter.
    assert (fits.slopes[..., 1] < fits.slopes[..., 0]).all()
    scores = {(r.season, r.setting): r for r in score_grid(df, fits, "y").collect()}
    assert len(scores) == 3 * 8
    for (season, setting), r in scores.items():
        w = fits.weights.reshape(3, 8, 3)[fits.folds.index(season), setting]
        design = scaled(rows, season)
        own = [(1 / (1 + math.exp(-sum(a * b for a, b in zip(w, [*design(x), 1.0])))), x[3]) for x in rows if x[0] == season and x[3] is not None]
        assert r.n == len(own) and math.isclose(r.log_loss, -sum(math.log(p if y else 1 - p) for p, y in own) / len(own), rel_tol=1e-9)
        assert math.isclose(r.accuracy, sum((p >= 0.5) == (y == 1) for p, y in own) / len(own))
    chosen = [r for r in choose_setting(score_grid(df, fits, "y"), (0.4, 0.2, 9)).collect() if r.chosen]
    assert sorted(r.season for r in chosen) == [2, 3, 4]
    for r in chosen:
        before = [s for s in scores.values() if s.season == r.season - 1]
        want = min(before, key=lambda s: (s.log_loss, -s.accuracy, s.setting)).setting if before else GRID.settings().index((0.4, 0.2, 9))
        assert r.setting == want


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(5, 1.0, None, 1, 1.0)], "season long, a double, b double, y int, w double")
    fits = fit_grid(df, COLUMNS, "y", [5], GRID, "w")
    assert not fits.weights.any()
    assert {(r.season, r.n, r.accuracy) for r in score_grid(df, fits, "y").collect()} == {(5, 1, 1.0)}
    empty = df.where("false")
    assert score_grid(empty, fit_grid(empty, COLUMNS, "y", [5], GRID), "y").collect() == []


def test_folds_of_other_scales(spark):
    """A column that is far wider and elsewhere in later seasons, and one with gaps, give each fold's own fit."""
    rng = random.Random(2)
    rows = [(s, rng.gauss(100.0 * s, 10.0 ** s), None if rng.random() < 0.2 * s else rng.gauss(-s, 1), rng.randrange(2), 1.0) for s in (0, 1, 2, 3) for _ in range(60)]
    df = spark.createDataFrame(rows, "season long, a double, b double, y int, w double").repartition(7)
    fits = fit_grid(df, COLUMNS, "y", [1, 2, 3], GRID, "w")
    for k, fold in enumerate(fits.folds):
        design = scaled(rows, fold)
        train = [(design(r), r[3], r[4]) for r in rows if r[0] < fold]
        assert np.allclose(fits.weights[k, 1, 1, 1], descend(train, 0.4, 0.2, 9), atol=1e-9)


def test_blocks_are_scaled_once():
    """No step makes a fold's design of the rows again (its figures are those of ``test_every_fit``)."""
    assert "_design" not in inspect.getsource(fit_grid)
