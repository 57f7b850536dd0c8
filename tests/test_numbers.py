import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutline.functions import calendar as K, cleaning as L, clocks as C, odds as O
from boutline.operators import evaluate as E, folds as M2, models as M, quantiles as Q, states as X
from boutline.operators.joins import attach_row
from boutline.operators.models import shuffled_places
from boutline.plans.modelling import seasons


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_quantiles_and_auc(spark):
    rng = random.Random(1)
    rows = [(i % 3, rng.choice([rng.random(), 0.25, 0.5]), rng.randrange(2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "m int, p double, y int")
    got = {(r.m, r.prob): r.value for r in Q.exact_quantiles(df, ["p"], [0.0, 0.1, 0.5, 0.9, 1.0], ["m"]).collect()}
    auc = {r.m: r.auc for r in Q.auc(df, ["m"], buckets=16).collect()}
    for m in range(3):
        v = np.array([r[1] for r in rows if r[0] == m])
        for p in (0.0, 0.1, 0.5, 0.9, 1.0):
            assert got[(m, p)] == pytest.approx(np.quantile(v, p))
        pos, neg = (np.array([r[1] for r in rows if r[0] == m and r[2] == y]) for y in (1, 0))
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert auc[m] == pytest.approx(want)
    all_ = Q.exact_quantiles(df, ["p"], [0.5]).first()
    assert (all_.n, all_.value) == (3000, pytest.approx(np.median([r[1] for r in rows])))


def test_quantiles_by_sketch(spark, monkeypatch):
    """A coarse sketch on more rows than its limit, so the brackets are really used."""
    monkeypatch.setattr(Q, "ACCURACY", 500)
    v = np.random.default_rng(2).normal(size=4001)
    df = spark.createDataFrame([(float(x),) for x in v], "p double")
    got = {r.prob: r.value for r in Q.exact_quantiles(df, ["p"], [0.0, 0.013, 0.25, 0.5, 0.9, 1.0]).collect()}
    for p, value in got.items():
        assert value == pytest.approx(np.quantile(v, p), abs=1e-12)
    few = spark.createDataFrame([(float(x),) for x in range(10)], "p double")
    assert Q.exact_quantiles(few, ["p"], [0.25]).first().value == pytest.approx(2.25)


def test_normal_cdf(spark):
    zs = [i / 20 for i in range(-120, 121)]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(O.normal_cdf("z").alias("p")).collect()
    for z, r in zip(zs, got):
        assert r.p == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), rel=3e-7, abs=1e-12)


def test_null_in_null_out(spark):
    null = F.lit(None).cast("double")
    for col in (O.clamp(null, 0, 1), O.logit(null), O.implied_prob(null), O.log_loss(null, F.lit(1)), O.normal_wp(null, null, 0.0, 1.0)):
        assert one(spark, col) is None
    assert one(spark, O.wilson(F.lit(0), F.lit(0))[0]) is None


@pytest.mark.parametrize("text,want", [("9:51", 591.0), ("0.0", 0.0), ("", None), ("x:10", None), ("12", 12.0), (None, None)])
def test_clock(spark, text, want):
    assert one(spark, C.clock_seconds(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("league,period,clock,want", [
    ("nba", 1, 720.0, 1.0), ("nba", 4, 0.0, 0.0), ("nba", 5, 100.0, 0.0), ("nhl", 1, 0.0, 1.0), ("nhl", 3, 1200.0, 0.0),
    ("nfl", 3, None, 0.5), ("nba", 2, 360.0, 0.625)])
def test_frac_remaining(spark, league, period, clock, want):
    assert one(spark, C.frac_remaining_clock(league, F.lit(period), F.lit(clock).cast("double"))) == pytest.approx(want)


@pytest.mark.parametrize("text,want", [("2024-25", 2025), ("20242025", 2025), ("202425", 2025), ("2025", 2025), ("1999-00", 2000), ("x", None)])
def test_season(spark, text, want):
    assert one(spark, K.parse_season(F.lit(text))) == want


def test_text_keys(spark):
    assert one(spark, L.norm_key(F.lit("Montréal Canadiens!"))) == "montrealcanadiens"
    assert one(spark, L.as_int(F.lit(" 12.9 "))) == 12 and one(spark, L.clean(F.lit(" n/a "))) is None


def test_normal_wp_is_monotone(spark):
    df = spark.range(-60, 61).select(F.col("id").alias("m")).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(41)))).withColumn("f", F.col("f") / 41.0)
    rows = df.select("m", "f", O.normal_wp("m", "f", 0.0, 12.0).alias("p")).collect()
    grid = {(r.m, r.f): r.p for r in rows}
    for (m, f), p in grid.items():
        assert 0 <= p <= 1
        if (m + 1, f) in grid:
            assert grid[(m + 1, f)] >= p - 1e-9


def test_surface_steps(tables):
    states = tables.states()
    analytic = X.monotone_surface(X.raw_surface(states, (-20, 20), 0.0, 8.0, 1.0, 0.0))
    for linear in (False, True):
        for r in X.monotone_audit(analytic, (-20, 20), sweep=401, linear=linear).collect():
            assert (r.time_drops, r.margin_drops) == (0, 0)
    # The margin step comes last, so it always holds; a deficit never gains with time either.
    learned = X.monotone_surface(X.raw_surface(states, (-20, 20), 0.5, 8.0, 0.6, 0.5))
    for r in X.monotone_audit(learned, (-20, 20), sweep=401).collect():
        assert r.margin_drops == 0 and (r.margin >= 0 or r.time_drops == 0)


def test_fit_normal_wp(spark):
    rng = np.random.default_rng(4)
    frac, mu, sigma = rng.uniform(0.05, 1, 6000), 2.0, 11.0
    margin = np.round(rng.normal(0, 8, 6000))
    won = (margin + rng.normal(mu * frac, sigma * np.sqrt(frac))) > 0
    df = spark.createDataFrame([(int(m), float(round(f, 2)), int(w)) for m, f, w in zip(margin, frac, won)], "margin int, frac double, home_won int")
    m, s = X.fit_normal_wp(df)
    assert abs(m - mu) < 1.2 and abs(s - sigma) < 1.5
    # No neighbour of the found point has a lower loss, whichever the objective.
    z = lambda a, b: np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in (margin + a * np.round(frac, 2)) / (b * np.sqrt(np.round(frac, 2)))])
    for objective, loss in (("log_loss", lambda p: -np.mean(np.log(np.where(won, p, 1 - p).clip(1e-6, 1 - 1e-6)))), ("brier", lambda p: np.mean((p - won) ** 2))):
        m, s = X.fit_normal_wp(df, objective)
        least = loss(z(m, s))
        assert all(loss(z(m + dm, s + ds)) > least for dm, ds in ((0.02, 0), (-0.02, 0), (0, 0.02), (0, -0.02), (3, 3), (-3, 3), (3, -3)))


def test_bootstrap_and_permutation(tables):
    wide = E.common_sample(tables.preds(), ["form", "market", "prior"])
    r = E.block_bootstrap(wide, "form", "market", 200).first()
    assert r.low <= r.point <= r.high and abs(r.mean - r["point"]) < (r.high - r.low)
    p = E.permutation_check(tables.preds().filter("model_id = 'form'"), 300).first()
    assert abs(p.mean_shuffled - 0.5) < 0.05 and 0 <= p.p_value <= 1
    q = {r.model_id: r for r in E.permutation_check(tables.preds(), 300, ["model_id"]).collect()}
    assert len(q) == 3 and q["form"].mean_shuffled == p.mean_shuffled


def test_hypergeometric():
    u = (np.arange(20_000) + 0.5) / 20_000
    for good, bad, taken in ((30, 50, 20), (1, 1, 1), (0, 5, 3), (5, 0, 3), (400, 300, 650), (2_000_000_000_000, 1_000_000_000_000, 5_000_000)):
        got = E.hypergeometric(good, bad, taken, u)
        n = good + bad
        mean, var = taken * good / n, taken * good / n * bad / n * (n - taken) / max(n - 1, 1)
        assert got.min() >= max(0, taken - bad) and got.max() <= min(good, taken)
        assert abs(got.mean() - mean) <= 0.02 * var ** 0.5 + 1e-9 and abs(got.var() - var) <= 0.02 * var + 1e-9


def test_one_row_or_an_error(spark):
    df = spark.range(3)
    assert attach_row(df, spark.range(1).select(F.lit(7).alias("v"))).select("v").distinct().collect()[0].v == 7
    for rows in (0, 2):
        with pytest.raises(Exception, match="one row expected"):
            attach_row(df, spark.range(rows).select(F.lit(7).alias("v"))).collect()


def test_every_season_is_scaled(tables):
    games = tables.games()
    more = games.filter("season = 2000").withColumns({"season": F.lit(2030), "game_id": F.col("game_id") + 10_000_000})
    both = games.unionByName(more)
    got = M2.robust_scale(both, ["margin"], seasons(both))
    assert got.filter("season = 2030").count() == more.count()


def test_places_are_a_permutation(spark):
    rows = spark.range(3000).select(F.col("id").alias("game_id"))
    a, b = ({r.game_id: r.i for r in shuffled_places(rows, s).collect()} for s in "ab")
    assert sorted(a.values()) == sorted(b.values()) == list(range(1, 3001)) and sum(a[k] == b[k] for k in a) < 30


def test_isotonic_is_a_step(spark, tables):
    p = tables.preds().filter("model_id = 'form'").select("y", "p")
    rows = sorted((r.p, r.calibrated) for r in M.isotonic(p, p).collect())
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(rows, rows[1:])) and len({c for _, c in rows}) < len(rows)
