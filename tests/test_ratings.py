import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from boutline.operators import context as C, ratings as R


@pytest.fixture(scope="module")
def games(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        h, a = rng.sample(range(14), 2) if rng.random() < 0.6 else (0, rng.randrange(1, 14))
        d = date(2018, 1, 1) + timedelta(days=rng.randrange(1400))
        rows.append((("x", "y")[i % 2], d.year, d, i, h, a, float(rng.randrange(-9, 10))))
    return spark.createDataFrame(rows, "league string, season int, game_date date, game_id long, home long, away long, margin double")


def plain_elo(rows, k, home, carry=1.0):
    out, rating, season = {}, {}, None
    for r in sorted(rows, key=lambda r: (r.season, r.game_date, r.game_id)):
        if season is not None and r.season != season:
            rating = {e: 1500 + carry * (v - 1500) for e, v in rating.items()}
        season = r.season
        h, a = rating.get(r.home, 1500.0), rating.get(r.away, 1500.0)
        p = 1 / (1 + 10 ** (-(h + home - a) / 400))
        y = 0.5 if r.margin == 0 else float(r.margin > 0)
        rating[r.home], rating[r.away] = h + k * (y - p), a - k * (y - p)
        out[r.game_id] = (h, a, p)
    return out


@pytest.mark.parametrize("params", [R.PLAIN, R.CARRY, R.FORM, R.MARGIN])
def test_pieces_equal_one_fold(games, params):
    one = {r.game_id: r for r in R.elo(games, params)[0].collect()}
    pieces, state = R.elo(games, params, max_rows=60)
    many = {r.game_id: r for r in pieces.collect()}
    assert one.keys() == many.keys() and len(one) == 600
    for g in one:
        assert many[g].prob == pytest.approx(one[g].prob, abs=1e-12)
        assert many[g].home_post == pytest.approx(one[g].home_post, abs=1e-9)
    final = {(r.league, r.entity): r.rating for r in state.collect()}
    latest = {(r.league, r.entity): r.rating for r in R.latest_ratings(R.elo(games, params)[0]).collect()}
    assert {k: pytest.approx(v) for k, v in latest.items()} == final


@pytest.mark.parametrize("params", [R.PLAIN, R.CARRY])
def test_against_plain_python(games, params):
    rows = games.collect()
    got = {r.game_id: r for r in R.elo(games, params)[0].collect()}
    for league in ("x", "y"):
        for g, (h, a, p) in plain_elo([r for r in rows if r.league == league], params.k, params.home, params.carry).items():
            assert (got[g].home_elo, got[g].away_elo, got[g].prob) == (pytest.approx(h), pytest.approx(a), pytest.approx(p))


def test_sum_is_conserved_and_result_is_not_seen(games):
    rated, state = R.elo(games, R.PLAIN)
    for r in state.groupBy("league").agg((F.sum("rating") - 1500 * F.count("*")).alias("drift")).collect():
        assert abs(r.drift) < 1e-6
    changed = games.withColumn("margin", F.when(F.col("game_id") == 311, -F.col("margin") - 1).otherwise(F.col("margin")))
    a = rated.filter("game_id = 311").first()
    b = R.elo(changed, R.PLAIN)[0].filter("game_id = 311").first()
    assert (a.home_elo, a.prob) == (b.home_elo, b.prob)


def test_grid_equals_single_runs(games):
    grid = [R.EloParams(k=k, home=h, carry=0.75, margin="capped", form_win=80.0, form_margin=20.0) for k in (14.0, 22.0) for h in (35.0, 75.0)]
    for rows in (2_000_000, 90):
        got = {(r.league, r.model_id): r for r in R.grid_metrics(games, grid, max_rows=rows).collect()}
        for i, p in enumerate(grid):
            rated = R.elo(games, p)[0].filter("y is not null")
            loss = rated.groupBy("league").agg(F.avg(-F.log(F.when(F.col("y") == 1, F.col("prob")).otherwise(1 - F.col("prob")))).alias("ll"), F.count("*").alias("n"))
            for r in loss.collect():
                assert got[(r.league, i)].log_loss == pytest.approx(r.ll) and got[(r.league, i)].n == r.n


def test_core_retention_pieces(tables):
    m = tables.members().filter("entity < 4")
    one = {(r.entity, r.game_id): r for r in C.core_retention(m, core=5, keys=2).collect()}
    many = {(r.entity, r.game_id): r for r in C.core_retention(m, core=5, keys=2, max_rows=40).collect()}
    assert one == many and any(r.core == 5 for r in one.values())
    recent, want = {}, {}
    for r in sorted(m.collect(), key=lambda r: (r.entity, r.game_date, r.game_id, r.member)):
        past = recent.setdefault(r.entity, {})
        key = (r.entity, r.game_id)
        if key not in want:
            best = sorted(past, key=lambda x: (-sum(past[x][-8:]) / len(past[x][-8:]), x))[:5]
            want[key] = (best, set())
        want[key][1].add(r.member)
        past.setdefault(r.member, [])
        past[r.member] = past[r.member] + [r.points]
    for key, (best, here) in want.items():
        assert (one[key].core, one[key].retained, one[key].active) == (len(best), len(set(best) & here), len(here))


def test_strength_of_equal_profiles(spark):
    df = spark.createDataFrame([(i, 1.0, 0.5) for i in range(5)], "entity long, a double, prior double")
    for r in R.strength(df, {"a": 1.0}, {}).collect():
        assert math.isclose(r.strength, 0.0, abs_tol=1e-12)
