"""Operators that score a small table once instead of copying rows."""
import numpy as np
from pyspark.sql import functions as F

from boutline.operators import evaluate as E, states as X


def test_envelope_beside_plain_python(spark):
    rng = np.random.default_rng(1)
    grid, back = [0.0, 0.25, 0.5, 0.75], 3

    def score(m, f, e):  # neither monotone in margin nor in time
        return float(np.sin(3 * m + 7 * f) * 0.4 + 0.5 + 0.1 * e)

    rows = [(i, int(rng.integers(-4, 5)), float(rng.choice([0.0, 0.1, 0.25, 0.6, 0.75, 1.0])), float(rng.integers(0, 2))) for i in range(200)]
    rows += [(1000 + i, 0, 0.6, 1.0) for i in range(100)] + [(2000, None, 0.5, 0.0), (2001, 2, None, 0.0)]  # one hot state, gaps
    df = spark.createDataFrame(rows, "id int, margin int, frac double, e double")
    got = X.row_envelope(df, ["e"], grid, back, lambda m, f: F.sin(3 * m + 7 * f) * 0.4 + 0.5 + 0.1 * F.col("e")).collect()

    def brute(m0, f0, e):
        best = []
        for m in range(m0 - back, m0 + 1):
            q = [score(m, f, e) for f in [f0] + ([g for g in grid if g >= f0 - 1e-12] if m else [])]
            best.append(max(q) if m >= 0 else min(q))
        return max(best)

    assert len(got) == len(rows) - 1
    for r in got:
        assert r.p_envelope is None if r.frac is None else abs(r.p_envelope - brute(r.margin, r.frac, r.e)) < 1e-12


def test_bootstrap_beside_plain_python(spark):
    rng = np.random.default_rng(8)
    rows = [(int(g), float(rng.random()), float(rng.random()), int(rng.random() < 0.5)) for g in [7] * 120 + list(range(-40, 200))]
    df = spark.createDataFrame(rows, "game_id long, p_a double, p_b double, y int")  # a third of all rows is one contest
    r = E.block_bootstrap(df, "a", "b", 50).first()
    eps = 1e-6

    def loss(p, y):
        p = min(max(p, eps), 1 - eps)
        return -np.log(p) if y else -np.log(1 - p)

    games = {}
    for g, a, b, y in rows:
        d, k = games.get(g, (0.0, 0))
        games[g] = d + loss(a, y) - loss(b, y), k + 1
    prime, diffs = (1 << 31) - 1, []
    for draw in range(50):
        top = low = 0.0
        for g, (d, k) in games.items():
            v = int(np.fmod(int(np.fmod(g, prime)) * 2654435761 + draw * 40503 + 12345, prime))
            for _ in range(3):
                v = int(np.fmod(v * 48271 + 11, prime))
            w, total, term = 0, 0.0, np.exp(-1)
            for c in range(1, 12):
                total += term
                w += v / prime >= total
                term /= c
            top, low = top + w * d, low + w * k
        diffs.append(top / low)
    assert r.draws == 50 and abs(r.mean - np.mean(diffs)) < 1e-9
    assert abs(r.low - np.quantile(diffs, 0.025)) < 1e-9 and abs(r.high - np.quantile(diffs, 0.975)) < 1e-9


def test_bootstrap_of_nothing(spark):
    r = E.block_bootstrap(spark.createDataFrame([], "game_id long, p_a double, p_b double, y int"), "a", "b", 5).first()
    assert r["mean"] is None and r.point is None
