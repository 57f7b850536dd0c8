import os
import random
from datetime import date, timedelta

import pytest

from boutline.operators import context
from boutline.operators.context import day_percentiles, schedule_strength


def test_strength_beside_plain_python(spark):
    """One entity in most contests, several a day; every list is worked out from all contests before each moment."""
    rng = random.Random(8)
    start, games = date(2003, 1, 1), []
    for g in rng.sample(range(5000), 160):
        h, a = (0, rng.randrange(1, 9)) if rng.random() < 0.6 else rng.sample(range(9), 2)
        games.append((2003 + g % 2, start + timedelta(rng.randrange(25)), g, h, a, rng.randrange(2)))
    log = [(s, d, g, e, o, w) for s, d, g, h, a, y in games for e, o, w in ((h, a, y), (a, h, 1 - y))]
    df = spark.createDataFrame(log, "season int, game_date date, game_id long, entity long, opponent long, win int")
    out = schedule_strength(df, past=4, ahead=3)
    # No row stands for a single pair of contest and opponent.
    assert "inline" not in out._jdf.queryExecution().toString().lower()
    own = {}
    for s, d, g, e, o, w in sorted(log, key=lambda r: (r[1], r[2])):
        own.setdefault((s, e), []).append((d, g, o, w))

    def rate(s, e, d, g):
        wins = [w for day, game, _, w in own[s, e] if (day, game) < (d, g)]
        return sum(wins) / len(wins) if wins else None

    def mean(values):
        values = [v for v in values if v is not None]
        return pytest.approx(sum(values) / len(values)) if values else None

    got = {(r.season, r.entity, r.game_id): r for r in out.collect()}
    assert len(got) == len(log)
    for (s, e), rows in own.items():
        for i, (d, g, _, _) in enumerate(rows):
            met = [rate(s, o, d, g) for _, _, o, _ in rows[max(0, i - 4):i]]
            soon = [rate(s, o, d, g) for _, _, o, _ in rows[i + 1:i + 4]]
            r = got[s, e, g]
            assert (r.sos_past, r.sos_last3, r.sos_ahead) == (mean(met), mean(met[-3:]), mean(soon))
            assert r.sos_sum == (pytest.approx(sum(v for v in met if v is not None)) if any(v is not None for v in met) else None)


def _log(spark, n, seed):
    rng, start, games = random.Random(seed), date(2003, 1, 1), []
    for g in rng.sample(range(5000), n):
        h, a = (0, rng.randrange(1, 9)) if rng.random() < 0.6 else rng.sample(range(9), 2)
        games.append((2003 + g % 2, start + timedelta(rng.randrange(25)), g, h, a, rng.randrange(2)))
    log = [(s, d, g, e, o, w) for s, d, g, h, a, y in games for e, o, w in ((h, a, y), (a, h, 1 - y))]
    return spark.createDataFrame(log, "season int, game_date date, game_id long, entity long, opponent long, win int")


def test_strength_in_turns(spark, monkeypatch):
    """Many rows go in turns, with the same result; times and rates are written by none, and only what the result reads stays."""
    df, real, kept = _log(spark, 150, 9), context.stored, []
    columns = ["season", "entity", "game_id", "sos_past", "sos_sum", "sos_last3", "sos_ahead", "last_opponent_pct"]
    want = sorted(schedule_strength(df, past=4, ahead=3).select(*columns).collect(), key=lambda r: r[:3])

    def noted(part, label):
        kept.append((label, real(part, label)))
        return kept[-1][1]

    folder = spark.conf.get("spark.checkpoint.dir")
    was = set(os.listdir(folder))
    monkeypatch.setattr(context, "stored", noted)
    monkeypatch.setattr(context, "TURN_ROWS", 60)
    got = schedule_strength(df, past=4, ahead=3).select(*columns)
    assert sorted(got.collect(), key=lambda r: r[:3]) == want and len(want) == 300
    parts = [part for label, part in kept if label == "strength"]
    assert len(parts) == 5 and sum(p.count() > 0 for p in parts) > 1 and sum(p.count() for p in parts) == 300
    assert not any(kind.startswith("array") for p in parts for _, kind in p.dtypes)
    assert {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - was} == {"strength"}


def test_percentiles_keep_what_is_read(spark):
    """Two values are looked up one after the other; what was written for the first is gone then."""
    df = _log(spark, 60, 10)
    folder = spark.conf.get("spark.checkpoint.dir")
    was = set(os.listdir(folder))
    asked = df.selectExpr("season", "game_date", "game_id", "entity", "game_id % 10 / 10D as a", "entity / 9D as b")
    both = day_percentiles(df, asked, {"x": "a", "y": "b"})
    one = [{tuple(r) for r in day_percentiles(df, asked, {"x": c}).select("game_id", "entity", "x").collect()} for c in ("a", "b")]
    assert [{tuple(r) for r in both.select("game_id", "entity", c).collect()} for c in ("x", "y")] == one
    assert not {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - was} & {"asked", "changes"}
