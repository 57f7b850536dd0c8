"""What a task holds or a row costs does not grow with the rest of the input; results beside plain Python."""

import heapq
import random
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from boutline.operators import aggregates as A, context as C, folds, history as H, ratings as R
from boutline.plans.io import D
from boutline.sources import contests
from boutline.streaming import live as S


def members(spark, seed, null):
    rng = random.Random(seed)
    rows = []
    for g in range(120):
        e, d = 0 if rng.random() < 0.4 else rng.randrange(1, 4), date(2010, 1, 1) + timedelta(rng.randrange(50))
        for m in rng.sample(range(12), 3):
            rows.append((e, d, g, None if rng.random() < null else m, None if rng.random() < null else float(rng.randrange(9))))
    return rows, spark.createDataFrame(rows, "entity long, game_date date, game_id long, member long, points double")


def test_fold_reads_batches(spark):
    """A group's rows reach the fold in several batches, and it never sees the group."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        games = spark.range(40).select(F.lit("x").alias("league"), F.lit(2001).alias("season"), F.date_add(F.lit(date(2001, 1, 1)), F.col("id").cast("int") % 9).alias("game_date"),
                                       F.col("id").alias("game_id"), (F.col("id") % 5).alias("home"), (F.col("id") % 5 + 5).alias("away"), (F.col("id") % 7 - 3.0).alias("margin"))
        got = {r.game_id: r for r in R.elo(games, R.PLAIN)[0].collect()}
        plan = R.elo(games, R.PLAIN)[0]
        now = R.Ratings(R.PLAIN, [])
        for r in sorted(games.collect(), key=lambda r: (r.game_date, r.game_id)):
            assert (got[r.game_id].home_elo, got[r.game_id].away_elo) == now.play(2001, r.home, r.away, r.margin, False)[:2]
        assert plan.count() == 40
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("null", [0.0, 0.1])
def test_core_from_a_heap(spark, null):
    rows, _ = members(spark, 5, null)
    core = C._Core(4, 2, 3, [])
    mean, recent, want, got = {}, {}, [], []
    by_game = {}
    for e, d, g, m, x in rows:
        by_game.setdefault(g, []).append((C._known(m), C._known(x)))
    for g, own in by_game.items():
        for m, x in own:
            got += core.row(None, g, None if m != m else m, None if x != x else x)
    got += core.end()
    for g, own in by_game.items():
        best = [m for _, m in heapq.nsmallest(4, ((-v, m) for m, v in mean.items()))]
        want.append((g, len(best)) + ((len(set(best) & {m for m, _ in own}), len(set(best[:2]) & {m for m, _ in own})) if not null else ()))
        for m, x in own:
            past = recent.setdefault(m, [])
            past.append(float(x))
            del past[:-3]
            mean[m] = sum(past) / len(past)
    assert [(r[0], r[2]) + ((r[3], r[4]) if not null else ()) for r in got] == want


def test_churn_has_no_row_for_absent_members(spark):
    rows, df = members(spark, 6, 0.1)
    out = H.roster_churn(df, [3, 9])
    assert "sequence" not in out._jdf.queryExecution().toString().lower()
    got = {(r.entity, r.game_id): r for r in out.collect()}
    assert len(got) == len({r[:3] for r in rows})
    for e, d, g in {r[:3] for r in rows}:
        here = {m for k, _, game, m, _ in rows if (k, game) == (e, g)}
        for n, churn in ((3, got[e, g].churn_3d), (9, got[e, g].churn_9d)):
            known = {m for k, day, _, m, _ in rows if k == e and d - timedelta(n) <= day < d and m is not None}
            assert churn == pytest.approx(len(known - here) / len(known) if known else 0.0)


def test_parts_grow_with_the_lines(spark, tables, monkeypatch):
    whole = sorted(map(tuple, tables.members().collect()))
    monkeypatch.setattr(contests, "PART_BYTES", 4000)
    many = tables.members()
    assert tables.by_order(["l_suppkey"]).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, many.collect())) == whole
    wide = D.pivot_box(spark.createDataFrame([(1, "a", 2.0), (1, "b", None), (2, "b", 3.0)], "k long, stat string, value double"), ["k"], ["a", "b"])
    assert sorted(map(tuple, wide.collect())) == [(1, 2.0, None), (2, None, 3.0)]
    assert "SortAggregate" not in wide._jdf.queryExecution().toString()


def test_temperature_of_counted_predictions(spark):
    rng = random.Random(7)
    rows = [("a", rng.choice([0.2, 0.6, 0.9]), rng.randrange(2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "model_id string, p double, y int")
    one, few = folds.temperature(df).first(), folds.temperature(df.unionAll(df).unionAll(df)).first()
    assert one.temperature == few.temperature and one.loss == pytest.approx(few.loss)


class Handle:
    """State in memory that counts the calls."""

    def __init__(self):
        self.calls, self.value = 0, None

    def getValueState(self, name, schema):
        return self

    getMapState = getListState = getValueState

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def registerTimer(self, at):
        self.calls += 1

    def getCurrentWatermarkInMs(self):
        return 0


def test_form_state_calls_do_not_grow_with_days():
    handle, state = Handle(), S.FormState(3)
    state.init(handle)
    days = [date(2020, 1, 1) + timedelta(k) for k in range(50)]
    rows = pd.DataFrame({"game_date": days, "game_id": range(50), "win": [k % 2 for k in range(50)]})
    out = pd.concat(state.handleInputRows((1,), iter([rows]), handle))
    assert out["played"].tolist() == list(range(50)) and handle.calls <= 4

def test_state_goes_a_row_at_a_time(spark):
    """A stretch's state reaches the fold, and leaves it, without a list of it; results do not depend on the stretches."""
    games = spark.range(60).select(F.lit("x").alias("league"), F.lit(2001).alias("season"), F.date_add(F.lit(date(2001, 1, 1)), F.col("id").cast("int") % 20).alias("game_date"),
                                   F.col("id").alias("game_id"), (F.col("id") % 5).alias("home"), (F.col("id") % 5 + 5).alias("away"), (F.col("id") % 7 - 3.0).alias("margin"))
    given = iter([(1, 1510.0, 2001, 3, 1.0, 2.0, False), (0, 0.0, 2001, 0, 0.0, 0.0, True)])
    now = R.Ratings(R.PLAIN, given)
    assert now.table == {1: [1510.0, 2001, 3, 1.0, 2.0]} and now.seasons == [2001] and next(given, None) is None
    assert not isinstance(now.state(), (list, tuple))
    tried = R._Tried([R.PLAIN, R.EloParams(k=10.0)], iter([(1, [1510.0, 1490.0], 2001, 3, 1.0, 2.0, False)]))
    assert tried.ratings.table[1][0].tolist() == [1510.0, 1490.0] and not isinstance(tried.state(), list)
    grid = [R.EloParams(k=k) for k in (10.0, 20.0, 30.0)]
    for run in (lambda n: R.elo(games, R.PLAIN, max_rows=n)[0], lambda n: R.elo(games, R.PLAIN, max_rows=n)[1], lambda n: R.grid_metrics(games, grid, max_rows=n)):
        one, many = (sorted(map(tuple, run(n).collect())) for n in (10 ** 6, 7))
        assert len(one) == len(many) and all(a == pytest.approx(b) for a, b in zip(one, many))


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange " in line]


def test_continuity_is_dealt_over_the_lines_parts(spark):
    rows, df = members(spark, 8, 0.0)
    df = df.withColumn("season", F.year("game_date"))
    plain, many = H.set_continuity(df), H.set_continuity(df, 23)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, many.select(plain.columns).collect()))
    assert sum(", 23)" in x and "REPARTITION_BY_NUM" in x for x in exchanges(many)) >= 4


def test_play_summary_is_dealt_over_the_lines_parts(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(30), date(2010, 1, 1), 2010, 1, rng.randrange(3), rng.randrange(4), rng.random() < 0.5, rng.randrange(1, 5), float(rng.randrange(50)),
             None if rng.random() < 0.1 else rng.random() - 0.5, rng.random() < 0.2) for _ in range(300)]
    df = spark.createDataFrame(rows, "game_id long, game_date date, season int, week int, offense long, defense long, is_pass boolean, down int, yards double, epa double, turnover boolean")
    for side in ("offense", "defense"):
        plain, many = A.play_summary(df, side, ["season", "week"]), A.play_summary(df, side, ["season", "week"], 23)
        one, two = ({r.entity: r.asDict() for r in x.collect()} for x in (plain, many))
        assert one.keys() == two.keys()
        for e in one:
            assert [two[e][c] for c in ("opponents", "n_games", "plays")] == [one[e][c] for c in ("opponents", "n_games", "plays")]
            assert two[e]["epa"] == pytest.approx(one[e]["epa"])
        assert any(", 23)" in x and "REPARTITION_BY_NUM" in x for x in exchanges(many))


def test_pitchers_are_dealt_once(spark):
    """Members with few logs and with many get what plain Python gives them; logs that come twice count as joins count them."""
    rng = random.Random(10)
    logs = []
    for g in range(80):
        for m in rng.sample(range(6), 3):
            m = 0 if rng.random() < 0.3 else m
            if not any(x[0] == m and x[1] == g for x in logs):
                logs.append((m, g, date(2010, 1, 1) + timedelta(g // 3), m % 2, rng.randrange(2), *(rng.randrange(5) for _ in range(6))))
    names = "member long, game_id long, game_date date, entity long, started int, outs long, er long, hits long, walks long, k long, hr long"
    odd = [(None, 1, date(2010, 1, 1), 1, *[1] * 7), (77, 200, None, 1, *[3] * 7), (77, 201, date(2010, 1, 5), 1, *[2] * 7), (77, 202, date(2010, 1, 4), None, *[1] * 7)]
    df = spark.createDataFrame([*logs, *odd], names)
    asked = spark.createDataFrame([(g, e, m) for m, g, _, e, *_ in logs[::2]] + [(1, 1, None), (999, 1, 3), (200, 1, 77), (201, 1, 77), (202, None, 77)], "game_id long, entity long, member long")
    got = {n: sorted(map(tuple, C.pitcher_prior(df, asked, stretch=n).collect()), key=str) for n in (0, 20, 4096)}
    assert got[0] == got[20] == got[4096] and len(got[0]) == asked.count()
    of = {(r[0], r[1], r[2]): r for r in got[4096]}
    cols = C.pitcher_prior(df, asked).columns
    assert of[77, 201, 1][cols.index("starts_pre")] == 4 and of[77, 200, 1][cols.index("no_prior")] == 1
    assert cols[:3] == ["member", "game_id", "entity"]
    for m, g, d, e, *_ in logs[::2]:
        before = sorted((x[2], x[1], x[3], x) for x in logs if x[0] == m and (x[2], x[1], x[3]) < (d, g, e))
        row = dict(zip(cols, of[m, g, e]))
        outs = sum(x[-1][5] for x in before)
        assert row["starts_pre"] == sum(x[-1][4] for x in before) and row["ip_pre"] == pytest.approx(outs / 3)
        last = [x[-1] for x in before if x[-1][4]][-3:]
        assert row["recent3_ip_pre"] == pytest.approx(sum(x[5] for x in last) / 3 if outs else 0.0)
        assert row["era_pre"] == (pytest.approx(sum(x[-1][6] for x in before) * 27 / outs) if outs else None)
    twice = df.unionAll(df)
    assert sorted(map(tuple, C.pitcher_prior(twice, asked, stretch=0).collect()), key=str) == sorted(map(tuple, C.pitcher_prior(twice, asked).collect()), key=str)
    assert len(exchanges(C.pitcher_prior(df, asked, 23))) <= 2


@pytest.mark.parametrize("null", [0.0, 0.1])
def test_main_members_without_history(spark, null):
    _, df = members(spark, 11, null)
    df = df.unionByName(spark.createDataFrame([(1, None, 500, 3, 4.0), (None, date(2010, 1, 2), 501, 3, 4.0)], df.schema))
    columns = ["game_id", "entity", "member"]
    whole, main = (H.primary_member(df, history=h).select(columns) for h in (True, False))
    assert sorted(map(tuple, main.collect())) == sorted(map(tuple, whole.collect()))
    assert len(exchanges(main)) < len(exchanges(whole))
