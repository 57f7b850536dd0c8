"""Streams give the batch answer however their input is cut into files and batches."""

import random
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from boutline.operators import ratings as R
from boutline.session import scratch_path
from boutline.streaming import live as S
from boutline.streaming.ledger import Ledger


def files(spark, df, per_batch, by="game_id", n=5):
    path = scratch_path(spark, "feed")
    df.withColumn("part", F.pmod(F.xxhash64(by), F.lit(n))).repartition(n, "part").write.partitionBy("part").parquet(path)
    return S.file_stream(spark, path, df.schema, files_per_batch=per_batch)


def plain(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def games(tables):
    return tables.games().filter("home_win is not null and league = '1-URGENT'").select("league", "season", "game_date", "game_id", "home", "away", "margin")


@pytest.mark.parametrize("per_batch", [1, 2, 1000])
def test_ratings_do_not_depend_on_batches(spark, games, per_batch):
    got = S.run_update(S.stream_elo(files(spark, games, per_batch), R.CARRY, 40_000), "elo", ["league", "game_id"], late="late")
    want = R.elo(games, R.CARRY)[0]
    assert got.filter("late").count() == 0
    cols = ["game_id", "home_elo", "away_elo", "prob"]
    assert plain(got.select(cols)) == plain(want.select(cols))


@pytest.mark.parametrize("per_batch", [1, 2, 1000])
def test_form_does_not_depend_on_batches(spark, tables, per_batch):
    log = tables.log().filter("win is not null and season = 1996").select("entity", "game_date", "game_id", "win")
    got = S.run_update(S.stream_form(files(spark, log, per_batch), 3, 40_000), "form", ["entity", "game_id"], late="late")
    rows = {}
    for e, d, g, w in sorted(map(tuple, log.collect()), key=lambda r: (r[0], r[1], r[2])):
        rows.setdefault(e, []).append((g, float(w)))
    want = []
    for e, seen in rows.items():
        for i, (g, _) in enumerate(seen):
            last = [w for _, w in seen[max(0, i - 3):i]]
            want.append((e, g, round(sum(last) / len(last), 9) if last else None, i, False))
    assert plain(got.select("entity", "game_id", "form", "played", "late")) == sorted(want, key=str)


def test_late_rows_go_aside(spark, games):
    path, out = scratch_path(spark, "late"), scratch_path(spark, "late-out")
    newest = games.agg(F.max("game_date")).first()[0]
    old = games.filter(F.col("game_date") < F.date_sub(F.lit(newest), 400))
    first, late = games.exceptAll(old.limit(3)), old.orderBy("game_id").limit(3)
    first = games.join(late.select("game_id"), "game_id", "left_anti").select(*games.columns)

    def run():
        return S.run_update(S.stream_elo(S.file_stream(spark, path, games.schema), R.CARRY, 30), "late", ["league", "game_id"], out, late="late")

    first.coalesce(1).write.mode("append").parquet(path)
    before = plain(run())
    late.coalesce(1).write.mode("append").parquet(path)
    first.limit(2).coalesce(1).write.mode("append").parquet(path)
    after = run()
    assert plain(after.filter("not late")) == before
    assert {r.game_id for r in after.filter("late").collect()} == {r.game_id for r in late.collect()}


@pytest.mark.parametrize("per_batch", [1, 1000])
def test_latest_status_does_not_depend_on_batches(spark, per_batch):
    rows = spark.range(200).select((F.col("id") % 17).alias("user"), F.timestamp_seconds(1000 + F.col("id") * 7 % 50).alias("ts"), F.col("id").alias("event"),
                                   F.element_at(F.array(*map(F.lit, ["live", "scheduled", "postponed", "odd", "final"])), (F.col("id") * 3 % 23 % 5 + 1).cast("int")).alias("status"))
    rows = rows.union(rows.limit(40))
    rank = {"final": 3, "live": 2, "postponed": 1}
    want = {}
    for u, ts, e, s in map(tuple, rows.collect()):
        if u not in want or (rank.get(s, 0), ts, -e) > want[u][0]:
            want[u] = ((rank.get(s, 0), ts, -e), (u, s, ts, e))
    got = S.run_latest(files(spark, rows, per_batch, "event"), "latest", "user", "ts", "status", ["event"])
    assert sorted(map(tuple, got.collect())) == sorted(v for _, v in want.values())


@pytest.mark.parametrize("late_days", [0, 5, 60])
def test_form_closes_days(spark, late_days):
    """Days close behind the newest one; three deliveries, one entity with most rows, repeated rows, plain Python beside it."""
    rng = random.Random(late_days)
    start, closed, seen, late, aside = date(2020, 1, 1), None, {}, set(), 0
    schema = "entity long, game_date date, game_id long, win int"
    feed, out = scratch_path(spark, "feed"), scratch_path(spark, "closing")
    for k in range(3):
        rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 4), start + timedelta(days=rng.randrange(30 * k, 30 * k + 60)), 1000 * k + i, rng.randrange(2)) for i in range(60)]
        rows += rows[:5]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(feed)
        for e, d, g, w in rows:
            if closed is not None and d <= closed:
                late.add((e, g))
            else:
                seen.setdefault(e, {})[(d, g)] = float(w)
        newest = max(d for _, d, *_ in rows)
        closed = max(closed or newest - timedelta(days=late_days), newest - timedelta(days=late_days))
        stream = S.stream_form(S.file_stream(spark, feed, spark.createDataFrame([], schema).schema), 3, late_days)
        got = S.run_update(stream, "closing", ["entity", "game_id"], out, late="late")
    want = [(e, g, None, None, True) for e, g in late]
    for e, games in seen.items():
        wins = [w for _, w in sorted(games.items())]
        for i, (_, g) in enumerate(sorted(games)):
            last = wins[max(0, i - 3):i]
            want.append((e, g, round(sum(last) / len(last), 9) if last else None, i, False))
    assert plain(got.select("entity", "game_id", "form", "played", "late")) == sorted(want, key=str)
    assert late or late_days == 60


def test_ingest_appends_and_compacts(spark):
    path, land = scratch_path(spark, "deliveries"), scratch_path(spark, "landed")
    schema = spark.range(1).select("id", F.lit(0).alias("v")).schema
    deliveries = [(1, range(100)), (2, range(0, 100, 9)), (3, [18]), (2, [18, 27]), (4, [])]
    deliveries += [(v, [v, 50]) for v in range(5, 12)]
    want = {}
    for v, ids in deliveries:
        want.update({i: max(v, want.get(i, 0)) for i in ids})
        spark.createDataFrame([(i, v) for i in ids], schema).repartition(2).write.mode("append").parquet(path)
        for _ in range(2):
            got = S.ingest_increment(S.file_stream(spark, path, schema), land, "id", land + "-progress", "v", every=3)
        assert sorted(map(tuple, got.collect())) == sorted(want.items())
    names = {p.name for p in Path(land).iterdir()}
    assert len([n for n in names if n.startswith("delta")]) <= 4 + 3 and len(list(Path(land, "commits").glob("[0-9]*"))) == 4


def test_ledger_commits_once(spark):
    """A repeated epoch changes nothing, an unfinished one counts only when it is written again."""
    merge = S.newest_deliveries("id", "v")
    path = scratch_path(spark, "ledger")
    rows = spark.range(3).select("id", F.lit(1).alias("v"))
    ledger = Ledger(spark, path, merge)
    assert ledger.read(rows.schema).count() == 0
    ledger.append(rows, 0)
    ledger.append(rows.withColumn("v", F.lit(9)), 0)
    rows.withColumn("v", F.lit(7)).write.parquet(f"{path}/delta-1")
    assert {r.v for r in Ledger(spark, path, merge).read(rows.schema).collect()} == {1}
    ledger.append(rows.where("id = 2").withColumn("v", F.lit(8)), 1)
    assert sorted(r.v for r in ledger.read(rows.schema).collect()) == [1, 1, 8]
