import gzip
import json
from datetime import date

import pytest
from pyspark.sql import functions as F, types as T

from boutline.operators import joins as J, quality as V, ratings as R
from boutline.sources import documents as D, readers as S
from boutline.streaming import live

SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])


def test_csv_header_gzip_and_fallback(spark, tmp_path):
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("a,b\n1,u\n2,\n")
    (tmp_path / "bad.csv").write_text("a,c\n1,u\n")
    got = S.read_first(spark, [str(tmp_path / "none.csv"), str(tmp_path / "x.csv.gz")], SCHEMA).collect()
    assert [(r.a, r.b) for r in got] == [(1, "u"), (2, None)]
    with pytest.raises(Exception, match="(?i)header|column"):
        S.read_csv_checked(spark, str(tmp_path / "bad.csv"), SCHEMA).collect()
    with pytest.raises(FileNotFoundError):
        S.read_first(spark, [str(tmp_path / "none.csv")], SCHEMA)


def test_partitions_snapshots_and_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "x"), (2, "y")], SCHEMA)
    S.write_table(df, path, ["b"])
    S.replace_partitions(spark.createDataFrame([(9, "x")], SCHEMA), path, ["b"])
    assert sorted((r.a, r.b) for r in spark.read.parquet(path).collect()) == [(2, "y"), (9, "x")]
    snaps = tmp_path / "s"
    for i in (1, 2):
        df.withColumn("a", F.col("a") * i).coalesce(1).toPandas().to_parquet(_mk(snaps) / f"snap-{i}.parquet")
    assert sorted(r.a for r in S.latest_snapshot(spark, str(snaps)).collect()) == [2, 4]
    wide = S.align_columns(df, T.StructType([*SCHEMA.fields, T.StructField("z", T.DoubleType())]))
    assert wide.columns == ["a", "b", "z"] and wide.filter("z is null").count() == 2


def _mk(path):
    path.mkdir(exist_ok=True)
    return path


def test_one_to_one_rejects_repeats(spark):
    left = spark.createDataFrame([(1,)], "k int")
    J.one_to_one(left, spark.createDataFrame([(1, 2)], "k int, v int"), ["k"]).collect()
    with pytest.raises(Exception, match="not unique"):
        J.one_to_one(left, spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), ["k"]).collect()


def test_split_valid_reasons(spark):
    good, bad = V.split_valid(spark.createDataFrame([(1,), (-1,), (None,)], "v int"), {"positive": F.col("v") > 0})
    assert good.count() == 1 and {r.reason for r in bad.collect()} == {"positive"}


def test_scoreboard_cases(spark):
    cases = spark.createDataFrame(
        [("1", "pre", "STATUS_SCHEDULED", "STD", ["home", "away"]), ("2", "post", "STATUS_SCHEDULED", "STD", ["home", "away"]),
         ("3", "post", "STATUS_SCHEDULED", "ALLSTAR", ["home", "away"]), ("4", "pre", "STATUS_POSTPONED", "STD", ["home", "away"]),
         ("5", "pre", "STATUS_SCHEDULED", "STD", ["home"])], "id string, state string, name string, kind string, sides array<string>")
    lines = F.transform("sides", lambda side: F.struct(side, F.lit("0"), F.struct(F.substring(side, 1, 1), side)))
    contest = F.struct(F.struct("kind"), F.struct(F.struct("state", "name", F.lit(""))), lines)
    whole = F.struct(F.array(F.struct("id", F.lit("2025-01-16T00:00:00Z"), F.array(contest))))
    rows = D.flatten_scoreboard(cases.select(F.to_json(whole.cast(f"struct<{D.SCOREBOARD.replace(' ', ':', 1)}>")).alias("doc"))).collect()
    assert {r.game_id: (r.status, r.home_score) for r in rows} == {"1": ("scheduled", None), "2": ("final", 0), "4": ("postponed", None)}
    assert {r.game_date for r in rows} == {date(2025, 1, 15)}


def test_plays_top_level_or_drives(spark):
    play = {"id": "1", "period": {"number": 1}, "clock": {"displayValue": "9:51"}, "homeScore": 3, "awayScore": 0}
    docs = [{"id": "a", "plays": [play]}, {"id": "b", "plays": None, "drives": {"previous": [{"plays": [play, play]}], "current": [{"plays": [play]}]}},
            {"id": "c"}]
    got = D.flatten_plays(spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")).groupBy("game_id").count().collect()
    assert {r.game_id: r["count"] for r in got} == {"a": 1, "b": 3}


def test_stream_ratings_equal_batch_and_flag_late(spark, tables, tmp_path):
    g = tables.games().filter("home_win is not null").select("league", "season", "game_date", "game_id", "home", "away", "margin")
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for lo, hi in ((1990, 1997), (1998, 2010)):
        g.filter(F.col("season").between(lo, hi)).write.mode("append").parquet(feed)
        got = live.run_update(live.stream_elo(live.file_stream(spark, feed, g.schema), R.CARRY), "elo", ["game_id"], out, late="late")
    batch = R.elo(g, R.CARRY)[0]
    both = got.join(batch.select("game_id", F.col("prob").alias("want")), "game_id")
    assert both.count() == g.count() == got.count()
    assert both.filter(F.abs(F.col("prob") - F.col("want")) > 1e-9).count() == 0
    g.filter("season = 1996").limit(5).withColumn("game_id", F.col("game_id") + 10_000_000).write.mode("append").parquet(feed)
    again = live.run_update(live.stream_elo(live.file_stream(spark, feed, g.schema), R.CARRY), "elo", ["game_id"], out, late="late")
    assert again.filter("late").count() == 5 and again.count() == g.count() + 5


def test_ingest_is_idempotent(spark, tmp_path):
    feed, land = str(tmp_path / "feed"), str(tmp_path / "land")
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "game_id long, seq int, v int")
    df.coalesce(1).write.parquet(feed)
    for _ in range(2):
        landed = live.ingest_increment(live.file_stream(spark, feed, df.schema), land, "game_id", land + "-p")
    assert landed.count() == 3
    spark.createDataFrame([(1, 1, 50)], df.schema).coalesce(1).write.mode("append").parquet(feed)
    landed = live.ingest_increment(live.file_stream(spark, feed, df.schema), land, "game_id", land + "-p")
    assert sorted((r.game_id, r.seq, r.v) for r in landed.collect()) == [(1, 1, 50), (2, 1, 7)]
