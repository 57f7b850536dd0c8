from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from boutline.operators.context import counts_below, day_percentiles


def test_counts_below():
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 7, 300):
        for most in (1, 3, 1000):
            day, value, delta = rng.integers(0, 20, size), rng.integers(0, most, size), rng.integers(-1, 2, size)
            want = [sum(int(d) for t, v, d in zip(day, value, delta) if t <= day[i] and v <= value[i]) for i in range(size)]
            got = counts_below(day, value, delta)
            assert [int(g) for g, d in zip(got, delta) if d == 0] == [w for w, d in zip(want, delta) if d == 0]


def test_one_hot_entity_and_ties(spark):
    rng = np.random.default_rng(4)
    start, log = date(2001, 1, 1), []
    for i in range(400):  # entity 0 owns a third of all rows, several a day
        e = 0 if rng.random() < 0.33 else int(rng.integers(1, 12))
        log.append((2001 + int(i % 2), e, start + timedelta(int(rng.integers(0, 60))), [None, 0.0, 1.0, 0.5][rng.integers(0, 4)]))
    asked = [(s, start + timedelta(d), v) for s in (2001, 2002, 2003) for d in (0, 1, 9, 30, 60) for v in (None, 0.0, 0.3333333333, 0.5, 0.7, 1.0)]
    got = day_percentiles(spark.createDataFrame(log, "season int, entity int, game_date date, win double"),
                          spark.createDataFrame(asked, "season int, game_date date, a double").withColumn("b", 1.0 - F.col("a")), {"x": "a", "y": "b"}).collect()

    def brute(season, day, value):
        rates = []
        for e in range(12):
            wins = [w for s, k, d, w in log if s == season and k == e and d < day and w is not None]
            rates += [round(sum(wins) / len(wins), 9)] if wins else []
        return None if value is None or not rates else 100.0 * sum(r <= round(value, 9) for r in rates) / len(rates)

    assert len(got) == len(asked)
    for r in got:
        assert r.x == brute(r.season, r.game_date, r.a) and r.y == brute(r.season, r.game_date, r.b)


def test_no_calendar_in_the_plan(spark):
    log = spark.createDataFrame([(2001, 1, date(2001, 1, 1), 1.0)], "season int, entity int, game_date date, win double")
    out = day_percentiles(log, log.withColumn("v", F.col("win")), {"x": "v"})
    assert "sequence" not in out._jdf.queryExecution().toString().lower()
    assert [r.x for r in out.collect()] == [None]
