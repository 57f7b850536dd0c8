"""Hot keys, short stretches and strict days against plain Python."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from boutline.operators import timeline as T


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(900):
        entity = 1 if rng.random() < 0.4 else rng.randrange(2, 12)  # one key holds a large share
        out.append((entity, date(2020, 1, 1) + timedelta(days=rng.randrange(60)), i, float(rng.randrange(50)), rng.randrange(2)))
    return out


@pytest.fixture(scope="module")
def log(spark, rows):
    return spark.createDataFrame(rows, "entity long, d date, g long, v double, win int")


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_running_row_order_and_strict_day(log, rows):
    kinds = {"s": T.run_sum("v"), "c": T.run_count("v"), "hi": T.run_max("v"), "lo": T.run_min("v")}
    a = {r.g: r for r in T.with_running(log, ["entity"], "d", ["g"], kinds, totals={"all": T.run_sum("v")}).collect()}
    b = {r.g: r for r in T.with_running(log, ["entity"], "d", ["g"], kinds, strict_day=True).collect()}
    for group in by_key(rows).values():
        for i, r in enumerate(group):
            past, strict = [x[3] for x in group[:i]], [x[3] for x in group if x[1] < r[1]]
            for got, want in ((a[r[2]], past), (b[r[2]], strict)):
                assert (got.c, got.s, got.hi, got.lo) == (
                    len(want), sum(want) if want else None, max(want, default=None), min(want, default=None))
            assert a[r[2]].seq == i + 1 and a[r[2]].all == sum(x[3] for x in group)


@pytest.mark.parametrize("stretch", [1, 7, 64, 4096])
def test_trailing_both_ways(log, rows, stretch):
    seq = T.with_running(log, ["entity"], "d", ["g"])
    got = {r.g: r for r in T.with_trailing(seq, ["entity"], {
        "back": (5, lambda w: F.collect_list("v").over(w)), "ahead": (-3, lambda w: F.collect_list("v").over(w)),
        "mean": (4, T.mean_of("v", 3))}, stretch=stretch).collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        v = [x[3] for x in group]
        for i, r in enumerate(group):
            last4 = v[max(0, i - 4):i]
            assert got[r[2]].back == v[max(0, i - 5):i] and got[r[2]].ahead == v[i + 1:i + 4]
            assert got[r[2]].mean == (pytest.approx(sum(last4) / len(last4)) if len(last4) >= 3 else None)


def test_signed_run(log, rows):
    seq = T.with_running(log, ["entity"], "d", ["g"])
    win = F.col("win") == 1
    run = T.with_running(seq, ["entity"], "d", ["g"], {"w": T.run_max(F.when(win, F.col("seq"))), "l": T.run_max(F.when(~win, F.col("seq")))})
    got = {r.g: r.s for r in run.select("g", T.signed_run(F.col("w"), F.col("l")).alias("s")).collect()}
    for group in by_key(rows).values():
        streak = 0
        for r in group:
            assert got[r[2]] == streak
            streak = (streak + 1 if streak > 0 else 1) if r[4] else (streak - 1 if streak < 0 else -1)


def test_asof_running_and_latest(spark, log, rows):
    rng = random.Random(9)
    asked = [(i, rng.randrange(1, 13), date(2019, 12, 28) + timedelta(days=rng.randrange(64)), rng.randrange(900)) for i in range(400)]
    req = spark.createDataFrame(asked, "i long, entity long, d date, g long")
    got = {r.i: r for r in T.asof_running(req, log.withColumn("one", F.lit(1)), ["entity"], "d", ["g"], {"s": "v", "n": "one"}).collect()}
    late = {r.i: r for r in T.latest_before(req, log.select("entity", "d", F.col("g").alias("src"), "v"), ["entity"], "d", ["src"], ["src", "v"]).collect()}
    groups = by_key(rows)
    assert len(got) == len(late) == 400
    for i, e, d, g in asked:
        past = [x for x in groups.get(e, []) if (x[1], x[2]) < (d, g)]
        assert (got[i].s, got[i].n) == (sum(x[3] for x in past), len(past))
        days = [x for x in groups.get(e, []) if x[1] < d]
        assert late[i].src == (max(days, key=lambda x: (x[1], x[2]))[2] if days else None)
