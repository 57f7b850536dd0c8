import numpy as np

from boutline.operators import isotonic as I


def brute(points):
    """Max-min formula over distinct scores: {score: value} of (score, label sum, weight)."""
    points = sorted(points)
    out = {}
    for i, (x, *_) in enumerate(points):
        out[x] = max(min(sum(p[1] for p in points[a:b + 1]) / sum(p[2] for p in points[a:b + 1]) for b in range(i, len(points)))
                     for a in range(i + 1))
    return out


def arrays(points):
    x, y, w = (np.array(v, float) for v in zip(*points))
    return x, y, w, np.ones(len(x), int)


def at(blocks, x):
    k = np.searchsorted(blocks[0], x, "right") - 1
    return (blocks[1] / blocks[2])[np.maximum(k, 0)]


def test_pooled_and_merged():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 10, 40):
        for shape in ("noise", "falling", "rising", "ties", "cliff"):
            w = rng.integers(1, 5, size).astype(float)
            mean = {"noise": rng.random(size), "falling": np.linspace(1, 0, size), "rising": np.linspace(0, 1, size),
                    "ties": rng.integers(0, 3, size) / 2, "cliff": np.append(np.linspace(0.5, 1, size)[:-1], 0.0)}[shape]
            points = list(zip(np.arange(size) / size, mean * w, w))
            want = brute(points)
            whole = I.pooled(*arrays(points))
            for cut in {0, 1, size // 2, size - 1}:
                parts = [I.pooled(*arrays(points[a:b])) for a, b in ((0, cut), (cut, size)) if a < b]
                for blocks in (whole, parts[0] if len(parts) == 1 else I.merged(*parts)):
                    assert np.allclose(at(blocks, np.array(list(want))), list(want.values()), atol=1e-12), (size, shape, cut)
                    assert blocks[3].sum() == size and (np.diff(blocks[1] / blocks[2]) > 0).all()


def test_rows_with_a_hot_group_and_gaps(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(p), int(rng.random() < p * 0.7 + 0.2 * np.sin(9 * p)), float(w))
            for p, w in zip(rng.integers(0, 60, 900) / 59, rng.integers(1, 4, 900))]
    rows += [("hot", 0.5, 1, 1.0)] * 600 + [("few", 0.25, 1, 1.0), ("few", 0.75, 0, 3.0), (None, 0.4, 1, 1.0), (None, 0.6, 1, 1.0)]
    odd = [("hot", None, 1, 1.0), ("hot", 0.5, None, 1.0), ("hot", 0.5, 1, None), ("hot", 0.5, 1, 0.0), ("none", float("nan"), 1, 1.0)]
    df = spark.createDataFrame(rows + odd, "g string, p double, y int, w double")
    steps = I.fit_steps(df, ["g"], weight="w").cache()
    want = {}
    for g in ("hot", "few", None):
        sums = {}
        for k, p, y, w in rows:
            if k == g:
                x = np.floor(p * 1e6 + 0.5000001) / 1e6
                a, b = sums.get(x, (0.0, 0.0))
                sums[x] = (a + y * w, b + w)
        want[g] = brute([(x, *s) for x, s in sums.items()])
    got = I.apply_steps(df, steps, ["g"]).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        x = None if r.p is None or np.isnan(r.p) else np.floor(r.p * 1e6 + 0.5000001) / 1e6
        assert (r.calibrated is None) == (x is None) and (x is None or abs(r.calibrated - want[r.g][x]) < 1e-9)
    assert {r.g: r.n for r in steps.groupBy("g").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {"hot": 1500, "few": 2, None: 2}


def test_scores_outside_the_blocks(spark):
    steps = spark.createDataFrame([(0.2, 0.1, 1), (0.2005, 0.15, 1), (0.7, 0.9, 1)], "lo double, value double, n long")
    ask = spark.createDataFrame([(v,) for v in (-3.0, 0.0, 0.2, 0.2004, 0.2005, 0.5, 0.699999, 0.7, 1.0, 4.0)], "p double")
    got = [r.calibrated for r in I.apply_steps(ask, steps).orderBy("p").collect()]
    assert got == [0.1, 0.1, 0.1, 0.1, 0.15, 0.15, 0.15, 0.9, 0.9, 0.9]


def test_empty(spark):
    df = spark.createDataFrame([], "p double, y int")
    steps = I.fit_steps(df)
    assert steps.collect() == []
    some = spark.createDataFrame([(0.5, 1)], "p double, y int")
    assert [r.calibrated for r in I.apply_steps(some, steps).collect()] == [None]
