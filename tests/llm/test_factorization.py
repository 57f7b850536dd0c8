import numpy as np
import pyarrow as pa
from odd import ROWS, SCHEMA, TEXTS, frame

from boutline.llm import factorization as fm
from boutline.llm.stored import bounded_sample, held_out
from boutline.llm.text import pieces


def test_linear_time_identity():
    rng = np.random.default_rng(2)
    machine = fm.Machine(0.3, rng.normal(size=fm.FEATURES), rng.normal(size=(fm.FEATURES, 4)))
    for _, data, offsets in pieces(pa.array(["one two two three", "Four 5 six! six", ""])):
        v = fm.vectors(data, offsets, np.array([17, 15, -1]))
        z, _ = fm.margin(machine, v)
        ends = np.append(v.begin[1:], len(v.feature))
        for i, (a, b) in enumerate(zip(v.begin, ends)):
            f, x = v.feature[a:b], v.value[a:b]
            want = machine.bias + machine.linear[f] @ x + sum(
                machine.factors[f[p]] @ machine.factors[f[q]] * x[p] * x[q] for p in range(len(f)) for q in range(p))
            assert abs(z[i] - want) < 1e-9


def test_odd_rows(spark):
    labels = spark.createDataFrame([(6, 1), (8, 0), (12, 1), (None, 1), (3, None), (999, 0)], "doc_id long, quality int")
    machine = fm.fit(frame(spark), labels)
    out = fm.score(frame(spark), machine).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert len(TEXTS) < len(ROWS)


def test_empty(spark):
    machine = fm.fit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int"))
    assert fm.score(spark.createDataFrame([], SCHEMA), machine).collect() == []
    assert len(fm.score(frame(spark), machine).collect()) == len(ROWS)


def test_held_out_accuracy(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = held_out("doc_id", 5, 0)
    rows = fm.score(docs, fm.fit(docs, known.where(~out))).join(known, "doc_id").where(out).select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.95 * len(rows)


def test_bounded_sample(spark):
    rows = spark.range(20_000)
    some = bounded_sample(rows, "id", 500)
    assert some.count() == 500 and sorted(some.collect()) == sorted(bounded_sample(rows.repartition(9), "id", 500).collect())
    assert bounded_sample(rows.limit(40), "id", 500).count() == 40
