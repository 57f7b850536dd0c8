import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from odd import ROWS, SCHEMA, frame
from pyspark.sql import functions as F

from boutline.llm import toxic_passages as tp
from boutline.llm.stored import held_out


def brute(scores):
    """The best segment, then the same on both sides of it: the definition of all maximal-scoring segments."""
    if not len(scores) or max(scores) <= 0:
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i, j = -best[2], -best[2] - best[1]
    return brute(scores[:i]) + [(i, j - 1, best[0])] + [(a + j, b + j, s) for a, b, s in brute(scores[j:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-40, 40).filter(bool), max_size=25))
def test_maximal_segments(values):
    scores = [v * 64 + i % 7 + 1 / (i + 3) for i, v in enumerate(values)]
    doc = np.zeros(len(scores), np.int64)
    got = tp.document_segments(np.array(scores, float), doc, 1, 0.0)[0]
    assert [(s.first, s.last) for s in got] == [(a, b) for a, b, _ in brute(scores)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, text string")


def test_odd_rows(spark):
    df = frame(spark)
    given_ = labels(spark, [(13, 1, None), (4, 0, None), (6, 0, None), (8, 0, None), (None, 1, None), (5, None, None), (999, 1, None)])
    model = tp.fit(df, given_, buckets=1 << 10)
    out = tp.score(df, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[0] == by[1] == by[2]
    kept = tp.without_toxic(df, model)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.predicted == 0 for r in out)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = tp.fit(none, labels(spark, []), buckets=64)
    assert tp.score(none, model).collect() == []
    one_class = tp.fit(frame(spark), labels(spark, [(4, 0, None), (8, 0, None)]), buckets=64)
    assert all(r.predicted == 0 for r in tp.score(frame(spark), one_class).collect())


def test_evidence_adds_up():
    model = tp.Model(np.array([0, 0, 4, 0], np.float32), 0.5, 2.0, 0.05, 1.0, -3.0)
    assert tp.evidence([], 10, 2.0, 0.05) == 0
    both = tp.evidence([tp.Segment(0, 0, 9.0), tp.Segment(5, 6, 7.0)], 10, 2.0, 0.05)
    assert abs(both - (18 - np.log(0.5) + 14 - np.log(0.5))) < 1e-9
    assert tp.judge(pa.array([None, ""]), model)[0] == tp.judge(pa.array([None, ""]), model)[1]


def test_held_out_accuracy(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = held_out("doc_id", 4, 2)
    model = tp.fit(docs, known.where(~out))
    rows = tp.score(docs, model).join(known, "doc_id").where(out).select("toxic", "predicted").collect()
    clean = [r.predicted for r in rows if r.toxic == 0]
    toxic = [r.predicted for r in rows if r.toxic == 1]
    assert sum(clean) <= 0.05 * len(clean) and sum(toxic) >= 0.6 * len(toxic)


def test_same_scores_for_other_partitions(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    first, second = (tp.fit(d, known) for d in (docs, docs.repartition(7, F.col("source"))))
    assert np.allclose(first.weight, second.weight) and np.allclose(first[1:], second[1:])
