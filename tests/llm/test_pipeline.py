"""The pipeline beside plain Python, stage by stage, on small documents with everything odd in them."""

import pyarrow as pa
import pytest
from odd import ROWS
from test_alike_texts import brute as alike
from test_byte_pairs import brute as tokens_of
from test_leaked_questions import brute as leaks_of
from test_repeated_lines import brute as lines_of

import corpus_pipeline
from boutline.llm import toxic_passages

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with odd rows and a clashing column added to documents."""
    path = str(tmp_path_factory.mktemp("tables"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(None if r[0] is None else 10_000_000 + r[0], r[1], r[2], None, r[4]) for r in ROWS], docs.schema)
    docs.union(odd).selectExpr("*", "'x' AS component_id").write.parquet(f"{path}/documents.parquet")
    return path


def near(rows):
    """Without an id a row stays; the others by the similarity of all pairs."""
    kept = set(alike(rows))
    return [r for r in rows if r[0] is None or r[0] in kept]


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    model = toxic_passages.fit(docs, spark.read.parquet(f"{folder}/labels.parquet").where(~toxic_passages_held()))
    rows = [tuple(r[c] for c in ("doc_id", "text")) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = [r for r in rows if toxic_passages.judge(pa.array([r[1]], pa.string()), model)[0][0] < 0.3]
    steps = [want]
    steps.append([(d, t) for d, t, *_ in lines_of(steps[-1])])
    steps.append(near(steps[-1]))
    leaked = {d for d, _ in leaks_of(steps[-1], items)}
    steps.append([r for r in steps[-1] if r[0] not in leaked])
    assert len(rows) > len(steps[0]) > len(steps[2]) > len(steps[3])
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], steps):
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "stage")
        assert docs.columns == columns, name
        got = docs.collect()
        # Null text becomes the empty text it counts as once lines have been dropped.
        assert sorted((r.doc_id, r.text or "") if r.doc_id is not None else (-1, r.text or "") for r in got) == \
            sorted((d, t or "") if d is not None else (-1, t or "") for d, t in expected), name
        assert name != "line dedup" or all(r.n_chars == len(r.text) for r in got)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert sorted(map(tuple, last.collect()), key=str) == tokens_of(steps[-1])
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) == tokens_of(steps[-1])


def toxic_passages_held():
    from boutline.llm.stored import held_out

    return held_out("doc_id", 4, 2)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
