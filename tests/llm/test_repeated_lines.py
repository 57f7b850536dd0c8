from collections import defaultdict

import pytest
from odd import ROWS, SCHEMA, frame, plain

from boutline.llm.repeated_lines import drop_repeated_lines


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()


def brute(rows, shortest=40, least=5):
    owners = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= shortest:
                owners[key(line)].add(d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(owners.get(key(x), ())) < least or max(owners[key(x)]) == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return plain(out)


def run(df, **kw):
    return plain(drop_repeated_lines(df, **kw).select("doc_id", "text", "n_lines", "n_dropped").collect())


LINE = "This line of more than forty characters stands in many documents é"
MORE = [(100 + i, f"start {i}\n {LINE.upper() if i % 3 else LINE}\t\nmiddle\n{LINE.lower()}\n", None, None, None, None, None, None) for i in range(7)]
FOUR = [(200 + i, "only four documents hold this line of more than forty", None, None, None, None, None, None) for i in range(4)]


@pytest.mark.parametrize("words", [64, 1 << 21])
def test_odd_rows(spark, words):
    rows = ROWS + MORE + FOUR + FOUR[:1] + [(None, LINE, None, None, None, None, None, None)]
    df = frame(spark, rows)
    assert run(df, words=words) == brute(rows)
    out = drop_repeated_lines(df, words=words)
    assert out.columns == df.columns + ["n_lines", "n_dropped"]


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs) == brute(rows)
