import pytest
import xxhash
from pyspark.sql import functions as F

from boutline.llm.near_copies import near_copies

SCHEMA = "doc_id long, text string, fingerprint string, u string"


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [(d, fingerprint(t)) for d, t, *_ in rows]
    home = list(range(len(prints)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                home[root(i)] = root(j)
    out = []
    for i, (d, f) in enumerate(prints):
        ids = [e for j, (e, _) in enumerate(prints) if root(j) == root(i) and e is not None]
        out.append((d, f"{f:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    return sorted(map(tuple, near_copies(spark.createDataFrame(rows, SCHEMA), **kw).collect()), key=str)


def test_odd_rows(spark):
    base = " ".join(f"w{i % 97}x{i % 13}" for i in range(4000))
    rows = [(5, base), (9, base.replace("w5x5", "changed", 1)), (3, None), (4, ""), (4, ""), (None, base), (7, "Éa B\u000bc"),
            (8, "ÉA b C"), (11, " \t\n"), (2, "one two"), (1, "ONE  two"), (12, " x y z"), (-1, base + " end")]
    rows = [(*r, "clash", "z") for r in rows]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_chain_of_fingerprints(spark):
    from boutline.llm.components import components
    from boutline.llm.near_copies import links

    values = [0, 3, 15, 63, 255, -1, -2, -(1 << 63) + 0xFFFF] + [0xFF << 40 | 1 << k for k in range(20, 30)]
    pairs = links(spark.createDataFrame([(v,) for v in values * 3], "fingerprint long"))
    general = links(spark.createDataFrame([(v,) for v in values], "fingerprint long"), radius=2, bits=63)
    for found in (pairs, general):
        of = {r.node: r.component for r in components(found).collect()}
        group = {}
        for v in values:
            group.setdefault(of.get(v, v), set()).add(v)
        assert {0, 3, 15, 63, 255} in group.values()
        assert {-1, -2} in group.values()
        assert {0xFF << 40 | 1 << k for k in range(20, 30)} in group.values()


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, near_copies(docs).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("length", [1, 700])
def test_long_chain(spark, length):
    from boutline.llm.components import components

    edges = spark.range(length).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(edges)
    assert got.select("component").distinct().collect()[0][0] == 0
    assert got.count() == length + 1
