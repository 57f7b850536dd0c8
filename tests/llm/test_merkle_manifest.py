"""The manifest beside plain Python that builds every level as a list."""

import zlib
from hashlib import sha256

import pytest
from odd import ROWS, plain

from boutline.llm import merkle_manifest as M
from boutline.llm.queries import QUERIES

SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, tree string, idx string, total string, path string"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, i):
    return [(i >> k & 1, level[(i >> k) ^ 1] if (i >> k) ^ 1 < len(level) else "") for k, level in enumerate(tree[:-1])]


def brute(rows):
    """``rows`` are (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda c: (c is not None, (c or "").encode()))
    ordered = {c: sorted(by[c], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for c in langs}
    trees = {c: levels([leaf(*r) for r in ordered[c]]) for c in langs}
    top = levels([trees[c][-1][0] for c in langs])
    out = []
    for k, c in enumerate(langs):
        for i, r in enumerate(ordered[c]):
            path = way(trees[c], i) + way(top, k)
            now = leaf(*r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now = leaf(*r[:3], r[3] + 1, r[4])
            for side, other in path:
                now = digest(other + now if side else now + other)
            out.append((r[0], leaf(*r), trees[c][-1][0], top[-1][0], digest("".join(h for _, h in path)), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", range(1, 33))
def test_places_follow_from_sizes(n):
    leaves = [sha256(bytes([i])).digest() for i in range(n)]
    for height in {max(n - 1, 0).bit_length(), 5}:
        log = M.append_log(leaves, height)
        level, seen = leaves, []
        for k in range(height + 1):
            at = [M.place(n, k, i) for i in range(len(level))]
            assert [log[p] for p in at] == level
            seen += at
            level = [M.node(*level[i:i + 2]) for i in range(0, len(level), 2)]
        assert sorted(seen) == list(range(len(log)))


@pytest.mark.parametrize("width", [1, 3, 10])
def test_rounds(spark, width):
    """Several rounds of builders, more languages than one builder takes, and one that holds most rows."""
    rows = [(i * 3, "s" if i % 4 else None, None if i % 50 == 0 else "en" if i % 3 else f"l{i % 13}", i if i % 5 else None, f"text {i}") for i in range(150)]
    docs = spark.createDataFrame([(r[4], r[0], r[2], r[1], r[3], "x", "y", "z", "p") for r in rows], SCHEMA).repartition(7)
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/manifest{width}"
    docs.write.parquet(f"{folder}/documents.parquet")
    from pyspark.sql import functions as F

    from boutline.llm.stored import held_out
    claim = M.leaf("doc_id", "source", "lang", F.when(held_out("doc_id", 7, 0), F.col("n_chars") + 1).otherwise(F.col("n_chars")), "text")
    got = M.proofs(M.build_manifest(docs, claim, width))
    assert plain(got.collect()) == brute(rows)
    if width == 10:
        assert plain(QUERIES["op13_merkle_manifest"](spark, folder).collect()) == brute(rows)


def test_odd_rows(spark):
    """Nulls in every column, rows that share an id, repeated rows, very long texts, clashing columns."""
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in ROWS] + [(8, None, None, None, None), (None, "k", "", 5, ""), (None, "k", "", 5, "")]
    docs = spark.createDataFrame([(r[4], r[0], r[2], r[1], r[3], "x", "y", "z", "p") for r in rows], SCHEMA).repartition(4)
    got = M.proofs(M.build_manifest(docs, width=2))
    assert plain((*r[:5], r.verified) for r in got.collect()) == sorted(((*r[:5], True) for r in brute(rows)), key=str)
    one = M.proofs(M.build_manifest(docs.where("doc_id = 3"))).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == digest("") and one.verified


def test_altered_tables_are_found(spark):
    docs = spark.createDataFrame([(f"t{i}", i, "en", "s", i, "", "", "", "") for i in range(40)], SCHEMA)
    manifest = M.build_manifest(docs, width=3)
    other = M.build_manifest(docs.withColumn("source", docs.lang), width=3)
    assert manifest.root != other.root and manifest.root == M.build_manifest(docs.repartition(9), width=2).root
    assert M.proofs(manifest).where("not verified").count() == 0


def test_empty(spark):
    manifest = M.build_manifest(spark.createDataFrame([], SCHEMA))
    assert manifest.root is None and M.proofs(manifest).collect() == []
