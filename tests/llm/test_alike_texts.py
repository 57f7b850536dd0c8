import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from odd import ROWS, SCHEMA, frame

import corpus_pipeline
from boutline.llm import alike_texts
from boutline.llm.alike_texts import alike_sets, one_of_alike


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, alike=0.8):
    """Ids that stay: the least of every group linked by Jaccard similarity, found by comparing all pairs."""
    rows = [(d, shingles(t)) for d, t in rows if d is not None]
    home = list(range(len(rows)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a == b or len(a & b) >= alike * len(a | b):
                home[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    gone = {d for i, (d, _) in enumerate(rows) if d > least[root(i)]}
    return sorted({d for d, _ in rows} - gone)


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.mark.parametrize("stage", [one_of_alike, lambda d: corpus_pipeline.near_duplicates(None, d, None)])
def test_edited_copies(spark, stage):
    rng = random.Random(3)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        # 0 to 4 in 100 words changed: similarities from 1 to under 0.7.
        rows += [(100 * g + i, edited(rng, base, i * len(base) // 100)) for i in range(5)]
    want = brute(rows)
    assert 25 <= len(want) < 80
    df = spark.createDataFrame([(*r, None, None, None, None, None, None) for r in rows], SCHEMA)
    assert sorted(r.doc_id for r in stage(df).collect()) == want


def test_one_large_group(spark):
    """Every copy has its own edits of one text: some pairs are alike and others are not."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(i, edited(rng, base, rng.randrange(1, 9))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in one_of_alike(df).collect()) == brute(rows)


@pytest.mark.parametrize("few", [4])
def test_unlike_members_of_one_group(spark, few):
    """Texts that share most of one passage: the first is unlike nearly all, some of the others are copies of each other."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows = []
    for g in range(60):
        own = base + [f"o{g}x{k}" for k in range(25)]
        rows += [(2 * g, " ".join(own)), (2 * g + 1, edited(rng, own, g % 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, links = alike_sets(df, few=few)
    kept = sorted(r.doc_id for r in one_of_alike(df).collect())
    assert kept == brute(rows) and 30 < len(kept) < 100
    found, sets = {(r.a, r.b) for r in links.collect()}, {d: shingles(t) for d, t in rows}
    assert len(found) >= 20 and all(len(a) == 2 for a in found)
    assert links.count() < 60 * len(rows)
    assert len(sets) == len(rows)


def test_rounds_shrink(spark, monkeypatch):
    """No pair is compared twice, and from the first round on only nodes that are still apart from their groups are read."""
    rng, kept, real = random.Random(5), [], alike_texts.stored

    def noted(df, label):
        kept.append((label, real(df, label)))
        return kept[-1][1]

    monkeypatch.setattr(alike_texts, "stored", noted)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows = [(g, " ".join(base + [f"o{g}x{k}" for k in range(25)])) for g in range(24)]
    rows += [(100 + g, " ".join(f"u{g}x{k}" for k in range(40))) for g in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in one_of_alike(df).collect()) == brute(rows)
    pairs = [(r.a, r.b) for label, t in kept if label == "likely" for r in t.collect()]
    assert len(pairs) == len(set(pairs)) > 10
    nodes = [t.count() for label, t in kept if label == "nodes"]
    assert nodes[0] == 44 and len(nodes) > 1 and max(nodes[1:]) < 25


def meetings(texts):
    """The values at which each text's sketches meet others, and its fingerprint."""
    at, prints = [], []
    for _, _, doc, h in alike_texts.shingles(pa.array(texts), 5):
        _, begin = np.unique(doc, return_index=True)
        at += [set(row) for row in alike_texts.ball(np.stack([np.minimum.reduceat(h * m, begin) for m in alike_texts._ODD], 1)).tolist()]
        prints += alike_texts.majority(h, np.diff(np.append(begin, len(h)))).tolist()
    return list(zip(at, prints))


@pytest.mark.parametrize("tile", [1024, 16])
def test_all_that_meet_are_compared(spark, monkeypatch, tile):
    """Many texts share most of a passage and are unlike; pairs of them at the limit that meet at one value only are linked all the same."""
    monkeypatch.setattr(alike_texts, "TILE", tile, raising=False)
    rng, rows, planted = random.Random(11), [], 0
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    for g in range(400):
        own = base + [f"o{g}x{k}" for k in range(25)]
        rows.append((2 * g, " ".join(own)))
        if planted == 12:
            continue
        # A run of nine words changed: 0.806 alike.
        tries = [" ".join([*own[:k], *(f"e{g}x{k}x{c}x{m}" for m in range(9)), *own[k + 9:]]) for k in range(10, 100) for c in range(3)]
        (at, first), *others = meetings([rows[-1][1], *tries])
        one = [t for t, (b, p) in zip(tries, others) if len(at & b) == 1 and (first ^ p).bit_count() > 2]
        if one:
            rows.append((2 * g + 1, one[0]))
            planted += 1
    assert planted == 12
    prints, linked = alike_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    node, home = {r.id: r.node for r in prints.collect()}, {}

    def root(n):
        while home.get(n, n) != n:
            n = home[n]
        return n

    for r in linked.collect():
        home[root(r.a)] = root(r.b)
    assert [d for d in node if d % 2 and root(node[d]) != root(node[d - 1])] == []


def test_forest():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (2, 1), (30, 20), (30, 200), (400, 390)):
        x, y = rng.integers(0, n, m), rng.integers(0, n, m)
        x, y = x[x != y], y[x != y]
        home, want = list(range(n)), []
        for k, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
            a, b = (next(v for v in range(n) if v == home[c]) for c in (a, b))
            if a != b:
                home, want = [a if h == b else h for h in home], [*want, k]
        assert alike_texts.forest(x * 7, y * 7).tolist() == want


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = one_of_alike(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    got = one_of_alike(frame(spark)).collect()
    assert sorted({r.doc_id for r in got if r.doc_id is not None}) == brute([r[:2] for r in ROWS])
    assert sum(r.doc_id is None for r in got) == 2 and sum(r.doc_id == 8 for r in got) == 2
    assert one_of_alike(spark.createDataFrame([], SCHEMA)).collect() == []


def test_fingerprints_meet(spark):
    """Nodes whose fingerprints differ in two bits or fewer share a place; one node's fingerprint is the majority of its shingles' bits."""
    rng = np.random.default_rng(5)
    base = [int(v) for v in rng.integers(-2**63, 2**63 - 1, 6)]
    rows = [(k, v ^ m) for k, (v, m) in enumerate((v, m) for v in base for m in (0, 0, 1 << 5, 1 << 9 | 1 << 40, 7 << 20))]
    at = {}
    for r in alike_texts._printed(spark.createDataFrame(rows, "node long, fingerprint long")).collect():
        at.setdefault(r.b, set()).add(r.at)
    for (a, x), (b, y) in combinations(rows, 2):
        if ((x ^ y) & (1 << 64) - 1).bit_count() <= 2:
            assert at[a] & at[b]
    texts = [" ".join(str(int(w)) for w in rng.integers(0, 50, n)) for n in (3, 40, 400)]
    got = {r.id: r.fingerprint for r in alike_texts._sketched(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), 5).collect()}
    for _, _, doc, h in alike_texts.shingles(pa.array(texts), 5):
        for i in range(3):
            own = [int(v) for v in h[doc == i]]
            want = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in own) > len(own))
            assert got[i] & (1 << 64) - 1 == want
