"""Terms, shares and distances beside plain Python with whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd import ROWS, SCHEMA, frame, plain

from boutline.llm import source_divergence as S

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def brute(rows, least=3, most=200):
    """``rows`` are (lang, source, text)."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        count[lang, source].update(terms(text))
        docs[lang].update(set(terms(text)))
    out = []

    def share(n, total, v):
        return 1 + 10 ** 9 * (n + 1) // (total + v)

    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        of = {s: [share(count[lang, s][t], total[s], len(kept)) for t in kept] for s in sources}
        all_ = [share(sum(count[lang, s][t] for s in sources), sum(total.values()), len(kept)) for t in kept]
        for s in sources:
            found = [("pair", o, sum((p - q) ** 2 // q for p, q in zip(of[s], of[o]))) for o in sources if o != s]
            told = [("term", t, (p - q) ** 2 // q) for t, p, q in zip(kept, of[s], all_) if count[lang, s][t] and p > q]
            for part, top in ((found, len(found)), (told, most)):
                part.sort(key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, i + 1) for i, r in enumerate(part[:top])]
    return sorted(out, key=str)


def words(rng, n):
    alphabet = "abcdefgh", "é漢🙂zZ", "QWERTYqwerty"
    return ["".join(rng.choice(rng.choice(alphabet)) for _ in range(rng.choice([1, 3, 7, 8, 9, 15, 16, 17, 33, 70, 300]))) for _ in range(n)]


def test_counted_terms():
    rng = random.Random(1)
    names = words(rng, 60) + ["a", "ab", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "a" * 256, "a" * 257, "é" * 8]
    texts = [" 1-".join(rng.choice(names) for _ in range(rng.randrange(80))) for _ in range(90)] + [None, "", "\x00 \x7f 12"]
    group = np.array([rng.randrange(4) for _ in texts])
    want = {(g, t): (sum(terms(x).count(t) for x, o in zip(texts, group) if o == g), sum(t in terms(x) for x, o in zip(texts, group) if o == g))
            for g, x in zip(group.tolist(), texts) for t in terms(x)}
    got = {}
    for own, text, n, docs in S.count_terms(pa.array(texts, pa.string()), group):
        for g, t, a, b in zip(own.tolist(), text.to_pylist(), n.tolist(), docs.tolist()):
            assert (g, t) not in got
            got[g, t] = (a, b)
    assert got == want


def test_radix_order():
    rng = np.random.default_rng(2)
    for high in (1, 5, 1 << 20, 1 << 63):
        a, b = rng.integers(0, high, 500).astype(np.uint64), rng.integers(0, 3, 500).astype(np.uint64)
        assert S.radix_order([a, b], np.arange(500)).tolist() == np.lexsort((b, a)).tolist()


def test_shares_are_exact(spark):
    n, size = np.array([0, 1, 10 ** 10, 9 * 10 ** 14]), np.array([7, 10 ** 9, 3 * 10 ** 13 + 1, 9 * 10 ** 15])
    want = [1 + 10 ** 9 * (int(a) + 1) // int(b) for a, b in zip(n, size)]
    assert S.shares(n, size).tolist() == want
    df = spark.createDataFrame([(int(a), int(b) - 5, 5) for a, b in zip(n, size)], "n long, total long, kept long")
    assert [r.p for r in df.select(S.share("n", "total", "kept").alias("p")).collect()] == want


@pytest.mark.parametrize("cells", [S.CELLS, 40])
def test_hot_source(spark, cells):
    """One source holds a third of all rows; with few cells sums are passed on in parts."""
    rng = random.Random(3)
    names = words(rng, 150)
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "de", None])
        rows.append((lang, "hot" if i % 3 == 0 else f"s{i % 9}", " ".join(names[min(rng.randrange(150), rng.randrange(150))] for _ in range(30))))
    rows += [("xx", "one", "only here"), ("xx", "two", None), ("yy", None, ""), ("de", "silent", "")]
    docs = spark.createDataFrame([(t, a, b, "x", 5) for a, b, t in rows], "text string, lang string, source string, term string, n long").repartition(5)
    assert plain(S.source_divergence(docs, most=20, cells=cells).collect()) == brute(rows, most=20)


def test_odd_rows(spark):
    docs = frame(spark).withColumnRenamed("key", "source")
    assert plain(S.source_divergence(docs, least=1).collect()) == brute([(r[2], r[3], r[1]) for r in ROWS], least=1)
    assert S.source_divergence(spark.createDataFrame([], SCHEMA.replace("key", "source"))).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert plain(S.source_divergence(docs).collect()) == brute([(r.lang, r.source, r.text) for r in docs.collect()])
