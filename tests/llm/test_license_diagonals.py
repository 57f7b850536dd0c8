"""Phrases beside plain Python, notices with planted edits, and no Python in the plan."""

import random
import re

import pytest
from odd import ROWS, SCHEMA, frame, plain

from boutline.llm import license_diagonals as L

WORD = re.compile(L.WORD)
BASE = {t.label: t.text.split() for t in L.PHRASES}


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def base(doc_id, text):
    w = words(text)
    at = sorted((i, label) for label, p in BASE.items() for i in range(len(w)) if w[i:i + len(p)] == p)
    return (doc_id, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({label for _, label in at})))


def scan(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in L.licenses(docs, **more).collect()}


def test_phrases(spark):
    rng = random.Random(1)
    names = [w for t in L.PHRASES for w in t.text.split()] + ["the", "É1", "2"]
    rows = [(i, rng.choice([" ", "-", "\n", ". "]).join(rng.choice([w, w.upper()]) for w in (rng.choice(names) for _ in range(rng.randrange(60))))) for i in range(200)]
    rows += [(1000, "MIT License " * 5000), (1001, "mit license mit mit license gnu general public licensed apache licensE"), (1002, "mitlicense mit_license ßmit license")]
    got = scan(spark, rows, notices=[])
    assert sorted((tuple(got[d])[:6] for d in got), key=str) == sorted((base(*r) for r in rows), key=str)
    assert all(got[d].labels == got[d].base_labels and got[d].score == (got[d].n_base > 0) for d in got)
    assert got[1000].n_base == 5000 and (got[1000].first_word, got[1000].last_word) == (0, 9998)
    assert [(s.start, s.stop, s.label) for s in got[1001].spans] == [(0, 2, "mit"), (3, 5, "mit"), (9, 11, "apache")]


def likeness(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return 1 - row[-1] / max(len(a), len(b), 1)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        i = rng.randrange(2, len(w) - 2)
        w[i:i + 1] = rng.choice([[], [w[i], "also"], [w[i] + "s"]])
    return " ".join(w)


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_notices_with_edits(spark, edits):
    """Every notice between other words; long ones with words left out, added or changed, so that their votes lie on several diagonals."""
    rng = random.Random(edits)
    other = [f"w{i}" for i in range(400)] + "the of this software license".split()
    rows, want = [], {}
    for i, t in enumerate(L.NOTICES):
        if edits and len(t.text.split()) < 20:
            continue
        before, after = ([rng.choice(other) for _ in range(rng.randrange(50))] for _ in range(2))
        text = edited(rng, t.text, edits)
        if likeness(" ".join(words(text)), " ".join(words(t.text))) < L.LIKENESS:
            continue
        rows.append((i, " ".join([*before, text, *after])))
        want[i] = (t.label, len(before))
    got = scan(spark, rows)
    assert len(want) >= (16, 9, 6)[edits]
    for i, (label, start) in want.items():
        assert label in got[i].labels.split(","), (label, rows[i])
        span = max(got[i].spans, key=lambda s: (s.label == label, s.stop - s.start))
        assert abs(span.start - start) <= L.DRIFT and got[i].score >= L.LIKENESS
        assert edits or got[i].score == 1.0
    others = {"lgpl": "gpl", "agpl": "gpl", "cc-by-sa-4.0": "cc-by-4.0"}
    for i, (label, _) in want.items():
        assert edits or others.get(label) not in {s.label for s in got[i].spans if s.likeness < 1.0}


def test_twice_and_far_apart(spark):
    one = L.NOTICES[1].text
    got = scan(spark, [(1, f"{one} and {one}"), (2, one + " x" * 30_000 + " " + one), (3, "of the rights to use this software " * 500), (4, one[:80])])
    n = len(words(one))
    assert [(s.start, s.stop) for s in got[1].spans] == [(0, n), (n + 1, 2 * n + 1)]
    assert [(s.start, s.stop) for s in got[2].spans] == [(0, n), (n + 30_000, 2 * n + 30_000)]
    assert got[3].labels == got[4].labels == "" and got[3].score == got[4].score == 0.0


def test_odd_rows(spark):
    got = L.licenses(frame(spark, [*ROWS, (50, "MIT License", None, None, None, None, None, None), (None, "mit license", None, None, None, None, None, None)]))
    want = [base(*r[:2]) for r in ROWS] + [base(50, "MIT License"), base(None, "mit license")]
    assert plain(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == sorted(want, key=str)
    assert L.licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def test_native(spark):
    """Neither Python nor Arrow in any plan, and words are split once."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    templates = L.template_runs(spark, L.PHRASES, L.NOTICES)
    for df in (L.licenses(docs), templates):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
    words_ = docs.select("doc_id", L.split_words(docs.text).alias("words"))
    plan = words_.select(L.runs(words_.words, 3).alias("r"), "words")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
