import os
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from odd import ROWS, SCHEMA, frame

from boutline.llm import shared_passages as module
from boutline.llm.shared_passages import _extend, align, chains, chosen, close, reached, shared_passages
from boutline.llm.stored import hot_join, stored


def best_scores(x, y, gain, gap):
    score = []
    for i in range(len(x)):
        before = [score[j] - gap * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
        score.append(gain + max([0.0, *before]))
    return score


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 60)), min_size=1, max_size=25))
def test_best_chain(steps):
    x = np.cumsum([s for s, _ in steps]).tolist()
    y = [b for _, b in steps]
    found = chains(x, y, 5.0, 0.1, 1)
    assert sorted(i for c in found for i in c) == list(range(len(x)))
    first = found[0] if len(found) == 1 else max(found, key=lambda c: sum(5.0 - 0.1 * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(c, c[1:])))
    total = 5.0 + sum(5.0 - 0.1 * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(first, first[1:]))
    assert abs(total - max(best_scores(x, y, 5.0, 0.1))) < 1e-6
    for c in found:
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:]))


def test_every_window_has_a_seed():
    rng = np.random.default_rng(4)
    for n in (0, 1, 9, 10, 300):
        h = rng.integers(0, 40, n).astype(np.uint64)
        doc = np.sort(rng.integers(0, 4, n))
        pick = set(chosen(h, doc, 10).tolist())
        assert all(pick & set(range(i, i + 10)) for i in range(n - 9) if doc[i] == doc[i + 9])
        for d in range(4):
            own = np.flatnonzero(doc == d)
            assert sorted(pick & set(own.tolist())) == [own[k] for k in chosen(h[own], doc[own] * 0, 10)]


def test_align():
    a = np.arange(100)
    b = np.concatenate([np.arange(500, 510), a[20:50], [999], a[50:90], np.arange(700, 760)])
    first, end, other, last, equal = align([25, 70], [15, 61], a, b, 5)
    assert (first, end, other, last, equal) == (20, 90, 10, 81, 70)


def text(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(400)}" for _ in range(n)]


@pytest.mark.parametrize("words", [64, 1 << 21])
def test_planted_passages(spark, words):
    rng = random.Random(6)
    exact, fuzzy, short = text(rng, 60), text(rng, 90), text(rng, 30)
    rows, want = [], {}
    for i in range(60):
        own = text(rng, 150)
        kind = i % 6
        passage = {0: exact, 1: fuzzy, 2: short}.get(kind, [])
        if kind == 1 and i > 1:
            passage = list(passage)
            for k in rng.sample(range(90), 6):
                passage[k] = "changed"
            passage.insert(40, "inserted")
        at = rng.randrange(len(own))
        rows.append((i, " ".join(own[:at] + passage + own[at:]).capitalize()))
        if kind < 2 and i > 1:
            want[i] = (kind, at, len(passage))
    rows += [(1000 + i, rows[5][1]) for i in range(5)]
    df = spark.createDataFrame([(*r, None, None, None, None, None, None) for r in rows], SCHEMA)
    found = {}
    for r in shared_passages(df, filter_words=words).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == set(want) | {1000 + i for i in range(5)}
    for d, (source, at, n) in want.items():
        r = max(found[d], key=lambda r: r.end - r.first)
        assert r.source_id == source and r.first <= at + 6 and r.end >= at + n - 6 and r.end - r.first <= n + 12
    assert all(found[1000 + i][0].source_id == 5 and found[1000 + i][0].likeness == 1 for i in range(5))


def test_hidden_in_long_texts(spark):
    rng = random.Random(7)
    passage = " ".join(text(rng, 80))
    rows = [(i, " ".join(text(rng, 30_000)) + " " + passage + " " + " ".join(text(rng, 30_000))) for i in range(2)]
    found = shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.source_id) for r in found] == [(1, 0)] and 80 <= found[0].end - found[0].first <= 84


def test_odd_rows(spark):
    found = shared_passages(frame(spark)).collect()
    assert {(r.doc_id, r.source_id) for r in found} == {(7, 6)}
    assert (min(r.first for r in found), max(r.end for r in found)) == (0, len(re.findall(r"\S+", ROWS[6][1])))
    assert shared_passages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_passages_that_no_first_holder_has(spark):
    """Two documents share a passage whose halves stand in two earlier ones, exact and with changed words."""
    rng = random.Random(8)
    rows, spans = [], {}
    for group in range(12):
        a, b = text(rng, 45), text(rng, 45)
        for k, part in enumerate((a, b, a + b, a + b)):
            if k == 3 and group % 2:
                part = [w if i % 15 != 7 else "changed" for i, w in enumerate(part)]
            doc, before = 100 * k + group, text(rng, 80)
            spans[doc] = (80, 80 + len(part))
            rows.append((doc, " ".join(before + part + text(rng, 80))))
    found = {}
    for r in shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {300 + g for g in range(12)}
    for doc, own in found.items():
        first, end = spans[doc]
        assert all(r.source_id == doc - 100 for r in own)
        assert min(r.first for r in own) <= first + 4 and max(r.end for r in own) >= end - 4


def test_every_exact_window_is_covered(spark):
    """Few lines in many documents: whatever 50 words stand in an earlier document lie in a passage, by comparing all pairs."""
    rng = random.Random(9)
    lines = [text(rng, rng.randrange(6, 30)) for _ in range(40)] + [["is", "so"] * 30]
    rows = [(i, sum((rng.choice(lines) + (text(rng, 1) if rng.random() < 0.3 else []) for _ in range(12)), [])) for i in range(80)]
    found = {}
    for r in shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append((r.first, r.end))
    seen, shared, missed = set(), 0, 0
    for i, t in rows:
        own = [tuple(t[k:k + 50]) for k in range(len(t) - 49)]
        for k, w in enumerate(own):
            if w in seen:
                shared += 1
                missed += not any(a <= k + 7 and e >= k + 43 for a, e in found.get(i, []))
        seen.update(own)
    assert shared > 200 and missed == 0


def test_pairs_reach_as_one_by_one():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(1, 4, (30, 20)).astype("<u2") for _ in range(2))
    a[5:9, 7:] = 0
    b[:15] = np.where(rng.random((15, 20)) < 0.8, a[:15], b[:15])
    i, j = (v.reshape(-1) for v in np.meshgrid(np.arange(30), np.arange(30), indexing="ij"))
    n, equal = reached(a, b, i, j)
    for p, q, k, e in zip(i, j, n, equal):
        x, y = (v[:int((v > 0).sum())] for v in (a[p], b[q]))
        assert (int(k), int(e)) == _extend(x, y)


def test_close_words_lose_no_pair():
    """Whatever reaches a length has enough equal words beside the seed, on one side."""
    rng = np.random.default_rng(5)
    for size, run in ((5, 16), (5, 10), (5, 7), (3, 16)):
        sides = []
        for _ in range(2):
            a = rng.integers(1, 9, (40_000, 20)).astype("<u2")
            b = np.where(rng.random(a.shape) < rng.choice([0.3, 0.5, 0.6, 0.7], (len(a), 1)), a, rng.integers(1, 9, a.shape)).astype("<u2")
            b[np.arange(20) >= rng.integers(0, 30, (len(a), 1))] = 0
            at = np.arange(len(a))
            sides.append((reached(a, b, at, at)[0].astype(int), (a[:, :module.CLOSE] == b[:, :module.CLOSE]).sum(1)))
        (n, left), (m, right) = sides
        good = n + m + size >= run
        assert 1000 < good.sum() and (np.maximum(left, right)[good] >= close(run, size)).all() and close(run, size) > 0
    assert close(5, 5) == close(4, 5) == 0


def test_shuffles_and_tables_go(spark):
    """What was shuffled for a written table is deleted with it, and of op1's tables those stay that its result reads."""
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    out = stored(spark.range(20_000).repartition(7, "id"), "ids")
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before
    assert out.count() == 20_000
    folder = spark.conf.get("spark.checkpoint.dir")
    was = set(os.listdir(folder))
    rng = random.Random(12)
    lines = [text(rng, 20) for _ in range(12)]
    rows = [(i, " ".join(sum((rng.choice(lines) for _ in range(6)), []))) for i in range(40)]
    assert shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).count()
    kept = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - was}
    assert kept and not kept & {"seeds", "matches", "left", "places", "heads", "asked", "wanted"}


def test_places_in_small_tiles(spark, monkeypatch):
    """Few lines in many documents: tiles of three places find the same partners."""
    rng, found, real = random.Random(13), [], module._rest
    lines = [text(rng, rng.randrange(8, 30)) for _ in range(15)]
    rows = [(i, " ".join(sum((rng.choice(lines) + (text(rng, 1) if rng.random() < 0.3 else []) for _ in range(10)), []))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def noted(*given):
        out = real(*given)
        found.append([sorted(map(tuple, part.collect())) for part in out])
        return out

    monkeypatch.setattr(module, "_rest", noted)
    shared_passages(df)
    monkeypatch.setattr(module, "PLACES", 3)
    shared_passages(df)
    assert all(len(part) > 40 for part in found[0]) and found[0] == found[1]


def test_join_with_frequent_keys(spark):
    many = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(200)] + [(None, 1)], "k int, v int")
    one = spark.createDataFrame([(k, f"w{k}{c}") for k in range(5) for c in range(1 + k % 2)], "k int, w string")
    want = sorted(map(tuple, many.join(one, ["k"]).collect()))
    assert sorted(map(tuple, hot_join(many, one, ["k"], "v", most=9).collect())) == want and len(want) > 100
