import re

import numpy as np
from hypothesis import given, settings, strategies as st
from odd import ROWS, SCHEMA, frame, plain

from boutline.llm.repetition import quality_rules, repeat_lengths


def naive(word, end, shortest):
    n = len(word)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < end[i] and j + k < end[j] and word[i + k] == word[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return [k if k >= shortest else 0 for k in out]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=18), max_size=4), st.integers(1, 9))
def test_repeat_lengths(texts, shortest):
    word = np.array([10 * d + w for d, t in enumerate(texts) for w in t], np.int64)
    end = np.array([e for t, e in zip(texts, np.cumsum([len(t) for t in texts])) for _ in t], np.int64)
    assert repeat_lengths(word, end, shortest).tolist() == naive(word, end, shortest)


def brute(rows, size=8):
    out = []
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen, hit = {}, set()
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i:i + size]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                hit |= {i + k for i in at for k in range(size)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        long = [tuple(w[i:i + 201]) for i in range(len(w) - 200)]
        chars = sum(len(w[i]) for i in hit)
        kept = not failed and chars <= 0.3 * sum(map(len, w)) + 1e-9 and len(set(long)) == len(long)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), chars, failed, kept))
    return plain(out)


PARTS = ["a b c d e f g h " * 3 + " ".join(f"u{i}" for i in range(100)), " ".join(f"v{i}" for i in range(260)) + " x " + " ".join(f"v{i}" for i in range(260)),
         " ".join(f"u{i}" for i in range(1200)) + " " + " ".join(f"u{i}" for i in range(205)), "é\né\né\n \n \né", "#*$%&|<> " * 30]


def test_odd_rows(spark):
    rows = ROWS + [(300 + i, t, None, None, None, None, None, None) for i, t in enumerate(PARTS)]
    assert plain(quality_rules(frame(spark, rows)).drop("longest_repeat").collect()) == brute(rows)


def test_empty(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []


def test_longest(spark):
    row = quality_rules(spark.createDataFrame([(1, PARTS[1])], "doc_id long, text string")).first()
    assert row.longest_repeat == 260
