import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from odd import TEXTS

from boutline.llm.seen_twice import note, suspected
from boutline.llm.text import BLANK, PUNCTUATION, pieces, windows, words


def naive(texts, separator, fold):
    out = []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        for m in re.finditer(b"[" + b"".join(re.escape(bytes([b])) for b in range(256) if not separator[b]) + b"]+", raw):
            out.append((i, m[0].lower() if fold else m[0]))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\n.\t0", max_size=30)), max_size=8), st.booleans(), st.integers(1, 40))
def test_words(texts, fold, limit):
    for separator in (BLANK, PUNCTUATION):
        got, hashes = [], []
        for first, data, offsets in pieces(pa.array(texts, pa.string()), limit):
            found = words(data, offsets, separator, fold)
            got += [(first + d, bytes(data[a:b]).lower() if fold else bytes(data[a:b])) for a, b, d in zip(found.start, found.stop, found.doc)]
            hashes += found.hash.tolist()
        assert got == naive(texts, separator, fold)
        assert len({w for _, w in got}) == len(set(hashes)) == len({(w, h) for (_, w), h in zip(got, hashes)})


def test_sliced_and_odd():
    column = pa.array(TEXTS, pa.large_string()).slice(3)
    seen = [(first, len(offsets) - 1) for first, _, offsets in pieces(column, 100)]
    assert sum(n for _, n in seen) == len(column)


def test_windows():
    h = np.array([1, 2, 3, 1, 2, 3, 1], np.uint64)
    at, w = windows(h, np.array([0, 0, 0, 0, 0, 1, 1]), 2)
    assert at.tolist() == [0, 1, 2, 3, 5] and w[0] == w[3] and len(set(w.tolist())) == 3
    assert len(windows(h[:1], np.zeros(1), 2)[0]) == 0


def test_seen_twice_never_misses():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    often = np.concatenate([h, h[:700], h[:3], h[:3]])
    rng.shuffle(often)
    for words_ in (64, 1 << 14):
        once, twice = np.zeros(words_, np.uint64), np.zeros(words_, np.uint64)
        for part in np.array_split(often, 9):
            note(once, twice, part)
        assert suspected(h[:700], twice).all()
    assert suspected(h[700:], twice).mean() < 0.2
