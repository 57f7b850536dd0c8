"""Quality rules with suffix-array repetition.

Per text a suffix array over words is sorted by prefix doubling; only suffixes that still share their prefix with another one
stay in the sort, so ordinary texts end after a few rounds. Longest common prefixes of neighbouring suffixes are the depths
of the intervals of maximal repeated substrings; the union of their spans and the longest of them decide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from boutline.llm.stored import map_arrow
from boutline.llm.text import BLANK, pieces, words

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_START = np.array([b & 0xC0 != 0x80 for b in range(256)])


def repeat_lengths(word: np.ndarray, end: np.ndarray, shortest: int) -> np.ndarray:
    """For each suffix, the words it shares with the suffix most like it; 0 where these are fewer than ``shortest``.

    ``word`` tells words apart, and those of different texts as well; ``end`` is the place behind the suffix's text.
    """
    n = len(word)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    _, group, count = np.unique(word, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[group]
    active = np.flatnonzero(count[group] > 1)
    levels, step, depth = [rank], 1, shortest.bit_length() - 1
    alike = active
    while len(active):
        follow = np.where(active + step < end[active], rank[np.minimum(active + step, n - 1)], -1)
        order = np.lexsort((follow, rank[active]))
        at, a, b = active[order], rank[active][order], follow[order]
        old = np.ones(len(at), bool)
        old[1:] = a[1:] != a[:-1]
        new = old.copy()
        new[1:] |= b[1:] != b[:-1]
        place = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[at] = a + begin - np.maximum.accumulate(np.where(old, place, 0))
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        active = at[np.repeat(size, size) > 1]
        levels.append(rank)
        step *= 2
        if len(levels) - 1 == depth:
            alike = active
    if len(levels) <= depth:
        return out
    order = alike[np.argsort(rank[alike], kind="stable")]
    i, j = order[:-1], order[1:]
    same = levels[depth][i] == levels[depth][j]
    i, j = i[same], j[same]
    length = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + length, j + length
        inside = (a < end[i]) & (b < end[j])
        length += (inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])).astype(np.int64) << k
    length[length < shortest] = 0
    np.maximum.at(out, i, length)
    np.maximum.at(out, j, length)
    return out


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _repeated_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 8, least_words: int = 20,
                  base_share: int = 30, cover: float = 0.3, longest: int = 200) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_chars, longest_repeat, base_failed, kept) of every row.

    ``n_repeat_words`` are the words in the union of repeats of ``shortest`` words or more: the words in windows of that size
    which the text holds twice. The base rule fails texts of fewer than ``least_words`` words or with more than ``base_share``
    percent of such words. The method keeps what passes if the union covers at most the share ``cover`` of the words'
    characters (``repeat_chars``) and no repeat has more than ``longest`` words. Null and empty texts have no words and fail. Repeated rows give repeated results; other columns are
    ignored.
    """

    def task(batch):
        column = batch.column(1)
        rows = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "repeat_chars", "longest_repeat")}
        duplicates = [_repeated_lines(v.as_py() or b"") for v in column]
        for _, data, offsets in pieces(column):
            found = words(data, offsets, BLANK, fold=False)
            count = len(offsets) - 1
            n = np.bincount(found.doc, minlength=count)
            ends = np.cumsum(n)
            length = repeat_lengths(found.hash ^ found.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), ends[found.doc], shortest)
            edge = np.zeros(len(length) + 1, np.int64)
            at = np.flatnonzero(length)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length[at], -1)
            most = np.zeros(count, np.int64)
            np.maximum.at(most, found.doc[at], length[at])
            rows["n_words"].append(n)
            rows["word_chars"].append(_sums(~BLANK[data] & _START[data], offsets))
            rows["n_symbols"].append(_sums(_SYMBOL[data], offsets))
            covered = np.cumsum(edge[:-1]) > 0
            points = np.concatenate([[0], np.cumsum(_START[data])])
            rows["n_repeat_words"].append(np.bincount(found.doc[covered], minlength=count))
            rows["repeat_chars"].append(np.bincount(found.doc, (points[found.stop] - points[found.start]) * covered, count).astype(np.int64))
            rows["longest_repeat"].append(most)
        whole = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in rows.items()}
        n, repeated = whole["n_words"], whole["n_repeat_words"]
        failed = (n < least_words) | (100 * repeated > base_share * n)
        kept = ~failed & (whole["repeat_chars"] <= cover * whole["word_chars"] + 1e-9) & (whole["longest_repeat"] <= longest)
        yield whole | {doc_id: batch.column(0), "n_dup_lines": duplicates, "base_failed": failed, "kept": kept}

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).cast("binary").alias("t")), task,
                     f"{doc_id} long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                     "repeat_chars long, longest_repeat long, base_failed boolean, kept boolean")
