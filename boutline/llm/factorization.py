"""Text quality by a factorisation machine.

A text is a sparse vector: its hashed words, structure statistics in fixed bins, and metadata in fixed bins. The machine adds
to a linear term all pairwise interactions through low-rank factors; the sum-of-squares identity scores them in time linear
in the vector's entries.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boutline.llm.stored import bounded_sample, map_arrow
from boutline.llm.text import BLANK, PUNCTUATION, pieces, words
from boutline.session import ship

#: Hashed words.
BUCKETS = 1 << 14
#: Most labelled documents that a fit looks at; their vectors come to the driver, texts do not.
SAMPLE = 8_000
BINS = 16
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SIGN = PUNCTUATION & ~BLANK
_LINE = np.arange(256) == 10
_MARK = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>!{}[]@^~\\="])
STATISTICS = ("words", "word length", "capitals", "digits", "signs", "marks", "lines", "distinct", "doubled", "longest word", "length")
FEATURES = BUCKETS + BINS * len(STATISTICS)


class Machine(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray


class Vectors(NamedTuple):
    """Rows of sparse vectors: where each row begins, feature numbers, values. No row is empty."""

    begin: np.ndarray
    feature: np.ndarray
    value: np.ndarray


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _log_bin(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(x, 0) + 1).astype(np.int64), BINS - 1)


def _share_bin(x: np.ndarray) -> np.ndarray:
    """Finer near 0, where most texts stand."""
    return np.minimum((np.sqrt(np.clip(x, 0, 1)) * BINS).astype(np.int64), BINS - 1)


def vectors(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> Vectors:
    """Vectors of the texts in ``data``; ``n_chars`` is their length as the table states it (-1: not stated)."""
    count = len(offsets) - 1
    found = words(data, offsets, PUNCTUATION)

    def total(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask[data])])[offsets])

    size = np.diff(offsets)
    n = np.bincount(found.doc, minlength=count)
    length = found.stop - found.start
    letters = total(_UPPER) + total(_LOWER)
    key, times = np.unique(found.doc * BUCKETS + (found.hash & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    doc = key // BUCKETS
    distinct = np.bincount(doc, minlength=count)
    doubled = np.bincount(found.doc[1:][(found.hash[1:] == found.hash[:-1]) & (found.doc[1:] == found.doc[:-1])], minlength=count)
    longest = np.zeros(count, np.int64)
    np.maximum.at(longest, found.doc, length)
    bins = [_log_bin(n), np.minimum(_share(np.bincount(found.doc, length, count), n), BINS - 1).astype(np.int64), _share_bin(_share(total(_UPPER), letters)),
            _share_bin(_share(total(_DIGIT), size)), _share_bin(_share(total(_SIGN), size)), _share_bin(_share(total(_MARK), size)),
            _share_bin(_share(total(_LINE), n)), _share_bin(_share(distinct, n)), _share_bin(_share(doubled, n)), _log_bin(longest),
            np.where(n_chars < 0, BINS - 1, _log_bin(n_chars))]
    weight = np.log1p(times)
    norm = np.sqrt(np.bincount(doc, weight ** 2, count))
    fixed = np.stack([BUCKETS + BINS * i + b for i, b in enumerate(bins)], 1)
    row = np.concatenate([doc, np.repeat(np.arange(count), len(bins))])
    order = np.argsort(row, kind="stable")
    feature = np.concatenate([key % BUCKETS, fixed.reshape(-1)])[order]
    value = np.concatenate([weight / np.maximum(norm, 1e-9)[doc], np.ones(fixed.size)])[order]
    return Vectors(np.searchsorted(row[order], np.arange(count)), feature, value)


def margin(machine: Machine, v: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """The machine's output for each row, and the factor sums of each row."""
    if not len(v.begin):
        return np.zeros(0), np.zeros((0, machine.factors.shape[1]))
    part = machine.factors[v.feature] * v.value[:, None]
    sums = np.add.reduceat(part, v.begin, axis=0)
    squares = np.add.reduceat((part ** 2).sum(1), v.begin)
    return machine.bias + np.add.reduceat(machine.linear[v.feature] * v.value, v.begin) + 0.5 * ((sums ** 2).sum(1) - squares), sums


def train(v: Vectors, label: np.ndarray, rank: int = 8, steps: int = 1500, batch: int = 128, rate: float = 0.05, decay: float = 1e-5) -> Machine:
    """Logistic loss with at least ``steps`` adaptive steps (AdaGrad); the same input gives the same machine. No rows: the score is always 1/2."""
    rng = np.random.default_rng(0)
    bias, linear, factors = 0.0, np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, rank))
    if not len(label):
        return Machine(bias, linear, factors)
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    seen, seen_factors = np.full(FEATURES, 1e-6), np.full((FEATURES, rank), 1e-6)
    bounds = np.append(v.begin, len(v.feature))
    for _ in range(-(-steps // -(-len(label) // batch))):
        order = rng.permutation(len(label))
        for a in range(0, len(order), batch):
            rows = order[a:a + batch]
            sizes = bounds[rows + 1] - bounds[rows]
            begin = np.cumsum(sizes) - sizes
            take = np.repeat(bounds[rows] - begin, sizes) + np.arange(sizes.sum())
            own = Vectors(begin, v.feature[take], v.value[take])
            z, sums = margin(Machine(bias, linear, factors), own)
            slope = np.repeat((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) / len(rows), sizes)
            used, at = np.unique(own.feature, return_inverse=True)
            down = np.bincount(at, slope * own.value) + decay * linear[used]
            grad = (slope * own.value)[:, None] * (np.repeat(sums, sizes, axis=0) - factors[own.feature] * own.value[:, None])
            deep = np.stack([np.bincount(at, g) for g in grad.T], 1) + decay * factors[used]
            seen[used] += down ** 2
            seen_factors[used] += deep ** 2
            linear[used] -= rate * down / np.sqrt(seen[used])
            factors[used] -= rate * deep / np.sqrt(seen_factors[used])
    return Machine(bias, linear, factors)


def fit(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars",
        label: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine from at most ``sample`` rows of ``labelled`` (id, 0/1 label) whose texts are in ``docs``.

    Labels without an id or value are no examples; several labels of one id are its largest.
    """
    ship(docs.sparkSession)
    examples = bounded_sample(labelled.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
                              .where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y")), "id", sample)
    chosen = (docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"), F.coalesce(F.col(n_chars).cast("long"), F.lit(-1)).alias("n"))
              .join(F.broadcast(examples), "id"))

    def run(batches):
        for batch in batches:
            for first, data, offsets in pieces(batch.column(1)):
                v = vectors(data, offsets, batch.column(2).to_numpy(zero_copy_only=False)[first:first + len(offsets) - 1])
                cuts = pa.array(np.append(v.begin, len(v.feature)).astype(np.int32))
                size = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, size), batch.column(3).slice(first, size),
                                                  pa.ListArray.from_arrays(cuts, pa.array(v.feature.astype(np.int32))),
                                                  pa.ListArray.from_arrays(cuts, pa.array(v.value))], names=["id", "y", "feature", "value"])

    rows = chosen.select("id", "t", "n", "y").mapInArrow(run, "id long, y int, feature array<int>, value array<double>").toArrow().sort_by("id")
    feature, value = rows.column("feature").combine_chunks(), rows.column("value").combine_chunks()
    sizes = np.diff(feature.offsets.to_numpy()) if len(rows) else np.zeros(0, np.int64)
    v = Vectors(np.cumsum(sizes) - sizes, feature.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy())
    return train(v, rows.column("y").to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", cut: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row; null and empty texts are scored by their statistics. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def task(batch):
        out = []
        stated = batch.column(2).to_numpy(zero_copy_only=False)
        for first, data, offsets in pieces(batch.column(1)):
            z, _ = margin(shared.value, vectors(data, offsets, stated[first:first + len(offsets) - 1]))
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        p = np.concatenate(out) if out else np.zeros(0)
        yield {doc_id: batch.column(0), "score": p, "predicted": (p >= cut).astype(np.int32)}

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text), F.coalesce(F.col(n_chars).cast("long"), F.lit(-1))), task,
                     f"{doc_id} long, score double, predicted int")
