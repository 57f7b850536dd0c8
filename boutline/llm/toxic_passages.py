"""Toxic passages as maximal-scoring segments of token log-odds, calibrated by extreme-value statistics.

Fit: a bounded sample of labelled documents gives the presence of each hashed token in toxic and in clean documents; the
Dirichlet prior of both is the token's frequency over all documents. A token's weight is its log-odds, shrunk towards 0 by its
uncertainty. On clean text the best segment of a document of n tokens follows exp(-K n exp(-lambda s)); lambda solves the
zero-drift equation on clean tokens, and K comes from the clean sample documents. A document's evidence is the summed
-ln(E) of its significant segments, and a logistic curve on the sample turns evidence into a score.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boutline.llm.stored import arrow_schema, bounded_sample, map_arrow
from boutline.llm.text import PUNCTUATION, pieces, words
from boutline.session import ship

#: Hashed tokens; a model is this many 4-byte weights.
BUCKETS = 1 << 18
#: Most labelled documents that a fit looks at.
SAMPLE = 20_000


class Model(NamedTuple):
    weight: np.ndarray
    drift: float
    rate: float
    scale: float
    slope: float
    offset: float


class Segment(NamedTuple):
    first: int
    last: int
    score: float


def tokens(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS):
    found = words(data, offsets, PUNCTUATION)
    return found, (found.hash & np.uint64(buckets - 1)).astype(np.int64)


def weigh(found, bucket: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each token's weight; one that repeats the token before it says nothing new and has weight 0."""
    out = weight[bucket].astype(float)
    out[1:][(bucket[1:] == bucket[:-1]) & (found.doc[1:] == found.doc[:-1])] = 0
    return out


def maximal_segments(left: list[float], right: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, in linear time, as (first, last, score).

    ``left`` and ``right`` are the running scores before and after each positive token; negative tokens lie between them.
    Every candidate keeps the nearest earlier candidate that begins lower, so no candidate is looked at twice for nothing.
    """
    held: list[tuple[float, float, int, int, int]] = []
    for k, (low, high) in enumerate(zip(left, right)):
        first = k
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= low:
                j = held[j][4]
            if j < 0 or held[j][1] >= high:
                held.append((low, high, first, k, j))
                break
            low, first = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, high - low) for low, high, a, b, _ in held]


def document_segments(weights: np.ndarray, doc: np.ndarray, count: int, drift: float) -> list[list[Segment]]:
    """Maximal segments of each of ``count`` documents; ``weights`` stand in text order, ``doc`` names their document."""
    scores = weights - drift
    at = np.flatnonzero(scores > 0)
    total = np.cumsum(scores)
    after = total[at]
    before = after - scores[at]
    bounds = np.searchsorted(doc[at], np.arange(count + 1))
    begin = np.searchsorted(doc, np.arange(count))
    out: list[list[Segment]] = [[] for _ in range(count)]
    for i in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[i], bounds[i + 1]
        out[i] = [Segment(int(at[a + x] - begin[i]), int(at[a + y] - begin[i]), s)
                  for x, y, s in maximal_segments(before[a:b].tolist(), after[a:b].tolist())]
    return out


def evidence(segments: list[Segment], n: int, rate: float, scale: float, level: float = 0.05) -> float:
    """Sum of -ln(E) over segments with E below ``level``, else that of the best segment, at least 0; 0 without segments."""
    if not segments:
        return 0.0
    each = [rate * s.score - np.log(scale * max(n, 1)) for s in segments]
    significant = [x for x in each if x > -np.log(level)]
    return float(sum(significant) if significant else max(0.0, max(each)))


def _presence(docs: DataFrame, text: str, marks: list, buckets: int) -> DataFrame:
    """(bucket, n...) for each mark (0/1 column): documents that hold the bucket's token; summed by Spark."""
    ship(docs.sparkSession)
    names = [f"n{i}" for i in range(len(marks))]
    schema = ", ".join(["bucket int", *(f"{n} long" for n in names)])

    def run(batches):
        counts = np.zeros((len(names), buckets), np.int64)
        for batch in batches:
            flags = np.stack([batch.column(1 + i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(len(names))])
            for first, data, offsets in pieces(batch.column(0)):
                found, bucket = tokens(data, offsets, buckets)
                once = np.unique(found.doc * buckets + bucket)
                own = flags[:, first + once // buckets] != 0
                for i in range(len(names)):
                    counts[i] += np.bincount(once[own[i]] % buckets, minlength=buckets)
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(c[at]) for c in counts)], schema=arrow_schema(schema))

    chosen = docs.select(F.col(text), *[m.cast("int").alias(n) for m, n in zip(marks, names)])
    return chosen.mapInArrow(run, schema).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])


def fit(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        sample: int = SAMPLE, buckets: int = BUCKETS, prior: float = 0.3, certainty: float = 1.5, drift: float = 0.2) -> Model:
    """Model from all documents' token frequencies and ``labelled`` (id, 0/1 label), of which at most ``sample`` rows are used.

    Rows without an id or label are no examples. Equal texts count once for the weights. With no example of one of the
    classes every weight is 0 and every score the share of toxic examples (0 without any example).
    """
    examples = bounded_sample(labelled.select(F.col(doc_id).cast("long").alias("__id"), F.col(label).cast("int").alias("__y"))
                              .where("__id is not null and __y is not null").groupBy("__id").agg(F.max("__y").alias("__y")), "__id", sample)
    # At most ``sample`` ids: small enough to send to every task. Their texts stay on the executors.
    chosen = (docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__t"))
              .join(F.broadcast(examples), "__id"))
    distinct = chosen.groupBy(F.xxhash64("__t").alias("h")).agg(F.max(F.struct("__y", "__id")).alias("m"))
    first = F.broadcast(distinct.select("m.__id", "m.__y"))
    own = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__t")).join(first, "__id")
    table = _presence(own, "__t", [F.col("__y") == 1, F.col("__y") == 0], buckets).toPandas()
    weight = np.zeros(buckets, np.float32)
    toxic, clean = (np.zeros(buckets) for _ in range(2))
    toxic[table.bucket], clean[table.bucket] = table.n0, table.n1
    if toxic.any() and clean.any():
        corpus = np.zeros(buckets)
        everywhere = _presence(docs.select(text), text, [F.lit(1)], buckets).toPandas()
        corpus[everywhere.bucket] = everywhere.n0
        share = (corpus + 1) / (corpus.sum() + buckets)
        a, b = prior * toxic.sum() * share, prior * clean.sum() * share
        odds = np.log((toxic + a) / toxic.sum()) - np.log((clean + b) / clean.sum())
        sure = np.sqrt(1 / (toxic + a) + 1 / (clean + b))
        weight = (np.sign(odds) * np.maximum(0, np.abs(odds) - certainty * sure)).astype(np.float32)
    values, at = np.unique(weight - drift, return_inverse=True)
    chance = np.bincount(at, clean + 1e-9, len(values))
    rate = _zero_drift(values.astype(float), chance / chance.sum())
    rows = _scan(chosen.select("__id", "__t", "__y"), weight, drift).toPandas()
    scale = _scale(rows[rows.y == 0], rate)
    x = np.array([evidence([Segment(0, 0, s) for s in v], n, rate, scale) for v, n in zip(rows.scores, rows.n)])
    slope, offset = _logistic(x, rows.y.to_numpy(float))
    return Model(weight, drift, rate, scale, slope, offset)


def _scan(rows: DataFrame, weight: np.ndarray, drift: float) -> DataFrame:
    """(id, y, n, scores): tokens and segment scores of the sample's documents."""

    def run(batches):
        for batch in batches:
            ns, scores = [], []
            for first, data, offsets in pieces(batch.column(1)):
                found, bucket = tokens(data, offsets, len(weight))
                count = len(offsets) - 1
                ns.extend(np.bincount(found.doc, minlength=count).tolist())
                scores.extend([s.score for s in own] for own in document_segments(weigh(found, bucket, weight), found.doc, count, drift))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(ns, pa.int64()),
                                              pa.array(scores, pa.list_(pa.float64()))], names=["id", "y", "n", "scores"])

    return rows.mapInArrow(run, "id long, y int, n long, scores array<double>")


def _zero_drift(values: np.ndarray, chance: np.ndarray) -> float:
    """The positive lambda with sum(chance exp(lambda value)) = 1, by bisection."""
    if not (values > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    while (chance * np.exp(high * values)).sum() < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (chance * np.exp(mid * values)).sum() < 1 else (low, mid)
    return max(high, 1e-3)


def _scale(clean, rate: float) -> float:
    """K from the mean of the best segment scores of clean documents: rate * E[best] = ln(K n) + Euler's constant."""
    best = np.array([max(v) if len(v) else 0.0 for v in clean.scores])
    if not len(best):
        return 1.0
    return float(np.exp(np.mean(rate * best - np.log(np.maximum(clean.n.to_numpy(float), 1))) - 0.5772156649015329))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Newton's method with a small ridge; constant share when only one class is there."""
    if not len(y) or y.min() == y.max():
        return 0.0, -20.0 if not len(y) or y.max() == 0 else 20.0
    z = np.stack([x, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - 1e-3 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def judge(texts: pa.Array, model: Model) -> list[tuple[float, str]]:
    """Score and significant passages of each text."""
    out = []
    for _, data, offsets in pieces(texts):
        found, bucket = tokens(data, offsets, len(model.weight))
        count = len(offsets) - 1
        ns = np.bincount(found.doc, minlength=count)
        for own, n in zip(document_segments(weigh(found, bucket, model.weight), found.doc, count, model.drift), ns):
            x = evidence(own, n, model.rate, model.scale)
            out.append((float(1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))),
                        ",".join(f"{s.first}-{s.last}" for s in own if model.rate * s.score > np.log(model.scale * max(n, 1) / 0.05))))
    return out


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", cut: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, passages) of every row.

    ``score`` in 0..1 is higher where toxic is likelier; empty and null texts get the score of no evidence. ``passages`` are
    the significant segments as "first-last" token numbers, joined by commas. One result row per input row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batch):
        judged = judge(batch.column(1), shared.value)
        yield {doc_id: batch.column(0), "score": [p for p, _ in judged], "predicted": [int(p >= cut) for p, _ in judged],
               "passages": [at for _, at in judged]}

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text)), task,
                     f"{doc_id} long, score double, predicted int, passages string")


def without_toxic(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", cut: float = 0.3) -> DataFrame:
    """Rows whose score is below ``cut``, scored in place: nothing is shuffled, and all columns pass unchanged."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(column: pa.Array) -> pa.Array:
        return pa.array([p < cut for p, _ in judge(column, shared.value)], pa.bool_())

    return docs.where(clean(F.col(text).cast("string")))
