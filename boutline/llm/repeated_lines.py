"""Line deduplication behind two Bloom filters.

Pass 1 notes every line's hash in two filters of one fixed size: seen once, and seen twice. A bit set by two tasks counts
as seen twice, so the merge never misses a repeat. Pass 2 lets only lines that the second filter suspects go into a
shuffle, where the lines' whole keys decide. The filters' size is a parameter, not a share of the data: with many more
lines than bits more lines are suspected and shuffled, and the result stays exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from boutline.llm.seen_twice import FILTER_WORDS, seen_twice, suspected
from boutline.llm.stored import map_arrow, spread_join, stored

_BLANK = b" \t\n\x0b\x0c\r"
#: Texts of a batch whose lines a task holds at once.
TEXTS = 500


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()


def long_keys(text: bytes, shortest: int) -> set[bytes]:
    """Distinct keys of at least ``shortest`` code points."""
    out = set()
    for line in text.split(b"\n"):
        if len(line) >= shortest:
            key = line_key(line)
            if len(key) >= shortest and (key.isascii() or len(key.decode()) >= shortest):
                out.add(key)
    return out


def key_hashes(keys) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)


def suspects(docs: DataFrame, doc_id: str, text: str, shortest: int, twice: np.ndarray) -> DataFrame:
    """(doc_id, key): a document's distinct long keys that the filter has."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def task(batch):
        for s in range(0, batch.num_rows, TEXTS):
            owners, keys = [], []
            for d, value in zip(batch.column(0).slice(s, TEXTS).to_pylist(), batch.column(1).slice(s, TEXTS)):
                if d is not None:
                    own = long_keys(value.as_py() or b"", shortest)
                    owners.extend([d] * len(own))
                    keys.extend(own)
            hit = np.flatnonzero(suspected(key_hashes(keys), shared.value))
            yield {"doc_id": [owners[i] for i in hit], "key": [keys[i].decode() for i in hit]}

    return map_arrow(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary").alias("t")), task, "doc_id long, key string")


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 40, least: int = 5,
                        words: int = FILTER_WORDS) -> DataFrame:
    """``docs`` with the remaining lines in ``text``, and columns ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line stripped of blanks with A-Z folded. Keys of ``shortest`` code points or more that stand in
    ``least`` documents or more lose all their lines, but for those in the largest id that holds the key. Null or empty text
    is one empty line. Rows that share an id are one document; a row without an id counts as none and keeps its lines. All
    other columns pass unchanged, whatever their names; ``n_lines`` and ``n_dropped`` replace columns so named.
    """
    def hashes(batch):
        for s in range(0, batch.num_rows, TEXTS):
            yield key_hashes([k for value in batch.column(0).slice(s, TEXTS) for k in long_keys(value.as_py() or b"", shortest)])

    twice = seen_twice(docs.select(F.col(text).cast("binary").alias("t")), hashes, words)
    found = stored(suspects(docs, doc_id, text, shortest, twice), "suspects")
    repeated = (found.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
                .where(F.col("n") >= least).select("key", "keeper"))
    drops = (spread_join(found, repeated, ["key"], "doc_id").where("doc_id <> keeper")
             .groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("key").alias("__drop")))

    kinds = [pa.string(), pa.int64(), pa.int64()]

    def some(texts: pa.Array, dropped: pa.Array) -> list[pa.Array]:
        out, before, gone = [], [], []
        for value, keys in zip(texts, dropped):
            value, keys = value.as_py() or "", keys.as_py()
            n = value.count("\n") + 1
            before.append(n)
            if keys:
                keys = {k.encode() for k in keys}
                kept = [x for x in value.split("\n") if len(x) < shortest or line_key(x.encode()) not in keys]
                gone.append(n - len(kept))
                value = "\n".join(kept)
            else:
                gone.append(0)
            out.append(value)
        return [pa.array(x, k) for x, k in zip((out, before, gone), kinds)]

    @F.arrow_udf("struct<t string, n_lines bigint, n_dropped bigint>")
    def rest(texts: pa.Array, dropped: pa.Array) -> pa.Array:
        parts = [some(texts.slice(s, TEXTS), dropped.slice(s, TEXTS)) for s in range(0, max(1, len(texts)), TEXTS)]
        return pa.StructArray.from_arrays([pa.concat_arrays(column) for column in zip(*parts)], names=["t", "n_lines", "n_dropped"])

    joined = docs.join(drops, F.col(doc_id).cast("long") == F.col("__doc"), "left").drop("__doc")
    done = joined.withColumn("__rest", rest(F.col(text), F.col("__drop")))
    return done.withColumns({text: F.col("__rest.t"), "n_lines": F.col("__rest.n_lines"), "n_dropped": F.col("__rest.n_dropped")}).drop("__rest", "__drop")
