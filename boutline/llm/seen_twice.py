"""Two Bloom filters of one fixed size: hashes seen once, and hashes seen at least twice.

Every task notes its hashes; a bit that two tasks set counts as seen twice, so the merge never misses a repeat. With many more
hashes than bits the second filter suspects more of them; nothing that repeats is ever left out. The filters' size is a
parameter, not a share of the data, and so bounds what is sent to the driver and to every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boutline.llm.stored import arrow_schema
from boutline.llm.text import mix
from boutline.session import ship

#: 64-bit words of each filter: 2^21 words are 2^27 bits, 16 MB.
FILTER_WORDS = 1 << 21
#: 64-bit words of the filters of seeds, places and ids that are looked for again, 4 MB.
NOTED_WORDS = 1 << 19
#: Parts in which the filters are merged, each by one task.
SEGMENTS = 64


def places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's word in the filter, and its three bits there."""
    mask = np.zeros(len(hashes), np.uint64)
    for shift in (40, 46, 52):
        mask |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return (hashes % np.uint64(words)).astype(np.int64), mask


def note(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray) -> None:
    """Hashes of one document or several: bits already set in ``once``, and repeats among the hashes, go to ``twice`` as well."""
    h, count = np.unique(hashes, return_counts=True)
    at, mask = places(h, len(once))
    again = count > 1
    np.bitwise_or.at(twice, at[again], mask[again])
    order = np.argsort(at, kind="stable")
    at, mask = at[order], mask[order]
    place = np.arange(len(at))
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    turn = place - np.maximum.accumulate(np.where(first, place, 0))
    for t in range(int(turn.max(initial=-1)) + 1):
        a, m = at[turn == t], mask[turn == t]
        twice[a] |= once[a] & m
        once[a] |= m


def suspected(hashes: np.ndarray, twice: np.ndarray) -> np.ndarray:
    at, mask = places(hashes, len(twice))
    return (twice[at] & mask) == mask


def seen_twice(rows: DataFrame, hashes, words: int = FILTER_WORDS) -> np.ndarray:
    """The filter of hashes seen at least twice; ``hashes`` gives arrays of 64-bit hashes of a record batch of ``rows``."""
    ship(rows.sparkSession)
    width = max(1, words // SEGMENTS)
    schema, merged = "segment int, place binary, once binary, twice binary", "segment int, place binary, twice binary"

    def build(batches):
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for batch in batches:
            for own in hashes(batch):
                note(once, twice, own)
        for s in range(0, words, width):
            at = np.flatnonzero(once[s:s + width])
            if len(at):
                yield pa.RecordBatch.from_pydict({
                    "segment": [s // width], "place": [at.astype(np.uint32).tobytes()],
                    "once": [once[s + at].tobytes()], "twice": [twice[s + at].tobytes()]}, schema=arrow_schema(schema))

    def merge(batches):
        segments: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                once, twice = segments.setdefault(row["segment"], (np.zeros(width, np.uint64), np.zeros(width, np.uint64)))
                at = np.frombuffer(row["place"], np.uint32)
                own = np.frombuffer(row["once"], np.uint64)
                twice[at] |= np.frombuffer(row["twice"], np.uint64) | (once[at] & own)
                once[at] |= own
        for s, (_, twice) in segments.items():
            at = np.flatnonzero(twice)
            yield pa.RecordBatch.from_pydict({"segment": [s], "place": [at.astype(np.uint32).tobytes()],
                                              "twice": [twice[at].tobytes()]}, schema=arrow_schema(merged))

    out = np.zeros(words, np.uint64)
    # At most the filter itself, whose size is fixed, reaches the driver.
    for row in rows.mapInArrow(build, schema).repartition(SEGMENTS, "segment").mapInArrow(merge, merged).collect():
        out[row["segment"] * width + np.frombuffer(row["place"], np.uint32)] = np.frombuffer(row["twice"], np.uint64)
    return out


def noted(rows: DataFrame, *columns: str) -> np.ndarray:
    """A filter of fixed size of the rows' ``columns`` (long), hashed together."""
    def hashes(batch):
        yield np.repeat(hashed(*[c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]), 2)

    return seen_twice(rows.select(*columns), hashes, NOTED_WORDS)


def hashed(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + c.view(np.uint64))
    return out


def maybe_in(rows: DataFrame, column: str):
    """A function of a column (long): false where its value, or null, is surely none of the rows' ``column``."""
    shared = rows.sparkSession.sparkContext.broadcast(noted(rows, column))

    @F.arrow_udf("boolean")
    def held(values: pa.Array) -> pa.Array:
        own = values.fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array(suspected(hashed(own), shared.value))

    return lambda value: value.isNotNull() & held(value)
