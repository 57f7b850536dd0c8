"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint emits every value within half the radius of itself. Two fingerprints within the radius meet in at least one
value, so equality on emitted values finds every link. What stands at one value is bounded by the ball, not by the data:
equal fingerprints are one row before anything is emitted.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from boutline.llm.components import components
from boutline.llm.stored import arrow_schema, spread_join, stored
from boutline.session import ship

_LANES = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], np.uint64)
_SIGN = 1 << 63


def text_fingerprint_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 (seed 42) of every ``size``-word shingle; the whole sequence if it is shorter, nothing if there is no word."""
    found = text.lower().split()
    if not found:
        return []
    joined, starts, stops, at = b" ".join(found), [], [], 0
    for word in found:
        starts.append(at)
        at += len(word)
        stops.append(at)
        at += 1
    h = xxhash.xxh64_intdigest
    if len(found) <= size:
        return [h(joined, 42)]
    return [h(joined[a:b], 42) for a, b in zip(starts, stops[size - 1:])]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of ``sizes`` (none of them 0) hashes, the value whose bit is 1 where over half of the run's hashes have it."""
    firsts = np.cumsum(sizes) - sizes
    blocks = -(-sizes // 255)
    begin = np.repeat(firsts, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    lanes = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, 8)], begin, axis=0)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(blocks) - blocks, axis=0)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) of every row; a text without words, or null, has fingerprint 0."""
    schema = f"{doc_id} long, fingerprint long"
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out, sizes, hashes = np.zeros(batch.num_rows, np.uint64), [], []

            def settle(end):
                if sizes:
                    n = np.array(sizes)
                    full = n > 0
                    if full.any():
                        out[end - len(n):end][full] = majority(np.array(hashes, np.uint64), n[full])
                    sizes.clear()
                    hashes.clear()

            for i, value in enumerate(batch.column(1)):
                own = text_fingerprint_hashes(value.as_py() or b"", size)
                sizes.append(len(own))
                hashes.extend(own)
                if len(hashes) > 200_000:
                    settle(i + 1)
            settle(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], schema=arrow_schema(schema))

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary").alias("t")).mapInArrow(run, schema)


def _within(values, bits: int, radius: int):
    """Array of every value that differs from ``values`` in at most ``radius`` bits."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    signed = [m - (1 << 64) if m >= _SIGN else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: values.bitwiseXOR(m))


def meeting(fingerprint: DataFrame, radius: int = 2, bits: int = 64) -> DataFrame:
    """(at, members): emitted values at which several distinct values of column ``fingerprint`` meet, and those values.

    With radius 2 the members at a value are kept as one 64-bit mask of the flipped bit and one flag, which Spark combines
    before the shuffle.
    """
    # Few bytes become 65 rows each: an explicit number of partitions keeps them spread.
    spread = int(fingerprint.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = fingerprint.select("fingerprint").distinct().repartition(spread)
    if radius == 2 and bits == 64:
        flip = F.explode(F.sequence(F.lit(-1), F.lit(bits - 1))).alias("bit")
        one = F.expr("shiftleft(1L, bit)")
        at = (values.select("fingerprint", flip)
              .select(F.when(F.col("bit") < 0, F.col("fingerprint")).otherwise(F.col("fingerprint").bitwiseXOR(one)).alias("at"),
                      F.when(F.col("bit") < 0, F.lit(0).cast("long")).otherwise(one).alias("mask"),
                      (F.col("bit") < 0).cast("int").alias("own"))
              .groupBy("at").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own"))
              .where(F.bit_count("mask") + F.col("own") > 1))
        flips = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.getbit(F.col("mask"), b) == 1)
        members = F.concat(F.transform(flips, lambda b: F.col("at").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))),
                           F.when(F.col("own") == 1, F.array("at")).otherwise(F.array().cast("array<bigint>")))
        return at.select("at", members.alias("members"))
    return (values.select(F.col("fingerprint"), F.explode(_within(F.col("fingerprint"), bits, radius // 2)).alias("at"))
            .groupBy("at").agg(F.collect_set("fingerprint").alias("members")).where(F.size("members") > 1))


def links(fingerprint: DataFrame, radius: int = 2, bits: int = 64) -> DataFrame:
    """(a, b) pairs of distinct values of column ``fingerprint`` that connect all values within ``radius`` bits.

    At each emitted value every member is paired with the smallest member only: members stand within half the radius of
    that value, so each pair of them links, and the star connects the same values as all pairs would.
    """
    groups = meeting(fingerprint, radius, bits)
    pairs = (groups.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b").distinct())
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked, directly or in chains, by fingerprints ``radius`` bits apart.

    One result row per input row, repeated rows too. ``component_id`` is the smallest id reachable. A null id takes no part in
    that minimum; rows with null ids alone have a null component. Empty input gives an empty result; other columns are ignored.
    """
    prints = stored(fingerprints(docs, doc_id, text, size).withColumnRenamed(doc_id, "doc_id"), "fingerprints")
    values = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    linked = stored(links(prints, radius), "links")
    member = components(linked)
    group = (values.join(member, F.col("fingerprint") == F.col("node"), "left")
             .select("fingerprint", F.coalesce("component", "fingerprint").alias("component"), "least"))
    named = group.groupBy("component").agg(F.min("least").alias("component_id"))
    owner = group.join(named, "component").select("fingerprint", "component_id")
    # Empty texts and mass copies share one fingerprint.
    return spread_join(prints, owner, ["fingerprint"], "doc_id").select(
        F.col("doc_id").alias(doc_id), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
