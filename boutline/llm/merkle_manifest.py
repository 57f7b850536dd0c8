"""Merkle manifest of a table: per language a binary hash tree over its documents, and one over the languages' roots.

Nodes are built by aligned builders: each takes ``1 << width`` neighbouring nodes of one tree and appends what it completes to a
log, a node as soon as its children are there (postorder). A node's place in the log follows in closed form from the sizes of the
subtrees before it, so that a proof reads its siblings from the logs by address; nothing but the digests is stored. The builders'
last nodes are the leaves of the next round, of which there is one for each ``width`` levels. No task sees more than a range of
one tree, however many of the documents have one language.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from boutline.llm.stored import arrow_schema, map_arrow, stored
from boutline.session import ship

#: Levels that one builder completes: 1,024 leaves, and a log of at most 2,047 nodes (64 kB).
WIDTH = 10
#: The columns a leaf is made of, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SIZE = 32
#: Beside a sibling: there is none, it stands to the right, it stands to the left.
ALONE, RIGHT, LEFT = 0, 1, 2


def node(*digests: bytes) -> bytes:
    """A parent's digest: SHA-256 of its children's, written as lowercase hex and joined."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def place(leaves: int, level: int, index: int) -> int:
    """Where the ``index``-th node of ``level`` (0: leaves) stands in the log of a builder of ``leaves`` leaves, from 0.

    m leaves complete 2m - popcount(m) nodes. A whole node comes with its last leaf, after the lower nodes that come with it; the
    nodes that the end cuts short come last, the lowest first.
    """
    last = (index + 1) << level
    if last <= leaves:
        return 2 * (last - 1) - (last - 1).bit_count() + level
    whole = (leaves & -leaves).bit_length() - 1
    return 2 * leaves - leaves.bit_count() + level - whole - 1


def append_log(leaves: list[bytes], height: int) -> list[bytes]:
    """The nodes of ``height`` levels above ``leaves``, in the order of completion; the last is the root."""
    log, open_ = [], []
    for digest in leaves:
        level = 0
        log.append(digest)
        while open_ and open_[-1][0] == level:
            digest = node(open_.pop()[1], digest)
            level += 1
            log.append(digest)
        open_.append((level, digest))
    level, digest = open_.pop()
    while level < height:
        digest = node(open_.pop()[1], digest) if open_ and open_[-1][0] == level else node(digest)
        level += 1
        log.append(digest)
    return log


def siblings(log: bytes, leaves: int, height: int, index: int) -> list[tuple[int, bytes]]:
    """The path of leaf ``index`` up to the builder's root: for each level the side of the sibling, and the sibling."""
    path = []
    for level in range(height):
        own = index >> level
        other = own ^ 1
        if other < -(-leaves >> level):
            at = place(leaves, level, other) * _SIZE
            path.append((LEFT if own & 1 else RIGHT, log[at:at + _SIZE]))
        else:
            path.append((ALONE, b""))
    return path


def fold(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root to which a leaf leads by its path."""
    for side, other in path:
        digest = node(digest) if side == ALONE else node(digest, other) if side == RIGHT else node(other, digest)
    return digest


def _packed(path) -> bytes:
    return b"".join(bytes([side]) + other.ljust(_SIZE, b"\0") for side, other in path)


def _unpacked(path: bytes) -> list[tuple[int, bytes]]:
    return [(path[i], path[i + 1:i + 1 + _SIZE] if path[i] else b"") for i in range(0, len(path), 1 + _SIZE)]


def leaf(*values) -> Column:
    """SHA-256 of the values' UTF-8 bytes, each after its length and a colon; a null is a dash."""
    texts = [F.col(v).cast("string") if isinstance(v, str) else v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(rows: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 among those of their key, and ``total``, how many these are.

    Ranges are ordered by themselves, and a range's first place comes from the counts of the ranges before it.
    """
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    ranges = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                    .withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), label)
    counts = ranges.groupBy(key, "__part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as ranges and keys; Spark sends it to all tasks if the written table is small.
    starts = stored(counts.select(key, "__part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("__shift"),
                                  F.sum("n").over(Window.partitionBy(key)).alias("total")), f"{label}-starts")
    return ranges.join(starts, [key, "__part"]).withColumn("idx", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


_LOG = "tree string, block long, leaves long, height long, total long, log binary, root binary, ids array<long>, claims binary"


def _round(nodes: DataFrame, label: str, width: int) -> DataFrame:
    """One log per block of (tree, idx, total, digest, id, claim)."""
    ship(nodes.sparkSession)
    schema = arrow_schema(_LOG)

    def close(tree, block, total, rows):
        height = width if total > 1 << width else (total - 1).bit_length()
        log = append_log([r[0] for r in rows], height)
        return {"tree": tree, "block": block, "leaves": len(rows), "height": height, "total": total, "log": b"".join(log), "root": log[-1],
                "ids": [r[1] for r in rows], "claims": b"".join(r[2] for r in rows)}

    def run(batches):
        now, rows = None, []
        for batch in batches:
            done = []
            for tree, block, total, digest, own, claim in zip(*[batch.column(c).to_pylist() for c in range(6)]):
                if now != (tree, block, total):
                    if rows:
                        done.append(close(*now, rows))
                    now, rows = (tree, block, total), []
                rows.append((digest, own, claim))
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if rows:
            yield pa.RecordBatch.from_pylist([close(*now, rows)], schema=schema)

    blocks = nodes.select("tree", F.shiftright("idx", width).alias("block"), "total", "digest", "id", "claim", "idx")
    dealt = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx").drop("idx")
    return stored(dealt.mapInArrow(run, _LOG), label)


def grow(nodes: DataFrame, label: str, width: int = WIDTH) -> list[DataFrame]:
    """The logs of all trees, round by round; ``nodes`` are (tree, idx, total, digest, id, claim)."""
    rounds = [_round(nodes, label, width)]
    while not (more := rounds[-1].where(F.col("total") > 1 << width)).isEmpty():
        total = F.shiftright(F.col("total") + ((1 << width) - 1), width)
        rounds.append(_round(more.select("tree", F.col("block").alias("idx"), total.alias("total"), F.col("root").alias("digest"),
                                         F.lit(None).cast("long").alias("id"), F.col("root").alias("claim")), label, width))
    return rounds


def roots(rounds: list[DataFrame], width: int = WIDTH) -> DataFrame:
    """(tree, root) of every tree."""
    return reduce(DataFrame.union, [r.where(F.col("total") <= 1 << width).select("tree", "root") for r in rounds])


def _one_by_one(batch: pa.RecordBatch):
    """Rows that hold a log each: only one is ever a Python object."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _ways(logs: DataFrame, width: int) -> DataFrame:
    """(tree, idx, path) of each leaf of the logs: its way to the log's root, and on by the log's own ``path``."""

    def task(batch):
        for row in _one_by_one(batch):
            n = row["leaves"]
            yield {"tree": [row["tree"]] * n, "idx": [(row["block"] << width) + i for i in range(n)],
                   "path": [_packed(siblings(row["log"], n, row["height"], i)) + row["path"] for i in range(n)]}

    return map_arrow(logs.select("tree", "block", "leaves", "height", "log", "path"), task, "tree string, idx long, path binary")


def descend(rounds: list[DataFrame], start: DataFrame, width: int = WIDTH) -> DataFrame:
    """The first round's logs with ``path``, their way up from the log's root; ``start`` is (tree, path) of the trees' roots."""
    below = None
    for logs in reversed(rounds):
        own = logs.where(F.col("total") <= 1 << width).join(start, "tree")
        if below is not None:
            up = below.select("tree", F.col("idx").alias("block"), "path")
            own = own.unionByName(logs.where(F.col("total") > 1 << width).join(up, ["tree", "block"]))
        if logs is not rounds[0]:
            below = stored(_ways(own, width), "paths")
    return own


class Manifest(NamedTuple):
    """The logs of the language trees, round by round, those of the tree over their roots, and (tree, path, subroot) of each language."""

    logs: list[DataFrame]
    top: list[DataFrame]
    languages: DataFrame
    root: bytes | None
    width: int


def build_manifest(docs: DataFrame, claim: Column | None = None, width: int = WIDTH) -> Manifest:
    """Write the manifest of ``docs`` (columns ``FIELDS``; others are ignored).

    Documents ascend by doc_id in their language's tree, a null id first, rows that share an id by their digests; languages ascend
    by their UTF-8 bytes, a null one first. ``claim`` is a document's digest as somebody else states it, to be verified; without
    it, its own. An empty table has no logs and no root.
    """
    own = leaf(*FIELDS)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree")
    # Written once: ranges are sampled from the digests, not from the texts.
    leaves = stored(docs.select(F.col("doc_id").cast("long").alias("id"), tree, F.unhex(own).alias("digest"),
                                F.unhex(own if claim is None else claim).alias("claim")), "leaves")
    logs = grow(numbered(leaves, "tree", ["id", "digest"], "ordered"), "logs", width)
    subroots = roots(logs, width).select(F.lit("").alias("all"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    named = stored(numbered(subroots, "all", ["name"], "languages"), "languages")
    if named.isEmpty():
        return Manifest(logs, [], named.select(F.col("name").alias("tree"), F.col("digest").alias("path"), F.col("digest").alias("subroot")), None, width)
    top = grow(named.select(F.col("all").alias("tree"), "idx", "total", "digest", F.lit(None).cast("long").alias("id"), F.col("digest").alias("claim")), "top", width)
    over = descend(top, roots(top, width).select("tree", F.unhex(F.lit("")).alias("path")), width)
    languages = stored(named.join(_ways(over, width).select("idx", "path"), "idx").select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot")), "ways")
    return Manifest(logs, top, languages, bytes(roots(top, width).first().root), width)


def proofs(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of the manifest's table.

    ``proof_sha256`` is the SHA-256 of the siblings on the way to the root; ``folded_root`` is where the claimed digest leads by
    them, and ``verified`` whether that is the root. Repeated rows have a leaf and a proof each.
    """
    top = manifest.root or b""

    def prove(batch):
        for row in _one_by_one(batch):
            out = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
            way = _unpacked(row["path"])
            rest = "".join(other.hex() for _, other in way)
            for i, own in enumerate(row["ids"]):
                path = siblings(row["log"], row["leaves"], row["height"], i)
                at = place(row["leaves"], 0, i) * _SIZE
                folded = fold(fold(row["claims"][i * _SIZE:(i + 1) * _SIZE], path), way)
                out["doc_id"].append(own)
                out["leaf"].append(row["log"][at:at + _SIZE].hex())
                out["proof_sha256"].append(sha256(("".join(other.hex() for _, other in path) + rest).encode()).hexdigest())
                out["folded_root"].append(folded.hex())
                out["verified"].append(folded == top)
            out["subroot"] += [row["subroot"].hex()] * row["leaves"]
            out["root"] += [top.hex()] * row["leaves"]
            yield out

    rows = descend(manifest.logs, manifest.languages.select("tree", "path"), manifest.width).join(manifest.languages.select("tree", "subroot"), "tree")
    return map_arrow(rows.select("ids", "log", "leaves", "height", "claims", "path", "subroot"), prove,
                     "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
