"""Near copies by shingle similarity: ball hashing of a SimHash fingerprint and several sketches per text, candidates verified
on the shingle sets.

Fingerprints meet as in `near_copies`, two bits apart at most. That finds the likest texts only; sketches find the others.
A sketch is a few least values of a text's shingle hashes, each under its own multiplier; two texts of similarity s agree in
each with probability s. A sketch's ball is the sketch with one value left out, for each of its values: two sketches that
differ in at most one value meet there. The share of all values in which two texts agree estimates their similarity before
any set is read; what may reach the limit is compared shingle by shingle, so nothing unlike is ever linked. All texts that meet
and are not linked in chains are compared, however many meet at one value. README says how much is missed.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boutline.llm.components import components
from boutline.llm.near_copies import majority, meeting
from boutline.llm.seen_twice import maybe_in
from boutline.llm.stored import arrow_schema, map_arrow, spread_join, stored
from boutline.llm.text import BLANK, mix, pieces, windows, words
from boutline.session import ship

#: Sketches per text, and values of each.
SKETCHES, VALUES = 8, 7
#: Up to so many texts of a group that are not linked to most of it are compared with all of it at once; in other groups the likest go first.
FEW = 16
#: Texts of a group that one task compares with as many others, and pairs of them that it counts at once.
TILE, PAIRS = 1024, 1 << 18
#: A pair is not compared if its estimate lies so many standard deviations below the limit (lost: 3 in 100,000 at the limit).
DEVIATIONS = 4.0
_ODD = mix(np.arange(1, SKETCHES * VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(column: pa.Array, size: int):
    """(index of the first text, index of the text, hash) of every ``size``-word shingle, by text.

    A shorter text is one shingle, and one without a word has none.
    """
    for first, data, offsets in pieces(column):
        found = words(data, offsets, BLANK)
        at, h = windows(found.hash, found.doc, size)
        doc = found.doc[at]
        count = np.bincount(found.doc, minlength=len(offsets) - 1)
        short = np.flatnonzero((count > 0) & (count < size))
        begin = np.searchsorted(found.doc, short)
        whole = np.zeros(len(short), np.uint64)
        for k in range(size):
            has = count[short] > k
            whole[has] = mix(whole[has] * np.uint64(0x9E3779B97F4A7C15) + found.hash[begin[has] + k])
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole ^ count[short].astype(np.uint64)])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        yield first, len(offsets) - 1, doc[new], h[new]


def _node(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each set; ``begin`` says where the sets begin."""
    return mix(np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), begin)) if len(begin) else np.zeros(0, np.uint64)


def ball(least: np.ndarray) -> np.ndarray:
    """The values at which texts meet, one row per text: each sketch without one of its values, for each of them."""
    sketch = least.reshape(len(least), SKETCHES, VALUES)
    place = np.arange(SKETCHES * VALUES, dtype=np.uint64).reshape(1, SKETCHES, VALUES)
    own = mix(sketch + mix(place + np.uint64(1)))
    return mix(own.sum(2, keepdims=True, dtype=np.uint64) - own + place).reshape(len(least), -1)


def _sketched(texts: DataFrame, size: int) -> DataFrame:
    """(id, node, fingerprint, at, brief): ``node`` is a hash of the shingle set, 0 if it is empty, ``fingerprint`` its SimHash, ``at``
    the values at which the text's sketches meet others, ``brief`` 16 bits of each of its least values."""

    def task(batch):
        for first, n, doc, h in shingles(batch.column(1), size):
            node, prints, at, brief = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(0, np.uint64), [None] * n
            own, begin = np.unique(doc, return_index=True)
            if len(own):
                node[own] = _node(h, begin)
                prints[own] = majority(h, np.diff(np.append(begin, len(h))))
                least = np.stack([np.minimum.reduceat(h * m, begin) for m in _ODD], 1)
                at = ball(least).reshape(-1)
                short = (mix(least) >> np.uint64(48)).astype("<u2")
                for i, row in zip(own.tolist(), short):
                    brief[i] = row.tobytes()
            sizes = np.zeros(n, np.int32)
            sizes[own] = SKETCHES * VALUES
            yield {"id": batch.column(0).slice(first, n), "node": pa.array(node.view(np.int64)),
                   "fingerprint": pa.array(prints.view(np.int64)), "brief": pa.array(brief, pa.binary()),
                   "at": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(at.view(np.int64)))}

    return map_arrow(texts, task, "id long, node long, fingerprint long, at array<long>, brief binary")


def _printed(nodes: DataFrame) -> DataFrame:
    """(at, b): the nodes (node, fingerprint) by the values at which their fingerprints meet, or that they share."""
    met = meeting(nodes).select("at", F.explode("members").alias("fingerprint"))
    equal = nodes.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select(F.col("fingerprint").alias("at"), "fingerprint")
    # Apart from the sketches' values.
    place = F.xxhash64("at", F.lit("fingerprint")).alias("at")
    return (nodes.select("fingerprint", "node").join(met.union(equal).distinct(), "fingerprint")
            .select(place, F.col("node").alias("b")))


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, own): the shingle hashes, in order, of the texts (id, t, node) whose set is ``node``."""

    def task(batch):
        nodes = batch.column(2).to_numpy(zero_copy_only=False)
        for first, _, doc, h in shingles(batch.column(1), size):
            own, begin = np.unique(doc, return_index=True)
            out = {"node": [], "own": []}
            for i, s, e, node in zip(own.tolist(), begin.tolist(), [*begin[1:].tolist(), len(h)], _node(h, begin).view(np.int64).tolist()):
                # Rows that share an id may have other texts.
                if node == nodes[first + i]:
                    out["node"].append(node)
                    out["own"].append(h[s:e].view(np.int64))
            yield out

    return map_arrow(texts, task, "node long, own array<long>")


def _enough(alike: float) -> int:
    """In how many of their values texts agree at least if their similarity may reach ``alike``."""
    count = SKETCHES * VALUES
    return int(np.ceil(count * alike - DEVIATIONS * sqrt(count * alike * (1 - alike))))


def _likely(pairs: DataFrame, nodes: DataFrame, alike: float) -> DataFrame:
    """The pairs (a, b) whose similarity, by the values in which they agree, may reach ``alike``."""
    count, least = SKETCHES * VALUES, _enough(alike)

    def task(batch):
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, count) for c in (2, 3))
        keep = pa.array((x == y).sum(1) >= least)
        yield {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    # A group's first text may have a third of all pairs.
    left = spread_join(pairs, nodes.select(F.col("node").alias("a"), F.col("brief").alias("x")), ["a"], "b", salts=4)
    both = left.join(nodes.select(F.col("node").alias("b"), F.col("brief").alias("y")), "b")
    return map_arrow(both.select("a", "b", "x", "y"), task, "a long, b long")


def forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the edges (x, y) of a spanning forest; earlier edges are taken before later ones."""
    label, taken = np.unique(np.concatenate([x, y]), return_inverse=True)[1].reshape(2, -1), []
    x, y = label
    own, at = np.arange(label.max(initial=-1) + 1), np.arange(len(x))
    while True:
        u, v = own[x[at]], own[y[at]]
        open_ = u != v
        at, u, v = at[open_], u[open_], v[open_]
        if not len(at):
            return np.unique(np.concatenate(taken)) if taken else at
        first = np.full(len(own), len(at))
        np.minimum.at(first, u, np.arange(len(at)))
        np.minimum.at(first, v, np.arange(len(at)))
        pick = np.unique(first[first < len(at)])
        taken.append(at[pick])
        u, v = u[pick], v[pick]
        while True:
            low = np.minimum(own[u], own[v])
            new = own.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            new = new[new]
            if (new == own).all():
                break
            own = new


def _met(apart: DataFrame, nodes: DataFrame, alike: float) -> DataFrame:
    """The pairs (a, b), a < b, of one group and different components whose similarity may reach ``alike``, by the values in which they agree.

    ``apart`` has (at, b, component, n, rest, main, first): of each group all ``n`` members, ``rest`` of them outside component ``main``, and
    each of those is compared with all others, ``TILE`` by ``TILE`` members in a task. Where ``first`` is true a task gives only pairs that
    connect its components, the likest first; without it all pairs. A pair may come from several groups.
    """
    count, least = SKETCHES * VALUES, _enough(alike)
    kinds = arrow_schema("a long, b long")

    def compare(first, node, component, kind, brief):
        asks = kind == 2
        a, h = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(a) or not len(h):
            return
        values, found = np.ascontiguousarray(brief[h].T), []
        wide = max(1, PAIRS // len(h))
        for s in range(0, len(a), wide):
            own = a[s:s + wide]
            agree = np.zeros((len(own), len(h)), np.uint8)
            for k in range(count):
                agree += brief[own, k][:, None] == values[k]
            # Two members outside of the main component are a pair once.
            good = (agree >= least) & (component[own][:, None] != component[h]) & ((kind[h] == 0) | (node[own][:, None] > node[h]))
            i, j = np.nonzero(good)
            found.append((own[i].astype(np.int32), h[j].astype(np.int32), agree[i, j]))
        i, j, agree = (np.concatenate(c) for c in zip(*found))
        if first[0]:
            order = np.argsort(-agree.astype(int), kind="stable")
            i, j = i[order], j[order]
            keep = forest(component[i], component[j])
            i, j = i[keep], j[keep]
        x, y = node[i], node[j]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=kinds)

    def rows(batches):
        rest = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:7]]
            columns.append(np.frombuffer(b"".join(batch.column(7).to_pylist()), "<u2").reshape(-1, count))
            if rest is not None:
                columns = [np.concatenate(p) for p in zip(rest, columns)]
            at, i, j = columns[:3]
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()]
            for s, e in zip(edges, edges[1:]):
                yield from compare(*[c[s:e] for c in columns[3:]])
            rest = [c[edges[-1]:] for c in columns]
        if rest is not None:
            yield from compare(*rest[3:])

    def tiles(size):
        return F.ceil(F.col(size) / TILE).cast("int")

    def own(size):
        return F.pmod(F.xxhash64("b", F.lit(size)), tiles(size)).cast("int")

    ship(apart.sparkSession)
    members = apart.join(nodes.select(F.col("node").alias("b"), "brief"), "b")
    outside = F.col("component") != F.col("main")
    held = members.select("at", own("n").alias("i"), F.explode(F.sequence(F.lit(0), tiles("rest") - 1)).alias("j"), "first", "b", "component", outside.cast("int").alias("kind"), "brief")
    asks = members.where(outside).select("at", F.explode(F.sequence(F.lit(0), tiles("n") - 1)).alias("i"), own("rest").alias("j"), "first", "b", "component", F.lit(2).alias("kind"), "brief")
    groups = held.union(asks).repartition("at", "i", "j").sortWithinPartitions("at", "i", "j", "kind", "b")
    return groups.mapInArrow(rows, "a long, b long").distinct()


class _Sets:
    """The shingle sets of texts that were candidates so far, each read from its text once."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, size: int, alike: float):
        self.texts, self.nodes, self.size, self.alike, self.known, self.compared = texts, nodes, size, alike, None, None

    def narrow(self, live: DataFrame) -> None:
        """From now on no pair has a node outside of ``live`` (node): the other nodes and their sets are not shuffled again."""
        self.nodes = stored(self.nodes.select("node", "id", "brief").join(live, "node"), "nodes")
        if self.known is not None:
            self.known = stored(self.known.join(live, "node"), "sets")

    def verified(self, likely: DataFrame) -> DataFrame:
        """The pairs (a, b), a < b, whose sets have a similarity of at least ``alike`` and were not compared before, written."""
        ship(likely.sparkSession)
        alike = self.alike
        likely = stored(likely if self.compared is None else likely.join(self.compared, ["a", "b"], "left_anti"), "likely")
        if likely.isEmpty():
            return likely
        self.compared = likely if self.compared is None else self.compared.union(likely)
        wanted = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
        if self.known is not None:
            wanted = wanted.join(self.known.select("node"), "node", "left_anti")
        wanted = stored(self.nodes.select("node", "id").join(wanted, "node"), "wanted")
        if not wanted.isEmpty():
            # Of the other texts hardly any is shuffled.
            sets = stored(_sets(self.texts.where(maybe_in(wanted, "id")(F.col("id"))).join(wanted, "id").select("id", "t", "node"), self.size).dropDuplicates(["node"]), "sets")
            self.known = sets if self.known is None else self.known.union(sets)

        def run(batches):
            schema = arrow_schema("a long, b long")
            for batch in batches:
                keep = np.zeros(batch.num_rows, bool)
                for i in range(batch.num_rows):
                    x, y = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = both >= alike * (len(x) + len(y) - both) - 1e-9
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], schema=schema)

        # Each second text's set travels once for each of its pairs; a first text's only once, and to the parts of a skewed join.
        right = likely.join(self.known.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
        both = right.join(self.known.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").select("a", "b", "x", "y")
        return stored(both.mapInArrow(run, "a long, b long"), "links")


def _stars(members: DataFrame) -> DataFrame:
    """(at, a, b): every other member (at, b) of a group of several beside the least of its group, written."""
    least = members.groupBy("at").agg(F.min("b").alias("a"), F.max("b").alias("last")).where("a <> last").select("at", "a")
    return stored(spread_join(members, least, ["at"], "b").where("a <> b").select("at", "a", "b"), "stars")


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """(at, b, component, n, rest, main): the ``members`` (at, b) of groups of several components, with the group's size, how many members
    are outside its largest component, and that component; written."""
    named = components(links).select(F.col("node").alias("b"), "component")
    own = members.select("at", "b").join(named, "b", "left").select("at", "b", F.coalesce("component", "b").alias("component"))
    parts = own.groupBy("at", "component").agg(F.count("*").alias("n"))
    counts = (parts.groupBy("at").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top")).where("n > top.n")
              .select("at", "n", (F.col("n") - F.col("top.n")).alias("rest"), F.col("top.component").alias("main")))
    return stored(spread_join(own, counts, ["at"], "b"), "apart")


def alike_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, alike: float = 0.8,
               few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """((id, node) of every row with an id, (a, b) links of nodes): shingle sets of similarity ``alike`` or more.

    Members of one value's group are compared with the group's least node. A group whose members are then linked, directly or in
    chains, is done. Of the other groups each two members of different components are compared: at once where up to ``few`` members
    lie outside the largest component; of larger groups first the likest pairs that would connect the components, then all that are
    still apart.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).where("id is not null")
    prints = stored(_sketched(texts, size), "sketches")
    nodes = stored(prints.where("node <> 0").groupBy("node").agg(F.min("id").alias("id"), F.min("fingerprint").alias("fingerprint"), F.min("at").alias("at"),
                                                               F.min("brief").alias("brief")), "nodes")
    members = nodes.select(F.explode("at").alias("at"), F.col("node").alias("b")).union(_printed(nodes))
    sets = _Sets(texts, nodes, size, alike)
    stars = _stars(members)
    links = sets.verified(_likely(stars.select("a", "b").distinct(), nodes, alike))
    # A group's least member was compared with all others.
    apart = _apart(stars, links)
    if not apart.isEmpty():
        sets.narrow(apart.select(F.col("b").alias("node")).distinct())
        links = stored(links.union(sets.verified(_met(apart.withColumn("first", F.col("rest") > few), sets.nodes, alike))), "links")
        large = apart.where(F.col("rest") > few)
        if not large.isEmpty():
            still = _apart(large, links)
            links = stored(links.union(sets.verified(_met(still.withColumn("first", F.lit(False)), sets.nodes, alike))), "links")
    return prints.select("id", "node"), links


def one_of_alike(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, alike: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies, that with the smallest id; documents without an id stay.

    Near copies are texts whose sets of ``size``-word shingles have a similarity (common over all) of at least ``alike``; groups
    are chains of such links. Texts without a word are one group. Rows that share the kept id all stay; other columns pass.
    """
    prints, linked = alike_sets(docs, doc_id, text, size, alike)
    own = prints.select("id", "node").distinct()
    group = (own.groupBy("node").agg(F.min("id").alias("least")).join(components(linked).withColumnRenamed("component", "c"), "node", "left")
             .select("node", F.coalesce("c", "node").alias("component"), "least"))
    kept = group.groupBy("component").agg(F.min("least").alias("kept"))
    owner = group.join(kept, "component").select("node", "kept")
    drop = stored(spread_join(own, owner, ["node"], "id").where("id > kept").select(F.col("id").alias("__doc")).distinct(), "drop")
    # Of the documents that stay hardly any is shuffled.
    asked = maybe_in(drop, "__doc")(F.col(doc_id).cast("long"))
    return docs.where(~asked).union(docs.where(asked).join(drop, F.col(doc_id).cast("long") == F.col("__doc"), "left_anti"))
