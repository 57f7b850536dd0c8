"""Substring deduplication by collinear chaining.

1. Seeds are five-word windows chosen by winnowing: whatever ten windows in a row two texts share, they share a chosen one.
2. Only seeds that a fixed-size filter suspects of repeating are shuffled. Each seed links every document that holds it to the
   first one that does: as many links as occurrences, never all pairs.
3. The links of two documents are chained: ordered in both texts, with a cost for every word passed over, the best predecessor
   found in a Fenwick tree.
4. Chains are aligned on the words themselves, which are fetched in blocks: each block is read once however many chains need
   it. Passages that are long and alike enough are results.
5. Seeds left outside of all passages meet every earlier document that holds them, by the words around them: places with the
   same words all around go to the first of them; of the others each two are compared, in blocks, and what agrees without a gap
   is aligned as above.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boutline.llm.seen_twice import FILTER_WORDS, hashed as _hashed, noted as _noted, seen_twice, suspected
from boutline.llm.stored import arrow_schema, hot_join, map_arrow, spread_join, stored
from boutline.llm.text import PUNCTUATION, mix, pieces, windows, words
from boutline.session import released, ship

#: Words of one block that is fetched for alignment, and how far a chain is extended beyond its outermost seeds.
BLOCK, REACH = 64, 64
#: Bytes of text worked on at once.
PART = 1 << 19
#: Words in a row (by `_extend`) in which two texts have to agree around a seed that their first holder did not settle.
RUN = 16
#: Places of a seed that are compared with as many others in a task, and pairs of them at once.
PLACES, PAIRS = 4096, 1 << 20
#: Words on a side of two places that are counted before their pair is extended word by word, and places of a group that is laid out pair by pair.
CLOSE, SMALL = 8, 64
#: What an extension may lose before it ends.
DROP = 6


def chosen(h: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every ``window`` hashes in a row of one text, the last of equal ones.

    Of texts with fewer hashes all places are chosen: what is chosen of a text depends on that text alone.
    """
    few = np.flatnonzero(np.bincount(doc, minlength=1)[doc] < window) if len(doc) else np.zeros(0, np.int64)
    n = len(h) - window + 1
    if n <= 0:
        return few
    best, at = h[:n].copy(), np.arange(n)
    for o in range(1, window):
        other = h[o:o + n]
        less = other <= best
        best = np.where(less, other, best)
        at = np.where(less, np.arange(o, o + n), at)
    return np.union1d(at[doc[:n] == doc[window - 1:]], few)


def _seeded(column: pa.Array, size: int, window: int):
    """(index of the piece's first document, words, first word of each document, word, number among words that do not repeat the
    last, hash) of the chosen windows."""
    for first, data, offsets in pieces(column, PART):
        found = words(data, offsets, PUNCTUATION)
        new = np.ones(len(found.hash), bool)
        new[1:] = (found.hash[1:] != found.hash[:-1]) | (found.doc[1:] != found.doc[:-1])
        place = np.flatnonzero(new)
        at, h = windows(found.hash[place], found.doc[place], size)
        pick = chosen(h, found.doc[place][at], window)
        step, h = at[pick], h[pick]
        at = place[step]
        number = np.arange(len(offsets))
        yield first, found, np.searchsorted(found.doc, number), at, step - np.searchsorted(found.doc[place], number)[found.doc[at]], h


def seeds(column: pa.Array, size: int, window: int):
    """(index of the document, word number, number among words that do not repeat the last, hash) of the chosen windows.

    Windows count a word that repeats at once as one word, so that a long run of one word is not full of equal seeds.
    """
    for first, found, begin, at, step, h in _seeded(column, size, window):
        doc = found.doc[at]
        yield first + doc, at - begin[doc], step, h


def around(found, begin: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """16 bits of each of the ``REACH`` words before a seed, outwards, and after it; 0 beyond the text, one row per seed."""
    doc = found.doc[at]
    low, high = begin[doc][:, None], begin[doc + 1][:, None]
    step = np.arange(REACH)
    place = np.concatenate([at[:, None] - 1 - step, at[:, None] + size + step], 1)
    inside = (place >= low) & (place < high)
    return np.where(inside, np.maximum(found.hash[np.where(inside, place, 0)] >> np.uint64(48), np.uint64(1)), np.uint64(0)).astype("<u2")


def reached(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, drop: int = DROP) -> tuple[np.ndarray, np.ndarray]:
    """`_extend` of rows ``i`` of ``a`` beside rows ``j`` of ``b``, all pairs at once: (words, equal words); 0 is no word."""
    best, matched, live = np.zeros(len(i), np.int16), np.zeros(len(i), np.int16), np.arange(len(i))
    total, peak, equal = (np.zeros(len(i), np.int16) for _ in range(3))
    for o in range(a.shape[1]):
        x, y = a[i[live], o], b[j[live], o]
        on = (x > 0) & (y > 0) & (peak - total <= drop)
        live, total, peak, equal, same = live[on], total[on], peak[on], equal[on], (x == y)[on]
        if not len(live):
            break
        total, equal = total + np.where(same, 1, -2).astype(np.int16), equal + same
        up = total > peak
        best[live[up]], matched[live[up]] = o + 1, equal[up]
        peak = np.maximum(peak, total)
    return best, matched


def close(run: int, size: int, drop: int = DROP) -> int:
    """How many of the next ``CLOSE`` words are equal at least, on one side of a seed, where ``reached`` gives ``run`` words with the seed.

    One side then has half of the words outside of the seed. If these are fewer than ``CLOSE``, over two thirds of them are equal; if not, the
    first ``CLOSE`` words have not lost more than ``drop``.
    """
    side = -(-(run - size) // 2)
    return max(0, min(-(-(2 * CLOSE - drop) // 3), -(-(2 * side + 1) // 3))) if side > 0 else 0


def chains(x: list[int], y: list[int], gain: float, gap: float, least: int) -> list[list[int]]:
    """Chains of at least ``least`` matches, as indices; ``x`` rises strictly, and a chain rises in both.

    A match adds ``gain``, and a step costs ``gap`` for every word it moves on in either text. That cost splits into a part of
    the predecessor and a part of the match, so the best predecessor is a prefix maximum over ``y``.
    """
    order = sorted(set(y))
    tree: list[tuple[float, int]] = [(-1e300, -1)] * (len(order) + 1)
    score, before = [0.0] * len(x), [-1] * len(x)
    for i, (a, b) in enumerate(zip(x, y)):
        r = bisect_left(order, b)
        best, j, p = -1e300, -1, r
        while p:
            if tree[p][0] > best:
                best, j = tree[p]
            p &= p - 1
        best -= gap * (a + b)
        score[i] = gain + (best if best > 0 else 0.0)
        before[i] = j if best > 0 else -1
        own, p = (score[i] + gap * (a + b), i), r + 1
        while p < len(tree):
            if tree[p][0] < own[0]:
                tree[p] = own
            p += p & -p
    used, out = [False] * len(x), []
    for i in sorted(range(len(x)), key=score.__getitem__, reverse=True):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if len(chain) >= least:
            out.append(chain[::-1])
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short runs of words."""
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == w)))
    return int(row[-1])


def _extend(a: np.ndarray, b: np.ndarray, drop: int = DROP) -> tuple[int, int]:
    """(words, equal words) by which a match goes on without gaps: equal words count 1, others -2, until ``drop`` is lost."""
    n = min(len(a), len(b))
    equal = a[:n] == b[:n]
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    peak = np.maximum.accumulate(total)
    lost = np.flatnonzero(peak - total > drop)
    best = int(np.argmax(total[:lost[0]] if len(lost) else total))
    return best, int(equal[:best].sum())


def align(x: list[int], y: list[int], a: np.ndarray, b: np.ndarray, size: int, reach: int = REACH) -> tuple[int, int, int, int, int]:
    """(first, end, first, end, equal words) of a chain of matches at ``x`` in ``a`` and ``y`` in ``b``."""
    equal = int((a[x[0]:x[0] + size] == b[y[0]:y[0] + size]).sum())
    for x0, y0, x1, y1 in zip(x, y, x[1:], y[1:]):
        if x1 - x0 == y1 - y0:
            equal += int((a[x0 + size:x1 + size] == b[y0 + size:y1 + size]).sum())
        else:
            # Seeds may overlap in one text and not in the other: what the shorter step adds is aligned with all of the other.
            equal += _common(a[x0 + size:x1 + size], b[y0 + size:y1 + size])
    left, on_left = _extend(a[max(0, x[0] - reach):x[0]][::-1], b[max(0, y[0] - reach):y[0]][::-1])
    right, on_right = _extend(a[x[-1] + size:x[-1] + size + reach], b[y[-1] + size:y[-1] + size + reach])
    return x[0] - left, x[-1] + size + right, y[0] - left, y[-1] + size + right, equal + on_left + on_right


def _chained(matches: DataFrame, gain: float, gap: float, least: int) -> DataFrame:
    """(doc, source, xs, ys) of chains; a task reads its pairs one after the other. Costs count no immediate repeats of a word."""
    ship(matches.sparkSession)
    schema = arrow_schema("doc long, source long, xs array<int>, ys array<int>")

    def run(batches):
        rest = [np.zeros(0, np.int64)] * 4

        def worked(columns):
            doc, source, x, y = columns
            low = (1 << 32) - 1
            x, y, u, v = x >> 32, y >> 32, x & low, y & low
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1])])) if len(doc) else np.zeros(0, int)
            ends = np.append(new[1:], len(doc))
            out = {"doc": [], "source": [], "xs": [], "ys": []}
            for s, e in zip(new.tolist(), ends.tolist()):
                if e - s >= least:
                    xs, ys = x[s:e].tolist(), y[s:e].tolist()
                    for chain in chains(u[s:e].tolist(), v[s:e].tolist(), gain, gap, least):
                        out["doc"].append(int(doc[s]))
                        out["source"].append(int(source[s]))
                        out["xs"].append([xs[i] for i in chain])
                        out["ys"].append([ys[i] for i in chain])
            return pa.RecordBatch.from_pydict(out, schema=schema)

        for batch in batches:
            columns = [np.concatenate([r, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(rest, batch.columns)]
            doc, source = columns[0], columns[1]
            change = np.flatnonzero((doc[1:] != doc[:-1]) | (source[1:] != source[:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0
            rest = [c[cut:] for c in columns]
            if cut:
                yield worked([c[:cut] for c in columns])
        yield worked(rest)

    return matches.mapInArrow(run, "doc long, source long, xs array<int>, ys array<int>")


def _blocks(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """(id, block, words): the wanted blocks (id, blocks) of texts as 32-bit word hashes. At most a text's own blocks are wanted of it."""

    def task(batch):
        out = {"id": [], "block": [], "words": []}
        for first, data, offsets in pieces(batch.column(1), PART):
            found = words(data, offsets, PUNCTUATION)
            begin = np.searchsorted(found.doc, np.arange(len(offsets)))
            for i in range(len(offsets) - 1):
                own = found.hash[begin[i]:begin[i + 1]].astype(np.uint32).view(np.int32)
                for block in batch.column(2)[first + i].as_py():
                    out["id"].append(batch.column(0)[first + i].as_py())
                    out["block"].append(block)
                    out["words"].append(own[block * BLOCK:(block + 1) * BLOCK])
        yield out

    # Of the other texts hardly any is shuffled.
    noted = docs.sparkSession.sparkContext.broadcast(_noted(lists, "id"))

    def hold(batch):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        keep = pa.array(suspected(_hashed(ids), noted.value))
        yield {"id": batch.column(0).filter(keep), "t": batch.column(1).filter(keep)}

    own = map_arrow(docs, hold, "id long, t string")
    return map_arrow(own.join(lists, "id").select("id", "t", "blocks"), task, "id long, block int, words array<int>")


def _paired(matches: DataFrame) -> DataFrame:
    return matches.select("doc", "source", "x", "y").repartition("doc", "source").sortWithinPartitions("doc", "source", "x")


def _passages(texts: DataFrame, chained: DataFrame, size: int, least_words: int, alike: float, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """The result's rows: chains aligned on the words, those that are long and alike enough; and the stored table that they read."""
    def side(owner: str, places: str):
        first = F.greatest(F.element_at(places, 1) - REACH, F.lit(0))
        last = F.element_at(places, -1) + (size + REACH)
        return chained.select("chain", F.lit(owner).alias("side"), F.col(owner).alias("id"), F.explode(F.sequence(
            F.floor(first / BLOCK).cast("int"), F.floor(last / BLOCK).cast("int"))).alias("block"))

    need = side("doc", "xs").union(side("source", "ys"))
    lists = stored(need.select("id", "block").distinct().groupBy("id").agg(F.collect_list("block").alias("blocks")), "wanted")
    block = stored(_blocks(texts, lists).dropDuplicates(["id", "block"]), "blocks")
    released(lists)
    parts = (hot_join(need, block, ["id", "block"], "chain")
             .groupBy("chain").agg(F.collect_list(F.struct("side", "block", "words")).alias("parts")))
    schema = f"{doc_id} long, first int, end int, source_id long, source_first int, source_end int, matched int, likeness double"

    def result(batch):
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        out = {n: [] for n in names}
        for row in batch.to_pylist():
            runs, base = {}, {}
            for name, places in (("doc", row["xs"]), ("source", row["ys"])):
                own = {p["block"]: p["words"] for p in row["parts"] if p["side"] == name}
                base[name] = min(own) * BLOCK
                runs[name] = np.array([w for k in sorted(own) for w in own[k]], np.int64)
            x, y = [v - base["doc"] for v in row["xs"]], [v - base["source"] for v in row["ys"]]
            a0, a1, b0, b1, equal = align(x, y, runs["doc"], runs["source"], size)
            likeness = equal / max(a1 - a0, b1 - b0)
            if min(a1 - a0, b1 - b0) >= least_words and likeness >= alike:
                values = (row["doc"], a0 + base["doc"], a1 + base["doc"], row["source"], b0 + base["source"], b1 + base["source"], equal, likeness)
                for n, v in zip(names, values):
                    out[n].append(v)
        yield out

    return map_arrow(chained.join(parts, "chain").select("doc", "source", "xs", "ys", "parts"), result, schema), block


def _outside(matches: DataFrame, passages: DataFrame, doc_id: str, size: int) -> DataFrame:
    """(doc, x, h): places of seeds that an earlier document holds, in no passage of their own document."""
    own = passages.groupBy(F.col(doc_id).alias("doc")).agg(F.collect_set(F.struct("first", "end")).alias("own"))
    at = F.shiftright("x", 32)
    inside = F.exists("own", lambda p: (p["first"] <= at) & (p["end"] >= at + size))
    return matches.select("doc", "x", "h").join(own, "doc", "left").where(~F.coalesce(inside, F.lit(False))).select("doc", "x", "h")


def _rest(texts: DataFrame, left: DataFrame, size: int, window: int, least_words: int, alike: float, run: int) -> tuple[DataFrame, DataFrame]:
    """Two tables (doc, source, x, y) for the places ``left``: sure passages, and what agrees over ``run`` words at least.

    Every earlier place of the same seed is met. What stands beyond ``REACH`` words of a seed plays no part in its alignment, so
    places with the same words up to there are one: all go to the first of them, once for each block of a document. Of the
    others each that asks is compared with all of earlier documents, up to ``PLACES`` of each in a task, and keeps the first sure one.
    """
    sc = left.sparkSession.sparkContext
    wanted, open_ = sc.broadcast(_noted(left, "h")), sc.broadcast(_noted(left, "doc", "x"))

    def task(batch):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, found, begin, at, step, h in _seeded(batch.column(1), size, window):
            hit = np.flatnonzero(suspected(_hashed(h.view(np.int64)), wanted.value))
            for s in range(0, len(hit), PLACES):
                own = hit[s:s + PLACES]
                words_ = around(found, begin, at[own], size)
                # No passage grows from a seed with fewer words around it.
                own, words_ = (v[(words_ > 0).sum(1) + size >= least_words] for v in (own, words_))
                doc = ids[first + found.doc[at[own]]]
                x = (at[own] - begin[found.doc[at[own]]]) << 32 | step[own]
                c = np.zeros(len(own), np.uint64)
                for k in range(words_.shape[1]):
                    c = mix(c * np.uint64(0x9E3779B97F4A7C15) + words_[:, k])
                yield {"h": pa.array(h[own].view(np.int64)), "c": pa.array(c.view(np.int64)), "doc": pa.array(doc), "x": pa.array(x),
                       "open": pa.array(suspected(_hashed(doc, x), open_.value)), "w": pa.array([w.tobytes() for w in words_], pa.binary())}

    places = stored(map_arrow(texts, task, "h long, c long, doc long, x long, open boolean, w binary"), "places")
    released(left)
    # A head asks if one of its document's places with these words around it is open.
    heads = stored(places.groupBy("h", "c").agg(F.min(F.struct("doc", "x", "w")).alias("m"), F.min(F.when(F.col("open"), F.col("doc"))).alias("asker"))
                   .select("h", "c", "m.*", F.coalesce(F.col("asker") == F.col("m.doc"), F.lit(False)).alias("asks")), "heads")
    first = heads.select("h", "c", F.col("doc").alias("source"), F.col("x").alias("y"))
    block = F.shiftright("x", 32 + BLOCK.bit_length() - 1).alias("block")
    copies = stored(spread_join(places.where("open").select("h", "c", "doc", "x"), first, ["h", "c"], "doc").where("source < doc")
                    .groupBy("doc", block).agg(F.min(F.struct("x", "source", "y")).alias("m")).select("doc", "block", "m.*"), "copies")
    own = stored(places.where("open").select("h", "c", "doc", F.col("x").alias("place")).join(heads.select("h", "c", "doc", "x"), ["h", "c", "doc"])
                 .withColumn("block", F.shiftright("place", 32 + BLOCK.bit_length() - 1))
                 .join(copies.select("doc", "block"), ["doc", "block"], "left_anti").select("h", "doc", "x", "place"), "asked")
    released(places)
    # Seeds with more places than a task takes are at most one in ``PLACES`` places: they go to every task.
    many = (heads.groupBy("h").agg(F.count("*").alias("total"), F.sum(F.col("asks").cast("int")).alias("asked")).where(F.col("total") > PLACES)
            .select("h", F.ceil(F.col("total") / PLACES).cast("int").alias("rows"), F.ceil(F.col("asked") / PLACES).cast("int").alias("cols")))
    dealt = heads.select("h", "doc", "x", "asks", "w").join(F.broadcast(many), "h", "left")
    few = dealt.where("rows is null").select("h", F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("asks"), 2).otherwise(0).alias("kind"), "doc", "x", "w")
    large, turn = dealt.where("cols > 0"), F.xxhash64("doc", "x")
    row, column = F.pmod(turn, F.col("rows")).cast("int"), F.pmod(turn, F.col("cols")).cast("int")
    held = large.select("h", row.alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(0).alias("kind"), "doc", "x", "w")
    asks = large.where("asks").select("h", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), column.alias("j"), F.lit(1).alias("kind"), "doc", "x", "w")
    groups = few.union(held).union(asks).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "doc", "x")
    # What holds for a document's first place with certain words around it holds for its other ones.
    links = stored(_compared(groups, size, least_words, alike, run).join(own.select("doc", "x", "place").distinct(), ["doc", "x"])
                   .select("doc", F.col("place").alias("x"), "source", "y", "before", "sure"), "links")
    sure = links.where("sure").groupBy("doc", "x").agg(F.min(F.struct("source", "y")).alias("m")).select("doc", "m.source", "x", "m.y")
    # Where two documents agree in one run only, that run is no passage: it was measured already.
    begin = F.shiftleft(F.shiftright("x", 32) - F.col("before"), 32) + F.shiftright("y", 32) - F.col("before")
    likely = (links.where("not sure").join(sure.select("doc", "x"), ["doc", "x"], "left_anti")
              .select("doc", "source", "x", "y", begin.alias("begin")))
    several = likely.groupBy("doc", "source").agg(F.min("begin").alias("low"), F.max("begin").alias("high")).where("low <> high")
    likely = likely.join(several.select("doc", "source"), ["doc", "source"]).select("doc", "source", "x", "y")
    released(heads, own)
    return copies.select("doc", "source", "x", "y").union(sure), likely


def _compared(groups: DataFrame, size: int, least_words: int, alike: float, run: int) -> DataFrame:
    """(doc, x, source, y, before, sure) of places that ask (``kind`` 1 or 2) and places of earlier documents (``kind`` 0 or 2) in the same group
    (h, i, j), in order; ``before`` is how many words before the seed agree."""
    schema = "doc long, x long, source long, y long, before int, sure boolean"
    kinds = arrow_schema(schema)
    least = close(run, size)

    def settle(doc, x, before, after, i, j):
        """Of each place that asks the first sure partner, or all that agree over ``run`` words."""
        n, equal = reached(after, after, i, j)
        m, same = reached(before, before, i, j)
        n, equal = n.astype(int) + m + size, equal.astype(int) + same + size
        good = n >= run
        i, j, m, sure = i[good], j[good], m[good].astype(np.int32), (n >= least_words)[good] & (equal >= alike * n)[good]
        done, at = np.unique(i[sure], return_index=True)
        other = ~np.isin(i, done)
        for p, q, k, yes in ((done, j[sure][at], m[sure][at], True), (i[other], j[other], m[other], False)):
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(doc[p]), pa.array(x[p]), pa.array(doc[q]), pa.array(x[q]),
                                                  pa.array(k), pa.array(np.full(len(p), yes))], schema=kinds)

    def compare(edges, kind, doc, x, w):
        """Whole groups, which begin and end at ``edges``."""
        before, after = w[:, :REACH], w[:, REACH:]
        begin, ends = np.repeat(edges[:-1], np.diff(edges)), np.diff(edges)
        # Small groups together, pair by pair: a place that asks with those before it.
        small = np.flatnonzero((kind > 0) & np.repeat(ends <= SMALL, ends))
        upto = np.cumsum(small - begin[small])
        for s in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
            own = small[np.searchsorted(upto, s, "right"):np.searchsorted(upto, s + PAIRS, "right")]
            size_ = own - begin[own]
            i = np.repeat(own, size_)
            j = np.arange(len(i)) - np.repeat(np.cumsum(size_) - size_, size_) + begin[i]
            good = (doc[j] < doc[i]) & (kind[j] != 1)
            i, j = i[good], j[good]
            if least:
                good = np.zeros(len(i), bool)
                for side in (before, after):
                    agree = np.zeros(len(i), np.uint8)
                    for k in range(CLOSE):
                        agree += side[i, k] == side[j, k]
                    good |= agree >= least
                i, j = i[good], j[good]
            yield from settle(doc, x, before, after, i, j)
        for g in np.flatnonzero(ends > SMALL):
            rows = np.arange(edges[g], edges[g + 1])
            a, b = rows[kind[rows] > 0], rows[kind[rows] != 1]
            wide = max(1, PAIRS // max(1, len(b)))
            sides = [np.ascontiguousarray(side[b, :CLOSE].T) for side in (before, after)]
            for s in range(0, len(a), wide):
                own = a[s:s + wide]
                good = np.zeros((len(own), len(b)), bool) if least else np.ones((len(own), len(b)), bool)
                for side, words_ in zip((before, after) if least else (), sides):
                    agree = np.zeros(good.shape, np.uint8)
                    for k in range(CLOSE):
                        agree += side[own, k][:, None] == words_[k]
                    good |= agree >= least
                i, j = np.nonzero(good & (doc[own][:, None] > doc[b]))
                yield from settle(doc, x, before, after, own[i], b[j])

    def rows(batches):
        rest = None
        for batch in batches:
            numbers = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]]
            w = np.frombuffer(b"".join(batch.column(6).to_pylist()), "<u2").reshape(-1, 2 * REACH)
            columns = [*numbers, w]
            if rest is not None:
                columns = [np.concatenate(p) for p in zip(rest, columns)]
            h, i, j = columns[:3]
            edges = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1])
            yield from compare(edges, *[c[:edges[-1]] for c in columns[3:]])
            rest = [c[edges[-1]:] for c in columns]
        if rest is not None:
            yield from compare(np.array([0, len(rest[0])]), *rest[3:])

    ship(groups.sparkSession)
    return groups.mapInArrow(rows, schema)


def shared_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, window: int = 10, gain: float = 5.0,
                    gap: float = 0.1, least_seeds: int = 2, least_words: int = 50, alike: float = 0.8, filter_words: int = FILTER_WORDS) -> DataFrame:
    """(doc_id, first, end, source_id, source_first, source_end, matched, likeness): passages that an earlier document holds too.

    Words are runs of letters, digits and non-ASCII characters, A-Z folded; ``first`` and ``end`` (exclusive) count them. A
    passage has at least ``least_words`` words in both texts (a mere run of one word is none), and ``likeness``, equal words in the alignment over the longer
    side's words, is at least ``alike``. ``source_id`` is the smallest id that holds the passage's seeds, so each group of
    documents that share a passage is a star around its first document; exact copies appear as one whole passage. Seeds in no
    such passage meet every earlier document that holds them (`_rest`), and the first one with a passage around them is taken. Rows without
    an id, and null, empty or short texts, give nothing; rows that share an id are taken for one document; other columns are
    ignored.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).where("id is not null")

    def hashes(batch):
        for *_, h in seeds(batch.column(0), size, window):
            yield h

    shared = docs.sparkSession.sparkContext.broadcast(seen_twice(texts.select("t"), hashes, filter_words))

    def task(batch):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for doc, at, step, h in seeds(batch.column(1), size, window):
            hit = suspected(h, shared.value)
            # Both numbers of a seed's place travel as one long, which sorts by the first.
            yield {"doc": pa.array(ids[doc[hit]]), "x": pa.array(at[hit] << 32 | step[hit]), "h": pa.array(h[hit].view(np.int64))}

    found = stored(map_arrow(texts, task, "doc long, x long, h long"), "seeds")
    shared.unpersist()
    source = (found.groupBy("h").agg(F.min(F.struct("doc", "x")).alias("m"), F.max("doc").alias("last")).where("m.doc <> last")
              .select("h", F.col("m.doc").alias("source"), F.col("m.x").alias("y")))
    matches = stored(spread_join(found, source, ["h"], "doc", salts=2).where("doc <> source").select("doc", "source", "x", "y", "h"), "matches")
    released(found)
    chained = stored(_chained(_paired(matches), gain, gap, least_seeds).withColumn("chain", F.monotonically_increasing_id()), "chains")
    rows, blocks = _passages(texts, chained, size, least_words, alike, doc_id)
    passages = stored(rows, "passages")
    released(chained, blocks)
    left = stored(_outside(matches, passages, doc_id, size), "left")
    released(matches)
    if left.isEmpty():
        return passages
    sure, likely = _rest(texts, left, size, window, least_words, alike, min(RUN, least_words))
    more = _chained(_paired(sure), gain, gap, 1).union(_chained(_paired(likely), gain, gap, least_seeds))
    more = stored(more.withColumn("chain", F.monotonically_increasing_id()), "chains")
    return passages.union(_passages(texts, more, size, least_words, alike, doc_id)[0])
