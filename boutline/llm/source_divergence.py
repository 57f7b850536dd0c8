"""How far the sources of a language differ in their words: exact term counts, and chi-square-like distances from them.

Counting is length-bucketed: a task packs terms of up to 8 and of up to 16 bytes into one and two 64-bit words, sorts these by
radix and counts runs; longer terms are sorted as bytes in buckets of one width each. What leaves a task is a row per (source,
term) of a piece of text, which Spark adds up before and after the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from boutline.llm.stored import arrow_schema, map_arrow, spread_join, stored
from boutline.llm.text import pieces
from boutline.session import ship

#: A term needs so many documents of its language.
LEAST_DOCS = 3
#: Terms reported for a source.
MOST_TERMS = 200
#: Shares are counted in units of one in so many.
UNIT = 1_000_000_000
#: Cells of one table of shares held by a task (sources x terms), 32 MB.
CELLS = 1 << 22
#: Bytes of the widest bucket that is an array; what is longer is sorted as single strings.
WIDEST = 256

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of the maximal runs of letters and non-ASCII bytes within documents."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero((inside[1:] == 1) & ((inside[:-1] == 0) | edge))
    stop = np.flatnonzero((inside[:-1] == 1) & ((inside[1:] == 0) | edge))
    return start, stop - start, np.searchsorted(offsets, start, "right") - 1


def radix_order(words: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """``order`` sorted, stably, by the 64-bit ``words``, the first the most significant: 16 bits at a time from the last."""
    for word in reversed(words):
        for digit in word.view(np.uint16).reshape(-1, 4).T if len(word) else ():
            if digit.min() != digit.max():
                # numpy sorts 16-bit numbers stably by radix
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _pack(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to eight bytes from ``start`` as one number, the first byte the highest; ``data`` goes on for eight bytes."""
    word = np.zeros(len(start), np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | np.where(k < length, data[start + k], 0).astype(np.uint64)
    return word


def _buckets(data: np.ndarray, start: np.ndarray, length: np.ndarray, order: np.ndarray):
    """For every bucket (indices in the order of their terms, whether each is another term than the one before)."""
    for least, most in ((0, 8), (8, 16)):
        own = order[(length[order] > least) & (length[order] <= most)]
        if len(own):
            at, n = start[own], length[own]
            words = [_pack(data, at, n)] + ([_pack(data, at + 8, n - 8)] if most > 8 else [])
            by = radix_order(words, np.arange(len(own)))
            new = np.ones(len(own), bool)
            new[1:] = np.logical_or.reduce([w[by][1:] != w[by][:-1] for w in words])
            yield own[by], new
    most = 16
    while most < WIDEST:
        least, most = most, 2 * most
        own = order[(length[order] > least) & (length[order] <= most)]
        if len(own):
            place = np.arange(most)
            wide = np.where(place < length[own, None], data[np.minimum(start[own, None] + place, len(data) - 1)], 0).astype(np.uint8)
            keys = np.ascontiguousarray(wide).view(f"S{most}").reshape(-1)
            by = np.argsort(keys, kind="stable")
            new = np.ones(len(own), bool)
            new[1:] = keys[by][1:] != keys[by][:-1]
            yield own[by], new
    own = order[length[order] > WIDEST]
    if len(own):
        keys = [data[start[i]:start[i] + length[i]].tobytes() for i in own.tolist()]
        by = sorted(range(len(own)), key=keys.__getitem__)
        yield own[by], np.array([True] + [keys[a] != keys[b] for a, b in zip(by, by[1:])])


def count_terms(column: pa.Array, group: np.ndarray):
    """(group, term, occurrences, documents) arrays for pieces of a text column; ``group`` is a number of each text."""
    for first, data, offsets in pieces(column):
        own = group[first:first + len(offsets) - 1]
        data = np.concatenate([_FOLD[data], np.zeros(16, np.uint8)])
        start, length, doc = terms(data[:-16], offsets)
        # Documents of one group stand together; the stable sorts by term keep them so.
        rank = np.empty(len(own), np.uint64)
        rank[np.argsort(own, kind="stable")] = np.arange(len(own), dtype=np.uint64)
        order = radix_order([rank[doc]], np.arange(len(start)))
        for at, new in _buckets(data, start, length, order):
            docs, groups = doc[at], own[doc[at]]
            other_doc, other_group = new.copy(), new.copy()
            other_doc[1:] |= docs[1:] != docs[:-1]
            other_group[1:] |= groups[1:] != groups[:-1]
            runs = np.flatnonzero(other_group)
            n = length[at[runs]]
            ends = np.cumsum(n)
            letters = data[np.repeat(start[at[runs]] - (ends - n), n) + np.arange(n.sum())]
            text = pa.StringArray.from_buffers(len(runs), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes()))
            yield groups[runs], text, np.diff(np.append(runs, len(at))), np.add.reduceat(other_doc.astype(np.int64), runs)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term; null text, lang and source are empty."""

    def task(batch):
        lang, source = (batch.column(c).dictionary_encode() for c in (0, 1))
        group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
        for own, term, n, found in count_terms(batch.column(2), group):
            yield {"lang": lang.dictionary.take(pa.array(own // len(source.dictionary))),
                   "source": source.dictionary.take(pa.array(own % len(source.dictionary))), "term": term, "n": n, "docs": found}

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = map_arrow(rows, task, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str):
    """1 + floor(UNIT * (n + 1) / (total + kept)), exact for any count."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(20, 0))) div CAST({total} + {kept} AS DECIMAL(20, 0))")


def shares(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``share`` of numpy counts over ``size``, by long division with three digits a step: nothing exceeds 64 bits up to 9 * 10^15."""
    out, rest = np.zeros(np.broadcast(n, size).shape, np.int64), n + 1
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // size, rest % size
    return out + 1


class Corpus:
    """Counted terms of a table: ``groups`` (lang, source, place, total, kept) and ``terms`` (lang, source, place, term, n, total, kept,
    lang_n, lang_total).

    ``place`` numbers a language's sources, ``total`` counts a source's kept occurrences, ``kept`` its language's kept terms.
    """

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCS):
        counts = stored(term_counts(docs), "term-counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
        rows = stored(counts.drop("docs").join(kept, ["lang", "term"]), "kept-terms")
        words = rows.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
        seen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        zero = {"total": 0, "kept": 0, "lang_total": 0}
        self.groups = stored(seen.join(sizes, ["lang", "source"], "left").join(words, "lang", "left").fillna(zero)
                             .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")
        self.terms = spread_join(rows, self.groups, ["lang", "source"], "term")


def _pair_sums(corpus: Corpus, cells: int) -> DataFrame:
    """(lang, a, b, value) for places a and b: distances summed over the language's kept terms, for part of the terms at a time."""
    spark = corpus.groups.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "lang string, a int, b int, value long"
    kinds = arrow_schema(schema)
    # Every part of a language's terms comes behind the language's sources.
    sources = corpus.groups.where("kept > 0").select("lang", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit("").alias("term"),
                                                     "place", F.lit(-1).cast("long").alias("n"), (F.col("total") + F.col("kept")).alias("size"))
    found = corpus.terms.select("lang", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), "term", "place", "n",
                                F.lit(0).cast("long").alias("size"))
    rows = sources.unionByName(found).repartition("lang", "part").sortWithinPartitions("lang", "part", "term", "place")

    def run(batches):
        lang, size, sums, held, last = None, None, None, [], None

        def settle():
            """Distances over the terms held: a table of all sources' shares, in which only some sources have a term."""
            nonlocal held
            place, number, n = (np.concatenate(c) for c in zip(*held))
            held = []
            _, term = np.unique(number, return_inverse=True)
            step = max(1, cells // len(size))
            by = np.argsort(term, kind="stable")
            place, term, n = place[by], term[by], n[by]
            none = shares(np.zeros(len(size), np.int64), size)
            for low in range(0, int(term[-1]) + 1, step):
                i, j = np.searchsorted(term, [low, low + step])
                width = min(step, int(term[-1]) + 1 - low)
                table = np.repeat(none[:, None], width, 1)
                table[place[i:j], term[i:j] - low] = shares(n[i:j], size[place[i:j]])
                for a in range(len(size)):
                    apart = table[a] - table
                    yield a, (apart * apart // table).sum(1)

        def emit(a, values):
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(np.full(len(values), a, np.int32)),
                                               pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], schema=kinds)

        def close(done):
            """Adds what is held to the sums; tables too large to hold are passed on at once."""
            if held:
                for a, values in settle():
                    if sums is None:
                        yield emit(a, values)
                    else:
                        sums[a] += values
            if done and sums is not None:
                for a in range(len(sums)):
                    yield emit(a, sums[a])

        count, number = 0, 0
        for batch in batches:
            for own in batch.column(0).unique().to_pylist():
                part = batch.filter(pc.equal(batch.column(0), own))
                if own != lang:
                    if lang is not None:
                        yield from close(True)
                    lang, size, sums, count = own, None, None, 0
                place, n, total = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4, 5))
                if size is None:
                    size = np.zeros(0, np.int64)
                given = n < 0
                if given.any():
                    # The sources stand before the terms of each part, in order; a batch may hold them in pieces.
                    if len(size) <= int(place[given].max()):
                        size = np.concatenate([size, np.zeros(int(place[given].max()) + 1 - len(size), np.int64)])
                    size[place[given]] = total[given]
                if (~given).any():
                    words = part.column(2).filter(pa.array(~given)).dictionary_encode()
                    names, ids = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
                    if names[0] == last:
                        number -= 1
                    if sums is None and len(size) ** 2 <= cells:
                        sums = np.zeros((len(size), len(size)), np.int64)
                    held.append((place[~given], ids + number, n[~given]))
                    number, last = number + len(names), names[-1]
                    count += len(ids)
                    if count > cells:
                        # The last term may go on in the next batch.
                        p, t, c = held.pop()
                        rest = t == t[-1]
                        held += [(p[~rest], t[~rest], c[~rest])] if not rest.all() else []
                        yield from close(False)
                        held.append((p[rest], t[rest], c[rest]))
                        count = int(rest.sum())
        if lang is not None:
            yield from close(True)

    return rows.mapInArrow(run, schema).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, most: int = MOST_TERMS, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): the sources of a language by their distance, and a source's ``most`` telling terms.

    ``docs`` has text, lang and source; nulls are empty strings and a group like any other; further columns are ignored, repeated
    rows count as rows. A term is kept if ``least`` documents of its language hold it. Distance is sum((p - q)^2 / q) over all kept
    terms, with shares p of the source and q of the other (part ``pair``: every other source of the language) or of the language
    (part ``term``: terms that the source has, and more often than its language). A language without a kept term has distances of
    0. Ranks go down by value, then up by the item's bytes. An empty table gives an empty result. A task holds tables of at most
    ``cells`` shares.
    """
    corpus = Corpus(docs, least)
    a = corpus.groups.select("lang", "source", F.col("place").alias("a"))
    b = corpus.groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"))
    # One row for every two sources of a language is what is asked for.
    pairs = a.join(b, "lang").where("a <> b").join(_pair_sums(corpus, cells), ["lang", "a", "b"], "left")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")).withColumn("rank", rank)
    told = corpus.terms.where("n > 0").withColumns({"p": share("n", "total", "kept"), "q": share("lang_n", "lang_total", "kept")}).where("p > q")
    term = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    # Each task keeps the first ranks of a source before they meet.
    return pair.unionByName(term.withColumn("rank", rank).where(F.col("rank") <= most))
