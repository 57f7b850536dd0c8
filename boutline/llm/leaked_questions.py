"""Benchmark decontamination on templates.

A text becomes a sequence of template words: a number, a name, or a unit after a number turns into a typed placeholder, any
other word stays as it is, in small letters. Windows of template words are joined by hash with the benchmark's, so a question with other
numbers and names still meets its original. Hits of a question in a document are taken by occurrences, so that variants of one
question do not spoil each other. What the placeholders of one stand for must then agree: one value of the question has to
become one value in it throughout.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from boutline.llm.stored import arrow_schema, map_arrow, spread_join, stored
from boutline.llm.text import PUNCTUATION, fold_latin, pieces, windows, words
from boutline.session import ship

#: Units that count as such after a number, folded to lower case.
UNITS = ("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres "
         "kilometer kilometers g kg mg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml litre "
         "litres liter liters gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days "
         "week weeks month months year years percent dollar dollars euro euros cent cents degree degrees mph kmh w kw v a hz").split()
#: Bits of the filter that lets a document's windows through to the join: 8 MB whatever the benchmark's size.
FILTER_BITS = 1 << 26
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1B873593CC9E2D51, 0x38495AB5E6546B64, 0x85EBCA6B52DCE729))
_LITERAL = np.uint64(0x52DCE729D1B54A33)
_DIGIT = np.array([chr(b).isdigit() and b < 0x80 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_POINT = np.isin(np.arange(256), [0x2C, 0x2E])
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?:;\n\"()[]{}|"])


class Template(NamedTuple):
    """Template words: document, hash of the template word, hash of what a placeholder stands for (0 for plain words)."""

    doc: np.ndarray
    word: np.ndarray
    slot: np.ndarray


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.sort(words(data, np.array([0, len(data)]), PUNCTUATION).hash)


def _words(data: np.ndarray, offsets: np.ndarray):
    """Words in small letters; a point or comma between two digits belongs to its number."""
    n = len(data)
    also = None
    if n > 2:
        also = np.zeros(n, bool)
        also[1:-1] = _POINT[data[1:-1]] & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
        cut = offsets[(offsets > 0) & (offsets < n)]
        also[cut] = False
        also[cut - 1] = False
    return words(fold_latin(data), offsets, PUNCTUATION, also=also)


def template(data: np.ndarray, offsets: np.ndarray, units: np.ndarray) -> Template:
    """Numbers are words that begin with a digit (``1,000`` and ``2.5`` are one); units are listed words after a number.

    Names are words with small letters that begin with a capital and do not begin a sentence, and the same words wherever else they stand
    capitalised in the text. Neighbouring names are one name.
    """
    n = len(data)
    found = _words(data, offsets)
    if not len(found.start):
        return Template(*(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64)))
    head = data[found.start]
    number = _DIGIT[head]
    after = np.zeros(len(head), bool)
    after[1:] = number[:-1] & (found.doc[1:] == found.doc[:-1])
    unit = after & np.isin(found.hash, units)
    second = data[np.minimum(found.start + 1, n - 1)]
    capital = _UPPER[head] | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    lower = np.concatenate([[0], np.cumsum(_LOWER[data])])
    capital &= lower[found.stop] > lower[found.start]
    ends = np.concatenate([[0], np.cumsum(_ENDS[data])])
    opens = np.ones(len(head), bool)
    opens[1:] = (found.doc[1:] != found.doc[:-1]) | (ends[found.start[1:]] > ends[found.stop[:-1]])
    own = found.hash ^ (found.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    name = capital & ~opens & ~unit
    name |= capital & opens & np.isin(own, np.unique(own[name]))
    word = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, found.hash)))
    # A number keeps its points and commas in the slot: 2.5 is not 25.
    slot = np.where(number | unit | name, found.hash ^ (found.stop - found.start).astype(np.uint64), np.uint64(0))
    keep = np.ones(len(head), bool)
    keep[1:] = ~(name[1:] & name[:-1] & ~opens[1:])
    return Template(found.doc[keep], word[keep], slot[keep])


def _windowed(rows: DataFrame, size: int, plain: int, bitmap=None) -> DataFrame:
    """(id, pos, h, slots) of template windows with at least ``plain`` plain words; with a bitmap, of those that it has."""
    schema = "id long, pos int, h long, slots array<long>"
    ship(rows.sparkSession)
    units = _unit_hashes()

    def run(batches):
        bits = None if bitmap is None else bitmap.value
        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in pieces(batch.column(1)):
                t = template(data, offsets, units)
                at, h = windows(t.word, t.doc, size)
                if bits is not None and len(at):
                    low = (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)
                    hit = (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
                    at, h = at[hit], h[hit]
                slots = np.stack([t.slot[at + k] for k in range(size)], 1) if len(at) else np.zeros((0, size), np.uint64)
                full = (slots == 0).sum(1) >= plain
                at, h, slots = at[full], h[full], slots[full]
                begin = np.searchsorted(t.doc, np.arange(len(offsets)))
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(first + t.doc[at])), pa.array((at - begin[t.doc[at]]).astype(np.int32)), pa.array(h.view(np.int64)),
                         pa.ListArray.from_arrays(pa.array(np.arange(0, slots.size + 1, size, dtype=np.int32)), pa.array(slots.view(np.int64).reshape(-1)))],
                        schema=arrow_schema(schema))

    return rows.mapInArrow(run, schema)


def _literal(rows: DataFrame, size: int, lengths, bitmap=None) -> DataFrame:
    """(id, pos, h, slots, k) of windows of k literal words, for k in ``lengths``; the slots are empty.

    Without a bitmap a text gives windows of ``size`` words, or if it has fewer, one of all its words. With one, it gives the windows
    that the bitmap has.
    """
    schema = "id long, pos int, h long, slots array<long>, k int"
    ship(rows.sparkSession)

    def run(batches):
        bits = None if bitmap is None else bitmap.value
        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in pieces(batch.column(1)):
                found = _words(data, offsets)
                begin = np.searchsorted(found.doc, np.arange(len(offsets)))
                count = np.diff(np.append(begin, len(found.doc)))
                for k in lengths:
                    at, h = windows(found.hash, found.doc, k)
                    h = h ^ _LITERAL
                    if bits is None:
                        own = count[found.doc[at]]
                        keep = own == k if k < size else own >= size
                    else:
                        low = (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)
                        keep = (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
                    at, h = at[keep], h[keep]
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(first + found.doc[at])), pa.array((at - begin[found.doc[at]]).astype(np.int32)), pa.array(h.view(np.int64)),
                             pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * size + 1, size, dtype=np.int32)), pa.array(np.zeros(len(at) * size, np.int64))),
                             pa.array(np.full(len(at), k, np.int32))], schema=arrow_schema(schema))

    return rows.mapInArrow(run, schema)


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """One bit for each hash, combined by Spark; at most ``bits`` / 8 bytes come to the driver."""
    low = F.col("h").bitwiseAND(F.lit(bits - 1))
    part = min(bits, 1 << 15)
    rows = (hashes.select(F.shiftright(low, part.bit_length() - 1).alias("part"), low.bitwiseAND(F.lit(part - 1)).alias("at"))
            .groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect())
    out = np.zeros(bits // 8, np.uint8)
    for row in rows:
        out[row["part"] * part // 8:(row["part"] + 1) * part // 8] = np.frombuffer(row["bits"], np.uint8)[:part // 8]
    return out


def occurrence(h: np.ndarray, pos: np.ndarray, at: np.ndarray, slots: np.ndarray, given: np.ndarray, n: int, size: int,
               coverage: float, agreement: float) -> tuple[int, int, float, int, int] | None:
    """(windows matched, slots, agreement, first, last) of the best occurrence of a question among its hits; None if none passes.

    An occurrence lies about one difference of the places in document and question, off by the question's length at most: of
    each of the question's windows it takes the hit nearest to that difference.
    """
    reach = int(pos.max()) + size - 1
    shift = at - pos
    order = np.lexsort((pos, shift))
    h, pos, at, shift, slots, given = (v[order] for v in (h, pos, at, shift, slots, given))
    best = None
    for middle in np.unique(shift).tolist():
        a, b = np.searchsorted(shift, [middle - reach, middle + reach + 1])
        near = a + np.argsort(np.abs(shift[a:b] - middle), kind="stable")
        own = near[np.unique(pos[near], return_index=True)[1]]
        matched = len(np.unique(h[own]))
        if matched < n * coverage - 1e-9:
            continue
        # A placeholder counts once for each place in the question and the document, however many windows show it.
        i, k = np.nonzero(slots[own])
        i = own[i]
        places = set(zip((pos[i] + k).tolist(), (at[i] + k).tolist(), slots[i, k].tolist(), given[i, k].tolist()))
        most: dict[int, int] = {}
        for (s, _), count in Counter((s, g) for *_, s, g in places).items():
            most[s] = max(most.get(s, 0), count)
        share = sum(most.values()) / len(places) if places else 1.0
        if share < agreement - 1e-9:
            continue
        if best is None or (matched, share) > (best[0], best[2]):
            best = matched, len(places), share, int(at[own].min()), int(at[own].max()) + size - 1
        if best[0] == n and best[2] == 1:
            break
    return best


def leaked_questions(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
                     size: int = 5, coverage: float = 0.8, agreement: float = 0.8, plain: int = 2, bits: int = FILTER_BITS,
                     shortest: int = 4) -> DataFrame:
    """(doc_id, item_id, n_windows, matched, coverage, n_slots, agreement, first, last) for each document that holds a question.

    A pair is given if one occurrence in the document holds at least ``coverage`` of the question's distinct template windows
    (``size`` template words with at least ``plain`` plain ones among them), and at least ``agreement`` of the placeholders in
    these windows stand for the value that the question's value most often becomes in that occurrence. The figures are those of
    the best occurrence; ``first`` and ``last`` are template word numbers.

    A question without such a window, because it is short or mostly numbers and names, is looked for word for word, numbers and names
    included: windows of ``size`` literal words, or all its words at once if it has fewer; ``first`` and ``last`` are then literal word
    numbers and there are no slots. Only questions of fewer than ``shortest`` words are never found: they stand everywhere. Rows with a
    null id or null or empty text give nothing; rows that share an id count as one text; other columns are ignored.
    """
    spark = docs.sparkSession
    items, texts = (df.select(F.col(c).cast("long").alias("id"), F.col(text)).where("id is not null") for df, c in ((benchmark, item_id), (docs, doc_id)))
    shapes = stored(_windowed(items, size, plain), "shapes")
    bare = items.join(shapes.select("id").distinct(), "id", "left_anti")
    word_for_word = stored(_literal(bare, size, range(min(shortest, size), size + 1)), "literal")
    lengths = [r.k for r in word_for_word.select("k").distinct().collect()]  # at most ``size`` numbers
    asked = shapes.unionByName(word_for_word.drop("k"))
    shared = spark.sparkContext.broadcast(_bitmap(asked, bits))
    met = _windowed(texts, size, plain, shared)
    if lengths:
        met = met.unionByName(_literal(texts, size, lengths, shared).drop("k"))
    hits = stored(met.withColumnsRenamed({"id": "doc", "pos": "at", "slots": "given"}), "hits")
    once = asked.select("id", "h").distinct().withColumn("items", F.count("*").over(Window.partitionBy("h")))
    place = Window.partitionBy("id")
    # A pair with that coverage shares one of the question's rarest windows: only those look for candidates, so a phrase that
    # many questions and many documents have in common does not pair them all.
    ranked = once.withColumns({"n": F.count("*").over(place), "rank": F.row_number().over(place.orderBy("items", "h"))})
    probe = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * coverage - 1e-9) + 1).select("h", "id")
    pairs = spread_join(hits.select("doc", "h").distinct(), probe, ["h"], "doc").select("doc", "id").distinct()
    whole = ranked.select("id", "h", "n")
    # What one occurrence has to hold, the document holds.
    met = (spread_join(pairs, whole, ["id"], "doc").join(hits.select("doc", "h").distinct(), ["doc", "h"]).groupBy("doc", "id")
           .agg(F.first("n").alias("n"), F.count("*").alias("matched")).where(F.col("matched") >= F.col("n") * coverage - 1e-9))
    met = stored(met.drop("matched"), "met")
    held = (spread_join(met, asked, ["id"], "doc").join(hits, ["doc", "h"]).groupBy("doc", "id")
            .agg(F.first("n").alias("n"), F.collect_list("h").alias("h"), F.collect_list("pos").alias("pos"), F.collect_list("at").alias("at"),
                 F.flatten(F.collect_list("slots")).alias("slots"), F.flatten(F.collect_list("given")).alias("given")))
    schema = f"{doc_id} long, {item_id} long, n_windows long, matched long, coverage double, n_slots long, agreement double, first int, last int"

    def task(batch):
        out = {c.strip().split(" ")[0]: [] for c in schema.split(",")}
        for i in range(batch.num_rows):
            doc, item, n = (batch.column(c)[i].as_py() for c in range(3))
            h, pos, at, slots, given = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(3, 8))
            found = occurrence(h, pos.astype(np.int64), at.astype(np.int64), slots.reshape(-1, size), given.reshape(-1, size), n, size, coverage, agreement)
            if found:
                matched, places, share, first, last = found
                for c, v in zip(out, (doc, item, n, matched, matched / n, places, share, first, last)):
                    out[c].append(v)
        yield out

    return map_arrow(held.select("doc", "id", "n", "h", "pos", "at", "slots", "given"), task, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **limits) -> DataFrame:
    """``docs`` without those that hold a question; a row without an id stays."""
    found = leaked_questions(docs, benchmark, doc_id, **limits).select(F.col(doc_id).alias("__doc")).distinct()
    return docs.join(found, F.col(doc_id).cast("long") == F.col("__doc"), "left_anti")
