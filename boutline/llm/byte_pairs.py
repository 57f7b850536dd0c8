"""Byte-pair encoding through a table of distinct words, and decoding through a table of pieces.

1. Each task splits its documents into words and writes them by chunk: the chunk's distinct words once, in parts by their
   hash, and each document as positions among them. The table lies in the shared folder, so both readers below see the same
   chunks, and it is bucketed by chunk.
2. The parts are shuffled by that hash. All of a word's occurrences meet in one task, which encodes it once and sends its ids
   back to the chunks.
3. A join by chunk turns positions into ids; the positions are read from their buckets and not shuffled.

Only distinct words are ever encoded, and neither texts nor positions are shuffled.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from boutline.llm.stored import arrow_schema, bucketed
from boutline.session import ship

#: Text of one chunk in characters, unless one document is longer. Its distinct words are what a join brings together.
CHUNK = 32_000_000


@cache
def pattern() -> str:
    """The published splitting pattern of byte-level vocabularies, a fixed form, over the encoder's own character classes.

    Python's classes follow other Unicode versions than the encoder's, so its letters, numbers and blanks are read off it.
    """
    from tokenizers import Regex, pre_tokenizers

    def ranges(kind: str) -> str:
        split, runs = pre_tokenizers.Split(Regex(kind + "+"), "removed", invert=True), []
        # A few thousand characters at a time: the encoder holds many bytes for each.
        for low in range(0, 0x110000, 0x1000):
            points = [c for c in range(low, low + 0x1000) if not 0xD800 <= c < 0xE000]
            for _, (a, b) in split.pre_tokenize_str("".join(map(chr, points))):
                if runs and points[a] == runs[-1][1] + 1:
                    runs[-1][1] = points[b - 1]
                else:
                    runs.append([points[a], points[b - 1]])
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)

    letter, number, blank = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    return (rf"'(?:[sdmt]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+"
            rf"|[{blank}]+(?![^{blank}])|[{blank}]+")


class Vocabulary:
    """A tokenizer file of the byte-level kind, read on the driver and sent to the tasks as its text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.text = f.read()
        spec = json.loads(self.text)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        before = spec.get("pre_tokenizer") or {}
        self.pattern = pattern()
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level vocabularies without normalizer and prefix space are read")

    def pieces(self) -> list[bytes]:
        """The bytes of each id."""
        spec = json.loads(self.text)
        byte = _byte_of()
        table = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
        out = [b""] * (max(table.values()) + 1)
        for word, i in table.items():
            out[i] = bytes(byte[c] for c in word) if all(c in byte for c in word) else word.encode()
        return out


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as U+0100 and on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def splitter(form: str, special: list[str]):
    """text -> words. Special strings are cut out first and are words of their own."""
    find = re.compile(form).findall
    if not special:
        return find
    cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")

    def split(text: str) -> list[str]:
        if not any(s in text for s in special):
            return find(text)
        return [w for i, part in enumerate(cut.split(text)) for w in ([part] if i % 2 else find(part))]

    return split


def _pack_bytes(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def _unpack_bytes(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.Codec("zstd").decompress(blob[8:], size, asbytes=True) if size else b""


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte planes apart."""
    return _pack_bytes(np.ascontiguousarray(values, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = _unpack_bytes(blob)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


def _pack_words(words: list[str]) -> tuple[bytes, bytes]:
    raw = [w.encode() for w in words]
    return _pack_bytes(b"".join(raw)), _pack(np.array([len(w) for w in raw]))


def _unpack_words(blob: bytes, lengths: bytes) -> list[str]:
    raw, ends = _unpack_bytes(blob), np.cumsum(_unpack(lengths), dtype=np.int64).tolist()
    return [raw[a:b].decode() for a, b in zip([0, *ends], ends)]


_PART = pa.struct([("part", pa.int32()), ("words", pa.binary()), ("lengths", pa.binary()), ("place", pa.binary())])
_CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("places", pa.binary()),
                    ("parts", pa.list_(_PART))])


class _Chunk:
    """Documents as positions in a list of distinct words."""

    def __init__(self):
        self.ids, self.sizes, self.places, self.known, self.held = [], [], [], {}, 0

    def add(self, doc, words: list[str], length: int) -> None:
        known = self.known
        place = known.setdefault
        self.ids.append(doc)
        self.sizes.append(len(words))
        self.places.append(np.array([place(w, len(known)) for w in words], np.uint32))
        self.held += length + 100

    def row(self, parts: int) -> pa.RecordBatch:
        names = list(self.known)
        part = np.array([xxhash.xxh3_64_intdigest(w.encode()) % parts for w in names], np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            words, lengths = _pack_words([names[i] for i in order[a:b]])
            rows.append({"part": int(part[order[a]]), "words": words, "lengths": lengths, "place": _pack(order[a:b])})
        flat = np.concatenate(self.places) if self.places else np.zeros(0, np.uint32)
        return pa.RecordBatch.from_pydict({"chunk": [uuid.uuid4().int >> 65], "ids": [self.ids], "sizes": [_pack(np.array(self.sizes))],
                                           "places": [_pack(flat)], "parts": [rows]}, schema=_CHUNK)


def _chunks(docs: DataFrame, form, special: list[str], limit: int, parts: int) -> DataFrame:
    """A row for each chunk: its documents' ids and numbers of words, word positions, and distinct words in parts by hash."""

    def run(batches):
        split = splitter(form.value, special)
        chunk = _Chunk()
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                chunk.add(doc, split(text), len(text))
                if chunk.held >= limit:
                    yield chunk.row(parts)
                    chunk = _Chunk()
        if chunk.ids:
            yield chunk.row(parts)

    return docs.mapInArrow(run, "chunk long, ids array<long>, sizes binary, places binary, "
                                "parts array<struct<part int, words binary, lengths binary, place binary>>")


def _encoded_words(parts: DataFrame, vocabulary) -> DataFrame:
    """(chunk, place, size, ids): a chunk's words of one part, encoded. A task keeps the ids of the words it has met."""
    schema = pa.schema([("chunk", pa.int64()), ("place", pa.binary()), ("size", pa.binary()), ("ids", pa.binary())])

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_str(vocabulary.value)
        encoder.no_truncation()
        encoder.no_padding()
        codes: dict[str, list[int]] = {}
        for one in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            for row in one.to_pylist():
                words = _unpack_words(row["words"], row["lengths"])
                fresh = [w for w in words if w not in codes]
                codes.update((w, e.ids) for w, e in zip(fresh, encoder.encode_batch(fresh, add_special_tokens=False)))
                own = [codes[w] for w in words]
                yield pa.RecordBatch.from_pydict({"chunk": [row["chunk"]], "place": [row["place"]], "size": [_pack(np.array([len(c) for c in own]))],
                                                  "ids": [_pack(np.array([i for c in own for i in c]))]}, schema=schema)

    return parts.mapInArrow(run, "chunk long, place binary, size binary, ids binary")


def encode(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", limit: int = CHUNK,
           finish=None, schema: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row; null and empty texts have no ids; one result row per input row, repeated ones too.

    Special strings of the vocabulary are their own ids wherever they stand in a text; none is added. Other columns are ignored.
    ``finish`` may turn record batches of that result into others of ``schema`` in the same task.
    """
    ship(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast
    shared = send(vocabulary.text)
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = bucketed(_chunks(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text)), send(vocabulary.pattern), vocabulary.special,
                              limit, parts), "chunk", "chunks")
    words = chunks.select("chunk", F.explode("parts").alias("p")).select("p.part", "chunk", "p.words", "p.lengths", "p.place")
    # As many partitions as the chunks have buckets, and no fewer: a chunk is large, and one task should not hold many.
    back = (_encoded_words(words.repartition("part"), shared).repartition(parts // 4, "chunk")
            .groupBy("chunk").agg(F.collect_list(F.struct("place", "size", "ids")).alias("parts")))
    plain = arrow_schema(f"{doc_id} long, ids array<int>")

    def run(batches):
        # One chunk at a time: several are in a batch, and unpacked they are large.
        for one in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            for row in one.to_pylist():
                parts = [tuple(_unpack(p[k]) for k in ("place", "size", "ids")) for p in row["parts"] or []]
                place, size, flat = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint32) for k in range(3))
                begin = np.zeros(len(place), np.int64)
                length = np.zeros(len(place), np.int64)
                begin[place], length[place] = np.cumsum(size, dtype=np.int64) - size, size
                where, sizes = _unpack(row["places"]), _unpack(row["sizes"])
                ends = np.cumsum(sizes, dtype=np.int64)
                a = 0
                while a < len(sizes):
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 200_000, "right")))
                    own = where[(ends[a - 1] if a else 0):ends[b - 1]]
                    n = length[own]
                    stop = np.cumsum(n)
                    ids = flat[np.repeat(begin[own] - (stop - n), n) + np.arange(n.sum())]
                    cuts = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(sizes[a:b], dtype=np.int64)])]
                    done = pa.RecordBatch.from_arrays([pa.array(row["ids"][a:b], pa.int64()),
                                                       pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))], schema=plain)
                    yield finish(done) if finish else done
                    a = b

    return (chunks.select("chunk", "ids", "sizes", "places").join(back, "chunk", "left").drop("chunk")
            .mapInArrow(run, schema or f"{doc_id} long, ids array<int>"))


def joined_pieces(column: pa.Array, pieces: list[bytes]) -> list[bytes | None]:
    """Each list of ids with its pieces put together; ids that are not in the table give nothing."""
    n = len(pieces)
    out = []
    for row in column:
        if not row.is_valid:
            out.append(None)
            continue
        own = row.values.to_numpy(zero_copy_only=False)
        if len(own) and (own.min() < 0 or own.max() >= n):
            own = own[(own >= 0) & (own < n)]
        out.append(b"".join([pieces[i] for i in own.tolist()]))
    return out


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with column ``text``: each id joined to its piece, bytes put together, broken UTF-8 replaced.

    The table of pieces has one row per id of the vocabulary, a fixed number, so every task holds it: a map-side join. Null ids
    give null; an id that the vocabulary does not have gives nothing.
    """
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.pieces())

    @F.arrow_udf("string")
    def join(column: pa.Array) -> pa.Array:
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in joined_pieces(column, shared.value)], pa.string())

    return encoded.withColumn(text, join(F.col(ids)))


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, encoded and decoded in the task that joins its ids.

    Ids are digested as little-endian unsigned 32-bit integers, decoded texts as UTF-8.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.pieces())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    kinds = arrow_schema(schema)

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(1)
        texts = [b.decode("utf-8", "replace").encode() for b in joined_pieces(ids, shared.value)]
        flat = [r.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() for r in ids]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) // 4 for f in flat], pa.int64()),
                                           pa.array([hashlib.sha256(f).hexdigest() for f in flat]),
                                           pa.array([hashlib.sha256(t).hexdigest() for t in texts])], schema=kinds)

    return encode(docs, vocabulary, finish=finish, schema=schema)
