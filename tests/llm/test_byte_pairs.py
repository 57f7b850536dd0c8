import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from odd import ROWS, SCHEMA, frame, plain
from tokenizers import Tokenizer

from boutline.llm import byte_pairs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return byte_pairs.Vocabulary(PATH)


def brute(rows):
    t = Tokenizer.from_file(PATH)
    out = []
    for d, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return plain(out)


SPECIAL = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>  y  ", "it's'll we'RE 'tis ''s", "12,345.67  \n\n  z", "<|endoftext|", "\x00\x01\x85​"]


def test_odd_rows(spark, vocabulary):
    rows = ROWS + [(300 + i, t, None, None, None, None, None, None) for i, t in enumerate(SPECIAL)]
    assert plain(byte_pairs.digests(frame(spark, rows), vocabulary).collect()) == brute(rows)


def test_small_chunks(spark, vocabulary):
    got = byte_pairs.encode(frame(spark), vocabulary, limit=500)
    whole = byte_pairs.encode(frame(spark), vocabulary)
    assert plain(got.collect()) == plain(whole.collect())


def test_empty(spark, vocabulary):
    assert byte_pairs.digests(spark.createDataFrame([], SCHEMA), vocabulary).collect() == []


def test_split_like_the_library(vocabulary):
    rng = random.Random(3)
    split, t = byte_pairs.splitter(vocabulary.pattern, vocabulary.special), Tokenizer.from_file(PATH)
    alphabet = "aZé1٣漢 \t\n 　'sdmt.,!𐐀½" + "".join(chr(rng.randrange(0x20, 0xD000)) for _ in range(200))
    for _ in range(800):
        text = "".join(rng.choices(alphabet, k=rng.randrange(40)))
        assert split(text) == [text[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(text)]


def test_decode_broken_ids(spark, vocabulary):
    t = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    rows = [(i, [rng.randrange(50257) for _ in range(rng.randrange(12))]) for i in range(50)] + [(99, None), (98, [])]
    got = {r.i: r.text for r in byte_pairs.decode(spark.createDataFrame(rows, "i int, ids array<int>"), vocabulary).collect()}
    assert got[99] is None and got[98] == ""
    for i, ids in rows[:50]:
        assert got[i] == t.decode(ids, skip_special_tokens=False)
