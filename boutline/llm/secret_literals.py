"""Secret scans by assignment-aware lexing.

Three fixed patterns give the base spans. Beside them a lexer reads source and configuration syntax into names and literals (pairs on a
line, strings over several lines, values indented below their key, private keys between their marks), carries constants from name to name
and through concatenation, and scores each literal by the name it ends up in. Its time grows with a text's length, whatever the text is.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from boutline.llm.stored import map_arrow

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_HINT = ("password", "passwd", "secret", "token", "api")

#: How much a part of a name says that its literal is secret; parts of a name add up.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "pass": 2, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3,
             "credentials": 3, "auth": 2, "bearer": 2, "private": 2, "access": 1, "api": 1, "key": 1, "signing": 1, "signature": 1,
             "client": 1, "encryption": 1, "master": 1, "session": 1, "salt": 2, "dsn": 2, "cookie": 1, "pin": 1}
#: Literals that stand for a secret still to be filled in.
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|-+|changeme|change_me|example|placeholder|none|null|true|false|todo|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|\$[A-Za-z_]\w*)$")

# Names and quoted strings are taken whole or not at all, and a name is tried at its beginning only, so that reading a text of any shape
# takes time in proportion to its length.
_NAME = r"[A-Za-z_$][\w$.-]*+"
_START = r"(?<![\w$.-])(?:(?![A-Za-z_$])[\w$.-])*+"
_QUOTED = r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\\n]++|\\.)*+`"
_TERM = rf"(?:{_QUOTED}|{_NAME})"
_PAIR = re.compile(rf"{_START}(?P<name>{_NAME})[\"']?\]?[ \t]*(?:\:[ \t]*[A-Za-z_][\w.<>\[\]]*+[ \t]*+=|\:=|=>|=|\:)(?![=:/])[ \t]*(?P<value>{_TERM}(?:[ \t]*[+.][ \t]*{_TERM})*|[^\s\"'`,;(){{}}\[\]<>]+)")
_MARKUP = re.compile(rf"<(?P<name>{_NAME})>(?P<value>[^<>\s][^<>\n]*)</(?P=name)>")
#: A string over several lines, a value that stands indented below its key, and a private key between its marks.
_LONG = re.compile(rf"{_START}(?P<name>{_NAME})[\"']?\]?[ \t]*+(?:\:\=|=|\:)[ \t]*+(?P<mark>\"\"\"|''')(?P<value>(?:(?!(?P=mark))[\s\S])*+)(?P=mark)")
_BELOW = re.compile(rf"^(?P<indent>[ ]*+)(?:-[ ]++)?[\"']?(?P<name>{_NAME})[\"']?[ ]*+:[ ]*+(?:[|>][-+0-9]*+)?[ ]*+$", re.MULTILINE)
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?P<value>[A-Za-z0-9+/=\s]*+)-----END ")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PIECE = re.compile(rf"{_QUOTED}|{_NAME}")
_LITERAL = re.compile(r"[A-Za-z0-9+/_.=~!@#$%^&*:-]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind in the order assign, access, hex."""
    out = []
    folded = text.lower()
    if any(h in folded for h in _HINT):
        out += [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return _ordered(out)


def _ordered(spans: list[Span]) -> list[Span]:
    kinds = ("assign", "access", "hex", "literal")
    return sorted(set(spans), key=lambda s: (s.start, kinds.index(s.kind), s.end))


def name_weight(name: str) -> int:
    """Sum of the weights of a name's parts; its last dotted or dashed component counts, camel case is split."""
    last = name.rsplit(".", 1)[-1]
    return _weight(last) if len(last) <= 200 else _weight.__wrapped__(last)


@lru_cache(1 << 14)
def _weight(name: str) -> int:
    parts = [p.lower() for p in _PART.findall(name)]
    joined = "".join(parts)
    return max(sum(SENSITIVE.get(p, 0) for p in set(parts)), SENSITIVE.get(joined, 0))


def entropy(literal: str) -> float:
    """Bits per character."""
    n = len(literal)
    return -sum(c / n * math.log2(c / n) for c in Counter(literal).values()) if n else 0.0


class Value(NamedTuple):
    """What is known of a value without its text: length, its first ``HEAD`` characters, and how often each ASCII character occurs.

    ``counts`` is None where a character occurs that literals of secrets do not have. Counts of very long values are scaled together.
    """

    length: int
    head: str
    counts: np.ndarray | None


HEAD = 64
#: The most that a value adds to its name's weight.
RANDOM = 2.0
_LONGEST = 1 << 40


def value_of(literal: str) -> Value:
    return _value(literal) if len(literal) <= HEAD else _value.__wrapped__(literal)


@lru_cache(1 << 12)
def _value(literal: str) -> Value:
    if not literal:
        return Value(0, "", np.zeros(128, np.float32))
    if not _LITERAL.fullmatch(literal):
        return Value(len(literal), literal[:HEAD], None)
    return Value(len(literal), literal[:HEAD], np.bincount(np.frombuffer(literal.encode("ascii"), np.uint8), minlength=128).astype(np.float32))


def concatenated(a: Value, b: Value) -> Value:
    if not a.length or not b.length:
        return a if a.length else b
    counts = None if a.counts is None or b.counts is None else a.counts + b.counts
    if counts is not None and a.length + b.length >= _LONGEST and counts.max() > 1e20:
        counts = counts / np.float32(1e10)
    return Value(min(a.length + b.length, _LONGEST), (a.head + b.head)[:HEAD], counts)


def _placeholder(value: Value) -> bool:
    """Whether the whole value stands for a secret still to be filled in."""
    if value.length <= HEAD:
        return bool(PLACEHOLDER.match(value.head))
    chars = {chr(c).lower() for c in np.flatnonzero(value.counts)}
    variable = re.match(r"\$[A-Za-z_]", value.head) and all(c == "$" or c == "_" or c.isalnum() for c in chars)
    return len(chars) == 1 and bool(chars & set("x*.-")) or bool(re.match("(?i)your[_-]", value.head)) or bool(variable)


def value_score(name: str, value: Value) -> float:
    """The name's weight, and up to ``RANDOM`` more for what looks drawn at random; 0 for placeholders and values too short."""
    weight = name_weight(name)
    if not weight or value.length < 6 or value.counts is None or _placeholder(value):
        return 0.0
    share = value.counts[value.counts > 0].astype(float)
    share /= share.sum()
    return weight + min(RANDOM, -float((share * np.log2(share)).sum()) * min(value.length, 16) / 32)


class Constant(NamedTuple):
    """Places of the literals that a name was given itself, the constants it took over, and its number in the text."""

    literals: list[tuple[int, int]]
    sources: list
    number: int


def _given(constant: Constant, taken: set[int]) -> list[tuple[int, int]]:
    """Literals that reach a constant by way of others, but for those already taken; every constant is walked to once in a text."""
    literals, left = [], [constant]
    while left:
        c = left.pop()
        if c.number not in taken:
            taken.add(c.number)
            literals += c.literals
            left += c.sources
    return literals


def _lines(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Places of the lines between two places, without the blanks around them and without empty ones."""
    out = []
    for line in text[begin:end].split("\n"):
        bare = line.strip()
        if bare:
            at = begin + line.index(bare)
            out.append((at, at + len(bare)))
        begin += len(line) + 1
    return out


def _below(text: str) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """(place, name, literals) of keys whose value stands on the lines below, indented further; lines that are pairs themselves are none.

    Keys over keys do not read each other's lines: what begins with another key ends the value.
    """
    out = []
    for m in _BELOW.finditer(text):
        at, found = m.end() + 1, []
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            line = text[at:end]
            bare = line.strip()
            if not bare or len(line) - len(line.lstrip(" ")) <= len(m["indent"]) or " " in bare or not _LITERAL.fullmatch(bare.strip("\"'")) \
                    or bare.endswith(":") or _PAIR.match(bare):
                break
            inner = bare.strip("\"'")
            begin = at + line.index(inner)
            found.append((begin, begin + len(inner)))
            at = end + 1
        if found:
            out.append((m.start("name"), m["name"], found))
    return out


def _assignments(text: str) -> list[tuple[int, str, int, str | list[tuple[int, int]]]]:
    """(place, name, where the value begins, its source text or the places of its lines), in text order.

    Strings over several lines are read first; nothing inside of them is an assignment.
    """
    out, inside = [], []
    if "\"\"\"" in text or "'''" in text:
        for m in _LONG.finditer(text):
            inside.append((m.start("value"), m.end("value")))
            out.append((m.start("name"), m["name"], m.start("value"), _lines(text, *inside[-1])))
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), "private_key_secret", m.start("value"), _lines(text, m.start("value"), m.end("value"))) for m in _PEM.finditer(text)]
    if ":" in text:
        out += [(at, name, places[0][0], places) for at, name, places in _below(text)]
    begins = [a for a, _ in inside]
    at = 0
    for line in text.split("\n"):
        pairs = list(_PAIR.finditer(line)) if "=" in line or ":" in line else []
        pairs += _MARKUP.finditer(line) if "</" in line else []
        for m in pairs:
            start = at + m.start("name")
            k = bisect_right(begins, start) - 1
            if k < 0 or start >= inside[k][1]:
                out.append((start, m["name"], at + m.start("value"), m["value"]))
        at += len(line) + 1
    return sorted(out, key=lambda a: a[0])


def literal_spans(text: str, least: float = 4.0) -> list[Span]:
    """Literals whose name, or a name that a constant is handed on to, makes them likely secrets.

    A concatenation is scored as a whole, by what is known of its parts' values; texts are never joined, and a literal is given once.
    """
    known: dict[str, tuple[Constant, Value]] = {}
    taken: set[int] = set()
    out = []
    for number, (_, name, begin, value) in enumerate(_assignments(text)):
        literals, sources, whole = [], [], value_of("")
        if isinstance(value, list):
            literals = value
            whole = value_of("".join(text[a:b] for a, b in value))
        else:
            terms = list(_PIECE.finditer(value))
            if value in known or any(t[0][0] in "\"'`" for t in terms) or " + " in value and all(t[0] in known for t in terms):
                for t in terms:
                    if t[0][0] in "\"'`":
                        literals.append((begin + t.start() + 1, begin + t.end() - 1))
                        whole = concatenated(whole, value_of(t[0][1:-1]))
                    elif t[0] in known:
                        sources.append(known[t[0]][0])
                        whole = concatenated(whole, known[t[0]][1])
            else:
                literals, whole = [(begin, begin + len(value))], value_of(value)
        own = Constant(literals, sources, number)
        known[name] = own, whole
        if name_weight(name) + RANDOM >= least and value_score(name, whole) >= least:
            out += [Span("literal", a, b) for a, b in _given(own, taken) if b > a]
    return _ordered(out)


def secret_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): a literal inside a base span adds nothing and is left out."""
    base = base_spans(text)
    if not any(mark in text for mark in ("=", ":", "</", "PRIVATE KEY-----")):
        return base, base
    starts, reach = [b.start for b in base], list(accumulate((b.end for b in base), max))

    def covered(s: Span) -> bool:
        k = bisect_right(starts, s.start)
        return k > 0 and reach[k - 1] >= s.end

    return base, _ordered(base + [s for s in literal_spans(text) if not covered(s)])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans) of every row.

    Spans are kind:start:end in code points, the end exclusive, by start. Null and empty texts have none. Repeated rows give
    repeated results; other columns are ignored.
    """

    def task(batch):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans")}
        for value in batch.column(1):
            base, every = secret_spans(value.as_py() or "")
            kinds = Counter(s.kind for s in every)
            for k in ("assign", "access", "hex", "literal"):
                out[f"n_{k}"].append(kinds[k])
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(every))
        yield out | {doc_id: batch.column(0)}

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text)), task,
                     f"{doc_id} long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string")
