"""Null tokens, safe casts, text keys."""

import unicodedata

from pyspark.sql import Column, functions as F

# Texts that mean "missing", and texts that mean "yes".
NULL_TOKENS = ["", "NA", "N/A", "NULL", "-"]
TRUE_TOKENS = ["TRUE", "1", "YES"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(c) -> Column:
    t = F.trim(_c(c))
    return F.when(~F.upper(t).isin(NULL_TOKENS), t)


def as_float(c) -> Column:
    return clean(c).try_cast("double")


def as_int(c) -> Column:
    """Whole part of a number text."""
    return as_float(c).try_cast("long")


def as_bool_int(c) -> Column:
    t = clean(c)
    return F.when(t.isNotNull(), F.upper(t).isin(TRUE_TOKENS).cast("int"))


def finite(c) -> Column:
    """NaN and infinities become NULL."""
    c = _c(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def safe_div(n, d, default: float | None = None) -> Column:
    q = F.try_divide(_c(n), _c(d))
    return q if default is None else F.coalesce(q, F.lit(default))


def split_pair(c) -> tuple[Column, Column]:
    """Both numbers of a ``made-attempted`` text; NULL without a dash."""
    t = clean(c)
    parts = F.split(t, "-", 2)
    ok = t.contains("-")
    return (F.when(ok, as_int(F.try_element_at(parts, F.lit(1)))),
            F.when(ok, as_int(F.try_element_at(parts, F.lit(2)))))


def _accents() -> tuple[str, str]:
    """Every letter whose compatibility decomposition starts with one ASCII letter, and that letter."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1 and plain.isalpha():
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def norm_key(c) -> Column:
    """Accent-free lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.translate(_c(c), ACCENTED, PLAIN)), "[^a-z0-9]", "")


def norm_words(c) -> Column:
    """Lower-case words of letters and digits, single-spaced."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", " "))


