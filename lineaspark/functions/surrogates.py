"""JSON text whose strings have half of a surrogate pair: legal JSON, but no character that a column of strings can hold.

A JSON parser that makes UTF-8 of such a text turns each half to one and the
same character, so texts that differ get one digest.  :func:`guarded` therefore
rewrites halves before the text is parsed, and its other functions
read what comes out of it.  A mark, a code point that is no character, goes before a
letter: ``s`` and four digits stand for a half, ``e`` for the mark itself, so
no text is taken for another.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MARK = "\ufdd0"
#: An escape's backslash comes after an even number of others.
_EVEN = r"(?<!\\)((?:\\\\)*+)"
_PAIR = _EVEN + r"\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})"
_HALF = _EVEN + r"\\u([dD][89a-fA-F][0-9a-fA-F]{2})"
_ODD = rf"\\u[dD][89a-fA-F]|\\u[fF][dD][dD]0|{MARK}"


def guarded(raw: Column) -> Column:
    """JSON text with its halves, and any marks that it has itself, written as the module says; most text is left as it is."""
    t = F.regexp_replace(F.regexp_replace(raw, MARK, f"{MARK}e"), _EVEN + r"\\u[fF][dD][dD]0", f"$1{MARK}e")
    t = F.regexp_replace(F.regexp_replace(t, _PAIR, f"$1{MARK}p$2$3"), _HALF, f"$1{MARK}s$2")
    low = F.transform(F.split(t, f"{MARK}s", -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lower(F.substring(x, 1, 4)), F.substring(x, 5, 1 << 30))))
    t = F.regexp_replace(F.array_join(low, f"{MARK}s"), f"{MARK}p(.{{4}})(.{{4}})", r"\\u$1\\u$2")
    return F.when(raw.rlike(_ODD), t).otherwise(raw)


def _read(text: Column, half: str) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, f"{MARK}s([0-9a-f]{{4}})", half), f"{MARK}e", MARK)
    return F.when(F.contains(text, F.lit(MARK)), t).otherwise(text)


def escaped(text: Column) -> Column:
    """Canonical JSON text made from guarded strings, with each half as the escape that stands for it."""
    return _read(text, r"\\u$1")


def shown(text: Column) -> Column:
    """A guarded string as UTF-8 has it: each half is U+FFFD, of three bytes."""
    return _read(text, "\ufffd")
