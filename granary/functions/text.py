"""Column functions with the text semantics that files and prose need: Unicode white space, lines, names, letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: the Unicode property and the four separators that it lacks.
SPACE = r"[\s\x1c-\x1f]"


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x with x worked out once: what stands in a lambda is otherwise worked out for every element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)([^\s\x1c-\x1f]+)"), F.lit(1))


def token_count(c: Column) -> Column:
    return F.size(words(c))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def lines(c: Column) -> Column:
    """Lines without their ends; an end at the end begins no line."""
    return F.split(F.regexp_replace(c, r"(\R|[\x1c-\x1e])\z", ""), r"\R|[\x1c-\x1e]")


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def _capital(x: str) -> str:
    return next((y for y in (x.upper(), x.title()) if len(y) == 1), "ẞ" if x == "ß" else x)


_CASED = [(x, y) for x in map(chr, range(0x20000)) if (y := _capital(x)) != x]
_SMALL, _CAPITAL = ("".join(x) for x in zip(*_CASED))


def upper_each(c: Column) -> Column:
    """Upper case by single characters, as in DuckDB: ß gives ẞ and ligatures stay, where F.upper gives several letters."""
    return F.translate(c, _SMALL, _CAPITAL)


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def suffix(c: Column) -> Column:
    """The lower-cased extension with its dot; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(base_name(c), r"[^.].*?(\.[^.]+)$|$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]+$", "")


def safe_name(c: Column) -> Column:
    """An identifier for SQL: a-z, 0-9 and _, at most 40 characters, col if nothing is left."""
    cut = F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"), 1, 40)
    return F.coalesce(F.nullif(F.regexp_replace(cut, "^_+|_+$", ""), F.lit("")), F.lit("col"))


def column_letter(i: Column) -> Column:
    """0: A, 25: Z, 26: AA, and so on; a long takes up to 14 letters. Null for null and negative numbers."""
    firsts = [sum(26**j for j in range(1, n)) for n in range(1, 15)]  # the first number of n letters
    i = i.cast("long")
    letter = lambda x: F.char(F.lit(65) + x)
    digit = lambda k, p: F.call_function("div", k, F.lit(26**p)) % 26
    each = [F.concat(*[letter(digit(i - first, p)) for p in range(n, -1, -1)]) for n, first in enumerate(firsts)]
    out = each[-1]
    for first, one in zip(firsts[:0:-1], each[-2::-1]):
        out = F.when(i < first, one).otherwise(out)
    return F.when(i >= 0, out)


def ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)
