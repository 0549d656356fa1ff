"""ECMAScript string and number semantics as column expressions.

The engine's rules are defined over ECMAScript's white space, ASCII word boundaries and half-up rounding, which differ
from Java's; every other module goes through these helpers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside a character class of a Java regular expression: ECMAScript's white space.
WS = r"\t\n\x0B\f\r \xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
CJK = r"\u3400-\u9FFF"
#: The characters of WS by themselves.
SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def text(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def truthy(c: Column) -> Column:
    """The string, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def units(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def half_up(c: Column) -> Column:
    """Rounds half towards plus infinity."""
    return F.floor(c + 0.5).cast("long")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def test(c: Column, pattern: str) -> Column:
    """Whether a pattern is found; false for null."""
    return F.coalesce(c.rlike(pattern), F.lit(False))
