"""Python's string semantics as Column expressions: white space, strip, splitlines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java looks up single characters below 256 in one table but tries ranges and other characters of a class one after the
# other. So the classes here name low characters singly, and try the others only for a character within their bounds.

#: What str.isspace() accepts, without and with \n, as the inside of a character class.
SPACE_BUT_NEWLINE = "\\t\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x1f\\x20\\x85\\xa0[\\u1680-\\u3000&&[\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]]"
SPACE = "\\n" + SPACE_BUT_NEWLINE
#: The same characters as a string.
SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Where str.splitlines() breaks, but for a lone \n.
OTHER_BREAK = "[\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85[\\u2028-\\u2029]](?:(?<=\\r)\\n)?"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it, and use no further than its conditions reach."""
    return F.transform(F.array(value), use)[0]


def where_has(text: Column, part: str, step: Callable[[Column], Column]) -> Column:
    """step(text) for texts with part; others need no step and are spared its regular expression."""
    return once(text, lambda t: F.when(F.contains(t, F.lit(part)), step(t)).otherwise(t))


def run_before(inside: str, end: str) -> str:
    """Pattern of a whole run of the class before end; a run is tried from its first character only, so in one pass."""
    return f"[{inside}](?<![{inside}][{inside}])[{inside}]*+{end}"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def unify_lines(text: Column) -> Column:
    """Every line break as \\n, and none at the end, as if lines were split and joined."""
    return once(F.regexp_replace(text, OTHER_BREAK, "\n"), lambda t: F.when(F.endswith(t, F.lit("\n")), F.regexp_replace(t, "\\n\\z", "")).otherwise(t))


def splitlines(text: Column) -> Column:
    """Lines without their breaks; a break at the end adds no line, and an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(unify_lines(text), "\n", -1))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE}]")
