"""Markdown stripped to plain text, and Han segments and their n-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions import pytext

#: Patterns and replacements in the order that they apply in; a line ends at \n only.
STEPS = (
    (r"```[\s\S]*?```", " "), (r"`[^`]+`", " "), (rf"(?dm)^#{{1,6}}[{pytext.SPACE}]+", ""), (r"(?d)!\[.*?\]\(.*?\)", " "), (r"(?d)\[.*?\]\(.*?\)", " "),
    (r"[*_]{1,3}", ""), (rf"(?dm)^[-*_]{{3,}}[{pytext.SPACE}]*$", " "), (r"\|", " "),
)
#: Han characters in segments, and those of the single-character test.
HAN_SEGMENT = "[\\u4e00-\\u9fff\\u3400-\\u4dbf]+"
HAN_CHAR = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{F900}-\\x{FAFF}\\x{2F800}-\\x{2FA1F}]"


def strip_markdown(text: Column) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), STEPS, text)


def han_segments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HAN_SEGMENT), F.lit(0))


def is_han(char: Column) -> Column:
    return char.rlike(f"^{HAN_CHAR}$")


def all_han(text: Column) -> Column:
    return text.rlike(f"^{HAN_CHAR}+$")


def char_ngrams(segment: Column, least: int, most: int) -> Column:
    """All n-grams of characters of a segment, lengths from least to most."""
    size = F.length(segment)
    each = F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(segment, i, n))).otherwise(F.array().cast("array<string>")))
    return F.flatten(each)
