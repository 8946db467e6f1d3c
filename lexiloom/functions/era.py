"""Dates by Japanese eras: Arabic numerals of era years, months and days become Chinese ones; Gregorian dates stay.

One pass over each text: it is split at all dates, and each date is rewritten by itself. The eras are a parameter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DIGIT = "[0-9０-９]"
_WIDE, _PLAIN = "０１２３４５６７８９", "0123456789"
_ONES = ("", "一", "二", "三", "四", "五", "六", "七", "八", "九")


def chinese(n: int) -> str:
    """0 to 99."""
    tens, ones = divmod(n, 10)
    return ("" if not tens else "十" if tens == 1 else _ONES[tens] + "十") + (_ONES[ones] or ("" if tens else "〇"))


def number(digits: Column) -> Column:
    return F.translate(digits, _WIDE, _PLAIN).cast("int")


def pattern(eras: list[str]) -> str:
    names = sorted({e for e in eras if e}, key=lambda e: (-len(e), e))
    if not names:
        raise ValueError("no eras")
    alternatives = "|".join(map(re.escape, names))
    d = _DIGIT
    return f"(?<!{d}){d}{{4}}年(?:{d}{{1,2}}月)?(?:{d}{{1,2}}日)?|(?:{alternatives}){d}{{1,2}}年|(?<!{d}){d}{{1,2}}月|(?<!{d}){d}{{1,2}}日"


def _rewritten(m: Column, first_year: bool) -> Column:
    digits = F.regexp_extract(m, f"({_DIGIT}+)[年月日]$", 1)
    n = number(digits)
    unit = F.right(m, F.lit(1))
    names = F.array(*(F.lit(chinese(i)) for i in range(100)))
    shown = F.element_at(names, n + 1)
    shown = F.when((unit == "年") & (n == 1), "元").otherwise(shown) if first_year else shown
    most = F.when(unit == "年", 99).when(unit == "月", 12).otherwise(31)
    changed = F.concat(F.left(m, F.length(m) - F.length(digits) - 1), shown, unit)
    gregorian = m.rlike(f"^{_DIGIT}{{4}}年")
    return F.when(gregorian | (n < 1) | (n > most), m).otherwise(changed)


def normalize(text: Column, eras: list[str], first_year: bool = True) -> Column:
    found = pattern(eras)
    pieces = F.split(text, found, -1)
    dates = F.transform(F.regexp_extract_all(text, F.lit(found), F.lit(0)), lambda m: _rewritten(m, first_year))
    return F.array_join(F.zip_with(pieces, dates, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def normalize_blocks(rows: DataFrame, eras: list[str], first_year: bool = True) -> DataFrame:
    """Block rows with every field named text rewritten; terms, citations, titles and the infobox stay."""
    return rows.withColumn("text", F.when((F.col("attr") == "text") & (F.col("node_kind") != "infobox"), normalize(F.col("text"), eras, first_year)).otherwise(F.col("text")))
