"""Quality checks of cleaned texts: an ordered chain in which the first failing check names the reason.

Reasons are codes with the measured number beside them, so results can be compared without rounding; reason_text() formats one.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import normalize, pytext
from lexiloom.functions.pytext import once


@dataclass(frozen=True)
class CleanConfig:
    """Bounds are inclusive for lengths and exclusive for shares; an empty block list turns its check off."""

    min_chars: int = 200
    max_chars: int = 100_000
    min_chinese_ratio: float = 0.3
    max_duplicate_line_ratio: float = 0.3
    max_repeated_char_run: int = 20
    max_noise_char_ratio: float = 0.02
    unicode_normalize: bool = True
    #: Phrases of advertisements and copyright notices.
    block_patterns: tuple[str, ...] = (r"(请关注|扫码关注|微信公众号|点击链接|广告)", r"(版权所有|copyright\s*©)")


@F.pandas_udf(T.LongType())
def _noise_count(text: pd.Series) -> pd.Series:
    kinds = ("Cc", "Cs", "Co", "Cn")
    return text.map(lambda t: sum(unicodedata.category(c) in kinds and c not in "\n\t" for c in t), na_action="ignore")


#: Characters of the noise categories but for newline and tab; low ones stand singly (see pytext on classes).
_NOISE = "[" + "".join("\\x%02x" % c for c in (*range(0x20), *range(0x7F, 0xA0)) if c not in (9, 10)) + "[\\x{ad}-\\x{10ffff}&&[\\p{Cc}\\p{Cs}\\p{Co}\\p{Cn}]]]"


def rough_noise_ratio(text: Column) -> Column:
    """noise_ratio() by Java's tables."""
    return (F.length(text) - F.length(F.regexp_replace(text, _NOISE + "+", ""))) / F.greatest(F.length(text), F.lit(1))


def noise_ratio(text: Column, limit: float, rough: Column | None = None) -> Column:
    """Share of control, surrogate, private and unassigned characters but for newline and tab.

    Java's tables count some newer characters as unassigned but none less, so a share that they keep within the limit
    needs no exact count; such texts go to Python as nulls. rough: a column of that share, if there is one.
    """
    rough = rough_noise_ratio(text) if rough is None else rough
    return F.coalesce(_noise_count(F.when(rough > limit, text)) / F.length(text), rough)


def non_space_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{pytext.SPACE}]+", ""))


def chinese_ratio(text: Column) -> Column:
    """Null if there is nothing but white space."""
    share = F.length(F.regexp_replace(text, "[^\\u4e00-\\u9fff]+", "")) / non_space_length(text)
    return F.when(text.rlike("[\\u4e00-\\u9fff]"), share).when(~pytext.is_blank(text), 0.0)


def duplicate_line_ratio(text: Column) -> Column:
    """Null without a line that isn't blank."""
    lines = F.filter(pytext.splitlines(text), lambda x: ~pytext.is_blank(x))
    return once(lines, lambda x: F.when(F.size(x) > 0, 1.0 - F.size(F.array_distinct(x)) / F.size(x)))


def has_repeated_char(text: Column, run: int) -> Column:
    """One character, but no newline, more than run times in a row."""
    return text.rlike("(?d)(.)\\1{%d,}" % run)


def fail_reason(text: Column, config: CleanConfig, rough: Column | None = None) -> Column:
    """Struct (code, value) of the first failing check, null if all pass. rough: as in noise_ratio()."""

    def reason(code: str, value: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), value.cast("double").alias("value"))

    size = F.length(text)
    noise = noise_ratio(text, config.max_noise_char_ratio, rough)
    checks = [
        F.when(size < config.min_chars, reason("too_short", size)),
        F.when(size > config.max_chars, reason("too_long", size)),
        once(noise, lambda x: F.when(x > config.max_noise_char_ratio, reason("noise_chars", x))),
        F.when(has_repeated_char(text, config.max_repeated_char_run), reason("repeated_chars", F.lit(config.max_repeated_char_run))),
        F.when(pytext.is_blank(text), reason("empty_after_strip", F.lit(0))),
        once(duplicate_line_ratio(text), lambda x: F.when(x > config.max_duplicate_line_ratio, reason("duplicate_lines", x))),
    ]
    if config.min_chinese_ratio > 0:
        # No share is below 0.
        checks.insert(-1, once(chinese_ratio(text), lambda x: F.when(x < config.min_chinese_ratio, reason("chinese_ratio", x))))
    if config.block_patterns:
        checks.append(F.when(text.rlike("(?iu)" + "|".join(config.block_patterns)), reason("block_pattern_matched", F.lit(None))))
    return F.coalesce(*checks)


def reason_text(reason: Column, config: CleanConfig) -> Column:
    """The reason as a message; shares have three decimals, rounded half up."""
    code, value = reason["code"], reason["value"]
    whole, share = value.cast("long").cast("string"), F.format_string("%.3f", value)
    text = (
        F.when(code == "too_short", F.concat(F.lit("too_short: "), whole, F.lit(f" < {config.min_chars}")))
        .when(code == "too_long", F.concat(F.lit("too_long: "), whole, F.lit(f" > {config.max_chars}")))
        .when(code == "noise_chars", F.concat(F.lit("noise_chars: "), share, F.lit(f" > {config.max_noise_char_ratio}")))
        .when(code == "repeated_chars", F.lit(f"repeated_chars: run >= {config.max_repeated_char_run}"))
        .when(code == "chinese_ratio", F.concat(F.lit("chinese_ratio: "), share, F.lit(f" < {config.min_chinese_ratio}")))
        .when(code == "duplicate_lines", F.concat(F.lit("duplicate_lines: "), share, F.lit(f" > {config.max_duplicate_line_ratio}")))
    )
    return F.when(reason.isNull(), "").otherwise(F.coalesce(text, code))


def clean(docs: DataFrame, column: str = "text", config: CleanConfig | None = None, table: dict[str, str] | None = None) -> DataFrame:
    """docs with passed, clean_text (empty if failed), fail_code and fail_value; null texts count as empty.

    table, if given, maps traditional to simplified characters first.
    """
    config = config or CleanConfig()
    text = normalize.normalize(normalize.simplified(F.coalesce(F.col(column), F.lit("")), table), config.unicode_normalize)
    # explode() of one element is where the optimizer stops copying an expression into each place that uses it.
    single = docs.select("*", F.explode(F.array(text)).alias("_clean"))
    rough = single.select("*", F.explode(F.array(rough_noise_ratio(F.col("_clean")))).alias("_rough"))
    made = rough.select("*", F.explode(F.array(fail_reason(F.col("_clean"), config, F.col("_rough")))).alias("_reason"))
    return made.select(
        *docs.columns, F.col("_reason").isNull().alias("passed"), F.when(F.col("_reason").isNull(), F.col("_clean")).otherwise("").alias("clean_text"), F.coalesce("_reason.code", F.lit("")).alias("fail_code"), F.col("_reason.value").alias("fail_value")
    )
