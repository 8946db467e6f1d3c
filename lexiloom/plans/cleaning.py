"""Jobs that clean whole corpora: one narrow stage from scan to write, and one small aggregate for the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.quality import CleanConfig, clean


def clean_wiki(raw: DataFrame, config: CleanConfig | None = None, table: dict[str, str] | None = None) -> DataFrame:
    """Passed texts of a table with the column text; table maps traditional to simplified characters."""
    return clean(raw.select("text"), "text", config, table).where("passed").select(F.col("clean_text").alias("text"))


def clean_web(raw: DataFrame, config: CleanConfig | None = None, least: float = 0.7) -> DataFrame:
    """Passed texts of a table with content and score; the score is compared as a double and kept as it is."""
    return clean(score_filter(raw.select("content", "score"), least), "content", config).where("passed").select(F.col("clean_text").alias("text"), "score")


def score_filter(raw: DataFrame, least: float = 0.7, column: str = "score") -> DataFrame:
    return raw.where(F.col(column).cast("double") >= least)


def report(cleaned: DataFrame, *keys: str) -> DataFrame:
    """passed and filtered rows by keys."""
    return cleaned.groupBy(*keys).agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("filtered"))


def by_reason(cleaned: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys and reason; an empty reason stands for passed texts."""
    return cleaned.groupBy(*keys, "fail_code").agg(F.count("*").alias("n"), F.sum(F.length("clean_text")).cast("long").alias("clean_chars"))


def pending(inputs: DataFrame, outputs: DataFrame, *keys: str) -> DataFrame:
    """Inputs that have no output yet."""
    return inputs.join(outputs.select(*keys).distinct(), list(keys), "left_anti")
