"""Frequencies of n-grams of Han characters or of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import markdown


def han_ngrams(docs: DataFrame, least: int = 2, most: int = 4, column: str = "text") -> DataFrame:
    """(term): each n-gram inside a segment of Han characters, Markdown stripped first."""
    segments = docs.select(F.explode(markdown.han_segments(markdown.strip_markdown(F.col(column)))).alias("s"))
    return segments.select(F.explode(markdown.char_ngrams(F.col("s"), least, most)).alias("term"))


def word_ngrams(docs: DataFrame, n: int, column: str = "text") -> DataFrame:
    """(term): each run of n words that spaces part, joined by one space."""
    words = F.filter(F.split(F.lower(F.col(column)), "[\\s]+", -1), lambda w: w != "")
    own = docs.select(words.alias("w")).where(F.size("w") >= n)
    return own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("term"))


def frequencies(terms: DataFrame, least: int = 1, column: str = "term") -> DataFrame:
    return terms.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def top(counts: DataFrame, n: int, column: str = "term") -> DataFrame:
    """The n most frequent terms; of equal counts the one first in order."""
    return counts.orderBy(F.desc("n"), column).limit(n)


def efficiency(rows: DataFrame, tokens: Column, term: str = "term") -> DataFrame:
    """rows with tokens and tokens per character."""
    return rows.withColumn("tokens", tokens).withColumn("ratio", F.col("tokens") / F.length(term))


def efficiency_summary(rows: DataFrame, limit: float = 1.5) -> DataFrame:
    """Mean ratio, the worst term and how many are above limit."""
    return rows.agg(F.avg("ratio").alias("mean_ratio"), F.max_by("term", F.struct("ratio", "term")).alias("worst"), F.count_if(F.col("ratio") > limit).alias("over"))
