"""Length statistics: summaries, exact percentiles, histograms and comparisons of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Percentiles, and the half-open edges of the histogram.
PERCENTILES = (10, 25, 50, 75, 90, 95, 99, 99.9)
EDGES = (0, 64, 128, 256, 512, 1024, 2048, 3072, 4096, 8192, 1_000_000_000)


def _percentile(size: Column, p: float) -> Column:
    return F.percentile(size, F.lit(p / 100))


def name(p: float) -> str:
    """Column of a percentile."""
    return "p" + f"{p:g}".replace(".", "_")


def summary(rows: DataFrame, column: str = "n", *keys: str) -> DataFrame:
    """n, min, mean, median, max and population deviation by keys."""
    size = F.col(column)
    return rows.groupBy(*keys).agg(F.count(size).alias("n"), F.min(size).alias("min"), F.avg(size).alias("mean"), F.median(size).alias("median"), F.max(size).alias("max"), F.stddev_pop(size).alias("std"))


def percentiles(rows: DataFrame, column: str = "n", *keys: str, points=PERCENTILES) -> DataFrame:
    """Percentiles by linear interpolation. The exact aggregate keeps a count for each distinct length only."""
    return rows.groupBy(*keys).agg(*(_percentile(F.col(column), p).alias(name(p)) for p in points))


def histogram(rows: DataFrame, column: str = "n", edges=EDGES) -> DataFrame:
    """lo, hi, n, share of rows and share of tokens for every bucket, empty ones too."""
    spark = rows.sparkSession
    buckets = spark.createDataFrame(list(zip(edges, edges[1:])), "lo long, hi long")
    size = F.col(column)
    lo = F.coalesce(*(F.when((size >= a) & (size < b), F.lit(a)) for a, b in zip(edges, edges[1:])))
    found = rows.groupBy(lo.cast("long").alias("lo")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("tokens"))
    total = rows.agg(F.count(size).alias("all_n"), F.sum(size).cast("long").alias("all_tokens"))
    joined = buckets.join(found, "lo", "left").crossJoin(F.broadcast(total))  # total is one row
    n, tokens = F.coalesce("n", F.lit(0)), F.coalesce("tokens", F.lit(0))
    return joined.select("lo", "hi", n.cast("long").alias("n"), (n / F.nullif(F.col("all_n"), F.lit(0))).alias("row_share"), (tokens / F.nullif(F.col("all_tokens"), F.lit(0))).alias("token_share"))


def by_source_and_total(rows: DataFrame, source: str = "source", column: str = "n", limit: int = 2048) -> DataFrame:
    """Percentiles and the share above limit of each source and, under a null source with is_total = 1, of all rows."""
    size = F.col(column)
    return rows.groupingSets([[source], []], source).agg(
        F.grouping(source).cast("int").alias("is_total"), F.count(size).alias("n"), *(_percentile(size, p).alias(name(p)) for p in (50, 75, 90, 95, 99)), F.avg((size > limit).cast("int")).alias("over_share")
    )


def char_percentiles(rows: DataFrame, column: str = "n", limit: int = 8000) -> DataFrame:
    size = F.col(column)
    return rows.agg(*(_percentile(size, p).alias(name(p)) for p in (50, 75, 90, 95, 99)), F.avg((size > limit).cast("int")).alias("over_share"))


def sampled(rows: DataFrame, keys: list[str], count: int, seed: int, *order: str) -> DataFrame:
    """count rows of each group, drawn by a seeded hash of order; 0 takes all. A group's rows are limited before they are shuffled."""
    if not count:
        return rows
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in order)))))
    return rows.withColumn("_at", place).where(F.col("_at") <= count).drop("_at")
