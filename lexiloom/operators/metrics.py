"""Roll-ups of training logs, and the relational parts of model code: masks, labels, positions, sizes, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG = "time string, step long, lr string, loss string, grad_norm string, eval_loss string, eval_ppl string"


def read_log(spark, path: str) -> DataFrame:
    """A metrics log, its numbers cast from strings."""
    rows = spark.read.schema(LOG).json(path)
    return rows.select(F.to_timestamp("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "step", *(F.col(c).cast("double").alias(c) for c in ("lr", "loss", "grad_norm", "eval_loss", "eval_ppl")))


def weighted_loss(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean loss weighted by tokens, and its perplexity, infinite where it overflows."""
    loss = F.sum(F.col("loss") * F.col("tokens")) / F.nullif(F.sum("tokens"), F.lit(0))
    return rows.groupBy(*keys).agg(loss.alias("loss"), F.sum("tokens").alias("tokens")).withColumn("ppl", F.exp("loss"))


def moving_means(rows: DataFrame, steps: int, order: str, *keys: str, column: str = "loss") -> DataFrame:
    """rows with the mean of the last steps values."""
    return rows.withColumn("moving", F.avg(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - steps, Window.currentRow)))


def shifted_labels(tokens: DataFrame, key: str = "seq", pos: str = "pos", token: str = "token", ignore: int = -100, pad: int | None = None) -> DataFrame:
    """tokens with the label of each position, the next token; ignore at the end and before padding."""
    following = F.lead(token).over(Window.partitionBy(key).orderBy(pos))
    return tokens.withColumn("label", F.when(following.isNull() | (F.lit(pad is not None) & (following == F.lit(pad if pad is not None else -1))), ignore).otherwise(following))


def position_ids(tokens: DataFrame, mask: str = "mask", key: str = "seq", pos: str = "pos") -> DataFrame:
    total = F.sum(mask).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return tokens.withColumn("position_id", F.greatest(total - 1, F.lit(0)))


def causal(i: Column, j: Column, pad: Column) -> Column:
    """Whether position i may look at position j, which must hold no padding."""
    return (i >= j) & ~pad


def top_p(rows: DataFrame, p: float, key: str = "step") -> DataFrame:
    """(key, token, prob): the most probable tokens up to and with the one that reaches p, scaled to 1."""
    order = Window.partitionBy(key).orderBy(F.desc("prob"), "token").rowsBetween(Window.unboundedPreceding, -1)
    kept = rows.withColumn("before", F.coalesce(F.sum("prob").over(order), F.lit(0.0))).where(F.col("before") < p)
    return kept.withColumn("prob", F.col("prob") / F.sum("prob").over(Window.partitionBy(key))).select(key, "token", "prob")


def parameter_count(vocab: Column, hidden: Column, layers: Column, heads: Column, inner: Column) -> Column:
    """Weights of a decoder: query and output, key and value by whole head sizes, a gated feed-forward part, norms, embedding and head."""
    layer = 2 * hidden * hidden + 2 * hidden * F.floor(hidden / heads) * heads + 3 * hidden * inner + 2 * hidden
    return (layers * layer + 2 * vocab * hidden + hidden).cast("long")


def steps_of(sequences: Column, batch: Column, accumulation: Column, processes: Column) -> Column:
    """Optimizer steps of one pass."""
    return F.ceil(sequences / (batch * accumulation * processes))


def checked_config(rows: DataFrame) -> DataFrame:
    """rows (dim, heads, kv_heads) with the first broken rule, '' if none."""
    return rows.withColumn(
        "broken",
        F.when((F.col("heads") == 0) | (F.col("kv_heads") == 0), "heads_zero").when(F.col("dim") % F.col("heads") != 0, "dim_heads").when(F.col("heads") % F.col("kv_heads") != 0, "heads_kv").when((F.col("dim") / F.col("heads")) % 2 != 0, "odd_head_dim").otherwise(""),
    )
