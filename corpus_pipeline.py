"""From raw documents to token ids: reject toxic texts, keep one of each group of near copies, cut out benchmark passages, redact secrets, encode.

Each stage works on all rows that the one before it kept, and its result is written and read again. Rows with a null
doc_id are never near copies of others; rows that repeat a doc_id with its text stay once after the join. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bpe, common, decontam, ngram_join, secrets, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut."""
    return toxicity.reject(docs, common.read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram join the document with the smallest id, other documents as they are."""
    common.prepare(spark)
    parts = ngram_join.join_components(docs).where("doc_id is not null")
    own = parts.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
    flags = common.cut(own.where("rows > 1 or not first").select(F.col("doc_id").alias("flagged id"), "first"))
    plain = docs.join(flags, docs["doc_id"] == flags["flagged id"], "left_anti")
    if not flags.where("first").head(1):
        return plain
    repeated = docs.join(flags.where("first"), docs["doc_id"] == flags["flagged id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return plain.union(repeated)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark windows; texts of nothing else go."""
    return decontam.remove(docs, common.read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of each document."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: Neither a learned lexicon nor BPE can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table documents."""
    docs = common.read(spark, sf_dir, "documents")
    held = []
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
        common.release(*held)
        held = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
