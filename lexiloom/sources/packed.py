"""Shard files of packed sequences: little-endian 16-bit token ids, one sequence after the other, no header.

Spark reads them with its binary file source and writes them with a data source of its own, `packed_tokens`; each
shard is one file, written by one task, streamed sequence by sequence.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def to_bytes(ids: Column) -> Column:
    """Binary of an array of ids; an id out of range fails."""
    checked = F.transform(ids, lambda x: F.when((x < 0) | (x > 65535), F.raise_error(F.lit("token id out of 16 bits"))).otherwise(F.concat(F.substring(F.lpad(F.hex(x), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(x), 4, "0"), 1, 2))))
    return F.unhex(F.array_join(checked, ""))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _rows(content: pd.Series, seq_len: pd.Series) -> pd.Series:
    def one(data: bytes, n: int):
        if len(data) % (2 * n):
            raise ValueError(f"{len(data)} bytes are no whole number of sequences of {n}")
        return np.frombuffer(data, "<u2").astype(np.int32).reshape(-1, n).tolist()

    return pd.Series([one(d, n) for d, n in zip(content, seq_len)])


def read_shards(spark: SparkSession, path: str, seq_len: int) -> DataFrame:
    """(path, local_no, ids) of all sequences under path; a file whose size doesn't fit fails."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.posexplode(_rows("content", F.lit(seq_len))).alias("local_no", "ids"))


def shard_offsets(spark: SparkSession, path: str, seq_len: int) -> DataFrame:
    """(path, sequences, first, past): the range of global numbers of each file, in order of paths. One row per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    whole = F.when(F.col("size") % (2 * seq_len) != 0, F.raise_error(F.concat(F.lit("size doesn't fit: "), F.col("path")))).otherwise(F.floor(F.col("size") / (2 * seq_len)))
    counted = files.select("path", whole.alias("sequences"))
    past = F.sum("sequences").over(Window.orderBy("path"))
    return counted.select("path", "sequences", (past - F.col("sequences")).alias("first"), past.alias("past"))


def locate(numbers: DataFrame, offsets: DataFrame) -> DataFrame:
    """(idx, path, local_no): where global sequence numbers are; one out of range fails. offsets has one row per shard."""
    found = numbers.join(F.broadcast(offsets), (F.col("idx") >= F.col("first")) & (F.col("idx") < F.col("past")), "left")
    path = F.when(F.col("path").isNull(), F.raise_error(F.concat(F.lit("no sequence "), F.col("idx").cast("string")))).otherwise(F.col("path"))
    return found.select("idx", path.alias("path"), (F.col("idx") - F.col("first")).alias("local_no"))


class _Message(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    """Each task writes its shards under temporary names; the driver renames them once all tasks are done."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        files, name, out = [], None, None
        os.makedirs(self.path, exist_ok=True)
        for row in rows:
            if row.shard_name != name:
                if out:
                    out.close()
                name = row.shard_name
                held = os.path.join(self.path, f".{name}.{uuid.uuid4().hex}")
                files.append((held, os.path.join(self.path, name)))
                out = open(held, "wb")
            out.write(bytes(row.content))
        if out:
            out.close()
        return _Message(files)

    def commit(self, messages):
        for m in messages:
            for held, final in m.files if m else ():
                os.replace(held, final)

    def abort(self, messages):
        for m in messages:
            for held, _ in m.files if m else ():
                if os.path.exists(held):
                    os.remove(held)


class PackedTokens(DataSource):
    """Sink: option path is a folder that all executors and the driver share."""

    @classmethod
    def name(cls):
        return "packed_tokens"

    def schema(self):
        return "shard_name string, content binary"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def write_shards(sequences: DataFrame, path: str) -> None:
    """Writes (kind, split, split_no, place, ids) as files kind-split-number.bin."""
    spark = sequences.sparkSession
    spark.dataSource.register(PackedTokens)
    name = F.format_string("%s-%s-shard-%05d.bin", "kind", "split", F.col("split_no").cast("int"))
    rows = sequences.select(name.alias("shard_name"), "place", to_bytes(F.col("ids")).alias("content"))
    rows.repartition("shard_name").sortWithinPartitions("shard_name", "place").drop("place").write.format("packed_tokens").mode("append").option("path", path).save()
