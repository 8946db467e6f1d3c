import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import packing
from lexiloom.sources import packed


def restated(sizes, length, threshold):
    """Packing of token lists, one list at a time, with a buffer and one pending sequence."""
    buffer, pending, longs, shorts, lost = [], [], [], [], 0

    def flow():
        nonlocal pending, buffer
        if pending:
            k = length - len(pending)
            pending, buffer = pending + buffer[:k], buffer[k:]
            if len(pending) == length:
                longs.append(pending)
                pending = []
        while len(buffer) >= length:
            shorts.append(buffer[:length])
            buffer = buffer[length:]

    for doc, n in enumerate(sizes):
        own = [(doc, k) for k in range(n)]
        if n >= length:
            while len(own) >= length:
                longs.append(own[:length])
                own = own[length:]
            buffer += own
        elif n >= threshold:
            lost += len(pending)
            pending = own
        else:
            buffer += own
        flow()
    return longs, shorts, lost + len(pending) + len(buffer)


@pytest.mark.parametrize("seed", range(3))
def test_plan_against_restatement(spark, seed):
    rnd = random.Random(seed)
    length = 12
    sizes = [rnd.choice([1, 5, 6, 7, 11, 12, 13, 24, 41]) for _ in range(120)]
    docs = spark.createDataFrame([(i, n, [i * 100 + k for k in range(n)]) for i, n in enumerate(sizes)], "ord long, n int, ids array<int>").repartition(4)
    plan = packing.plan(docs, length, length // 2)
    longs, shorts, lost = restated(sizes, length, length // 2)
    assert plan.where("kind = 'discarded'").agg(F.sum("seq_no")).first()[0] == lost
    made = packing.materialize(plan, docs).orderBy("kind", "seq_no").collect()
    want = [("long", [d * 100 + k for d, k in s]) for s in longs] + [("short", [d * 100 + k for d, k in s]) for s in shorts]
    assert [(r.kind, r.ids) for r in made] == want
    assert sum(len(r.ids) for r in made) + lost == sum(sizes)


def test_groups_pack_alone(spark):
    docs = spark.createDataFrame([(i, 5, "ab"[i % 2]) for i in range(20)], "ord long, n int, s string")
    plan = packing.plan(docs, 10, 6, F.col("s")).where("kind = 'short'")
    assert {r.grp: r.n for r in plan.groupBy("grp").agg(F.count_distinct("seq_no").alias("n")).collect()} == {"a": 5, "b": 5}


def test_short_packing_is_a_running_sum(spark):
    rnd = random.Random(4)
    sizes = [rnd.randint(1, 9) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(sizes)), "ord long, n int").repartition(5)
    rows = packing.pack_short(docs, 16, blocks=7).orderBy("seq_no", "slot").collect()
    assert sum(r.len for r in rows) == sum(sizes)
    assert all(sum(r.len for r in rows if r.seq_no == s) == 16 for s in {r.seq_no for r in rows if r.full})
    assert [r.ord for r in rows] == sorted(r.ord for r in rows)


@pytest.mark.parametrize(("n", "count"), [(1, 1), (2, 1), (50, 1), (150, 2), (250, 3)])
def test_eval_shards(spark, n, count):
    rows = spark.range(n).select(F.lit("long").alias("kind"), F.col("id").alias("shard"))
    made = packing.split(rows).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in made} == {k: v for k, v in (("eval", count), ("train", n - count)) if v}


def test_shards_round_trip(spark, tmp_path):
    rows = [(("long", "short")[i % 3 == 0], i, [(i * 7 + k) % 65536 for k in range(8)]) for i in range(60)]
    sequences = spark.createDataFrame(rows, "kind string, no long, ids array<int>").withColumn("no", F.row_number().over(packing.Window.partitionBy("kind").orderBy("no")) - 1)
    placed = packing.shards(sequences, "no", 10, 42, "kind")
    named = packing.split(placed.select("kind", "shard").distinct())
    packed.write_shards(placed.join(named, ["kind", "shard"]), str(tmp_path))
    files = sorted(f for f in os.listdir(tmp_path) if f.endswith(".bin"))
    assert files and not [f for f in os.listdir(tmp_path) if f.startswith(".") and f.endswith(".bin")]
    assert sum(os.path.getsize(tmp_path / f) for f in files) == 60 * 8 * 2
    back = packed.read_shards(spark, str(tmp_path), 8)
    assert sorted(tuple(r.ids) for r in back.collect()) == sorted(tuple(r[2]) for r in rows)
    offsets = packed.shard_offsets(spark, str(tmp_path), 8)
    found = {r.idx: r for r in packed.locate(spark.range(60).withColumnRenamed("id", "idx"), offsets).collect()}
    whole = [tuple(x) for f in files for x in np.fromfile(tmp_path / f, "<u2").reshape(-1, 8).tolist()]
    local = {(r.path, r.local_no): tuple(r.ids) for r in back.collect()}
    assert all(local[found[i].path, found[i].local_no] == whole[i] for i in range(60))
    for bad in (-1, 60):
        with pytest.raises(Exception, match="no sequence"):
            packed.locate(spark.createDataFrame([(bad,)], "idx long"), offsets).collect()
    with pytest.raises(Exception, match="size doesn't fit"):
        packed.shard_offsets(spark, str(tmp_path), 7).collect()
    assert packing.sequence_count(spark.createDataFrame([(33,), (16,)], "size long"), 8).first()[0] == 3


def test_ids_out_of_range_fail(spark):
    with pytest.raises(Exception, match="16 bits"):
        spark.createDataFrame([([65536],)], "ids array<int>").select(packed.to_bytes(F.col("ids"))).collect()


def test_metadata(spark):
    sequences = spark.createDataFrame([("long", "train", 0), ("long", "train", 0), ("long", "eval", 1), ("short", "eval", 0)], "kind string, split string, shard long")
    segments = spark.createDataFrame([("discarded", 40)], "kind string, seq_no long")
    row = packing.metadata(sequences, segments, "t", ["a"], 10).first()
    assert row.long.train.sequences == 2 and row.long.eval.shards == 1 and row.short.train.tokens == 0 and row.total.tokens == 40 and row.discarded_percent == 50.0
