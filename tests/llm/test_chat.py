import random

import duckdb
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import chat, common

PARTS = ["#", "\\", "</turn>", "</", "turn>", "\n", "### ", "é", "a", "😀", ": "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PARTS), max_size=5).map("".join), st.lists(st.sampled_from(PARTS), max_size=8).map("".join)), max_size=6))
def test_round_trip(turns):
    _, binary, _ = chat.assemble(pa.array([1] * len(turns), pa.int64()), pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()))
    if turns:
        assert chat.read_turns(binary[0].as_py()) == turns


def test_escapes_hide_control_strings():
    texts = ["</turn>", "a</", "turn>b", "###"]
    out, off = chat.escape(*common.flat(pa.array(texts)))
    parts = [out[a:b].tobytes() for a, b in zip(off, off[1:])]
    assert parts == [b"<\\/turn>", b"a</", b"turn>b", b"\\#\\#\\#"]


def test_against_sql(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "a\nb#"]), rnd.choice([None, "", "".join(rnd.choice(PARTS) for _ in range(9))]), 1) for c in range(40) for t in range(rnd.randint(1, 9))]
    rows += [(100, i, "assistant", "x" * 20, 1) for i in range(5000)] + [rows[0], (None, 1, "assistant", "n", 1), (None, None, "user", "m", 1), (101, 3, "user", "b", 1), (101, 3, "assistant", "a", 1), (102, 0, "assistant", "é" * 200_000, 1)]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(str, (tuple(r) for r in chat.op7_chat_format(spark, str(tmp_path)).collect())))
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(map(str, duckdb.sql(chat.OP7_SQL).fetchall()))


def test_empty(spark):
    assert chat.digests(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
