r"""Chat formatting by columnar assembly of bytes.

A turn becomes `### role\n`, its text, and `\n</turn>\n`. Inside roles and texts a backslash, a number sign and the
slash of `</turn>` get a backslash before them (in roles a line end, too), so control strings never occur in contents and
reading back is exact. Lengths of all segments of a batch are computed first, then cumulative offsets and the index
that scatters each byte to its place in one preallocated Arrow buffer.

Turns are dealt by ranges of (conv_id, turn, role), so a long conversation spreads over tasks, and come out as
pieces: a conversation's turns of one batch. The loss mask is a list of code-point spans of a piece, one for each
assistant text. Digests of a conversation read its pieces in order, as a stream with the state of one hash.

Order is by turn, then role, then text, nulls first. A null role or text is empty; a null conv_id is a conversation
of its own; repeated rows are turns like others; empty tables give no pieces; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import common

HEAD, MIDDLE, END = b"### ", b"\n", b"\n</turn>\n"
TURN = re.compile(rb"### ((?:[^\\\n]|\\.)*)\n(.*?)\n</turn>\n", re.DOTALL)
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)
_CLOSE = np.frombuffer(b"</turn>", np.uint8)


def escape(data: np.ndarray, off: np.ndarray, role: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes of several texts, and their offsets."""
    flag = (data == 0x5C) | (data == 0x23)
    if role:
        flag |= data == 0x0A
    n = len(data)
    if n >= len(_CLOSE):
        close = np.ones(n - len(_CLOSE) + 1, bool)
        for k, b in enumerate(_CLOSE):
            close &= data[k : n - len(_CLOSE) + 1 + k] == b
        at = np.flatnonzero(close)
        # A match must lie in one text.
        at = at[np.searchsorted(off, at, "right") == np.searchsorted(off, at + len(_CLOSE) - 1, "right")]
        flag[at + 1] = True
    added = np.concatenate(([0], np.cumsum(flag)))
    out = np.empty(n + int(added[-1]), np.uint8)
    place = np.arange(n) + added[1:]
    out[place] = data
    out[place[flag] - 1] = 0x5C
    return out, off + added[off]


def unescape(data: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", data)


def _put(out: np.ndarray, at: np.ndarray, data: np.ndarray, off: np.ndarray) -> None:
    """Scatters each text to its place."""
    out[np.repeat(at - off[:-1], np.diff(off)) + np.arange(len(data))] = data


def _points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def assemble(conv: pa.Array, roles: pa.Array, texts: pa.Array):
    """Pieces of sorted turns: first row of each, their bytes as one Arrow array, and loss spans of each."""
    assistant = np.array(roles.fill_null("").to_pylist()) == "assistant"
    role, role_off = escape(*common.flat(roles), role=True)
    text, text_off = escape(*common.flat(texts))
    size = np.diff(role_off) + np.diff(text_off) + len(HEAD) + len(MIDDLE) + len(END)
    begin = np.concatenate(([0], np.cumsum(size)))
    buffer = pa.allocate_buffer(int(begin[-1]))
    out = np.frombuffer(buffer, np.uint8)
    at = begin[:-1]
    out[at[:, None] + np.arange(len(HEAD))] = np.frombuffer(HEAD, np.uint8)
    at = at + len(HEAD)
    _put(out, at, role, role_off)
    at = at + np.diff(role_off)
    out[at[:, None] + np.arange(len(MIDDLE))] = np.frombuffer(MIDDLE, np.uint8)
    at = at + len(MIDDLE)
    _put(out, at, text, text_off)
    stop = at + np.diff(text_off)
    out[stop[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)
    points = _points(out)
    ids = conv.to_pylist()
    first = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
    edge = [*first, len(ids)]
    if begin[-1] >= 1 << 31:
        raise ValueError("a batch of turns must be under 2 GiB")
    binary = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(begin[edge].astype(np.int32)), buffer])
    spans = []
    for a, b in zip(edge, edge[1:], strict=False):
        zero = points[begin[a]]
        spans.append([int(x) for k in range(a, b) if assistant[k] for x in (points[at[k]] - zero, points[stop[k]] - zero)])
    return first, binary, spans


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, n_turns, formatted, loss) of all turns; piece orders a conversation's rows, loss has pairs of code points."""
    common.prepare(conversations.sparkSession)
    order = ["conv_id", "turn", "role"]
    turns = common.own(conversations, "conv_id", "turn", "role", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j in common.slices(common.flat(batch.column("text"))[1], 64 << 20):
                part = batch.slice(i, j - i)
                first, binary, spans = assemble(part.column("conv_id"), part.column("role"), part.column("text"))
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id").take(pa.array(first)), pa.array(range(number, number + n), pa.int64()), pa.array(np.diff([*first, part.num_rows]), pa.int64()), binary, pa.array(spans, pa.list_(pa.int64()))],
                    names=["conv_id", "piece", "n_turns", "formatted", "loss"],
                )
                number += n

    return turns.mapInArrow(common.task(run), "conv_id long, piece long, n_turns long, formatted binary, loss array<long>")


def read_turns(formatted: bytes) -> list[tuple[str, str]]:
    """(role, text) of each turn of a piece."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at byte {at}")
        out.append((unescape(m[1]).decode(), unescape(m[2]).decode()))
        at = m.end()
    return out


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.chars, self.n, self.size = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: bytes, loss: list[int]) -> None:
        for role, text in read_turns(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        whole = formatted.decode()
        self.size += len(whole)
        for a, b in zip(loss[::2], loss[1::2], strict=True):
            own = unescape(whole[a:b].encode())
            self.chars += len(own.decode())
            self.loss.update(own)


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, read back from its pieces."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        held, done = None, []

        def rows():
            cells = list(zip(*((d.conv, d.n, d.turns.hexdigest(), d.chars, d.loss.hexdigest(), d.size) for d in done), strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=names)

        for batch in batches:
            for conv, formatted, loss in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if held is None or held.conv != conv:
                    if held is not None:
                        done.append(held)
                    held = _Digest(conv)
                held.add(formatted.as_py(), loss)
            if len(done) > 1000:
                yield rows()
                done = []
        if held is not None:
            done.append(held)
            yield rows()

    # A hash is a sequence: a conversation's pieces meet in one task, which streams them.
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "formatted", "loss")
    return dealt.mapInArrow(common.task(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one with control strings inside, formatted and read back."""
    given = common.own(common.read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return digests(format_turns(given.unionByName(extra)))


OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'))
    + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), chr(10), '\' || chr(10))) + 14 AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
