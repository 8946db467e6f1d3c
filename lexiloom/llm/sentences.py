"""Substring removal by sliding spans of sentences.

A text is cut into sentences at . ! ? ; : and line ends, and in a sentence also before the words that have the least
hash of some PIECE words in a row (winnowing). So no sentence has over PIECE words, and equal passages are cut alike
wherever they begin and end. From each sentence starts one span: the shortest run of at least RUN sentences with at
least WORDS words. Spans' hashes meet in a global join; the first span of each hash, by doc_id and place, stays, and
every sentence that another one covers is removed.

Any WORDS + 3 * PIECE - 2 = 51 words that two texts share, with their stops, hold a span of both: their first PIECE
words have a cut of both, WORDS words after it the next PIECE words have one, and only their last PIECE - 1 words may be
cut in one text alone. Repeated passages of fewer than WORDS words are never touched.

The least place of each hash is aggregated before the shuffle, and only hashes that occur twice are written and joined
back with spans made again; the rows of hot hashes are dealt to several tasks.

Null and empty texts have no sentences and are returned as they are. Rows with one doc_id count as one document: the
first span of such copies is the same place, so they stay alike. Rows with a null doc_id are returned unchanged and
are no one's first. Empty tables give empty results; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import common
from lexiloom.llm.common import ALNUM, Words

#: Sentences and words of a span at least; most words of a sentence.
RUN, WORDS, PIECE = 1, 29, 8

_STOP = np.zeros(256, np.int32)
_STOP[[ord(c) for c in ".!?;:\n\r"]] = 1


def _least(h: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """The words whose hash is the least of some PIECE words in a row of one sentence; with ties, each of them."""
    n = len(h) - PIECE + 1
    if n <= 0:
        return np.zeros(len(h), bool)
    least = h[:n].copy()
    for k in range(1, PIECE):
        np.minimum(least, h[k : n + k], out=least)
    least[sentence[:n] != sentence[PIECE - 1 :]] = 0
    # A word's hash is not below the least of any row that it is in.
    most = np.zeros(len(h), np.uint64)
    for k in range(PIECE):
        np.maximum(most[k : n + k], least, out=most[k : n + k])
    return most == h


class Sentences:
    """Of several texts: by sentence its first word's number, and by text its first sentence's number."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.words = words = Words(data, off, ALNUM)
        n = len(words.hash)
        stops = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_STOP[data], out=stops[1:])
        starts = np.zeros(n, bool)
        if n:
            starts[0] = True
            starts[1:] = stops[words.start[1:]] > stops[words.end[:-1]]
            starts[words.first[:-1][np.diff(words.first) > 0]] = True
            starts |= _least(words.hash, np.cumsum(starts))
        self.first = np.flatnonzero(starts)
        self.text = np.searchsorted(self.first, words.first)
        self.edge = np.append(self.first, n)
        up, down = common._powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(words.hash * up, out=total[1:])
        self.total, self.down = total, down

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first sentence, sentence past the last, and text of each span."""
        m = len(self.first)
        if not m:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none, none
        a = np.arange(m)
        b = np.maximum(a + RUN, np.searchsorted(self.edge, self.edge[:-1] + WORDS))
        text = np.searchsorted(self.text, a, "right") - 1
        inside = b <= self.text[text + 1]
        a, b, text = a[inside], b[inside], text[inside]
        x, y = self.edge[a], self.edge[b]
        return common.mix((self.total[y] - self.total[x]) * self.down[x] + (y - x).astype(np.uint64)), a, b, text


def spans(docs: DataFrame) -> DataFrame:
    """(h, doc_id, at, n): hash, first sentence and number of sentences of each span."""

    def run(batches):
        for batch, i, j, data, off in common.texts_of(batches):
            made = Sentences(data, off)
            h, a, b, text = made.spans()
            ids = batch.column(0)[i:j].take(pa.array(text))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids, pa.array(a - made.text[text], pa.int32()), pa.array(b - a, pa.int32())], names=["h", "doc_id", "at", "n"])

    return docs.mapInArrow(common.task(run), "h long, doc_id long, at int, n int")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, at, n, h): the spans that are not the first of their hash."""
    every = spans(docs.where("doc_id is not null"))
    first = every.groupBy("h").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("k")).where("k > 1")
    return common.spread(every, common.cut(first), "h", "k").where(F.struct("doc_id", "at") > F.col("first")).select("doc_id", "at", "n", "h")


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed (first:end of removed sentences, comma-joined) and text without them, of each row."""
    common.prepare(docs.sparkSession)
    docs = common.own(docs, "doc_id", "text")
    # One row of a document per run of covered sentences' starts; a document's own spans bound its group.
    covered = common.cut(repeated(docs).distinct()).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "n", "h"))).alias("spans"))
    joined = docs.join(covered, "doc_id", "left")

    def run(batches):
        for batch in batches:
            data, off = common.flat(batch.column("text"))
            given = batch.column("spans")
            size, gone, where, texts = [], [], [], []
            for i, j in common.slices(off):
                part = off[i : j + 1] - off[i]
                raw = data[off[i] : off[j]]
                made = Sentences(raw, part)
                hashes, starts, _, _ = made.spans()
                hash_at = np.zeros(len(made.first) + 1, np.int64)
                hash_at[starts] = hashes.view(np.int64)
                for k in range(i, j):
                    lo, hi = made.text[k - i], made.text[k - i + 1]
                    size.append(int(hi - lo))
                    own = given[k].as_py()
                    if not own:
                        gone.append(0)
                        where.append("")
                        texts.append(batch.column("text")[k].as_py())
                        continue
                    hit = np.zeros(hi - lo + 1, np.int32)
                    for s in own:
                        if s["at"] + s["n"] <= hi - lo and hash_at[lo + s["at"]] == s["h"]:
                            hit[s["at"]] += 1
                            hit[s["at"] + s["n"]] -= 1
                    edge = np.diff(np.concatenate(([0], (np.cumsum(hit[:-1]) > 0).astype(np.int8), [0])))
                    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    gone.append(int((b - a).sum()))
                    where.append(",".join(f"{x}:{y}" for x, y in zip(a.tolist(), b.tolist(), strict=True)))
                    out, at = [], int(part[k - i])
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        out.append(raw[at : made.words.start[made.edge[lo + x]]].tobytes())
                        at = int(made.words.start[made.edge[lo + y]]) if lo + y < hi else int(part[k - i + 1])
                    texts.append(b"".join([*out, raw[at : part[k - i + 1]].tobytes()]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(where, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_sentences", "n_removed", "removed", "text"])

    return joined.mapInArrow(common.task(run), "doc_id long, n_sentences long, n_removed long, removed string, text string")


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the sentences that repeated spans cover taken out."""
    return remove(common.read(spark, sf_dir, "documents"))
