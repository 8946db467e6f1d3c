"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn by its code point. A trigram's vector binds its letters'
vectors, rotated by their place, by multiplication; a text's vector bundles (adds) those of its trigrams, and a
language's prototype those of its training texts, each scaled to length one. A text gets the language whose
prototype has the largest cosine with it. Everything that is no letter is a blank, and blanks next to each other are one.

Prototypes are fitted on at most PER_LANGUAGE texts of each language, drawn by hashes of their ids
among rows whose crc32(doc_id) mod 4 is not 2. Every language of them has one: the driver holds SIZE numbers for each,
and workers take them in blocks of BLOCK, one pass over the texts for each block. The predictor reads nothing but text.

Texts that are null or have no letter, and all texts if nothing could be learned, get `und` and score 0. Of equal
cosines the first language in order of names wins; rows with equal ids or texts are judged each for itself; empty
tables give empty results; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm import common

#: Components of a vector; training texts of a language at most; languages whose prototypes a worker holds at once.
SIZE, PER_LANGUAGE, BLOCK = 1024, 400, 4096
#: Trigrams whose vectors are added in one product of matrices.
COLUMNS = 4096


@lru_cache(maxsize=None)
def letter_table() -> np.ndarray:
    """The lower-case letter that each code point stands for, 0 for all that are no letters."""
    out = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


@lru_cache(maxsize=8192)
def letter(cp: int) -> np.ndarray:
    return (np.random.default_rng([20240301, cp]).integers(0, 2, SIZE) * 2 - 1).astype(np.int8)


class Bound:
    """Vectors of the trigrams met last: rows of a matrix, made when first needed."""

    def __init__(self, rows: int = 4 * COLUMNS):
        self.at: dict[int, int] = {}
        self.rows = np.zeros((rows, SIZE), np.int8)

    def take(self, grams: list[int]) -> np.ndarray:
        """One row for each of at most COLUMNS trigrams of three code points, 21 bits each."""
        at = self.at
        if len(at) + len(grams) > len(self.rows):
            at.clear()
        for g in grams:
            if g not in at:
                a, b, c = g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF
                self.rows[len(at)] = np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
                at[g] = len(at)
        return self.rows[[at[g] for g in grams]]


@lru_cache(maxsize=1)
def known() -> Bound:
    return Bound()


def bundles(texts: list[str]) -> np.ndarray:
    """The vector of each text, zero if it has no letter."""
    out = np.zeros((len(texts), SIZE), np.float32)
    table = letter_table()
    size = np.array([len(t) for t in texts])
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), size)
    signs = table[raw]
    keep = np.ones(len(signs), bool)
    keep[1:] = (signs[1:] > 0) | (signs[:-1] > 0) | (row[1:] != row[:-1])
    signs, row = signs[keep].astype(np.int64), row[keep]
    # A blank stands before and after each text.
    place = np.arange(len(signs)) + 2 * row + 1
    line = np.zeros(len(signs) + 2 * len(texts), np.int64)
    of = np.repeat(np.arange(len(texts)), np.bincount(row, minlength=len(texts)) + 2)
    line[place] = signs
    grams = line[:-2] << 42 | line[1:-1] << 21 | line[2:]
    inside = (of[:-2] == of[2:]) & (grams > 0)
    if not inside.any():
        return out
    grams, of = grams[inside], of[:-2][inside]
    names, column = np.unique(grams, return_inverse=True)
    for a in range(0, len(names), COLUMNS):
        own = (column >= a) & (column < a + COLUMNS) if len(names) > COLUMNS else slice(None)
        width = min(COLUMNS, len(names) - a)
        counts = np.bincount(of[own] * width + column[own] - a, minlength=len(texts) * width).reshape(len(texts), width).astype(np.float32)
        out += counts @ known().take(names[a : a + width].tolist()).astype(np.float32)
    return out


def _texts(column, limit: int = 400_000, rows: int = 128):
    """The texts of a column in lists of bounded length; a very long text comes in pieces, each (row, text)."""
    held, size = [], 0
    for i, text in enumerate(column):
        text = text.as_py() or ""
        for at in range(0, max(1, len(text)), limit):
            # Pieces share two characters, so no trigram is lost; a blank at a cut counts for next to nothing.
            piece = text[at : at + limit + 2] if at + limit < len(text) else text[at:]
            held.append((i, piece))
            size += len(piece)
            if size >= limit or len(held) >= rows:
                yield held
                held, size = [], 0
    if held:
        yield held


def vectors(column) -> np.ndarray:
    out = np.zeros((len(column), SIZE), np.float32)
    for part in _texts(column):
        np.add.at(out, [i for i, _ in part], bundles([t for _, t in part]))
    return out


def fold() -> F.Column:
    """Remainder 2 marks the rows that are held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, each of length one."""
    usable = docs.where(fold() != 2).where("lang is not null and doc_id is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("draw"))
    # A frequent language is drawn from in parts first, so that no task sees all of its rows.
    parts = usable.withColumn("part", F.pmod("draw", F.lit(64)))
    some = parts.withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy("draw", "doc_id"))).where(F.col("at") <= PER_LANGUAGE // 16)
    sample = some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))).where(F.col("at") <= PER_LANGUAGE).select("doc_id", "lang")
    # As a written table its size is known, so it is broadcast only if it is small.
    chosen = common.cut(sample)
    texts = docs.where("text is not null").join(chosen, ["doc_id", "lang"], "left_semi").select("lang", "text")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            made = vectors(batch.column("text")).astype(np.float64)
            made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)
            for lang, row in zip(batch.column("lang").to_pylist(), made, strict=True):
                sums[lang] = sums[lang] + row if lang in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    def merge(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang] = sums[lang] + v if lang in sums else np.array(v)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    schema = "lang string, v array<double>"
    # One row of SIZE numbers for each language comes to the driver.
    total = {r.lang: np.array(r.v) for r in texts.mapInArrow(common.task(run), schema).repartition("lang").mapInArrow(common.task(merge), schema).collect()}
    common.release(chosen)
    names = sorted(k for k, v in total.items() if v.any())
    # Sums come in any order; rounding makes them the same in every run.
    rows = [np.round(total[k], 6) for k in names]
    return names, np.array([r / np.linalg.norm(r) for r in rows]).reshape(len(names), SIZE)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred and score (cosine, not below 0) of each row; with many languages, in a pass for each block of them."""
    spark = common.prepare(docs.sparkSession)
    names, prototypes = model
    out = docs.select("doc_id", (fold() == 2).alias("held_out"), "text", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    for at in range(0, len(names), BLOCK):
        shared = spark.sparkContext.broadcast((names[at : at + BLOCK], prototypes[at : at + BLOCK]))
        kept = ["doc_id", "held_out", *(["text"] if at + BLOCK < len(names) else [])]

        def run(batches, shared=shared, kept=kept, first=at == 0):
            some, rows = shared.value
            for batch in batches:
                made = vectors(batch.column("text")).astype(np.float64)
                length = np.linalg.norm(made, axis=1)
                cosine = made @ rows.T / np.maximum(length, 1e-9)[:, None]
                best = cosine.argmax(1)
                score = np.clip(cosine[np.arange(len(made)), best], 0, 1)
                lang, old = batch.column("lang_pred").to_pylist(), batch.column("score").to_numpy()
                # The first of equal ones, by name, stays.
                better = (length > 0) & ((score > old) | first)
                for i in np.flatnonzero(better).tolist():
                    lang[i] = some[best[i]]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(np.where(better, score, old))], names=[*kept, "lang_pred", "score"])

        out = out.mapInArrow(common.task(run), out.select(*kept, "lang_pred", "score").schema)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents."""
    common.prepare(spark)
    docs = common.own(common.read(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return identify(docs, fit(docs))
