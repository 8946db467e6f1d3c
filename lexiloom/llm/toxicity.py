"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding look-alikes.

Texts are folded first: lower case, homoglyphs to Latin letters, and digits or signs next to letters to the letter
that they stand for; i, l and 1 are one letter. The lexicon holds whole words and beginnings of words, learned from
labelled texts: a term's weight is its log-odds of standing in a toxic text. Phrases of a term's word and a
neighbour that clean texts have again and again and toxic ones hardly ever are exceptions; a match inside one
doesn't count. The sum of a text's weights, per hundred words, goes through a logistic curve fitted on the same rows.

At most SAMPLE labelled rows are learned from, those with the smallest hashes of their ids, none of them with
crc32(doc_id) mod 4 = 2. The lexicon holds every term and exception of theirs that passes the tests of weight and
frequency, so the sample bounds its size. Scoring reads nothing but text, and all of it.

Null and empty texts get the score of a text without matches; without usable labels every score is 0. Rows with equal
ids or texts are scored each for itself; a document with several labels counts once for each; empty tables give empty
results; columns other than doc_id, text and toxic are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import common

#: Labelled rows that are learned from, and toxic texts of a large sample that must have a term.
SAMPLE, LEAST = 12_000, 8
#: Least log-odds of a term; lengths of a word's beginnings; the score from which a text counts as toxic.
ODDS, BEGIN, CUT = 2.5, range(4, 8), 0.3

#: Letters of other scripts that look like Latin ones, and what digits and signs stand for.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}

_FOLD = str.maketrans({**HOMOGLYPHS, **{chr(0xFF41 + i): chr(0x61 + i) for i in range(26)}, "l": "i", "ⅼ": "i"})
_SIGN = re.compile(r"(?<=[^\W\d_])[013457 8@$|]+(?=[^\W\d_])|(?<![\w@$|])[013457 8@$|]{1,2}(?=[^\W\d_])".replace(" ", ""))
_SIGNS = str.maketrans(SIGNS)
_WORD = re.compile(r"\w+")


def fold(text: str) -> str:
    text = text.lower().translate(_FOLD)
    return _SIGN.sub(lambda m: m.group().translate(_SIGNS), text)


class Lexicon:
    """Terms (`word ` is whole, `word` a beginning) with weights, and exception phrases of two words."""

    def __init__(self, terms: dict[str, float], exceptions: set[str]):
        self.exceptions = exceptions
        self.found = ahocorasick.Automaton()
        for term, weight in terms.items():
            word = term.rstrip(" ")
            old = self.found.get(word, (len(word), None, None))
            self.found.add_word(word, (len(word), weight if term == word else old[1], weight if term != word else old[2]))
        if terms:
            self.found.make_automaton()
        self.empty = not terms

    def matches(self, text: str):
        """Weight of each word of folded text that a term matches, its heaviest term counting, and the word's place."""
        best: dict[int, float] = {}
        n = len(text)
        for end, (size, begin, whole) in self.found.iter(text):
            start = end - size + 1
            if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
                continue
            last = end + 1 == n or not (text[end + 1].isalnum() or text[end + 1] == "_")
            for weight in (begin, whole if last else None):
                if weight is not None and weight > best.get(start, 0):
                    best[start] = weight
        return best

    def excepted(self, text: str, start: int) -> bool:
        word = _WORD.match(text, start).group()
        after = _WORD.search(text, start + len(word))
        before = re.search(r"(\w+)\W*\Z", text[max(0, start - 60) : start])
        return bool(after and f"{word} {after.group()}" in self.exceptions or before and f"{before.group(1)} {word}" in self.exceptions)

    def weigh(self, text: str | None) -> float:
        """Sum of weights per hundred words."""
        if not text or self.empty:
            return 0.0
        text = fold(text)
        best = self.matches(text)
        if not best:
            return 0.0
        total = math.fsum(w for start, w in best.items() if not self.exceptions or not self.excepted(text, start))
        return 100 * total / max(10, len(text.split()))


def fold_of(column: str = "doc_id") -> Column:
    """Remainder 2 marks the rows that are held out."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 4


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of the labelled rows that are learned from."""
    usable = labels.where("doc_id is not null and toxic is not null").where(fold_of() != 2).select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE)
    return docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def _terms_of(text: str) -> set[str]:
    words = set(_WORD.findall(fold(text)))
    return {w + " " for w in words if len(w) >= 3} | {w[:k] for k in BEGIN for w in words if len(w) > k}


def _counted(sample: DataFrame, of) -> DataFrame:
    """(term, bad, good): texts of each kind with each term; those of some rows are counted together, so a worker holds few terms."""

    def run(batches):
        for batch in (b.slice(k, 50) for b in batches for k in range(0, b.num_rows, 50)):
            sums = {True: Counter(), False: Counter()}
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[toxic].update(of(text.as_py()))
            terms = list(sums[True].keys() | sums[False].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([sums[True][t] for t in terms], pa.int64()), pa.array([sums[False][t] for t in terms], pa.int64())], names=["term", "bad", "good"])

    return sample.mapInArrow(common.task(run), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], set[str], tuple[float, float]]:
    """Terms, exceptions, and bias and slope of the curve."""
    sample = common.cut(_sample(docs, labels))
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not good:
        common.release(sample)
        return {}, set(), (-1e9 if not bad else 1e9, 0.0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    # LEAST is for samples of many toxic texts; of few, a hundredth but three at least.
    least = max(3, min(LEAST, -(-bad // 100)))
    rows = _counted(sample, _terms_of).where(f"bad >= {least}").withColumn("odds", odds).where(F.col("odds") >= ODDS).collect()
    every = {r.term: r.odds for r in rows}
    # A term that a shorter beginning matches with as much weight adds nothing.
    terms = {t: w for t, w in every.items() if not any(every.get(t.rstrip(" ")[:k], -1.0) >= w - 0.5 and t != t[:k] for k in BEGIN if k < len(t))}
    exceptions = _exceptions(sample, terms)
    points = [(r.toxic, r.x) for r in _weighed(sample, terms, exceptions).select("toxic", "x").collect()]
    common.release(sample)
    x, y = np.log1p([p[1] for p in points]), np.array([float(p[0]) for p in points])
    a, b = 0.0, 0.0
    # Newton's method with a weak prior on the slope, so that separable rows give a finite curve.
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - 0.05 * b])
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.05]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return terms, exceptions, (round(float(a), 6), round(float(b), 6))


def _exceptions(sample: DataFrame, terms: dict[str, float]) -> set[str]:
    """Phrases that at least three clean texts have and nine times as many of them as of toxic ones."""
    if not terms:
        return set()

    def of(text: str) -> set[str]:
        lexicon = _made(terms, set())
        text = fold(text)
        out = set()
        for start in lexicon.matches(text):
            word = _WORD.match(text, start).group()
            if after := _WORD.search(text, start + len(word)):
                out.add(f"{word} {after.group()}")
            if before := re.search(r"(\w+)\W*\Z", text[max(0, start - 60) : start]):
                out.add(f"{before.group(1)} {word}")
        return out

    rows = _counted(sample, of).where("good >= 3 and good >= 9 * bad")
    return {r.term for r in rows.collect()}


_LAST: list = [None, None]


def _made(terms: dict[str, float], exceptions: set[str]) -> Lexicon:
    """The lexicon, made once for the batches of a task."""
    key = (len(terms), hash(frozenset(terms.items())), frozenset(exceptions))
    if _LAST[0] != key:
        _LAST[:] = [key, Lexicon(terms, exceptions)]
    return _LAST[1]


def _weighed(rows: DataFrame, terms: dict[str, float], exceptions: set[str]) -> DataFrame:
    """rows with the weight x in place of text."""
    kept = [c for c in rows.columns if c != "text"]
    schema = rows.select(*kept).schema.add("x", "double")

    def run(batches):
        lexicon = _made(terms, exceptions)
        for batch in batches:
            x = [lexicon.weigh(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(x, pa.float64())], names=schema.names)

    return rows.mapInArrow(common.task(run), schema)


def score_of(x: Column, curve: tuple[float, float]) -> Column:
    a, b = curve
    return F.round(1 / (1 + F.exp(-(F.lit(float(a)) + F.lit(float(b)) * F.log1p(x)))), 9)


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    common.prepare(docs.sparkSession)
    terms, exceptions, curve = model
    weighed = _weighed(docs.select("doc_id", (fold_of() == 2).alias("held_out"), "text"), terms, exceptions)
    return weighed.select("doc_id", "held_out", score_of(F.col("x"), curve).alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the toxic ones."""
    common.prepare(docs.sparkSession)
    terms, exceptions, curve = fit(docs, labels)
    kept = docs.columns

    def run(batches):
        lexicon = _made(terms, exceptions)
        for batch in batches:
            x = np.array([lexicon.weigh(t.as_py()) for t in batch.column("text")])
            z = curve[0] + curve[1] * np.log1p(x)
            yield batch.select(kept).filter(pa.array(np.round(1 / (1 + np.exp(np.clip(-z, -700, 700))), 9) < CUT))

    return docs.mapInArrow(common.task(run), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents."""
    common.prepare(spark)
    docs = common.own(common.read(spark, sf_dir, "documents"), "doc_id", "text")
    return score(docs, fit(docs, common.own(common.read(spark, sf_dir, "labels"), "doc_id", "toxic")))
