"""Benchmark decontamination with an FM-index per training shard.

Each worker cuts its partition into shards, builds an FM-index over a shard's words, finds every test phrase by
backward search with ranks from a wavelet matrix, locates the occurrences by walking to sampled suffix positions,
and merges them to removal spans. Words that no phrase has are one separator symbol, and stretches shorter than
the shortest phrase hold no occurrence, so neither is indexed; this is exact, whatever the corpus.

Phrases are broadcast in blocks of at most BLOCK_BYTES, which a worker turns once into rows of numbers; a larger
benchmark takes several passes over the texts. The driver reads the benchmark block by block and holds one at a time.
Null texts have no words; benchmark rows without words or without an id are no items; rows with equal ids or texts
are judged each for itself; empty tables give empty results or documents without hits; columns of any name pass
through remove() as they are, n_words, hit_words and items among them.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import common
from lexiloom.llm.common import ALNUM, Words

#: Words of a window; a shorter item is one window.
WINDOW = 13
#: Bytes of benchmark text in one pass; bytes of text and indexed words of a shard; distance of sampled suffixes.
BLOCK_BYTES, SHARD_BYTES, SHARD_WORDS, SAMPLE = 4 << 20, 16 << 20, 4 << 20, 8


class Phrases:
    """Windows of the items: distinct rows of symbols by length, and the items of each."""

    def __init__(self, items: list[tuple[str, str]]):
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        owner = np.array([number[i] for i, _ in items], np.int64)
        data, off = common.flat(pa.array([t for _, t in items], pa.string()))
        words = Words(data, off, ALNUM)
        self.vocabulary, symbols = np.unique(words.hash, return_inverse=True)
        symbols = symbols.astype(np.int32) + 1
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        size = np.diff(words.first)
        self.groups = []
        for n in np.unique(np.minimum(size[size > 0], WINDOW)).tolist():
            own = np.flatnonzero(size >= n if n == WINDOW else size == n)
            many = size[own] - n + 1
            # The first word of each window, and its item.
            start = np.repeat(words.first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            # Equal windows have equal digests of their symbols.
            digest = np.zeros(len(start), np.uint64)
            for k in range(n):
                digest += common.mix(symbols[start + k].astype(np.uint64)) * common._TERMS[k]
            _, first, which = np.unique(digest, return_index=True, return_inverse=True)
            pairs = np.unique(which * len(self.ids) + np.repeat(owner[own], many))
            rows = symbols[start[first][:, None] + np.arange(n)]
            self.groups.append((n, rows, (pairs % len(self.ids)).astype(np.int32), np.searchsorted(pairs // len(self.ids), np.arange(len(first) + 1))))
        self.shortest = min((g[0] for g in self.groups), default=0)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 if no phrase has it."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.near[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        found = self.vocabulary[at] == hashes[maybe]
        out[maybe[found]] = at[found] + 1
        return out


class FMIndex:
    """Of a sequence of symbols from 1 on, with 0 as separator; inside, they are one higher, and a unique 0 ends the text."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.append(text + 1, 0)
        n = len(text)
        order = self._sorted(text)
        self.bwt = text[order - 1]
        top = int(text.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top))))
        self.levels = []
        row = self.bwt
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (row >> bit) & 1
            total = np.zeros(n + 1, np.int32)
            np.cumsum(ones, out=total[1:])
            self.levels.append((bit, total, n - int(total[-1])))
            row = np.concatenate((row[ones == 0], row[ones == 1]))
        self.sampled = order % sample == 0
        self.sample_at = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = order[self.sampled]

    @staticmethod
    def _sorted(text: np.ndarray) -> np.ndarray:
        """Suffix array, by doubling the compared prefix until all ranks differ."""
        n = len(text)
        rank, step = text.astype(np.int64), 1
        while True:
            key = rank * (int(rank.max()) + 2)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            fresh = np.empty(n, np.int64)
            fresh[order] = np.concatenate(([0], np.cumsum(key[order[1:]] != key[order[:-1]])))
            rank = fresh
            if rank[order[-1]] == n - 1 or step >= n:
                return order
            step *= 2

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each position."""
        low, high = np.zeros_like(at), at
        for bit, total, zeros in self.levels:
            one = ((symbol >> bit) & 1) == 1
            a, b = total[low], total[high]
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return high - low

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each row of symbols."""
        rows = rows + 1
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.bwt), np.int64)
        alive = np.flatnonzero(rows.max(1) < len(self.before) - 1)
        dead = np.ones(len(rows), bool)
        dead[alive] = False
        high[dead] = 0
        for k in range(rows.shape[1] - 1, -1, -1):
            c = rows[alive, k]
            low[alive] = self.before[c] + self.rank(c, low[alive])
            high[alive] = self.before[c] + self.rank(c, high[alive])
            gone = low[alive] >= high[alive]
            high[alive[gone]] = low[alive[gone]]
            alive = alive[~gone]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, steps = np.zeros(len(rows), np.int64), 0
        rows, left = rows.copy(), np.arange(len(rows))
        while len(left):
            done = self.sampled[rows[left]]
            there = left[done]
            out[there] = self.samples[self.sample_at[rows[there]]] + steps
            left = left[~done]
            c = self.bwt[rows[left]]
            rows[left] = self.before[c] + self.rank(c, rows[left])
            steps += 1
        return out


_MADE: dict[int, Phrases] = {}


def _phrases(shared) -> Phrases:
    """The phrases of a broadcast block, made once in a process."""
    if shared.value[0] not in _MADE:
        _MADE.clear()
        _MADE[shared.value[0]] = Phrases(shared.value[1])
    return _MADE[shared.value[0]]


class Shard:
    """Texts of one index: adds slices, then finds the hit words of all."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.parts, self.words = phrases, [], []
        self.bytes = self.texts = self.symbols_held = 0

    def add(self, data: np.ndarray, off: np.ndarray) -> None:
        words = Words(data, off, ALNUM)
        symbols = self.phrases.symbols(words.hash)
        known = symbols > 0
        n = len(known)
        base = self.texts
        self.words.append(np.diff(words.first))
        self.texts += len(off) - 1
        self.bytes += len(data)
        if not n:
            return
        left, right = np.zeros(n, bool), np.zeros(n, bool)
        left[1:], right[:-1] = known[:-1], known[1:]
        begin = words.first[:-1][np.diff(words.first) > 0]
        left[begin] = False
        right[begin[1:] - 1] = False
        a, b = np.flatnonzero(known & ~left), np.flatnonzero(known & ~right) + 1
        long = b - a >= max(1, self.phrases.shortest)
        a, b = a[long], b[long]
        doc = np.searchsorted(words.first, a, "right") - 1
        for x, y, d in zip(a.tolist(), b.tolist(), doc.tolist(), strict=True):
            self.parts.append((base + d, x - int(words.first[d]), symbols[x:y].astype(np.int32)))
            self.symbols_held += y - x + 1

    @property
    def indexed(self) -> int:
        return self.symbols_held

    def hits(self) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, set[int]]]]:
        """Words of each text, and by text with hits its hit words' flags and its items."""
        counts = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        found: dict[int, tuple[np.ndarray, set[int]]] = {}
        if not self.parts or not self.phrases.groups:
            return counts, found
        text = np.concatenate([x for p in self.parts for x in (p[2], [0])]).astype(np.int64)
        size = np.array([len(p[2]) + 1 for p in self.parts])
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        index = FMIndex(text)
        for n, rows, items, first in self.phrases.groups:
            low, high = index.search(rows)
            many = high - low
            which = np.repeat(np.arange(len(rows)), many)
            if not len(which):
                continue
            at = index.locate(np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many))
            part = np.searchsorted(begin, at, "right") - 1
            for w, p, x in zip(which.tolist(), part.tolist(), (at - begin[part]).tolist(), strict=True):
                doc, word, _ = self.parts[p]
                if doc not in found:
                    found[doc] = (np.zeros(counts[doc], bool), set())
                found[doc][0][word + x : word + x + n] = True
                found[doc][1].update(items[first[w] : first[w + 1]].tolist())
        return counts, found


def _items(benchmark: DataFrame):
    """Items in blocks of bounded size."""
    rows = common.own(benchmark, "item_id", "text").where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text")
    block: list[tuple[str, str]] = []
    size = 0
    for i, text in rows.toLocalIterator():
        if size + len(text) > BLOCK_BYTES and block:
            yield block
            block, size = [], 0
        block.append((i, text))
        size += len(text)
    yield block


def _merged(old: tuple[bytes, str] | None, flags: np.ndarray | None, ids: set[str]) -> tuple[bytes, str]:
    have = set(filter(None, old[1].split(","))) if old else set()
    bits = np.frombuffer(old[0], np.uint8).astype(bool) if old and old[0] else None
    if flags is not None:
        bits = flags if bits is None else bits | flags
    return (b"" if bits is None else bits.astype(np.uint8).tobytes()), ",".join(sorted(have | ids))


def _free(docs: DataFrame, *names: str) -> list[str]:
    """names, lengthened until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def scan(docs: DataFrame, benchmark: DataFrame, keep_text: bool = True) -> DataFrame:
    """The rows of docs (without text, if it isn't kept) with n_words, hit_words (a byte for each word, empty if none is hit) and items (ids, sorted as strings, comma-joined).

    docs needs the column text. If it has one of the three names, the new column's name is lengthened by underscores.
    """
    spark = common.prepare(docs.sparkSession)
    out = docs
    added = _free(docs, "n_words", "hit_words", "items")
    given = docs.columns
    blocks = _items(benchmark)
    block = next(blocks)
    k = 0
    while block is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast((uuid.uuid4().int, block))
        columns = [c for c in given if keep_text or c != "text" or following is not None]

        def run(batches, shared=shared, columns=columns, again=k > 0):
            phrases = _phrases(shared)
            shard, held = Shard(phrases), []

            def done():
                counts, found = shard.hits()
                at = 0
                for batch in held:
                    n = batch.num_rows
                    names = batch.schema.names
                    old = list(zip(*(batch.column(names.index(c)).to_pylist() for c in added[1:]), strict=True)) if again else [None] * n
                    new = [_merged(old[i], *((x[0], {phrases.ids[j] for j in x[1]}) if (x := found.get(at + i)) else (None, set()))) for i in range(n)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in columns), pa.array(counts[at : at + n], pa.int64()), pa.array([x[0] for x in new], pa.binary()), pa.array([x[1] for x in new], pa.string())], names=[*columns, *added])
                    at += n

            for batch in batches:
                held.append(batch)
                data, off = common.flat(batch.column(batch.schema.names.index("text")))
                for i, j in common.slices(off):
                    shard.add(data[off[i] : off[j]], off[i : j + 1] - off[i])
                if shard.bytes >= SHARD_BYTES or shard.indexed >= SHARD_WORDS:
                    yield from done()
                    shard, held = Shard(phrases), []
            if held:
                yield from done()

        schema = out.select(*(f"`{c}`" for c in columns)).schema.add(added[0], "long").add(added[1], "binary").add(added[2], "string")
        out = out.mapInArrow(common.task(run), schema)
        block = following
        k += 1
    return out


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the removal spans cut out of text, n_chars set anew; texts of which no word stays go."""
    kept = docs.columns
    _, hit_words, _ = _free(docs, "n_words", "hit_words", "items")

    def cut(batches):
        for batch in batches:
            texts, sizes, stay = [], [], []
            flags = batch.column(hit_words).to_pylist()
            old = batch.column("text")
            for i, bits in enumerate(flags):
                text = old[i].as_py()
                if bits:
                    hit = np.frombuffer(bits, np.uint8).astype(bool)
                    raw = text.encode()
                    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
                    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                    out, at = [], 0
                    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                        out.append(raw[at : words.start[a]])
                        at = int(words.end[b - 1])
                    text = b"".join([*out, raw[at:]]).decode()
                    stay.append(not hit.all())
                else:
                    stay.append(True)
                texts.append(text)
                sizes.append(None if text is None else len(text))
            made = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in kept], names=kept).filter(pa.array(stay, pa.bool_()))

    return scan(docs, benchmark).mapInArrow(common.task(cut), docs.schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every whole text of documents."""
    found = scan(common.own(common.read(spark, sf_dir, "documents"), "doc_id", "text"), common.read(spark, sf_dir, "benchmark"), keep_text=False)

    def digest(batches):
        for batch in batches:
            hit = [sum(x) for x in batch.column("hit_words").to_pylist()]
            items = batch.column("items").to_pylist()
            words = batch.column("n_words").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x.split(",")) if x else 0 for x in items], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in items], pa.string()), pa.array([h > 0 and 20 * h >= w for h, w in zip(hit, words, strict=True)], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.mapInArrow(common.task(digest), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT r, i, n, item FROM dw JOIN iw USING (n, win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM t LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
