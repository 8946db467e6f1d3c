"""Jaccard join of documents on word n-grams, by rare-first prefix filtering.

Texts with equal shingle sets are one class, known by a 64-bit digest of the set. A class's shingles are ordered rare
first, by counts from a fixed-size table of hashed counts over all texts (the order decides cost, never results), and
its prefix of n - ceil(t * n) + 1 shingles is emitted, once per task however many copies the task has. Classes meet on
prefix shingles (of which the smaller set must hold one in the shorter prefix that its own size allows), pass length
and positional filters, then a bound by parity bitmaps and a suffix filter on how their shingles spread over hash
ranges, and each pair is verified once on whole sets. Only components are wanted, so no group expands into all pairs:

1. each prefix shingle proposes a star from a centre that differs by shingle; verified stars give first components;
2. wherever a shingle still joins two components, its rows are tried against each other in blocks in numpy: a block
   with few pairs that pass the filters emits them, one with many emits its rows. In these dense blocks, parity bitmaps
   of whole sets bound the overlap, and ROUNDS times each class proposes the few that look nearest across components;
3. every pair that still crosses components and passes all filters is verified.

No pair of different components is left out, so the components are those of all links. Shingles that are hot, by
what their cell has beyond twice the median of all cells, are salted in step 1. Afterwards the blocks of a hot shingle
are cut by component, and blocks of one component never meet, so its rows are copied only where components meet.
Nothing of corpus size is collected. Sets for verification are made anew from the texts of the classes that occur; a
bitmap of fixed size keeps the others from the shuffle.

The count table has a fixed size, as a table of all shingles would have to be shuffled twice more. Where a corpus fills
all cells alike the order is that of hashes within the noise: more prefix shingles are shared then (about three times
as many, measured), never others left out.

Null doc_ids link with nothing (component_id null); null and wordless texts have no shingles and link with nothing;
rows with one doc_id are each judged by their own text; empty tables give empty results; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm import common
from lexiloom.llm.common import NOT_SPACE, Words

#: Words of a shingle, and the least similarity in hundredths.
WORDS, PERCENT = 5, 75
#: Cells of the count table as a power of two, and of one of its rows; it is broadcast with 4 bytes a cell.
CELL_BITS, BLOCK_BITS = 22, 15
#: Rows of one shingle that one group takes in step 1; hash ranges of the suffix filter; stars that a class joins.
GROUP, RANGES, STARS = 2000, 16, 2
#: Bits, as a power of two, of the map of documents whose sets are wanted.
MAP_BITS = 23
#: Rounds of step 2; rows of a block and pairs per row with which it counts as sparse.
ROUNDS, BLOCK, SPARSE = 1, 1024, 4


def shingles(data: np.ndarray, off: np.ndarray, k: int = WORDS):
    """The sorted distinct shingle hashes of each text."""
    words = Words(data, off, NOT_SPACE)
    hashes, first = words.runs(k)
    for i in range(len(off) - 1):
        if first[i + 1] > first[i]:
            yield np.unique(hashes[first[i] : first[i + 1]])
        else:
            own = words.hash[words.first[i] : words.first[i + 1]]
            if len(own):
                total = int(sum(int(h) * int(t) for h, t in zip(own, common._TERMS, strict=False)) + len(own)) % (1 << 64)
                yield common.mix(np.array([total], np.uint64))
            else:
                yield own


def _sets(batches):
    """(doc_id, set of shingle hashes) of all rows."""
    for batch, i, j, data, off in common.texts_of(batches):
        yield batch.column(0)[i:j], list(shingles(data, off))


def _digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and c (digest of the shingle set, null without shingles) of each row."""

    def run(batches):
        for ids, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n_shingles", "c"])

    return docs.mapInArrow(common.task(run), "doc_id long, n_shingles long, c long")


def _counts(docs: DataFrame) -> np.ndarray:
    """The count table: how many documents have a shingle whose hash falls in each cell."""
    width = 1 << BLOCK_BITS

    def partial(batches):
        table = np.zeros(1 << CELL_BITS, np.uint32)
        for _, sets in _sets(batches):
            for s in sets:
                # Some shingles of a text may fall in one cell.
                np.add.at(table, (s >> np.uint64(64 - CELL_BITS)).astype(np.int64), np.uint32(1))
        blocks = np.flatnonzero(table.reshape(-1, width).any(1))
        for b in blocks.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([table[b * width : (b + 1) * width].astype("<u4").tobytes()], pa.binary())], names=["block", "part", "cells"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, cells in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                row = np.frombuffer(cells.as_buffer(), "<u4")
                if b in sums:
                    # Cells stay at their largest number rather than begin anew.
                    sums[b] = np.minimum(sums[b].astype(np.uint64) + row, (1 << 32) - 1).astype("<u4")
                else:
                    sums[b] = row.copy()
        for b, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([0], pa.int32()), pa.array([row.tobytes()], pa.binary())], names=["block", "part", "cells"])

    schema = "block int, part int, cells binary"
    parts = docs.mapInArrow(common.task(partial), schema).repartition(64, "block", "part").mapInArrow(common.task(total), schema)
    table = np.zeros((1 << (CELL_BITS - BLOCK_BITS), width), np.uint32)
    # One row of each block comes to the driver, whatever the number of tasks.
    for row in parts.repartition(16, "block").mapInArrow(common.task(total), schema).collect():
        table[row.block] = np.frombuffer(row.cells, "<u4")
    return table.ravel()


def _need(n: int) -> int:
    """Least overlap of a set of n with any partner."""
    return (PERCENT * n + 99) // 100


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, c, place): the prefix shingles of each class, rare first; a class comes once per task.

    place holds n, the shingle's position and, if the shingle is hot, a salt from 1 on, which key's upper bits hold, too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    # What every cell has, rare shingles alone, is no sign of a hot one.
    usual = 2 * int(np.median(counts))

    def run(batches):
        table, seen = shared.value, set()
        for _, sets in _sets(batches):
            out, cells, sizes, names, totals, places = [], [], [], [], [], []
            for s in sets:
                if not len(s) or (c := _digest(s)) in seen:
                    continue
                seen.add(c)
                often = table[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                take = np.argsort(often, kind="stable")[: len(s) - _need(len(s)) + 1]
                out.append(s[take])
                cells.append(often[take])
                sizes.append(len(take))
                names.append(c)
                totals.append(len(s))
                places.append(np.arange(len(take)))
            if not out:
                continue
            h, often, sizes = np.concatenate(out), np.concatenate(cells).astype(np.int64), np.array(sizes)
            c = np.repeat(np.array(names, np.int64), sizes)
            salts = np.minimum(np.maximum(often - usual, 0) // GROUP + 1, 500)
            salt = np.where(salts > 1, (c.view(np.uint64) >> np.uint64(1)).astype(np.int64) % salts + 1, 0)
            place = np.repeat(np.array(totals, np.int64), sizes) << 36 | np.concatenate(places) << 9 | salt
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64) ^ salt << 50), pa.array(c), pa.array(place)], names=["key", "c", "place"])

    return docs.mapInArrow(common.task(run), "key long, c long, place long")


def _salt(place):
    return place.bitwiseAND(511)


def _may(a, b):
    """Length and positional filters for two places of one shingle."""
    n, m = F.shiftright(a, 36), F.shiftright(b, 36)
    i, j = F.shiftright(a, 9).bitwiseAND((1 << 27) - 1), F.shiftright(b, 9).bitwiseAND((1 << 27) - 1)
    return (PERCENT * n <= 100 * m) & (PERCENT * m <= 100 * n) & ((100 + PERCENT) * F.least(n - i, m - j) >= PERCENT * (n + m))


def _indexed(place):
    """Whether a shingle stands early enough for a link with a set that isn't smaller."""
    n, i = F.shiftright(place, 36), F.shiftright(place, 9).bitwiseAND((1 << 27) - 1)
    return (100 + PERCENT) * (n - i) >= 2 * PERCENT * n


def _bit(doc_id):
    return doc_id.bitwiseXOR(F.shiftrightunsigned(doc_id, MAP_BITS)).bitwiseAND((1 << MAP_BITS) - 1)


def _remade(docs: DataFrame, used: DataFrame, schema: str, make) -> DataFrame:
    """c and what make(set) gives, for each class of used (c, doc_id), from the texts of docs; for some others, too, and again for repeated rows."""
    bit = _bit(F.col("doc_id"))
    wanted = np.zeros(1 << MAP_BITS >> 3, np.uint8)
    for row in used.groupBy(F.floor(bit / 32768).alias("b")).agg(F.bitmap_construct_agg(bit % 32768).alias("m")).collect():
        wanted[row.b * 4096 : row.b * 4096 + 4096] = np.frombuffer(row.m, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        bits = shared.value
        for batch in batches:
            at = np.asarray(batch.column(0)).astype(np.uint64)
            at = ((at ^ (at >> np.uint64(MAP_BITS))) & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for _, sets in _sets([batch]) if batch.num_rows else ():
                made = [(_digest(s), *make(s)) for s in sets if len(s)]
                cells = list(zip(*made, strict=True)) or [[] for _ in range(len(names) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int64()), *(pa.array(c, k) for c, k in zip(cells[1:], kinds, strict=True))], names=["c", *names])

    kinds = [{"long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[x.split()[1]] for x in schema.split(", ")]
    return docs.where("doc_id is not null").mapInArrow(common.task(run), f"c long, {schema}")


def _parity(s: np.ndarray):
    """Bits that say whether an odd number of shingles falls on each; at least two for each shingle, a power of two."""
    size = max(64, 1 << int(2 * len(s) - 1).bit_length())
    bits = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return (np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(),)


def _named(c: DataFrame, reps: DataFrame) -> DataFrame:
    """(doc_id, c) of the distinct classes."""
    return c.distinct().join(reps, "c").select(F.col("rep").alias("doc_id"), "c")


def _near_enough(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length and positional filters, as in _may(), for all pairs of two lists of places."""
    n, m = (left >> 36)[:, None], (right >> 36)[None, :]
    i, j = ((left >> 9) & ((1 << 27) - 1))[:, None], ((right >> 9) & ((1 << 27) - 1))[None, :]
    return (PERCENT * n <= 100 * m) & (PERCENT * m <= 100 * n) & ((100 + PERCENT) * np.minimum(n - i, m - j) >= PERCENT * (n + m))


def _groups(rows: DataFrame) -> DataFrame:
    """(i, j, all): rows (h, c, place, part, size) of each shingle h in pairs of blocks of about BLOCK; all has the rows of both. size is a shingle's number of rows.

    Of a shingle with more rows, each part with over BLOCK has blocks of its own, which meet all but each other; the rest share blocks.
    """
    columns = ["c", "place", "part"]
    small = rows.where(F.col("size") <= BLOCK).groupBy("h").agg(F.collect_list(F.struct(*columns, F.lit(0).alias("block"))).alias("all")).select(F.lit(0).alias("i"), F.lit(0).alias("j"), "all")
    if not rows.where(F.col("size") > BLOCK).head(1):
        return small
    mine = rows.where(F.col("size") > BLOCK).withColumn("hp", F.struct("h", "part"))
    n, blocks = F.col("n"), F.ceil(F.col("n") / BLOCK)
    parts = common.cut(mine.groupBy("hp").agg(F.count("*").alias("n")).withColumn("h", F.col("hp.h")))
    rest = F.ceil(F.sum(F.when(n <= BLOCK, n).otherwise(0)) / BLOCK)
    totals = parts.groupBy("h").agg(rest.cast("int").alias("mixed"), (rest + F.sum(F.when(n > BLOCK, blocks).otherwise(0))).cast("int").alias("total"), F.count("*").alias("k"))
    before = F.sum("blocks").over(Window.partitionBy("h").orderBy("hp").rowsBetween(Window.unboundedPreceding, -1))
    large = parts.where(n > BLOCK).withColumn("blocks", blocks.cast("int")).withColumn("before", F.coalesce(before, F.lit(0)).cast("int")).select("hp", "blocks", "before")
    plan = common.spread(parts.join(large, "hp", "left"), common.cut(totals), "h", "k").select("hp", "n", "mixed", "total", "blocks", (F.col("mixed") + F.col("before")).alias("first"))
    dealt = common.spread(mine, common.cut(plan), "hp", "n")
    alone, number = F.col("first").isNotNull(), F.xxhash64("c")
    dealt = dealt.withColumn("block", F.when(alone, F.col("first") + F.pmod(number, "blocks")).otherwise(F.pmod(number, "mixed")).cast("int"))
    past = F.col("first") + F.col("blocks")
    none = F.array().cast("array<int>")
    others = F.when(alone, F.concat(F.when(F.col("first") > 0, F.sequence(F.lit(0), F.col("first") - 1)).otherwise(none), F.when(past < F.col("total"), F.sequence(past, F.col("total") - 1)).otherwise(none)))
    dealt = dealt.withColumn("other", F.explode(others.otherwise(F.sequence(F.lit(0), F.col("total") - 1)))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    pairs = dealt.repartition("h", "i", "j").groupBy("h", "i", "j").agg(F.collect_list(F.struct(*columns, "block")).alias("all")).select("i", "j", "all")
    return small.union(pairs)


def _blocks(batch):
    """(fields, first, past, i, j) of each row of a batch of _groups()."""
    lists = batch.column("all")
    flat = lists.flatten()
    off = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    for i, j, a, b in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), off.tolist(), off[1:].tolist(), strict=False):
        yield flat, a, b, i, j


def _crossing(left: DataFrame) -> DataFrame:
    """(u, v, g, part) from rows (h, c, place, part, size): pairs that cross parts and pass the filters, or, with null v, the rows of dense blocks g."""

    def run(batches):
        for batch in batches:
            us, vs, gs, parts = [], [], [], []
            for flat, a, b, i, j in _blocks(batch):
                c, place, part, block = (flat.field(k).to_numpy()[a:b] for k in ("c", "place", "part", "block"))
                left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
                hit = _near_enough(place[left], place[right]) & (part[left][:, None] != part[right][None, :])
                if i == j:
                    hit = np.triu(hit)
                many = int(hit.sum())
                if many <= SPARSE * (b - a):
                    x, y = np.nonzero(hit)
                    us.append(c[left[x]])
                    vs += c[right[y]].tolist()
                    gs.append(np.zeros(many, np.int64))
                    parts.append(np.zeros(many, np.int64))
                else:
                    keep = np.concatenate((left[hit.any(1)], right[hit.any(0)]))
                    keep = np.unique(keep)
                    us.append(c[keep])
                    vs += [None] * len(keep)
                    # The block's name: a digest of its rows.
                    gs.append(np.full(len(keep), int.from_bytes(hashlib.blake2b(np.sort(c[keep]).tobytes(), digest_size=8).digest(), "little", signed=True)))
                    parts.append(part[keep])
            if us:
                u, v = np.concatenate(us), pa.array(vs, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), v, pa.array(np.concatenate(gs), pa.int64()), pa.array(np.concatenate(parts), pa.int64())], names=["u", "v", "g", "part"])

    return _groups(left).mapInArrow(common.task(run), "u long, v long, g long, part long")


def _dense(rows: DataFrame, bitmaps: DataFrame, stars: int = 0) -> DataFrame:
    """(u, v): pairs of dense blocks (g, c, part) that cross parts and whose parity bitmaps allow a link; with stars, each class's best so many."""

    def run(batches):
        for batch in batches:
            us, vs = [], []
            for flat, a, b, i, j in _blocks(batch):
                c, n, part, block = (flat.field(k).to_numpy()[a:b] for k in ("c", "n", "part", "block"))
                cells = [np.frombuffer(x.as_buffer(), np.uint64) for x in flat.field("bits")[a:b]]
                left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
                size = np.array([len(x) for x in cells])
                score = np.full((len(left), len(right)), -1.0)
                for s in np.unique(size[left]):
                    for t in np.unique(size[right]):
                        x, y = np.flatnonzero(size[left] == s), np.flatnonzero(size[right] == t)
                        few = min(s, t)
                        # A longer bitmap folds onto a shorter one.
                        p = np.stack([np.bitwise_xor.reduce(cells[k].reshape(-1, few), axis=0) for k in left[x]])
                        q = np.stack([np.bitwise_xor.reduce(cells[k].reshape(-1, few), axis=0) for k in right[y]])
                        for k in range(len(x)):
                            apart = np.bitwise_count(p[k][None, :] ^ q).sum(1, dtype=np.int64)
                            both = n[left[x[k]]] + n[right[y]]
                            ok = (100 * (both - apart) >= PERCENT * (both + apart)) & (part[left[x[k]]] != part[right[y]])
                            score[x[k], y[ok]] = ((both - apart) / (both + apart))[ok]
                if stars:
                    k = min(stars, len(right))
                    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    x, y = np.repeat(np.arange(len(left)), k), best.ravel()
                    keep = score[x, y] >= 0
                    x, y = x[keep], y[keep]
                else:
                    x, y = np.nonzero(np.triu(score + 1) > 0 if i == j else score >= 0)
                us.append(c[left[x]])
                vs.append(c[right[y]])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], names=["u", "v"])

    # A dense block holds the rows of two blocks at most.
    groups = rows.join(bitmaps, "c").groupBy("g").agg(F.collect_list(F.struct("c", "part", "n", "bits", F.lit(0).alias("block"))).alias("all"))
    return groups.select(F.lit(0).alias("i"), F.lit(0).alias("j"), "all").mapInArrow(common.task(run), "u long, v long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


_BOUNDS = (np.arange(1, RANGES, dtype=np.uint64) << np.uint64(60)).astype(np.uint64)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link: a suffix filter on their spread over hash ranges, then the overlap itself."""
    both = len(x) + len(y)
    a, b = (np.diff(np.concatenate(([0], np.searchsorted(s, _BOUNDS), [len(s)]))) for s in (x, y))
    if (100 + PERCENT) * int(np.minimum(a, b).sum()) < PERCENT * both:
        return False
    merged = np.concatenate((x, y))
    merged.sort(kind="stable")
    same = int((merged[1:] == merged[:-1]).sum())
    return 100 * same >= PERCENT * (both - same)


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, bounded: bool = False) -> DataFrame:
    """Those of the distinct pairs (u, v) of classes whose sets are similar enough; sets are made anew for the classes that occur.

    Parity bitmaps go first, unless the pairs are bounded by them already.
    """
    used = common.cut(_named(pairs.select(F.col("u").alias("c")).union(pairs.select("v")), reps))
    sets = common.cut(_remade(docs, used, "n long, bits binary, hashes binary", lambda s: (len(s), *_parity(s), s.tobytes())))

    def joined(pairs: DataFrame, *columns: str) -> DataFrame:
        left, right = (sets.select(F.col("c").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in columns)) for k in ("u", "v"))
        return pairs.join(left, "u").join(right, "v").select("u", "v", *(f"{c}_{k}" for k in ("u", "v") for c in columns))

    def allowed(batches):
        for batch in batches:
            keep = []
            for n, a, m, b in zip(*(batch.column(k) for k in ("n_u", "bits_u", "n_v", "bits_v")), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                few = min(len(x), len(y))
                apart = int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, few), axis=0) ^ np.bitwise_xor.reduce(y.reshape(-1, few), axis=0)).sum())
                both = n.as_py() + m.as_py()
                keep.append(100 * (both - apart) >= PERCENT * (both + apart))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    near = pairs if bounded else joined(pairs, "n", "bits").mapInArrow(common.task(allowed), "u long, v long")

    def run(batches):
        for batch in batches:
            keep = [_similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in zip(batch.column("hashes_u"), batch.column("hashes_v"), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    out = common.cut(joined(near, "hashes").mapInArrow(common.task(run), "u long, v long"))
    common.release(used, sets)
    return out


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reached by links, itself included) of each row."""
    common.prepare(docs.sparkSession)
    docs = common.own(docs, "doc_id", "text")
    rows = common.cut(classes(docs))
    reps = common.cut(rows.where("doc_id is not null and c is not null").groupBy("c").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    every = prefixes(docs.where("doc_id is not null"), _counts(docs))

    # Step 1: shared prefix shingles, and stars from centres drawn by shingle.
    drawn = F.struct(F.xxhash64("c", "key").alias("r"), "c", "place")
    group = Window.partitionBy("key")
    near = common.cut(
        every.withColumns({"centre": F.min(drawn).over(group), "low": F.min("c").over(group), "high": F.max("c").over(group), "indexed": F.max(_indexed(F.col("place"))).over(group)})
        .where((F.col("indexed") & (F.col("low") != F.col("high"))) | (_salt(F.col("place")) > 0))
        .select((F.col("key").bitwiseXOR(F.shiftleft(_salt(F.col("place")), 50))).alias("h"), "c", "place", F.col("centre.c").alias("x"), F.col("centre.place").alias("at"))
    )
    stars = near.where("c <> x").where(_may(F.col("place"), F.col("at"))).select("c", "x")
    centres = near.where(_salt(F.col("place")) > 0).where("c = x").select("h", "c", "place")
    first = centres.groupBy("h").agg(F.min(F.struct(F.xxhash64("c", "h").alias("r"), "c", "place")).alias("b"))
    across = centres.join(first, "h").where("b.c <> c").where(_may(F.col("place"), F.col("b.place"))).select("c", F.col("b.c").alias("x"))
    met = stars.union(across).groupBy("c", "x").agg(F.count("*").alias("met"))
    best = met.withColumn("at", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("met"), "x"))).where(F.col("at") <= STARS)
    pairs = common.cut(best.select(F.least("c", "x").alias("u"), F.greatest("c", "x").alias("v")).distinct())
    links = _verified(pairs, docs, reps)
    parts = common.components(links)

    # Step 2: shingles that join components, and the best pairs of their dense blocks.
    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(parts, F.col("c") == F.col("node"), "left").withColumn("part", F.coalesce("component", "c")).drop("node", "component")

    own = placed(near.select("h", "c", "place"))
    crossed = common.cut(own.groupBy("h").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("size")).where("p <> q").select("h", "size", F.col("size").alias("k")))
    left = common.cut(common.spread(own, crossed, "h", "k"))
    found = common.cut(_crossing(left))
    dense = common.cut(found.where("v is null").select("g", F.col("u").alias("c")).distinct())
    tried, bitmaps = pairs, None
    if dense.head(1):
        used = common.cut(_named(dense.select("c"), reps))
        bitmaps = common.cut(_remade(docs, used, "n long, bits binary", lambda s: (len(s), *_parity(s))))
        for _ in range(ROUNDS):
            more = common.cut(_ordered(_dense(placed(dense), bitmaps, STARS)).join(tried, ["u", "v"], "left_anti"))
            links = links.union(_verified(more, docs, reps, bounded=True))
            parts = common.components(links)
            tried = tried.union(more)

    # Step 3: whatever still crosses components.
    more = found.where("v is not null").select("u", "v")
    if bitmaps is not None:
        more = more.union(_dense(placed(dense), bitmaps))
    more = common.cut(_ordered(more).join(tried, ["u", "v"], "left_anti"))
    links = links.union(_verified(more, docs, reps))
    parts = common.components(links)

    whole = reps.join(parts, F.col("c") == F.col("node"), "left").select("c", "rep", "copies", F.coalesce("component", "c").alias("part"))
    parts = common.cut(whole.groupBy("part").agg(F.min("rep").alias("component_id"), F.count("*").alias("k")))
    named = common.cut(common.spread(whole, parts, "part", "k").select("c", "component_id", "copies"))
    common.release(near, left, found, dense, more, pairs, reps, crossed, parts)
    return common.spread(rows, named, "c", "copies", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at a Jaccard similarity of 0.75 on five-word shingles."""
    return join_components(common.read(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS sh FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
z AS (SELECT r, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS c FROM s GROUP BY r),
k AS (SELECT c, min(r) AS r, min(doc_id) AS doc, any_value(n) AS n FROM z JOIN t USING (r) WHERE doc_id IS NOT NULL GROUP BY c),
m AS (SELECT c, doc, n, sh FROM k JOIN s USING (r)),
p AS (SELECT a.doc AS u, b.doc AS v FROM m a JOIN m b ON a.sh = b.sh AND a.c < b.c GROUP BY a.c, b.c, a.doc, b.doc, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
reach(a, b) AS (SELECT doc, doc FROM k UNION SELECT reach.a, l.v FROM reach JOIN l ON reach.b = l.u),
g AS (SELECT a AS doc, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, coalesce(z.n, 0) AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN coalesce(g.component, doc_id) END AS component_id
FROM t LEFT JOIN z USING (r) LEFT JOIN k ON z.c = k.c LEFT JOIN g ON g.doc = k.doc
"""
