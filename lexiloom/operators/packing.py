"""Packing of token lists into sequences of one length.

Only lengths decide where a token goes, so packing is planned on (order, length) rows: a streamed fold per group
gives segments (sequence, place, document, from, length), and the token lists are cut and put together by joins and
aggregations on all executors. One group packs in one order; several groups pack side by side and each discards its own tails.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequence length, least length of a medium document, sequences of a shard, share of training shards.
SEQ_LEN, SHORT_THRESHOLD, SHARD_SIZE, TRAIN_RATIO = 4096, 2048, 50_000, 0.99

SEGMENTS = "grp string, kind string, seq_no long, slot int, ord long, from int, len int"


def route(n: Column, seq_len: int = SEQ_LEN, threshold: int = SHORT_THRESHOLD) -> Column:
    """long, medium or short by length, the end token counted."""
    return F.when(n >= seq_len, "long").when(n >= threshold, "medium").otherwise("short")


def long_chunks(docs: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """(ord, chunk_no, ids): the whole chunks of long documents."""
    whole = docs.where(F.size("ids") >= seq_len)
    each = whole.select("ord", "ids", F.explode(F.sequence(F.lit(0), F.floor(F.size("ids") / seq_len).cast("int") - 1)).alias("chunk_no"))
    return each.select("ord", "chunk_no", F.slice("ids", F.col("chunk_no") * seq_len + 1, F.lit(seq_len)).alias("ids"))


def _running(docs: DataFrame, order: str, blocks: int) -> DataFrame:
    """docs with `before`, the sum of n of earlier rows, by sums of ordered blocks: only block totals meet in one task."""
    dealt = docs.repartitionByRange(blocks, order).withColumn("_block", F.spark_partition_id())
    totals = dealt.groupBy("_block").agg(F.sum("n").alias("t"))
    base = totals.withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_block", "base")
    own = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(base), "_block").withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(own), F.lit(0))).drop("_block", "base")


def pack_short(docs: DataFrame, seq_len: int = SEQ_LEN, order: str = "ord", blocks: int = 64) -> DataFrame:
    """(ord, seq_no, slot, from, len): greedy packing of short documents in order; the unfilled tail has full = false."""
    placed = _running(docs.select(order, F.col("n").cast("long").alias("n")), order, blocks).where("n > 0")
    total = placed.agg(F.max(F.col("before") + F.col("n")).alias("total"))
    first, last = F.floor(F.col("before") / seq_len), F.floor((F.col("before") + F.col("n") - 1) / seq_len)
    each = placed.select(order, "before", "n", F.explode(F.sequence(first, last)).alias("seq_no"))
    begin = F.greatest(F.col("before"), F.col("seq_no") * seq_len)
    end = F.least(F.col("before") + F.col("n"), (F.col("seq_no") + 1) * seq_len)
    cut = each.select(order, "seq_no", (begin - F.col("seq_no") * seq_len).cast("int").alias("slot"), (begin - F.col("before")).cast("int").alias("from"), (end - begin).cast("int").alias("len"))
    return cut.crossJoin(F.broadcast(total)).withColumn("full", (F.col("seq_no") + 1) * seq_len <= F.col("total")).drop("total")  # total is one row


class Fold:
    """Packing of one group: documents come by add() in order, segments go to out.

    A medium document starts a sequence and takes short tokens, waiting ones first, until it is full; the next
    medium document drops it if it isn't. Short documents and the rests of long ones fill a waiting medium one first
    and are then cut one after the other. While a medium one waits, no short token does.
    """

    def __init__(self, seq_len: int, threshold: int):
        self.size, self.threshold = seq_len, threshold
        self.longs = self.shorts = 0
        self.waiting: list[tuple[int, int, int]] = []
        self.short: list[tuple[int, int, int]] = []
        self.held = self.queued = self.discarded = 0
        self.out: list[tuple] = []

    def _emit(self, kind: str, parts: list[tuple[int, int, int]]) -> None:
        number = self.longs if kind == "long" else self.shorts
        slot = 0
        for doc, start, n in parts:
            self.out.append((kind, number, slot, doc, start, n))
            slot += n
        if kind == "long":
            self.longs += 1
        else:
            self.shorts += 1

    def _take(self, need: int) -> list[tuple[int, int, int]]:
        taken = []
        while need and self.short:
            doc, start, n = self.short[0]
            k = min(need, n)
            taken.append((doc, start, k))
            self.short[0:1] = [(doc, start + k, n - k)] if n > k else []
            need -= k
            self.queued -= k
        return taken

    def _settle(self) -> None:
        """Short tokens fill the waiting medium document, then whole short sequences."""
        if self.held:
            taken = self._take(self.size - self.held)
            self.waiting += taken
            self.held += sum(t[2] for t in taken)
            if self.held == self.size:
                self._emit("long", self.waiting)
                self.waiting, self.held = [], 0
        while self.queued >= self.size:
            self._emit("short", self._take(self.size))

    def add(self, doc: int, n: int) -> None:
        if n >= self.size:
            whole = n // self.size
            for k in range(whole):
                self._emit("long", [(doc, k * self.size, self.size)])
            start, rest = whole * self.size, n % self.size
        elif n >= self.threshold:
            self.discarded += self.held
            self.waiting, self.held = [(doc, 0, n)], n
            start = rest = 0
        else:
            start, rest = 0, n
        if rest:
            self.short.append((doc, start, rest))
            self.queued += rest
        self._settle()

    def finish(self) -> None:
        self.discarded += self.held + self.queued


def plan(docs: DataFrame, seq_len: int = SEQ_LEN, threshold: int = SHORT_THRESHOLD, group: Column | None = None) -> DataFrame:
    """Segments of all groups, and one row of kind `discarded` per group with the dropped tokens as its seq_no.

    docs has ord (unique) and n. Without group there is one, in one order; a group's rows stream through one task.
    """
    group = F.lit("") if group is None else group.cast("string")
    rows = docs.select(group.alias("grp"), F.col("ord").cast("long").alias("ord"), F.col("n").cast("long").alias("n")).where("n > 0")

    def run(batches):
        name, fold = None, None

        def flush(last: bool):
            if fold is None:
                return []
            if last:
                fold.finish()
                fold.out.append(("discarded", fold.discarded, 0, None, 0, 0))
            out, fold.out = [(name, *x) for x in fold.out], []
            return out

        made = []
        for pdf in batches:
            for g, o, n in zip(pdf["grp"], pdf["ord"], pdf["n"]):
                if g != name:
                    made += flush(True)
                    name, fold = g, Fold(seq_len, threshold)
                fold.add(int(o), int(n))
            made += flush(False)
            yield pd.DataFrame(made, columns=["grp", "kind", "seq_no", "slot", "ord", "from", "len"]).astype({"ord": "Int64"})
            made = []
        yield pd.DataFrame(flush(True), columns=["grp", "kind", "seq_no", "slot", "ord", "from", "len"]).astype({"ord": "Int64"})

    return rows.repartition("grp").sortWithinPartitions("grp", "ord").mapInPandas(run, SEGMENTS)


def materialize(segments: DataFrame, docs: DataFrame) -> DataFrame:
    """(grp, kind, seq_no, ids): whole sequences from segments and (ord, ids) rows; a sequence bounds its group."""
    cut = segments.where("kind <> 'discarded'").join(docs.select("ord", "ids"), "ord").select("grp", "kind", "seq_no", F.struct("slot", F.slice("ids", F.col("from") + 1, F.col("len")).alias("part")).alias("s"))
    return cut.groupBy("grp", "kind", "seq_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["part"])).alias("ids"))


def shards(sequences: DataFrame, order: str, size: int = SHARD_SIZE, seed: int = 42, *keys: str) -> DataFrame:
    """sequences with shard and place: shards of size sequences in order, shuffled inside a shard by a seeded hash.

    order must be dense from 0 within keys (as sequence numbers are), so no global sort is needed.
    """
    shard = F.floor(F.col(order) / size)
    place = F.row_number().over(Window.partitionBy(*keys, "shard").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(order).cast("string"))), order)) - 1
    return sequences.withColumn("shard", shard).withColumn("place", place)


def eval_count(n: Column, train_ratio: float = TRAIN_RATIO) -> Column:
    """Shards for evaluation: at least one; the product is one of doubles, rounded half to even."""
    return F.greatest(F.lit(1).cast("long"), F.bround(n.cast("double") * F.lit(1 - train_ratio).cast("double"), 0).cast("long"))


def split(shard_rows: DataFrame, seed: int = 42, train_ratio: float = TRAIN_RATIO, kind: str = "kind", shard: str = "shard") -> DataFrame:
    """shard_rows (one per shard) with split and split_no: eval shards are the first in a seeded order, for each kind alone."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(kind), F.col(shard).cast("string")))
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(key, shard))
    n = F.count("*").over(Window.partitionBy(kind))
    ranked = shard_rows.withColumn("_rank", rank).withColumn("_eval", eval_count(n, train_ratio))
    test = F.col("_rank") <= F.col("_eval")
    return ranked.withColumn("split", F.when(test, "eval").otherwise("train")).withColumn("split_no", F.when(test, F.col("_rank")).otherwise(F.col("_rank") - F.col("_eval")) - 1).drop("_rank", "_eval")


def sequence_count(files: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Sequences in shard files by their sizes in bytes."""
    return files.agg(F.coalesce(F.sum(F.floor(F.col("size") / (2 * seq_len))), F.lit(0)).cast("long").alias("sequences"))


def metadata(sequences: DataFrame, segments: DataFrame, tokenizer: str, sources: list[str], seq_len: int = SEQ_LEN, threshold: int = SHORT_THRESHOLD, shard_size: int = SHARD_SIZE, train_ratio: float = TRAIN_RATIO) -> DataFrame:
    """One row: settings, discarded tokens and their share, and shards, sequences and tokens of each kind and split.

    sequences has kind, split and shard.
    """
    used = sequences.agg(
        *(
            F.struct(F.count_distinct(F.when((F.col("kind") == k) & (F.col("split") == s), F.col("shard"))).alias("shards"), F.count_if((F.col("kind") == k) & (F.col("split") == s)).alias("sequences"), (F.count_if((F.col("kind") == k) & (F.col("split") == s)) * seq_len).alias("tokens")).alias(f"{k}_{s}")
            for k in ("long", "short")
            for s in ("train", "eval")
        ),
        F.count("*").alias("n"),
    )
    lost = segments.where("kind = 'discarded'").agg(F.coalesce(F.sum("seq_no"), F.lit(0)).alias("discarded_tokens"))
    tokens = F.col("n") * seq_len
    return used.crossJoin(F.broadcast(lost)).select(  # both are single rows
        F.current_timestamp().alias("created_at"), F.lit(tokenizer).alias("tokenizer"), F.lit(seq_len).alias("seq_len"), F.lit(threshold).alias("short_threshold"), F.lit(shard_size).alias("shard_size"), F.lit(train_ratio).alias("train_ratio"),
        F.array(*map(F.lit, sources)).alias("sources"), "discarded_tokens", (100 * F.col("discarded_tokens") / F.greatest(tokens + F.col("discarded_tokens"), F.lit(1))).alias("discarded_percent"),
        *(F.struct(F.col(f"{k}_train").alias("train"), F.col(f"{k}_eval").alias("eval")).alias(k) for k in ("long", "short")), F.struct(F.col("n").alias("sequences"), tokens.alias("tokens")).alias("total"),
    )
