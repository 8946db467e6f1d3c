"""Tokenizers and token statistics. An encoder maps texts to arrays of ids; the default one is a word vocabulary.

Vocabularies trained elsewhere come as files of the tokenizers library; training one counts words in Spark and merges
pairs on the driver, on counts of distinct words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.lineage import written

#: Special tokens, vocabulary size and least frequency of training.
SPECIALS = ("<|unk|>", "<|pad|>", "<|im_end|>", "<|im_system|>", "<|im_user|>", "<|im_assistant|>")
VOCAB_SIZE, MIN_FREQUENCY = 40_960, 5
#: Contexts that a term is encoded in.
PREFIX, SUFFIX = "这是", "的内容"
#: Bytes of words that share a table of codes.
CHUNK_BYTES = 8 << 20


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, and single other characters that are no space."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]"), F.lit(0))


def spaced(text: Column) -> Column:
    """The text whose parts between spaces and the controls 9 to 13 are its words(), in order."""
    return F.regexp_replace(F.lower(text), "[^\\s\\p{L}\\p{N}]", "\n$0\n")


def word_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """(word, n)."""
    return docs.select(F.explode(words(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(docs: DataFrame, column: str = "text", first_id: int = 1) -> DataFrame:
    """(word, n, id): words by falling frequency, then by word; id 0 is left for the end of a document."""
    return numbered(word_counts(docs, column), first_id)


def numbered(counts: DataFrame, first_id: int = 1) -> DataFrame:
    """(word, n, id) of (word, n): the sorted ranges are written once, and only their sizes meet in one task."""
    # The upper bits of the number are the range, the lower 33 the place in it.
    laid = written(counts.orderBy(F.desc("n"), "word").select("word", "n", F.monotonically_increasing_id().alias("place")))
    part = F.shiftright("place", 33)
    sizes = laid.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("part", before.alias("base"))
    at = F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1)
    return laid.withColumn("part", part).join(F.broadcast(base), "part").select("word", "n", (at + first_id).cast("int").alias("id"))


def encode_words(docs: DataFrame, vocab: DataFrame | None, key: str, column: str = "text", eos: int = 0, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(key, ids): ids of the words of each text in order and the end id; texts without a word have no row. key must be unique.

    vocab is (word, id), each word once, and words that it lacks are left out; None stands for the vocabulary of docs.
    Texts are cut into words once and written as codes of their chunk, a few megabytes of text with a table of its
    words; ids are found for these tables, so that what is shuffled are a chunk's distinct words and not its tokens, and
    a frequent word is one row of each chunk. Rows that share a key are merged by the places of their words.
    """
    texts = docs.select(F.col(key).alias("key"), spaced(F.col(column)).alias("words")).where("words <> ''")
    kind = texts.schema["key"].dataType.simpleString()
    coded = written(texts.mapInArrow(_chunks(chunk), f"chunk long, key {kind}, codes binary, at int, word string, n long"))
    own = coded.where("word is not null").select("chunk", "at", "word", "n")
    if vocab is None:
        vocab = numbered(own.groupBy("word").agg(F.sum("n").alias("n")))
    found = own.join(vocab.select("word", F.col("id").cast("int").alias("id")), "word").select(F.col("chunk").alias("of"), "at", "id")
    texts = coded.where("codes is not null").select("chunk", "key", "codes")
    made = texts.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_translated(eos), f"key {kind}, ids array<int>")
    if texts.groupBy("key").count().where("count > 1").head(1):
        placed = F.transform(F.collect_list("ids"), lambda x: F.transform(F.slice(x, 1, F.size(x) - 1), lambda i, at: F.struct(at.alias("at"), i.alias("id"))))
        made = made.groupBy("key").agg(F.concat(F.transform(F.array_sort(F.flatten(placed)), lambda x: x["id"]), F.array(F.lit(eos))).alias("ids"))
    return made.select(F.col("key").alias(key), "ids")


def _chunks(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts, as of spaced(), in chunks of at most limit bytes or one text: a row for each text and each distinct word."""

    def coded(name: int, keys: list, texts: list) -> Iterator[pa.RecordBatch]:
        lists, key = pc.ascii_split_whitespace(pa.concat_arrays(texts)), pa.concat_arrays(keys)
        table = lists.flatten().dictionary_encode()
        codes, past = table.indices.to_numpy().astype("<i4", copy=False), np.cumsum(pc.list_value_length(lists).to_numpy())
        # Texts that begin or end with a space have an empty part there.
        empty = pc.index(table.dictionary, pa.scalar("", table.dictionary.type)).as_py()
        if empty >= 0:
            kept = codes != empty
            codes, past = codes[kept], np.concatenate([[0], np.cumsum(kept)])[past]
        n = np.bincount(codes)
        at = np.flatnonzero(n)
        binary = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(np.concatenate([[0], past * 4]).astype(np.int32)), pa.py_buffer(codes)])
        columns = ["chunk", "key", "codes", "at", "word", "n"]
        none, chunk = lambda kind, rows: pa.nulls(rows, kind), lambda rows: pa.array(np.full(rows, name))
        yield pa.RecordBatch.from_arrays([chunk(len(key)), key, binary, *(none(kind, len(key)) for kind in (pa.int32(), pa.string(), pa.int64()))], columns)
        own = [pa.array(at.astype(np.int32)), table.dictionary.take(pa.array(at)).cast(pa.string()), pa.array(n[at])]
        yield pa.RecordBatch.from_arrays([chunk(len(at)), none(key.type, len(at)), none(pa.binary(), len(at)), *own], columns)

    def run(batches):
        name = TaskContext.get().partitionId() << 32
        keys, texts, size = [], [], 0
        for batch in batches:
            past = np.concatenate([[0], np.cumsum(pc.binary_length(batch["words"]).to_numpy(), dtype=np.int64)])
            i = 0
            while i < batch.num_rows:
                j = int(np.searchsorted(past, past[i] + limit - size, "right")) - 1
                if j <= i and not size:
                    j = i + 1
                if j > i:
                    keys.append(batch["key"].slice(i, j - i))
                    texts.append(batch["words"].slice(i, j - i))
                    size += int(past[j] - past[i])
                if j < batch.num_rows:
                    yield from coded(name, keys, texts)
                    name, keys, texts, size = name + 1, [], [], 0
                i = max(i, j)
        if keys:
            yield from coded(name, keys, texts)

    return run


def _translated(eos: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Ids for the codes of a chunk; codes without one are left out."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(texts["codes"].to_pylist()), "<i4")
        past = np.cumsum(pc.binary_length(texts["codes"]).to_numpy()) // 4
        at = found["at"].to_numpy()
        ids = np.zeros(max(codes.max(initial=0), at.max(initial=0)) + 1, np.int32)
        known = np.zeros(len(ids), bool)
        ids[at], known[at] = found["id"].to_numpy(), True
        kept = known[codes]
        ends = np.concatenate([[0], np.cumsum(kept)])[past]
        some = np.diff(ends, prepend=0) > 0
        ends = ends[some]
        offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
        values = np.insert(ids[codes[kept]], ends, eos).astype(np.int32)
        return pa.table({"key": texts["key"].filter(pa.array(some)), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))})

    return run


def file_encoder(spec: str, eos: int | None = None) -> Callable[[Column], Column]:
    """Encoder of a tokenizers file's content: no special tokens, nothing cut; eos, if given, ends each list that isn't empty."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(spec)
        some = texts.dropna()
        ids = [e.ids + ([eos] if eos is not None and e.ids else []) for e in made.encode_batch(some.tolist(), add_special_tokens=False)]
        return pd.Series(ids, index=some.index, dtype=object).reindex(texts.index)

    return encode


def in_context(spec: str) -> Callable[[Column], Column]:
    """Encoder of terms inside a neutral sentence, whose own tokens are cut off; alone if nothing is left. For short lists of terms."""

    @F.pandas_udf("array<string>")
    def encode(terms: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(spec)
        size = lambda t: len(made.encode(t, add_special_tokens=False).ids)
        head, tail = size(PREFIX), size(SUFFIX)

        def one(term):
            whole = made.encode(PREFIX + term + SUFFIX, add_special_tokens=False).tokens
            return whole[head : len(whole) - tail] or made.encode(term, add_special_tokens=False).tokens

        return terms.map(one, na_action="ignore")

    return encode


def with_offsets(spec: str) -> Callable[[Column], Column]:
    @F.pandas_udf("array<struct<piece:string,first:int,past:int>>")
    def encode(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(spec)
        return texts.map(lambda t: [{"piece": p, "first": a, "past": b} for e in [made.encode(t, add_special_tokens=False)] for p, (a, b) in zip(e.tokens, e.offsets)], na_action="ignore")

    return encode


# --- training ---


def pretokens(text: Column) -> Column:
    """Runs of one script's letters, single digits, runs of newlines, runs of spaces, and runs of anything else."""
    return F.regexp_extract_all(text, F.lit("\\p{IsHan}+|[\\p{L}&&[^\\p{IsHan}]]+|\\p{Nd}|\\n+| +|[^\\p{L}\\p{Nd}\\n ]+"), F.lit(0))


def train(docs: DataFrame, column: str = "text", size: int = VOCAB_SIZE, least: int = MIN_FREQUENCY, specials=SPECIALS) -> tuple[list[str], list[tuple[str, str]]]:
    """Vocabulary and merges of a BPE: words are counted in Spark, and the driver merges pairs of distinct words' symbols.

    Words below least and the characters of all words come from the counts; the driver holds distinct frequent words only.
    """
    counted = docs.select(F.explode(pretokens(F.col(column))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    letters = [r.c for r in counted.select(F.explode(F.split("w", "")).alias("c")).where("c <> ''").distinct().orderBy("c").collect()]
    table = [[list(r.w), r.n] for r in counted.where(F.col("n") >= least).where(F.length("w") > 1).orderBy("w").collect()]
    vocab, merges = [*specials, *letters], []
    pairs: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = {}

    def add(k: int, sign: int) -> None:
        symbols, n = table[k]
        for p in zip(symbols, symbols[1:]):
            pairs[p] += sign * n
            if sign > 0:
                where.setdefault(p, set()).add(k)

    for k in range(len(table)):
        add(k, 1)
    while len(vocab) < size and pairs:
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < least:
            break
        merges.append(best)
        vocab.append(best[0] + best[1])
        for k in where.pop(best):
            add(k, -1)
            symbols, out, i = table[k][0], [], 0
            while i < len(symbols):
                if tuple(symbols[i : i + 2]) == best:
                    out.append(best[0] + best[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            table[k][0] = out
            add(k, 1)
        pairs = +pairs
    return vocab, merges


def missing(spark, wanted: list[str], vocab: DataFrame) -> DataFrame:
    """Strings that the vocabulary lacks."""
    return spark.createDataFrame([(w,) for w in wanted], "word string").join(vocab, "word", "left_anti")


# --- statistics ---


def frequencies(tokens: DataFrame, column: str = "token") -> DataFrame:
    return tokens.groupBy(column).agg(F.count("*").alias("n"))


def visible_length(text: Column) -> Column:
    """Characters but for those of the separator categories."""
    return F.length(F.regexp_replace(text, "\\p{Z}", ""))


def length_distribution(tokens: DataFrame, column: str = "token") -> DataFrame:
    return tokens.groupBy(visible_length(F.col(column)).alias("chars")).agg(F.count("*").alias("n"))


def corpus_metrics(lines: DataFrame, tokens: DataFrame, vocab_size: int, column: str = "text", token: str = "token") -> DataFrame:
    """One row: totals, tokens per character and back, active vocabulary and its share, share of single characters, mean length."""
    chars = lines.agg(F.coalesce(F.sum(visible_length(F.col(column))), F.lit(0)).cast("long").alias("total_chars"))
    size = visible_length(F.col(token))
    made = tokens.agg(F.count("*").alias("total_tokens"), F.count_distinct(token).alias("active_vocab"), F.count_if(size == 1).alias("single"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("token_chars"))
    total, n = F.col("total_chars"), F.col("total_tokens")
    one = F.lit(1)
    # Both sides are single rows.
    return chars.crossJoin(F.broadcast(made)).select(
        "total_chars", "total_tokens", "active_vocab", (n / F.greatest(total, one)).alias("fertility"), (total / F.greatest(n, one)).alias("compression"), (F.col("active_vocab") / F.lit(vocab_size)).alias("vocab_coverage"),
        (F.col("single") / F.greatest(n, one)).alias("single_char_ratio"), (F.col("token_chars") / F.greatest(n, one)).alias("mean_token_chars"),
    )


def term_lines(lines: DataFrame, terms: DataFrame, most: int = 5, order: str = "line_no") -> DataFrame:
    """(term, order, text): for each term the first lines that contain it. The terms are a list that fits in memory by its definition."""
    return _first(lines.join(F.broadcast(terms), F.contains(F.col("text"), F.col("term"))), most, order)


def _first(rows: DataFrame, most: int, order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("term").orderBy(order))
    return rows.withColumn("at", place).where(F.col("at") <= most).select("term", order, "text")


def occurrences(text: Column, term: Column) -> Column:
    """0-based places of term in text, overlapping ones too; an empty term is at every place.

    text is split before each place of term, in one pass; the lengths of the pieces tell the places.
    """
    quoted = F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pieces = F.split(text, F.concat(F.lit("(?=\\Q"), quoted, F.lit("\\E)")), -1)
    start = F.struct(F.lit(0).alias("past"), F.array().cast("array<int>").alias("places"))
    places = F.aggregate(
        pieces,
        start,
        lambda a, x: F.struct((a["past"] + F.length(x)).alias("past"), F.concat(a["places"], F.array(a["past"])).alias("places")),
        lambda a: F.filter(a["places"], lambda i: (i > 0) | F.startswith(text, term)),
    )
    return F.when(F.length(term) == 0, F.sequence(F.lit(0), F.length(text))).otherwise(places)


def term_tokens(found: DataFrame, offsets: Column, order: str = "line_no") -> DataFrame:
    """Per term the most frequent number of tokens (the first seen of equal ones), its first pieces, and counts of all numbers."""
    each = found.withColumn("offsets", offsets).select("term", order, F.explode(occurrences(F.col("text"), F.col("term"))).alias("at"), "offsets")
    pieces = F.transform(F.filter("offsets", lambda x: (x["first"] >= F.col("at")) & (x["past"] <= F.col("at") + F.length("term"))), lambda x: x["piece"])
    cut = each.select("term", order, "at", pieces.alias("pieces")).where(F.size("pieces") > 0).withColumn("n", F.size("pieces"))
    counts = cut.groupBy("term", "n").agg(F.count("*").alias("k"), F.min(F.struct(order, "at", "pieces")).alias("first"))
    best = counts.groupBy("term").agg(
        F.max_by("n", F.struct("k", -F.col(f"first.{order}"), -F.col("first.at"))).alias("n_tokens"), F.max_by("first.pieces", F.struct("k", -F.col(f"first.{order}"), -F.col("first.at"))).alias("pieces"),
        F.sum("k").alias("occurrences"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("n", "k")))).alias("token_count_dist"),
    )
    return best.withColumn("fertility", F.col("n_tokens") / F.greatest(F.length("term"), F.lit(1))).orderBy(F.desc("n_tokens"), "term")
