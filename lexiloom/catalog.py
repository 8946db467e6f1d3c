"""Registry of the engine's own queries and their SQL twins for DuckDB.

Inline rows are SQL that both engines understand. Where an oracle leaves something out (NFKC, unassigned characters), the driver's texts hold none of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import era, markdown, normalize
from lexiloom.operators import articles, blocks, books, catalogue, lengths, metrics, ngrams, packing, quality, tokens, translation
from lexiloom.plans import cleaning

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OPEN = quality.CleanConfig(min_chinese_ratio=0.0)

# --- cleaning ---


def _fractions_sql(t: str) -> str:
    for a, b in normalize.FRACTIONS.items():
        t = f"replace({t}, '{a}', '{b}')"
    return t


_NOISE_SQL = normalize.NOISE_CLASS.replace("\\\\", "\\")
_WS = r"\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LINES = r"regexp_replace(regexp_replace({}, '\r\n|[\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '\n\z', '')"


def _quotes_sql(t: str, mark: str, a: str, b: str) -> str:
    return f"array_to_string(list_transform(string_split({t}, '{mark}'), lambda x, i: CASE WHEN i = 1 THEN x WHEN i % 2 = 0 THEN '{a}' || x ELSE '{b}' || x END), '')"


CLEAN_SQL = rf"""
c1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace({_fractions_sql("coalesce(text, '')")}, '[\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2069}}\x{{ad}}\x{{feff}}\x{{2060}}\x{{fe00}}-\x{{fe0f}}]', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{{80}}-\x{{9f}}]', '', 'g'), '[\x{{2000}}-\x{{200a}}]', ' ', 'g') AS t FROM documents),
c2 AS (SELECT * REPLACE (regexp_replace(regexp_replace({_LINES.format("t")}, '([^ \n]) {{5,}}', '\1    ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t) FROM c1),
c3 AS (SELECT * REPLACE (array_to_string(list_transform(string_split({_LINES.format("t")}, chr(10)), lambda x: regexp_replace(x, '[{_WS}]+\z', '')), chr(10)) AS t) FROM c2),
c4 AS (SELECT * REPLACE (regexp_replace(regexp_replace(t, '\A[\n{_WS}]+', ''), '[\n{_WS}]+\z', '') AS t) FROM c3),
c5 AS (SELECT * REPLACE (translate(replace(regexp_replace(regexp_replace(t, '{_NOISE_SQL}', '', 'g'), '\.{{2,}}', '……', 'g'), chr(8252), '!!'), ',?!:;()', '，？！：；（）') AS t) FROM c4),
c6 AS (SELECT * REPLACE (replace(replace(regexp_replace(regexp_replace(t, '(\d)\.', '\1' || chr(57344), 'g'), '\.(\d)', chr(57344) || '\1', 'g'), '.', '。'), chr(57344), '.') AS t) FROM c5),
c7 AS (SELECT * REPLACE ({_quotes_sql("t", '"', "“", "”")} AS t) FROM c6),
cleaned AS (SELECT * REPLACE ({_quotes_sql("t", "''", "‘", "’")} AS t) FROM c7),
m1 AS (SELECT *, length(t) AS size, length(regexp_replace(t, '[\n{_WS}]+', '', 'g')) AS solid, length(regexp_replace(t, '[^\x{{4e00}}-\x{{9fff}}]+', '', 'g')) AS han,
  list_filter(string_split({_LINES.format("t")}, chr(10)), lambda x: regexp_replace(x, '[\n{_WS}]+', '', 'g') <> '') AS lines,
  len(list_filter(list_distinct(string_split(t, '')), lambda c: c <> chr(10) AND c <> '' AND contains(t, repeat(c, 21)))) > 0 AS repeated FROM cleaned),
m2 AS (SELECT *, CASE WHEN len(lines) > 0 THEN 1.0::DOUBLE - len(list_distinct(lines))::DOUBLE / len(lines)::DOUBLE END AS twice, CASE WHEN solid > 0 THEN han::DOUBLE / solid::DOUBLE END AS chinese FROM m1),
"""


def _judged(least: float) -> str:
    return f"""judged AS (SELECT *, CASE WHEN size < 200 THEN 'too_short' WHEN size > 100000 THEN 'too_long' WHEN repeated THEN 'repeated_chars' WHEN solid = 0 THEN 'empty_after_strip'
  WHEN chinese < {least} THEN 'chinese_ratio' WHEN twice > 0.3 THEN 'duplicate_lines' WHEN regexp_matches(t, '(?i)((请关注|扫码关注|微信公众号|点击链接|广告)|(版权所有|copyright\\s*©))') THEN 'block_pattern_matched' ELSE '' END AS fail_code FROM m2)
"""


@query("WITH " + CLEAN_SQL + _judged(0.0) + "SELECT doc_id, t AS clean_text, size::INT AS n FROM judged")
def clean_normalize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", normalize.normalize(F.coalesce("text", F.lit(""))).alias("clean_text"))
    return docs.withColumn("n", F.length("clean_text"))


@query("WITH " + CLEAN_SQL + _judged(0.0) + "SELECT source, fail_code, count(*) AS n, sum(CASE WHEN fail_code = '' THEN size ELSE 0 END)::BIGINT AS clean_chars FROM judged GROUP BY ALL")
def clean_fail_reason_counts(spark, sf_dir):
    return cleaning.by_reason(quality.clean(table(spark, sf_dir, "documents").select("source", "text"), config=OPEN), "source")


@query("WITH " + CLEAN_SQL + _judged(0.3) + "SELECT fail_code, count(*) AS n, sum(CASE WHEN fail_code = '' THEN size ELSE 0 END)::BIGINT AS clean_chars FROM judged GROUP BY ALL")
def clean_default_rejects(spark, sf_dir):
    return cleaning.by_reason(quality.clean(table(spark, sf_dir, "documents").select("text")))


@query("WITH " + CLEAN_SQL + _judged(0.0) + "SELECT doc_id, fail_code = '' AS passed, fail_code, CASE fail_code WHEN 'too_short' THEN size WHEN 'too_long' THEN size WHEN 'repeated_chars' THEN 20 WHEN 'duplicate_lines' THEN twice WHEN 'chinese_ratio' THEN chinese WHEN 'empty_after_strip' THEN 0 END::DOUBLE AS fail_value FROM judged")
def clean_fail_values(spark, sf_dir):
    return quality.clean(table(spark, sf_dir, "documents").select("doc_id", "text"), config=OPEN).select("doc_id", "passed", "fail_code", "fail_value")


@query("WITH " + CLEAN_SQL + _judged(0.0) + "SELECT source, count(*) FILTER (fail_code = '') AS passed, count(*) FILTER (fail_code <> '') AS filtered FROM judged GROUP BY source")
def clean_report(spark, sf_dir):
    return cleaning.report(quality.clean(table(spark, sf_dir, "documents").select("source", "text"), config=OPEN), "source")


@query("SELECT d.doc_id, l.quality::VARCHAR AS score FROM documents d JOIN labels l USING (doc_id) WHERE l.quality::DOUBLE >= 0.7")
def score_prefilter(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("score")), "doc_id")
    return cleaning.score_filter(scored)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def incremental_pending(spark, sf_dir):
    return cleaning.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


FRACTION_ROWS = "(VALUES (1, '¼ ⅒ cup', 'ab'), (2, '3.14 and x.y', 'he said \"yes\" and \"no\"'), (3, '`a` **b** [c](d)', '# T'), (4, 'a......b', '(x)')) AS t(id, a, b)"


@query(f"SELECT id, replace(replace(a, '¼', '1/4'), '⅒', '1/10') AS fractions, translate(b, ',?!:;()', '，？！：；（）') AS marks, {_quotes_sql('b', chr(34), '“', '”')} AS quoted FROM {FRACTION_ROWS}")
def normalize_literals(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM {FRACTION_ROWS}")
    return rows.select("id", normalize.fractions(F.col("a")).alias("fractions"), F.translate("b", normalize.HALF, normalize.FULL).alias("marks"), normalize.quotes(F.col("b")).alias("quoted"))


# --- lengths ---

_QUANTILES = ", ".join(f"round(quantile_cont(n, {p / 100}), 6) AS {lengths.name(p)}" for p in lengths.PERCENTILES)
_SIZES = "WITH r AS (SELECT source, length(text) AS n FROM documents) "


def _sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", F.length("text").alias("n"))


@query(_SIZES + "SELECT source, count(n) AS n, min(n)::INT AS min, avg(n) AS mean, median(n) AS median, max(n)::INT AS max, round(stddev_pop(n), 6) AS std FROM r GROUP BY source")
def length_summary(spark, sf_dir):
    return lengths.summary(_sizes(spark, sf_dir), "n", "source").withColumn("std", F.round("std", 6))


@query(_SIZES + f"SELECT {_QUANTILES} FROM r")
def length_percentiles(spark, sf_dir):
    made = lengths.percentiles(_sizes(spark, sf_dir))
    return made.select(*(F.round(c, 6).alias(c) for c in made.columns))


_EDGES = ", ".join(f"({a}, {b})" for a, b in zip(lengths.EDGES, lengths.EDGES[1:]))


@query(_SIZES + f"SELECT lo::BIGINT AS lo, hi::BIGINT AS hi, count(n) AS n, round(count(n) / (SELECT count(n) FROM r)::DOUBLE, 9) AS row_share, round(coalesce(sum(n), 0) / (SELECT sum(n) FROM r)::DOUBLE, 9) AS token_share FROM (VALUES {_EDGES}) e(lo, hi) LEFT JOIN r ON n >= lo AND n < hi GROUP BY lo, hi")
def length_histogram(spark, sf_dir):
    return lengths.histogram(_sizes(spark, sf_dir)).withColumn("row_share", F.round("row_share", 9)).withColumn("token_share", F.round("token_share", 9))


@query(_SIZES + "SELECT source, grouping(source)::INT AS is_total, count(n) AS n, " + ", ".join(f"round(quantile_cont(n, {p / 100}), 6) AS p{p}" for p in (50, 75, 90, 95, 99)) + ", round(avg((n > 2048)::INT), 9) AS over_share FROM r GROUP BY GROUPING SETS ((source), ())")
def length_by_source_and_total(spark, sf_dir):
    made = lengths.by_source_and_total(_sizes(spark, sf_dir))
    return made.select("source", "is_total", "n", *(F.round(f"p{p}", 6).alias(f"p{p}") for p in (50, 75, 90, 95, 99)), F.round("over_share", 9).alias("over_share"))


@query(_SIZES + "SELECT " + ", ".join(f"round(quantile_cont(n, {p / 100}), 6) AS p{p}" for p in (50, 75, 90, 95, 99)) + ", round(avg((n > 8000)::INT), 9) AS over_share FROM r")
def char_length_percentiles(spark, sf_dir):
    made = lengths.char_percentiles(_sizes(spark, sf_dir))
    return made.select(*(F.round(c, 9 if c == "over_share" else 6).alias(c) for c in made.columns))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id)) AS rn FROM documents) WHERE rn <= 3")
def sample_per_source(spark, sf_dir):
    return lengths.sampled(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], 3, 42, "doc_id")


# --- Markdown and n-grams ---

_MD_SQL = "text"
for _p, _r in ((r"```[\s\S]*?```", " "), (r"`[^`]+`", " "), (rf"(?m)^#{{1,6}}[\n{_WS}]+", ""), (r"!\[.*?\]\(.*?\)", " "), (r"\[.*?\]\(.*?\)", " "), (r"[*_]{1,3}", ""), (rf"(?m)^[-*_]{{3,}}[\n{_WS}]*$", " "), (r"\|", " ")):
    _MD_SQL = f"regexp_replace({_MD_SQL}, '{_p}', '{_r}', 'g')"


@query(f"SELECT doc_id, {_MD_SQL} AS plain FROM documents")
def strip_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", markdown.strip_markdown(F.col("text")).alias("plain"))


HAN_ROWS = "(VALUES (1, '织田信长是日本战国 的武将。信长'), (2, 'abc 日本 日本 **日本**'), (3, ''), (4, '一')) AS t(id, text)"


@query(f"""WITH s AS (SELECT unnest(regexp_extract_all({_MD_SQL}, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]+')) AS s FROM {HAN_ROWS}),
g AS (SELECT s, n, unnest(range(1, length(s) - n + 2)) AS i FROM s, (VALUES (2), (3), (4)) AS k(n))
SELECT substr(s, i, n) AS term, count(*) AS n FROM g GROUP BY 1""")
def han_ngrams(spark, sf_dir):
    return ngrams.frequencies(ngrams.han_ngrams(spark.sql(f"SELECT * FROM {HAN_ROWS}")))


_WORD_SQL = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT {_WORD_SQL} AS w FROM documents), g AS (SELECT w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2)
SELECT w[i] || ' ' || w[i + 1] AS term, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT 200""")
def word_ngrams_topk(spark, sf_dir):
    return ngrams.top(ngrams.frequencies(ngrams.word_ngrams(table(spark, sf_dir, "documents"), 2), 2), 200)


@query(f"""WITH g AS (SELECT DISTINCT unnest({_WORD_SQL}) AS term FROM documents), e AS (SELECT term, length(term) AS tokens, 1.0::DOUBLE * (length(term) // 2 + 1) / length(term) AS ratio FROM g)
SELECT round(avg(ratio), 9) AS mean_ratio, arg_max(term, (ratio, term)) AS worst, count(*) FILTER (ratio > 0.6) AS over FROM e""")
def ngram_efficiency(spark, sf_dir):
    terms = ngrams.word_ngrams(table(spark, sf_dir, "documents"), 1).distinct()
    made = ngrams.efficiency_summary(ngrams.efficiency(terms, F.floor(F.length("term") / 2) + 1), 0.6)
    return made.withColumn("mean_ratio", F.round("mean_ratio", 9))


# --- tokens ---

_TOKENS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')"
_TOKENS = f"WITH k AS (SELECT doc_id, source, unnest({_TOKENS_SQL}) AS token FROM documents) "


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens.words(F.col("text"))).alias("token"))


@query(_TOKENS + "SELECT token, count(*) AS n FROM k GROUP BY token")
def token_freq(spark, sf_dir):
    return tokens.frequencies(_tokens(spark, sf_dir))


@query(_TOKENS + "SELECT length(token)::INT AS chars, count(*) AS n FROM k GROUP BY 1")
def token_len_dist(spark, sf_dir):
    return tokens.length_distribution(_tokens(spark, sf_dir))


@query(_TOKENS + r""", c AS (SELECT sum(length(regexp_replace(text, '\p{Z}', '', 'g')))::BIGINT AS total_chars FROM documents),
t AS (SELECT count(*) AS total_tokens, count(DISTINCT token) AS active_vocab, count(*) FILTER (length(token) = 1) AS single, sum(length(token)) AS token_chars FROM k)
SELECT total_chars, total_tokens, active_vocab, total_tokens / total_chars::DOUBLE AS fertility, total_chars / total_tokens::DOUBLE AS compression, active_vocab / 65536::DOUBLE AS vocab_coverage,
single / total_tokens::DOUBLE AS single_char_ratio, token_chars / total_tokens::DOUBLE AS mean_token_chars FROM c, t""")
def corpus_token_metrics(spark, sf_dir):
    return tokens.corpus_metrics(table(spark, sf_dir, "documents").select("text"), _tokens(spark, sf_dir), 65536)


@query(_TOKENS + "SELECT token AS word, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token)::INT AS id FROM k GROUP BY token")
def word_vocabulary(spark, sf_dir):
    return tokens.vocabulary(table(spark, sf_dir, "documents"))


@query(f"""WITH k AS (SELECT doc_id, unnest({_TOKENS_SQL}) AS token, unnest(range(len({_TOKENS_SQL}))) AS rn FROM documents), v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM k GROUP BY token)
SELECT doc_id, md5(string_agg(id::VARCHAR, ',' ORDER BY rn) || ',0') AS digest, (count(*) + 1)::INT AS n FROM k JOIN v USING (token) GROUP BY doc_id""")
def encoded_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    made = tokens.encode_words(docs, None, "doc_id")
    return made.select("doc_id", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"), F.size("ids").alias("n"))


TERMS = "(VALUES ('tion'), ('the '), ('zzzzq'), ('ung')) AS t(term)"


@query(f"SELECT term, doc_id AS line_no, md5(text) AS digest FROM (SELECT term, doc_id, text, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS rn FROM documents, {TERMS} WHERE contains(text, term)) WHERE rn <= 5")
def term_lines_first5(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), "text")
    return tokens.term_lines(lines, spark.sql(f"SELECT * FROM {TERMS}")).select("term", "line_no", F.md5("text").alias("digest"))


@query("SELECT * FROM (VALUES ('ab', 2, 3::BIGINT, 1.0::DOUBLE), ('b', 1, 3::BIGINT, 1.0::DOUBLE)) AS t(term, n_tokens, occurrences, fertility)")
def term_token_mode(spark, sf_dir):
    found = spark.sql("SELECT * FROM (VALUES ('ab', 1, 'abxab'), ('ab', 2, 'cab'), ('b', 1, 'abxab'), ('b', 2, 'cab')) AS t(term, line_no, text)")
    offsets = F.transform(F.sequence(F.lit(0), F.length("text") - 1), lambda i: F.struct(F.substring(F.col("text"), i + 1, F.lit(1)).alias("piece"), i.alias("first"), (i + 1).alias("past")))
    return tokens.term_tokens(found, offsets).select("term", "n_tokens", "occurrences", "fertility")


@query("SELECT * FROM (VALUES ('##'), ('zzzzzzq')) AS t(word)")
def vocabulary_missing(spark, sf_dir):
    return tokens.missing(spark, ["the", "##", "zzzzzzq"], tokens.word_counts(table(spark, sf_dir, "documents")))


# --- packing ---

_L = 256
_N = f"(SELECT doc_id AS ord, len({_WORD_SQL}) + 1 AS n FROM documents)"


def _lengths(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), "\\s+", -1), lambda w: w != "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), words.alias("ids")).select("ord", "ids", (F.size("ids") + 1).alias("n"))


@query(f"SELECT CASE WHEN n >= {_L} THEN 'long' WHEN n >= {_L // 2} THEN 'medium' ELSE 'short' END AS kind, count(*) AS n FROM {_N} GROUP BY 1")
def pack_routes(spark, sf_dir):
    return _lengths(spark, sf_dir).groupBy(packing.route(F.col("n"), _L, _L // 2).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH w AS (SELECT doc_id AS ord, {_WORD_SQL} AS ids FROM documents) SELECT ord, c::INT AS chunk_no, md5(array_to_string(ids[c * {_L} + 1 : (c + 1) * {_L}], ' ')) AS digest FROM (SELECT ord, ids, unnest(range(len(ids) // {_L})) AS c FROM w)")
def pack_long_chunks(spark, sf_dir):
    return packing.long_chunks(_lengths(spark, sf_dir), _L).select("ord", "chunk_no", F.md5(F.array_join("ids", " ")).alias("digest"))


@query(f"""WITH p AS (SELECT ord, n, sum(n) OVER (ORDER BY ord) - n AS before, sum(n) OVER () AS total FROM {_N} WHERE n < {_L // 2}),
e AS (SELECT *, unnest(range((before // {_L})::BIGINT, ((before + n - 1) // {_L})::BIGINT + 1)) AS s FROM p)
SELECT ord, s AS seq_no, (greatest(before, s * {_L}) - s * {_L})::INT AS slot, (greatest(before, s * {_L}) - before)::INT AS "from", (least(before + n, (s + 1) * {_L}) - greatest(before, s * {_L}))::INT AS len, (s + 1) * {_L} <= total AS "full" FROM e""")
def pack_short_running_sum(spark, sf_dir):
    return packing.pack_short(_lengths(spark, sf_dir).where(F.col("n") < _L // 2), _L)


@query()
def pack_plan(spark, sf_dir):
    return packing.plan(_lengths(spark, sf_dir), _L, _L // 2)


@query(f"SELECT sum(n)::BIGINT AS tokens FROM {_N}")
def pack_conserves_tokens(spark, sf_dir):
    made = packing.plan(_lengths(spark, sf_dir), _L, _L // 2)
    return made.agg(F.sum(F.when(F.col("kind") == "discarded", F.col("seq_no")).otherwise(F.col("len"))).cast("long").alias("tokens"))


_SEQ = "(SELECT doc_id AS no FROM documents)"


@query(f"SELECT no, no // 64 AS shard, row_number() OVER (PARTITION BY no // 64 ORDER BY md5('42|' || no), no) - 1 AS place FROM {_SEQ}")
def shard_assign(spark, sf_dir):
    made = packing.shards(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("no")), "no", 64)
    return made.select("no", "shard", F.col("place").cast("long").alias("place"))


@query("""WITH s AS (SELECT k.kind, unnest(range(k.n)) AS shard FROM (VALUES ('long', 1), ('short', 50), ('other', 150), ('more', 250)) AS k(kind, n)),
r AS (SELECT kind, shard, row_number() OVER (PARTITION BY kind ORDER BY md5('42|' || kind || '|' || shard), shard) AS rank, count(*) OVER (PARTITION BY kind) AS n FROM s),
e AS (SELECT *, greatest(1, round_even(n * (1.0::DOUBLE - 0.99::DOUBLE), 0)::BIGINT) AS test FROM r)
SELECT kind, shard, CASE WHEN rank <= test THEN 'eval' ELSE 'train' END AS split, CASE WHEN rank <= test THEN rank ELSE rank - test END - 1 AS split_no FROM e""")
def train_eval_split(spark, sf_dir):
    kinds = spark.sql("SELECT kind, explode(sequence(0L, n - 1L)) AS shard FROM (VALUES ('long', 1), ('short', 50), ('other', 150), ('more', 250)) AS k(kind, n)")
    made = packing.split(kinds)
    return made.select("kind", "shard", "split", F.col("split_no").cast("long").alias("split_no"))


@query(f"SELECT sum((n * 2 * {_L} + 3) // (2 * {_L}))::BIGINT AS sequences FROM {_N}")
def shard_sequence_count(spark, sf_dir):
    return packing.sequence_count(_lengths(spark, sf_dir).select((F.col("n") * 2 * _L + 3).alias("size")), _L)


# --- catalogue ---

NAMES = "(VALUES ('1466年の日本'), ('1467年の日本'), ('1615年の日本'), ('1616年の日本'), ('1450年代の日本'), ('1460年代の日本'), ('1610年代の日本'), ('1620年代の日本'), ('戦国時代の武将'), ('武将の映画'), ('世界の歴史'), ('城')) AS t(name)"


@query("SELECT * FROM (VALUES ('exclude', 5::BIGINT, '1450年代の日本|1466年の日本|1616年の日本|1620年代の日本|世界の歴史'), ('include', 6::BIGINT, '1460年代の日本|1467年の日本|1610年代の日本|1615年の日本|戦国時代の武将|武将の映画'), ('review', 1::BIGINT, '城')) AS t(class, n, names)")
def category_classify(spark, sf_dir):
    return catalogue.classified(spark.sql(f"SELECT * FROM {NAMES}")).withColumn("names", F.array_join("names", "|"))


EDGES = "(VALUES ('a', 'b'), ('b', 'c'), ('c', 'a'), ('a', 'd'), ('d', 'c'), ('c', 'e'), ('e', 'f'), ('x', 'y')) AS t(parent, child)"


@query(f"WITH RECURSIVE r(name, depth) AS (SELECT 'a', 0 UNION ALL SELECT child, depth + 1 FROM r JOIN {EDGES} ON parent = name WHERE depth < 3) SELECT name, min(depth)::INT AS depth FROM r GROUP BY name")
def category_bfs(spark, sf_dir):
    return catalogue.category_tree(spark.sql(f"SELECT * FROM {EDGES}"), spark.sql("SELECT 'a' AS name"), 3)


@query("SELECT c_custkey::VARCHAR AS title, c_mktsegment AS lang, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS categories, coalesce(array_to_string(list_sort(list(o_orderpriority) FILTER (o_orderpriority IS NOT NULL))[1:5], '|'), '') AS first_five FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def article_categories_agg(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("title"), F.col("c_mktsegment").alias("lang"), F.lit("pending").alias("stage"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("title"), F.col("o_orderpriority").alias("category"))
    members = orders.join(people.select("title", "lang"), "title")
    return catalogue.pending_with_categories(people, members).withColumn("first_five", F.array_join("first_five", "|"))


ARTICLES = "(VALUES ('A', 'ja', 'pending'), ('B', 'ja', 'queued'), ('C', 'ja', 'fetched'), ('D', 'ja', 'fetch_failed')) AS t(title, lang, stage)"


@query("SELECT * FROM (VALUES ('A', 'ja', 'pending'), ('B', 'ja', 'queued'), ('C', 'ja', 'fetched'), ('D', 'ja', 'fetch_failed'), ('E', 'ja', 'pending')) AS t(title, lang, stage)")
def upsert_ignore(spark, sf_dir):
    members = spark.sql("SELECT * FROM (VALUES ('A', 'ja', 'x', 0), ('E', 'ja', 'x', 0), ('E', 'ja', 'x', 0), ('F', 'ja', 'x', 14)) AS t(title, lang, category, ns)")
    return catalogue.insert_members(spark.sql(f"SELECT * FROM {ARTICLES}"), members.select("title", "lang", "category").limit(0), members)[0]


@query("SELECT * FROM (VALUES ('A', 'ja', 'skip'), ('B', 'ja', 'fetched'), ('C', 'ja', 'fetched'), ('D', 'ja', 'fetch_failed')) AS t(title, lang, stage)")
def stage_update(spark, sf_dir):
    rows = catalogue.apply_decisions(spark.sql(f"SELECT * FROM {ARTICLES}"), spark.sql("SELECT 'A' AS title, 'ja' AS lang, false AS keep UNION ALL SELECT 'C', 'ja', true"))
    return catalogue.record_fetch(rows, spark.sql("SELECT 'B' AS title, 'ja' AS lang, true AS ok UNION ALL SELECT 'D', 'ja', false"))


REDIRECTS = "(VALUES ('C', 'ja', 'Cc', NULL), ('D', 'ja', 'Dd', 'part')) AS t(title, lang, canonical, tofragment)"


@query("SELECT 'C' AS alias_title, 'Cc' AS canonical_title, 'ja' AS lang")
def redirect_aliases(spark, sf_dir):
    return catalogue.aliases(spark.sql(f"SELECT * FROM {REDIRECTS}"))


@query("SELECT * FROM (VALUES ('A', 'ja', 'pending', NULL::INT, NULL, NULL::INT), ('B', 'ja', 'queued', NULL, NULL, NULL), ('C', 'ja', 'fetched', 1, 'Cc', 0), ('D', 'ja', 'fetch_failed', NULL, NULL, NULL)) AS t(title, lang, stage, is_redirect, redirect_to, redirect_has_anchor)")
def redirect_resolution(spark, sf_dir):
    rows = spark.sql(f"SELECT *, CAST(NULL AS INT) AS is_redirect, CAST(NULL AS STRING) AS redirect_to, CAST(NULL AS INT) AS redirect_has_anchor FROM {ARTICLES}")
    return catalogue.resolve_redirects(rows, spark.sql(f"SELECT * FROM {REDIRECTS}"))


@query("SELECT s_name AS name, row_number() OVER (ORDER BY s_name) - 1 AS id, (row_number() OVER (ORDER BY s_name) - 1) // 7 AS batch FROM supplier")
def batch_numbers(spark, sf_dir):
    made = catalogue.batches(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")), 7, "name")
    return made.select("name", F.col("id").cast("long").alias("id"), F.col("batch").cast("long").alias("batch"))


# --- pages ---


@query(r"SELECT page_id, trim(regexp_replace(h, '<[^>]*>', '', 'g')) AS heading FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS h FROM pages)")
def page_h_titles(spark, sf_dir):
    return articles.headings(table(spark, sf_dir, "pages").select("page_id", "html"), 1).select("page_id", "heading")


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS h FROM pages), t AS (SELECT trim(regexp_replace(h, '<[^>]*>', '', 'g')) AS title, page_id::VARCHAR AS file FROM h)
SELECT title, count(*) AS n, array_to_string(CASE WHEN count(*) <= 10 THEN list_sort(list(DISTINCT file)) ELSE list_sort(list(DISTINCT file))[1:5] END, ' | ') AS files FROM t GROUP BY title""")
def title_counts(spark, sf_dir):
    found = articles.headings(table(spark, sf_dir, "pages").select("page_id", "html"), 1)
    return catalogue.title_counts(found.select(F.col("heading").alias("title"), F.col("page_id").cast("string").alias("file")))


@query()
def html_clean_text(spark, sf_dir):
    return articles.page_text(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "visible_text")


@query()
def html_blocks(spark, sf_dir):
    page = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("title"), F.regexp_extract("html", "(?s)<article[^>]*>(.*)</article>", 1).alias("body"), "html")
    wrapped = F.concat(F.lit('<section data-mw-section-id="0"><p>lead</p></section><section data-mw-section-id="1"><h2>Page</h2>'), F.when(F.col("body") != "", F.col("body")).otherwise(F.col("html")), F.lit("</section>"))
    return articles.blocks(page.select("title", wrapped.alias("html")))


_ARTICLE = """<section data-mw-section-id="0"><table class="infobox"><tr><th>生誕</th><td>天文3年<br>5月</td></tr></table><p>主人公(仮)は"英雄"。</p></section>
<section data-mw-section-id="1"><h2>概要</h2><p>本文 です。</p><p>※注</p><section><h3>一覧</h3><ul><li>甲</li><li>乙</li></ul></section>
<section><h3>詳細</h3><ol><li>第一である。<ul><li>内である。</li></ul></li><li>第二である。</li></ol><blockquote title="題">句<br>詩—作者</blockquote><dl><dt>語</dt><dd>説明</dd><dd><ul><li>例</li></ul></dd></dl></section></section>
<section data-mw-section-id="2"><h2>脚注</h2><p>x</p></section>"""


def _article(spark) -> DataFrame:
    return articles.blocks(spark.createDataFrame([("記事", _ARTICLE)], "title string, html string"), ["脚注"])


@query("SELECT '記事' AS title, '# 記事' || chr(10) || chr(10) || '主人公（仮）は“英雄”。' || chr(10) || chr(10) || '## 概要' || chr(10) || '本文です。' || chr(10) || chr(10) || '### 詳細' || chr(10) || '1. 第一である。' || chr(10) || '  - 内である。' || chr(10) || '2. 第二である。' || chr(10) || chr(10) || '句' || chr(10) || '詩——作者' || chr(10) || chr(10) || '**語**' || chr(10) || '説明' AS markdown")
def render_markdown(spark, sf_dir):
    return blocks.to_markdown(_article(spark))


@query("SELECT * FROM (VALUES ('記事', 'l0', 'paragraph'), ('記事', 'b0', 'heading'), ('記事', 'b1', 'paragraph'), ('記事', 'b2', 'paragraph'), ('記事', 'b3', 'heading'), ('記事', 'b4.0', 'list_item'), ('記事', 'b4.1', 'list_item'), ('記事', 'b5', 'heading'), ('記事', 'b6.0', 'list_item'), ('記事', 'b6.0.0', 'list_item'), ('記事', 'b6.1', 'list_item'), ('記事', 'b7.t', 'quote_title'), ('記事', 'b7.q', 'quote'), ('記事', 'b7.c', 'citation'), ('記事', 'b8.0.dt', 'dt'), ('記事', 'b8.0.0', 'paragraph'), ('記事', 'b8.0.1.0', 'list_item')) AS t(title, id, kind)")
def flatten_article(spark, sf_dir):
    return blocks.flatten(_article(spark)).select("title", "id", "kind")


@query("SELECT '記事' AS title, true AS same, 17::BIGINT AS changed")
def patch_keeps_structure(spark, sf_dir):
    rows = _article(spark)
    items = blocks.flatten(rows).select("title", "id", F.concat(F.lit("译"), F.col("id")).alias("text"))
    new = blocks.patch(rows, items)
    same = blocks.fingerprint(rows).join(blocks.fingerprint(new).withColumnRenamed("structure", "after"), "title").select("title", (F.col("structure") == F.col("after")).alias("same"))
    return same.join(new.where("text like '译%'").groupBy("title").agg(F.count("*").alias("changed")), "title")


HEADS = "(VALUES ('t', 0, 'b0', 0, 'heading', 2), ('t', 1, 'b1', 0, 'heading', 3), ('t', 2, 'b2', 0, 'heading', 3), ('t', 3, 'b3', 0, 'paragraph', NULL), ('t', 4, 'b4', 0, 'heading', 2), ('t', 5, 'b5', 0, 'heading', 3), ('u', 0, 'b0', 0, 'heading', 2), ('u', 1, 'b1', 0, 'heading', 2), ('u', 2, 'b2', 0, 'list', NULL)) AS t(title, ord, path, depth, node_kind, level)"


@query("SELECT * FROM (VALUES ('t', 'b0'), ('t', 'b2'), ('t', 'b3'), ('u', 'b1'), ('u', 'b2')) AS t(title, path)")
def heading_prune(spark, sf_dir):
    return blocks.drop_empty_headings(spark.sql(f"SELECT * FROM {HEADS}")).select("title", "path")


DATES = "(VALUES (1, '天正10年6月2日（1582年6月21日）'), (2, '明治1年13月32日'), (3, '慶長５年９月15日'), (4, '12年3月'), (5, '')) AS t(id, text)"


@query("SELECT * FROM (VALUES (1, '天正十年六月二日（1582年6月21日）'), (2, '明治元年13月32日'), (3, '慶長五年九月十五日'), (4, '12年三月'), (5, '')) AS t(id, text)")
def era_dates(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {DATES}").select("id", era.normalize(F.col("text"), ["天正", "明治", "慶長"]).alias("text"))


# --- books ---

PAGES = """(VALUES ('K', 1, true, array(named_struct('type', 'title', 'content', '第一章 始まり'), named_struct('type', 'paragraph', 'content', '文が'))), ('K', 2, false, array(named_struct('type', 'paragraph', 'content', '続く'))),
 ('K', 3, false, array(named_struct('type', 'paragraph', 'content', '終わる。'), named_struct('type', 'dialogue', 'content', '「はい」'))), ('K', 4, false, array(named_struct('type', 'title', 'content', '12 次'), named_struct('type', 'paragraph', 'content', '"新"')))) AS t(book, page, first_paragraph_has_indent, paragraphs)"""


@query("SELECT 'K' AS book, '# K' || chr(10) || chr(10) || '## 始まり' || chr(10) || '文が続く終わる。' || chr(10) || chr(10) || '“はい”' || chr(10) || chr(10) || '### 次' || chr(10) || '“新“' AS markdown")
def book_continuation(spark, sf_dir):
    return books.to_markdown(spark.sql(f"SELECT * FROM {PAGES}"))


@query("SELECT * FROM (VALUES ('K', 1, true, '第一章 始まり|文が続く'), ('K', 2, true, ''), ('K', 3, false, '終わる。|「はい」'), ('K', 4, false, '12 次|\"新\"')) AS t(book, page, first_paragraph_has_indent, contents)")
def book_page_merge(spark, sf_dir):
    return books.merge_pages(spark.sql(f"SELECT * FROM {PAGES}")).select("book", "page", "first_paragraph_has_indent", F.array_join(F.transform("paragraphs", lambda p: p["content"]), "|").alias("contents"))


@query("SELECT * FROM (VALUES ('K', 1, true), ('K', 2, false), ('K', 3, false), ('K', 4, false)) AS t(book, page, first_paragraph_has_indent)")
def book_indents(spark, sf_dir):
    return books.decide_indents(spark.sql(f"SELECT * FROM {PAGES}")).select("book", "page", "first_paragraph_has_indent")


@query("""WITH f AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role AS fresh FROM conversations), p AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM f)
SELECT conv_id, part::BIGINT AS part, any_value(role) AS role, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM p GROUP BY conv_id, part""")
def conversation_fold(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("fresh", ~F.lag("role").over(order).eqNullSafe(F.col("role")))
    parts = rows.withColumn("part", F.sum(F.col("fresh").cast("long")).over(order))
    made = parts.groupBy("conv_id", "part").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("all"))
    return made.select("conv_id", "part", "role", F.md5(F.array_join(F.transform("all", lambda x: x["text"]), "\n")).alias("digest"))


# --- translation ---

ITEMS = "(VALUES ('A', 'l0', 'x'), ('A', 'b0', 'y'), ('B', 'l0', 'z')) AS t(title, id, text)"
ANSWERS = "(VALUES ('A', 'l0', '译'), ('A', 'b1', '文'), ('B', 'l0', 'かな')) AS t(title, id, text)"


@query("SELECT * FROM (VALUES ('A', 'b0', 'b1', '', false), ('B', '', '', 'l0', false)) AS t(title, missing, extra, retry, ok)")
def translation_patch_check(spark, sf_dir):
    made = translation.check_patch(spark.sql(f"SELECT * FROM {ITEMS}"), spark.sql(f"SELECT * FROM {ANSWERS}"))
    return made.select("title", *(F.array_join(c, ",").alias(c) for c in ("missing", "extra", "retry")), "ok")


RESPONSES = """(VALUES (0, '[{"id":0,"ja_title":"甲","zh_title":"甲","confidence":"high","note":""}]'), (1, '{"titles":[{"id":1,"ja_title":"丙","zh_title":"丙","confidence":"low","note":""}]}'), (2, '{"items":[{"id":2,"ja_title":"丙","zh_title":"丙"}]}'), (3, 'no json')) AS t(batch, response)"""


@query("SELECT * FROM (VALUES (0, ''), (1, 'title'), (2, 'fields'), (3, 'no_list')) AS t(batch, reason)")
def title_batch_check(spark, sf_dir):
    asked = spark.sql("SELECT * FROM (VALUES (0, 0, '甲'), (1, 1, '乙'), (2, 2, '丙'), (3, 3, '丁')) AS t(batch, id, ja_title)")
    return translation.check_batches(asked, spark.sql(f"SELECT * FROM {RESPONSES}"))


@query("SELECT * FROM (VALUES (1, 'good'), (2, 'plain'), (3, '{\"other\":1}')) AS t(id, text)")
def response_fallback(spark, sf_dir):
    rows = spark.sql("""SELECT * FROM (VALUES (1, '{"text":"good"}'), (2, 'plain'), (3, '{"other":1}')) AS t(id, response)""")
    return rows.select("id", translation.text_or_raw(F.col("response")).alias("text"))


@query("SELECT p_name AS ja_title, row_number() OVER (ORDER BY p_name) - 1 AS id, (row_number() OVER (ORDER BY p_name) - 1) // 100 AS batch FROM (SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 45))")
def pending_titles(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("ja_title"), "p_size")
    made = translation.number_titles(part, part.where("p_size > 45"))
    return made.select("ja_title", F.col("id").cast("long").alias("id"), F.col("batch").cast("long").alias("batch"))


# --- metrics ---


@query("""WITH w AS (SELECT event_type, ts, event_id, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS moving FROM events)
SELECT event_id, round(moving, 6) AS moving FROM w""")
def metric_moving_mean(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")))
    return metrics.moving_means(numbered, 10, "at", "event_type", column="value").select("event_id", F.round("moving", 6).alias("moving"))


@query("SELECT event_type, round(sum(value / 100 * user_id) / sum(user_id), 9) AS loss, sum(user_id)::BIGINT AS tokens, round(exp(sum(value / 100 * user_id) / sum(user_id)), 6) AS ppl FROM events GROUP BY event_type")
def metric_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("loss"), F.col("user_id").alias("tokens"))
    return metrics.weighted_loss(rows, "event_type").withColumn("loss", F.round("loss", 9)).withColumn("ppl", F.round("ppl", 6))


@query("SELECT l_orderkey AS seq, l_linenumber AS pos, coalesce(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), -100) AS label FROM lineitem")
def shifted_labels(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("token"), "l_suppkey")
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("seq").orderBy("pos", "token", "l_suppkey")))
    return metrics.shifted_labels(numbered, pos="at").select("seq", "pos", "label")


@query("SELECT 1145157120::BIGINT AS big, 802235904::BIGINT AS small")
def parameter_counts(spark, sf_dir):
    of = lambda *x: metrics.parameter_count(*(F.lit(v).cast("long") for v in x))
    return spark.range(1).select(of(40960, 1536, 36, 16, 4096).alias("big"), of(39936, 1536, 24, 16, 4096).alias("small"))


@query("WITH t AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY step ORDER BY prob DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (VALUES (1, 7, 0.5::DOUBLE), (1, 8, 0.25::DOUBLE), (1, 9, 0.125::DOUBLE), (1, 6, 0.125::DOUBLE), (2, 1, 1.0::DOUBLE)) AS r(step, token, prob)) SELECT step, token, prob / sum(prob) OVER (PARTITION BY step) AS prob FROM t WHERE before < 0.8")
def sampling_top_p(spark, sf_dir):
    rows = spark.sql("SELECT * FROM (VALUES (1, 7, 0.5D), (1, 8, 0.25D), (1, 9, 0.125D), (1, 6, 0.125D), (2, 1, 1.0D)) AS r(step, token, prob)")
    return metrics.top_p(rows, 0.8)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
