"""Secret scans with a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is parsed on the driver into a Boolean query of the trigrams that any match must
contain, in disjunctive form. The index holds, for every trigram of a query, the documents whose lower-cased text
has it. A rule's candidates are the intersections of its queries' postings, made by one join and one aggregation for all rules; they
are verified with the expression itself. Rules without mandatory trigrams (hex) scan every text.

Spans come from splitting a text at the matches: lengths of pieces and matches, summed up in order, give the places,
so the work is linear in a text's matches. No step collects more than one document's spans.

Null and empty texts have no spans; rows with equal ids or texts are scanned each for itself, null ids too; empty
tables give empty results; columns other than doc_id and text are not read by the scan.
"""

from __future__ import annotations

import re._constants as _c
import re._parser as _p
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm import common

#: Strings of one part of an expression that are told apart; more make the part count as unknown.
STRINGS = 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose group is shorter than least are dropped; base rules are counted in base_sha256.

    quick, if given, matches exactly what pattern and least keep, and finds the texts of a rule without trigrams.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    quick: str | None = None


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", "(?<![0-9a-f])[0-9a-f]{24,}", 0, 24, True, "[0-9a-f]{24}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
)


# --- Boolean trigram queries ---


def _strings(node) -> set[str] | None:
    """All strings that a part can match, lower-cased, if they are few."""
    op, arg = node
    if op is _c.LITERAL:
        return {chr(arg).lower()}
    if op is _c.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is _c.LITERAL:
                out.add(chr(x).lower())
            elif kind is _c.RANGE and x[1] - x[0] < STRINGS:
                out |= {chr(k).lower() for k in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= STRINGS else None
    if op is _c.SUBPATTERN:
        return _all(arg[3])
    if op is _c.BRANCH:
        parts = [_all(x) for x in arg[1]]
        if any(x is None for x in parts):
            return None
        out = set().union(*parts)
        return out if len(out) <= STRINGS else None
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT) and arg[1] is not _c.MAXREPEAT and arg[1] <= 8:
        once = _all(arg[2])
        if once is None:
            return None
        out = {"".join(x) for n in range(arg[0], arg[1] + 1) if len(once) ** n <= STRINGS for x in product(once, repeat=n)}
        return out if all(len(once) ** n <= STRINGS for n in range(arg[0], arg[1] + 1)) and len(out) <= STRINGS else None
    if op in (_c.AT, _c.ASSERT, _c.ASSERT_NOT):
        return {""}
    return None


def _all(parts) -> set[str] | None:
    out = {""}
    for node in parts:
        more = _strings(node)
        if more is None or len(out) * len(more) > STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _and(a: set[frozenset[str]], b: set[frozenset[str]]) -> set[frozenset[str]]:
    """Of disjunctive forms; {frozenset()} is always true. Sets that another one is part of say nothing."""
    both = {x | y for x in a for y in b}
    return {x for x in both if not any(y < x for y in both)}


def _grams(strings: set[str]) -> set[frozenset[str]]:
    made = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return {x for x in made if not any(y < x for y in made)}


def _query(parts) -> set[frozenset[str]]:
    out, run = {frozenset()}, {""}
    for node in parts:
        more = _strings(node)
        if more is not None and len(run) * len(more) <= STRINGS:
            run = {a + b for a in run for b in more}
            continue
        out, run = _and(out, _grams(run)), {""}
        if more is not None:
            run = set(more)
            continue
        op, arg = node
        if op is _c.SUBPATTERN:
            out = _and(out, _query(arg[3]))
        elif op is _c.BRANCH:
            out = _and(out, set().union(*(_query(x) for x in arg[1])))
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT) and arg[0] > 0:
            out = _and(out, _query(arg[2]))
    return _and(out, _grams(run))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case trigrams, one of which any match contains whole; empty if nothing is mandatory."""
    out = _query(_p.parse(pattern))
    return [] if frozenset() in out else sorted(out, key=sorted)


# --- index and candidates ---


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id): postings of the given trigrams in lower-cased texts; null ids have postings, too."""
    low = docs.where("text is not null").select("doc_id", F.lower("text").alias("low"))
    has = F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams))
    return low.select("doc_id", F.explode(F.array_compact(has)).alias("trigram")).distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): documents whose postings satisfy rules' queries, by intersection per set of trigrams."""
    rows = [(r.kind, k, t, len(grams)) for r in rules for k, grams in enumerate(trigram_query(r.pattern)) for t in sorted(grams)]
    wanted = index.sparkSession.createDataFrame(rows, "kind string, part int, trigram string, need long")
    met = index.join(F.broadcast(wanted), "trigram").groupBy("doc_id", "kind", "part", "need").agg(F.count("*").alias("n")).where("n = need")
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _found(rule: Rule, number: int, text: Column) -> Column:
    """(kind, i, gap, size, ok) of a rule's matches in order: characters before it since the last one, its own, and whether it counts."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("a"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("b"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("c"))
    matches = F.filter(zipped, lambda x: x["b"].isNotNull())
    return F.transform(
        matches,
        lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), F.length(x["a"]).alias("gap"), F.length(x["b"]).alias("size"), (F.length(x["c"]) >= rule.least).alias("ok")),
    )


_NONE = "array<struct<kind:int,i:int,gap:int,size:int,ok:boolean>>"


def marked(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the column `lexiloom found`: the matches of all rules."""
    grams = sorted({t for r in rules for q in trigram_query(r.pattern) for t in q})
    own = common.own(docs, "doc_id", "text")
    index = common.cut(build_index(own, grams))
    some = common.cut(candidates(index, rules).select(F.col("doc_id").alias("lexiloom id"), F.col("kinds").alias("lexiloom kinds")))
    common.release(index)
    joined = docs.join(some, docs["doc_id"].eqNullSafe(F.col("`lexiloom id`")), "left")
    text = docs["text"]
    parts = []
    for number, rule in enumerate(rules):
        may = F.array_contains("`lexiloom kinds`", rule.kind) if trigram_query(rule.pattern) else text.rlike(rule.quick or rule.pattern)
        parts.append(F.when(may, _found(rule, number, text)).otherwise(F.array().cast(_NONE)))
    return joined.withColumn("lexiloom found", F.concat(*parts)).drop("lexiloom id", "lexiloom kinds")


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with one line per match that counts (or one with null start): kind, start, end; rows are told apart by keys."""
    each = rows.select("*", F.explode_outer("lexiloom found").alias("m")).drop("lexiloom found")
    order = Window.partitionBy(*keys, "m.kind").orderBy("m.i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(order)
    return each.withColumn("end", end).select(*(c for c in each.columns if c != "m"), F.when(F.col("m.ok"), F.struct((F.col("end") - F.col("m.size")).alias("start"), F.col("m.kind").alias("kind"), F.col("end").alias("end"))).alias("span"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (start, kind, end) in order, of each row; kind is the rule's number."""
    common.prepare(docs.sparkSession)
    rows = marked(common.own(docs, "doc_id", "text"), rules).withColumn("row", F.monotonically_increasing_id()).drop("text")
    return _placed(rows, ["row"]).groupBy("row", "doc_id").agg(F.sort_array(F.collect_list("span")).alias("spans")).drop("row")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span in text replaced by mark, n_chars set anew where that happened."""
    common.prepare(docs.sparkSession)
    every = marked(docs, rules)
    clean = every.where("text is null or size(`lexiloom found`) = 0").drop("lexiloom found")
    dirty = every.where("text is not null and size(`lexiloom found`) > 0").withColumn("lexiloom row", F.monotonically_increasing_id())
    columns = [f"`{c}`" for c in docs.columns]
    whole = dirty.select("lexiloom row", "lexiloom found", F.struct(*columns).alias("doc"))
    spans = _placed(whole, ["`lexiloom row`"]).where("span is not null")
    before = Window.partitionBy("`lexiloom row`").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("`lexiloom row`", "span", F.coalesce(F.max("span.end").over(before), F.lit(0)).alias("past"))
    cuts = spans.groupBy("`lexiloom row`").agg(F.sort_array(F.collect_list(F.struct("span", "past"))).alias("cuts"))
    joined = whole.drop("lexiloom found").join(cuts, "lexiloom row", "left")
    text = F.col("doc.text")
    pieces = F.transform("cuts", lambda x: F.when(x["span"]["start"] >= x["past"], F.concat(F.substring(text, x["past"] + 1, x["span"]["start"] - x["past"]), F.lit(mark))).otherwise(""))
    rest = F.array_max(F.transform("cuts", lambda x: x["span"]["end"]))
    new = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), F.substring(text, (rest + 1).cast("int"), F.length(text))))
    made = joined.select("doc", new.alias("new"), F.col("cuts").isNotNull().alias("cut"))
    fields = {"text": F.col("new"), "n_chars": F.when(F.col("cut"), F.length("new").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return clean.unionByName(made.select(*((fields.get(c) if fields.get(c) is not None else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns)))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    found = scan(common.read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    names = F.array(*(F.lit(r.kind) for r in RULES))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


#: RE2 has no look-behind; a run of [0-9a-f] is cut at its whole length, so short runs are matched and dropped.
OP4_SQL = r"""
WITH rules(kind, n, pattern, g, least) AS (VALUES
  ('assign', 0, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 20),
  ('hex', 2, '[0-9a-f]+', 0, 24),
  ('pem', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 0),
  ('github', 4, 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 0),
  ('slack', 5, 'xox[abprs]-[A-Za-z0-9-]{10,}', 0, 0),
  ('stripe', 6, '[rs]k_live_[A-Za-z0-9]{16,}', 0, 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT r, kind, n, least, string_split_regex(text, pattern) AS a,
        CASE n WHEN 0 THEN regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0)
               WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) WHEN 2 THEN regexp_extract_all(text, '[0-9a-f]+', 0)
               WHEN 3 THEN regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0) WHEN 4 THEN regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36,}', 0)
               WHEN 5 THEN regexp_extract_all(text, 'xox[abprs]-[A-Za-z0-9-]{10,}', 0) ELSE regexp_extract_all(text, '[rs]k_live_[A-Za-z0-9]{16,}', 0) END AS b,
        CASE n WHEN 0 THEN regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) END AS c
      FROM d, rules),
e AS (SELECT r, kind, n, least, unnest(range(1, len(b) + 1)) AS i, unnest(a[1:len(b)]) AS gap, unnest(b) AS hit, unnest(coalesce(c, b)) AS own FROM m WHERE len(b) > 0),
f AS (SELECT r, kind, n, least, length(own) AS own, length(hit) AS size, sum(length(gap) + length(hit)) OVER (PARTITION BY r, n ORDER BY i) AS stop FROM e),
s AS (SELECT r, kind, n, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM f WHERE own >= least),
t AS (SELECT r, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex,
        coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, n) FILTER (n < 3), '') AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, n) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (r)
"""
