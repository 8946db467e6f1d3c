"""Checks and application of model outputs, which come as tables of (key, response)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import pytext

KANA = "[ぁ-ゖァ-ヶー]"
ITEM = "array<struct<id:int,ja_title:string,zh_title:string,confidence:string,note:string>>"
#: Keys of an object under which a response may hold its list, the first one counting.
LISTS = ("items", "titles", "translations", "results")


def needs_retry(text: Column) -> Column:
    """Blank, or kana left over."""
    return (pytext.strip(text) == "") | text.rlike(KANA)


def check_patch(items: DataFrame, translations: DataFrame, key: str = "title") -> DataFrame:
    """(key, missing, extra, retry, ok): ids that only one side has, and those whose text must be asked for again."""
    a, b = items.select(key, "id", F.lit(True).alias("asked")), translations.select(key, "id", F.col("text").alias("t"), F.lit(True).alias("answered"))
    both = a.join(b, [key, "id"], "full_outer")
    ids = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("id"))))
    made = both.groupBy(key).agg(ids(F.col("answered").isNull()).alias("missing"), ids(F.col("asked").isNull()).alias("extra"), ids(F.col("answered") & F.coalesce(needs_retry(F.col("t")), F.lit(True))).alias("retry"))
    return made.withColumn("ok", (F.size("missing") == 0) & (F.size("extra") == 0) & (F.size("retry") == 0))


def parse_list(response: Column) -> Column:
    """The JSON of a response's list: itself, or the first list under the known keys; null if there is none."""
    v = F.try_parse_json(response)

    def as_list(x: Column) -> Column:
        return F.when(F.startswith(F.schema_of_variant(x), F.lit("ARRAY")), F.to_json(x))

    return F.coalesce(as_list(v), *(as_list(F.try_variant_get(v, f"$.{k}", "variant")) for k in LISTS))


def parse_items(response: Column) -> Column:
    return F.from_json(parse_list(response), ITEM)


def check_batches(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """(batch, reason): '' if a response has the batch's items, in order, with all fields and the same titles.

    asked has batch, id and ja_title; responses batch and response. Reasons come in the order: no list, count, ids, fields, title.
    """
    want = asked.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("id", "ja_title"))).alias("want"))
    got = responses.select("batch", parse_items(F.col("response")).alias("got"), parse_list(F.col("response")).alias("raw"))
    both = want.join(got, "batch", "left")
    fields = F.from_json("raw", "array<map<string,string>>")
    lacking = F.exists(fields, lambda m: F.size(F.array_except(F.array(*map(F.lit, ("id", "ja_title", "zh_title", "confidence", "note"))), F.map_keys(m))) > 0)
    reason = (
        F.when(F.col("got").isNull(), "no_list")
        .when(F.size("want") != F.size("got"), "count")
        .when(~F.transform("want", lambda x: x["id"].cast("int")).eqNullSafe(F.transform("got", lambda x: x["id"])), "ids")
        .when(F.coalesce(lacking, F.lit(True)), "fields")
        .when(~F.transform("want", lambda x: x["ja_title"]).eqNullSafe(F.transform("got", lambda x: x["ja_title"])), "title")
        .otherwise("")
    )
    return both.select("batch", reason.alias("reason"))


def accepted(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """Items of the batches that pass."""
    good = check_batches(asked, responses).where("reason = ''").select("batch")
    return responses.join(good, "batch", "left_semi").select("batch", F.inline(parse_items(F.col("response"))))


def text_or_raw(response: Column, field: str = "text") -> Column:
    """The field of a JSON response, the response itself if it isn't one."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(response), f"$.{field}", "string"), response)


def prompt(infobox: Column, lead: Column) -> Column:
    """An infobox map and lead paragraphs as one text."""
    lines = F.array_join(F.transform(F.map_entries(infobox), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return F.concat(lines, F.lit("\n\n"), F.array_join(lead, "\n"))


def fuse(articles: DataFrame, outputs: DataFrame) -> DataFrame:
    """(title, lead, stage): leads replaced by the list under `lead` in (title, response); without an infobox skip_fused, without an answer as before."""
    new = F.from_json(F.get_json_object("response", "$.lead"), "array<string>")
    joined = articles.join(outputs.select("title", new.alias("_new")), "title", "left")
    none = F.col("infobox").isNull() | (F.size("infobox") == 0)
    stage = F.when(none, "skip_fused").when(F.col("_new").isNotNull(), "fused").otherwise(F.col("stage"))
    return joined.select("title", F.when(~none & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("lead")).alias("lead"), stage.alias("stage"))


def number_titles(titles: DataFrame, done: DataFrame, size: int = 100) -> DataFrame:
    """(id, ja_title, batch) of the titles that aren't done, dense in order."""
    open_ = titles.select("ja_title").distinct().join(done.select("ja_title"), "ja_title", "left_anti")
    at = F.row_number().over(Window.orderBy("ja_title")) - 1
    return open_.withColumn("id", at).withColumn("batch", F.floor(F.col("id") / size))
