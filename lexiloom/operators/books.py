"""Book pages: paragraphs that go on over page ends, and Markdown of whole books.

Pages are rows (book, page, first_paragraph_has_indent, paragraphs array<struct<type, content>>).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARAGRAPHS = "array<struct<type:string,content:string>>"
#: Heading patterns with their levels, the first match counting; the last one matches everything.
HEADINGS = (("第(?:[一二三四五六七八九]十[一二三四五六七八九]?|十[一二三四五六七八九]?|[一二三四五六七八九])章\\s+", 2), ("\\d+\\s+", 3), ("", 4))


def merge_pages(pages: DataFrame) -> DataFrame:
    """pages with a first paragraph moved to the end of the page before where it goes on there.

    That is so if the indent flag is false, both pages have paragraphs at that time and the last one before is a
    paragraph. An emptied page takes nothing, so pages are folded in order; they stream through a task book by book.
    """

    def run(batches):
        held: dict | None = None

        def rows(x):
            return pd.DataFrame([x] if x else [], columns=["book", "page", "first_paragraph_has_indent", "paragraphs"])

        for pdf in batches:
            done = []
            for book, page, indent, paragraphs in zip(pdf["book"], pdf["page"], pdf["first_paragraph_has_indent"], pdf["paragraphs"]):
                now = {"book": book, "page": page, "first_paragraph_has_indent": None if pd.isna(indent) else bool(indent), "paragraphs": [dict(p) for p in paragraphs] if paragraphs is not None else []}
                if held is not None and held["book"] == book and now["first_paragraph_has_indent"] is False and held["paragraphs"] and now["paragraphs"] and held["paragraphs"][-1]["type"] == "paragraph":
                    held["paragraphs"][-1]["content"] = (held["paragraphs"][-1]["content"] or "") + (now["paragraphs"].pop(0)["content"] or "")
                    now["first_paragraph_has_indent"] = True
                if held is not None:
                    done.append(held)
                held = now
            yield pd.DataFrame(done, columns=["book", "page", "first_paragraph_has_indent", "paragraphs"]).astype({"first_paragraph_has_indent": "boolean"})
        yield rows(held).astype({"first_paragraph_has_indent": "boolean"})

    own = pages.select("book", F.col("page").cast("int").alias("page"), "first_paragraph_has_indent", "paragraphs")
    return own.repartition("book").sortWithinPartitions("book", "page").mapInPandas(run, f"book string, page int, first_paragraph_has_indent boolean, paragraphs {PARAGRAPHS}")


def quotes(text: Column) -> Column:
    """Straight double quotes and corner brackets to curly ones; a straight one always opens."""
    return F.replace(F.replace(F.replace(text, F.lit('"'), F.lit("“")), F.lit("「"), F.lit("“")), F.lit("」"), F.lit("”"))


def heading(content: Column, patterns=HEADINGS) -> tuple[Column, Column]:
    """Level and text of a title: the first pattern that matches at its begin, cut off; 2 and the whole if none does."""
    level, text = F.lit(2), content
    for p, k in reversed(patterns):
        hit = content.rlike(f"^(?:{p})")
        level = F.when(hit, k).otherwise(level)
        text = F.when(hit, F.regexp_replace(F.regexp_replace(F.regexp_replace(content, f"^(?:{p})", ""), "^[\\s　]+", ""), "[\\s　]+$", "")).otherwise(text)
    return level, text


def to_markdown(pages: DataFrame, patterns=HEADINGS) -> DataFrame:
    """(book, markdown): title, headings and bodies. A page's first block without an indent goes on the last body since the last title."""
    each = pages.select("book", "page", F.coalesce("first_paragraph_has_indent", F.lit(True)).alias("indent"), F.posexplode("paragraphs").alias("i", "p")).where("p.type in ('title', 'paragraph', 'dialogue')")
    content = quotes(F.col("p.content"))
    rows = each.select("book", "page", "i", "indent", (F.col("p.type") == "title").alias("is_title"), content.alias("content"))
    order = Window.partitionBy("book").orderBy("page", "i")
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    last_is_body = F.coalesce(~F.last("is_title").over(back), F.lit(False))
    goes_on = ~F.col("is_title") & (F.col("i") == 0) & ~F.col("indent") & last_is_body
    marked = rows.withColumn("part", F.sum(F.when(goes_on, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    level, text = heading(F.col("content"), patterns)
    shown = marked.withColumn("shown", F.when(F.col("is_title"), F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), text)).otherwise(F.col("content")))
    parts = shown.groupBy("book", "part").agg(F.max("is_title").alias("is_title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "i", "shown"))), lambda x: x["shown"]), "").alias("text"))
    along = Window.partitionBy("book").orderBy("part")
    after_title = F.coalesce(F.lag("is_title").over(along), F.lit(True))
    joined = parts.withColumn("text", F.concat(F.when(~F.col("is_title") & after_title, "\n").otherwise("\n\n"), F.col("text")))
    body = joined.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("body"))
    return pages.select("book").distinct().join(body, "book", "left").select("book", F.concat(F.lit("# "), F.col("book"), F.coalesce("body", F.lit(""))).alias("markdown"))


def starts_fresh(last: Column, indent: Column) -> Column:
    """Whether a page's first paragraph is a new one, by the end of the last paragraph before (without a closing quote); indent if there is none."""
    text = F.regexp_replace(last, "[\\s　]+$", "")
    cut = F.when(F.right(text, F.lit(1)) == "”", F.regexp_replace(F.left(text, F.length(text) - 1), "[\\s　]+$", "")).otherwise(text)
    return F.when(F.coalesce(last, F.lit("")) == "", indent).otherwise(F.right(cut, F.lit(1)).isin("。", "？", "！", "…"))


def decide_indents(pages: DataFrame) -> DataFrame:
    """pages with the indent flag decided from the last paragraph of earlier pages; a page of titles only counts as an end."""
    paragraphs = F.filter("paragraphs", lambda p: p["type"] == "paragraph")
    last = F.when(F.size(paragraphs) > 0, F.element_at(paragraphs, -1)["content"]).when(F.exists("paragraphs", lambda p: p["type"] == "title"), F.lit("。"))
    back = Window.partitionBy("book").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    seen = pages.withColumn("_own", last).withColumn("_last", F.coalesce(F.last("_own", ignorenulls=True).over(back), F.lit("")))
    first_is_title = F.coalesce(F.get("paragraphs", F.lit(0))["type"] == "title", F.lit(True))
    flag = F.when(first_is_title, F.col("first_paragraph_has_indent")).otherwise(starts_fresh(F.col("_last"), F.col("first_paragraph_has_indent")))
    return seen.withColumn("first_paragraph_has_indent", flag).drop("_own", "_last")
