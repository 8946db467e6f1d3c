"""Filters, rendering, flattening and patching of block rows (see articles). Plans work on rows; one article bounds every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import pytext

KEY = ["title"]


def top_of(path: Column) -> Column:
    """The block that a row belongs to."""
    return F.substring_index(path, ".", 1)


def drop_unwanted(rows: DataFrame) -> DataFrame:
    """Without notes that begin with ※, enumerative lists, items of description lists left without a body, and description lists left without an item."""
    first = top_of(F.col("path"))
    notes = rows.where((F.col("node_kind") == "paragraph") & (F.col("depth") == 0) & F.startswith(F.col("text"), F.lit("※")) & F.startswith(F.col("path"), F.lit("b"))).select("title", F.col("path").alias("gone"))
    lists = rows.where((F.col("node_kind") == "list") & (F.col("category") == "enumerative")).select("title", F.col("path").alias("gone"))
    gone = notes.union(lists)
    # A list lies at depth 0 or, in a description list, at depth 2; its rows share that prefix.
    at_two = F.substring_index(F.col("path"), ".", 3)
    kept = rows.join(gone.withColumnsRenamed({"gone": "g1"}), (rows["title"] == gone["title"]) & (first == F.col("g1")), "left_anti")
    kept = kept.join(gone.withColumnsRenamed({"gone": "g2"}), (kept["title"] == gone["title"]) & (at_two == F.col("g2")), "left_anti")
    item = F.substring_index(F.col("path"), ".", 2)
    body = kept.where((F.col("depth") >= 2) & ~F.col("node_kind").isin("dt", "dl_item")).select("title", item.alias("item")).distinct()
    items = rows.where("node_kind = 'dl_item'").select("title", F.col("path").alias("item"))
    empty = items.join(body, ["title", "item"], "left_anti")
    kept = kept.join(empty.select(F.col("title").alias("t3"), F.col("item").alias("g3")), (F.col("title") == F.col("t3")) & (item == F.col("g3")), "left_anti")
    full = kept.where("node_kind = 'dl_item'").select("title", first.alias("path")).distinct()
    bare = kept.where("node_kind = 'dl'").select("title", "path").join(full, ["title", "path"], "left_anti")
    return kept.join(bare, ["title", "path"], "left_anti").select(*rows.columns)


def drop_empty_headings(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Without headings below which nothing stands before the next heading of the same or a higher rank.

    Only block starts count. A heading stays if a block that is no heading comes before the next heading with a level
    not above its own; the headings that follow it are looked at inside one array per article.
    """
    blocks = rows.where((F.col("depth") == 0) & F.startswith(F.col("path"), F.lit("b")))
    own = blocks.groupBy("title").agg(F.array_sort(F.collect_list(F.struct(order, "path", F.coalesce("level", F.lit(99)).alias("level"), (F.col("node_kind") == "heading").alias("is_heading")))).alias("all"))
    # next heading of rank <= own, and next block that is no heading, by position
    each = own.select("title", F.posexplode("all").alias("i", "b"), "all").where("b.is_heading")
    after = F.slice("all", F.col("i") + 2, F.greatest(F.size("all") - F.col("i") - 1, F.lit(0)))
    until = F.aggregate(after, F.struct(F.lit(False).alias("done"), F.lit(False).alias("found")), lambda s, x: F.struct((s["done"] | s["found"] | (x["is_heading"] & (x["level"] <= F.col("b.level")))).alias("done"), (s["found"] | (~s["done"] & ~x["is_heading"])).alias("found")))
    bare = each.where(~until["found"]).select("title", F.col("b.path").alias("path"))
    return rows.join(bare, ["title", "path"], "left_anti").select(*rows.columns)


def drop_blank(rows: DataFrame) -> DataFrame:
    """Without blank paragraphs and headings at the top and blank lead paragraphs, as a validated reader drops them."""
    blank = (F.col("depth") == 0) & F.col("node_kind").isin("paragraph", "heading") & (pytext.strip(F.col("text")) == "")
    return rows.where(~F.coalesce(blank, F.lit(False)))


def render(rows: DataFrame, order: str = "ord") -> DataFrame:
    """(title, markdown) of filtered rows."""
    item_depth = F.col("depth") - F.col("list_depth") - 1
    # Each list item learns its list: the nearest list row before it.
    before = Window.partitionBy("title").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lists = F.when(F.col("node_kind") == "list", F.struct("depth", "ordered"))
    marked = rows.withColumn("_list", F.last(lists, ignorenulls=True).over(before)).withColumn("list_depth", F.col("_list.depth"))
    number = F.concat((F.col("idx") + 1).cast("string"), F.lit(". "))
    marker = F.concat(F.repeat(F.lit("  "), item_depth.cast("int")), F.when(F.col("_list.ordered") & (item_depth == 0), number).otherwise("- "))
    line = (
        F.when(F.col("node_kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text")))
        .when(F.col("node_kind") == "list_item", F.concat(marker, F.col("text")))
        .when(F.col("node_kind") == "dt", F.concat(F.lit("**"), F.col("text"), F.lit("**")))
        .when(F.col("node_kind") == "citation", F.concat(F.lit("——"), F.col("text")))
        .otherwise(F.col("text"))
    )
    shown = marked.where("node_kind not in ('infobox', 'quote_title', 'list', 'dl', 'dl_item', 'quote', 'error')").withColumn("line", line)
    along = Window.partitionBy("title").orderBy(order)
    prev_kind, prev_top = F.lag("node_kind").over(along), F.lag(top_of(F.col("path"))).over(along)
    prev_item = F.lag(F.substring_index(F.col("path"), ".", 3)).over(along)
    same_block = top_of(F.col("path")) == prev_top
    kind = F.col("node_kind")
    separator = (
        F.when(prev_kind.isNull(), "")
        .when(kind == "citation", "")
        .when(same_block & (kind == "list_item") & (prev_kind == "list_item") & ((F.col("list_depth") == 0) | (F.substring_index(F.col("path"), ".", 3) == prev_item)), "\n")
        .when(same_block & (prev_kind == "dt"), "\n")
        .when(~same_block & (prev_kind == "heading") & (kind != "heading"), "\n")
        .otherwise("\n\n")
    )
    parts = shown.withColumn("part", F.concat(separator, F.col("line")))
    body = parts.groupBy("title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "part"))), lambda x: x["part"]), "").alias("body"))
    titles = rows.select("title").distinct()
    return titles.join(body, "title", "left").select("title", F.when(F.coalesce(F.length("body"), F.lit(0)) > 0, F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("body"))).otherwise(F.concat(F.lit("# "), F.col("title"))).alias("markdown"))


def to_markdown(rows: DataFrame) -> DataFrame:
    return render(drop_empty_headings(drop_unwanted(drop_blank(rows.where("node_kind not in ('error')")))))


def flatten(rows: DataFrame) -> DataFrame:
    """(title, id, kind, text): what is to be translated; blank texts, containers and the infobox are left out."""
    kind = F.when(F.col("node_kind") == "quote_text", "quote").otherwise(F.col("node_kind"))
    return rows.where(F.col("text").isNotNull() & ~F.col("node_kind").isin("infobox", "error") & (pytext.strip(F.col("text")) != "")).select("title", F.col("path").alias("id"), kind.alias("kind"), "text")


def patch(rows: DataFrame, translations: DataFrame) -> DataFrame:
    """rows with the texts of (title, id, text) put in."""
    new = translations.select("title", F.col("id").alias("path"), F.col("text").alias("_new"), F.lit(True).alias("_hit"))
    joined = rows.join(new, ["title", "path"], "left")
    return joined.withColumn("text", F.when(F.col("_hit") & (F.col("node_kind") != "infobox"), F.col("_new")).otherwise(F.col("text"))).select(*rows.columns)


def fingerprint(rows: DataFrame) -> DataFrame:
    """(title, structure): digest of everything but texts, equal before and after a patch."""
    shape = F.to_json(F.struct("ord", "path", "node_kind", "level", "ordered", "category", "attr"))
    return rows.groupBy("title").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(shape)), "\n"), 256).alias("structure"))


def refresh(parsed: DataFrame, fused: DataFrame) -> DataFrame:
    """(title, is_changed, blocks): newly parsed blocks in place of fused ones where they differ; titles as fused has them."""
    joined = fused.select("title", F.col("blocks").alias("old")).join(parsed.select("title", F.col("blocks").alias("new")), "title", "left")
    changed = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))
    return joined.select("title", changed.alias("is_changed"), F.when(changed, F.col("new")).otherwise(F.col("old")).alias("blocks"))


def refresh_summary(refreshed: DataFrame) -> DataFrame:
    return refreshed.agg(F.count("*").alias("total"), F.count_if("is_changed").alias("changed"), F.count_if(~F.col("is_changed")).alias("unchanged"))


def articles_by_size(rows: DataFrame, past: int, width: int = 100) -> DataFrame:
    """Rows past - width to past of articles by falling size."""
    sizes = rows.groupBy("title").agg(F.sum(F.length("text")).alias("size"))
    return sizes.orderBy(F.desc("size"), "title").offset(max(0, past - width)).limit(min(width, past))
