"""Catalogue of an encyclopedia crawl: categories, articles, memberships, aliases, and the stages of an article.

Tables are DataFrames with the keys that the docstrings name; Spark enforces none, so inserts leave existing keys out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.lineage import checkpointed

#: The years that count, as a half-open range, and keywords of categories.
YEARS = (1467, 1616)
EXCLUDE = ("を題材とした", "の映画", "のテレビ", "のアニメ", "の漫画", "のゲーム", "の小説", "の文学", "の演劇", "の遺跡", "の建築", "の城郭", "の災害", "の地震", "の飢饉", "の疫病", "の研究", "博物館", "に関する書籍", "アジアの軍人", "世界の")
INCLUDE = ("武将", "武士", "大名", "将軍", "守護", "地頭", "合戦", "の戦い", "の乱", "の変", "の役", "幕府", "の人物", "氏")


def _has(name: Column, keywords) -> Column:
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(name, F.lit(k))
    return found


def classify(name: Column) -> Column:
    """include, exclude or review: years first, then keywords, of which including ones win."""
    year = F.regexp_extract(name, "^(\\p{Nd}{4})年の日本\\n?$", 1)
    decade = F.regexp_extract(name, "^(\\p{Nd}{3,4})年代の日本\\n?$", 1)
    lo, hi = YEARS
    inside = lambda hit: F.when(hit, "include").otherwise("exclude")
    y, d = F.try_to_number(year, F.lit("9999")).cast("int"), F.try_to_number(decade, F.lit("9999")).cast("int")
    return F.when(year != "", inside((y >= lo) & (y < hi))).when(decade != "", inside((d < hi) & (d + 9 >= lo))).when(_has(name, INCLUDE), "include").when(_has(name, EXCLUDE), "exclude").otherwise("review")


def classified(categories: DataFrame, column: str = "name") -> DataFrame:
    """(class, n, names): members of each class in order."""
    return categories.groupBy(classify(F.col(column)).alias("class")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(column)).alias("names"))


def category_tree(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(name, depth): categories reached from roots over (parent, child) edges, each at its least depth; one at depth isn't expanded.

    Frontiers are joined round by round against what was not seen yet, so cycles end and nothing is held on the driver.
    Each is checkpointed, so that a level is found once; levels end with the first that finds nothing.
    """
    front = seen = checkpointed(roots.select("name").distinct().withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        names = front.join(edges, front["name"] == edges["parent"]).select(F.col("child").alias("name")).distinct()
        front = checkpointed(names.join(seen, "name", "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def strip_namespace(title: Column) -> Column:
    return F.regexp_replace(title, "^Category:", "")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and those of rows whose keys it lacks, once each; of rows with equal keys the first in order of all columns stays."""
    columns = table.columns
    order = Window.partitionBy(*keys).orderBy(*columns)
    new = rows.select(*columns).withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")
    return table.unionByName(new.join(table.select(*keys), keys, "left_anti"))


def insert_members(articles: DataFrame, memberships: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the pages (title, lang, category, ns = 0) that they lack; new articles are pending."""
    pages = members.where("ns = 0")
    new = pages.select("title", "lang", F.lit("pending").alias("stage"))
    more = [c for c in articles.columns if c not in ("title", "lang", "stage")]
    new = new.select("*", *(F.lit(None).cast(articles.schema[c].dataType).alias(c) for c in more))
    return insert_ignore(articles, new, ["title", "lang"]), insert_ignore(memberships, pages.select("title", "lang", "category"), ["title", "lang", "category"])


def pending_with_categories(articles: DataFrame, memberships: DataFrame, stage: str = "pending", separator: str = ",") -> DataFrame:
    """(title, lang, categories, first_five): articles of a stage with their categories in order; none gives null and an empty list."""
    own = articles.where(F.col("stage") == stage).select("title", "lang").join(memberships.select("title", "lang", "category"), ["title", "lang"], "left")
    made = own.groupBy("title", "lang").agg(F.array_sort(F.collect_list("category")).alias("all"))
    return made.select("title", "lang", F.when(F.size("all") > 0, F.array_join("all", separator)).alias("categories"), F.slice("all", 1, 5).alias("first_five"))


def batches(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """rows with id and batch, dense in order. For lists of titles: the numbering is global."""
    at = F.row_number().over(Window.orderBy(*order)) - 1
    return rows.withColumn("id", at).withColumn("batch", F.floor(F.col("id") / size))


def set_stage(articles: DataFrame, keys: DataFrame, on: list[str], stage: str, only: str | None = None) -> DataFrame:
    """articles, those whose keys occur with a new stage; only limits it to one old stage."""
    hit = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    joined = articles.join(hit, on, "left")
    change = F.col("_hit").isNotNull() & (F.lit(True) if only is None else F.col("stage") == only)
    return joined.withColumn("stage", F.when(change, stage).otherwise(F.col("stage"))).select(*articles.columns)


def apply_decisions(articles: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending articles become queued or skip by (title, lang, keep); articles without a decision stay."""
    joined = articles.join(decisions.select("title", "lang", "keep").dropDuplicates(["title", "lang"]), ["title", "lang"], "left")
    stage = F.when((F.col("stage") == "pending") & F.col("keep").isNotNull(), F.when(F.col("keep"), "queued").otherwise("skip")).otherwise(F.col("stage"))
    return joined.withColumn("stage", stage).select(*articles.columns)


def record_fetch(articles: DataFrame, results: DataFrame) -> DataFrame:
    """Queued or once failed articles become fetched or fetch_failed by (title, lang, ok)."""
    joined = articles.join(results.select("title", "lang", "ok").dropDuplicates(["title", "lang"]), ["title", "lang"], "left")
    stage = F.when(F.col("stage").isin("queued", "fetch_failed") & F.col("ok").isNotNull(), F.when(F.col("ok"), "fetched").otherwise("fetch_failed")).otherwise(F.col("stage"))
    return joined.withColumn("stage", stage).select(*articles.columns)


def resolve_redirects(articles: DataFrame, redirects: DataFrame) -> DataFrame:
    """Fetched, unchecked articles with is_redirect, redirect_to and redirect_has_anchor from (title, lang, canonical, tofragment); others as they are."""
    joined = articles.drop("is_redirect", "redirect_to", "redirect_has_anchor").join(redirects.select("title", "lang", "canonical", "tofragment", F.lit(True).alias("_hit")), ["title", "lang"], "left")
    old = articles.select("title", "lang", *(F.col(c).alias(f"_{c}") for c in ("is_redirect", "redirect_to", "redirect_has_anchor")))
    both = joined.join(old, ["title", "lang"])
    open_ = (F.col("stage") == "fetched") & F.col("_is_redirect").isNull()
    hit = F.col("_hit").isNotNull()
    return both.select(
        *(c for c in articles.columns if c not in ("is_redirect", "redirect_to", "redirect_has_anchor")),
        F.when(open_, hit.cast("int")).otherwise(F.col("_is_redirect")).alias("is_redirect"),
        F.when(open_ & hit, F.col("canonical")).otherwise(F.col("_redirect_to")).alias("redirect_to"),
        F.when(open_ & hit, F.col("tofragment").isNotNull().cast("int")).otherwise(F.col("_redirect_has_anchor")).alias("redirect_has_anchor"),
    )


def aliases(redirects: DataFrame) -> DataFrame:
    """(alias_title, canonical_title, lang) of redirects that lead to a whole article."""
    return redirects.where("tofragment is null").select(F.col("title").alias("alias_title"), F.col("canonical").alias("canonical_title"), "lang").dropDuplicates(["alias_title", "lang"])


def title_counts(titles: DataFrame, title: str = "title", file: str = "file") -> DataFrame:
    """(title, n, files): how often each title occurs, and its files in order, all if n is at most ten, else five; by falling n."""
    made = titles.groupBy(title).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(file)).alias("f"))
    return made.select(title, "n", F.array_join(F.when(F.col("n") <= 10, F.col("f")).otherwise(F.slice("f", 1, 5)), " | ").alias("files")).orderBy(F.desc("n"), title)
