"""Readers and writers of corpora: Parquet, Markdown, HTML, JSON pages, JSON lines, and files by order or by sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("text")


def read_web(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("content", "score")


def read_texts(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Column text of all Parquet files below path; tolerant skips files that can't be read."""
    return spark.read.schema("text string").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", str(tolerant).lower()).option("pathGlobFilter", "*.parquet").parquet(path).select("text")


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def label_of(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def list_files(spark: SparkSession, roots: list[str], pattern: str = "*.parquet") -> DataFrame:
    """(path, size, label) of files below roots, the label being the root's own name; roots that don't exist are skipped."""
    out = None
    for root in roots:
        if exists(spark, root):
            rows = _files(spark, root, pattern).select("path", F.col("length").alias("size"), F.lit(root.rstrip("/").rsplit("/", 1)[-1]).alias("label"))
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "path string, size long, label string")


def interleave(files: DataFrame, seed: int = 42) -> DataFrame:
    """files (path, label) with position: each label's files in a seeded order, spread evenly; ties in order of paths.

    The order comes from hashes, so it is the same in every run; only its distribution equals that of a random shuffle.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "path"))
    own = Window.partitionBy("label")
    at = F.row_number().over(own.orderBy(key, "path")) - 1
    jitter = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}j"), "path")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * 0.5
    return files.withColumn("position", (at + jitter) / F.count("*").over(own)).orderBy("position", "path")


def sample_files(files: DataFrame, count: int = 13, seed: int = 42) -> DataFrame:
    """count files, drawn by a seeded hash of their paths."""
    return files.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "path")), "path").limit(count)


def read_markdown(spark: SparkSession, path: str, tolerant: bool = True) -> DataFrame:
    """(path, text) of *.md files; bytes that are no UTF-8 are replaced, or dropped if tolerant. No file at all is an error."""
    files = _files(spark, path, "*.md")
    if not files.select("path").head(1):
        raise FileNotFoundError(f"no *.md below {path}")
    text = F.decode("content", "UTF-8") if not tolerant else F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return files.select("path", text.alias("text"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of *.html and *.htm files, bytes that are no UTF-8 replaced."""
    return _files(spark, path, "*.{html,htm,HTML,HTM}").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def number_of(path: Column) -> Column:
    """The file name's stem as a number, null if it is none."""
    stem = F.regexp_extract(path, "([^/]*)\\.[^./]*$", 1)
    return F.when(stem.rlike("^-?[0-9]{1,9}$"), stem.cast("int"))


PAGE = "first_paragraph_has_indent boolean, paragraphs array<struct<type:string,content:string>>"


def read_pages(spark: SparkSession, path: str, start: int | None = None) -> DataFrame:
    """(book, page, first_paragraph_has_indent, paragraphs) of JSON files named by page numbers; others are left out, as are pages before start."""
    rows = spark.read.schema(PAGE).option("multiLine", "true").option("recursiveFileLookup", "true").json(path).withColumn("_path", F.input_file_name())
    named = rows.withColumn("page", number_of(F.col("_path"))).withColumn("book", F.regexp_extract("_path", "([^/]+)/[^/]+$", 1)).where("page is not null")
    if start is not None:
        named = named.where(F.col("page") >= start)
    return named.select("book", "page", "first_paragraph_has_indent", "paragraphs")


def read_done(spark: SparkSession, path: str, key: str = "ja_title") -> DataFrame:
    """Distinct keys of a JSON-lines file; blank and broken lines, and keys that are no strings, are left out."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.try_parse_json("value")
    value = F.try_variant_get(parsed, f"$.{key}", "string")
    return lines.where(F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant")) == "STRING").select(value.alias(key)).where(F.col(key).isNotNull()).distinct()


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_per_input(rows: DataFrame, path: str, key: str) -> None:
    """Parquet below path, a folder for each value of key."""
    rows.write.mode("overwrite").partitionBy(key).parquet(path)


def write_texts(rows: DataFrame, path: str, key: str = "title", text: str = "markdown") -> None:
    """One text file's folder for each row's key; slashes in keys become underscores."""
    rows.select(F.replace(F.col(key), F.lit("/"), F.lit("_")).alias("name"), F.col(text).alias("value")).write.mode("overwrite").option("lineSep", "\n").partitionBy("name").text(path)


def relative_path(path: Column, root: str) -> Column:
    return F.replace(F.regexp_replace(path, "^(?:[a-z]+:)?" + root.rstrip("/") + "/", ""), F.lit("\\"), F.lit("/"))


def to_upload(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Files (path) that the other side doesn't have."""
    return local.join(remote.select("path"), "path", "left_anti")


def safe_name(title: Column) -> Column:
    return F.replace(title, F.lit("/"), F.lit("_"))
