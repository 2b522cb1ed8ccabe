"""Inputs: Markdown pages, feeds, stored HTML captures, sitemaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerloom.functions.text import trim_all

FEED_ITEM = "title string, link string, description string"


def read_markdown_pages(spark: SparkSession, path: str, label: str = "") -> DataFrame:
    """Every ``*.md`` below ``path`` as one row (page, text); ``label`` goes before the file name."""
    text = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return text.select(F.concat(F.lit(label), name).alias("page"), F.col("value").alias("text"))


def markdown_lines(pages: DataFrame) -> DataFrame:
    """Lines (page, line_no, line) of Markdown pages."""
    return pages.select("page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items (title, link, description, item_no) of an RSS document."""
    items = spark.read.format("xml").option("rowTag", "item").schema(FEED_ITEM).load(path)
    return items.select(
        *(F.coalesce(trim_all(F.col(name)), F.lit("")).alias(name) for name in ("title", "link", "description")),
        F.monotonically_increasing_id().alias("_read"),
        F.col("_metadata.file_path").alias("_file"),
    ).transform(_numbered)


def _numbered(items: DataFrame) -> DataFrame:
    """``item_no``: files in the order of their names, items in theirs, however the files are cut into tasks.

    The pieces of a file are read in order, so the order of reading is right inside a file.
    """
    files = items.select("_file").distinct()
    # One row per feed file, so one task can number them.
    numbered = files.withColumn("_nth", F.row_number().over(Window.orderBy("_file")))
    placed = items.join(numbered.select("_file", "_nth"), "_file")
    place = Window.partitionBy("_file").orderBy("_read")
    return placed.select("title", "link", "description", (F.col("_nth") * F.lit(1 << 32) + F.row_number().over(place)).alias("item_no"))


CAPTURE = "url string, slug string, html string, status int, source string"


def write_captures(captures: DataFrame, path: str) -> None:
    """Add captured pages (source, url, slug, html; status if there is one) to a table that is parted by source.

    A source with many pages goes to many files: pages are dealt by address, not by source.
    """
    if "status" not in captures.columns:
        captures = captures.withColumn("status", F.lit(None).cast("int"))
    rows = captures.select("url", "slug", "html", F.col("status").cast("int").alias("status"), "source")
    rows.repartition("source", F.pmod(F.xxhash64("url"), F.lit(64))).write.mode("append").partitionBy("source").parquet(path)


def read_captures(spark: SparkSession, path: str, sources: Sequence[str] | None = None) -> DataFrame:
    """Stored pages (source, url, slug, html, status), optionally of some sources only: no other folder is read."""
    captures = spark.read.schema(CAPTURE).parquet(path).select("source", "url", "slug", "html", "status")
    return select_sources(captures, sources)


def select_sources(df: DataFrame, sources: Sequence[str] | str | None = None) -> DataFrame:
    """Rows of the named sources; all of them without a name, none for an unknown one."""
    if sources is None:
        return df
    wanted = [sources] if isinstance(sources, str) else list(sources)
    return df.filter(F.col("source").isin(*wanted))


def sitemap_locs(sitemaps: DataFrame) -> DataFrame:
    """Entries of sitemap documents (source, sitemap_url, sitemap_ord, body), in document order."""
    locs = F.regexp_extract_all(F.col("body"), F.lit("<loc>([^<]+)</loc>"), F.lit(1))
    return sitemaps.select(
        "source",
        "sitemap_url",
        "sitemap_ord",
        F.contains("body", F.lit("<sitemap>")).alias("is_index"),
        F.posexplode(locs).alias("pos", "loc"),
    ).withColumn("pos", F.col("pos").cast("long"))


def read_sitemaps(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Entries of stored sitemap files, as ``discover_slugs`` takes them.

    ``manifest`` says what each file is: file (its name), source, sitemap_url, sitemap_ord (place of a top-level
    sitemap, null for others). Files without an entry are left out.
    """
    files = spark.read.text(path, wholetext=True)
    files = files.select(F.substring_index("_metadata.file_path", "/", -1).alias("file"), F.col("value").alias("body"))
    return sitemap_locs(files.join(manifest, "file")).withColumn("loc", trim_all(F.col("loc")))
