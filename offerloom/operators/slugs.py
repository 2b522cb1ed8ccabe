"""Store slugs out of sitemaps, and the page addresses to visit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.fixed import FALLBACK_SLUGS
from offerloom.functions.text import first_group, literal_map
from offerloom.sources.profiles import DISCOVERY, PAGED_URL, URL_TEMPLATES, Discovery


def slug_in(url: Column, pattern: str) -> Column:
    return first_group(url, pattern)


def first_nonempty(rows: DataFrame, group: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows of the first ``order`` value in each group that has any non-null ``value``."""
    filled = rows.filter(F.col(value).isNotNull())
    firsts = filled.groupBy(*group).agg(F.min(order).alias(order))
    return filled.join(firsts, [*group, order], "left_semi")


def _listed(url: Column, markers: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(url, F.lit(m)) for m in markers), F.lit(False))


def _by_source(rules: dict[str, Discovery], value) -> Column:
    """``value(rule)`` of the row's source; null for a source without a rule."""
    chosen = F
    for source, rule in rules.items():
        chosen = chosen.when(F.col("source") == source, value(rule))
    return chosen.otherwise(F.lit(None))


def discover_slugs(locs: DataFrame, rules: dict[str, Discovery] = DISCOVERY) -> DataFrame:
    """Distinct slugs (source, slug) per source, or its fallback list where none was found.

    ``locs``: source, sitemap_url, sitemap_ord (place of a top-level sitemap, null for others),
    is_index, pos, loc.

    All sources at once: pages meet the indexes that list them, each way a page is found by is a turn, and the
    ``first`` policy keeps the slugs of the lowest turn of its source. The lowest turns are one row per rule.
    """
    own = locs.filter(F.col("source").isin(*rules))
    policy = _by_source(rules, lambda rule: F.lit(rule.policy))
    listing = (
        own.filter(F.col("is_index") & _by_source(rules, lambda rule: _listed(F.col("loc"), rule.listed)))
        .groupBy("source", F.col("loc").alias("sitemap_url"))
        .agg(F.min(F.struct("sitemap_ord", F.col("pos").alias("sub_ord"))).alias("listed"))
    )
    pages = own.filter(~F.col("is_index")).select(
        "source", "sitemap_url", "sitemap_ord", policy.alias("policy"), _by_source(rules, lambda rule: slug_in(F.col("loc"), rule.slug)).alias("slug")
    )
    through = F.when(F.col("policy") != "flat", F.col("listed"))
    top = F.col("sitemap_ord").isNotNull() & (F.col("policy") != "union")
    direct = F.when(top, F.struct(F.col("sitemap_ord"), F.lit(-1).cast("long").alias("sub_ord")))
    turn = F.coalesce(F.least(through, direct), through, direct)
    found = (
        pages.filter(F.col("slug").isNotNull())
        .join(listing, ["source", "sitemap_url"], "left")
        .withColumn("turn", turn)
        .filter(F.col("turn").isNotNull())
        .groupBy("source", "policy", "slug")
        .agg(F.min("turn").alias("turn"))
    )
    lowest = found.groupBy("source").agg(F.min("turn").alias("lowest"))
    kept = found.join(F.broadcast(lowest), "source").filter((F.col("policy") != "first") | (F.col("turn") == F.col("lowest")))
    missing = fallback_slugs(locs.sparkSession, list(rules)).join(lowest, "source", "left_anti")
    return kept.select("source", "slug").unionByName(missing)


def fallback_slugs(spark: SparkSession, sources: Sequence[str]) -> DataFrame:
    rows = [(source, slug) for source in sources for slug in FALLBACK_SLUGS.get(source, ())]
    return spark.createDataFrame(rows, "source string, slug string")


def crawl_frontier(slugs: DataFrame, templates: dict[str, str] = URL_TEMPLATES) -> DataFrame:
    """Page address of every slug."""
    template = F.try_element_at(literal_map(templates), F.col("source"))
    return slugs.withColumn("url", F.replace(template, F.lit("{slug}"), F.col("slug")))


def paged_frontier(base: Column | None = None, pages: int = 5) -> Column:
    """Addresses of a listing of ``pages`` pages, first one without a page number."""
    base = F.lit(PAGED_URL) if base is None else base
    return F.transform(
        F.sequence(F.lit(1), F.lit(pages)),
        lambda n: F.when(n == 1, base).otherwise(F.concat(base, F.lit("?page="), n.cast("string"))),
    )
