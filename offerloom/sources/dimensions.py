"""The fixed lists as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerloom import fixed
from offerloom.functions.codes import stop_prefixes


def store_map(spark: SparkSession) -> DataFrame:
    rows = [
        (source, key, domain, place)
        for source, table in fixed.STORE_TABLES.items()
        for place, (key, domain) in enumerate(table.items())
    ]
    return spark.createDataFrame(rows, "source string, key string, domain string, ord int")


def fallback_slugs(spark: SparkSession) -> DataFrame:
    rows = [
        (source, slug, place)
        for source, slugs in fixed.FALLBACK_SLUGS.items()
        for place, slug in enumerate(slugs)
    ]
    return spark.createDataFrame(rows, "source string, slug string, ord int")


def stop_words(spark: SparkSession) -> DataFrame:
    rows = [("page", word, "exact") for word in fixed.COMMON_WORDS]
    rows += [("feed", word, "exact") for word in fixed.FEED_COMMON_WORDS]
    for source in fixed.SOURCES:
        rows += [(source, word, "prefix") for word in stop_prefixes(source)]
    return spark.createDataFrame(rows, "list string, word string, match string")


def priority_domains(spark: SparkSession) -> DataFrame:
    rows = [(domain, place) for place, domain in enumerate(fixed.PRIORITY_DOMAINS)]
    return spark.createDataFrame(rows, "domain string, ord int")


def load_dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "store_map": store_map(spark),
        "fallback_slugs": fallback_slugs(spark),
        "stop_words": stop_words(spark),
        "priority_domains": priority_domains(spark),
    }
