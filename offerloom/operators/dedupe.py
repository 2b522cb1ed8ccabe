"""First-in-order rows per key, unions of sources, provenance lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key.

    The filter on the row number lets Spark keep ``n`` rows per key in every map task before the
    shuffle, so a key that fills a third of the table still sends only a few rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= n).drop("_n")


def dedupe_source(offers: DataFrame) -> DataFrame:
    """First row of every (code, domain) of a source, as written."""
    order = [F.col("page_key"), F.col("pos")]
    return first_rows(offers, ["source", "code", "store_domain"], order)


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """All sources in their fixed order; the order itself is a column."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def union_provenance(known: Column, found: Column) -> Column:
    """Known sources followed by the new ones, each once."""
    nothing = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(known, nothing), F.coalesce(found, nothing)))
