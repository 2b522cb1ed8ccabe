"""Store names and slugs to store domains.

The store tables are fixed lists of about a hundred entries, so they travel as literals inside the
expression: no join, no shuffle, no broadcast that could grow.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.fixed import SPACE, STORE_TABLES
from offerloom.functions.stores import (
    UNKNOWN,
    UNKNOWN_DOMAIN,
    generated_domain,
    name_in_text,
    strip_slug_suffix,
)
from offerloom.functions.text import let, literal_map, literal_pairs, title_words, trim_all

#: Sources whose pages belong to no single store.
MIXED_SOURCES = ("latestdeals", "moneysavingexpert")
NO_STORE = "Various"


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Exact lookup in a small literal table; null when absent."""
    return F.try_element_at(literal_map(table), key)


def first_contained(text: Column, table: Mapping[str, str], both_ways: bool = False) -> Column:
    """Entry (key, value) of the first table key that occurs in ``text``, or null.

    With ``both_ways`` a key that contains the whole text counts as well.
    """
    def hit(entry: Column, text: Column) -> Column:
        inside = F.contains(text, entry["key"])
        return inside | F.contains(entry["key"], text) if both_ways else inside

    entries = literal_pairs(table.items())
    return let(text, lambda t: F.get(F.filter(entries, lambda entry: hit(entry, t)), F.lit(0)))


def resolve_domain_feed(offers: DataFrame, table: Mapping[str, str] = STORE_TABLES["hotukdeals"]) -> DataFrame:
    """Exact name, else first table key inside the name or around it, else a generated domain."""
    name = F.col("_name")
    unnamed = F.coalesce(F.col("store_name").isin("", UNKNOWN), F.lit(True))
    domain = F.when(unnamed, F.lit(UNKNOWN_DOMAIN)).otherwise(
        F.coalesce(
            lookup(name, table),
            first_contained(name, table, both_ways=True)["value"],
            generated_domain(F.col("store_name")),
        )
    )
    named = offers.withColumn("_name", trim_all(F.lower(F.col("store_name"))))
    return named.withColumn("store_domain", domain).drop("_name")


def _slug_domain(source: str) -> Column:
    slug = strip_slug_suffix(F.col("slug")) if source == "savoo" else F.col("slug")
    bare = F.replace(slug, F.lit("-"), F.lit("")) if source == "coupert" else slug
    made = F.concat(bare, F.lit(".co.uk"))
    table = STORE_TABLES.get(source)
    return F.coalesce(lookup(slug, table), made) if table else made


def resolve_domain_slug(offers: DataFrame) -> DataFrame:
    """Domain of the page slug: table entry of the source, else made from the slug."""
    known = [s for s in STORE_TABLES if s not in (*MIXED_SOURCES, "hotukdeals", "ggdeals")]
    domain = F
    for source in known:
        domain = domain.when(F.col("source") == source, _slug_domain(source))
    return offers.withColumn("store_domain", domain.otherwise(F.concat("slug", F.lit(".co.uk"))))


def resolve_domain_name(offers: DataFrame, source: str = "ggdeals") -> DataFrame:
    """Domain of an exact display name, else the name in lower case without signs."""
    name = F.col("store_name")
    made = F.concat(
        F.regexp_replace(F.regexp_replace(F.lower(name), rf"[^a-z0-9\s]", ""), f"{SPACE}+", ""),
        F.lit(".com"),
    )
    unnamed = F.coalesce(name.isin("", UNKNOWN), F.lit(True))
    return offers.withColumn(
        "store_domain",
        F.coalesce(lookup(name, STORE_TABLES[source]), F.when(unnamed, F.lit("unknown.com")).otherwise(made)),
    )


def resolve_domain_text(offers: DataFrame) -> DataFrame:
    """Name and domain of offers from mixed pages, found in the description."""
    text = F.col("description")
    source = F.col("source")
    named = F.coalesce(name_in_text(text), F.lit(NO_STORE))
    by_name = first_contained(F.lower(named), STORE_TABLES["latestdeals"])
    by_text = first_contained(F.lower(text), STORE_TABLES["moneysavingexpert"])
    mixed_name = F.when(source == MIXED_SOURCES[0], named).when(
        source == MIXED_SOURCES[1], F.coalesce(title_words(by_text["key"]), F.lit(NO_STORE))
    )
    mixed_domain = F.when(
        source == MIXED_SOURCES[0], F.coalesce(by_name["value"], F.lit(UNKNOWN_DOMAIN))
    ).when(source == MIXED_SOURCES[1], F.coalesce(by_text["value"], F.lit(UNKNOWN_DOMAIN)))
    return offers.withColumns(
        {
            "store_name": F.coalesce(mixed_name, F.col("store_name")),
            "store_domain": F.coalesce(mixed_domain, F.col("store_domain")),
        }
    )
