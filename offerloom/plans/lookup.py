"""Lookup run: what a reader sees on a host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.fixed import PRIORITY_DOMAINS

from offerloom.operators.serve import (
    last_verified,
    match_store,
    offer_cards,
    rank_offers,
    shop_of,
    shop_offers,
    store_rollup,
    visible_offers,
)
from offerloom.session import durable
from offerloom.sources.store_keys import StoreKeys
from offerloom.sources.versions import read_registry_table


SHOP = ("pooled", "shop")


def lookup_hosts(
    hosts: DataFrame,
    stores: DataFrame,
    offers: DataFrame,
    hidden: DataFrame,
    asof: Column,
    priority: Sequence[str] = PRIORITY_DOMAINS,
    keys: StoreKeys | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matched hosts with their shop, ranked cards of the shops, and one header row per shop.

    A shop is a store or a pool of stores (``pooled``); hosts are joined to cards and headers by it.
    """
    matched = durable(shop_of(match_store(hosts, stores, offers, priority, keys)))
    served = shop_offers(matched, offers)
    visible = durable(visible_offers(served, hidden))
    cards = offer_cards(rank_offers(visible, by=SHOP), keep=(*SHOP, "position", "size"))
    header = store_rollup(served, hidden, SHOP).join(last_verified(visible, asof, by=SHOP), list(SHOP), "left")
    header = header.withColumn("last_verified", F.coalesce("last_verified", F.lit("unknown")))
    return matched, cards, header


def lookup_stored(
    spark: SparkSession, base: str, hosts: DataFrame, hidden: DataFrame, asof: Column, priority: Sequence[str] = PRIORITY_DOMAINS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``lookup_hosts`` on the newest version of a stored registry, through the index of its store keys."""
    offers, stores = read_registry_table(spark, base)
    return lookup_hosts(hosts, stores, offers, hidden, asof, priority, StoreKeys(spark, base))
