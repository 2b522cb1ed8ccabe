"""Upsert of raw offers into the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.functions.codes import norm_code
from offerloom.functions.descriptions import clean_description, min_spend, offer_type, offer_value
from offerloom.functions.text import blank_to_null, round_half_up
from offerloom.operators.dedupe import union_provenance
from offerloom.schemas import OFFER, STORE

KEY = ["domain", "norm_code"]
UNKNOWN_SOURCE = "unknown"


def in_slice(rows: DataFrame, store: Column, part: tuple[int, int]) -> DataFrame:
    """Rows of slice k of n, ``part`` being (k, n): the stores (a key of theirs) whose hash says so, with all their rows.

    Merging slice after slice keeps the shuffle files of one of them on the disk instead of all. A store with a third of
    all rows makes its slice as large.
    """
    number, count = part
    return rows if count == 1 else rows.filter(F.pmod(F.xxhash64(store), F.lit(count)) == number)


def keyed_offers(incoming: DataFrame, now: Column) -> DataFrame:
    """Raw offers with their registry key and their place in the collection order."""
    return incoming.select(
        F.lower("store_domain").alias("domain"),
        norm_code(F.col("code")).alias("norm_code"),
        F.struct(
            now.cast("timestamp").alias("run"),
            F.col("source_rank").cast("int").alias("source_rank"),
            F.col("page_key").cast("string").alias("page_key"),
            F.col("pos").cast("long").alias("pos"),
        ).alias("ord"),
        F.struct(
            "store_name",
            "category",
            "description",
            "type",
            "value",
            "min_spend",
            "expiry",
            "source",
            "url",
        ).alias("entry"),
        "success_rate",
    )


def first_per_key(keyed: DataFrame) -> DataFrame:
    """One row per key: first entry in order, its sources in first-seen order, rows, best rate.

    Rows are first reduced per (key, source), which collapses a hot key inside the map tasks.  What
    is gathered per key afterwards is one entry per distinct source, never one per row.
    """
    per_source = keyed.groupBy(*KEY, F.col("entry.source").alias("source")).agg(
        F.min(F.struct("ord", "entry")).alias("first"),
        F.count(F.lit(1)).alias("rows"),
        F.max("success_rate").alias("best_rate"),
    )
    named = F.when(F.coalesce(F.col("source"), F.lit("")) != "", F.struct(F.col("first.ord").alias("first_ord"), "source"))
    # Most keys have one source, so a window, which sorts once, costs half of an aggregation on both sides of a shuffle.
    in_order = Window.partitionBy(*KEY).orderBy("first")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_key = per_source.select(
        *KEY,
        "first",
        F.row_number().over(in_order).alias("place"),
        F.sum("rows").over(whole).alias("rows"),
        F.max("best_rate").over(whole).alias("best_rate"),
        F.array_sort(F.collect_list(named).over(whole)).alias("seen"),
    )
    return per_key.filter(F.col("place") == 1).select(
        *KEY,
        F.col("first.ord").alias("ord"),
        F.col("first.entry").alias("entry"),
        "rows",
        "best_rate",
        F.transform("seen", lambda one: one["source"]).alias("found_by"),
    )


def _new_offer(now: Column, intended: bool) -> dict[str, Column]:
    """Registry columns of an offer seen for the first time; ``_text`` and ``_kind`` are set."""
    entry, text, kind = F.col("i.entry"), F.col("_text"), F.col("_kind")
    source = F.coalesce(blank_to_null(entry["source"]), F.lit(UNKNOWN_SOURCE))
    return {
        "dup_no": F.lit(0),
        "code": F.col("i.norm_code"),
        "description": text,
        "type": kind,
        "value": F.coalesce(F.nullif(entry["value"], F.lit(0.0)), offer_value(text, kind, intended)),
        "min_spend": F.coalesce(F.nullif(entry["min_spend"], F.lit(0.0)), min_spend(text)),
        "expiry": blank_to_null(entry["expiry"]).try_cast("date"),
        "source": source,
        "sources": union_provenance(F.array(source), F.col("i.found_by")),
        "url": F.coalesce(entry["url"], F.lit("")),
        "added_at": now,
        "last_seen": now,
        "total": F.lit(0),
        "worked": F.lit(0),
        "last_tested": F.lit(None),
        "ord": F.col("i.ord"),
    }


def _worked_after(now_best: Column) -> Column:
    """Stored successes, raised when an incoming rate beats the stored one."""
    total = F.coalesce(F.col("r.total"), F.lit(0))
    stored = F.coalesce(F.col("r.worked"), F.lit(0)) / F.greatest(total, F.lit(1))
    return F.when(now_best > stored, round_half_up(now_best * total)).otherwise(F.col("r.worked"))


def upsert(registry: DataFrame, incoming: DataFrame, now: Column, intended: bool = False) -> DataFrame:
    """Registry after the run, with ``is_new`` and ``rows`` (incoming rows of the offer) per row."""
    return upsert_firsts(registry, first_per_key(keyed_offers(incoming, now)), now, intended)


def upsert_firsts(registry: DataFrame, firsts: DataFrame, now: Column, intended: bool = False) -> DataFrame:
    """``upsert`` of rows that ``first_per_key`` has already reduced.

    Both sides of the join hold a key once, so no key is hot.  A second registry row of one normal
    form (``dup_no`` > 0) passes through unchanged.
    """
    now = now.cast("timestamp")
    firsts = firsts.alias("i")
    known = registry.alias("r")
    same = (
        (F.col("r.domain") == F.col("i.domain"))
        & (F.col("r.norm_code") == F.col("i.norm_code"))
        & (F.col("r.dup_no") == F.lit(0))
    )
    is_new = F.col("r.norm_code").isNull()
    seen_again = F.col("i.norm_code").isNotNull()
    kept = {
        "sources": F.when(
            seen_again, union_provenance(F.col("r.sources"), F.col("i.found_by"))
        ).otherwise(F.col("r.sources")),
        "last_seen": F.when(seen_again, now).otherwise(F.col("r.last_seen")),
        "worked": _worked_after(F.col("i.best_rate")),
    }
    fresh = _new_offer(now, intended)
    columns = []
    for field in OFFER:
        name = field.name
        if name in KEY:
            value = F.coalesce(F.col(f"r.{name}"), F.col(f"i.{name}"))
        else:
            value = F.when(is_new, fresh[name]).otherwise(kept.get(name, F.col(f"r.{name}")))
        columns.append(value.cast(field.dataType).alias(name))
    entry = F.col("i.entry")
    joined = known.join(firsts, same, "full_outer")
    # Separate projections, so that each text rule runs once per new offer.
    joined = joined.withColumn("_text", F.when(is_new, clean_description(entry["description"], intended)))
    inferred = F.when(entry["type"] == "unknown", offer_type(F.col("_text"))).otherwise(entry["type"])
    joined = joined.withColumn("_kind", F.when(is_new, inferred))
    return joined.select(
        *columns, is_new.alias("is_new"), F.coalesce("i.rows", F.lit(0)).alias("rows")
    )


def merge_offers(registry: DataFrame, incoming: DataFrame, now: Column, intended: bool = False) -> DataFrame:
    """Registry after merging raw offers at time ``now``."""
    return upsert(registry, incoming, now, intended).drop("is_new", "rows")


def merge_stats(merged: DataFrame) -> DataFrame:
    """Offers added, and incoming rows that met an offer already there."""
    added = F.count_if("is_new")
    return merged.agg(
        added.alias("added"),
        (F.coalesce(F.sum("rows"), F.lit(0)) - added).alias("updated"),
        F.lit(0).cast("long").alias("skipped"),
    )


def store_upsert(stores: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Stores after the run; a store keeps the name and category of its first offer."""
    return store_upsert_firsts(stores, keyed_offers(incoming, now))


def store_upsert_firsts(stores: DataFrame, keyed: DataFrame) -> DataFrame:
    """``store_upsert`` of keyed rows, reduced by ``first_per_key`` or not.

    The first row of a store is the first row of its key, so the reduced rows are enough.
    """
    firsts = keyed.groupBy("domain").agg(
        F.min(F.struct("ord", "entry.store_name", "entry.category")).alias("first")
    )
    new = firsts.join(stores.select("domain"), "domain", "left_anti").select(
        "domain",
        F.coalesce(blank_to_null(F.col("first.store_name")), F.col("domain")).alias("name"),
        F.coalesce(blank_to_null(F.col("first.category")), F.lit("general")).alias("category"),
        F.col("first.ord").alias("ord"),
    )
    return stores.select(*STORE.names).unionByName(new)
