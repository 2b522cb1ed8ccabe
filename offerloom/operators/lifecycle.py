"""Expiry, user reports and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.codes import norm_code
from offerloom.operators.contains import join_containing

RETENTION_DAYS = 90


def is_fresh(asof: Column, days: int = RETENTION_DAYS) -> Column:
    """Seen within ``days`` before ``asof``; an offer without any time is not fresh."""
    seen = F.coalesce(F.col("last_seen"), F.col("added_at"))
    return F.coalesce(seen > asof.cast("timestamp") - F.make_interval(days=F.lit(days)), F.lit(False))


def prune_stale(registry: DataFrame, asof: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return registry.filter(is_fresh(asof, days))


def count_stale(registry: DataFrame, asof: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return registry.agg(F.count_if(~is_fresh(asof, days)).alias("pruned"))


def drop_empty_stores(stores: DataFrame, registry: DataFrame) -> DataFrame:
    """Stores that still hold an offer."""
    return stores.join(registry.select("domain").distinct(), "domain", "left_semi")


def _report_keys(reports: DataFrame) -> DataFrame:
    """One row per reported (normal code, first label of the domain), with its earliest report.

    A domain always contains its own first label, so "same domain or contains the label" is the
    label test alone.
    """
    return reports.groupBy(
        norm_code(F.col("code")).alias("norm_code"),
        F.substring_index("store_domain", ".", 1).alias("label"),
    ).agg(F.min("report_id").alias("report_id"))


def match_reports(registry: DataFrame, reports: DataFrame) -> DataFrame:
    """Key (domain, norm_code) of every reported offer with the first report that removes it.

    Only offers whose code is reported are taken apart; code and piece together make the join key.
    """
    keys = _report_keys(reports)
    offers = registry.select("domain", "norm_code").distinct()
    offers = offers.join(keys.select("norm_code").distinct(), "norm_code", "left_semi")
    hits = join_containing(offers, "domain", keys, "label", ["norm_code"])
    return hits.groupBy("domain", "norm_code").agg(F.min("report_id").alias("report_id"))


def mark_reported(registry: DataFrame, reports: DataFrame, mark: str = "reported") -> DataFrame:
    """Registry with a flag on the offers that a report names."""
    hits = match_reports(registry, reports).select("domain", "norm_code", F.lit(True).alias(mark))
    marked = registry.join(hits, ["domain", "norm_code"], "left")
    return marked.select(*registry.columns, F.coalesce(mark, F.lit(False)).alias(mark))


def remove_reported(registry: DataFrame, reports: DataFrame) -> DataFrame:
    """Registry without the offers that a report names."""
    return registry.join(match_reports(registry, reports), ["domain", "norm_code"], "left_anti")


def reports_with_effect(registry: DataFrame, reports: DataFrame) -> DataFrame:
    """Every report with the number of offers it removed; all of them are to be closed."""
    hits = (
        registry.select("domain", "norm_code")
        .join(match_reports(registry, reports), ["domain", "norm_code"])
        .groupBy("report_id")
        .agg(F.count(F.lit(1)).alias("removed"))
    )
    return reports.join(hits, "report_id", "left").select(
        "report_id", "code", "store_domain", F.coalesce("removed", F.lit(0)).alias("removed")
    )


def registry_meta(registry: DataFrame, asof: Column, version: str = "1.0") -> DataFrame:
    return registry.agg(F.count(F.lit(1)).alias("total_codes")).select(
        asof.cast("timestamp").alias("last_updated"), "total_codes", F.lit(version).alias("version")
    )


def source_summary(incoming: DataFrame) -> DataFrame:
    """Raw offers found per source."""
    return incoming.groupBy("source").agg(F.count(F.lit(1)).alias("found"))


def run_summary(
    merged: DataFrame,
    asof: Column,
    removed: DataFrame | None = None,
    errors: DataFrame | None = None,
    days: int = RETENTION_DAYS,
) -> DataFrame:
    """Labelled counters of one run (counter, n)."""
    stats = merged.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("found"),
        F.count_if("is_new").alias("added"),
        (F.coalesce(F.sum("rows"), F.lit(0)) - F.count_if("is_new")).alias("updated"),
        F.count_if(~is_fresh(asof, days)).alias("pruned"),
        F.count_if(is_fresh(asof, days)).alias("total"),
    ).unpivot([], ["found", "added", "updated", "pruned", "total"], "counter", "n")
    parts = stats
    if removed is not None:
        n = removed.agg(F.count(F.lit(1)).alias("n")).select(F.lit("removed").alias("counter"), "n")
        parts = parts.unionByName(n)
    if errors is not None:
        n = errors.agg(F.count(F.lit(1)).alias("n")).select(F.lit("errors").alias("counter"), "n")
        parts = parts.unionByName(n)
    return parts
