"""One collection run: read the registry, merge what was found, expire, apply reports, publish."""

from __future__ import annotations

import datetime
import functools
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.operators.dedupe import dedupe_source, union_sources
from offerloom.operators.containers import page_elements
from offerloom.operators.extract import (
    as_raw_offers,
    element_offers,
    extract_feed_offers,
    extract_markdown_offers,
    page_faults,
    readable_pages,
)
from offerloom.operators.lifecycle import (
    RETENTION_DAYS,
    drop_empty_stores,
    is_fresh,
    mark_reported,
    match_reports,
    prune_stale,
    run_summary,
)
from offerloom.operators.merge import (
    first_per_key,
    in_slice,
    keyed_offers,
    store_upsert_firsts,
    upsert_firsts,
)
from offerloom.schemas import RAW_OFFER, RUN
from offerloom.session import durable, stored, work_path
from offerloom.sources.profiles import PAGES, PageProfile
from offerloom.sources.store_keys import follow_stores
from offerloom.sources.versions import (
    BUCKETS,
    KEEP,
    Manifest,
    bucket_of,
    newest,
    read_buckets,
    read_registry_table,
    touched,
    write_changes,
)

ERRORS = "source string, error string"
#: Page errors that a run row lists itself; all of them are error rows.
LOGGED_ERRORS = 100


def collect_markdown(pages: DataFrame) -> DataFrame:
    """Unique offers of the Markdown source."""
    return dedupe_source(extract_markdown_offers(pages))


@dataclass
class Pages:
    """What stored pages gave: raw offers, an error row for each page that gave none, and the parsed elements."""

    offers: DataFrame
    errors: DataFrame
    elements: DataFrame


def collect_pages(captures: DataFrame, profiles: dict[str, PageProfile] = PAGES) -> Pages:
    """Offers and error rows of stored pages, which are parsed once: their elements are written in between.

    ``extract.dead_letters`` of the elements are the pages that could not be parsed.
    """
    spark = captures.sparkSession
    readable, errors = readable_pages(captures, profiles)
    elements, path = page_elements(readable, profiles), work_path(spark, "elements")
    elements.write.parquet(path)
    elements = spark.read.schema(elements.schema).parquet(path)
    return Pages(element_offers(elements, profiles), errors.unionByName(page_faults(elements)), elements)


@dataclass
class Collected:
    """Raw offers of all sources that could be read, an error row for each that could not, and one run row each."""

    offers: DataFrame
    errors: DataFrame
    runs: DataFrame


def collect_sources(spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame | Pages]]) -> Collected:
    """Raw offers of all sources, written source by source, so that one which fails while it is read stops no other.

    A source gives raw offers, or ``Pages``, whose page errors become error rows of their own while its other pages
    count. The run rows hold what was found, how long it took, and the first 100 errors (one more entry says how many
    follow); ``codesAdded`` and ``codesUpdated`` are 0 before the merge.
    """
    parts, failures, runs = [spark.createDataFrame([], RAW_OFFER)], [spark.createDataFrame([], ERRORS)], []
    base = work_path(spark, "collected")
    for number, (name, read) in enumerate(sources.items()):
        path, begun, found, told = f"{base}/source={number}", time.time(), 0, []
        try:
            given = read()
            pages = given if isinstance(given, Pages) else None
            as_raw_offers(pages.offers if pages else given).write.parquet(path)
            part = spark.read.schema(RAW_OFFER).parquet(path)
            found = part.count()
            parts.append(part)
            if pages:
                told = _written_errors(pages.errors, f"{base}/errors={number}", failures)
        except Exception as failure:  # one broken source must not stop the others
            told = [(str(failure).splitlines() or [type(failure).__name__])[0]]
            failures.append(spark.createDataFrame([(name, told[0])], ERRORS))
        moment = datetime.datetime.fromtimestamp(begun, datetime.timezone.utc)
        runs.append((moment, name, found, 0, 0, int((time.time() - begun) * 1000), told))
    return Collected(
        union_sources(parts), functools.reduce(DataFrame.unionByName, failures), spark.createDataFrame(runs, RUN)
    )


def _written_errors(errors: DataFrame, path: str, failures: list[DataFrame]) -> list[str]:
    """Writes the error rows of a source's pages, and names the first of them for the log."""
    errors.select("source", "error").write.parquet(path)
    rows = errors.sparkSession.read.schema(ERRORS).parquet(path)
    failures.append(rows)
    told = [row["error"] for row in rows.orderBy("error").limit(LOGGED_ERRORS).collect()]
    more = rows.count() - len(told)
    return [*told, f"and {more} more"] if more else told


def collect_all(
    feed: DataFrame | None = None,
    captures: DataFrame | None = None,
    markdown: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Raw offers of whatever inputs are there, and the error rows of pages that gave none."""
    parts, errors = [], None
    if feed is not None:
        parts.append(extract_feed_offers(feed))
    if markdown is not None:
        parts.append(collect_markdown(markdown))
    if captures is not None:
        pages = collect_pages(captures)
        parts.append(pages.offers)
        errors = pages.errors
    return union_sources(parts), errors


@dataclass
class RunResult:
    offers: DataFrame
    stores: DataFrame
    summary: DataFrame


def run_collection(
    registry: DataFrame,
    stores: DataFrame,
    incoming: DataFrame,
    now: Column,
    reports: DataFrame | None = None,
    errors: DataFrame | None = None,
    days: int = RETENTION_DAYS,
) -> RunResult:
    """Registry, stores and counters after one run.

    Incoming rows come straight from page parsing, so they are read once: their reduced form is
    checkpointed for offers and stores, the merged registry for the result and the counters.
    """
    firsts = durable(first_per_key(keyed_offers(incoming, now)))
    kept, summary = _after_run(registry, firsts, now, reports, errors, days)
    return RunResult(kept, drop_empty_stores(store_upsert_firsts(stores, firsts), kept), summary)


def _after_run(
    registry: DataFrame, firsts: DataFrame, now: Column, reports: DataFrame | None, errors: DataFrame | None, days: int
) -> tuple[DataFrame, DataFrame]:
    """Offers that are left of ``registry`` with ``firsts`` merged in, and the counters."""
    merged = durable(upsert_firsts(registry, firsts, now))
    kept = prune_stale(merged.drop("is_new", "rows"), now, days)
    removed = None
    if reports is not None:
        marked = durable(mark_reported(kept, reports))
        removed = marked.filter("reported")
        kept = marked.filter("not reported").drop("reported")
    summary = run_summary(merged, now, removed, errors, days)
    summary = summary.filter(F.col("counter") != "total").unionByName(
        kept.agg(F.lit("total").alias("counter"), F.count(F.lit(1)).alias("n"))
    )
    return kept, summary


def upsert_into(
    spark: SparkSession,
    base: str,
    version: Manifest | None,
    incoming: DataFrame,
    now: Column,
    stream: tuple[str, int] | None = None,
    keep: int | None = KEEP,
    slices: int = 1,
) -> Manifest:
    """Merge raw offers into ``version`` and write the next one; only buckets with one of their keys are read and written.

    With ``slices``, so many parts of the stores are merged one after the other (``merge.in_slice``), so that the disk holds
    the shuffle files of one of them. The incoming rows and the buckets are then read once for each, so ``incoming`` and
    ``now`` must come out the same every time.
    """
    keyed = keyed_offers(incoming, now)
    size, held = version.buckets if version else BUCKETS, []
    try:
        for number in range(slices):
            held.append(stored(first_per_key(in_slice(keyed, F.col("domain"), (number, slices))), "firsts"))
        firsts = functools.reduce(DataFrame.unionByName, (part.rows for part in held))
        hit, shops = touched(firsts, "offers", size), touched(firsts, "stores", size)
        known = read_buckets(spark, base, version, "offers", hit)
        before = read_buckets(spark, base, version, "stores", shops)
        merged_stores = stored(store_upsert_firsts(before, firsts), "stores")
        stores, held = merged_stores.rows, [*held, merged_stores]

        def merged() -> Iterator[DataFrame]:
            for number, part in enumerate(held[:slices]):
                yield upsert_firsts(in_slice(known, F.col("domain"), (number, slices)), part.rows, now).drop("is_new", "rows")
                part.drop()

        follow_stores(spark, base, read_buckets(spark, base, version, "stores"), stores.join(before, "domain", "left_anti"))
        return write_changes(spark, base, version, (merged(), hit), (stores, shops), stream, keep)
    finally:
        for part in held:
            part.drop()


def run_and_store(
    spark: SparkSession,
    base: str,
    incoming: DataFrame,
    now: Column,
    reports: DataFrame | None = None,
    errors: DataFrame | None = None,
    days: int = RETENTION_DAYS,
    keep: int | None = KEEP,
) -> RunResult:
    """A run on the newest version below ``base`` that writes the next one.

    Merged, expired and written are only the buckets that hold a key of the run, an offer that expires, or a reported
    one; of the others, expiry reads the two times, reports read the keys, and empty stores read the domains.
    """
    version = newest(spark, base)
    size = version.buckets if version else BUCKETS
    registry, stores = (read_buckets(spark, base, version, kind) for kind in ("offers", "stores"))
    firsts = durable(first_per_key(keyed_offers(incoming, now)))
    hit = touched(firsts, "offers", size) | touched(registry.filter(~is_fresh(now, days)), "offers", size)
    if reports is not None:
        hit |= touched(match_reports(registry, reports), "offers", size)
    kept, summary = _after_run(read_buckets(spark, base, version, "offers", hit), firsts, now, reports, errors, days)
    others = sum(rows for bucket, (_, rows) in (version.offers if version else {}).items() if bucket not in hit)
    summary = summary.withColumn("n", F.when(F.col("counter") == "total", F.col("n") + others).otherwise(F.col("n")))

    untouched = read_buckets(spark, base, version, "offers", set(range(size)) - hit)
    known = store_upsert_firsts(stores, firsts)
    left = durable(drop_empty_stores(known, kept.select("domain").unionByName(untouched.select("domain"))))
    changed = stores.join(left, "domain", "left_anti").select("domain").unionByName(left.join(stores, "domain", "left_anti").select("domain"))
    shops = touched(changed, "stores", size)
    follow_stores(spark, base, stores, left.join(stores, "domain", "left_anti"))
    of_shops = left.filter(bucket_of("stores", size).isin(*shops)) if shops else left.limit(0)
    write_changes(spark, base, version, (kept, hit), (of_shops, shops), keep=keep)
    return RunResult(*read_registry_table(spark, base), summary)
