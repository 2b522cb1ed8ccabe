"""Structured Streaming forms of the run: upsert, outcomes, repeats, reports, expiry.

Every job is one streaming query.  Where a micro-batch changes the registry, it writes the buckets it
touches as the next version, whose manifest names the stream's last batch, so a replayed batch is skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from offerloom.functions.codes import norm_code
from offerloom.operators.lifecycle import RETENTION_DAYS, match_reports
from offerloom.plans.collect import upsert_into
from offerloom.session import durable
from offerloom.sources import pointers
from offerloom.sources.versions import (
    BUCKETS,
    KEEP,
    Manifest,
    file_system,
    names_in,
    newest,
    path_exists,
    read_buckets,
    read_small,
    touched,
    write_changes,
)


def drain(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query; raises what it raised."""
    query.awaitTermination()


def to_table(stream: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to Parquet until its input is used up."""
    return (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


#: What a stream's batch does: (newest version, batch, (stream, number of the batch)) to the next version.
Change = Callable[[Manifest | None, DataFrame, tuple[str, int]], object]


def _each_batch(stream: DataFrame, base: str, checkpoint: str, name: str, change: Change) -> StreamingQuery:
    """Turn the newest version below ``base`` into the next one with every micro-batch.

    The manifest holds the last batch of each stream (named by the query's id in its checkpoint), so a batch that comes
    again is told by the newest manifest alone, however many versions there are. Several streams and plain runs may
    share a base, one writer at a time.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        writer = f"{name} {read_small(spark, f'{checkpoint}/metadata').strip()}"  # new for a new checkpoint
        version = newest(spark, base)
        if version is None or version.streams.get(writer, -1) < number:
            change(version, batch, (writer, number))

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_upsert(
    incoming: DataFrame, base: str, checkpoint: str, now: Column | None = None, keep: int | None = KEEP
) -> StreamingQuery:
    """Merge every micro-batch of raw offers into the newest registry below ``base``.

    Only buckets with a key of the batch are read and written; all but the newest ``keep`` versions go.
    """

    def merge(version: Manifest | None, batch: DataFrame, stream: tuple[str, int]) -> None:
        moment = F.current_timestamp() if now is None else now
        upsert_into(batch.sparkSession, base, version, batch, moment, stream, keep)

    return _each_batch(incoming, base, checkpoint, "upsert", merge)


def stream_reports(reports: DataFrame, base: str, checkpoint: str, keep: int | None = KEEP) -> StreamingQuery:
    """Remove reported offers as reports arrive, one version per micro-batch.

    Earlier reports were applied to the version a batch starts from, so only its own are needed. The keys of all offers
    are matched; only buckets with a hit are written.
    """

    def remove(version: Manifest | None, batch: DataFrame, stream: tuple[str, int]) -> None:
        spark = batch.sparkSession
        hits = durable(match_reports(read_buckets(spark, base, version, "offers"), batch))
        hit = touched(hits, "offers", version.buckets if version else BUCKETS)
        left = read_buckets(spark, base, version, "offers", hit).join(hits, ["domain", "norm_code"], "left_anti")
        write_changes(spark, base, version, (left, hit), None, stream, keep)

    return _each_batch(reports, base, checkpoint, "reports", remove)


def stream_outcomes(
    attempts: DataFrame, ts: str = "ts", width: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Attempts per code, status and time window, each window once it is complete."""
    return (
        attempts.withWatermark(ts, delay)
        .groupBy(F.window(ts, width), "code", "status")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("day"), "code", "status", "n")
    )


def stream_tests(attempts: DataFrame) -> DataFrame:
    """Running attempts and successes per offer, for an ``update`` sink."""
    return attempts.groupBy("domain", "code").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("worked"),
    )


#: Totals as they are stored.
TESTS = T.StructType([T.StructField(n, k) for n, k in (("domain", T.StringType()), ("code", T.StringType()), ("total", T.LongType()), ("worked", T.LongType()))])
#: Batches of changes that are folded into the base together.
COMPACT_EVERY = 50


def to_changes(stream: DataFrame, path: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Write the changed totals of every micro-batch below ``path``, and fold them into a base now and then.

    A replay overwrites its batch; one that the base holds already is skipped.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number > pointers.current(spark, path).get("low", -1):
            batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
            if (number + 1) % compact_every == 0:
                compact_tests(spark, path)

    return (
        stream.writeStream.foreachBatch(write_batch)
        .outputMode("update")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches of changes that are there whole."""
    names = [name for name in names_in(spark, f"{path}/changes") if name.startswith("batch=")]
    return sorted(int(name[6:]) for name in names if path_exists(spark, f"{path}/changes/{name}/_SUCCESS"))


def _totals(spark: SparkSession, path: str, base: dict, batches: list[int]) -> DataFrame:
    rows = pointers.read_parts(spark, path, TESTS, base)
    if batches:
        folders = (f"{path}/changes/batch={number}" for number in batches)
        rows = rows.unionByName(spark.read.schema(TESTS).parquet(*folders))
    newest = rows.groupBy("domain", "code").agg(F.max("total").alias("total"), F.max("worked").alias("worked"))
    return newest.select(*TESTS.names)


def compact_tests(spark: SparkSession, path: str) -> None:
    """Fold all changes so far into a new base, which states the last batch it holds (the low-water mark).

    The base before it and its batches stay until the next time, for readers that are under way.
    """
    before = pointers.current(spark, path)
    batches = [n for n in _batches(spark, path) if n > before.get("low", -1)]
    if not batches:
        return
    part = pointers.write_part(_totals(spark, path, before, batches), path)
    pointers.point(spark, path, before, [part], low=batches[-1])
    pointers.clear(spark, path, keep=2)
    system, root, jvm = file_system(spark, path)
    for number in _batches(spark, path):
        if number <= before.get("low", -1):
            system.delete(jvm.org.apache.hadoop.fs.Path(root, f"changes/batch={number}"), True)


def latest_tests(spark: SparkSession, path: str) -> DataFrame:
    """Newest totals per offer: the base, and the batches since; totals only grow."""
    base = pointers.current(spark, path)
    return _totals(spark, path, base, [n for n in _batches(spark, path) if n > base.get("low", -1)])


def stream_dedupe(offers: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Offers whose (domain, normal code) was not seen within the watermark."""
    return (
        offers.withColumn("norm_code", norm_code(F.col("code")))
        .withWatermark(ts, delay)
        .dropDuplicatesWithinWatermark(["domain", "norm_code"])
    )


def expiries(sightings: DataFrame, ts: str = "ts", days: int = RETENTION_DAYS) -> DataFrame:
    """Runs of sightings closer than ``days``; each ends in an expiry row.

    A session window with the retention as its gap is exactly that: it closes ``days`` after the
    last sighting.  Works on a table and, behind a watermark, on a stream, without Python state.

    The end is worked out from the last sighting: a filter on the window itself would be pushed below
    the grouping, where the sightings are not merged yet.
    """
    seen = sightings.groupBy(F.session_window(ts, f"{days} days"), "domain", "code").agg(
        F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("sightings")
    )
    ends = F.col("last_seen") + F.make_interval(days=F.lit(days))
    return seen.select("domain", "code", "last_seen", ends.alias("expired_at"), "sightings")


def stream_expire(
    sightings: DataFrame, ts: str = "ts", days: int = RETENTION_DAYS, delay: str = "0 seconds"
) -> DataFrame:
    """An expiry row for every offer the stream has not shown for ``days``."""
    return expiries(sightings.withWatermark(ts, delay), ts, days)


def expired_by(sightings: DataFrame, watermark: Column, ts: str = "ts", days: int = RETENTION_DAYS) -> DataFrame:
    """What ``stream_expire`` has emitted once its watermark has reached ``watermark``."""
    return expiries(sightings, ts, days).filter(F.col("expired_at") <= watermark)
