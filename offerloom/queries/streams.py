"""The event table replayed as a stream through every streaming job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.operators.extract import as_raw_offers
from offerloom.plans.collect import upsert_into
from offerloom.queries.common import sql_stamp, stamp, table
from offerloom.queries.registry import (
    EVENTS_K,
    REPORTED_REMOVED,
    event_registry,
)
from offerloom.schemas import OFFER
from offerloom.session import work_path
from offerloom.sources.reports import parse_reports
from offerloom.sources.versions import (
    empty_registry,
    file_system,
    names_in,
    newest,
    read_registry_table,
    write_registry_table,
)
from offerloom.streaming.jobs import (
    drain,
    latest_tests,
    stream_dedupe,
    stream_expire,
    stream_outcomes,
    stream_reports,
    stream_tests,
    stream_upsert,
    to_changes,
    to_table,
)

NOW = "2024-02-01 00:00:00"
GAP_DAYS = 2


#: The events are replayed in slices of so many days, one micro-batch each.
SLICE_DAYS = 6


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of several micro-batches in the order of time, with the number inside the properties."""
    path = work_path(spark, "event-slices")
    events = table(spark, sf_dir, "events")
    sliced = events.withColumn("slice", F.floor(F.datediff("ts", F.lit("2024-01-01")) / SLICE_DAYS).cast("int"))
    sliced.repartition("slice").sortWithinPartitions("slice", "ts", "event_id").write.partitionBy("slice").parquet(path)
    in_order(spark, path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    return stream.select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").alias("k"),
        F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string"), F.lit(".example.com")).alias("domain"),
    )


def in_order(spark: SparkSession, path: str) -> None:
    """Give the files below ``path`` times in the order of their slices: a file stream reads the oldest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    slices = [s.getPath() for s in system.listStatus(root) if s.isDirectory()]
    slices.sort(key=lambda p: int(p.getName().rpartition("=")[2]))
    for nth, folder in enumerate(slices):  # a handful of files
        for status in system.listStatus(folder):
            system.setTimes(status.getPath(), (1_700_000_000 + nth) * 1000, -1)


def forget_last_batch(spark: SparkSession, checkpoint: str) -> None:
    """Leave a checkpoint as if the driver had gone before it noted that the last batch was done."""
    system, folder, jvm = file_system(spark, f"{checkpoint}/commits")
    last = max(int(name) for name in names_in(spark, f"{checkpoint}/commits") if name.isdigit())
    for name in (str(last), f".{last}.crc"):
        system.delete(jvm.org.apache.hadoop.fs.Path(folder, name), False)


def _raw(rows: DataFrame, pos: str, code: Column, domain: Column, source: Column) -> DataFrame:
    return as_raw_offers(
        rows.select(
            F.lit(0).alias("source_rank"), F.lit("").alias("page_key"), F.col(pos).cast("long").alias("pos"), code.alias("code"),
            domain.alias("store_name"), domain.alias("store_domain"), F.lit("5% off all of it").alias("description"),
            F.lit("unknown").alias("type"), source.alias("source"),
        )
    )


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events merged batch by batch into a base that has two versions already; the last batch comes twice."""
    base = work_path(spark, "stream-registry")
    registry, checkpoint = f"{base}/registry", f"{base}/checkpoint"
    supplier = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    for code in ("BASE1", "BASE2"):
        offers = _raw(supplier, "s_suppkey", F.lit(code), F.concat(F.lit("b"), key, F.lit(".example.com")), F.lit("base"))
        upsert_into(spark, registry, newest(spark, registry), offers, F.lit(NOW))
    incoming = _raw(event_stream(spark, sf_dir), "event_id", F.col("k"), F.col("domain"), F.col("event_type"))
    drain(stream_upsert(incoming, registry, checkpoint, F.lit(NOW)))
    forget_last_batch(spark, checkpoint)
    drain(stream_upsert(incoming, registry, checkpoint, F.lit(NOW)))
    offers, _ = read_registry_table(spark, registry)
    return offers.select("domain", "code", "type", "source", F.array_join("sources", "|").alias("sources"), F.col("ord.pos").alias("pos"))


UPSERTED = f"""
WITH e AS (SELECT 's' || (user_id % 10) || '.example.com' AS domain, CAST(k AS VARCHAR) AS code, event_type, event_id FROM {EVENTS_K}),
     t AS (SELECT domain, code, event_type, min(event_id) AS first FROM e GROUP BY 1, 2, 3)
SELECT domain, code, 'percentage' AS type, arg_min(event_type, first) AS source,
       array_to_string(list(event_type ORDER BY first), '|') AS sources, min(first) AS pos FROM t GROUP BY 1, 2
UNION ALL
SELECT 'b' || s_suppkey || '.example.com', code, 'percentage', 'base', 'base', s_suppkey FROM supplier, (VALUES ('BASE1'), ('BASE2')) AS v(code)
"""


def day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = event_stream(spark, sf_dir).select("ts", F.col("domain").alias("code"), F.col("event_type").alias("status"))
    path = work_path(spark, "stream-outcomes")
    drain(to_table(stream_outcomes(attempts), path))
    return spark.read.parquet(f"{path}/data").select(stamp(F.col("day")).alias("day"), "code", "status", "n")


DAY_COUNTS = f"""
WITH e AS (SELECT date_trunc('day', ts) AS day, 's' || (user_id % 10) || '.example.com' AS code, event_type AS status FROM events)
SELECT {sql_stamp('CAST(day AS TIMESTAMP)')} AS day, code, status, count(*) AS n FROM e
WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL
"""


def running_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals: a base of the first batches, and the changes of the rest."""
    status = F.when(F.col("event_type") == "purchase", F.lit("success")).otherwise(F.lit("failure"))
    attempts = event_stream(spark, sf_dir).select("domain", F.col("k").alias("code"), status.alias("status"))
    path = work_path(spark, "stream-tests")
    drain(to_changes(stream_tests(attempts), path, compact_every=2))
    return latest_tests(spark, path)


RUNNING_TESTS = f"""
SELECT 's' || (user_id % 10) || '.example.com' AS domain, CAST(k AS VARCHAR) AS code, count(*) AS total,
       count(*) FILTER (WHERE event_type = 'purchase') AS worked FROM {EVENTS_K} GROUP BY 1, 2
"""


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = event_stream(spark, sf_dir).select("ts", "domain", F.concat(F.lit("k-"), "k").alias("code"))
    path = work_path(spark, "stream-dedupe")
    drain(to_table(stream_dedupe(offers), path))
    return spark.read.parquet(f"{path}/data").select("domain", "norm_code", stamp(F.col("ts")).alias("ts"))


# A key is let through when the stream holds no state for it. Its state ends in the first batch whose watermark - the
# latest time of the batches before, less a day - lies over a day behind the row that was let through.
DEDUPED = f"""
WITH RECURSIVE e AS (SELECT 's' || (user_id % 10) || '.example.com' AS domain, 'K' || k AS norm_code, ts,
                            CAST(floor(date_diff('day', TIMESTAMP '2024-01-01', ts) / {SLICE_DAYS}) AS INTEGER) AS slice FROM {EVENTS_K}),
     f AS (SELECT domain, norm_code, slice, min(ts) AS ts FROM e GROUP BY ALL),
     b AS (SELECT slice, max(max(ts)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS watermark FROM e GROUP BY slice),
     g AS (SELECT f.*, coalesce((SELECT min(b.slice) FROM b WHERE b.slice > f.slice AND b.watermark > f.ts + INTERVAL 1 DAY), 1000000) AS ends FROM f),
     n AS (SELECT g.*, (SELECT min(h.slice) FROM f h WHERE h.domain = g.domain AND h.norm_code = g.norm_code AND h.slice > g.ends) AS next FROM g),
     out AS (SELECT n.* FROM n WHERE slice = (SELECT min(slice) FROM f h WHERE h.domain = n.domain AND h.norm_code = n.norm_code)
             UNION ALL SELECT n.* FROM out JOIN n ON n.domain = out.domain AND n.norm_code = out.norm_code AND n.slice = out.next)
SELECT domain, norm_code, {sql_stamp('ts')} AS ts FROM out
"""


def reports_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_path(spark, "stream-reports")
    _, stores = empty_registry(spark)
    offers = event_registry(spark, sf_dir).withColumn("dup_no", F.lit(0))
    nothing = spark.createDataFrame([], OFFER)
    for part in (offers.filter("length(norm_code) < 2"), offers):  # a base with versions, written before the stream
        write_registry_table(nothing.unionByName(part, allowMissingColumns=True), stores, f"{base}/registry")
    errors = event_stream(spark, sf_dir).filter(F.col("event_type") == "error")
    titles = errors.select(
        F.col("event_id").alias("report_id"),
        F.concat(F.lit("Code failed: "), "k", F.lit(" @ s"), F.col("user_id").cast("string"), F.lit(".example.org")).alias("title"),
    )
    drain(stream_reports(parse_reports(titles), f"{base}/registry", f"{base}/checkpoint"))
    left, _ = read_registry_table(spark, f"{base}/registry")
    return left.select("domain", "norm_code")


def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    sightings = event_stream(spark, sf_dir).select("ts", "domain", F.col("k").alias("code"))
    path = work_path(spark, "stream-expire")
    drain(to_table(stream_expire(sightings, days=GAP_DAYS), path))
    return spark.read.parquet(f"{path}/data").select(
        "domain", "code", stamp(F.col("last_seen")).alias("last_seen"), stamp(F.col("expired_at")).alias("expired_at"), "sightings"
    )


EXPIRED = f"""
WITH e AS (SELECT 's' || (user_id % 10) || '.example.com' AS domain, CAST(k AS VARCHAR) AS code, ts FROM {EVENTS_K}),
     g AS (SELECT *, ts >= lag(ts) OVER (PARTITION BY domain, code ORDER BY ts) + INTERVAL {GAP_DAYS} DAY AS gap FROM e),
     r AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY domain, code ORDER BY ts) AS run FROM g),
     s AS (SELECT domain, code, run, max(ts) AS last_seen, count(*) AS sightings FROM r GROUP BY 1, 2, 3)
SELECT domain, code, {sql_stamp('last_seen')} AS last_seen, {sql_stamp(f'last_seen + INTERVAL {GAP_DAYS} DAY')} AS expired_at, sightings
FROM s WHERE last_seen + INTERVAL {GAP_DAYS} DAY <= (SELECT max(ts) FROM events)
"""

QUERIES = {
    "q_stream_upsert": upserted,
    "q_stream_outcomes": day_counts,
    "q_stream_tests": running_tests,
    "q_stream_dedupe": deduped,
    "q_stream_reports": reports_applied,
    "q_stream_expire": expired,
}

SQL = {
    "q_stream_upsert": UPSERTED,
    "q_stream_outcomes": DAY_COUNTS,
    "q_stream_tests": RUNNING_TESTS,
    "q_stream_dedupe": DEDUPED,
    "q_stream_reports": REPORTED_REMOVED,
    "q_stream_expire": EXPIRED,
}
