"""Streams cut into random micro-batches end where the batch job ends."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offerloom.operators.merge import merge_offers
from offerloom.plans.collect import run_and_store
from offerloom.schemas import OFFER, RAW_OFFER
from offerloom.sources import pointers
from offerloom.sources.versions import empty_registry, read_registry_table, snapshots, write_registry_table
from offerloom.streaming.jobs import (
    compact_tests,
    drain,
    expired_by,
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

START = datetime(2024, 1, 1)
SCHEMA = "domain string, code string, status string, ts timestamp"


def events(seed, n=300):
    rng = random.Random(seed)
    moments = sorted(rng.randrange(30 * 24 * 3600) for _ in range(n))
    return [
        (f"d{rng.randrange(3)}", f"c-{rng.randrange(12)}", rng.choice(["success", "failure"]), START + timedelta(seconds=s)) for s in moments
    ]


def in_batches(spark, rows, schema, path, batches=4):
    """One file per batch, in order, and the stream that reads one file at a time."""
    size = -(-len(rows) // batches)
    for i in range(batches):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1)
        part.write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_upsert(spark, tmp_path):
    rows = [
        tuple({"source_rank": 0, "page_key": "", "pos": i, "code": c, "store_domain": d, "source": s, "type": "fixed"}.get(f.name) for f in RAW_OFFER)
        for i, (d, c, s, _) in enumerate(events(1, 80))
    ]
    stream = in_batches(spark, rows, RAW_OFFER, str(tmp_path / "in"))
    base, now = str(tmp_path / "registry"), F.lit(START)
    drain(stream_upsert(stream, base, str(tmp_path / "cp"), now))
    assert snapshots(spark, base) == [1, 2, 3, 4]
    whole = merge_offers(empty_registry(spark)[0], spark.createDataFrame(rows, RAW_OFFER), now)
    keep = ["domain", "code", "source", "sources", "total", "worked", "last_seen"]
    assert rows_of(read_registry_table(spark, base)[0].select(keep)) == rows_of(whole.select(keep))


def raw(code, pos=0, **more):
    given = {"source_rank": 0, "page_key": "", "pos": pos, "code": code, "store_domain": "d", "source": "s", "success_rate": 0.5} | more
    return tuple(given.get(f.name) for f in RAW_OFFER)


def test_replayed_batch_is_skipped(spark, tmp_path):
    base, checkpoint = str(tmp_path / "registry"), tmp_path / "cp1"
    stream = in_batches(spark, [raw("A1")], RAW_OFFER, str(tmp_path / "in"), 1)
    drain(stream_upsert(stream, base, str(checkpoint), F.lit(START)))
    before = rows_of(read_registry_table(spark, base)[0])
    for name in ("0", ".0.crc"):
        (checkpoint / "commits" / name).unlink()  # as if the driver went before it noted the batch
    drain(stream_upsert(spark.readStream.schema(RAW_OFFER).parquet(str(tmp_path / "in")), base, str(checkpoint), F.lit(START)))
    assert snapshots(spark, base) == [1] and rows_of(read_registry_table(spark, base)[0]) == before


def test_streams_go_on_from_the_newest_snapshot(spark, tmp_path):
    """Two streams on a base that has versions already: nothing is lost and no version changes."""
    base = str(tmp_path / "registry")
    for code in ("AA11", "BB22", "CC33"):
        run_and_store(spark, base, spark.createDataFrame([raw(code)], RAW_OFFER), F.lit(START))
    stream = in_batches(spark, [raw("ST99"), raw("ST98", 1)], RAW_OFFER, str(tmp_path / "in"), 2)
    drain(stream_upsert(stream, base, str(tmp_path / "cp1"), F.lit(START)))
    titles = in_batches(spark, [(1, "AA11", "d"), (2, "ST98", "d.x")], "report_id long, code string, store_domain string", str(tmp_path / "reports"), 2)
    drain(stream_reports(titles, base, str(tmp_path / "cp2")))
    assert snapshots(spark, base) == [1, 2, 3, 4, 5, 6, 7]
    codes = [sorted(r.code for r in read_registry_table(spark, base, below=n + 1)[0].collect()) for n in (1, 3, 5, 7)]
    assert codes == [["AA11"], ["AA11", "BB22", "CC33"], ["AA11", "BB22", "CC33", "ST98", "ST99"], ["BB22", "CC33", "ST99"]]


def test_jobs_of_a_batch_do_not_grow_with_versions(spark, tmp_path):
    """A replayed batch runs no job on a base with many versions, and a batch as many as on one with few."""
    base, tracker = str(tmp_path / "registry"), spark.sparkContext.statusTracker()

    def jobs(run, group):
        """Jobs of a stream, counted under its own group (its run id)."""
        query = run()
        drain(query)
        return len(tracker.getJobIdsForGroup(str(query.runId)))

    counts = []
    for k in range(4):
        stream = in_batches(spark, [raw(f"ST{k}9")], RAW_OFFER, str(tmp_path / f"in{k}"), 1)
        counts.append(jobs(lambda stream=stream, k=k: stream_upsert(stream, base, str(tmp_path / f"cp{k}"), F.lit(START)), k))
        for n in range(2):
            run_and_store(spark, base, spark.createDataFrame([raw(f"R{k}{n}7")], RAW_OFFER), F.lit(START))
    assert len(set(counts[1:])) == 1, counts
    for name in ("0", ".0.crc"):
        (tmp_path / "cp0" / "commits" / name).unlink()
    before = snapshots(spark, base)
    again = spark.readStream.schema(RAW_OFFER).parquet(str(tmp_path / "in0"))
    assert jobs(lambda: stream_upsert(again, base, str(tmp_path / "cp0"), F.lit(START)), "again") == 0
    assert snapshots(spark, base) == before


def test_outcomes(spark, tmp_path):
    rows = events(2)
    out = str(tmp_path / "out")
    drain(to_table(stream_outcomes(in_batches(spark, rows, SCHEMA, str(tmp_path / "in"))), out))
    closed = rows[-1][3] - timedelta(hours=1)
    batch = (
        spark.createDataFrame(rows, SCHEMA).groupBy(F.date_trunc("day", "ts").alias("day"), "code", "status")
        .agg(F.count(F.lit(1)).alias("n")).filter(F.col("day") + F.expr("interval 1 day") <= F.lit(closed))
    )
    got = rows_of(spark.read.parquet(f"{out}/data").select("day", "code", "status", "n"))
    assert got and got == rows_of(batch)


def test_running_totals(spark, tmp_path):
    rows = events(3)
    out = str(tmp_path / "out")
    drain(to_changes(stream_tests(in_batches(spark, rows, SCHEMA, str(tmp_path / "in"))), out))
    batch = spark.createDataFrame(rows, SCHEMA).groupBy("domain", "code").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("worked")
    )
    assert rows_of(latest_tests(spark, out)) == rows_of(batch)


def test_changes_are_folded_into_a_base(spark, tmp_path):
    """Base and later changes give the totals; folded batches go one round later, and replays change nothing."""
    rows, out = events(4), str(tmp_path / "out")
    want = rows_of(
        spark.createDataFrame(rows, SCHEMA).groupBy("domain", "code")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("worked"))
    )
    drain(to_changes(stream_tests(in_batches(spark, rows, SCHEMA, str(tmp_path / "in"), 7)), out, compact_every=2))
    state = pointers.current(spark, out)
    assert state["low"] == 5 and len(state["parts"]) == 1
    assert sorted(p.name for p in (tmp_path / "out" / "changes").iterdir()) == ["batch=4", "batch=5", "batch=6"]
    assert rows_of(latest_tests(spark, out)) == want
    for batch in (5, 6):  # as if the driver went before it noted the last two batches
        for name in (str(batch), f".{batch}.crc"):
            (tmp_path / "out" / "checkpoint" / "commits" / name).unlink()
    again = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(to_changes(stream_tests(again), out, compact_every=2))
    assert rows_of(latest_tests(spark, out)) == want
    compact_tests(spark, out)
    assert pointers.current(spark, out)["low"] == 6 and rows_of(latest_tests(spark, out)) == want
    before = pointers.current(spark, out)
    compact_tests(spark, out)
    assert pointers.current(spark, out) == before


def test_dedupe(spark, tmp_path):
    """A repeat within the watermark is dropped; one long after it comes through again."""
    day = timedelta(days=1)
    rows = [("d", "a-1", "x", START), ("d", "A1", "x", START + day / 4), ("e", "B", "x", START + 4 * day), ("e", "C", "x", START + 5 * day), ("d", "a1", "x", START + 9 * day)]
    out = str(tmp_path / "out")
    drain(to_table(stream_dedupe(in_batches(spark, rows, SCHEMA, str(tmp_path / "in"), 5)), out))
    got = [(r.norm_code, r.ts) for r in spark.read.parquet(f"{out}/data").orderBy("ts").collect()]
    assert got == [("A1", START), ("B", START + 4 * day), ("C", START + 5 * day), ("A1", START + 9 * day)]


def test_reports(spark, tmp_path):
    offers = spark.createDataFrame([(f"d{d}", f"C{c}", 0) for d in range(3) for c in range(12)], "domain string, norm_code string, dup_no int")
    offers = spark.createDataFrame([], OFFER).unionByName(offers, allowMissingColumns=True)
    base = str(tmp_path / "registry")
    write_registry_table(offers, empty_registry(spark)[1], base, 0)
    rows = [(i, c, f"{d}.com") for i, (d, c, _, _) in enumerate(events(4, 20))]
    stream = in_batches(spark, rows, "report_id long, code string, store_domain string", str(tmp_path / "in"))
    drain(stream_reports(stream, base, str(tmp_path / "cp")))
    gone = {(d.removesuffix(".com"), c.replace("-", "").upper()) for _, c, d in rows}
    want = sorted((r.domain, r.norm_code) for r in offers.collect() if (r.domain, r.norm_code) not in gone)
    assert rows_of(read_registry_table(spark, base)[0].select("domain", "norm_code")) == want


@pytest.mark.parametrize("batches", [1, 4])
def test_expire(spark, tmp_path, batches):
    rows = events(5, 200)
    out = str(tmp_path / "out")
    stream = in_batches(spark, rows, SCHEMA, str(tmp_path / "in"), batches).select("domain", "code", "ts")
    drain(to_table(stream_expire(stream, days=3), out))
    batch = expired_by(spark.createDataFrame(rows, SCHEMA), F.lit(rows[-1][3]), days=3)
    got = rows_of(spark.read.parquet(f"{out}/data"))
    assert got and got == rows_of(batch)
