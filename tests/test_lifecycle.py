"""Expiry, reports, publication, snapshots, run log, whole runs."""

import glob
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offerloom.operators.lifecycle import (
    count_stale,
    drop_empty_stores,
    prune_stale,
    registry_meta,
    remove_reported,
    reports_with_effect,
    source_summary,
)
from offerloom.operators.merge import upsert_firsts
from offerloom.operators.ranking import with_position
from offerloom.plans import collect
from offerloom.plans.collect import run_and_store
from offerloom.queries import common
from offerloom.queries import registry as samples
from offerloom.queries.registry import logged_last_runs
from offerloom.schemas import OFFER, RAW_OFFER, STORE
from offerloom.session import shared_dir
from offerloom.sources import pointers
from offerloom.sources import registry as document
from offerloom.sources.dimensions import load_dimensions
from offerloom.sources.registry import document_lines, export_registry_json, read_registry, single_document, store_parts
from offerloom.sources.reports import (
    append_run_log,
    last_runs,
    last_runs_per_source,
    parse_reports,
    read_reports,
    read_run_log,
    trim_run_log,
)
from offerloom.sources.versions import empty_registry, manifest, read_registry_table, snapshots, write_registry_table

NOW = datetime(2024, 6, 1)


def registry(spark, rows, schema):
    offers, _ = empty_registry(spark)
    return offers.unionByName(spark.createDataFrame(rows, schema), allowMissingColumns=True)


def test_prune(spark):
    day = timedelta(days=1)
    rows = [
        ("d", "exact", NOW - 90 * day, NOW), ("d", "older", NOW - 91 * day, NOW), ("d", "newer", NOW - 89 * day, None),
        ("d", "added", None, NOW - day), ("e", "none", None, None), ("e", "addedold", None, NOW - 200 * day),
    ]
    offers = registry(spark, rows, "domain string, norm_code string, last_seen timestamp, added_at timestamp")
    kept = prune_stale(offers, F.lit(NOW))
    assert sorted(r.norm_code for r in kept.collect()) == ["added", "newer"]
    assert count_stale(offers, F.lit(NOW)).first().pruned == 4
    stores = spark.createDataFrame([("d",), ("e",)], "domain string")
    assert [r.domain for r in drop_empty_stores(stores, kept).collect()] == ["d"]
    meta = registry_meta(kept, F.lit(NOW)).first()
    assert (meta.total_codes, meta.version, meta.last_updated) == (2, "1.0", NOW)


def test_reports(spark):
    offers = registry(
        spark,
        [("shop.com", "AB1", 0), ("my-shop.net", "AB1", 0), ("other.com", "AB1", 0), ("shop.com", "CD2", 0), ("a.b", "X", 0)],
        "domain string, norm_code string, dup_no int",
    )
    titles = spark.createDataFrame(
        [(1, "❌ Code failed: ab-1 @ shop.co.uk "), (2, "Code failed: AB1 @ my-shop.net"), (3, "Code failed: ZZ @ shop.com"),
         (4, "Code failed ZZ @ shop.com"), (5, "Code failed: X @ .b")],
        "report_id long, title string",
    )
    reports = parse_reports(titles)
    assert [tuple(r) for r in reports.orderBy("report_id").collect()][:2] == [(1, "ab-1", "shop.co.uk"), (2, "AB1", "my-shop.net")]
    left = remove_reported(offers, reports).collect()
    assert sorted((r.domain, r.norm_code) for r in left) == [("other.com", "AB1"), ("shop.com", "CD2")]
    effect = reports_with_effect(offers, reports).orderBy("report_id").collect()
    assert [(r.report_id, r.removed) for r in effect] == [(1, 2), (2, 0), (3, 0), (5, 1)]
    assert parse_reports(titles, limit=2).count() == 1


def test_read_reports(spark, tmp_path):
    path = str(tmp_path / "reports")
    spark.range(150).select(F.col("id").alias("report_id"), F.lit("Code failed: a @ b").alias("title")).write.parquet(path)
    assert read_reports(spark, path).count() == 150 and read_reports(spark, path, 100).count() == 100


DOCUMENT = {
    "meta": {"lastUpdated": "2024-01-01T00:00:00.000Z", "totalCodes": 4, "version": "1.0", "sources": []},
    "stores": {
        "z.com": {"name": "Zed", "category": "general", "codes": [
            {"code": "A-1", "description": "d", "type": "fixed", "value": 5, "minSpend": None, "expiry": "2024-12-31", "source": "s", "sources": ["s", "t"],
             "url": "u", "addedAt": "2024-01-01T00:00:00.000Z", "lastSeen": "2024-02-01T10:00:00.000Z",
             "testResults": {"total": 4, "worked": 3, "lastTested": None}},
            {"code": "a1", "addedAt": "2024-01-01T00:00:00.000Z"},
            {"code": "BAD", "addedAt": "2024-05-31T00:00:00.000Z", "lastSeen": "not a date"}]},
        "empty.com": {"name": "Empty", "category": "x", "codes": []},
        "a.com": {"name": "Ay", "category": "general", "codes": [{"code": "B2", "lastSeen": "2024-05-31T00:00:00.000Z"}]},
    },
}


def test_document(spark, tmp_path):
    path = tmp_path / "registry.json"
    path.write_text(json.dumps(DOCUMENT, indent=2))
    offers, stores = read_registry(spark, str(path), pretty=True)
    assert [(f.name, f.dataType) for f in offers.schema if f.name != "ord"] == [(f.name, f.dataType) for f in OFFER if f.name != "ord"]
    rows = {(r.domain, r.code): r for r in offers.collect()}
    first = rows["z.com", "A-1"]
    assert (first.norm_code, first.value, str(first.expiry), first.sources, first.total, first.worked) == ("A1", 5.0, "2024-12-31", ["s", "t"], 4, 3)
    assert (first.dup_no, rows["z.com", "a1"].dup_no) == (0, 1)
    assert [r.name for r in stores.orderBy("ord").collect()] == ["Zed", "Empty", "Ay"]
    # An unreadable time counts as stale even though the offer was added lately.
    assert {r.code for r in prune_stale(offers, F.lit(NOW)).collect()} == {"B2"}
    for single in (False, True):
        target = str(tmp_path / f"out-{single}")
        export_registry_json(offers, stores, target, F.lit(NOW), single)
        again, named = read_registry(spark, target, pretty=single)
        keep = [f.name for f in OFFER]  # places too
        assert sorted(map(str, again.select(keep).collect())) == sorted(map(str, offers.select(keep).collect()))
        assert {r.name for r in named.collect()} == {"Zed", "Ay"}
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "out-True" / "part-*")))
    lines = [json.loads(text)]
    assert list(lines[0]["stores"]) == ["z.com", "a.com"] and lines[0]["meta"]["totalCodes"] == 4
    assert lines[0]["stores"]["z.com"]["codes"][0]["lastSeen"] == "2024-02-01T10:00:00.000Z"


def test_missing_document(spark, tmp_path):
    offers, stores = read_registry(spark, str(tmp_path / "absent"))
    assert offers.count() == 0 and stores.count() == 0


def test_large_store_is_cut_into_parts_in_order(spark, tmp_path):
    rows = [("hot.com", f"C{i}", 0, f"C{i}") for i in range(500)] + [("cold.com", "X", 0, "X")]
    offers = registry(spark, rows, "domain string, norm_code string, dup_no int, code string")
    place = F.struct(F.timestamp_seconds(F.lit(5)).alias("run"), F.lit(1).alias("source_rank"), F.lit("p").alias("page_key"), F.substring("code", 2, 9).try_cast("long").alias("pos"))
    offers = offers.withColumn("ord", place)
    stores = spark.createDataFrame([], STORE)
    parts = store_parts(offers, stores, 50).orderBy("part").collect()
    hot = [c for c in parts if c.domain == "hot.com"]
    assert [c.part for c in hot] == list(range(10)) and {len(c.codes) for c in hot} == {50}
    assert [code.code for c in hot for code in c.codes] == [r[1] for r in rows[:-1]]
    for frame, pretty in ((document_lines(offers, stores, F.lit(NOW), 50), False), (single_document(offers, stores, F.lit(NOW), 50), True)):
        target = str(tmp_path / str(pretty))
        frame.coalesce(1).write.text(target)
        again, _ = read_registry(spark, target, pretty)
        assert [r.code for r in again.filter("domain = 'hot.com'").orderBy("ord").collect()] == [r[1] for r in rows[:-1]]
    empty = single_document(spark.createDataFrame([], OFFER), stores, F.lit(NOW)).collect()
    assert json.loads("".join(r.value for r in empty))["stores"] == {}


def test_snapshots(spark, tmp_path):
    base = str(tmp_path / "registry")
    offers = registry(spark, [("a", "A", 0)], "domain string, norm_code string, dup_no int")
    stores = spark.createDataFrame([], STORE)
    assert snapshots(spark, base) == [] and read_registry_table(spark, base)[0].count() == 0
    write_registry_table(offers, stores, base, 1)
    write_registry_table(offers.union(offers.withColumn("dup_no", F.lit(1))), stores, base, 2)
    (tmp_path / "registry" / "offers" / "v=3-unfinished").mkdir()
    (tmp_path / "registry" / "versions" / ".00000003.json-x").write_text("{")
    assert snapshots(spark, base) == [1, 2]
    assert read_registry_table(spark, base)[0].count() == 2 and read_registry_table(spark, base, below=2)[0].count() == 1
    with pytest.raises(FileExistsError):
        write_registry_table(offers, stores, base, 2)
    assert snapshots(spark, base) == [1, 2] and read_registry_table(spark, base)[0].count() == 2


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    base, (offers, stores) = str(tmp_path / "registry"), empty_registry(spark)
    many = spark.range(0, 40000, 1, 8).select(F.lit("a").alias("domain"), F.sha2(F.col("id").cast("string"), 256).alias("norm_code"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "256k")
    try:
        write_registry_table(offers.unionByName(many, allowMissingColumns=True), stores, base, buckets=1)
    finally:
        spark.conf.unset(size)
    assert len(files(base)) > 1
    assert read_registry_table(spark, base)[0].select("norm_code").distinct().count() == 40000


def files(base):
    return {path[len(base) :] for path in glob.glob(f"{base}/*/v=*/bucket=*/*.parquet")}


def test_a_run_writes_the_buckets_it_touches(spark, tmp_path):
    """A run that changes k keys leaves the files of all other buckets alone; every version can still be read."""
    base, day = str(tmp_path / "registry"), timedelta(days=1)
    names = [f.name for f in RAW_OFFER]

    def raw(codes, domain="shop.com"):
        rows = [{"pos": i, "code": c, "store_domain": domain, "source": "x"} for i, c in enumerate(codes)]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW_OFFER)

    run_and_store(spark, base, raw([f"CODE{k}" for k in range(400)]), F.lit(NOW))
    run_and_store(spark, base, raw(["ALONE1"], "alone.com"), F.lit(NOW - 80 * day))
    first, before = manifest(spark, base, 2), files(base)
    assert len(first.offers) == first.buckets and sum(rows for _, rows in first.offers.values()) == 401

    summary = run_and_store(spark, base, raw(["CODE7", "NEW1"]), F.lit(NOW + day)).summary
    assert {r.counter: r.n for r in summary.collect()} == {"found": 2, "added": 1, "updated": 1, "pruned": 0, "total": 402}
    second, added = manifest(spark, base, 3), files(base) - before
    changed = {b for b in second.offers if second.offers[b] != first.offers.get(b)}
    assert 1 <= len(changed) <= 2 and second.stores == first.stores
    assert len(added) == len(changed) and before <= files(base)

    # An offer expires and a store becomes empty, a report takes another; their buckets alone are written.
    reports = spark.createDataFrame([(1, "code9", "shop.com")], "report_id long, code string, store_domain string")
    result = run_and_store(spark, base, raw([]), F.lit(NOW + 11 * day), reports)
    assert {r.counter: r.n for r in result.summary.collect()} == {"found": 0, "added": 0, "updated": 0, "pruned": 1, "removed": 1, "total": 400}
    third = manifest(spark, base, 4)
    assert len({b for b in second.offers if second.offers[b] != third.offers.get(b)}) <= 2
    assert [r.domain for r in result.stores.collect()] == ["shop.com"]
    counts = [read_registry_table(spark, base, below=n + 1)[0].count() for n in (1, 2, 3, 4)]
    assert counts == [400, 401, 402, 400]


def test_old_versions_go_and_shared_buckets_stay(spark, tmp_path):
    base = str(tmp_path / "registry")
    names = [f.name for f in RAW_OFFER]
    for k in range(5):
        rows = [tuple({"pos": i, "code": c, "store_domain": "d", "source": "x"}.get(n) for n in names) for i, c in enumerate([f"A{k}1", f"B{k}2"])]
        run_and_store(spark, base, spark.createDataFrame(rows, RAW_OFFER), F.lit(NOW), keep=2)
    assert snapshots(spark, base) == [4, 5]
    assert read_registry_table(spark, base)[0].count() == 10 and read_registry_table(spark, base, below=5)[0].count() == 8
    used = manifest(spark, base, 4).folders() | manifest(spark, base, 5).folders()
    assert {path.rpartition("/")[0].strip("/") for path in files(base)} == used


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = [(datetime(2024, 1, 1) + timedelta(hours=i), f"s{i % 2}", i, 0, 0, 5, ["e"]) for i in range(120)]
    frame = spark.createDataFrame(rows, "timestamp timestamp, source string, codesFound int, codesAdded int, codesUpdated int, duration int, errors array<string>")
    append_run_log(frame.limit(60), path)
    append_run_log(frame.exceptAll(frame.limit(60)), path)
    log = read_run_log(spark, path)
    kept = [r.codesFound for r in last_runs(log).collect()]
    assert len(kept) == 100 and min(kept) == 20
    assert last_runs_per_source(log, 3).count() == 6


def test_stores_of_one_part_and_larger_ones(spark, tmp_path, monkeypatch):
    """Only offers of stores with more than one part are placed by range; the published lines are compressed."""
    sizes = {"a.com": 1, "b.com": 3, "c.com": 4, "d.com": 9}
    rows = [(d, f"C{i:02d}", 0, f"C{i:02d}", (datetime(2024, 1, 1), 0, "p", (i * 7) % n)) for d, n in sizes.items() for i in range(n)]
    shape = "domain string, norm_code string, dup_no int, code string, ord struct<run:timestamp,source_rank:int,page_key:string,pos:long>"
    offers = registry(spark, rows, shape)
    stores = spark.createDataFrame([], STORE)
    placed = []
    monkeypatch.setattr(document, "with_position", lambda df, *rest: placed.append(df) or with_position(df, *rest))
    parts = {(r.domain, r.part): [c.code for c in r.codes] for r in store_parts(offers, stores, 3).collect()}
    want = {d: [r[3] for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[4], r[1]))] for d in sizes}
    assert parts == {(d, k // 3): codes[k : k + 3] for d, codes in want.items() for k in range(0, len(codes), 3)}
    assert {r.domain for r in placed[0].select("domain").collect()} == {"c.com", "d.com"}
    export_registry_json(offers, stores, f"{tmp_path}/lines", F.lit(NOW))
    written = glob.glob(f"{tmp_path}/lines/part-*")
    assert written and all(name.endswith(".gz") for name in written)
    assert read_registry(spark, f"{tmp_path}/lines")[0].count() == len(rows)


def test_last_runs_come_from_the_log_as_it_is_stored(spark, tmp_path):
    """The log lies in parts behind a pointer file, which no plain read of its folder finds."""
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i // 2), i % 3, "view", 1.0, f'{{"k": {i}}}') for i in range(130)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    last = logged_last_runs(spark, str(tmp_path)).collect()
    assert sorted(r.duration for r in last) == list(range(30, 130))
    assert {r.codesFound for r in last} == set(range(30, 130))


@pytest.mark.parametrize("step", ["write_part", "point", "clear"])
def test_a_trim_that_is_cut_off_leaves_a_log(spark, tmp_path, monkeypatch, step):
    """Whichever step fails, the log is the old or the new one, and the next trim ends the work."""
    path = str(tmp_path / "runs")
    assert read_run_log(spark, path).count() == 0
    for k in range(3):
        row = (datetime(2024, 1, 1 + k), "s", k, 0, 0, 5, [])
        append_run_log(spark.createDataFrame([row], "timestamp timestamp, source string, codesFound int, codesAdded int, codesUpdated int, duration int, errors array<string>"), path)

    def fail(*_, **__):
        raise OSError("the driver went")

    with monkeypatch.context() as cut:
        cut.setattr(pointers, step, fail)
        with pytest.raises(OSError):
            trim_run_log(spark, path, 2)
    left = sorted(r.codesFound for r in read_run_log(spark, path).collect())
    assert left == ([1, 2] if step == "clear" else [0, 1, 2])
    trim_run_log(spark, path, 2)
    assert sorted(r.codesFound for r in read_run_log(spark, path).collect()) == [1, 2]
    assert len(glob.glob(f"{path}/pointers/*.json")) == 1
    with pytest.raises(FileExistsError):
        pointers.point(spark, path, {"number": pointers.current(spark, path)["number"] - 1}, [])


def test_whole_run(spark, tmp_path):
    base = str(tmp_path / "registry")

    def raw(*rows):
        fields = [f.name for f in RAW_OFFER]
        return spark.createDataFrame([tuple(dict(zip(["pos", "code", "store_domain", "source"], r)).get(f) for f in fields) for r in rows], RAW_OFFER)

    run_and_store(spark, base, raw((1, "OLD1", "a.com", "x"), (2, "KEEP1", "a.com", "x")), F.lit(NOW - timedelta(days=100)))
    reports = spark.createDataFrame([(7, "new-1", "b.com")], "report_id long, code string, store_domain string")
    errors = spark.createDataFrame([("x", "boom")], "source string, error string")
    result = run_and_store(
        spark, base, raw((1, "keep-1", "A.com", "y"), (2, "NEW1", "b.com", "y"), (3, "NEW2", "c.com", "y"), (4, "NEW2", "c.com", "x")),
        F.lit(NOW), reports=reports, errors=errors,
    )
    counters = {r.counter: r.n for r in result.summary.collect()}
    assert counters == {"found": 4, "added": 2, "updated": 2, "pruned": 1, "removed": 1, "total": 2, "errors": 1}
    offers, stores = read_registry_table(spark, base)
    assert sorted((r.domain, r.code, tuple(r.sources)) for r in offers.collect()) == [("a.com", "KEEP1", ("x", "y")), ("c.com", "NEW2", ("y", "x"))]
    assert sorted(r.domain for r in stores.collect()) == ["a.com", "c.com"]
    assert snapshots(spark, base) == [1, 2]
    assert {(r.source, r.found) for r in source_summary(raw((1, "a", "b", "y"))).collect()} == {("y", 1)}


def test_dimensions(spark):
    sizes = {name: frame.count() for name, frame in load_dimensions(spark).items()}
    assert sizes["store_map"] == 470 and sizes["fallback_slugs"] == 275 and sizes["priority_domains"] == 37


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def line_items(spark, path):
    """Line items of 41 stores, early and late ones of the same keys among them."""
    shape = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
             "l_discount double, l_returnflag string, l_shipdate timestamp_ntz")
    rows = [
        (i // 7, i % 31, i % 41, i % 7 + 1, float(i % 50), i * 1.25, (i % 11) / 100, "ANR"[i % 3], datetime(1996 + i % 5, 1, 1 + i % 28))
        for i in range(4000)
    ]
    spark.createDataFrame(rows, shape).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_a_registry_is_published_slice_by_slice(spark, tmp_path, monkeypatch):
    """Each slice is published on its own, and what it needed in between is gone; the rows are those of one slice."""
    sf_dir, sizes = line_items(spark, tmp_path), []
    whole = sorted(map(str, samples.registry_json(spark, sf_dir).collect()))
    monkeypatch.setattr(common, "SLICE_BYTES", 1)
    monkeypatch.setattr(common, "SLICES", 2)

    def published(offers, *rest, **options):
        sizes.append(offers.count())
        export_registry_json(offers, *rest, **options)
        assert not [name for name in os.listdir(shared_dir(spark)) if name.startswith("publishing-")]

    monkeypatch.setattr(samples, "export_registry_json", published)
    assert sorted(map(str, samples.registry_json(spark, sf_dir).collect())) == whole
    assert len(sizes) == 2 and min(sizes) > 0 and sum(sizes) == len(whole) > 1000


def test_versions_are_written_slice_by_slice(spark, tmp_path, monkeypatch):
    """Each version is written in slices of the stores, and what was needed in between is gone; the rows are those of one slice."""
    sf_dir, parts = line_items(spark, tmp_path), []
    whole = sorted(map(str, samples.registry_snapshot(spark, sf_dir).collect()))
    monkeypatch.setattr(common, "SLICE_BYTES", 1)
    monkeypatch.setattr(common, "SLICES", 2)
    monkeypatch.setattr(collect, "upsert_firsts", lambda *rows: parts.append(rows[1].count()) or upsert_firsts(*rows))
    assert sorted(map(str, samples.registry_snapshot(spark, sf_dir).collect())) == whole
    assert len(parts) == 2 and min(parts) > 0 and len(whole) > 2000
    assert not [name for name in os.listdir(shared_dir(spark)) if name.startswith(("firsts-", "stores-"))]
