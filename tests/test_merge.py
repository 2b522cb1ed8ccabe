"""The set form of the upsert against a plain sequential fold."""

import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from offerloom.operators.merge import merge_stats, store_upsert, upsert
from offerloom.schemas import OFFER, RAW_OFFER
from offerloom.sources.registry import empty_registry

T0, NOW = datetime(2024, 1, 1), datetime(2024, 3, 1)


def fold(registry, incoming):
    """What a reader of the rows one by one ends up with: (domain, norm code) -> state."""
    state = {key: dict(value) for key, value in registry.items()}
    added = updated = 0
    for row in sorted(incoming, key=lambda r: (r["source_rank"], r["page_key"], r["pos"])):
        key = (row["store_domain"].lower(), row["code"].upper().replace("-", "").replace(" ", ""))
        if key in state:
            known = state[key]
            rate = row["success_rate"]
            if rate is not None and rate > known["worked"] / max(known["total"], 1):
                known["worked"] = math.floor(rate * known["total"] + 0.5)
            known["seen"] = NOW
            if row["source"] and row["source"] not in known["sources"]:
                known["sources"] = known["sources"] + [row["source"]]
            updated += 1
        else:
            source = row["source"] or "unknown"
            state[key] = {"total": 0, "worked": 0, "seen": NOW, "sources": [source], "url": row["url"]}
            added += 1
    return state, added, updated


@pytest.mark.parametrize("seed", range(4))
def test_upsert_equals_fold(spark, seed):
    rng = random.Random(seed)
    forms = ["ab-1", "AB1", "a b 1", "CD2", "c-d2", "ef3", "GH4"]
    domains = ["Shop.com", "shop.com", "other.co.uk", "unknown.co.uk"]
    registry = {}
    for code in ("AB1", "CD2", "ZZ9"):
        for domain in ("shop.com", "unknown.co.uk"):
            total = rng.choice([0, 3, 7, 10])
            registry[domain, code] = {
                "total": total, "worked": rng.randint(0, total), "seen": T0, "sources": rng.choice([[], ["a"], ["a", "b"]]), "url": "old",
            }
    incoming = [
        {
            "source_rank": rng.randint(0, 2), "page_key": rng.choice("pq"), "pos": i, "code": rng.choice(forms),
            "store_domain": rng.choice(domains), "source": rng.choice(["a", "b", "c", "", None]), "url": f"u{i}",
            "success_rate": rng.choice([None, 0.0, 0.55, 0.58, 1.0, rng.random()]),
        }
        for i in range(60)
    ]
    want, added, updated = fold(registry, incoming)

    offers, _ = empty_registry(spark)
    known = spark.createDataFrame(
        [(d, c, 0, c, "a", v["sources"], "old", T0, T0, v["total"], v["worked"]) for (d, c), v in registry.items()],
        "domain string, norm_code string, dup_no int, code string, source string, sources array<string>, url string, "
        "added_at timestamp, last_seen timestamp, total long, worked long",
    )
    known = offers.unionByName(known, allowMissingColumns=True)
    raw = spark.createDataFrame([tuple(r.get(f.name) for f in RAW_OFFER) for r in incoming], RAW_OFFER)
    merged = upsert(known, raw, F.lit(NOW))
    got = {
        (r.domain, r.norm_code): {"total": r.total, "worked": r.worked, "seen": r.last_seen, "sources": r.sources, "url": r.url}
        for r in merged.collect()
    }
    assert got == want
    stats = merge_stats(merged).first()
    assert (stats.added, stats.updated, stats.skipped) == (added, updated, 0)


def raw_row(**given):
    base = {"source_rank": 0, "page_key": "", "pos": 0, "code": "X1", "store_domain": "S.com", "type": "unknown", "source": "a"}
    return tuple((base | given).get(f.name) for f in RAW_OFFER)


def test_new_offer_fields(spark):
    offers, _ = empty_registry(spark)
    rows = [
        raw_row(code="n-1", description="<b>20% off shoes</b> on £30 today", expiry="2024-05-01"),
        raw_row(code="n2", description="Save £5 now please", type="bogo", value=0.0, min_spend=9.0, expiry="soon", source=None),
        raw_row(code="n3", description="Save £5 now please", type=None, value=7.0),
        raw_row(code="n4", description="10% off", url="u"),
    ]
    merged = upsert(offers, spark.createDataFrame(rows, RAW_OFFER), F.lit(NOW)).orderBy("code").collect()
    facts = [(r.code, r.description, r.type, r.value, r.min_spend, r.expiry, r.source, r.sources, r.url) for r in merged]
    assert facts == [
        ("N1", "20% off shoes on £30", "percentage", 20.0, 30.0, date(2024, 5, 1), "a", ["a"], ""),
        ("N2", "Save £5 now", "bogo", None, 9.0, None, "unknown", ["unknown"], ""),
        ("N3", "Save £5 now", None, 7.0, None, None, "a", ["a"], ""),
        ("N4", "10%", "unknown", None, None, None, "a", ["a"], "u"),
    ]
    assert all(r.is_new and r.added_at == NOW and r.last_seen == NOW and r.total == 0 for r in merged)


def test_second_spelling_in_the_registry_is_left_alone(spark):
    offers, _ = empty_registry(spark)
    rows = spark.createDataFrame(
        [("s.com", "X1", 0, "x-1", T0), ("s.com", "X1", 1, "X1", T0)],
        "domain string, norm_code string, dup_no int, code string, last_seen timestamp",
    )
    known = offers.unionByName(rows, allowMissingColumns=True)
    merged = upsert(known, spark.createDataFrame([raw_row()], RAW_OFFER), F.lit(NOW))
    assert [(r.code, r.last_seen) for r in merged.orderBy("dup_no").collect()] == [("x-1", NOW), ("X1", T0)]


def test_stores_keep_their_first_name(spark):
    _, stores = empty_registry(spark)
    first = [raw_row(pos=2, store_name="Late"), raw_row(pos=1, store_name="", category="toys"), raw_row(store_domain="b.com", store_name="B")]
    once = store_upsert(stores, spark.createDataFrame(first, RAW_OFFER), F.lit(T0))
    again = store_upsert(once, spark.createDataFrame([raw_row(store_name="New")], RAW_OFFER), F.lit(NOW))
    got = [(r.domain, r.name, r.category) for r in again.orderBy("ord").collect()]
    assert got == [("b.com", "B", "general"), ("s.com", "s.com", "toys")]


def test_result_schema(spark):
    offers, _ = empty_registry(spark)
    merged = upsert(offers, spark.createDataFrame([raw_row()], RAW_OFFER), F.lit(NOW)).drop("is_new", "rows")
    assert [(f.name, f.dataType) for f in merged.schema] == [(f.name, f.dataType) for f in OFFER]
