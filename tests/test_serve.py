"""Host matching against brute force, ranking of large groups, serving rows."""

import random
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from offerloom.fixed import PRIORITY_DOMAINS
from offerloom.operators.ranking import with_position
from offerloom.operators.serve import (
    apply_tests,
    best_offer,
    last_verified,
    match_store,
    offer_cards,
    offers_for_hosts,
    rank_offers,
    savings_totals,
    source_contribution,
    store_rollup,
    trial_order,
    visible_offers,
)
from offerloom.plans.collect import run_and_store
from offerloom.plans.lookup import lookup_hosts, lookup_stored
from offerloom.schemas import RAW_OFFER
from offerloom.sources.store_keys import StoreKeys, follow_stores, rebuild_store_keys
from offerloom.sources.versions import empty_registry

STORES = "domain string, name string, category string, n long"


def stores_frame(spark, domains):
    rows = [(d, d.upper(), "general", n) for n, d in enumerate(domains)]
    place = F.struct(
        F.timestamp_seconds(F.lit(0)).alias("run"), F.lit(0).alias("source_rank"), F.lit("").alias("page_key"), F.col("n").alias("pos")
    )
    return spark.createDataFrame(rows, STORES).withColumn("ord", place).drop("n")


def ladder(host, domains, stocked):
    """The answer for one host, tried rule by rule over all stores."""
    def strip(d):
        return d[:-6].replace(".", "") if d.endswith(".co.uk") else d.replace(".", "")

    bare_host = host[4:] if host.startswith("www.") else host
    for tier, names in ((1, [host]), (2, [bare_host, "www." + host]), (3, [host + ".co.uk"])):
        for name in names:
            if name in domains:
                return tier, name, None
    compact = host.replace(".", "")
    for domain in domains:
        base = strip(domain)
        if base in host or compact in base or base in compact:
            return 4, domain, None
    for wanted in PRIORITY_DOMAINS:
        if wanted in host or host in wanted:
            owner = next((d for d in domains if d == wanted or (d[4:] if d.startswith("www.") else d) in wanted), None)
            if owner in stocked:
                return 5, owner, None
            label = wanted.split(".")[0]
            if any(label in d for d in stocked):
                return 6, None, label
    return None


@pytest.mark.parametrize("seed", range(3))
def test_match_store_equals_the_ladder(spark, tmp_path, seed):
    rng = random.Random(seed)
    parts = ["driffle", "gog", "shop", "alpha", "be", "gamer", "x", "kinguin"]
    tails = [".com", ".co.uk", ".net", ""]

    def name():
        return rng.choice(["", "", "www.", "my."]) + rng.choice(parts) + rng.choice(["", "", "-" + rng.choice(parts)]) + rng.choice(tails)

    domains = list(dict.fromkeys([name() for _ in range(3)] + ["www.driff", "xgogx.shop", "kinguinfans.org"][: rng.randint(1, 3)]))
    stocked = [d for d in domains if rng.random() < 0.8]
    hosts = sorted({name() for _ in range(25)} | set(PRIORITY_DOMAINS[:8]) | {"nothing.example", "qqq.gog.com", "driffle.com"})
    offers = spark.createDataFrame([(d, "C" + d) for d in stocked], "domain string, code string")
    got = match_store(
        spark.createDataFrame([(h,) for h in hosts], "host string"), stores_frame(spark, domains), offers
    ).collect()
    want = {h: answer for h in hosts if (answer := ladder(h, domains, stocked)) is not None}
    assert {r.host: (r.tier, r.domain, r.pool) for r in got} == want
    # Through an index that was added to, and that still holds a store that has gone.
    base = str(tmp_path)
    rebuild_store_keys(spark, base, stores_frame(spark, [*domains[:2], "gog-gone.com"]))
    follow_stores(spark, base, stores_frame(spark, domains[:2]), stores_frame(spark, domains[2:]))
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = match_store(frame, stores_frame(spark, domains), offers, keys=StoreKeys(spark, base)).collect()
    assert {r.host: (r.tier, r.domain, r.pool) for r in got} == want


def test_a_lookup_reads_the_buckets_of_its_pieces(spark, tmp_path):
    base = str(tmp_path)
    rebuild_store_keys(spark, base, stores_frame(spark, [f"store{k:04d}.com" for k in range(200)]))
    keys = StoreKeys(spark, base)
    wanted = spark.createDataFrame([("store0",), ("e0042c",)], "gram string")
    rows = keys.rows(wanted)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert rows.select("bucket").distinct().count() <= 2
    assert [r.domain for r in rows.filter("gram = 'e0042c'").collect()] == ["store0042.com"]


def test_the_index_follows_the_registry(spark, tmp_path):
    base = str(tmp_path)
    names = [f.name for f in RAW_OFFER]

    def run(domain):
        row = {"pos": 1, "code": "AA11", "store_domain": domain, "source": "x"}
        return run_and_store(spark, base, spark.createDataFrame([tuple(row.get(n) for n in names)], RAW_OFFER), F.lit("2024-01-05 00:00:00"))

    rebuild_store_keys(spark, base, run("alpha-shop.com").stores)
    run("beta-shop.com")
    hidden = spark.createDataFrame([], "domain string, code string")
    hosts = spark.createDataFrame([("www2.beta-shop.com.au",), ("my.alpha-shop.com.au",), ("none",)], "host string")
    matched, cards, _ = lookup_stored(spark, base, hosts, hidden, F.lit("2024-01-05 00:00:00"))
    assert {(r.host, r.tier, r.shop) for r in matched.collect()} == {
        ("www2.beta-shop.com.au", 4, "beta-shop.com"), ("my.alpha-shop.com.au", 4, "alpha-shop.com")
    }
    assert cards.count() == 2


def test_pool_shows_every_store_of_the_label(spark):
    domains = ["xgogx.shop", "gogfans.shop", "other.shop"]
    stores = stores_frame(spark, domains)
    offers = spark.createDataFrame([(d, "C" + d) for d in domains], "domain string, code string")
    matched = match_store(spark.createDataFrame([("gog.com",), ("other.shop",)], "host string"), stores, offers)
    rows = {r.host: r for r in matched.collect()}
    assert (rows["gog.com"].tier, rows["gog.com"].name) == (6, "Gaming Store")
    shown = sorted((r.host, r.domain) for r in offers_for_hosts(matched, offers).collect())
    assert shown == [("gog.com", "gogfans.shop"), ("gog.com", "xgogx.shop"), ("other.shop", "other.shop")]


def test_positions_of_a_hot_group(spark):
    """Ranges give the very positions a window gives, with one group holding a third of the rows."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.xxhash64("id") % 7).alias("v"), "id",
    )
    rows = rows.withColumn("g", F.when(F.col("g") != "g7", F.col("g")))  # a null key is a group like any other
    order = [F.col("v").desc(), F.col("id")]
    group = Window.partitionBy("g")
    plain = rows.withColumns({"position": F.row_number().over(group.orderBy(*order)).cast("long"), "size": F.count(F.lit(1)).over(group)})
    ranges = with_position(rows, ["g"], order)
    assert ranges.filter("g is null").count() > 0
    assert plain.count() == ranges.count() == 6000
    assert plain.exceptAll(ranges).count() == 0
    assert ranges.agg(F.max("size")).first()[0] == 2000


def offers_frame(spark):
    offers, _ = empty_registry(spark)
    day = [datetime(2024, 1, d) for d in range(1, 10)]
    rows = [
        ("s", "A", 10, 7, day[0], "percentage", ["x"], "x", 0), ("s", "B", 0, 0, day[5], "unknown", ["x", "y"], "x", 1),
        ("s", "C", 10, 7, day[3], "fixed", None, "y", 2), ("s", "D", 0, 0, None, None, None, None, 3), ("t", "E", 3, 1, None, "bogo", [], "y", 4),
    ]
    frame = spark.createDataFrame(
        rows, "domain string, code string, total long, worked long, last_seen timestamp, type string, sources array<string>, source string, n long"
    )
    place = F.struct(F.timestamp_seconds(F.lit(0)).alias("run"), F.lit(0).alias("source_rank"), F.lit("").alias("page_key"), F.col("n").alias("pos"))
    frame = frame.withColumns({"ord": place, "norm_code": F.col("code"), "dup_no": F.lit(0)}).drop("n")
    return offers.unionByName(frame, allowMissingColumns=True)


def test_rank(spark):
    ranked = rank_offers(offers_frame(spark)).orderBy("domain", "position").collect()
    assert [(r.domain, r.position, r.code, r.size) for r in ranked] == [
        ("s", 1, "C", 4), ("s", 2, "A", 4), ("s", 3, "B", 4), ("s", 4, "D", 4), ("t", 1, "E", 1),
    ]
    progress = trial_order(offers_frame(spark)).orderBy("domain", "position").collect()
    assert [r.progress for r in progress] == [25.0, 50.0, 75.0, 100.0, 100.0]


def test_serving_rows(spark):
    offers = offers_frame(spark)
    hidden = spark.createDataFrame([("s", "C"), ("s", "C"), ("other", "A")], "domain string, code string")
    assert sorted(r.code for r in visible_offers(offers, hidden).collect()) == ["A", "B", "D", "E"]
    assert {r.domain: r.code for r in best_offer(visible_offers(offers, hidden)).collect()} == {"s": "A", "t": "E"}
    rolled = {r.domain: (r.visible, r.hidden, r.total, r.worked, r.rate, r.rate_class) for r in store_rollup(offers, hidden).collect()}
    assert rolled == {"s": (3, 1, 10, 7, 70, "green"), "t": (1, 0, 3, 1, 33, "red")}
    seen = {r.domain: r.last_verified for r in last_verified(offers, F.lit("2024-01-05 00:00:00")).collect()}
    assert seen == {"s": "1 day ago", "t": "unknown"}
    card = {r.code: r for r in offer_cards(offers).collect()}
    assert (card["B"].type, card["B"].sources, card["B"].rate) == (None, "x y", None)
    assert (card["C"].sources, card["D"].sources, card["C"].rate_class) == ("y", "unknown", "green")
    given = {r.source: (r.carried, r.found_first) for r in source_contribution(offers).collect()}
    assert given == {"x": (2, 2), "y": (3, 2), "unknown": (1, 1)}


def test_tests_are_added(spark):
    tests = spark.createDataFrame([("s", "A", 2, 1, datetime(2024, 2, 1))], "domain string, code string, total long, worked long, last_tested timestamp")
    after = {r.code: (r.total, r.worked, r.last_tested) for r in apply_tests(offers_frame(spark), tests).collect()}
    assert after["A"] == (12, 8, datetime(2024, 2, 1)) and after["B"] == (0, 0, None)


def test_savings(spark):
    rows = [("10.004",), ("2.5 GBP",), ("-3",), ("abc",), ("0",), (None,)]
    total = savings_totals(spark.createDataFrame(rows, "amount string")).first()
    assert (str(total.saved), total.orders, total.label) == ("12.50", 2, "£12.50")
    assert savings_totals(spark.createDataFrame([], "amount string")).first().label == "£0.00"


def test_lookup(spark):
    stores = stores_frame(spark, ["s", "t"])
    hosts = spark.createDataFrame([("s",), ("zzz",)], "host string")
    hidden = spark.createDataFrame([("s", "A")], "domain string, code string")
    matched, cards, header = lookup_hosts(hosts, stores, offers_frame(spark), hidden, F.lit("2024-01-05 00:00:00"))
    assert [r.host for r in matched.collect()] == ["s"]
    assert [(r.position, r.code) for r in cards.orderBy("position").collect()] == [(1, "C"), (2, "B"), (3, "D")]
    row = header.first()
    assert (row.pooled, row.shop, row.visible, row.hidden, row.last_verified) == (False, "s", 3, 1, "1 day ago")


def test_lookup_of_a_pool(spark):
    """A host that leads to a pool of stores gets their offers, twin codes once each."""
    twin = offers_frame(spark).filter("code = 'A'").withColumn("domain", F.lit("cheap-driffle.net"))
    offers = twin.unionByName(twin.withColumn("dup_no", F.lit(1))).unionByName(
        offers_frame(spark).withColumn("domain", F.lit("driffle-two.net"))
    )
    stores = stores_frame(spark, ["cheap-driffle.net", "driffle-two.net"])
    hosts = spark.createDataFrame([("shop.driffle.com",), ("x.driffle.com",)], "host string")
    hidden = spark.createDataFrame([("driffle-two.net", "E")], "domain string, code string")
    matched, cards, header = lookup_hosts(hosts, stores, offers, hidden, F.lit("2024-01-05 00:00:00"))
    assert {(r.host, r.tier, r.pooled, r.shop, r.name) for r in matched.collect()} == {
        (h, 6, True, "driffle", "Gaming Store") for h in ("shop.driffle.com", "x.driffle.com")
    }
    shown = cards.collect()
    assert sorted(r.position for r in shown) == list(range(1, 7)) and {r["size"] for r in shown} == {6}
    assert sorted(r.code for r in shown) == ["A", "A", "A", "B", "C", "D"]
    row = header.first()
    assert header.count() == 1 and (row.shop, row.visible, row.hidden) == ("driffle", 6, 1)
