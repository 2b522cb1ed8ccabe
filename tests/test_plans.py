"""Plans keep the shape they need on large data."""

import pytest
from pyspark.sql import functions as F

from offerloom.operators.contains import grams
from offerloom.operators.dedupe import first_rows
from offerloom.operators.lifecycle import match_reports, remove_reported
from offerloom.operators.merge import first_per_key, keyed_offers
from offerloom.operators.serve import best_offer, match_store
from offerloom.queries import all_queries, all_sql
from offerloom.queries.common import table
from offerloom.queries import registry as samples
from offerloom.sources.registry import empty_registry

SMALL = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_top_row_is_cut_before_the_shuffle(spark):
    events = table(spark, SMALL, "events")
    plan = plan_of(first_rows(events, ["user_id"], [F.col("ts")]))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "WindowGroupLimit" in plan_of(best_offer(samples.tested_offers(spark, SMALL)))


def test_sources_of_a_key_are_gathered_after_the_shuffle_alone(spark):
    plan = plan_of(first_per_key(keyed_offers(samples.item_offers(spark, SMALL), F.lit(samples.LATE))))
    assert "ObjectHashAggregate" not in plan and plan.count("Exchange hashpartitioning(") == 2


def test_reports_do_not_compare_all_pairs(spark):
    offers = samples.tested_offers(spark, SMALL)
    reports = spark.createDataFrame([(1, "a", "b.c")], "report_id long, code string, store_domain string")
    for plan in (plan_of(remove_reported(offers, reports)), plan_of(match_reports(offers, reports))):
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pieces_of_a_key_grow_with_its_length(spark):
    sizes = [spark.range(1).select(F.size(grams(F.lit(("k%d" * 40 % tuple(range(40)))[:n])))).first()[0] for n in (30, 60)]
    assert sizes[1] <= 2.2 * sizes[0] and sizes[1] <= 6 * 60 + 1


def test_host_matching_has_no_nested_loop(spark):
    place = F.struct(F.timestamp_seconds(F.lit(0)).alias("run"), F.lit(0).alias("source_rank"), F.lit("").alias("page_key"), F.lit(0).cast("long").alias("pos"))
    stores = spark.createDataFrame([("a.com", "A", "g")], "domain string, name string, category string").withColumn("ord", place)
    plan = plan_of(match_store(spark.createDataFrame([("x.com",)], "host string"), stores, stores))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scan_reads_only_what_it_needs(spark):
    plan = plan_of(samples.item_offers(spark, SMALL, "early").select("code", "store_domain"))
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate," in plan
    assert "l_extendedprice" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["q_merge_registry", "q_remove_reported_many", "q_store_rollup", "q_dedupe_first", "q_registry_json"])
def test_no_pairwise_joins(spark, name):
    plan = plan_of(all_queries()[name](spark, SMALL))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


def test_empty_registry_has_the_declared_columns(spark):
    offers, stores = empty_registry(spark)
    assert offers.columns[:2] == ["domain", "norm_code"] and stores.columns == ["domain", "name", "category", "ord"]
