"""Registry: first-in-order rows, upsert, expiry, reports, publication, run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.operators.dedupe import first_rows, union_sources
from offerloom.operators.extract import as_raw_offers
from offerloom.operators.lifecycle import (
    count_stale,
    drop_empty_stores,
    mark_reported,
    prune_stale,
    registry_meta,
    remove_reported,
    reports_with_effect,
    run_summary,
    source_summary,
)
from offerloom.operators.merge import in_slice, merge_offers, merge_stats, store_upsert, upsert
from offerloom.operators.serve import source_contribution
from offerloom.plans.collect import collect_pages, collect_sources, run_collection, upsert_into
from offerloom.queries.common import (
    OFFER_TEXT_SQL,
    offer_text,
    pence,
    slices_of,
    sql_clean,
    sql_min_spend,
    sql_norm,
    sql_pence,
    sql_plain,
    sql_stamp,
    sql_type,
    sql_value,
    stamp,
    table,
)
from offerloom.queries.pages import BUTTON_OFFERS, faulty_captures
from offerloom.session import durable, work_path
from offerloom.sources.registry import export_registry_json, read_registry
from offerloom.sources.reports import (
    append_run_log,
    last_runs,
    last_runs_per_source,
    parse_reports,
    read_run_log,
    trim_run_log,
)
from offerloom.sources.versions import empty_registry, newest, read_registry_table, write_registry_table

EARLY, LATE = "1998-06-01 00:00:00", "2001-12-01 00:00:00"


def events_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number inside their properties."""
    events = table(spark, sf_dir, "events")
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))


EVENTS_K = "(SELECT *, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events)"


#: All stores as the one slice of ``merge.in_slice``.
WHOLE = (0, 1)


def item_offers(spark: SparkSession, sf_dir: str, when: str | None = None, part: tuple[int, int] = WHOLE) -> DataFrame:
    """Line items, of all suppliers or one slice of them, as raw offers: store = supplier, code = part, source = return flag."""
    lines = in_slice(table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), part)
    if when == "early":
        lines = lines.filter(F.col("l_shipdate") < F.lit(EARLY).cast("timestamp_ntz"))
    elif when == "late":
        lines = lines.filter(F.col("l_shipdate") >= F.lit(EARLY).cast("timestamp_ntz"))
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = lines.select(
        rank.alias("source_rank"),
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("page_key"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.floor(F.col("l_extendedprice") * 100 + 0.5)).alias("pos"),
        F.concat(F.lit("p-"), F.col("l_partkey").cast("string")).alias("code"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("store_name"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit(".Example.com")).alias("store_domain"),
        offer_text().alias("description"),
        F.lit("unknown").alias("type"),
        F.col("l_returnflag").alias("source"),
        F.lit("").alias("url"),
    )
    return as_raw_offers(rows)


def early_registry(spark: SparkSession, sf_dir: str, part: tuple[int, int] = WHOLE) -> DataFrame:
    """Registry built from the items shipped before the cut."""
    offers, _ = empty_registry(spark)
    return merge_offers(offers, item_offers(spark, sf_dir, "early", part), F.lit(EARLY))


def late_merge(spark: SparkSession, sf_dir: str, part: tuple[int, int] = WHOLE) -> DataFrame:
    return upsert(early_registry(spark, sf_dir, part), item_offers(spark, sf_dir, "late", part), F.lit(LATE))


def merge_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_merge(spark, sf_dir).select(
        "domain",
        "code",
        "description",
        "type",
        pence(F.col("value")).alias("value"),
        pence(F.col("min_spend")).alias("min_spend"),
        "source",
        F.array_join("sources", "|").alias("sources"),
        stamp(F.col("added_at")).alias("added_at"),
        stamp(F.col("last_seen")).alias("last_seen"),
        F.col("ord.pos").alias("pos"),
        "is_new",
        "rows",
    )


_ORDER = "source_rank, page_key, pos, description"
ITEMS_SQL = f"""
items AS (
  SELECT 's' || l_suppkey || '.example.com' AS domain, 'P' || l_partkey AS code, l_shipdate < TIMESTAMP '{EARLY}' AS early,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS source_rank, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS page_key,
         CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS pos, {OFFER_TEXT_SQL} AS description, l_returnflag AS source,
         'Supplier ' || l_suppkey AS store_name
  FROM lineitem),
ranked AS (SELECT *, row_number() OVER (PARTITION BY early, domain, code ORDER BY {_ORDER}) AS rn,
                  count(*) OVER (PARTITION BY early, domain, code) AS n FROM items),
srcs AS (SELECT early, domain, code, list(source ORDER BY source_rank) AS sources
         FROM (SELECT DISTINCT early, domain, code, source_rank, source FROM items) GROUP BY ALL),
firsts AS (SELECT r.*, s.sources FROM ranked r JOIN srcs s USING (early, domain, code) WHERE rn = 1),
cleaned AS (SELECT *, {sql_plain('description')} AS plain FROM firsts),
texts AS (SELECT *, {sql_clean('plain')} AS text FROM cleaned),
kinds AS (SELECT *, {sql_type('text')} AS type FROM texts),
facts AS (SELECT *, {sql_value('text', 'type')} AS value, {sql_min_spend('text')} AS min_spend FROM kinds),
merged AS (
  SELECT coalesce(r.domain, i.domain) AS domain, coalesce(r.code, i.code) AS code,
         CASE WHEN r.code IS NULL THEN i.text ELSE r.text END AS description,
         CASE WHEN r.code IS NULL THEN i.type ELSE r.type END AS type,
         CASE WHEN r.code IS NULL THEN i.value ELSE r.value END AS value,
         CASE WHEN r.code IS NULL THEN i.min_spend ELSE r.min_spend END AS min_spend,
         coalesce(r.source, i.source) AS source,
         CASE WHEN r.code IS NULL THEN i.sources WHEN i.code IS NULL THEN r.sources
              ELSE list_concat(r.sources, list_filter(i.sources, lambda x: NOT list_contains(r.sources, x))) END AS sources,
         CASE WHEN r.code IS NULL THEN TIMESTAMP '{LATE}' ELSE TIMESTAMP '{EARLY}' END AS added_at,
         CASE WHEN i.code IS NULL THEN TIMESTAMP '{EARLY}' ELSE TIMESTAMP '{LATE}' END AS last_seen,
         coalesce(r.pos, i.pos) AS pos, r.code IS NULL AS is_new, coalesce(i.n, 0) AS rows
  FROM (SELECT * FROM facts WHERE early) r FULL JOIN (SELECT * FROM facts WHERE NOT early) i ON r.domain = i.domain AND r.code = i.code)
"""

MERGE_REGISTRY = f"""
WITH {ITEMS_SQL}
SELECT domain, code, description, type, {sql_pence('value')} AS value, {sql_pence('min_spend')} AS min_spend, source,
       array_to_string(sources, '|') AS sources, {sql_stamp('added_at')} AS added_at, {sql_stamp('last_seen')} AS last_seen, pos, is_new, rows
FROM merged
"""


def merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_stats(late_merge(spark, sf_dir))


MERGE_STATS = f"""
WITH {ITEMS_SQL}
SELECT count(*) FILTER (WHERE is_new) AS added, CAST(sum(rows) AS BIGINT) - count(*) FILTER (WHERE is_new) AS updated, CAST(0 AS BIGINT) AS skipped FROM merged
"""


def union_and_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The return flags as three sources, their union merged, and what each contributed."""
    items = item_offers(spark, sf_dir)
    parts = [items.filter(F.col("source") == flag) for flag in ("A", "N", "R")]
    incoming = union_sources(parts)
    offers, _ = empty_registry(spark)
    merged = merge_offers(offers, incoming, F.lit(LATE))
    return source_contribution(merged).join(source_summary(incoming), "source")


UNION_SOURCES = f"""
WITH i AS (SELECT l_suppkey AS d, l_partkey AS c, l_returnflag AS source FROM lineitem),
     f AS (SELECT d, c, min(source) AS first, list(DISTINCT source) AS srcs FROM i GROUP BY 1, 2),
     e AS (SELECT unnest(srcs) AS source, first FROM f),
     n AS (SELECT source, count(*) AS found FROM i GROUP BY 1)
SELECT source, count(*) AS carried, count(*) FILTER (WHERE source = first) AS found_first, found FROM e JOIN n USING (source) GROUP BY source, found
"""


def stores_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores after both runs; later offers never rename a store."""
    _, stores = empty_registry(spark)
    early = store_upsert(stores, item_offers(spark, sf_dir, "early"), F.lit(EARLY))
    both = store_upsert(early, item_offers(spark, sf_dir, "late"), F.lit(LATE))
    return both.select("domain", "name", "category", F.col("ord.page_key").alias("page"), F.col("ord.pos").alias("pos"))


STORE_UPSERT = f"""
WITH {ITEMS_SQL},
s AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY early DESC, {_ORDER}) AS k FROM items)
SELECT domain, store_name AS name, 'general' AS category, page_key AS page, pos FROM s WHERE k = 1
"""


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_k(spark, sf_dir).select("user_id", "k", "ts", "event_id", "event_type")
    firsts = first_rows(events, ["user_id", "k"], [F.col("ts"), F.col("event_id")])
    return firsts.select("user_id", "k", "event_id", "event_type")


DEDUPE_FIRST = f"""
SELECT user_id, k, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS n FROM {EVENTS_K}) WHERE n = 1
"""


def tested_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry whose offers and attempts come from all events: purchases worked, errors failed, others only show them."""
    events = events_k(spark, sf_dir)
    worked = F.count_if(F.col("event_type") == "purchase")
    failed = F.count_if(F.col("event_type") == "error")
    grouped = events.groupBy(
        F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string"), F.lit(".example.com")).alias("domain"),
        F.col("k").cast("string").alias("norm_code"),
    ).agg((worked + failed).alias("total"), worked.alias("worked"), F.max("ts").cast("timestamp").alias("last_seen"))
    offers, _ = empty_registry(spark)
    rows = grouped.withColumns(
        {
            "code": F.col("norm_code"),
            "dup_no": F.lit(0),
            "type": F.when(F.col("total") % 2 == 0, F.lit("percentage")).otherwise(F.lit("unknown")),
            "sources": F.array(F.lit("events")),
            "source": F.lit("events"),
            "ord": F.struct(
                F.lit(EARLY).cast("timestamp").alias("run"), F.lit(0).alias("source_rank"), F.lit("").alias("page_key"),
                F.col("norm_code").cast("long").alias("pos"),
            ),
        }
    )
    return offers.unionByName(rows, allowMissingColumns=True)


TESTED_SQL = f"""
SELECT 's' || (user_id % 10) || '.example.com' AS domain, CAST(k AS VARCHAR) AS code,
       count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS worked, max(ts) AS last_seen
FROM {EVENTS_K} GROUP BY 1, 2
"""


def success_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks arrive with a success rate; a better one than stored raises the successes."""
    clicks = events_k(spark, sf_dir).filter(F.col("event_type") == "click")
    incoming = as_raw_offers(
        clicks.select(
            F.lit(0).alias("source_rank"),
            F.lit("").alias("page_key"),
            F.col("event_id").alias("pos"),
            F.col("k").cast("string").alias("code"),
            F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string"), F.lit(".example.com")).alias("store_domain"),
            F.lit("bogo").alias("type"),
            F.lit("clicks").alias("source"),
            F.least(F.lit(1.0), F.col("value") / 500).alias("success_rate"),
        )
    )
    merged = merge_offers(tested_offers(spark, sf_dir), incoming, F.lit("2024-02-01 00:00:00"))
    return merged.select(
        "domain", "code", "total", "worked", "type", F.array_join("sources", "|").alias("sources"),
        stamp(F.col("last_seen")).alias("last_seen"),
    )


SUCCESS_BUMP = f"""
WITH r AS ({TESTED_SQL}),
     i AS (SELECT 's' || (user_id % 10) || '.example.com' AS domain, CAST(k AS VARCHAR) AS code, max(least(1.0, value / 500)) AS best
           FROM {EVENTS_K} WHERE event_type = 'click' GROUP BY 1, 2)
SELECT coalesce(r.domain, i.domain) AS domain, coalesce(r.code, i.code) AS code, coalesce(r.total, 0) AS total,
       CASE WHEN r.code IS NULL THEN 0 WHEN best > worked / greatest(total, 1) THEN CAST(floor(best * total + 0.5) AS BIGINT) ELSE worked END AS worked,
       CASE WHEN r.code IS NULL THEN 'bogo' WHEN total % 2 = 0 THEN 'percentage' ELSE 'unknown' END AS type,
       CASE WHEN r.code IS NULL THEN 'clicks' WHEN i.code IS NULL THEN 'events' ELSE 'events|clicks' END AS sources,
       {sql_stamp("CASE WHEN i.code IS NULL THEN r.last_seen ELSE TIMESTAMP '2024-02-01 00:00:00' END")} AS last_seen
FROM r FULL JOIN i ON r.domain = i.domain AND r.code = i.code
"""

ASOF = "2001-08-02 00:00:00"


def customers_as_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest order of a customer as the last sight of an offer; one in eleven has none."""
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("timestamp").alias("at"))
    return latest.select(
        F.concat(F.lit("d"), (F.col("o_custkey") % 50).cast("string")).alias("domain"),
        F.col("o_custkey").cast("string").alias("norm_code"),
        F.when(F.col("o_custkey") % 11 != 0, F.col("at")).alias("last_seen"),
        F.when(F.col("o_custkey") % 22 != 0, F.col("at")).alias("added_at"),
    )


CUSTOMERS_SQL = """
l AS (SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY 1),
reg AS (SELECT 'd' || (o_custkey % 50) AS domain, CAST(o_custkey AS VARCHAR) AS norm_code,
        coalesce(CASE WHEN o_custkey % 11 <> 0 THEN latest END, CASE WHEN o_custkey % 22 <> 0 THEN latest END) AS seen FROM l)
"""


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = customers_as_registry(spark, sf_dir)
    kept = prune_stale(registry, F.lit(ASOF)).select(F.lit("kept").alias("part"), "domain", "norm_code")
    count = count_stale(registry, F.lit(ASOF))
    return kept.unionByName(
        count.select(F.lit("pruned").alias("part"), F.lit("").alias("domain"), F.col("pruned").cast("string").alias("norm_code"))
    )


PRUNED = f"""
WITH {CUSTOMERS_SQL}
SELECT 'kept' AS part, domain, norm_code FROM reg WHERE seen > TIMESTAMP '{ASOF}' - INTERVAL 90 DAY
UNION ALL
SELECT 'pruned', '', CAST(count(*) AS VARCHAR) FROM reg WHERE seen IS NULL OR NOT seen > TIMESTAMP '{ASOF}' - INTERVAL 90 DAY
"""


def stores_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = customers_as_registry(spark, sf_dir)
    stores = registry.groupBy("domain").agg(F.count(F.lit(1)).alias("before"))
    return drop_empty_stores(stores, prune_stale(registry, F.lit(ASOF), 5))


STORES_LEFT = f"""
WITH {CUSTOMERS_SQL}
SELECT domain, count(*) AS before FROM reg GROUP BY 1
HAVING count(*) FILTER (WHERE seen > TIMESTAMP '{ASOF}' - INTERVAL 5 DAY) > 0
"""


def _event_keys(spark: SparkSession, sf_dir: str, kind: str, tld: str) -> DataFrame:
    return events_k(spark, sf_dir).filter(F.col("event_type") == kind).select(
        "event_id",
        F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit(f".example.{tld}")).alias("domain"),
        F.col("k").cast("string").alias("code"),
    )


def event_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_keys(spark, sf_dir, "purchase", "com").select("domain", F.col("code").alias("norm_code")).distinct()


def event_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = _event_keys(spark, sf_dir, "error", "org")
    titles = errors.select(
        F.col("event_id").alias("report_id"),
        F.concat(F.lit("x Code failed: "), "code", F.lit(" @ "), "domain", F.lit(" ")).alias("title"),
    )
    return parse_reports(titles)


EVENT_SETS = f"""
reg AS (SELECT DISTINCT 's' || user_id || '.example.com' AS domain, CAST(k AS VARCHAR) AS norm_code FROM {EVENTS_K} WHERE event_type = 'purchase'),
rep AS (SELECT event_id AS report_id, CAST(k AS VARCHAR) AS code, 's' || user_id || '.example.org' AS store_domain FROM {EVENTS_K} WHERE event_type = 'error'),
hit AS (SELECT reg.domain, reg.norm_code, min(report_id) AS report_id FROM reg JOIN rep ON reg.norm_code = rep.code
        AND (reg.domain = rep.store_domain OR contains(reg.domain, split_part(rep.store_domain, '.', 1))) GROUP BY 1, 2)
"""


def reported_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_reported(event_registry(spark, sf_dir), event_reports(spark, sf_dir))


def reported_removed_by_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same removal by the flag that a run counts its removals with."""
    return mark_reported(event_registry(spark, sf_dir), event_reports(spark, sf_dir)).filter("not reported").drop("reported")


REPORTED_REMOVED = f"WITH {EVENT_SETS} SELECT domain, norm_code FROM reg ANTI JOIN hit USING (domain, norm_code)"


def report_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports_with_effect(event_registry(spark, sf_dir), event_reports(spark, sf_dir))


REPORT_EFFECT = f"""
WITH {EVENT_SETS}, n AS (SELECT report_id, count(*) AS removed FROM hit GROUP BY 1)
SELECT report_id, code, store_domain, coalesce(removed, 0) AS removed FROM rep LEFT JOIN n USING (report_id)
"""


def reports_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_k(spark, sf_dir)
    opening = F.when(F.col("event_type") == "error", F.lit("❌ Code failed: ")).otherwise(F.lit("Other: "))
    titles = events.select(
        F.col("event_id").alias("report_id"),
        F.concat(opening, F.lit(" C "), F.col("k"), F.lit(" @ shop"), F.col("user_id"), F.lit(".co.uk ")).alias("title"),
    )
    return parse_reports(titles)


REPORTS_PARSED = f"""
SELECT event_id AS report_id, 'C ' || k AS code, 'shop' || user_id || '.co.uk' AS store_domain FROM {EVENTS_K} WHERE event_type = 'error'
"""

# -- publication and run log --------------------------------------------------------------------


#: Stores that go to every task at most (some 100 MB); of more, the offers are shuffled to meet them.
SENT_STORES = 1_000_000


def _flat(offers: DataFrame, stores: DataFrame) -> DataFrame:
    names = durable(stores.select("domain", "name"))
    if names.count() <= SENT_STORES:
        names = F.broadcast(names)
    return offers.join(names, "domain").select(
        "domain", "code", "description", "type", F.array_join("sources", "|").alias("sources"),
        stamp(F.col("added_at")).alias("added_at"), "total", "name", F.col("ord.pos").alias("pos"),
    )


def _early(spark: SparkSession, sf_dir: str, part: tuple[int, int] = WHOLE) -> tuple[DataFrame, DataFrame]:
    _, stores = empty_registry(spark)
    return early_registry(spark, sf_dir, part), store_upsert(stores, item_offers(spark, sf_dir, "early", part), F.lit(EARLY))


def registry_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of all line items, published as JSON lines and read back."""
    path, count = work_path(spark, "published"), slices_of(table(spark, sf_dir, "lineitem"))
    _, none = empty_registry(spark)
    for part in ((number, count) for number in range(count)):
        offers = late_merge(spark, sf_dir, part).drop("is_new", "rows")
        stores = store_upsert(none, item_offers(spark, sf_dir, part=part), F.lit(EARLY))
        export_registry_json(offers, stores, path, F.lit(LATE), append=part[0] > 0)
    return _flat(*read_registry(spark, path))


def registry_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions, the second made of the first by the buckets it touches; both are read back."""
    base, count = work_path(spark, "registry"), slices_of(table(spark, sf_dir, "lineitem"))
    offers, stores = zip(*(_early(spark, sf_dir, (number, count)) for number in range(count)), strict=True)
    write_registry_table(offers, stores, base)
    upsert_into(spark, base, newest(spark, base), item_offers(spark, sf_dir, "late"), F.lit(LATE), slices=count)
    first, second = (_flat(*read_registry_table(spark, base, below)) for below in (2, None))
    return first.withColumn("version", F.lit(1)).unionByName(second.withColumn("version", F.lit(2)))


_FLAT_MERGED = f"""
SELECT domain, code, description, type, array_to_string(sources, '|') AS sources, {sql_stamp('added_at')} AS added_at,
       CAST(0 AS BIGINT) AS total, replace(replace(domain, '.example.com', ''), 's', 'Supplier ') AS name, pos
"""
REGISTRY_FLAT = f"""
WITH {ITEMS_SQL}
{_FLAT_MERGED} FROM merged
"""
REGISTRY_VERSIONS = f"""
WITH {ITEMS_SQL}
{_FLAT_MERGED}, 2 AS version FROM merged
UNION ALL
SELECT domain, code, text AS description, type, array_to_string(sources, '|') AS sources,
       {sql_stamp(f"TIMESTAMP '{EARLY}'")} AS added_at, CAST(0 AS BIGINT) AS total, store_name AS name, pos, 1 AS version
FROM facts WHERE early
"""


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_k(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("source"),
        F.col("k").alias("codesFound"), F.col("user_id").alias("codesAdded"), F.lit(0).alias("codesUpdated"),
        F.col("event_id").alias("duration"), F.array().cast("array<string>").alias("errors"),
    )


def logged_last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "runs")
    append_run_log(event_runs(spark, sf_dir), path)
    return last_runs(read_run_log(spark, path), ties=("duration",)).select(
        stamp(F.col("timestamp")).alias("timestamp"), "source", "codesFound", "duration"
    )


def runs_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = last_runs_per_source(event_runs(spark, sf_dir), 20, ("duration",))
    return runs.select(stamp(F.col("timestamp")).alias("timestamp"), "source", "codesFound", "duration")


LAST_RUNS = f"""
SELECT {sql_stamp('ts')} AS timestamp, event_type AS source, k AS "codesFound", event_id AS duration
FROM (SELECT * FROM {EVENTS_K} ORDER BY ts DESC, event_id DESC LIMIT 100)
"""
RUNS_BY_SOURCE = f"""
SELECT {sql_stamp('ts')} AS timestamp, event_type AS source, k AS "codesFound", event_id AS duration
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM {EVENTS_K}) WHERE n <= 20
"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = late_merge(spark, sf_dir)
    return run_summary(merged, F.lit(LATE))


RUN_SUMMARY = f"""
WITH {ITEMS_SQL},
c AS (SELECT CAST(sum(rows) AS BIGINT) AS found, count(*) FILTER (WHERE is_new) AS added,
             CAST(sum(rows) AS BIGINT) - count(*) FILTER (WHERE is_new) AS updated,
             count(*) FILTER (WHERE last_seen < TIMESTAMP '{LATE}') AS pruned, count(*) FILTER (WHERE last_seen = TIMESTAMP '{LATE}') AS total FROM merged)
SELECT unnest(['found', 'added', 'updated', 'pruned', 'total']) AS counter, unnest([found, added, updated, pruned, total]) AS n FROM c
"""


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a published registry says of itself."""
    meta = registry_meta(late_merge(spark, sf_dir), F.lit(LATE))
    return meta.select("total_codes", "version", stamp(F.col("last_updated")).alias("last_updated"))


REGISTRY_META = f"""
WITH {ITEMS_SQL} SELECT count(*) AS total_codes, '1.0' AS version, {sql_stamp(f"TIMESTAMP '{LATE}'")} AS last_updated FROM merged
"""


def collection_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run: collect (one source fails while it is read, some pages of another cannot be read), merge, expire,
    remove reported, drop empty stores, log.

    Offers left per store, the counters, the error rows of pages, and what the log says of each source.
    """
    offers, stores = _early(spark, sf_dir)
    reports = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("report_id"),
        F.concat(F.lit("P"), (F.col("s_suppkey") * 3).cast("string")).alias("code"),
        F.concat(F.lit("s"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".example.com")).alias("store_domain"),
    )
    late = item_offers(spark, sf_dir, "late")
    broken = late.withColumn("code", F.when(F.col("pos") >= 0, F.raise_error(F.lit("unreadable")).cast("string")))
    captures = faulty_captures(spark, sf_dir, "coupert")
    collected = collect_sources(spark, {"items": lambda: late, "broken": lambda: broken, "pages": lambda: collect_pages(captures)})
    result = run_collection(offers, stores, collected.offers, F.lit(LATE), reports, collected.errors)
    log = work_path(spark, "runs")
    for _ in range(2):
        append_run_log(collected.runs, log)
    trim_run_log(spark, log, 5)
    logged = read_run_log(spark, log).groupBy("source").agg(F.max(F.col("codesFound") + F.size("errors")).alias("n"))
    per_store = result.offers.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    left = result.stores.join(per_store, "domain").select(F.lit("store").alias("part"), F.col("domain").alias("label"), "n")
    counters = result.summary.select(F.lit("counter").alias("part"), F.col("counter").alias("label"), "n")
    faults = collected.errors.filter("source = 'coupert'").groupBy(F.lit("error").alias("part"), F.col("error").alias("label")).agg(F.count("*").alias("n"))
    logged = logged.select(F.lit("log").alias("part"), F.col("source").alias("label"), "n")
    return left.unionByName(counters).unionByName(faults).unionByName(logged)


COLLECTION_RUN = f"""
WITH {ITEMS_SQL},
page_rows AS (SELECT lower(store_domain) AS domain, {sql_norm('code')} AS code FROM ({BUTTON_OFFERS})
              WHERE CAST(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT) % 50 > 1),
faults AS (SELECT replace(p_name, ' ', '-') || CASE p_partkey % 50 WHEN 0 THEN ': unknown status keyword ''part'' in marked section'
                                                                   ELSE ': HTTP 503' END AS label
           FROM part WHERE p_partkey % 50 < 2),
kept AS (SELECT domain, code FROM merged WHERE last_seen = TIMESTAMP '{LATE}' UNION ALL SELECT DISTINCT domain, code FROM page_rows),
rep AS (SELECT 'P' || (s_suppkey * 3) AS code, 's' || (s_suppkey % 7) AS label FROM supplier),
gone AS (SELECT DISTINCT domain, kept.code FROM kept JOIN rep ON kept.code = rep.code AND contains(kept.domain, rep.label)),
left_ AS (SELECT * FROM kept ANTI JOIN gone USING (domain, code)),
p AS (SELECT count(*) AS n, count(DISTINCT (domain, code)) AS new FROM page_rows)
SELECT 'store' AS part, domain AS label, count(*) AS n FROM left_ GROUP BY 2
UNION ALL SELECT 'counter', 'found', CAST(sum(rows) AS BIGINT) + (SELECT n FROM p) FROM merged
UNION ALL SELECT 'counter', 'added', count(*) FILTER (WHERE is_new) + (SELECT new FROM p) FROM merged
UNION ALL SELECT 'counter', 'updated', CAST(sum(rows) AS BIGINT) - count(*) FILTER (WHERE is_new) + (SELECT n - new FROM p) FROM merged
UNION ALL SELECT 'counter', 'pruned', count(*) FILTER (WHERE last_seen < TIMESTAMP '{LATE}') FROM merged
UNION ALL SELECT 'counter', 'removed', count(*) FROM gone
UNION ALL SELECT 'counter', 'total', count(*) FROM left_
UNION ALL SELECT 'counter', 'errors', 1 + (SELECT count(*) FROM faults)
UNION ALL SELECT 'error', label, count(*) FROM faults GROUP BY 2
UNION ALL SELECT 'log', 'items', CAST(sum(rows) AS BIGINT) FROM merged
UNION ALL SELECT 'log', 'broken', 1
UNION ALL SELECT 'log', 'pages', (SELECT n FROM p) + least(count(*), 100) + CAST(count(*) > 100 AS INT) FROM faults
"""

QUERIES = {
    "q_merge_registry": merge_registry,
    "q_merge_stats": merged_stats,
    "q_store_upsert": stores_of,
    "q_union_sources": union_and_contribution,
    "q_dedupe_first": dedupe_first,
    "q_success_bump": success_bump,
    "q_prune": pruned,
    "q_drop_empty_stores": stores_left,
    "q_remove_reported": reported_removed,
    "q_remove_reported_many": reported_removed_by_pieces,
    "q_report_effect": report_effect,
    "q_reports_parse": reports_parsed,
    "q_registry_json": registry_json,
    "q_registry_snapshot": registry_snapshot,
    "q_last_runs": logged_last_runs,
    "q_last_runs_per_source": runs_by_source,
    "q_run_summary": summary,
    "q_registry_meta": totals,
    "q_collection_run": collection_run,
}

SQL = {
    "q_merge_registry": MERGE_REGISTRY,
    "q_merge_stats": MERGE_STATS,
    "q_store_upsert": STORE_UPSERT,
    "q_union_sources": UNION_SOURCES,
    "q_dedupe_first": DEDUPE_FIRST,
    "q_success_bump": SUCCESS_BUMP,
    "q_prune": PRUNED,
    "q_drop_empty_stores": STORES_LEFT,
    "q_remove_reported": REPORTED_REMOVED,
    "q_remove_reported_many": REPORTED_REMOVED,
    "q_report_effect": REPORT_EFFECT,
    "q_reports_parse": REPORTS_PARSED,
    "q_registry_json": REGISTRY_FLAT,
    "q_registry_snapshot": REGISTRY_VERSIONS,
    "q_last_runs": LAST_RUNS,
    "q_last_runs_per_source": RUNS_BY_SOURCE,
    "q_run_summary": RUN_SUMMARY,
    "q_registry_meta": REGISTRY_META,
    "q_collection_run": COLLECTION_RUN,
}
