"""Serving: host lookup, ranking, roll-ups, cards, savings, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.ratings import age_label
from offerloom.functions.stores import host_of
from offerloom.operators.ranking import with_position
from offerloom.operators.serve import (
    apply_tests,
    best_offer,
    classify_outcomes,
    last_verified,
    match_store,
    offer_cards,
    offers_for_hosts,
    outcome_counts,
    outcomes_to_tests,
    rank_offers,
    savings_totals,
    store_rollup,
    trial_order,
    visible_offers,
    with_rate,
)
from offerloom.plans.lookup import lookup_hosts, lookup_stored
from offerloom.queries.common import SQL_HOST, sql_stamp, stamp, table
from offerloom.queries.registry import EVENTS_K, TESTED_SQL, events_k, tested_offers
from offerloom.session import work_path
from offerloom.sources.store_keys import rebuild_store_keys
from offerloom.sources.versions import empty_registry, write_registry_table

ASOF = "2024-02-01 12:00:00"

# Hosts of the pages that are served through the priority list in the store sample below.
PRIORITY = ("therin.example.net", "ththwh.example.org", "ththnt.example.com", "blog.ththon.example.net")


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(host_of(F.col("url")).alias("host"), "page_id")


def sample_stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stores keyed like the hosts of the pages, in five spellings, and one offer for most."""
    hosts = page_hosts(spark, sf_dir).groupBy("host").agg(F.min("page_id").alias("n"))
    host, n = F.col("host"), F.col("n")
    label = F.substring_index(host, ".", 1)
    domain = (
        F.when(n % 5 == 0, host)
        .when(n % 5 == 1, F.concat(F.lit("www."), host))
        .when(n % 5 == 2, F.concat(host, F.lit(".co.uk")))
        .when(n % 5 == 3, F.substring_index(host, ".", 2))
        .when(n % 2 == 0, F.concat(F.lit("www."), label))
        .otherwise(F.concat(F.lit("x"), label, F.lit("x.shop")))
    )
    stores = hosts.select(domain.alias("domain"), "n").groupBy("domain").agg(F.min("n").alias("n"))
    place = F.struct(
        F.timestamp_seconds(F.lit(0)).alias("run"), F.lit(0).alias("source_rank"), F.lit("").alias("page_key"), F.col("n").alias("pos")
    )
    stores = stores.select(
        "domain", F.concat(F.lit("Store "), "n").alias("name"), F.lit("general").alias("category"), place.alias("ord"), "n"
    )
    offers = stores.filter(F.col("n") % 13 != 0).select("domain", F.concat(F.lit("C"), "n").alias("code"))
    return stores.drop("n"), offers


STORES_SQL = f"""
hosts AS (SELECT {SQL_HOST} AS host, min(page_id) AS n FROM pages GROUP BY 1),
stores AS (SELECT domain, min(n) AS n FROM (
  SELECT n, CASE n % 5 WHEN 0 THEN host WHEN 1 THEN 'www.' || host WHEN 2 THEN host || '.co.uk'
    WHEN 3 THEN split_part(host, '.', 1) || '.' || split_part(host, '.', 2)
    ELSE CASE WHEN n % 2 = 0 THEN 'www.' || split_part(host, '.', 1) ELSE 'x' || split_part(host, '.', 1) || 'x.shop' END END AS domain
  FROM hosts) GROUP BY 1),
offers AS (SELECT domain, 'C' || n AS code FROM stores WHERE n % 13 <> 0),
bases AS (SELECT *, replace(regexp_replace(domain, '\\.co\\.uk$', ''), '.', '') AS kb FROM stores),
t1 AS (SELECT host, 1 AS tier, domain FROM hosts JOIN stores ON domain = host),
t2 AS (SELECT host, 2 AS tier, domain FROM hosts JOIN stores ON domain = 'www.' || host),
t3 AS (SELECT host, 3 AS tier, domain FROM hosts JOIN stores ON domain = host || '.co.uk'),
t4 AS (SELECT host, 4 AS tier, arg_min(domain, b.n) AS domain FROM hosts JOIN bases b
       ON contains(host, kb) OR contains(kb, replace(host, '.', '')) OR contains(replace(host, '.', ''), kb) GROUP BY 1),
pri AS (SELECT unnest(['therin.example.net', 'ththwh.example.org', 'ththnt.example.com', 'blog.ththon.example.net']) AS p, unnest(range(4)) AS place),
own AS (SELECT place, arg_min(domain, n) AS domain FROM pri JOIN stores ON domain = p OR contains(p, regexp_replace(domain, '^www\\.', '')) GROUP BY 1),
stocked AS (SELECT place, own.domain FROM own SEMI JOIN offers ON own.domain = offers.domain),
pool AS (SELECT DISTINCT place, split_part(p, '.', 1) AS label FROM pri JOIN offers ON contains(offers.domain, split_part(p, '.', 1))),
t5 AS (SELECT host, place, s.domain, l.label FROM hosts JOIN pri ON contains(host, p) OR contains(p, host)
       LEFT JOIN stocked s USING (place) LEFT JOIN pool l USING (place) WHERE s.domain IS NOT NULL OR l.label IS NOT NULL),
t5b AS (SELECT host, CASE WHEN domain IS NULL THEN 6 ELSE 5 END AS tier, domain, CASE WHEN domain IS NULL THEN label END AS pool
        FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY place) AS k FROM t5) WHERE k = 1),
every AS (SELECT host, tier, domain, NULL AS pool FROM t1 UNION ALL SELECT *, NULL FROM t2 UNION ALL SELECT *, NULL FROM t3
          UNION ALL SELECT *, NULL FROM t4 UNION ALL SELECT * FROM t5b),
matched AS (SELECT host, tier, domain, pool FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY tier) AS k FROM every) WHERE k = 1)
"""


def matched_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores, offers = sample_stores(spark, sf_dir)
    matched = match_store(page_hosts(spark, sf_dir), stores, offers, PRIORITY)
    return matched.select(
        "host", F.col("tier").cast("long").alias("tier"), F.coalesce("domain", F.lit("")).alias("domain"),
        F.coalesce("pool", F.lit("")).alias("pool"), "name",
    )


MATCHED_HOSTS = f"""
WITH {STORES_SQL}
SELECT host, CAST(tier AS BIGINT) AS tier, coalesce(m.domain, '') AS domain, coalesce(pool, '') AS pool,
       CASE WHEN tier = 6 THEN 'Gaming Store' ELSE 'Store ' || s.n END AS name
FROM matched m LEFT JOIN stores s ON m.domain = s.domain
"""


def hosts_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores, offers = sample_stores(spark, sf_dir)
    matched = match_store(page_hosts(spark, sf_dir), stores, offers, PRIORITY)
    return offers_for_hosts(matched, offers).select("host", "domain", "code")


HOSTS_OFFERS = f"""
WITH {STORES_SQL}
SELECT host, o.domain, code FROM matched m JOIN offers o ON m.domain = o.domain WHERE tier < 6
UNION ALL SELECT host, o.domain, code FROM matched m JOIN offers o ON contains(o.domain, m.pool) WHERE tier = 6
"""

RANKED_SQL = f"""
tested AS ({TESTED_SQL}),
rated AS (SELECT *, CASE WHEN total = 0 THEN NULL ELSE CAST(floor(100.0 * worked / total + 0.5) AS BIGINT) END AS rate FROM tested),
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY coalesce(rate, -1) DESC, last_seen DESC, CAST(code AS BIGINT)) AS position,
                  count(*) OVER (PARTITION BY domain) AS size FROM rated)
"""


def ranked_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = with_rate(rank_offers(tested_offers(spark, sf_dir)))
    return ranked.select("domain", "code", F.coalesce("rate", F.lit(-1)).alias("rate"), "rate_class", "position", "size")


RANKED_OFFERS = f"""
WITH {RANKED_SQL}
SELECT domain, code, coalesce(rate, -1) AS rate,
       CASE WHEN rate >= 70 THEN 'green' WHEN rate >= 40 THEN 'yellow' WHEN rate IS NOT NULL THEN 'red' ELSE '' END AS rate_class, position, size FROM ranked
"""


def ranked_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every line item of a supplier by price; every seventh supplier is unknown, one large group."""
    supplier = F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey"))
    lines = table(spark, sf_dir, "lineitem").select(
        supplier.alias("supplier"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.floor(F.col("l_extendedprice") * 100 + 0.5).alias("cents")
    )
    order = [F.col("cents").desc(), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    ranked = with_position(lines, ["supplier"], order)
    return ranked.groupBy("supplier", "size").agg(
        F.sum(F.col("position") * (F.col("cents") % 1000)).alias("mix"), F.max("position").alias("last"),
        F.countDistinct("position").alias("positions"),
    )


RANKED_IN_RANGES = """
WITH l AS (SELECT CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END AS supplier, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents,
                  l_orderkey, l_partkey, l_linenumber, l_suppkey FROM lineitem),
     r AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY cents DESC, l_orderkey, l_partkey, l_linenumber, l_suppkey) AS position,
                  count(*) OVER (PARTITION BY supplier) AS size FROM l)
SELECT supplier, size, CAST(sum(position * (cents % 1000)) AS BIGINT) AS mix, max(position) AS last, count(DISTINCT position) AS positions FROM r GROUP BY 1, 2
"""


def tried_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = trial_order(tested_offers(spark, sf_dir))
    return tried.select("domain", "code", "position", F.floor(F.col("progress") * 1000 + 0.5).alias("progress"))


TRIED_OFFERS = f"""
WITH {RANKED_SQL} SELECT domain, code, position, CAST(floor(position / size * 100 * 1000 + 0.5) AS BIGINT) AS progress FROM ranked
"""


def best_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_offer(tested_offers(spark, sf_dir)).select("domain", "code", "worked", "total")


BEST_OFFERS = f"WITH {RANKED_SQL} SELECT domain, code, worked, total FROM ranked WHERE position = 1"


def hidden_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers readers reported: all errors. Those of even events name codes that no store has, and hide nothing."""
    errors = events_k(spark, sf_dir).filter(F.col("event_type") == "error")
    code = F.when(F.col("event_id") % 2 == 1, F.col("k")).otherwise(F.col("k") + 1_000_000)
    return errors.select(
        F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string"), F.lit(".example.com")).alias("domain"),
        code.cast("string").alias("code"),
    )


HIDDEN_SQL = f"""
hidden AS (SELECT DISTINCT 's' || (user_id % 10) || '.example.com' AS domain,
                  CAST(CASE event_id % 2 WHEN 1 THEN k ELSE k + 1000000 END AS VARCHAR) AS code FROM {EVENTS_K} WHERE event_type = 'error')
"""


def shown_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_offers(tested_offers(spark, sf_dir), hidden_offers(spark, sf_dir)).select("domain", "code", "total")


SHOWN_OFFERS = f"WITH {HIDDEN_SQL}, t AS ({TESTED_SQL}) SELECT domain, code, total FROM t ANTI JOIN hidden USING (domain, code)"


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = store_rollup(tested_offers(spark, sf_dir), hidden_offers(spark, sf_dir))
    return rolled.withColumn("rate", F.coalesce("rate", F.lit(-1)))


ROLLUP = f"""
WITH {HIDDEN_SQL}, t AS ({TESTED_SQL}),
m AS (SELECT t.*, h.domain IS NULL AS shown FROM t LEFT JOIN hidden h USING (domain, code)),
g AS (SELECT domain, count(*) FILTER (WHERE shown) AS visible, count(*) FILTER (WHERE NOT shown) AS hidden,
             CAST(coalesce(sum(total) FILTER (WHERE shown), 0) AS BIGINT) AS total, CAST(coalesce(sum(worked) FILTER (WHERE shown), 0) AS BIGINT) AS worked
      FROM m GROUP BY 1),
r AS (SELECT *, CASE WHEN total = 0 THEN -1 ELSE CAST(floor(100.0 * worked / total + 0.5) AS BIGINT) END AS rate FROM g)
SELECT *, CASE WHEN rate >= 70 THEN 'green' WHEN rate >= 40 THEN 'yellow' WHEN rate >= 0 THEN 'red' ELSE '' END AS rate_class FROM r
"""


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_verified(tested_offers(spark, sf_dir), F.lit(ASOF))


_AGE = f"CAST(floor(epoch(TIMESTAMP '{ASOF}' - {{0}}) / 86400) AS BIGINT)"


def _sql_age(moment: str) -> str:
    days = _AGE.format(moment)
    return f"CASE WHEN {days} < 1 THEN 'today' WHEN {days} = 1 THEN '1 day ago' ELSE {days} || ' days ago' END"


VERIFIED = f"WITH {RANKED_SQL} SELECT domain, {_sql_age('last_seen')} AS last_verified FROM ranked WHERE position = 1"


def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of every event in words, counted."""
    label = age_label(F.col("ts").cast("timestamp"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy(label.alias("age")).agg(F.count(F.lit(1)).alias("n"))


AGES = f"SELECT {_sql_age('ts').replace(ASOF, '2024-01-31 00:00:00')} AS age, count(*) AS n FROM events GROUP BY 1"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = offer_cards(tested_offers(spark, sf_dir))
    return shown.select(
        "domain", "code", F.coalesce("rate", F.lit(-1)).alias("rate"), "rate_class", "description",
        F.coalesce("type", F.lit("")).alias("type"), "sources",
    )


CARDS = f"""
WITH {RANKED_SQL}
SELECT domain, code, coalesce(rate, -1) AS rate,
       CASE WHEN rate >= 70 THEN 'green' WHEN rate >= 40 THEN 'yellow' WHEN rate IS NOT NULL THEN 'red' ELSE '' END AS rate_class,
       '' AS description, CASE WHEN total % 2 = 0 THEN 'percentage' ELSE '' END AS type, 'events' AS sources FROM ranked
"""


def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_k(spark, sf_dir).filter(F.col("event_type").isin("purchase", "view"))
    amount = F.when(F.col("event_type") == "purchase", F.concat(F.col("value").cast("string"), F.lit(" GBP"))).when(
        F.col("k") % 2 == 0, F.concat(F.lit("-"), F.col("value").cast("string"))
    ).otherwise(F.lit("n/a"))
    totals = savings_totals(events.select(amount.alias("amount")))
    return totals.select((F.col("saved") * 100).cast("long").alias("pence"), "orders", "label")


SAVINGS = """
WITH s AS (SELECT CAST(sum(CAST(value AS DECIMAL(12, 2))) AS DECIMAL(38, 2)) AS saved, count(*) AS orders FROM events WHERE event_type = 'purchase' AND value > 0)
SELECT CAST(saved * 100 AS BIGINT) AS pence, orders, '£' || CAST(saved AS VARCHAR) AS label FROM s
"""

SUCCESS, FAILURE = ("the er", "que le"), ("of the", "de la", "an")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as result pages, with wordings that occur in them."""
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 9).cast("string").alias("domain"), F.col("role").alias("code"), F.col("text").alias("page_text"),
        F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("ts"),
    )
    return classify_outcomes(turns, success=SUCCESS, failure=FAILURE)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome_counts(attempts(spark, sf_dir))


def tests_from_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes_to_tests(attempts(spark, sf_dir)).withColumn("last_tested", stamp(F.col("last_tested")))


OUTCOMES_SQL = r"""
att AS (SELECT CAST(conv_id % 9 AS VARCHAR) AS domain, role AS code, make_timestamp((conv_id * 1000 + turn) * 1000000) AS ts,
        CASE WHEN contains(lower(text), 'the er') OR contains(lower(text), 'que le') THEN 'success'
             WHEN contains(lower(text), 'of the') OR contains(lower(text), 'de la') OR contains(lower(text), 'an') THEN 'failure'
             ELSE 'unknown' END AS status FROM conversations)
"""
OUTCOMES = f"WITH {OUTCOMES_SQL} SELECT domain, code, status, count(*) AS n FROM att GROUP BY 1, 2, 3"
TESTS = f"""
WITH {OUTCOMES_SQL}
SELECT domain, code, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS worked, {sql_stamp('max(ts)')} AS last_tested FROM att GROUP BY 1, 2
"""


def tests_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of the clicks added to the stored ones."""
    clicks = events_k(spark, sf_dir).filter(F.col("event_type") == "click")
    status = F.when(F.col("value") > 20, F.lit("success")).otherwise(F.lit("failure"))
    new = outcomes_to_tests(
        clicks.select(
            F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string"), F.lit(".example.com")).alias("domain"),
            F.col("k").cast("string").alias("code"), status.alias("status"), "ts",
        )
    )
    applied = apply_tests(tested_offers(spark, sf_dir), new)
    return applied.select("domain", "code", "total", "worked", stamp(F.col("last_tested")).alias("last_tested"))


TESTS_APPLIED = f"""
WITH t AS ({TESTED_SQL}),
c AS (SELECT 's' || (user_id % 10) || '.example.com' AS domain, CAST(k AS VARCHAR) AS code, count(*) AS n,
             count(*) FILTER (WHERE value > 20) AS w, max(ts) AS ts FROM {EVENTS_K} WHERE event_type = 'click' GROUP BY 1, 2)
SELECT domain, code, total + coalesce(n, 0) AS total, worked + coalesce(w, 0) AS worked, {sql_stamp('ts')} AS last_tested FROM t LEFT JOIN c USING (domain, code)
"""


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup run for every user number: header rows of the matched stores."""
    offers = tested_offers(spark, sf_dir)
    place = F.struct(
        F.timestamp_seconds(F.lit(0)).alias("run"), F.lit(0).alias("source_rank"), F.lit("").alias("page_key"),
        F.substring("domain", 2, 1).cast("long").alias("pos"),
    )
    stores = offers.select("domain").distinct().select(
        "domain", F.col("domain").alias("name"), F.lit("general").alias("category"), place.alias("ord")
    )
    host = F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string"), F.lit(".example.com"))
    hosts = table(spark, sf_dir, "events").select(host.alias("host"))
    _, cards_, header = lookup_hosts(hosts, stores, offers, hidden_offers(spark, sf_dir), F.lit(ASOF))
    first = cards_.filter(F.col("position") == 1).select("shop", F.col("code").alias("best"), "size")
    return header.join(first, "shop").select(F.col("shop").alias("domain"), "visible", "hidden", "last_verified", "best", "size")


LOOKUP = f"""
WITH {HIDDEN_SQL}, {RANKED_SQL.replace('ranked AS (SELECT *', 'shown AS (SELECT * FROM rated ANTI JOIN hidden USING (domain, code)), ranked AS (SELECT *').replace('FROM rated)', 'FROM shown)')}
SELECT domain, size AS visible, (SELECT count(*) FROM tested t WHERE t.domain = r.domain) - size AS hidden,
       {_sql_age('last_seen')} AS last_verified, code AS best, size FROM ranked r WHERE position = 1
"""

def pool_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of every host of the pages in a stored registry, through its key index: the shop it leads to, which may be a
    pool of stores, and the cards and codes it shows. Every offer has a twin of the same code; every third is hidden."""
    stores, offers = sample_stores(spark, sf_dir)
    twins = offers.withColumn("dup_no", F.explode(F.array(F.lit(0), F.lit(1))))
    full, _ = empty_registry(spark)
    full = full.unionByName(twins.withColumn("norm_code", F.col("code")), allowMissingColumns=True)
    base = work_path(spark, "served")
    write_registry_table(full, stores, base)
    rebuild_store_keys(spark, base, stores)
    hidden = offers.filter(F.substring("code", 2, 20).cast("long") % 3 == 0)
    matched, cards_, _ = lookup_stored(spark, base, page_hosts(spark, sf_dir), hidden, F.lit(ASOF), PRIORITY)
    shown = cards_.groupBy("pooled", "shop").agg(F.count("*").alias("cards"), F.count_distinct("domain", "code").alias("codes"))
    return matched.join(shown, ["pooled", "shop"], "left").select(
        "host", F.col("tier").cast("long").alias("tier"), "pooled", "shop", F.coalesce("cards", F.lit(0)).alias("cards"), F.coalesce("codes", F.lit(0)).alias("codes")
    )


POOL_LOOKUP = f"""
WITH {STORES_SQL},
shown AS (SELECT * FROM offers WHERE CAST(substr(code, 2) AS BIGINT) % 3 <> 0),
served AS (SELECT host, domain AS of_store FROM shown JOIN matched USING (domain) WHERE tier < 6
           UNION ALL SELECT host, s.domain FROM matched m JOIN shown s ON contains(s.domain, m.pool) WHERE tier = 6),
sizes AS (SELECT host, count(*) AS n FROM served GROUP BY 1)
SELECT host, CAST(tier AS BIGINT) AS tier, tier = 6 AS pooled, CASE WHEN tier = 6 THEN pool ELSE domain END AS shop,
       2 * coalesce(n, 0) AS cards, coalesce(n, 0) AS codes FROM matched LEFT JOIN sizes USING (host)
"""

QUERIES = {
    "q_match_store": matched_hosts,
    "q_offers_for_hosts": hosts_offers,
    "q_rank_offers": ranked_offers,
    "q_rank_in_ranges": ranked_in_ranges,
    "q_trial_order": tried_offers,
    "q_best_offer": best_offers,
    "q_hide_reported": shown_offers,
    "q_store_rollup": rollup,
    "q_last_verified": verified,
    "q_age_label": ages,
    "q_cards": cards,
    "q_savings": savings,
    "q_outcomes": outcomes,
    "q_outcomes_to_tests": tests_from_outcomes,
    "q_tests_applied": tests_applied,
    "q_lookup": lookup,
    "q_lookup_pool": pool_lookup,
}

SQL = {
    "q_match_store": MATCHED_HOSTS,
    "q_offers_for_hosts": HOSTS_OFFERS,
    "q_rank_offers": RANKED_OFFERS,
    "q_rank_in_ranges": RANKED_IN_RANGES,
    "q_trial_order": TRIED_OFFERS,
    "q_best_offer": BEST_OFFERS,
    "q_hide_reported": SHOWN_OFFERS,
    "q_store_rollup": ROLLUP,
    "q_last_verified": VERIFIED,
    "q_age_label": AGES,
    "q_cards": CARDS,
    "q_savings": SAVINGS,
    "q_outcomes": OUTCOMES,
    "q_outcomes_to_tests": TESTS,
    "q_tests_applied": TESTS_APPLIED,
    "q_lookup": LOOKUP,
    "q_lookup_pool": POOL_LOOKUP,
}
