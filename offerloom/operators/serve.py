"""Reading side of the registry: match a host, rank, roll up, describe."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.fixed import POOL_NAME, PRIORITY_DOMAINS
from offerloom.functions.descriptions import money, parse_amount
from offerloom.functions.ratings import age_label, outcome, rate, rate_class
from offerloom.functions.text import blank_to_null
from offerloom.operators.contains import join_containing
from offerloom.operators.dedupe import first_rows
from offerloom.operators.ranking import with_position
from offerloom.session import durable
from offerloom.sources.store_keys import StoreKeys, key_base

EXACT, WWW, CO_UK, PARTIAL, PRIORITY, POOL = 1, 2, 3, 4, 5, 6


def _partial_matches(hosts: DataFrame, stores: DataFrame, keys: StoreKeys | None = None) -> DataFrame:
    """First store per host by containment between host and store key, either way round.

    With an index of the keys only its buckets with a piece of a host are read; else all keys are taken apart.
    """
    compact = F.replace(F.col("host"), F.lit("."), F.lit(""))
    names = hosts.select("host", F.explode(F.array_distinct(F.array("host", compact))).alias("name"))
    if keys is not None:
        found = keys.containing(names.withColumn("short", F.col("name") == compact))
        hits = found.join(stores.select("domain", F.struct("ord", "domain").alias("store")), "domain").select("host", "store")
    else:
        bases = stores.groupBy(key_base(F.col("domain")).alias("base")).agg(F.min(F.struct("ord", "domain")).alias("store"))
        inside_host = join_containing(names, "name", bases, "base").select("host", "store")
        short = hosts.select("host", compact.alias("name"))
        hits = inside_host.unionByName(join_containing(bases, "base", short, "name").select("host", "store"))
    return (
        hits.groupBy("host")
        .agg(F.min("store").alias("store"))
        .select("host", F.lit(PARTIAL).alias("tier"), F.col("store.domain").alias("domain"))
    )


def _literal_hits(priority: Sequence[str], test) -> Column:
    """(ord, name) of every priority domain that passes ``test``; the list is fixed and short."""
    entries = F.array(
        *(F.struct(F.lit(i).alias("place"), F.lit(name).alias("name")) for i, name in enumerate(priority))
    )
    return F.filter(entries, lambda entry: test(entry["name"]))


def _priority_matches(
    hosts: DataFrame, stores: DataFrame, stocked: DataFrame, priority: Sequence[str]
) -> DataFrame:
    """Last resort: the host resembles a priority domain, which leads to its store or to a pool."""
    host, domain = F.col("host"), F.col("domain")
    wanted = hosts.select(
        "host",
        F.inline(_literal_hits(priority, lambda p: F.contains(host, p) | F.contains(p, host))),
    )
    bare = F.regexp_replace(domain, r"^www\.", "")
    owners = (
        stores.select(
            "ord",
            "domain",
            F.inline(_literal_hits(priority, lambda p: (domain == p) | F.contains(p, bare))),
        )
        .groupBy("place")
        .agg(F.min(F.struct("ord", "domain")).alias("store"))
        .select("place", "store.domain")
        .join(stocked, "domain", "left_semi")
    )
    pools = stocked.select(
        F.inline(_literal_hits(priority, lambda p: F.contains(domain, F.substring_index(p, ".", 1))))
    ).select("place").distinct()
    # Both sides hold at most one row per entry of the fixed priority list.
    placed = wanted.join(F.broadcast(owners), "place", "left").join(
        F.broadcast(pools.withColumn("pooled", F.lit(True))), "place", "left"
    )
    usable = placed.filter(F.col("domain").isNotNull() | F.col("pooled"))
    best = usable.groupBy("host").agg(F.min(F.struct("place", "domain", "name")).alias("b"))
    owned = F.col("b.domain").isNotNull()
    return best.select(
        "host",
        F.when(owned, F.lit(PRIORITY)).otherwise(F.lit(POOL)).alias("tier"),
        F.col("b.domain").alias("domain"),
        F.when(~owned, F.substring_index("b.name", ".", 1)).alias("pool"),
    )


def match_store(
    hosts: DataFrame,
    stores: DataFrame,
    offers: DataFrame,
    priority: Sequence[str] = PRIORITY_DOMAINS,
    keys: StoreKeys | None = None,
) -> DataFrame:
    """Store of every distinct host: (host, tier, domain, pool, name); unmatched hosts are absent.

    ``keys`` is the index of a stored registry; without it the store keys are taken apart anew.

    Equality tiers are hash joins; only hosts they leave over go to the containment tiers.  The
    answer of the equality tiers is kept, as it is read once for its matches and twice for the rest.
    """
    hosts = hosts.select("host").distinct()
    spelled = hosts.select(
        "host",
        F.inline(
            F.array(
                F.struct(F.lit(EXACT).alias("tier"), F.col("host").alias("domain")),
                F.struct(F.lit(WWW).alias("tier"), F.regexp_replace("host", r"^www\.", "").alias("domain")),
                F.struct(F.lit(WWW).alias("tier"), F.concat(F.lit("www."), "host").alias("domain")),
                F.struct(F.lit(CO_UK).alias("tier"), F.concat("host", F.lit(".co.uk")).alias("domain")),
            )
        ),
    )
    known = stores.select("domain", F.lit(True).alias("known"))
    # Within the second tier the spelling without www. goes first; it is the shorter one.
    spelling = F.struct("tier", F.length("domain").alias("size"), "domain")
    tried = durable(
        spelled.join(known, "domain", "left")
        .groupBy("host")
        .agg(F.min(F.when(F.col("known"), spelling)).alias("m"))
        .select("host", "m.tier", "m.domain")
    )
    equal = tried.filter(F.col("tier").isNotNull())
    rest = tried.filter(F.col("tier").isNull()).select("host")
    stocked = stores.select("domain").join(offers.select("domain").distinct(), "domain", "left_semi")
    others = _partial_matches(rest, stores, keys).unionByName(
        _priority_matches(rest, stores, stocked, priority), allowMissingColumns=True
    )
    first = others.groupBy("host").agg(F.min(F.struct("tier", "domain", "pool")).alias("m"))
    matched = equal.unionByName(
        first.select("host", "m.tier", "m.domain", "m.pool"), allowMissingColumns=True
    )
    names = stores.select("domain", "name")
    return matched.join(names, "domain", "left").select(
        "host",
        "tier",
        "domain",
        "pool",
        F.when(F.col("tier") == POOL, F.lit(POOL_NAME)).otherwise(F.col("name")).alias("name"),
    )


def shop_of(matched: DataFrame) -> DataFrame:
    """Matched hosts with what they are served: ``shop`` is a store's domain, or the label of a pool (``pooled``)."""
    pooled = F.col("tier") == POOL
    return matched.withColumns({"pooled": pooled, "shop": F.when(pooled, F.col("pool")).otherwise(F.col("domain"))})


def shop_offers(matched: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers of every shop that a host leads to, each once: (pooled, shop) and the columns of the offer.

    A pool holds the offers of all stores whose key contains its label.
    """
    shops = shop_of(matched).select("pooled", "shop").distinct()
    own = shops.filter(~F.col("pooled")).select("shop", F.col("shop").alias("domain"))
    labels = shops.filter("pooled").select("shop")
    pooled = join_containing(offers.select("domain").distinct(), "domain", labels, "shop").select("shop", "domain")
    members = own.withColumn("pooled", F.lit(False)).unionByName(pooled.withColumn("pooled", F.lit(True)))
    return members.join(offers, "domain").select("pooled", "shop", *offers.columns)


def offers_for_hosts(matched: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers shown on each host, one row for each host and offer; ``shop_offers`` has them once for each shop."""
    hosts = shop_of(matched).select("host", "pooled", "shop")
    return hosts.join(shop_offers(matched, offers), ["pooled", "shop"]).select("host", *offers.columns)


def visible_offers(offers: DataFrame, hidden: DataFrame) -> DataFrame:
    """Offers whose exact code the reader did not report for that exact domain."""
    return offers.join(hidden.select("domain", "code").distinct(), ["domain", "code"], "left_anti")


def with_rate(offers: DataFrame) -> DataFrame:
    """Adds ``rate`` in percent and its class."""
    percent = rate(F.col("worked"), F.col("total"))
    return offers.withColumn("rate", percent).withColumn("rate_class", rate_class(F.col("rate")))


def best_first(ties: Iterable[Column]) -> list[Column]:
    """Order of offers: rate, then last sight, then stored order."""
    return [
        F.coalesce(rate(F.col("worked"), F.col("total")), F.lit(-1)).desc(),
        F.coalesce(F.col("last_seen"), F.timestamp_seconds(F.lit(0))).desc(),
        *ties,
    ]


def rank_offers(offers: DataFrame, ties: Sequence[str] = ("ord",), by: Sequence[str] = ("domain",)) -> DataFrame:
    """Adds ``position`` and ``size`` of every offer within its store, best first."""
    return with_position(offers, by, best_first([F.col(tie) for tie in ties]))


def trial_order(offers: DataFrame, ties: Sequence[str] = ("ord",)) -> DataFrame:
    """Order in which codes are tried, with the progress after each in percent."""
    ranked = rank_offers(offers, ties)
    return ranked.withColumn("progress", F.col("position") / F.col("size") * 100)


def best_offer(offers: DataFrame, ties: Sequence[str] = ("ord",), by: Sequence[str] = ("domain",)) -> DataFrame:
    """Best offer of every store."""
    return first_rows(offers, by, best_first([F.col(tie) for tie in ties]))


def last_verified(
    offers: DataFrame, asof: Column, ties: Sequence[str] = ("ord",), by: Sequence[str] = ("domain",)
) -> DataFrame:
    """When the best offer of a store was last confirmed, in words."""
    seen = F.coalesce(F.col("last_seen"), F.col("last_tested"))
    label = F.coalesce(age_label(seen, asof.cast("timestamp")), F.lit("unknown"))
    return best_offer(offers, ties, by).select(*by, label.alias("last_verified"))


def store_rollup(offers: DataFrame, hidden: DataFrame, by: Sequence[str] = ("domain",)) -> DataFrame:
    """Per store: offers shown and hidden, attempts, successes, overall rate and its class.

    All sums are partial in the map tasks, so a store with a third of the offers is no problem.
    """
    marks = hidden.select("domain", "code").distinct().withColumn("_hidden", F.lit(True))
    marked = offers.join(marks, ["domain", "code"], "left")
    shown = F.col("_hidden").isNull()
    sums = marked.groupBy(*by).agg(
        F.count_if(shown).alias("visible"),
        F.count_if(~shown).alias("hidden"),
        F.coalesce(F.sum(F.when(shown, F.col("total"))), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(shown, F.col("worked"))), F.lit(0)).alias("worked"),
    )
    return with_rate(sums)


def offer_cards(offers: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """What is shown of an offer, and the columns ``keep`` as they are."""
    sources = F.coalesce(F.col("sources"), F.array(F.coalesce(F.col("source"), F.lit("unknown"))))
    return with_rate(offers).select(
        "domain",
        "code",
        "rate",
        "rate_class",
        F.coalesce("description", F.lit("")).alias("description"),
        F.nullif(F.col("type"), F.lit("unknown")).alias("type"),
        "expiry",
        F.array_join(sources, " ").alias("sources"),
        *keep,
    )


def savings_totals(savings: DataFrame) -> DataFrame:
    """Sum of positive amounts, their number, and the sum in pounds."""
    amount = parse_amount(F.col("amount").cast("string"))
    kept = savings.select(amount.alias("amount")).filter(F.col("amount") > 0)
    return kept.agg(
        F.coalesce(F.sum(F.col("amount").cast("decimal(12,2)")), F.lit(0)).alias("saved"),
        F.count(F.lit(1)).alias("orders"),
    ).withColumn("label", money(F.col("saved")))


def classify_outcomes(attempts: DataFrame, **phrases: Iterable[str]) -> DataFrame:
    """Attempts with the status their page shows."""
    return attempts.withColumn("status", outcome(F.col("page_text"), **phrases))


def outcome_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("domain", "code", "status").agg(F.count(F.lit(1)).alias("n"))


def outcomes_to_tests(classified: DataFrame) -> DataFrame:
    """Attempts, successes and last attempt per offer."""
    return classified.groupBy("domain", "code").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("worked"),
        F.max("ts").alias("last_tested"),
    )


def apply_tests(registry: DataFrame, tests: DataFrame) -> DataFrame:
    """Registry with new attempts added to the stored ones."""
    new = tests.select(
        "domain",
        "code",
        F.col("total").alias("_total"),
        F.col("worked").alias("_worked"),
        F.col("last_tested").alias("_tested"),
    )
    joined = registry.join(new, ["domain", "code"], "left")
    return joined.withColumns(
        {
            "total": F.coalesce("total", F.lit(0)) + F.coalesce("_total", F.lit(0)),
            "worked": F.coalesce("worked", F.lit(0)) + F.coalesce("_worked", F.lit(0)),
            "last_tested": F.greatest("last_tested", F.col("_tested").cast("timestamp")),
        }
    ).select(*registry.columns)


def source_contribution(offers: DataFrame) -> DataFrame:
    """Per source: offers that carry it, and offers it found first."""
    own = F.coalesce(blank_to_null(F.col("source")), F.lit("unknown"))
    badges = F.when(F.size(F.col("sources")) > 0, F.col("sources")).otherwise(F.array(own))
    return (
        offers.select(F.explode(badges).alias("badge"), own.alias("own"))
        .groupBy(F.col("badge").alias("source"))
        .agg(
            F.count(F.lit(1)).alias("carried"),
            F.count_if(F.col("badge") == F.col("own")).alias("found_first"),
        )
    )
