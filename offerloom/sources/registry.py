"""The registry as a published document: nested JSON, read and written. Its stored versions are in ``versions``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerloom.functions.codes import norm_code
from offerloom.functions.text import blank_to_null
from offerloom.operators.ranking import with_position
from offerloom.schemas import DOCUMENT, OFFER, ORD, STORE
from offerloom.session import durable, shuffles_dropped, stored
from offerloom.sources.versions import empty_registry, path_exists

VERSION = "1.0"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
#: Offers of one published line; a store with more goes on in further parts, on lines of their own.
CHUNK_OFFERS = 10_000


def _moment(text: Column) -> Column:
    return F.try_to_timestamp(blank_to_null(text))


def _last_seen(text: Column) -> Column:
    """A time that is written but unreadable counts as the epoch, so the offer is stale."""
    return F.when(blank_to_null(text).isNull(), F.lit(None)).otherwise(
        F.coalesce(_moment(text), F.timestamp_seconds(F.lit(0)))
    )


def read_registry(
    spark: SparkSession, path: str, pretty: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Offers and stores of a published document; a missing one is an empty registry.

    ``pretty`` reads a document that is spread over several lines.
    """
    if not path_exists(spark, path):
        return empty_registry(spark)
    documents = spark.read.schema(DOCUMENT).option("multiLine", pretty).json(path)
    documents = documents.filter("stores is not null")
    return flatten_documents(documents)


def flatten_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offers and stores of document rows, in the order they state, else in that of the arrays."""
    stores = documents.select(F.posexplode("stores").alias("nth", "domain", "store"))

    def place(stated: str, pos: Column) -> Column:
        return F.struct(
            F.coalesce(_moment(F.col(f"{stated}.run")), F.timestamp_seconds(F.lit(0))).alias("run"),
            F.coalesce(F.col(f"{stated}.sourceRank"), F.lit(0)).alias("source_rank"),
            F.coalesce(F.col(f"{stated}.page"), F.lit("")).alias("page_key"),
            F.coalesce(F.col(f"{stated}.pos"), pos.cast("long")).alias("pos"),
        )

    store_rows = (
        stores.select("domain", "store.name", "store.category", place("store.ord", F.col("nth")).alias("ord"))
        .groupBy("domain")
        .agg(F.min(F.struct("ord", "name", "category")).alias("s"))
        .select("domain", "s.name", "s.category", "s.ord")
    )
    codes = stores.select("domain", F.posexplode("store.codes").alias("pos", "c"))
    last_seen = _last_seen(F.col("c.lastSeen"))
    offers = codes.select(
        "domain",
        norm_code(F.col("c.code")).alias("norm_code"),
        "c.code",
        "c.description",
        "c.type",
        "c.value",
        F.col("c.minSpend").alias("min_spend"),
        blank_to_null(F.col("c.expiry")).try_cast("date").alias("expiry"),
        "c.source",
        "c.sources",
        "c.url",
        _moment(F.col("c.addedAt")).alias("added_at"),
        last_seen.alias("last_seen"),
        F.coalesce("c.testResults.total", F.lit(0)).alias("total"),
        F.coalesce("c.testResults.worked", F.lit(0)).alias("worked"),
        _moment(F.col("c.testResults.lastTested")).alias("last_tested"),
        place("c.ord", F.col("pos")).alias("ord"),
    )
    twins = Window.partitionBy("domain", "norm_code").orderBy("ord")
    offers = offers.withColumn("dup_no", F.row_number().over(twins) - 1)
    return offers.select(*(F.col(f.name).cast(f.dataType) for f in OFFER)), store_rows.select(*STORE.names)


# -- publication --------------------------------------------------------------------------------


def _iso(moment: str) -> Column:
    return F.date_format(moment, ISO)


def _place(ord_: str) -> Column:
    return F.struct(
        F.date_format(F.col(f"{ord_}.run"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("run"),
        F.col(f"{ord_}.source_rank").alias("sourceRank"),
        F.col(f"{ord_}.page_key").alias("page"),
        F.col(f"{ord_}.pos").alias("pos"),
    )


def _code_entry() -> Column:
    return F.struct(
        "code",
        "description",
        "type",
        "value",
        F.col("min_spend").alias("minSpend"),
        F.col("expiry").cast("string").alias("expiry"),
        "source",
        "sources",
        "url",
        _iso("added_at").alias("addedAt"),
        _iso("last_seen").alias("lastSeen"),
        F.struct("total", "worked", _iso("last_tested").alias("lastTested")).alias("testResults"),
        _place("ord").alias("ord"),
    )


def store_parts(
    offers: DataFrame, stores: DataFrame, part_offers: int = CHUNK_OFFERS, fixed: Callable[[DataFrame], DataFrame] = durable
) -> DataFrame:
    """Rows (domain, name, category, ord, part, codes): the offers of a store in order, so many in each part.

    A store of one part is gathered as it is, in one shuffle. The places of offers in a larger one come from
    ``with_position``, so it is cut by many tasks and no array grows beyond a part. Offers are read several times, so they
    are ``fixed`` first.
    """
    offers = fixed(offers)
    sizes = offers.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    # At most one row for every part of the registry.
    larger = F.broadcast(sizes.filter(F.col("n") > part_offers).select(F.col("domain").alias("_larger")))
    of_larger = F.col("domain").eqNullSafe(F.col("_larger"))
    places = [F.col(f"ord.{field.name}") for field in ORD]
    order = [F.col("ord"), F.col("norm_code"), F.col("dup_no")]
    whole = offers.join(larger, of_larger, "left_anti")
    placed = with_position(offers.join(larger, of_larger, "left_semi"), ["domain"], order, "_at", "_size", fixed)
    placed = placed.withColumn("part", F.floor((F.col("_at") - 1) / part_offers).cast("int"))

    def listed(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
        # Plain columns come first in what is sorted, as a struct inside costs an ordering of its own in every comparison.
        at = [value.alias(f"at{i}") for i, value in enumerate(order)]
        codes = F.sort_array(F.collect_list(F.struct(*at, _code_entry().alias("entry"))))
        # Entries are built behind the shuffle, as they are wider than the rows.
        return rows.repartition(*by).groupBy(*by).agg(codes.alias("codes")).join(stores.select("domain", "name", "category", "ord"), "domain", "left").select(
            "domain",
            F.coalesce("name", F.col("domain")).alias("name"),
            F.coalesce("category", F.lit("general")).alias("category"),
            "ord",
            (F.col("part") if "part" in by else F.lit(0)).alias("part"),
            F.transform("codes", lambda row: row["entry"]).alias("codes"),
        )

    in_order = [F.col("ord").isNotNull(), *places, *order[1:]]
    return listed(whole, ["domain"], in_order).unionByName(listed(placed, ["domain", "part"], [F.col("_at")]))


def _meta(asof: Column, total: Column) -> Column:
    return F.struct(
        F.date_format(asof.cast("timestamp"), ISO).alias("lastUpdated"),
        total.alias("totalCodes"),
        F.lit(VERSION).alias("version"),
        F.array().cast("array<string>").alias("sources"),
    )


def _store_entry() -> Column:
    return F.struct("name", "category", _place("ord").alias("ord"), "part", "codes")


_JSON = {"ignoreNullFields": "false"}


def document_lines(
    offers: DataFrame, stores: DataFrame, asof: Column, part_offers: int = CHUNK_OFFERS, fixed: Callable[[DataFrame], DataFrame] = durable
) -> DataFrame:
    """One JSON line per part of a store, each a small document of its own that states its places and its part."""
    parts = store_parts(offers, stores, part_offers, fixed)
    entry = F.struct("domain", _store_entry().alias("store"))
    return parts.select(
        F.to_json(
            F.struct(
                _meta(asof, F.size("codes").cast("long")).alias("meta"),
                F.map_from_entries(F.array(entry)).alias("stores"),
            ),
            _JSON,
        ).alias("value")
    )


def single_document(
    offers: DataFrame, stores: DataFrame, asof: Column, part_offers: int = CHUNK_OFFERS, fixed: Callable[[DataFrame], DataFrame] = durable
) -> DataFrame:
    """The whole registry as the lines of one JSON document, sorted: a head, the parts of each store, a foot.

    Nothing is gathered: the parts of a store follow each other inside its one array.
    """
    parts = store_parts(offers, stores, part_offers, fixed)
    of_store = Window.partitionBy("domain")
    parts = parts.withColumn("last", F.max("part").over(of_store))
    ends = parts.agg(
        F.coalesce(F.sum(F.size("codes")), F.lit(0)).cast("long").alias("n"), F.min(F.struct("ord", "domain")).alias("first")
    )
    body = F.to_json("codes", _JSON)
    body = F.substring(body, 2, F.length(body) - 2)
    head = F.to_json(F.struct("name", "category", _place("ord").alias("ord")), _JSON)
    opening = F.concat(
        F.when(F.struct("ord", "domain").eqNullSafe(F.col("first")), F.lit("")).otherwise(F.lit(",")),
        _quoted("domain"), F.lit(":"), F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"codes":['),
    )
    text = F.concat(
        F.when(F.col("part") == 0, opening).otherwise(F.lit(",")),
        body,
        F.when(F.col("part") == F.col("last"), F.lit("]}")).otherwise(F.lit("")),
    )
    # ``ends`` is a single row.
    lines = parts.crossJoin(F.broadcast(ends)).select(F.lit(1).alias("k"), "ord", "domain", "part", text.alias("value"))
    meta = F.to_json(F.struct(_meta(asof, F.col("n")).alias("meta")), _JSON)
    rim = ends.select(
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("k"), F.concat(F.substring(meta, F.lit(1), F.length(meta) - 1), F.lit(',"stores":{')).alias("value")),
                F.struct(F.lit(2).alias("k"), F.lit("}}").alias("value")),
            )
        )
    )
    return lines.unionByName(rim, allowMissingColumns=True).orderBy("k", "ord", "domain", "part").select("value")


def _quoted(text: str) -> Column:
    """A string as JSON writes it."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def export_registry_json(
    offers: DataFrame, stores: DataFrame, path: str, asof: Column, single: bool = False, append: bool = False
) -> None:
    """Publish the registry: JSON lines by part of a store (gzip), or one document in one file.

    The file of a document is written by one task, line by line as the sorted lines come in. With ``append``, the lines of
    whole stores join those that are published, so a registry can be published slice by slice (``merge.in_slice``).
    What is written in between, and its shuffle files, go when the lines are there.
    """
    spark, between = offers.sparkSession, []

    def fixed(rows: DataFrame) -> DataFrame:
        between.append(stored(rows, "publishing"))
        return between[-1].rows

    try:
        with shuffles_dropped(spark):
            if single:
                single_document(offers, stores, asof, fixed=fixed).coalesce(1).write.mode("overwrite").text(path)
            else:
                lines = document_lines(offers, stores, asof, fixed=fixed)
                lines.write.mode("append" if append else "overwrite").option("compression", "gzip").text(path)
    finally:
        for each in between:
            each.drop()
