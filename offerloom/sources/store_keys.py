"""An index of store keys by their pieces, kept beside the registry: a host lookup reads only the buckets it needs.

Below ``<base>/keys`` lies a pointer table whose parts are written by bucket of the piece. New stores are added as a part;
stores that went stay in it until it is rebuilt, as a lookup checks what it finds against the stores anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.operators.contains import first_gram, grams
from offerloom.sources import pointers

#: Buckets of an index, and parts after which it is rebuilt as one.
KEY_BUCKETS, MOST_PARTS = 256, 20

ROWS = "gram string, opens boolean, base string, domain string, bucket int"


def key_base(domain: Column) -> Column:
    """A store's key as it is looked for: without ``.co.uk`` at its end, and without dots."""
    return F.replace(F.regexp_replace(domain, r"\.co\.uk\z", ""), F.lit("."), F.lit(""))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(KEY_BUCKETS)).cast("int")


def _key_rows(stores: DataFrame) -> DataFrame:
    """(gram, opens, base, domain, bucket): every piece of up to six characters of each key; ``opens`` where the key begins with it.

    The empty piece is left out, but for an empty key.
    """
    based = stores.select("domain", key_base(F.col("domain")).alias("base"))
    pieces = based.select(F.explode(grams(F.col("base"))).alias("gram"), "base", "domain")
    pieces = pieces.filter((F.col("gram") != "") | (F.col("base") == ""))
    return pieces.withColumns({"opens": F.col("gram") == first_gram(F.col("base")), "bucket": _bucket()}).select("gram", "opens", "base", "domain", "bucket")


def add_store_keys(spark: SparkSession, base: str, stores: DataFrame) -> None:
    """Add the keys of new stores to the index."""
    path = f"{base}/keys"
    before = pointers.current(spark, path)
    part = pointers.write_part(_key_rows(stores), path, "bucket")
    pointers.point(spark, path, before, [*before["parts"], part])


def rebuild_store_keys(spark: SparkSession, base: str, stores: DataFrame) -> None:
    """Write the whole index anew, of the stores there are now."""
    path = f"{base}/keys"
    before = pointers.current(spark, path)
    pointers.point(spark, path, before, [pointers.write_part(_key_rows(stores), path, "bucket")])
    pointers.clear(spark, path, keep=2)


def follow_stores(spark: SparkSession, base: str, before: DataFrame, added: DataFrame) -> None:
    """Keep the index of a registry that has one in step with a run: ``added`` stores join those there were ``before``.

    Done before the version is there, so no reader misses a key; keys of a run that fails then lead to no store.
    """
    parts = pointers.current(spark, f"{base}/keys")["parts"]
    if len(parts) >= MOST_PARTS:
        rebuild_store_keys(spark, base, before.select("domain").unionByName(added.select("domain")))
    elif parts:
        add_store_keys(spark, base, added)


def _read(spark: SparkSession, base: str, parts: list[str]) -> DataFrame:
    folders = [f"{base}/keys/{part}" for part in parts]
    rows = spark.createDataFrame([], ROWS)
    for folder in folders:  # a part at a time, as each has bucket folders of its own; a handful
        rows = rows.unionByName(spark.read.schema(ROWS).parquet(folder))
    return rows


class StoreKeys:
    """The index below a base as it is now."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.parts = pointers.current(spark, f"{base}/keys")["parts"]

    def rows(self, wanted: DataFrame) -> DataFrame:
        """Index rows of the buckets that hold a piece of ``wanted`` (gram); no other bucket is read."""
        buckets = [row[0] for row in wanted.select(_bucket()).distinct().collect()]  # at most 256
        return _read(self.spark, self.base, self.parts).filter(F.col("bucket").isin(buckets))

    def containing(self, names: DataFrame) -> DataFrame:
        """(host, domain) where the key lies inside a name of the host, or the host's shortest name inside the key.

        ``names``: (host, name, short). What is found may have gone since; join it to the stores.
        """
        pieces = names.select("host", "name", F.explode(grams(F.col("name"))).alias("gram")).filter("gram <> '' OR name = ''")
        whole = names.filter("short").select("host", "name", first_gram(F.col("name")).alias("gram"))
        found = self.rows(pieces.select("gram").union(whole.select("gram")))
        inside = pieces.join(found.filter("opens"), "gram").filter(F.contains("name", F.col("base")))
        around = whole.join(found, "gram").filter(F.contains("base", F.col("name")))
        return inside.select("host", "domain").union(around.select("host", "domain")).distinct()
