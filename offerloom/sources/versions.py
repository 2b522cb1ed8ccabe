"""Versions of the stored registry: a manifest for each, over hash buckets of Parquet files that versions share.

Below a base lie ``versions/<number>.json`` (manifests), and ``offers`` and ``stores`` with a folder for every write,
parted into ``bucket=<n>``. A manifest names the folder of each bucket. A change writes the buckets it touches anew and
takes the others over, so its cost follows the change and not the registry; a version, once written, is never altered.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.schemas import OFFER, STORE
from offerloom.session import shuffles_dropped

#: Buckets of a registry that is written for the first time; choose so that a bucket is a few hundred MB (large ones are several files).
BUCKETS = 32
#: Versions that stay when streams and runs write new ones.
KEEP = 20

_SCHEMAS = {"offers": OFFER, "stores": STORE}
_KEYS = {"offers": ("domain", "norm_code"), "stores": ("domain",)}


@dataclasses.dataclass(frozen=True)
class Manifest:
    """One version: the folder (below the base) and the rows of each bucket that has any, and each stream's last batch."""

    number: int
    buckets: int
    offers: dict[int, tuple[str, int]] = dataclasses.field(default_factory=dict)
    stores: dict[int, tuple[str, int]] = dataclasses.field(default_factory=dict)
    streams: dict[str, int] = dataclasses.field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @staticmethod
    def parse(text: str) -> Manifest:
        given = json.loads(text)
        for kind in _SCHEMAS:
            given[kind] = {int(bucket): (folder, rows) for bucket, (folder, rows) in given[kind].items()}
        return Manifest(**given)

    def folders(self) -> set[str]:
        return {folder for kind in _SCHEMAS for folder, _ in getattr(self, kind).values()}


def empty_registry(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], OFFER), spark.createDataFrame([], STORE)


# -- files --------------------------------------------------------------------------------------


def file_system(spark: SparkSession, path: str):
    """The file system of a path, the path as Hadoop knows it, and the JVM."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop, jvm


def path_exists(spark: SparkSession, path: str) -> bool:
    system, hadoop, _ = file_system(spark, path)
    return system.exists(hadoop)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    system, hadoop, _ = file_system(spark, path)
    return [status.getPath().getName() for status in system.listStatus(hadoop)] if system.exists(hadoop) else []


def read_small(spark: SparkSession, path: str) -> str:
    """A small text file, read by the driver without a job."""
    system, hadoop, jvm = file_system(spark, path)
    stream = system.open(hadoop)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that is there whole or not at all; one of that name is not replaced."""
    system, hadoop, jvm = file_system(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(hadoop.getParent(), f".{hadoop.getName()}-{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if system.exists(hadoop) or not system.rename(draft, hadoop):
        system.delete(draft, False)
        raise FileExistsError(f"{path} was written by another run")


# -- manifests ----------------------------------------------------------------------------------


def snapshots(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the versions below ``base``, oldest first."""
    names = names_in(spark, f"{base}/versions")
    return sorted(int(name[:-5]) for name in names if name.endswith(".json") and not name.startswith("."))


def manifest(spark: SparkSession, base: str, number: int) -> Manifest:
    return Manifest.parse(read_small(spark, f"{base}/versions/{number:08d}.json"))


def newest(spark: SparkSession, base: str, below: int | None = None) -> Manifest | None:
    """The newest version, or the newest one numbered under ``below``: one listing and one small file, whatever the number of versions."""
    numbers = [n for n in snapshots(spark, base) if below is None or n < below]
    return manifest(spark, base, numbers[-1]) if numbers else None


# -- buckets ------------------------------------------------------------------------------------


def bucket_of(kind: str, buckets: int) -> Column:
    """The bucket of a row of offers (by domain and normal code) or of stores (by domain)."""
    return F.pmod(F.xxhash64(*_KEYS[kind]), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, kind: str, buckets: int) -> set[int]:
    """The buckets that rows with the key columns of ``kind`` belong to."""
    return {row[0] for row in rows.select(bucket_of(kind, buckets)).distinct().collect()}


def read_buckets(spark: SparkSession, base: str, version: Manifest | None, kind: str, wanted: Iterable[int] | None = None) -> DataFrame:
    """Rows of a version, of all buckets or only of the ones ``wanted``."""
    held = getattr(version, kind) if version else {}
    folders = [f"{base}/{held[b][0]}" for b in sorted(held if wanted is None else set(wanted) & held.keys())]
    if not folders:
        return spark.createDataFrame([], _SCHEMAS[kind])
    return spark.read.schema(_SCHEMAS[kind]).parquet(*folders)


def _written(
    spark: SparkSession, parts: DataFrame | Iterable[DataFrame], base: str, kind: str, number: int, buckets: int
) -> dict[int, tuple[str, int]]:
    """Writes rows, part after part, by bucket into a folder of their own; what the manifest says of them."""
    folder = f"{kind}/v={number}-{uuid.uuid4().hex}"
    for rows in [parts] if isinstance(parts, DataFrame) else parts:
        rows = rows.select(*_SCHEMAS[kind].names, bucket_of(kind, buckets).alias("bucket"))
        # Rebalancing parts a large bucket among tasks, which a shuffle by bucket would leave to one task each.
        rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *_KEYS[kind])
        with shuffles_dropped(spark):
            rows.write.mode("append").partitionBy("bucket").parquet(f"{base}/{folder}")
    if not any(name.startswith("bucket=") for name in names_in(spark, f"{base}/{folder}")):
        return {}
    # Footers hold the numbers of rows, so no column is read for them.
    counts = spark.read.schema("bucket int").parquet(f"{base}/{folder}").groupBy("bucket").count().collect()
    return {row["bucket"]: (f"{folder}/bucket={row['bucket']}", row["count"]) for row in counts}


def write_changes(
    spark: SparkSession,
    base: str,
    before: Manifest | None,
    offers: tuple[DataFrame | Iterable[DataFrame], set[int]] | None = None,
    stores: tuple[DataFrame | Iterable[DataFrame], set[int]] | None = None,
    stream: tuple[str, int] | None = None,
    keep: int | None = KEEP,
    buckets: int | None = None,
) -> Manifest:
    """The version after ``before``, in which the given buckets hold the given rows and all others are taken over.

    Rows may come in several parts, which are written one after the other, each with its shuffle files alone on the disk.
    ``stream`` names a stream and its batch; it stands in the manifest from then on, so a batch that comes again is told
    without looking at older versions. Readers see the version once its manifest is there. Of two writers at once, the
    second fails. ``keep`` drops all but the newest so many versions afterwards (None: none).
    """
    number = before.number + 1 if before else 1
    size = before.buckets if before else buckets or BUCKETS
    parts = {}
    for kind, change in (("offers", offers), ("stores", stores)):
        held = dict(getattr(before, kind)) if before else {}
        if change is not None and change[1]:
            rows, hit = change
            held = {b: x for b, x in held.items() if b not in hit} | _written(spark, rows, base, kind, number, size)
        parts[kind] = held
    streams = (before.streams if before else {}) | ({stream[0]: stream[1]} if stream else {})
    after = Manifest(number, size, **parts, streams=streams)
    write_small(spark, f"{base}/versions/{number:08d}.json", after.text())
    if keep is not None:
        drop_snapshots(spark, base, keep)
    return after


def write_registry_table(
    offers: DataFrame | Sequence[DataFrame],
    stores: DataFrame | Sequence[DataFrame],
    base: str,
    number: int | None = None,
    keep: int | None = None,
    buckets: int | None = None,
) -> int:
    """Write a whole registry, or its parts one after the other, as the next version (or one of a higher number); every bucket is new.

    Offers lie in hash buckets of (domain, code), so nothing is sampled and the catch-all domain of unresolved stores
    spreads over all files. By default every version stays.
    """
    spark = (offers if isinstance(offers, DataFrame) else offers[0]).sparkSession
    last = newest(spark, base)
    if number is None:
        number = last.number + 1 if last else 1
    size = buckets or (last.buckets if last else BUCKETS)
    # A version without buckets comes before, so nothing is taken over but the streams.
    before = Manifest(number - 1, size, streams=last.streams if last else {})
    whole = set(range(size))
    return write_changes(spark, base, before, (offers, whole), (stores, whole), keep=keep).number


def read_registry_table(spark: SparkSession, base: str, below: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Newest version, or the newest one numbered under ``below``; an empty registry where there is none."""
    version = newest(spark, base, below)
    return read_buckets(spark, base, version, "offers"), read_buckets(spark, base, version, "stores")


def drop_snapshots(spark: SparkSession, base: str, keep: int) -> None:
    """Delete all but the newest ``keep`` versions, and the buckets that none of those holds.

    Buckets go before the manifest that names them, so a deletion that breaks off is taken up again by the next one.
    """
    numbers = snapshots(spark, base)
    old, kept = numbers[: -max(1, keep)], numbers[-max(1, keep) :]
    if not old:
        return
    system, root, jvm = file_system(spark, base)
    path = jvm.org.apache.hadoop.fs.Path
    # Every folder a dropped version shares with a kept one is also held by the oldest that is kept.
    used = manifest(spark, base, kept[0]).folders()
    for number in old:
        gone = manifest(spark, base, number).folders() - used
        for folder in gone:
            system.delete(path(root, folder), True)
        for parent in {folder.rpartition("/")[0] for folder in gone}:
            if not any(name.startswith("bucket=") for name in names_in(spark, f"{base}/{parent}")):
                system.delete(path(root, parent), True)
        system.delete(path(root, f"versions/{number:08d}.json"), False)
