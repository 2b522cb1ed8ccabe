"""A table made of written parts, and pointer files that say which: whoever reads finds a whole table at any moment.

Below a path lie ``parts`` and ``pointers/<number>.json``. A change writes new parts first and the next pointer last;
what the pointers before named is deleted afterwards. One writer at a time; a second one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from offerloom.sources.versions import file_system, names_in, read_small, write_small


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name[:-5]) for name in names_in(spark, f"{path}/pointers") if name.endswith(".json") and name[0] != ".")


def _pointer(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(read_small(spark, f"{path}/pointers/{number:08d}.json"))


def current(spark: SparkSession, path: str) -> dict:
    """The newest pointer: ``number``, ``parts`` and whatever else it was given; number 0 without parts where there is none."""
    numbers = _numbers(spark, path)
    return _pointer(spark, path, numbers[-1]) if numbers else {"number": 0, "parts": []}


def write_part(rows: DataFrame, path: str, by: str | None = None) -> str:
    """Write rows as a part, with a folder for each value of ``by``; it belongs to the table once a pointer names it."""
    part = f"parts/{uuid.uuid4().hex}"
    if by is None:
        rows.write.parquet(f"{path}/{part}")
    else:
        rows.repartition(by).write.partitionBy(by).parquet(f"{path}/{part}")
    return part


def point(spark: SparkSession, path: str, before: dict, parts: list[str], **facts) -> dict:
    """Write the pointer after ``before``."""
    after = {"number": before["number"] + 1, "parts": parts, **facts}
    write_small(spark, f"{path}/pointers/{after['number']:08d}.json", json.dumps(after))
    return after


def read_parts(spark: SparkSession, path: str, schema: T.StructType, pointer: dict | None = None) -> DataFrame:
    """Rows of the newest pointer's parts, or of those of the one given."""
    parts = (pointer or current(spark, path))["parts"]
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{part}" for part in parts))


def clear(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete the parts that only pointers before the newest ``keep`` name, then those pointers.

    A deletion that breaks off is taken up by the next one, as the pointer that names a part goes last.
    """
    numbers = _numbers(spark, path)
    held = {part for n in numbers[-keep:] for part in _pointer(spark, path, n)["parts"]}
    system, root, jvm = file_system(spark, path)
    for number in numbers[:-keep]:
        for part in set(_pointer(spark, path, number)["parts"]) - held:
            system.delete(jvm.org.apache.hadoop.fs.Path(root, part), True)
        system.delete(jvm.org.apache.hadoop.fs.Path(root, f"pointers/{number:08d}.json"), False)
