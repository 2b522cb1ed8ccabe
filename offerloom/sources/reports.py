"""User reports and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.fixed import NOT_NEWLINE
from offerloom.functions.text import trim_all
from offerloom.operators.dedupe import first_rows
from offerloom.schemas import RUN
from offerloom.sources import pointers

REPORT_TITLE = rf"Code failed: ({NOT_NEWLINE}+?) @ ({NOT_NEWLINE}+)"
RUNS_KEPT = 100


def parse_reports(titles: DataFrame, limit: int | None = None) -> DataFrame:
    """Reports (report_id, code, store_domain) of titles that follow the wording.

    ``limit`` keeps the newest open ones, as a run does that reads a single result page.
    """
    if limit is not None:
        titles = titles.orderBy(F.col("report_id").desc()).limit(limit)
    title = F.col("title")
    return titles.filter(title.rlike(REPORT_TITLE)).select(
        "report_id",
        trim_all(F.regexp_extract(title, REPORT_TITLE, 1)).alias("code"),
        trim_all(F.regexp_extract(title, REPORT_TITLE, 2)).alias("store_domain"),
    )


def read_reports(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """All stored reports; with ``limit``, the newest ones only."""
    return parse_reports(spark.read.parquet(path).select("report_id", "title"), limit)


def append_run_log(runs: DataFrame, path: str) -> None:
    """Append run rows to the log."""
    spark = runs.sparkSession
    before = pointers.current(spark, path)
    part = pointers.write_part(runs.select(*(F.col(f.name).cast(f.dataType) for f in RUN)), path)
    pointers.point(spark, path, before, [*before["parts"], part])


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """All run rows of the log; none where there is no log."""
    return pointers.read_parts(spark, path, RUN)


def trim_run_log(spark: SparkSession, path: str, keep: int = RUNS_KEPT) -> None:
    """Leave the newest ``keep`` runs in the stored log.

    They are written beside the others and become the log in one step; only then the others are deleted. Cut off
    anywhere, the log is the old one or the new one.
    """
    before = pointers.current(spark, path)
    part = pointers.write_part(last_runs(pointers.read_parts(spark, path, RUN, before), keep), path)
    pointers.point(spark, path, before, [part])
    pointers.clear(spark, path)


def last_runs(runs: DataFrame, keep: int = RUNS_KEPT, ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest ``keep`` runs."""
    order = [F.col("timestamp").desc(), *(F.col(tie).desc() for tie in ties)]
    return runs.orderBy(*order).limit(keep)


def last_runs_per_source(runs: DataFrame, keep: int = RUNS_KEPT, ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest ``keep`` runs of every source."""
    order = [F.col("timestamp").desc(), *(F.col(tie).desc() for tie in ties)]
    return first_rows(runs, ["source"], order, keep)
