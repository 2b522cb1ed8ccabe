"""Rules on ratings: success rate and its class, age label, outcome of an attempt."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.fixed import FAILURE_PHRASES, SUCCESS_PHRASES
from offerloom.functions.text import any_of, round_half_up


def rate(worked: Column, total: Column) -> Column:
    """Whole percent of attempts that worked; null without attempts."""
    share = F.lit(100.0) * F.coalesce(worked, F.lit(0)) / F.nullif(total, F.lit(0))
    return round_half_up(share).cast("long")


def rate_class(percent: Column) -> Column:
    return (
        F.when(percent >= 70, F.lit("green"))
        .when(percent >= 40, F.lit("yellow"))
        .when(percent.isNotNull(), F.lit("red"))
        .otherwise(F.lit(""))
    )


def age_label(moment: Column, asof: Column) -> Column:
    """'today', '1 day ago', 'n days ago'; null for a missing moment."""
    micros = F.unix_micros(asof) - F.unix_micros(moment)
    days = F.floor(micros / F.lit(86_400_000_000))
    return (
        F.when(days < 1, F.lit("today"))
        .when(days == 1, F.lit("1 day ago"))
        .when(days.isNotNull(), F.concat(days.cast("string"), F.lit(" days ago")))
    )


def outcome(
    page_text: Column,
    success: Iterable[str] = SUCCESS_PHRASES,
    failure: Iterable[str] = FAILURE_PHRASES,
) -> Column:
    """Result an attempt shows on the page; success wording wins."""
    text = F.lower(page_text)
    return (
        F.when(text.rlike(any_of(success)), F.lit("success"))
        .when(text.rlike(any_of(failure)), F.lit("failure"))
        .otherwise(F.lit("unknown"))
    )
