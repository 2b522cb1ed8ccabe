"""Rules on descriptions: kind of offer, clean-up, amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom import fixed
from offerloom.functions.text import any_of, collapse_space, let, trim_all

DESCRIPTION_CHARS = 200
LONGEST_NOISE = max(map(len, fixed.NOISE_OPENINGS))


def offer_type(text: Column, extra_discount: bool = False) -> Column:
    """First kind whose wording occurs; ``extra_discount`` swaps the last kind.

    Each pattern is tried only on texts that hold its telling word, which is a plain byte search.
    """
    kinds = fixed.OFFER_KINDS[:-1] + (fixed.EXTRA_KIND,) if extra_discount else fixed.OFFER_KINDS
    lowered = F.lower(F.coalesce(text, F.lit("")))
    verdict = F
    for kind, telling, pattern in kinds:
        verdict = verdict.when(F.contains(lowered, F.lit(telling)) & lowered.rlike(pattern), F.lit(kind))
    return verdict.otherwise(F.lit("unknown"))


def plain_text(text: Column) -> Column:
    """Text without CDATA marks and tags, white space collapsed."""

    def without_tags(raw: Column) -> Column:
        unmarked = F.replace(F.regexp_replace(raw, r"(?i)<!\[CDATA\[", ""), F.lit("]]>"), F.lit(""))
        return F.when(F.contains(raw, F.lit("<")), F.regexp_replace(unmarked, "<[^>]+>", "")).otherwise(
            F.replace(raw, F.lit("]]>"), F.lit(""))
        )

    return trim_all(collapse_space(let(F.coalesce(text, F.lit("")), without_tags)))


def clean_description(text: Column, intended: bool = False) -> Column:
    """Plain one-line description, '' for noise.

    The cut at the last space up to character 200 also takes the last word of a shorter text; that
    is the rule as it stands.  ``intended`` cuts longer texts only.
    """

    def cleaned(plain: Column) -> Column:
        head = F.substring(plain, 1, DESCRIPTION_CHARS + 1)
        last_space = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
        cut = F.left(plain, F.when(last_space > 0, last_space).otherwise(F.lit(DESCRIPTION_CHARS)))
        if intended:
            cut = F.when(F.length(plain) <= DESCRIPTION_CHARS, plain).otherwise(cut)
        noise = F.substring(plain, 1, LONGEST_NOISE).rlike(f"(?i)^(?:{any_of(fixed.NOISE_OPENINGS)})")
        return F.when((F.length(plain) < 5) | noise, F.lit("")).otherwise(cut)

    return let(plain_text(text), cleaned)


def feed_description(title: Column) -> Column:
    """Title without its code label and without what follows the first dash or bar."""
    text = F.regexp_replace(title, rf"(?i)^(?:CODE|Voucher|Promo)[:{fixed.SPACE_SET}]+", "")
    text = F.regexp_replace(text, rf"{fixed.SPACE}*[-–|]{fixed.NOT_NEWLINE}*\z", "")
    return F.left(trim_all(text), F.lit(DESCRIPTION_CHARS))


def _number(text: Column, pattern: str, sign: str | None = None) -> Column:
    """First captured number of a text; no match gives '', which casts to null.

    ``sign`` is a character that every match holds: texts without it are not searched.
    """
    found = F.regexp_extract(text, pattern, 1).try_cast("double")
    return found if sign is None else F.when(F.contains(text, F.lit(sign)), found)


def offer_value(description: Column, kind: Column, intended: bool = False) -> Column:
    """Percent or pounds named by a description; whole percents only unless ``intended``."""
    percent = fixed.PERCENT_OFF_DECIMAL if intended else fixed.PERCENT_OFF
    return (
        F.when(kind == "percentage", _number(description, percent, "%"))
        .when(kind == "fixed", _number(description, fixed.POUNDS, "£"))
    )


def min_spend(description: Column) -> Column:
    return _number(description, fixed.MIN_SPEND, "£")


def money(amount: Column) -> Column:
    """Pounds with two decimals."""
    return F.concat(F.lit("£"), amount.cast("decimal(38,2)").cast("string"))


def parse_amount(text: Column) -> Column:
    """Leading number of a text as a decimal amount, or null."""
    return _number(text, rf"^{fixed.SPACE}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
