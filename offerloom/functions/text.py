"""Text helpers that behave the same for every rule: trimming, word edges, title case, rounding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.fixed import SPACE, SPACE_CHARS

WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"


def any_of(words: Iterable[str]) -> str:
    """Regex alternation of literal words."""
    return "|".join(re.escape(word) for word in words)


def whole_word(pattern: str) -> str:
    """``pattern`` between ASCII word edges, whatever letters stand next to it."""
    return f"{WORD_START}(?:{pattern}){WORD_END}"


def trim_all(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A capture of the first match, or null."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def title_words(text: Column) -> Column:
    """Upper-case the first letter of every ASCII word, leaving the rest as it is."""
    marked = F.regexp_replace(text, f"{WORD_START}([a-z])", "\u0001$1")
    parts = F.split(marked, "\u0001")
    raised = F.transform(
        parts,
        lambda part, i: F.when(
            i > 0, F.concat(F.upper(F.substring(part, 1, 1)), F.substring(part, 2, 2**31 - 1))
        ).otherwise(part),
    )
    return F.array_join(raised, "")


def round_half_up(number: Column) -> Column:
    return F.floor(number + F.lit(0.5))


def present(value: Column) -> Column:
    """Generator that keeps rows with a value.

    A filter on a computed column is pushed below the projection and computes it again; a generator
    computes it once.
    """
    return F.explode(F.array_compact(F.array(value)))


def literal_map(table: Mapping[str, str]) -> Column:
    """A small fixed table as one map literal."""
    return F.expr(f"map({', '.join(_sql_text(item) for pair in table.items() for item in pair)})")


def literal_pairs(pairs: Iterable[tuple[str, str]]) -> Column:
    """A small fixed list as one array literal of (key, value)."""
    rows = (f"named_struct('key', {_sql_text(k)}, 'value', {_sql_text(v)})" for k, v in pairs)
    return F.expr(f"array({', '.join(rows)})")


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
