"""Rules on codes: normal form, validity, candidate tokens, codes inside feed entries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.fixed import (
    COMMON_WORDS,
    EXTRA_STOP_PREFIXES,
    FEED_COMMON_WORDS,
    SPACE_SET,
    STOP_PREFIXES,
)
from offerloom.functions.text import any_of, let, trim_all, whole_word

TOKEN = whole_word("[A-Z0-9]{3,20}")
YEAR = r"^20\d{2}\z"

LABELLED_CODE = rf"(?i)(?:code|voucher|promo)[:{SPACE_SET}]+([A-Z0-9]{{3,30}})"
STANDALONE_CODE = f"({whole_word('[A-Z0-9]{5,20}')})"
QUOTED_CODE = r"""(?i)["']([A-Z0-9]{3,30})["']"""


def norm_code(code: Column) -> Column:
    """Upper case without white space, hyphens and underscores; no code gives ''."""
    return F.coalesce(F.regexp_replace(F.upper(code), rf"[{SPACE_SET}\-_]+", ""), F.lit(""))


def is_valid_code(code: Column, common_words: Iterable[str] = COMMON_WORDS) -> Column:
    """3 to 30 characters, a letter, and a digit or at least 6 capitals; no common word, no year.

    Tests that white space around the code cannot change come first and spare most words the trim.
    """
    word = trim_all(code)
    has_digit = code.rlike("[0-9]")
    verdict = (
        ((code == F.upper(code)) | has_digit)
        & code.rlike("[A-Za-z]")
        & F.length(word).between(3, 30)
        & (has_digit | (F.length(word) >= 6))
        & ~F.upper(word).isin(*common_words)
    )
    return F.coalesce(verdict, F.lit(False))


def stop_prefixes(source: str | None) -> tuple[str, ...]:
    return STOP_PREFIXES + EXTRA_STOP_PREFIXES.get(source or "", ())


def is_candidate_token(token: Column, source: Column | str | None = None) -> Column:
    """A card token that may be a code: not opening with a stop word, even inside a longer word.

    ``source`` adds the stop words of a source; as a column it picks them row by row.
    """

    def opens_with(prefixes: Iterable[str]) -> Column:
        return token.rlike(f"^(?:{any_of(prefixes)})")

    usable = (
        token.rlike("[A-Z]")
        & (token.rlike("[0-9]") | (F.length(token) >= 6))
        & ~opens_with(STOP_PREFIXES)
        & ~token.rlike(YEAR)
    )
    if source is None:
        return usable
    if isinstance(source, str):
        extra = EXTRA_STOP_PREFIXES.get(source)
        return usable & ~opens_with(extra) if extra else usable
    for extra in dict.fromkeys(EXTRA_STOP_PREFIXES.values()):
        named = [name for name, words in EXTRA_STOP_PREFIXES.items() if words == extra]
        usable = usable & ~(source.isin(*named) & opens_with(extra))
    return usable


def candidate_tokens(text: Column, source: Column | str | None = None) -> Column:
    """Every candidate token of a text, in order."""
    tokens = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(tokens, lambda token: is_candidate_token(token, source))


def first_candidate_token(text: Column, source: Column | str | None = None) -> Column:
    return F.get(candidate_tokens(text, source), F.lit(0))


def feed_code(title: Column, description: Column) -> Column:
    """Labelled code, else standalone token, else quoted token; only first matches count."""
    def rare(word: Column) -> Column:
        return (word != "") & ~F.upper(word).isin(*FEED_COMMON_WORDS)

    def accepted(word: Column) -> Column:
        return F.when(rare(word), word)

    def accepted_alone(word: Column) -> Column:
        return F.when((word.rlike("[0-9]") | (F.length(word) >= 6)) & rare(word), word)

    def search(text: Column) -> Column:
        return F.coalesce(
            let(F.regexp_extract(text, LABELLED_CODE, 1), accepted),
            let(F.regexp_extract(text, STANDALONE_CODE, 1), accepted_alone),
            let(F.regexp_extract(text, QUOTED_CODE, 1), accepted),
        )

    return let(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))), search)
