"""Text containment as an equality join.

"A contains B" needs A to hold B's first characters somewhere.  So every needle stands under its first
``GRAM`` characters (all of it, when it is shorter) and every haystack under its pieces of up to that
length: the number of rows grows with the length of the texts, not with its square, and the test itself
runs on the pairs that meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 6


def first_gram(needle: Column) -> Column:
    return F.substring(needle, 1, GRAM)


def grams(haystack: Column) -> Column:
    """Every distinct piece of at most ``GRAM`` characters, the empty one included."""
    size = F.length(haystack)
    none = F.array().cast("array<string>")

    def of_length(k: int) -> Column:
        starts = F.sequence(F.lit(1), size - (k - 1))
        return F.when(size >= k, F.transform(starts, lambda at: F.substring(haystack, at, k))).otherwise(none)

    return F.array_distinct(F.concat(F.array(F.lit("")), *(of_length(k) for k in range(1, GRAM + 1))))


def join_containing(
    haystacks: DataFrame, haystack: str, needles: DataFrame, needle: str, also: Sequence[str] = ()
) -> DataFrame:
    """Pairs of rows where ``haystack`` contains ``needle``, and the columns ``also`` are equal.

    A text that many rows share is taken apart once, and only pieces that some needle opens with go on to the rows.
    Pieces are many more than the size of the stored texts tells, so no side may be broadcast by that estimate.
    """
    right = needles.withColumn("_gram", first_gram(F.col(needle)))
    pieces = haystacks.select(haystack).distinct().withColumn("_gram", F.explode(grams(F.col(haystack))))
    pieces = pieces.hint("merge").join(right.select("_gram").distinct().hint("merge"), "_gram", "left_semi")
    left = haystacks.hint("merge").join(pieces.hint("merge"), haystack)
    met = left.hint("merge").join(right.hint("merge"), ["_gram", *also])
    return met.filter(F.contains(haystack, F.col(needle))).drop("_gram")
