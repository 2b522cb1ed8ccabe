"""Line dedup by an exact set-similarity join, in DataFrame functions only."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.arrow import documents, stored

#: Lines match if the sets of their words have at least this Jaccard similarity (in hundredths).
SIMILARITY = 80

#: Bytes that part words; all but the space are first made spaces, so that one plain character parts them.
OTHER_SEPARATORS = "\t\x0b\x0c\r"

#: Words are counted in so many groups of hashes (2 to the power); the counts order the words of a line.
RARITY_BITS = 16

#: Counts are told apart by so many steps of their logarithm; one small number for each group goes to each task.
RARITY_STEPS = 127

#: Lines of more words also have 256 bits, as 64 do not tell sets of so many words apart.
WIDE_WORDS = 96

#: Bits of the table that says which lines to look at again; a full table lets every line through.
MARK_BITS = 22

PLACE = ("doc_id", "line_no")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line) of every line."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _table(values: list[int]) -> Column:
    """A constant array, folded to one literal (an array of literals would be one expression for each)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _split(line: str) -> Column:
    """Words with repeats; some may be empty."""
    odd = functools.reduce(Column.__or__, (F.col(line).contains(c) for c in OTHER_SEPARATORS))
    spaced = F.when(odd, F.translate(line, OTHER_SEPARATORS, " " * len(OTHER_SEPARATORS))).otherwise(F.col(line))
    return F.split(spaced, " ")


def _hashes(line: str) -> Column:
    """The set of words, each as its 64-bit hash; sets of numbers are made far faster than sets of strings."""
    hashes = F.transform(_split(line), lambda w: F.xxhash64(w))
    return F.array_distinct(F.array_remove(hashes, F.xxhash64(F.lit(""))))


def _group(hash_: Column, bits: int = RARITY_BITS) -> Column:
    return F.shiftrightunsigned(hash_, 64 - bits).cast("int")


def word_ranks(lines: DataFrame) -> list[int]:
    """For each group of word hashes a step (0 to 127) by how often its words occur, rarest first.

    Small numbers, as Java holds one object for each of them: a table of large ones would be 65,536 objects in each task.
    """
    words = lines.select(F.explode(_split("line")).alias("w"))
    counts = words.groupBy(_group(F.xxhash64("w")).alias("g")).agg(F.count("*").alias("n")).collect()
    most = max((row["n"] for row in counts), default=1)
    ranks = [0] * (1 << RARITY_BITS)
    for row in counts:
        ranks[row["g"]] = round(RARITY_STEPS * math.log(row["n"]) / math.log(most + 1))
    return ranks


def _codes(ranks: list[int]) -> Column:
    """The words' codes in one order for all lines, rarest first: step of the group, then 25 bits of the hash.

    Words may share a code. They then stand at the same place in the order, so sets that share a word still share its
    code where they would share the word; a pair too many is told by its words later.
    """
    table, bits = _table(ranks), len(ranks).bit_length() - 1

    def code(h: Column) -> Column:
        # As little as can be, since it is interpreted for every word; and no nulls, so that plain numbers are sorted.
        step = F.coalesce(F.get(table, _group(h, bits)), F.lit(0).cast("long"))
        return F.shiftleft(step, 25).bitwiseOR(h.bitwiseAND(F.lit((1 << 25) - 1)))

    return F.sort_array(F.transform("hashes", code))


def _flipped(bits: Column, h: Column) -> Column:
    return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))


def _parities() -> Column:
    """64 bits of which each word turns one: sets whose bits differ in k places differ in k words at least."""
    return F.aggregate("hashes", F.lit(0).cast("long"), _flipped)


def _wide() -> Column:
    """The same in 256 bits, as four numbers; joined by XOR they are the 64 bits."""

    def quarter(j: int) -> Column:
        own = F.filter("hashes", lambda h: h.bitwiseAND(F.lit(3 << 6)) == F.lit(j << 6))
        return F.aggregate(own, F.lit(0).cast("long"), _flipped)

    return F.array(*(quarter(j) for j in range(4)))


def needed(a: Column, b: Column) -> Column:
    """Fewest common words of sets of a and b words that match: t / (1 + t) of the sum, rounded up."""
    return F.floor((SIMILARITY * (a + b) + (100 + SIMILARITY - 1)) / F.lit(100 + SIMILARITY)).cast("int")


def _prefix(n: Column) -> Column:
    """Length of the prefix that a set of n words shares a word of with every set it matches."""
    return (n - F.floor((SIMILARITY * n + 99) / F.lit(100)) + 1).cast("int")


def line_sets(lines: DataFrame, ranks: list[int]) -> DataFrame:
    """One row for each different line with a word: h1, h2, its first place, copies, n words, bits, wide, and the prefix of its codes.

    Copies are joined in the map tasks before anything is shuffled.
    """
    rows = lines.select(*PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), _hashes("line").alias("hashes"))
    n = F.size("hashes")
    rows = rows.withColumn("wide", F.when(n > WIDE_WORDS, _wide()))
    folded = functools.reduce(Column.bitwiseXOR, (F.get("wide", F.lit(j)) for j in range(4)))
    low = F.lit(1 << 31)  # of codes as longs from 0; they are kept as ints
    prefix = F.transform(F.slice(_codes(ranks), F.lit(1), _prefix(n)), lambda code: (code - low).cast("int"))
    rows = rows.select(
        "h1", "h2", F.struct(*PLACE).alias("place"), n.alias("n"),
        F.when(F.col("wide").isNull(), _parities()).otherwise(folded).alias("bits"), "wide",
        prefix.alias("prefix"),
    )
    one = rows.groupBy("h1", "h2").agg(
        F.min("place").alias("place"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "bits", "wide", "prefix"))
    )
    return one.select("h1", "h2", "place.*", "copies", "n", "bits", "wide", "prefix")


def postings(sets: DataFrame, part: Column | None = None, *more: str) -> DataFrame:
    """(t, doc_id, line_no, n, k, bits): each code of the prefix with its position k, or of the first ``part`` of it."""
    prefix = F.col("prefix") if part is None else F.slice("prefix", F.lit(1), part)
    return sets.select(F.posexplode(prefix).alias("k", "t"), *PLACE, "n", "bits", *more)


def _may_match(a: str, b: str, first: bool = False) -> Column:
    """Length, positional and bit filters of two postings (structs or sides) that share a code.

    ``first`` asks that no earlier code is shared, so nothing before the postings counts: a pair that matches passes at the
    first code it shares, and fewer of the others pass, and at fewer codes. It also tests the wide bits.
    """

    def of(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    n_a, n_b, k_a, k_b = of(a, "n"), of(b, "n"), of(a, "k"), of(b, "k")
    long_enough = (100 * n_a >= SIMILARITY * n_b) & (100 * n_b >= SIMILARITY * n_a)
    # This one and as many as follow in both; where others may be shared, also as many as stand before in both.
    common = F.least(n_a - k_a, n_b - k_b)
    if not first:
        common = common + F.least(k_a, k_b)
    both = n_a + n_b

    def near(apart: Column) -> Column:
        return (100 + SIMILARITY) * apart <= (100 - SIMILARITY) * both

    # What is cheapest comes first. No divisions and no lambdas, so that all of it is compiled into the join.
    passed = long_enough & ((100 + SIMILARITY) * common.cast("long") >= SIMILARITY * both)
    passed = passed & near(F.bit_count(of(a, "bits").bitwiseXOR(of(b, "bits"))))
    if not first:
        return passed
    each = [F.bit_count(F.get(of(a, "wide"), F.lit(j)).bitwiseXOR(F.get(of(b, "wide"), F.lit(j)))) for j in range(4)]
    return passed & F.coalesce(near(functools.reduce(Column.__add__, each)), F.lit(True))


def leader_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (later, earlier) of places that may match: of each posting with the first two and the last two before it.

    No pair of a dense group is listed but these, at most four for each code. Half a prefix will do: what is missed here
    is found by ``asked_pairs``.
    """
    half = (F.col("n") - F.floor((2 * SIMILARITY * F.col("n") + 179) / F.lit(180)) + 1).cast("int")
    own = F.struct(*PLACE, "n", "k", "bits")
    order = W.partitionBy("t").orderBy(*PLACE)
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = postings(sets, half).select(
        "t",
        own.alias("own"),
        F.first(own).over(so_far).alias("p1"),
        F.nth_value(own, 2).over(so_far).alias("p2"),
        F.lag(own, 1).over(order).alias("p3"),
        F.lag(own, 2).over(order).alias("p4"),
    )
    # One test behind the generator: four in one expression are too long a method for the JVM to compile.
    met = rows.select("own", F.explode(F.array("p1", "p2", "p3", "p4")).alias("other"))
    met = met.filter(F.col("other").isNotNull() & _before("other", "own") & _may_match("own", "other"))
    return met.select(_place("own").alias("later"), _place("other").alias("earlier")).distinct()


def _place(side: str) -> Column:
    return F.struct(*(F.col(f"{side}.{c}").alias(c) for c in PLACE))


def _before(a: str, b: str) -> Column:
    """Whether a place comes before another, without a struct for each pair that is looked at."""
    same = F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")
    return (F.col(f"{a}.doc_id") < F.col(f"{b}.doc_id")) | (same & (F.col(f"{a}.line_no") < F.col(f"{b}.line_no")))


def asked_pairs(sets: DataFrame) -> DataFrame:
    """All pairs (later, earlier) of places that may match, for the lines that ask (``asks``).

    Sets that match share one of the first n - ceil(0.8 n) + 1 words in the common order; where they share one, its
    positions bound what they can have in common; and their bits tell at once most sets that are too far apart.
    """
    rows = postings(sets, None, "asks", "wide")
    a, b = rows.alias("a"), rows.alias("b")
    # Both sides are one exchange. A test of a's column alone would be moved below it and make it two.
    asks = F.col("a.asks") | (F.col("b.asks") & (F.col("b.n") < 0))
    met = a.join(b, (F.col("a.t") == F.col("b.t")) & _before("b", "a") & _may_match("a", "b", first=True) & asks)
    return met.select(_place("a").alias("later"), _place("b").alias("earlier")).distinct()


def _marks(places: DataFrame) -> Column:
    """A test of (doc_id, line_no) against a bit table of fixed size: true for every place of ``places``, and for some others."""
    place = F.shiftrightunsigned(F.xxhash64(*PLACE), 64 - MARK_BITS).cast("int")
    return _marked(places, place)


def _marked(rows: DataFrame, place: Column) -> Column:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place % 64)
    words = rows.groupBy(F.floor(place / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits")).collect()
    table = [0] * (1 << (MARK_BITS - 6))
    for row in words:  # at most 65,536
        table[row["w"]] = row["bits"]
    word = F.get(_table(table), F.floor(place / 64).cast("int"))
    return F.call_function("shiftrightunsigned", word, place % 64).bitwiseAND(F.lit(1).cast("long")) == 1


def matched(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Places (doc_id, line_no) that match the earlier one of a pair, by all their words."""
    pairs = stored(pairs, "line-pairs")
    places = stored(pairs.select("later.*").union(pairs.select("earlier.*")).distinct(), "line-places")
    words = F.sort_array(_hashes("line"))
    # The words are worked out behind the join, for wanted lines alone.
    wanted = lines.filter(_marks(places)).join(places, [*PLACE], "left_semi").dropDuplicates([*PLACE])
    sets = stored(wanted.select(F.struct(*PLACE).alias("place"), words.alias("s")), "line-words")
    both = pairs.join(sets.select(F.col("place").alias("later"), F.col("s").alias("s_a")), "later")
    both = both.join(sets.select(F.col("place").alias("earlier"), F.col("s").alias("s_b")), "earlier")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.filter(common >= needed(F.size("s_a"), F.size("s_b"))).select("later.*").distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no) of every line that matches an earlier one: by doc_id, then by place in the text.

    Lines (parted by newlines) without words and of rows with a null id stay; every other line, however short, goes if
    an earlier line of any document, this one included, has a set of words with a Jaccard similarity of 0.8 or more -
    judged on the input, not on what is left. Null texts have no lines; rows that share an id are one text twice; an
    empty table gives no rows.

    Only whether a line has an earlier match is asked, so a dense group is not listed pair by pair: first each line meets
    a few earlier ones of its words, then the lines without a match so far meet all that are left by the filters.
    """
    lines = lines_of(docs.filter(F.col(id_col).isNotNull()), id_col, text_col)
    sets = stored(line_sets(lines, word_ranks(lines)), "line-sets").filter("n > 0")
    first = stored(matched(leader_pairs(sets), lines), "lines-matched")
    # Only what the bit table does not clear is shuffled to be told from the matched lines.
    spot = _marks(first)
    asking = sets.filter(spot).join(first.withColumn("found", F.lit(True)), [*PLACE], "left")
    asking = asking.withColumn("asks", F.col("found").isNull()).drop("found")
    asking = sets.filter(~spot).withColumn("asks", F.lit(True)).unionByName(asking)
    gone = first.union(matched(asked_pairs(asking), lines)).withColumn("all_go", F.lit(True))
    bounds = sets.join(gone, [*PLACE], "left").filter((F.col("copies") > 1) | F.col("all_go"))
    bounds = bounds.select("h1", "h2", F.struct(*PLACE).alias("first"), F.coalesce("all_go", F.lit(False)).alias("all_go"))
    places = lines.select(*PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    going = F.col("all_go") | (F.col("first") < F.struct(*PLACE))
    return places.join(bounds, ["h1", "h2"]).filter(going).select(*PLACE).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the lines of ``removed_lines`` taken out of the text; all rows and columns stay.

    A text of which every line goes is empty; a null text stays null. The row travels inside a struct, so its columns
    may have any name. Rows of which nothing goes (told by a bit table of fixed size) are not shuffled.
    """
    gone = removed_lines(docs, id_col, text_col).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    gone = stored(gone.withColumnRenamed("doc_id", "gone_id"), "lines-gone")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("lines"))
    spot = F.shiftrightunsigned(F.xxhash64("id"), 64 - MARK_BITS).cast("int")
    touched = F.coalesce(_marked(gone.select(F.col("gone_id").alias("id")), spot) & F.col("id").isNotNull(), F.lit(False))
    joined = rows.filter(touched).join(gone, F.col("id") == F.col("gone_id"), "left")
    # A map of places, so that a text with many lines is not searched line by line.
    joined = joined.withColumn("places", F.map_from_entries(F.transform("gone", lambda k: F.struct(k, F.lit(True)))))
    kept = F.filter(F.split("lines", "\n"), lambda line, k: F.col("places")[k].isNull())
    joined = joined.withColumn("left", F.when(F.col("places").isNull(), F.col("lines")).otherwise(F.array_join(kept, "\n")))
    kind = docs.schema[text_col].dataType
    changed = joined.select(F.col("row").withField(f"`{text_col}`", F.col("left").cast(kind)).alias("row"))
    return changed.union(rows.filter(~touched).select("row")).select("row.*")


def op8_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, how many lines it has, how many go, and which (their places, in order)."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    gone = removed_lines(docs).groupBy("doc_id").agg(F.count("*").alias("n_removed"), F.sort_array(F.collect_list("line_no")).alias("gone"))
    rows = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    return rows.join(gone, "doc_id", "left").select(
        "doc_id",
        "n_lines",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"),
    )


QUERIES = {"op8_line_join": op8_line_join}
SQL: dict[str, str] = {
    "op8_line_join": r"""
WITH texts AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM texts
), by_line AS (
  SELECT line, min((doc_id, line_no)) AS first,
         list_sort(list_distinct(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS s
  FROM lines GROUP BY line
), sets AS (
  SELECT line, first, s, len(s) AS n FROM by_line WHERE len(s) >= 1
), words AS (
  SELECT line, unnest(s) AS w FROM sets
), counts AS (
  SELECT w, count(*) AS c FROM words GROUP BY w
), ordered AS (
  SELECT line, w, row_number() OVER (PARTITION BY line ORDER BY c, w) AS k FROM words JOIN counts USING (w)
), prefix AS (
  SELECT line, w FROM ordered JOIN sets USING (line) WHERE 10 * (k - 1) <= 2 * n
), pairs AS (
  SELECT DISTINCT a.line AS a, b.line AS b FROM prefix a JOIN prefix b USING (w)
), matches AS (
  SELECT x.line, min(y.first) AS bound
  FROM pairs JOIN sets x ON x.line = pairs.a JOIN sets y ON y.line = pairs.b
  WHERE 9 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n)
  GROUP BY x.line
), gone AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed
  FROM lines JOIN matches USING (line) WHERE bound < (doc_id, line_no) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM texts LEFT JOIN gone USING (doc_id)
"""
}
