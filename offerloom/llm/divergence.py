"""Quality rules by distribution divergence, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.arrow import documents

#: Frequent words of each language, most frequent first; other languages are judged by characters alone.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"),
}

#: Base rules: fewest words, and most words (in percent) inside repeated windows of three words.
MIN_WORDS, MAX_REPEATED, REPEAT_WINDOW = 50, 50, 3

#: Fewest words of a document that is compared or that a reference learns from, and fewest documents of a reference.
GUARD_WORDS, GUARD_DOCUMENTS = 50, 10

#: Largest Jensen-Shannon distances (square root of the divergence in bits, so at most 1) of a document that is kept.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.2, 0.285

SEPARATORS = r"[\x20\x09-\x0D]+"
OTHER = ""


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _language(lang_col: str) -> Column:
    lang = F.col(lang_col).cast("string")
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(OTHER))


def _share(counts: list[Column]) -> Column:
    """Counts as shares of their sum (all 0 if that is 0)."""
    total = sum(counts[1:], counts[0])
    return F.when(total > 0, F.array(*(c / total for c in counts))).otherwise(F.array(*(F.lit(0.0) for _ in counts)))


def with_histograms(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Adds q_text, q_lang, q_words (array), q_chars (shares of character classes) and q_common (of common words)."""
    base = docs.withColumns({"q_text": _text(text_col), "q_lang": _language(lang_col)})
    base = base.withColumn("q_words", F.array_remove(F.split("q_text", SEPARATORS), ""))
    # Two spaces part the words, so neighbouring occurrences of a word are both found.
    base = base.withColumns(
        {
            "q_padded": F.concat(F.lit(" "), F.lower(F.array_join("q_words", "  ")), F.lit(" ")),
            "q_word_chars": F.length(F.array_join("q_words", "")),
            "q_n_words": F.size("q_words"),
            "q_n_chars": F.length("q_text"),
        }
    )

    def found(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return ((F.octet_length("q_padded") - F.octet_length(F.replace("q_padded", padded, F.lit("")))) / F.octet_length(padded)).cast("long")

    width = max(map(len, COMMON_WORDS.values()))
    lists = F.create_map(*(x for lang, words in COMMON_WORDS.items() for x in (F.lit(lang), F.array(*map(F.lit, words)))))
    hits = F.transform(lists[F.col("q_lang")], found)
    base = base.withColumns(
        {
            "q_hits": F.coalesce(hits, F.array_repeat(F.lit(0).cast("long"), width)),
            "q_upper": F.regexp_count("q_text", F.lit("[A-Z]")),
            "q_digits": F.regexp_count("q_text", F.lit("[0-9]")),
            "q_marks": F.regexp_count("q_text", F.lit(r"[!-/:-@\[-`{-~]")),
        }
    )
    spaces = F.col("q_n_chars") - F.col("q_word_chars")
    letters = F.col("q_word_chars") - F.col("q_upper") - F.col("q_digits") - F.col("q_marks")
    beyond_ascii = F.octet_length("q_text") - F.col("q_n_chars")
    others = F.col("q_n_words") - F.aggregate("q_hits", F.lit(0).cast("long"), lambda a, x: a + x)
    return base.withColumns(
        {
            "q_chars": _share([letters, F.col("q_upper"), F.col("q_digits"), F.col("q_marks"), spaces, beyond_ascii]),
            "q_common": _share([*(F.get("q_hits", F.lit(k)) for k in range(width)), others]),
        }
    )


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Mean histograms over all documents of each language with enough words: one row for each listed language and one for the rest."""
    rows = with_histograms(docs.select(F.col(text_col), F.col(lang_col)), text_col, lang_col)
    width = max(map(len, COMMON_WORDS.values())) + 1
    learned = F.col("q_n_words") >= GUARD_WORDS  # a filter would be pushed down and split the texts a second time

    def mean(shares: str, k: int) -> Column:
        return F.avg(F.when(learned, F.get(shares, F.lit(k))))

    means = rows.groupBy("q_lang").agg(
        F.count_if(learned).alias("n"),
        *(mean("q_chars", k).alias(f"c{k}") for k in range(6)),
        *(mean("q_common", k).alias(f"w{k}") for k in range(width)),
    )
    return means.filter(F.col("n") >= GUARD_DOCUMENTS).select(
        F.col("q_lang").alias("r_lang"),
        F.array(*(f"c{k}" for k in range(6))).alias("r_chars"),
        F.array(*(f"w{k}" for k in range(width))).alias("r_common"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def repeated_words() -> Column:
    """Words of q_words in windows found twice or more; q_windows holds (hash, place) of each window, sorted by hash."""
    windows = F.col("q_windows")

    def twin(k: Column) -> Column:
        return F.coalesce(F.get(windows, k)["h"] == F.get(windows, k - 1)["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter(windows, lambda x, k: twin(k) | twin(k + 1)), lambda x: x["k"]))
    ends = F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, k: F.struct(
            (k + REPEAT_WINDOW).alias("end"), (a["n"] + k + REPEAT_WINDOW - F.greatest(a["end"], k)).alias("n")
        ),
    )
    return ends["n"]


def with_base(rows: DataFrame) -> DataFrame:
    """Adds the base counts to rows with histograms."""
    lines = F.filter(F.split("q_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(
        F.when(F.col("q_n_words") >= REPEAT_WINDOW, F.sequence(F.lit(0), F.col("q_n_words") - REPEAT_WINDOW)),
        lambda k: F.xxhash64(*(F.get("q_words", k + j) for j in range(REPEAT_WINDOW))),
    )
    rows = rows.withColumns({"q_lines": lines, "q_hashes": hashes})
    # Most texts repeat no window, and need no sorting.
    repeats = F.size(F.array_distinct("q_hashes")) < F.size("q_hashes")
    windows = F.when(repeats, F.sort_array(F.transform("q_hashes", lambda h, k: F.struct(h.alias("h"), k.alias("k")))))
    rows = rows.withColumn("q_windows", windows)
    return rows.withColumns(
        {
            "n_words": F.col("q_n_words").cast("long"),
            "word_chars": F.col("q_word_chars").cast("long"),
            "n_symbols": F.regexp_count("q_text", F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("q_windows").isNull(), 0).otherwise(repeated_words()).cast("long"),
        }
    )


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` under q_row (a struct), with the base counts, both distances, base_failed and kept.

    A document fails the base rules with fewer than 50 words or more than half of them in repeated windows of three.
    Otherwise it is kept unless its character classes, or its common words, lie further from the reference of its
    language than the bounds; one with fewer words than the guard, or of a language whose reference rests on too few
    documents, is not compared. A null or empty text has no words and fails; a null language counts among the rest;
    rows are judged alone, so repeated rows get equal verdicts; an empty table gives no rows. Columns of any name
    stay inside q_row. References cover all documents. Two passes over the texts; the only shuffle is of sums.
    """
    rows = docs.select(F.struct("*").alias("q_row"), F.col(text_col).alias("q_t"), F.col(lang_col).alias("q_l"))
    rows = with_base(with_histograms(rows, "q_t", "q_l"))
    means = references(docs, text_col, lang_col)  # at most one row for each listed language, and one more
    rows = rows.join(F.broadcast(means), rows["q_lang"] == means["r_lang"], "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    compared = F.col("r_lang").isNotNull() & (F.col("n_words") >= GUARD_WORDS)
    rows = rows.withColumns(
        {
            "class_distance": F.when(compared, distance(F.col("q_chars"), F.col("r_chars"))),
            "word_distance": F.when(compared & (F.col("q_lang") != OTHER), distance(F.col("q_common"), F.col("r_common"))),
            "base_failed": failed,
        }
    )
    far = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(
        F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False)
    )
    return rows.withColumn("kept", ~failed & ~far).select(
        "q_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"
    )


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(documents(spark, sf_dir, "doc_id", "text", "lang"))
    return judged.select(
        F.col("q_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    lists = " ".join(f"WHEN '{lang}' THEN {list(words)}" for lang, words in COMMON_WORDS.items())
    width = max(map(len, COMMON_WORDS.values()))
    part = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"

    def js(p: str, q: str, n: int) -> str:
        both = f"{part.format(x=f'{p}[k]', y=f'{q}[k]')} + {part.format(x=f'{q}[k]', y=f'{p}[k]')}"
        return f"sqrt(greatest(0, list_sum(list_transform(range(1, {n + 1}), lambda k: {both})) / 2))"

    def means(shares: str, n: int) -> str:
        return "[" + ", ".join(f"avg({shares}[{k}])" for k in range(1, n + 1)) + "]"

    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN {tuple(COMMON_WORDS)} THEN lang ELSE '' END AS lang FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t
), b AS (
  SELECT *, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, ' ' || lower(array_to_string(ws, '  ')) || ' ' AS padded,
         len(regexp_extract_all(text, '[A-Z]')) AS upper, len(regexp_extract_all(text, '[0-9]')) AS digits,
         len(regexp_extract_all(text, '[!-/:-@\[-`{{-~]')) AS marks, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines
  FROM w
), h AS (
  SELECT *, [word_chars - upper - digits - marks, upper, digits, marks, length(text) - word_chars, strlen(text) - length(text)] AS cs,
         coalesce(list_transform(CASE lang {lists} END, lambda x: (strlen(padded) - strlen(replace(padded, ' ' || x || ' ', ''))) // strlen(' ' || x || ' ')),
                  list_transform(range({width}), lambda x: 0)) AS hits
  FROM b
), s AS (
  SELECT *, list_transform(cs, lambda c: CASE WHEN list_sum(cs) > 0 THEN c / list_sum(cs) ELSE 0 END) AS chars,
         list_transform(list_append(hits, n_words - list_sum(hits)), lambda c: CASE WHEN n_words > 0 THEN c / n_words ELSE 0 END) AS common
  FROM h
), r AS (
  SELECT lang, {means("chars", 6)} AS r_chars, {means("common", width + 1)} AS r_common
  FROM s WHERE n_words >= {GUARD_WORDS} GROUP BY lang HAVING count(*) >= {GUARD_DOCUMENTS}
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows
), repeated AS (
  SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM twice WHERE n > 1) GROUP BY doc_id
), judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lang,
         n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEATED} * n_words AS base_failed,
         CASE WHEN r_chars IS NOT NULL AND n_words >= {GUARD_WORDS} THEN {js("chars", "r_chars", 6)} ELSE 0 END AS class_distance,
         CASE WHEN r_chars IS NOT NULL AND n_words >= {GUARD_WORDS} AND lang <> '' THEN {js("common", "r_common", width + 1)} ELSE 0 END AS word_distance
  FROM s LEFT JOIN r USING (lang) LEFT JOIN repeated USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND class_distance <= {MAX_CLASS_DISTANCE} AND word_distance <= {MAX_WORD_DISTANCE} AS kept
FROM judged
"""


QUERIES = {"op2_divergence": op2_divergence}
SQL = {"op2_divergence": _sql()}
