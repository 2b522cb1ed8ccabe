"""Phrases whose words stand together more often than apart: count streams in prefix and suffix order, merged in step."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.arrow import documents, gather, pieces, stored, text_buffers
from offerloom.llm.hashing import LOWER, U, WORD_FACTOR, mix, word_hashes, word_spans

#: Words of the longest phrase, fewest occurrences of a candidate, and the scale of scores.
LONGEST, MIN_COUNT, SCALE = 4, 30, 2_000_000
#: A candidate goes if a longer one around it has at least this share (in hundredths) of its occurrences.
COVERED = 80
#: Phrases reported for each language.
TOP = 2000

#: Bytes that part words, and bytes that part pieces (no phrase crosses them).
GAPS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(BREAKS)] = True
PARTS_WORDS = IS_BREAK.copy()
PARTS_WORDS[list(GAPS)] = True

#: Words whose n-grams are counted together before they are shuffled.
COUNTED_WORDS = 1 << 21
#: Bits of the filter for each frequent n-gram, probes, and the bounds of its size (128 KB to 128 MB, so that it may be
#: broadcast). A full filter lets more n-grams through to the exact counts, and never holds one back.
BITS_PER_KEY, PROBES, MIN_BITS, MAX_BITS = 16, 4, 1 << 20, 1 << 30
SLICES = 256

ROWS_OUT = 1 << 18


class Words:
    """The words of some texts, with what tells neighbours apart."""

    def __init__(self, hashes, segments, langs, bytes_, starts):
        #: Hash of (language, word); number of the piece it stands in; place of its language; all words with one space
        #: after each; where each begins there (one more at the end).
        self.hashes, self.segments, self.langs, self.bytes, self.starts = hashes, segments, langs, bytes_, starts

    @staticmethod
    def read(column, langs: np.ndarray, salts: np.ndarray) -> Words:
        data, offsets = text_buffers(column)
        data = LOWER[data]
        begins, ends, at = word_spans(data, offsets, PARTS_WORDS)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        broken = np.concatenate([[0], np.cumsum(IS_BREAK[data])])
        segments = broken[begins] + doc
        sizes = ends - begins
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        compact = np.full(starts[-1], 0x20, np.uint8)
        compact[np.repeat(starts[:-1] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = gather(data, begins, sizes)
        hashes = mix(word_hashes(data, begins, ends, PARTS_WORDS) + salts[langs[doc]])
        return Words(hashes, segments, langs[doc].astype(np.int32), compact, starts)

    @staticmethod
    def joined(parts: list[Words]) -> Words:
        shift_s = np.cumsum([0, *(int(p.segments[-1]) + 1 if len(p.segments) else 0 for p in parts)])
        shift_b = np.cumsum([0, *(len(p.bytes) for p in parts)])
        starts = [p.starts[:-1] + b for p, b in zip(parts, shift_b[:-1], strict=True)] + [shift_b[-1:]]
        return Words(
            np.concatenate([p.hashes for p in parts]),
            np.concatenate([p.segments + s for p, s in zip(parts, shift_s[:-1], strict=True)]),
            np.concatenate([p.langs for p in parts]),
            np.concatenate([p.bytes for p in parts]),
            np.concatenate(starts),
        )

    def longer(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Hashes of n-grams of ``order`` words at each place, from those of one word less."""
        n = max(0, len(self.hashes) - order + 1)
        return mix(keys[:n] * U(WORD_FACTOR) + self.hashes[order - 1 :])

    def whole(self, order: int) -> np.ndarray:
        """Whether the n-gram at each place lies in one piece."""
        n = max(0, len(self.segments) - order + 1)
        return self.segments[:n] == self.segments[order - 1 :]

    def texts(self, places: np.ndarray, order: int) -> pa.Array:
        begins = self.starts[places]
        sizes = self.starts[places + order] - 1 - begins
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        data = gather(self.bytes, begins, sizes)
        return pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(data))


def _held(batches, words: int = COUNTED_WORDS):
    """Words of many texts at a time, each with the languages its ``langs`` point to."""
    names: dict[str, int] = {}
    parts, size = [], 0
    for piece in pieces(batches):
        own = [names.setdefault(x, len(names)) for x in piece.column("lang").to_pylist()]
        salts = mix(np.array([hash_of(x) for x in names], U))
        parts.append(Words.read(piece.column("text"), np.array(own, np.int64), salts))
        size += len(parts[-1].hashes)
        if size >= words:
            yield Words.joined(parts), list(names)
            parts, size = [], 0
    if parts:
        yield Words.joined(parts), list(names)


def hash_of(name: str) -> int:
    """The same 64-bit number for a name in every task."""
    data = np.frombuffer(name.encode() or b"\0", np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]), np.zeros(256, bool))[0])


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def _key_counts(texts: DataFrame) -> DataFrame:
    """(key, c): hashes of words and pairs of words with their occurrences in some 2 million words of a task."""

    def step(batches):
        for words, _ in _held(batches):
            pairs = words.longer(words.hashes, 2)[words.whole(2)]
            for keys in (words.hashes, pairs):
                found, counts = np.unique(keys, return_counts=True)
                for k in range(0, len(found), ROWS_OUT):
                    part = slice(k, k + ROWS_OUT)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found[part].view(np.int64)), pa.array(counts[part].astype(np.int32))], ["key", "c"]
                    )

    return texts.mapInArrow(step, "key long, c int")


def _spots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The probed bits of each key; all lie in the slice that its top byte names."""
    slice_bits = bits // SLICES
    base = (keys >> U(56)).astype(np.int64) * slice_bits
    return [base + (mix(keys + U(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)) & U(slice_bits - 1)).astype(np.int64) for k in range(1, PROBES + 1)]


def build_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter (bytes) of all keys, each slice built by a task; 128 MB at most come to the driver."""
    wanted = BITS_PER_KEY * max(1, keys.count())
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (wanted - 1).bit_length()))
    slice_bytes = bits // SLICES // 8

    def step(batches):
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            own = batch.column("key").to_numpy().view(U)
            for name in np.unique(own >> U(56)).tolist():
                table = tables.setdefault(name, np.zeros(slice_bytes, np.uint8))
                for spots in _spots(own[own >> U(56) == U(name)], bits):
                    spots = spots - name * slice_bytes * 8
                    np.bitwise_or.at(table, spots >> 3, np.uint8(1) << (spots & 7).astype(np.uint8))
        for name, table in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([table.tobytes()], pa.binary())], ["slice", "bits"])

    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(partitions, F.shiftrightunsigned("key", 56))
    table = np.zeros(bits // 8, np.uint8)
    for row in dealt.mapInArrow(step, "slice int, bits binary").toLocalIterator():
        table[row["slice"] * slice_bytes : (row["slice"] + 1) * slice_bytes] = np.frombuffer(row["bits"], np.uint8)
    return table


def member(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter holds each key; true for every key it was built from."""
    found = np.ones(len(keys), bool)
    for spots in _spots(keys, 8 * len(table)):
        found &= table[spots >> 3] >> (spots & 7).astype(np.uint8) & 1 == 1
    return found


def _phrase_counts(texts: DataFrame, frequent: Callable[[], np.ndarray]) -> DataFrame:
    """(lang, phrase, order, c): occurrences, in some 2 million words of a task, of n-grams all of whose words and pairs may be frequent.

    Order 0 holds all words of the language.
    """

    def row_batches(words: Words, names: list[str], keys: np.ndarray, places: np.ndarray, order: int):
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        langs = pa.array(names)
        for k in range(0, len(first), ROWS_OUT):
            at = places[first[k : k + ROWS_OUT]]
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(words.langs[at])),
                    words.texts(at, order).cast(pa.string()),
                    pa.array(np.full(len(at), order, np.int32)),
                    pa.array(counts[k : k + ROWS_OUT].astype(np.int64)),
                ],
                ["lang", "phrase", "order", "c"],
            )

    def step(batches):
        table = frequent()
        for words, names in _held(batches):
            totals = np.bincount(words.langs, minlength=len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([""] * len(names)), pa.array([0] * len(names), pa.int32()), pa.array(totals.astype(np.int64))],
                ["lang", "phrase", "order", "c"],
            )
            keys = words.hashes
            own = np.flatnonzero(member(table, keys))
            yield from row_batches(words, names, keys[own], own, 1)
            keys = words.longer(keys, 2)
            good = words.whole(2)
            good[good] = member(table, keys[good])
            pair = good  # pairs that may be frequent; a longer n-gram needs all of its pairs
            for order in range(2, LONGEST + 1):
                if order > 2:
                    keys = words.longer(keys, order)
                    good = good[: len(keys)] & pair[order - 2 : order - 2 + len(keys)]
                own = np.flatnonzero(good)
                yield from row_batches(words, names, keys[own], own, order)

    return texts.mapInArrow(step, "lang string, phrase string, order int, c long")


def count_streams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, order, f): exact occurrences of every n-gram of one to four words found 30 times or more.

    Words (A-Z in lower case) are parted by space and tab, and no n-gram crosses ``.,;:!?`` or a line end; overlapping
    occurrences count. Order 0, with an empty phrase, holds the number of all words of the language. Null texts have no
    words, a null language is ``und``. First words and pairs are counted by hash; what is built from frequent pairs
    alone is then counted by its text. A hash shared by two pairs can only let more through. Inside some 2 million words of
    a task, n-grams are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    texts = _texts(docs, text_col, lang_col)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _key_counts(texts).repartition(partitions, "key").groupBy("key").agg(F.sum("c").alias("c"))
    keys = stored(keys.filter(F.col("c") >= MIN_COUNT).select("key"), "frequent-keys")
    table = spark.sparkContext.broadcast(build_filter(keys))
    counts = _phrase_counts(texts, lambda: table.value)
    counts = counts.repartition(partitions, "lang", "phrase").groupBy("lang", "phrase", "order").agg(F.sum("c").alias("f"))
    return counts.filter((F.col("order") == 0) | (F.col("f") >= MIN_COUNT))


def _whole(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, order, a, l, r, score) of each candidate, by its lowest-scoring cut (of equal ones the first).

    Two streams of the counts are merged in step with the cuts of all phrases: in prefix order, where the first part of
    a cut stands before its extensions, for l; in suffix order, where the rest of a cut does, for r.
    """
    cuts = counts.filter("order > 1").select("lang", "phrase", "order", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("order") - 1)).alias("k"))
    cuts = cuts.withColumns({
        "first": F.expr("substring_index(phrase, ' ', k)"),
        "rest": F.expr("substring_index(phrase, ' ', k - order)"),
    })
    prefix = counts.filter("order > 0").select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    suffix = counts.filter("order > 0").select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    left = cuts.hint("merge").join(prefix, ["lang", "first"])
    both = left.hint("merge").join(suffix, ["lang", "rest"])
    # 2,000,000 * a may pass 64 bits; the quotient is at most a million, as l and r are at least a.
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = both.groupBy("lang", "phrase", "order", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "order", "a", "best.l", "best.r", "best.score")


def extensions(counts: DataFrame) -> DataFrame:
    """(lang, phrase, around): of each phrase, the occurrences of the most frequent candidate that is one word longer at
    the right (found in prefix order) or at the left (in suffix order)."""
    longer = counts.filter("order > 2")
    parts = F.array(F.expr("substring_index(phrase, ' ', order - 1)"), F.expr("substring_index(phrase, ' ', 1 - order)"))
    return longer.select("lang", F.explode(parts).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of two to four words found 30 times or more. Of a cut into two parts found l and r times, the
    score is 2,000,000 a / (l + r), rounded down; the lowest cut counts. A candidate that lies in a longer one with at
    least 80 % of its occurrences goes (one word longer is enough to look at: what holds for two words more holds for the
    phrase between). Of each language the first ``top`` by score, a (both falling) and phrase (by bytes) come back.

    Null and empty texts, repeated rows, and languages are as in ``count_streams``; ties end at the phrase, which is
    unique; an empty table gives no rows; extra columns are left behind.
    """
    counts = stored(count_streams(docs, text_col, lang_col), "phrase-counts")
    best = scored(counts).hint("merge").join(extensions(counts), ["lang", "phrase"], "left")
    covered = F.coalesce(100 * _whole("around") >= COVERED * _whole("a"), F.lit(False))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.filter(~covered).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counts.filter("order = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir, "text", "lang"))


QUERIES = {"op11_phrases": op11_phrases}
SQL = {
    "op11_phrases": rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p
), totals AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), places AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), grams AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2, 3, 4]) AS m FROM places) WHERE i + m - 1 <= len(ws)
), f AS (
  SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
), cuts AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:m], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f)
), scores AS (
  SELECT c.lang, c.m, c.phrase, c.a, x.f AS l, y.f AS r, k, ({SCALE}::HUGEINT * c.a // (x.f + y.f)::HUGEINT)::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, f AS around
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM f WHERE m > 2))
), left_over AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (
    SELECT 1 FROM inside WHERE inside.lang = c.lang AND inside.phrase = c.phrase AND 100::HUGEINT * around >= {COVERED}::HUGEINT * a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM left_over JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""
}
