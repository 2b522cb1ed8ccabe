"""Substring dedup by seed and extend: winnowed anchors are joined, matches extended both ways."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.anchors import ANCHORS, Windows, anchor_rows, covered, list_arrays, neighbours, spans_of, text_tag, window_rows, with_lists, word_tokens
from offerloom.llm.arrow import documents, gather, id_and_text, pieces, stored, text_buffers
from offerloom.llm.hashing import word_spans

#: Words in a repeated window, and anchors grams to choose from inside it (so a gram has five words).
WINDOW_WORDS, WIDTH = 13, 9

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def repeated_spans(rows: DataFrame, rule: Windows) -> DataFrame:
    """(doc_id, tag, begin, end): spans of words that windows also starting in a smaller doc_id cover.

    Seeds: anchors are grouped by their gram, and a gram found once goes. Extension: two anchors whose windows all
    agree (equal span hash) match on their whole reach, so only the first document of each such class is kept for
    comparison. Where classes share a gram but not the whole reach - the ends of a repeat - the single windows of the
    first documents are compared, which gives the exact end. Grams and classes are reduced in the map tasks.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [field.split()[0] for field in ANCHORS.split(", ")]

    def repeated(keys, at_start, at_end):
        gram = keys[0]
        same = gram[1:] == gram[:-1]
        return np.concatenate([[False], same]) | np.concatenate([same, [False]])

    def seeds(batches):
        for table, keep in neighbours(batches, ["gram"], repeated):
            yield from table.filter(pa.array(keep)).select(names).combine_chunks().to_batches()

    anchors = anchor_rows(rows.filter("doc_id is not null"), rule)
    shared = stored(anchors.repartition(partitions, "gram").sortWithinPartitions("gram").mapInArrow(seeds, ANCHORS), "seeds")
    classes = shared.groupBy("gram", "span").agg(F.min("doc_id").alias("first"))
    grams = classes.groupBy("gram").agg(F.count("*").alias("n_classes"), F.max("first").alias("latest"), F.min("first").alias("least"))
    known = stored(
        shared.join(classes, ["gram", "span"])
        .join(grams, "gram")
        .filter("first < doc_id or (n_classes > 1 and least < latest)")
        .select("doc_id", "tag", "at", "lo", "hi", (F.col("first") < F.col("doc_id")).alias("whole")),
        "matches",
    )
    windows = window_rows(rows, known.filter("not whole"), rule)
    first = F.first("doc_id").over(W.partitionBy("gram", "window").orderBy("doc_id").rowsBetween(W.unboundedPreceding, 0))
    ends = windows.withColumn("first", first).filter("first < doc_id")
    single = ends.select("doc_id", "tag", "begin", (F.col("begin") + rule.length).cast("int").alias("end"))
    return spans_of(known.filter("whole"), rule.length).unionByName(single)


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """Each row with the words left after those in windows of ``window`` words that also start in a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) and kept_text (the text without
    the removed words and the white space after each). Windows are judged on the input. A null text is empty; a null
    id is smaller than none and greater than none, so nothing of it is removed or removes; rows that share an id do
    not remove each other's words; texts with fewer words keep all; an empty table gives no rows. Extra columns are
    ignored.
    """
    rows = id_and_text(docs)
    rule = Windows(window, width, word_tokens)
    schema = RESULT if with_text else RESULT.rpartition(",")[0]

    def step(batches):
        for piece in pieces(batches):
            data, offsets = text_buffers(piece.column("text"))
            begins, ends, at = word_spans(data, offsets)
            text, tag, begin, end = list_arrays(piece)
            own = text_tag(data, offsets)[text] == tag
            gone = covered(at, text[own], begin[own], end[own])
            lengths = np.where(gone, 0, ends - begins + 1)
            kept = gather(np.append(data, np.uint8(0x20)), begins[~gone], lengths[~gone])
            stops = np.concatenate([[0], np.cumsum(lengths)])
            kept[stops[1:][~gone] - 1] = 0x20
            cuts = stops[at].tolist()
            raw = memoryview(kept.tobytes())
            digests = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            removed = np.concatenate([[0], np.cumsum(gone)])[at]
            columns = [piece.column("doc_id"), pa.array(np.diff(at)), pa.array(np.diff(removed)), pa.array(digests, pa.string())]
            if with_text:
                columns.append(pa.array(_without(data, offsets, begins, at, gone), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in schema.split(", ")])

    return with_lists(rows, repeated_spans(rows, rule), "left").mapInArrow(step, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` with the words that ``remove_repeats`` names cut out of the text; all rows and columns stay.

    A null text becomes empty.
    """
    rest = [F.col(c) for c in docs.columns if c != text_col]
    packed = F.struct(*rest).alias("rest")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), packed)
    rule = Windows(window, width, word_tokens)

    def step(batches):
        for piece in pieces(batches):
            data, offsets = text_buffers(piece.column("text"))
            begins, _, at = word_spans(data, offsets)
            text, tag, begin, end = list_arrays(piece)
            own = text_tag(data, offsets)[text] == tag
            gone = covered(at, text[own], begin[own], end[own])
            left = pa.array(_without(data, offsets, begins, at, gone), pa.string())
            yield pa.RecordBatch.from_arrays([piece.column("rest"), left], ["rest", "text"])

    spans = repeated_spans(rows.select("doc_id", "text"), rule)
    schema = f"rest {rows.schema['rest'].dataType.simpleString()}, text string"
    joined = with_lists(rows, spans, "left").mapInArrow(step, schema)
    return joined.select(*(F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns))


def _without(data, offsets, begins, at, gone) -> list[str]:
    """The texts without the removed words; each goes with the white space that follows it."""
    stops = np.append(begins[1:], len(data))
    last = at[1:][np.diff(at) > 0] - 1
    stops[last] = offsets[1:][np.diff(at) > 0]
    steps = np.zeros(len(data) + 1, np.int8)
    np.add.at(steps, begins[gone], 1)
    np.add.at(steps, stops[gone], -1)
    left = np.cumsum(steps[:-1]) == 0
    cuts = np.concatenate([[0], np.cumsum(left)])[offsets].tolist()
    raw = data[left].tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir, "doc_id", "text"), with_text=False)


QUERIES = {"op4_substrings": op4_substrings}
SQL = {
    "op4_substrings": r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM words)
), first AS (
  SELECT win, min(doc_id) AS least FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM windows JOIN first USING (win) WHERE least < doc_id
), lists AS (
  SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id
), left_over AS (
  SELECT w.doc_id, ws, list_filter(list_transform(ws, lambda x, k: CASE WHEN list_contains(coalesce(ks, []), k) THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS kept
  FROM words w LEFT JOIN lists USING (doc_id)
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(kept))::BIGINT AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM left_over
"""
}
