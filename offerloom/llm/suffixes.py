"""Suffix-array dedup: suffixes are range-partitioned by leading tokens, sorted in buckets, and neighbours compared."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.anchors import ANCHORS, Windows, anchor_rows, byte_tokens, covered, list_arrays, neighbours, spans_of, text_tag, window_rows, with_lists
from offerloom.llm.arrow import documents, id_and_text, pieces, stored, text_buffers

#: Bytes of a repeated string, and gram places in it; a sampled suffix leads with a gram of 209 bytes.
LENGTH, WIDTH = 400, 192

NO_ID = -(1 << 63)
FLAGGED = f"{ANCHORS}, multi boolean, exam boolean"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _flags(keys, at_start: bool, at_end: bool):
    """Bits of each sorted suffix: 1 if a neighbour agrees on its whole reach, 2 if one agrees on the leading gram only.

    The first and last suffix of a bucket count as agreeing with a neighbour across the boundary on the leading gram.
    """
    gram, span = keys
    same_gram = gram[1:] == gram[:-1]
    same_span = same_gram & (span[1:] == span[:-1])
    differ = same_gram & ~same_span
    no = [False]
    multi = np.concatenate([no, same_span]) | np.concatenate([same_span, no])
    exam = np.concatenate([[at_start], differ]) | np.concatenate([differ, [at_end]])
    return multi + 2 * exam


def repeated_spans(rows: DataFrame, rule: Windows) -> DataFrame:
    """(doc_id, tag, begin, end): spans of bytes covered by strings of the rule's length that start anywhere else too.

    Sampled suffixes (the anchors of all windows) are range-partitioned by sampled splitters over their leading
    tokens - the gram, then the hash of the whole reach, then the place, so that many equal suffixes spread over
    many buckets - and each bucket is sorted. Suffixes next to each other that agree on the whole reach repeat all of
    its windows. Where neighbours agree on the leading gram only, and at the boundaries of buckets, the single
    windows are compared, which gives the exact ends.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [field.split()[0] for field in ANCHORS.split(", ")]

    def compare(batches):
        for table, bits in neighbours(batches, ["gram", "span"], _flags):
            table = table.select(names).append_column("multi", pa.array(bits & 1 > 0)).append_column("exam", pa.array(bits & 2 > 0))
            yield from table.filter(pa.array(bits > 0)).combine_chunks().to_batches()

    order = ["gram", "span", "doc_id", "tag", "at"]
    suffixes = anchor_rows(rows, rule).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    known = stored(suffixes.mapInArrow(compare, FLAGGED), "suffixes")
    windows = window_rows(rows, known.filter("exam"), rule)
    same = W.partitionBy("gram", "window").orderBy("doc_id", "tag", "begin")
    twice = F.lag("begin").over(same).isNotNull() | F.lead("begin").over(same).isNotNull()
    ends = windows.withColumn("twice", twice).filter("twice")
    single = ends.select("doc_id", "tag", "begin", (F.col("begin") + rule.length).cast("int").alias("end"))
    return spans_of(known.filter("multi"), rule.length).unionByName(single)


def remove_repeats(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, with_bytes: bool = True) -> DataFrame:
    """Each row with the bytes left after those in strings of ``length`` bytes that start anywhere else too.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept. Strings are judged on
    the input and never cross texts; both of two overlapping repeats count. A null text is empty; a null id is an id
    like any other; repeated rows repeat each other's strings; shorter texts keep all; an empty table gives no rows.
    Extra columns are ignored.
    """
    rows = id_and_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    rule = Windows(length, width, byte_tokens)
    schema = RESULT if with_bytes else RESULT.rpartition(",")[0]

    def step(batches):
        for piece in pieces(batches):
            data, offsets = text_buffers(piece.column("text"))
            text, tag, begin, end = list_arrays(piece)
            own = text_tag(data, offsets)[text] == tag
            gone = covered(offsets, text[own], begin[own], end[own])
            before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
            before[offsets[:-1][offsets[:-1] < len(gone)]] = False
            removed = np.concatenate([[0], np.cumsum(gone)])
            runs = np.concatenate([[0], np.cumsum(gone & ~before)])
            cuts = (offsets - removed[offsets]).tolist()
            raw = data[~gone].tobytes()
            kept = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = [
                piece.column("doc_id"),
                pa.array(np.diff(offsets)),
                pa.array(np.diff(removed[offsets])),
                pa.array(np.diff(runs[offsets])),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            ]
            if with_bytes:
                columns.append(pa.array(kept, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in schema.split(", ")])

    found = with_lists(rows, repeated_spans(rows, rule), "left").mapInArrow(step, schema)
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir, "doc_id", "text"), with_bytes=False)


QUERIES = {"op9_suffixes": op9_suffixes}
SQL: dict[str, str] = {}
