"""Content-chosen anchors of token windows, and which tokens of a text its repeated windows cover.

Every window of ``length`` tokens has one anchor: the gram of ``length - width + 1`` tokens with the smallest hash
(the first of equals) among the ``width`` grams inside it. Equal windows have their anchor at the same place, so
they meet at the anchor's hash. The windows of one anchor lie side by side, from ``lo`` to ``hi`` tokens before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.arrow import longs, pieces, text_buffers, within
from offerloom.llm.hashing import BYTE_VALUES, LONG_FACTOR, U, WORD_FACTOR, mix, window_hashes, window_minima, word_hashes, word_spans

ANCHORS = "gram long, span long, doc_id long, tag int, at int, lo short, hi short"
WINDOWS = "gram long, window long, doc_id long, tag int, begin int"


@dataclass(frozen=True)
class Windows:
    """What a window is: how many tokens, how many grams are in it, and how a text becomes token hashes."""

    length: int
    width: int
    tokens: Callable

    @property
    def gram(self) -> int:
        return self.length - self.width + 1


def word_tokens(data, offsets):
    """Token hashes of all texts and the token at which each text begins."""
    begins, ends, at = word_spans(data, offsets)
    return word_hashes(data, begins, ends), at


def byte_tokens(data, offsets):
    return BYTE_VALUES[data], offsets


def text_tag(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A small checksum of each text, which tells rows apart that share an id."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTE_VALUES[data] * (np.arange(len(data)) + 1).astype(U), dtype=U)])
    begins, ends = offsets[:-1], offsets[1:]
    plain = np.concatenate([np.zeros(1, U), np.cumsum(BYTE_VALUES[data], dtype=U)])
    moved = (sums[ends] - sums[begins]) - (plain[ends] - plain[begins]) * begins.astype(U)
    return (mix(moved + (ends - begins).astype(U)) >> U(40)).astype(np.int32)


def text_anchors(tokens: np.ndarray, at: np.ndarray, rule: Windows):
    """(text, place, lo, hi, gram hash, span hash) of each anchor, with places counted from the text's first token.

    The span hash stands for all tokens of the anchor's windows, from the first one's begin to the last one's end.
    """
    grams = window_hashes(tokens, rule.gram, WORD_FACTOR)
    whole = window_hashes(tokens, rule.length, LONG_FACTOR)
    chosen = window_minima(grams, rule.width)
    counts = np.maximum(np.diff(at) - rule.length + 1, 0)  # windows of each text
    text = np.repeat(np.arange(len(counts)), counts)
    begin = at[text] + within(counts)
    anchor = chosen[begin]
    if not len(begin):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty.astype(U), empty.astype(U)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    place = anchor[first]
    hi, lo = place - begin[first], place - begin[last]
    span = mix(whole[begin[first]] + U(LONG_FACTOR) * whole[begin[last]] + (hi * 65536 + lo).astype(U))
    return text[first], place - at[text[first]], lo, hi, grams[place], span


def anchor_rows(rows: DataFrame, rule: Windows) -> DataFrame:
    """The anchors of every text of (doc_id, text)."""

    def step(batches):
        for piece in pieces(batches):
            data, offsets = text_buffers(piece.column("text"))
            text, place, lo, hi, gram, span = text_anchors(*rule.tokens(data, offsets), rule)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram.view(np.int64)),
                    pa.array(span.view(np.int64)),
                    pa.array(longs(piece.column("doc_id"))[text]),
                    pa.array(text_tag(data, offsets)[text]),
                    pa.array(place.astype(np.int32)),
                    pa.array(lo.astype(np.int16)),
                    pa.array(hi.astype(np.int16)),
                ],
                [field.split()[0] for field in ANCHORS.split(", ")],
            )

    return rows.mapInArrow(step, ANCHORS)


def _packed(*columns) -> F.Column:
    return F.collect_list(F.struct(*columns))


def with_lists(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """The texts joined with the (tag, begin, end) rows of their id, as three arrays; at most one entry for each token."""
    lists = found.groupBy("doc_id").agg(_packed("tag", "begin", "end").alias("l"))
    lists = lists.select("doc_id", F.col("l.tag").alias("tags"), F.col("l.begin").alias("begins"), F.col("l.end").alias("ends"))
    return rows.join(lists, "doc_id", how)


def list_arrays(batch: pa.RecordBatch, names=("tags", "begins", "ends")):
    """(text, values of each list column) of all entries, as flat arrays."""
    column = batch.column(names[0])
    counts = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    counts = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, counts)
    text = np.repeat(np.arange(len(counts)), counts)
    return text, *(batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for name in names)


def window_rows(rows: DataFrame, wanted: DataFrame, rule: Windows) -> DataFrame:
    """Each single window of the wanted anchors (doc_id, tag, at, lo, hi): where it begins, its hash and its anchor's."""
    found = wanted.select("doc_id", "tag", F.col("at").alias("begin"), (F.col("hi").cast("int") * 65536 + F.col("lo")).alias("end"))

    def step(batches):
        for piece in pieces(batches):
            data, offsets = text_buffers(piece.column("text"))
            tokens, at = rule.tokens(data, offsets)
            grams = window_hashes(tokens, rule.gram, WORD_FACTOR)
            whole = window_hashes(tokens, rule.length, LONG_FACTOR)
            text, tag, place, reach = list_arrays(piece)
            own = text_tag(data, offsets)[text] == tag
            text, tag, place, hi, lo = text[own], tag[own], place[own], reach[own] >> 16, reach[own] & 65535
            counts = hi - lo + 1
            begin = np.repeat(place - hi, counts) + within(counts)
            text, place, tag = np.repeat(text, counts), np.repeat(place, counts), np.repeat(tag, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams[at[text] + place].view(np.int64)),
                    pa.array(whole[at[text] + begin].view(np.int64)),
                    pa.array(longs(piece.column("doc_id"))[text]),
                    pa.array(tag.astype(np.int32)),
                    pa.array(begin.astype(np.int32)),
                ],
                [field.split()[0] for field in WINDOWS.split(", ")],
            )

    return with_lists(rows, found, "inner").mapInArrow(step, WINDOWS)


def covered(at: np.ndarray, text, begin, end) -> np.ndarray:
    """True for each token inside one of the spans."""
    steps = np.zeros(int(at[-1]) + 1, np.int32)
    np.add.at(steps, at[text] + begin, 1)
    np.add.at(steps, at[text] + end, -1)
    return np.cumsum(steps[:-1]) > 0


def spans_of(rows: DataFrame, length: int) -> DataFrame:
    """Anchors as spans: all tokens of their windows."""
    return rows.select(
        "doc_id",
        "tag",
        (F.col("at") - F.col("hi")).cast("int").alias("begin"),
        (F.col("at") - F.col("lo") + length).cast("int").alias("end"),
    )


def neighbours(batches, columns: list[str], flags: Callable):
    """Sorted batches with ``flags(keys)`` of each row, given the key columns of the rows and their neighbours.

    One row of the batch before is carried over; what stands before the first and after the last row of the
    partition is not seen, and flagged by ``flags`` as an edge.
    """
    held = None
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        n = table.num_rows
        keep = flags([table.column(c).to_numpy() for c in columns], first, False)
        start = 0 if first else 1
        if n - 1 > start:
            yield table.slice(start, n - 1 - start), keep[start : n - 1]
            first = False
            held = table.slice(n - 2)
        else:
            held = table
    if held is not None:
        keep = flags([held.column(c).to_numpy() for c in columns], first, True)
        start = 0 if first else 1
        yield held.slice(start), keep[start:]
