"""Hierarchical packing into windows of several context sizes."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from offerloom.llm.arrow import documents, id_and_text, longs, pieces
from offerloom.llm.bpe import END_ID, library_encoder

#: Context sizes, longest first; all powers of two.
TIERS = (1024, 512, 256, 128)

#: A sequence number holds the partition above this bit and the place in the partition below it.
PARTITION_BIT = 40

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long, ids binary"
)


class _Gaps:
    """Pieces waiting to fill gaps, by length; takes the longest that fits, and cuts one only when none does."""

    def __init__(self):
        self.lengths: list[int] = []  # sorted
        self.by_length: dict[int, list] = {}
        self.total = 0

    def add(self, piece) -> None:
        length = piece[2]
        waiting = self.by_length.get(length)
        if waiting is None:
            bisect.insort(self.lengths, length)
            waiting = self.by_length[length] = []
        waiting.append(piece)
        self.total += length

    def take(self, room: int):
        """A piece of at most ``room`` tokens; the rest of a cut piece waits on."""
        at = bisect.bisect_right(self.lengths, room) - 1
        length = self.lengths[max(at, 0)]
        waiting = self.by_length[length]
        piece = waiting.pop()
        if not waiting:
            del self.by_length[length]
            self.lengths.pop(max(at, 0))
        self.total -= length
        if length > room:
            doc, start, _ = piece
            self.add((doc, start + room, length - room))
            piece = (doc, start, room)
        return piece


class TierPacker:
    """Packs the documents of one partition; what cannot fill a window waits for the next documents.

    A document is routed to tiers by its length: whole windows of the longest size are cut off, and the rest goes to
    the shortest tier that holds it. A rest opens a window of its tier if it fills more than half of it; rests below
    half the shortest tier wait as fillers. Gaps are filled from shorter tiers, longest piece first.
    """

    def __init__(self, tiers=TIERS, group_tokens: int | None = None):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.open: dict[int, list] = {size: [] for size in self.tiers}
        self.fillers = _Gaps()
        #: Step groups hold equally many tokens: so many windows of the longest size, or their equal in shorter ones.
        self.group_tokens = group_tokens or 16 * self.tiers[0]
        self.group = dict.fromkeys(self.tiers, None)
        self.groups = 0

    def add(self, doc, length: int):
        """Yields the windows that are whole at once."""
        longest, shortest = self.tiers[0], self.tiers[-1]
        whole = length - length % longest
        for start in range(0, whole, longest):
            yield longest, [(doc, start, longest)]
        rest = length - whole
        if not rest:
            return
        if rest <= shortest // 2:
            self.fillers.add((doc, whole, rest))
            return
        tier = min(size for size in self.tiers if size >= rest)
        if tier == rest:
            yield tier, [(doc, whole, rest)]
        else:
            self.open[tier].append((doc, whole, rest))

    def flush(self, last: bool = False):
        """Fills the open windows, longest tier first, from fillers and then from the open pieces of shorter tiers."""
        if not last:
            kept = self.fillers.total // 2  # fillers for the documents to come
        for n, tier in enumerate(self.tiers):
            waiting, self.open[tier] = sorted(self.open[tier], key=lambda piece: piece[2]), []
            while waiting:
                piece = waiting.pop()
                window, room = [piece], tier - piece[2]
                while room:
                    if not self.fillers.total:
                        shorter = next((self.open[size] for size in self.tiers[n + 1 :] if self.open[size]), waiting)
                        if not shorter:
                            break
                        self.fillers.add(shorter.pop(0) if shorter is waiting else shorter.pop())
                    window.append(self.fillers.take(room))
                    room -= window[-1][2]
                if room and not last:
                    for left in window:
                        self.fillers.add(left)
                else:
                    yield tier, window
        longest = self.tiers[0]
        while self.fillers.total and (last or self.fillers.total >= longest + kept):
            window, room = [], longest
            while room and self.fillers.total:
                window.append(self.fillers.take(room))
                room -= window[-1][2]
            yield longest, window

    def group_of(self, tier: int) -> int:
        """The step group of the next window of a tier."""
        group = self.group[tier]
        if group is None or group[1] + tier > self.group_tokens:
            group = self.group[tier] = [self.groups, 0]
            self.groups += 1
        group[1] += tier
        return group[0]


def pack(docs: DataFrame, path: str, tiers=TIERS, with_ids: bool = True) -> DataFrame:
    """A row for each piece of a document, with the sequence that holds it and its place there.

    Each partition packs its own documents in the order it reads them, so nothing is shuffled and memory holds the
    token ids of one batch and of the pieces that wait. A null text is empty and has its end id only; a null id stays
    null; repeated rows are packed as often as they come; an empty table gives no rows; extra columns are ignored.
    A long text is cut into windows. At most two windows of a partition are not full.
    """
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    names = names if with_ids else names[:-1]

    def step(batches):
        encoder = library_encoder(path)
        packer = TierPacker(tiers)
        base = TaskContext.get().partitionId() << PARTITION_BIT
        sequences = 0
        held: dict[int, list] = {}  # document number -> id, tokens, ids
        number = 0

        def rows(windows):
            nonlocal sequences
            out = {name: [] for name in names}
            for tier, window in windows:
                offset, group = 0, base + packer.group_of(tier)
                for doc, start, length in window:
                    doc_id, ids = held[doc]
                    part = ids[start : start + length].tobytes()
                    row = (doc_id, start, length, zlib.crc32(part), len(ids), base + sequences, offset, tier, group, part)
                    for name, value in zip(names, row, strict=False):
                        out[name].append(value)
                    offset += length
                sequences += 1
            types = {"ids": pa.binary(), "tier": pa.int32()}
            return pa.RecordBatch.from_arrays([pa.array(out[n], types.get(n, pa.int64())) for n in names], names)

        for piece in pieces(batches):
            ids, counts = encoder.encode(piece.column("text").to_pylist())
            begins = np.cumsum(counts) - counts
            windows = []
            for doc_id, begin, count in zip(piece.column("doc_id").to_pylist(), begins.tolist(), counts.tolist(), strict=True):
                own = np.empty(count + 1, "<u4")
                own[:count], own[count] = ids[begin : begin + count], END_ID
                held[number] = (doc_id, own)
                windows += packer.add(number, count + 1)
                number += 1
            windows += packer.flush()
            yield rows(windows)
            waiting = {p[0] for open_ in packer.open.values() for p in open_}
            waiting |= {p[0] for group in packer.fillers.by_length.values() for p in group}
            held = {doc: held[doc] for doc in waiting}
        yield rows(packer.flush(last=True))

    schema = SCHEMA if with_ids else SCHEMA.rpartition(",")[0]
    return id_and_text(docs).mapInArrow(step, schema)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


QUERIES = {"op10_pack": op10_pack}
SQL: dict[str, str] = {}
