"""Near-duplicates by SimHash: fingerprints meet at the anchor points of a covering code."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.arrow import documents, id_and_text, pieces, stored, text_buffers, within
from offerloom.llm.components import components
from offerloom.llm.hashing import LOWER, word_spans

#: Bits in which linked fingerprints may differ.
THRESHOLD = 4

#: The 64 bits in blocks: of two fingerprints within the threshold, one block differs in at most a third of it.
BLOCKS = ((0, 21), (21, 21), (42, 22))
BLOCK_THRESHOLD = THRESHOLD // len(BLOCKS)

#: Bits of a block under the covering code, a Hamming code of length 15 and radius 1; its other bits are anchors as they are.
CODE_BITS = 15
COVERING_RADIUS = 1


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, words_in_shingle: int, lower: bool = True) -> np.ndarray:
    """SimHash of each text: a bit is set if it is set in over half the XXH64 (seed 42) of its shingles."""
    if lower:
        data = LOWER[data]
    begins, ends, at = word_spans(data, offsets)
    fingerprints = np.zeros(len(offsets) - 1, np.uint64)
    raw = data.tobytes()
    digest = xxhash.xxh64_intdigest
    joined = _single_spaced(raw, data, begins, ends)
    for text in range(len(fingerprints)):
        first, last = int(at[text]), int(at[text + 1])
        if first == last:
            continue
        size = min(words_in_shingle, last - first)
        source, starts, stops = joined(first, last)
        hashes = [digest(source[a:b], 42) for a, b in zip(starts[: len(starts) - size + 1], stops[size - 1 :], strict=True)]
        fingerprints[text] = majority(np.array(hashes, np.uint64))
    return fingerprints


def _single_spaced(raw: bytes, data: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """Words first to last as bytes in which one space parts words: the text itself where that is so already."""
    gaps_ok = np.ones(len(begins), bool)
    if len(begins) > 1:
        gaps_ok[1:] = (begins[1:] - ends[:-1] == 1) & (data[ends[:-1]] == 0x20)
    bad = np.cumsum(~gaps_ok)

    def joined(first: int, last: int):
        if bad[last - 1] == bad[first]:
            return raw, begins[first:last].tolist(), ends[first:last].tolist()
        lengths = ends[first:last] - begins[first:last]
        stops = np.cumsum(lengths + 1) - 1
        words = [raw[a:b] for a, b in zip(begins[first:last].tolist(), ends[first:last].tolist(), strict=True)]
        return b" ".join(words), (stops - lengths).tolist(), stops.tolist()

    return joined


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, words_in_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t (a hash of the text) and fingerprint (long: the same 64 bits) of each row; a null or empty text has fingerprint 0."""

    def step(batches):
        for piece in pieces(batches):
            data, offsets = text_buffers(piece.column("text"))
            found = text_fingerprints(data, offsets, words_in_shingle)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("t"), pa.array(found.view(np.int64))], ["doc_id", "t", "fingerprint"])

    rows = id_and_text(docs, id_col, text_col).withColumn("t", F.xxhash64("text"))
    return rows.mapInArrow(step, "doc_id long, t long, fingerprint long")


def nearest_codeword(values: np.ndarray) -> np.ndarray:
    """The codeword within one bit: the syndrome names the bit to flip (0: none)."""
    syndrome = np.zeros_like(values)
    for bit in range(CODE_BITS):
        syndrome ^= np.where((values >> np.uint64(bit)) & np.uint64(1), np.uint64(bit + 1), np.uint64(0))
    flip = np.where(syndrome > 0, np.uint64(1) << (syndrome - np.uint64(1) * (syndrome > 0)), np.uint64(0))
    return values ^ flip


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is the row's own anchor) for every anchor within radius plus block threshold of each fingerprint.

    The own anchor is the codeword nearest in each block; the block's number stands in the top two bits.
    """
    rows, points, own = [], [], []
    reach = COVERING_RADIUS + BLOCK_THRESHOLD
    code = np.uint64((1 << CODE_BITS) - 1)
    for number, (shift, width) in enumerate(BLOCKS):
        block = (values >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        tag = np.uint64(number << 62)
        home = (block & ~code) | nearest_codeword(block & code)
        for flips in itertools.chain.from_iterable(itertools.combinations(range(width), k) for k in range(reach + 1)):
            moved = block ^ np.uint64(sum(1 << f for f in flips))
            at = np.flatnonzero(nearest_codeword(moved & code) == (moved & code))
            rows.append(at)
            points.append(moved[at] | tag)
            own.append(moved[at] == home[at])
    return np.concatenate(rows), np.concatenate(points), np.concatenate(own)


def forest(values: np.ndarray, homes: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links that join every pair within the threshold of which one is at home, as a forest: fewer links than points.

    Breadth first: a point is compared with the points not reached yet, so a dense cluster shrinks to nothing at once.
    """
    links: list[tuple[int, int]] = []
    waiting = np.ones(len(values), bool)
    for seed in np.flatnonzero(homes).tolist():
        if not waiting[seed]:
            continue
        waiting[seed] = False
        front = [seed]
        while front:
            p = front.pop()
            rest = np.flatnonzero(waiting if homes[p] else waiting & homes)
            hit = rest[np.bitwise_count(values[rest] ^ values[p]) <= threshold]
            waiting[hit] = False
            links += [(p, q) for q in hit.tolist()]
            front += hit.tolist()
    return links


#: Pairs compared in one numpy step.
STEP_PAIRS = 1 << 20


def anchor_links(points: np.ndarray, values: np.ndarray, homes: np.ndarray, threshold: int = THRESHOLD):
    """(value, value) links found at each anchor; rows come sorted by anchor, whole groups only.

    Every fingerprint at home is compared with all that were sent there. A group is linked as a forest as soon as it has
    many more hits than members, so no more than those are kept.
    """
    begins = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1]]))
    sizes = np.diff(np.append(begins, len(points)))
    group = np.repeat(np.arange(len(begins)), sizes)
    at_home = np.flatnonzero(homes)
    hits = np.zeros(len(begins), np.int64)
    dense = np.zeros(len(begins), bool)
    left, right = [], []
    work = np.cumsum(sizes[group[at_home]])
    begin = 0
    while begin < len(at_home):
        base = work[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(work, base + STEP_PAIRS)))
        mine = at_home[begin:end]
        mine = mine[~dense[group[mine]]]
        counts = sizes[group[mine]]
        a = np.repeat(mine, counts)
        b = np.repeat(begins[group[mine]], counts) + within(counts)
        near = (np.bitwise_count(values[a] ^ values[b]) <= threshold) & (a != b)
        a, b = a[near], b[near]
        hits += np.bincount(group[a], minlength=len(hits))
        dense = hits > 4 * sizes
        plain = ~dense[group[a]]
        left.append(a[plain])
        right.append(b[plain])
        begin = end
    a = np.concatenate(left) if left else at_home[:0]
    b = np.concatenate(right) if right else at_home[:0]
    plain = ~dense[group[a]]
    a, b = a[plain], b[plain]
    for g in np.flatnonzero(dense).tolist():
        part = slice(begins[g], begins[g] + sizes[g])
        links = np.array(forest(values[part], homes[part], threshold), np.int64).reshape(-1, 2) + begins[g]
        a, b = np.append(a, links[:, 0]), np.append(b, links[:, 1])
    low, high = np.minimum(values[a], values[b]), np.maximum(values[a], values[b])
    return np.unique(np.stack([low, high], axis=1), axis=0) if len(low) else np.zeros((0, 2), np.uint64)


def whole_groups(batches, key: str, rows: int = 1 << 16):
    """Batches sorted by ``key`` joined and cut so that no key is parted."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        cut = int(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[-1])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        size = 0
    if held:
        yield pa.Table.from_batches(held)


def linked(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (long) that differ in few enough bits.

    Anchor-point covering: in each block the codewords of a covering code are anchors; a fingerprint is sent to every
    anchor within radius plus threshold (about 44 rows) and compared where another one is at home. Links of one group
    are at most four times its members.
    """

    def spread(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                values = batch.column("fingerprint").slice(k, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                rows, points, own = anchors(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(points.view(np.int64)), pa.array(values[rows].view(np.int64)), pa.array(own)],
                    ["anchor", "fingerprint", "own"],
                )

    def meet(batches):
        for table in whole_groups(batches, "anchor"):
            values = table.column("fingerprint").to_numpy().view(np.uint64)
            links = anchor_links(table.column("anchor").to_numpy(), values, table.column("own").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [pa.array(links[:, 0].copy().view(np.int64)), pa.array(links[:, 1].copy().view(np.int64))], ["a", "b"]
            )

    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Few bytes become many: dealt by number, or they would be joined into a task or two.
    dealt = distinct.select("fingerprint").repartition(partitions, "fingerprint")
    spread_out = dealt.mapInArrow(spread, "anchor long, fingerprint long, own boolean")
    return spread_out.repartition(partitions, "anchor").sortWithinPartitions("anchor").mapInArrow(meet, "a long, b long").distinct()


def _rooted(docs: DataFrame, words_in_shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t, fingerprint, smallest (doc_id under this fingerprint) and root of each row."""
    prints = stored(fingerprints(docs, words_in_shingle, id_col, text_col), "fingerprints")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest"))
    roots = components(linked(classes))
    rooted = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "smallest", F.coalesce("root", "fingerprint").alias("root")
    )
    return prints.join(stored(rooted, "roots"), "fingerprint")


def near_duplicates(docs: DataFrame, words_in_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of each row.

    Texts without words have fingerprint 0 and link like any other. Equal fingerprints are one class from the start,
    so copies are never paired. Rows that share an id keep a row each; a null id gets a row, and counts in no
    component's smallest id; an empty table gives none. Extra columns are ignored.
    """
    rows = _rooted(docs, words_in_shingle, id_col, text_col)
    least = rows.groupBy("root").agg(F.min("smallest").alias("component_id"))
    return rows.join(least, "root").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, words_in_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``: of those with its smallest id, the one with the least hash of its text.

    Copies are told by their text alone: rows that share an id but whose texts are not linked are components of their
    own and stay; repeated rows are one. Rows with a null id stay. The row travels inside a struct, so its columns may
    have any name; an empty table gives no rows.
    """
    found = _rooted(docs, words_in_shingle, id_col, text_col).filter("doc_id IS NOT NULL")
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("kept")).select("kept.*").distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"))
    single = rows.join(kept, ["doc_id", "t"], "left_semi").groupBy("doc_id", "t").agg(F.first("row").alias("row"))
    return single.select("row").union(rows.filter("doc_id IS NULL").select("row")).select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


QUERIES = {"op3_simhash": op3_simhash}
SQL: dict[str, str] = {}
