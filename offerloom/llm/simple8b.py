"""Token ids in word-aligned blocks: 64-bit words whose selector says how many ids of how many bits they hold."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.arrow import documents, id_and_text, longs, pieces, within
from offerloom.llm.bpe import END_ID, library_encoder
from offerloom.session import work_path

#: (ids in a word, bits of each) by selector; the selector stands in the top four bits. Selector 0 is the escape:
#: the next word holds one id of up to 64 bits as it is.
LAYOUTS = ((1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 0
_COUNTS = np.array([count for count, _ in LAYOUTS], np.int64)

#: Ids in a block; the words of each block can be read alone.
BLOCK_IDS = 1 << 16

#: Documents are laid out over about as many files as there are multiples of this many bytes of text.
FILE_TEXT_BYTES = 16 << 20


def encode_block(ids: np.ndarray) -> np.ndarray:
    """The words of one block, as many ids in each as fit."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    choice = np.zeros(n, np.int64)  # of the word that would begin here
    largest, size = ids, 1  # the largest of each ``size`` ids in a row
    for selector in range(len(LAYOUTS) - 1, 0, -1):  # from one id in a word to sixty
        count, bits = LAYOUTS[selector]
        if count > n:
            break
        if count > size:
            largest, size = np.maximum(largest[: n - count + 1], largest[count - size :]), count
        choice[: n - count + 1][largest < np.uint64(1 << bits)] = selector
    steps = _COUNTS[choice].tolist()
    begins, at = [], 0
    while at < n:
        begins.append(at)
        at += steps[at]
    begins = np.array(begins, np.int64)
    chosen = choice[begins] if n else np.zeros(0, np.int64)
    escaped = chosen == ESCAPE
    words = np.zeros(len(begins) + int(escaped.sum()), np.uint64)
    places = np.arange(len(begins)) + np.cumsum(escaped) - escaped
    for selector in np.unique(chosen):
        mine = chosen == selector
        if selector == ESCAPE:
            words[places[mine] + 1] = ids[begins[mine]]
            continue
        count, bits = LAYOUTS[selector]
        packed = np.full(int(mine.sum()), np.uint64(int(selector) << 60))
        for k in range(count):
            packed |= ids[begins[mine] + k] << np.uint64(k * bits)
        words[places[mine]] = packed
    return words


def decode_words(words: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
    """The ids in the words of whole blocks; all words of a selector at once."""
    words = np.asarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    # A raw word follows each escape and is no selector; raw words may look like escapes, so they are told in order.
    raw = np.zeros(len(words), bool)
    last = -1
    for at in np.flatnonzero(selectors == ESCAPE).tolist():
        if at != last:
            last = at + 1
            raw[last] = True
    heads = np.flatnonzero(~raw)
    counts = _COUNTS[selectors[heads]]
    begins = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), np.uint64)
    chosen = selectors[heads]
    for selector in np.unique(chosen):
        mine = chosen == selector
        if selector == ESCAPE:
            ids[begins[mine]] = words[heads[mine] + 1]
            continue
        count, bits = LAYOUTS[selector]
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            ids[begins[mine] + k] = (words[heads[mine]] >> np.uint64(k * bits)) & mask
    return ids


def encode_ids(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, and the word at which each block begins (one more at the end)."""
    parts = [encode_block(ids[k : k + block]) for k in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, parts)])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offsets


def decode_range(words: np.ndarray, offsets: np.ndarray, begin: int, end: int, block: int = BLOCK_IDS) -> np.ndarray:
    """Ids ``begin`` to ``end``, from the blocks that hold them only."""
    if begin >= end:
        return np.zeros(0, np.uint64)
    first, last = begin // block, (end - 1) // block
    ids = decode_words(words[offsets[first] : offsets[last + 1]])
    return ids[begin - first * block : end - first * block]


#: ``begins``: ids of the same file before the segment.
FILE_SCHEMA = "file_no int, begins long, n_ids long, doc_ids binary, doc_tokens binary, block_offsets binary, words binary"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), [field.split()[0] for field in schema.split(", ")])


def _binary(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def write_ids(docs: DataFrame, path: str, vocabulary: str, text_bytes: int = FILE_TEXT_BYTES) -> None:
    """Ids of all texts, an end id after each, in files in ascending order of doc_id.

    A file is a range of doc_ids (sampled splitters) and a sequence of segments; a segment holds the ids of some
    documents one after the other: their doc_ids, how many ids each has, the words, and the word at which each block
    begins. A null text is empty and has its end id only; a null id stands first; rows that share an id stand
    together, in the order of their texts; an empty table gives no segments. Extra columns are ignored. The number
    of ranges follows the input, at most 100,000.
    """
    rows = id_and_text(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, min(100_000, -(-int(total) // text_bytes)))

    def step(batches):
        encoder = library_encoder(vocabulary)
        file_no, before = TaskContext.get().partitionId(), 0
        for piece in pieces(batches):
            ids, counts = encoder.encode(piece.column("text").to_pylist())
            begins = np.cumsum(counts) - counts
            whole = np.full(len(ids) + len(counts), END_ID, np.uint32)
            whole[within(counts) + np.repeat(begins + np.arange(len(counts)), counts)] = ids
            words, offsets = encode_ids(whole)
            missing = piece.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc_ids = longs(piece.column("doc_id"))
            yield _batch(
                FILE_SCHEMA,
                pa.array([file_no], pa.int32()),
                pa.array([before], pa.int64()),
                pa.array([len(whole)], pa.int64()),
                pa.array([_binary(doc_ids, "<i8") + _binary(missing, "u1")], pa.binary()),
                pa.array([_binary(counts + 1, "<i8")], pa.binary()),
                pa.array([_binary(offsets, "<i8")], pa.binary()),
                pa.array([_binary(words, "<u8")], pa.binary()),
            )
            before += len(whole)

    (
        rows.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(step, FILE_SCHEMA)
        .write.parquet(path)
    )


READ_SCHEMA = "file_no int, in_file long, doc_id long, n_tokens long, ids_crc32 long"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Each document of the files: ``start``, the ids of all documents before it; how many ids it has; their checksum."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)

    def step(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens = np.frombuffer(row["doc_tokens"], "<i8")
                n = len(tokens)
                doc_ids = np.frombuffer(row["doc_ids"], "<i8", n)
                missing = np.frombuffer(row["doc_ids"], np.uint8, offset=8 * n).astype(bool)
                offsets = np.frombuffer(row["block_offsets"], "<i8")
                ids = decode_range(np.frombuffer(row["words"], "<u8"), offsets, 0, row["n_ids"])
                data = memoryview(_binary(ids, "<u4"))
                ends = np.cumsum(tokens)
                begins = ends - tokens
                yield _batch(
                    READ_SCHEMA,
                    pa.array(np.full(n, row["file_no"]), pa.int32()),
                    pa.array(begins + row["begins"], pa.int64()),
                    pa.array(doc_ids, pa.int64(), mask=missing),
                    pa.array(tokens, pa.int64()),
                    pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64()),
                )

    # One row for each file, and there are at most 100,000: small enough for one window and a broadcast.
    sizes = files.groupBy("file_no").agg(F.sum("n_ids").alias("n_ids"))
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file_no", before.alias("before"))
    return files.mapInArrow(step, READ_SCHEMA).join(F.broadcast(starts), "file_no").select(
        "doc_id", (F.col("before") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32"
    )


def op6_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-ids")
    write_ids(documents(spark, sf_dir, "doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path)


QUERIES = {"op6_simple8b": op6_simple8b}
SQL: dict[str, str] = {}
