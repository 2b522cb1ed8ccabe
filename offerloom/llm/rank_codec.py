"""Byte-level BPE encoding and decoding by a serialised sentencepiece model."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from offerloom.llm.arrow import documents, id_and_text, pieces
from offerloom.llm.bpe import rank_coder

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _coded(batches, path):
    """(piece, ids of each text, bytes decoded from them)."""
    coder = rank_coder(path)
    for piece in pieces(batches):
        ids, counts = coder.encode(piece.column("text").to_pylist())
        decoded, per_id = coder.decode(ids)
        ends = np.cumsum(counts)
        at = np.concatenate([[0], np.cumsum(per_id)])
        ids = ids.astype("<u4")
        bounds = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
        yield piece, counts, [ids[a:b].tobytes() for a, b in bounds], [decoded[at[a] : at[b]].tobytes() for a, b in bounds]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Ids (little-endian unsigned 32-bit) of each text by the ranks in ``path``, and the bytes they decode to.

    A null text is empty: no ids. Each row is coded alone: repeated rows give repeated rows, a null id stays null,
    an empty table gives none, further columns are ignored. One narrow step, no shuffle.
    """

    def step(batches):
        for piece, counts, ids, decoded in _coded(batches, path):
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return id_and_text(docs).mapInArrow(step, SCHEMA)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``encode_decode`` with a digest in place of ids and bytes."""

    def step(batches):
        for piece, counts, ids, decoded in _coded(batches, path):
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs).mapInArrow(step, DIGESTS)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
SQL: dict[str, str] = {}
