import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from offerloom.llm import bpe, packing, rank_codec, simple8b
from tests.llm.conftest import ODD

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def test_pattern_is_that_of_the_vocabularies():
    assert bpe.PATTERN == P.PATTERN


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(JSON)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab 's1é\n\t 日.😀", max_size=30), max_size=6))
def test_pieces_encode_as_whole_texts(texts):
    tokenizer = Tokenizer.from_file(JSON) if not hasattr(test_pieces_encode_as_whole_texts, "t") else test_pieces_encode_as_whole_texts.t
    test_pieces_encode_as_whole_texts.t = tokenizer
    ids, counts = bpe.library_encoder(JSON).encode(texts)
    assert counts.tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert ids.tolist() == [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids]


def test_added_tokens_in_texts(spark, docs, library, tmp_path):
    assert library("one <|endoftext|> two") == [505, 220, 50256, 734]
    end = "<|endoftext|>"
    texts = [f"one {end} two", "one two", end, f"{end}{end} a", f"a{end}\n b", f"é \n {end}", "<|endoftext| >", f" x  {end[:-1]}", ""]
    ids, counts = bpe.library_encoder(JSON).encode(texts)
    assert counts.tolist() == [len(library(t)) for t in texts]
    assert ids.tolist() == [i for t in texts for i in library(t)]
    table = docs(list(enumerate(texts)))
    simple8b.write_ids(table, str(tmp_path / "ids"), JSON)
    start, want = 0, []
    for k, text in enumerate(texts):
        own = np.array([*library(text), 0], "<u4")
        want.append((k, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert [tuple(r) for r in simple8b.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()] == want
    check_packed(packing.pack(table.coalesce(1), JSON).collect(), {k: [t] for k, t in enumerate(texts)}, library, 1024)


def test_a_full_memory_starts_anew(library):
    encoder = bpe.library_encoder(JSON)
    small = bpe.PieceEncoder(encoder.encode_word, remembered=3)
    for text in ("one two three four five", "one  two\nthree", "six seven"):
        assert small.encode([text])[0].tolist() == library(text)


def test_rank_codec(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = docs(ODD)
    got = sorted(map(tuple, rank_codec.digests(table, RANKS).collect()), key=str)
    want = []
    for row in table.collect():
        ids = np.array(encoding.encode_ordinary(row.text or ""), "<u4")
        digest = hashlib.sha256((row.text or "").encode()).hexdigest()
        want.append((row.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), digest))
    assert got == sorted(want, key=str)
    assert all(bytes(r.decoded) == (r.decoded or b"") for r in rank_codec.encode_decode(table, RANKS).collect())
    assert rank_codec.digests(docs([]), RANKS).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=200), st.integers(1, 50))
def test_simple8b_round_trip(values, block):
    ids = np.array(values, np.uint64)
    words, offsets = simple8b.encode_ids(ids, block)
    assert simple8b.decode_words(words).tolist() == values
    begin, end = len(values) // 3, 2 * len(values) // 3
    assert simple8b.decode_range(words, offsets, begin, end, block).tolist() == values[begin:end]


def test_files_of_ids(spark, docs, library, tmp_path):
    table = docs(ODD)
    simple8b.write_ids(table, str(tmp_path / "ids"), JSON, text_bytes=4000)
    got = [tuple(r) for r in simple8b.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()]
    rows = sorted(table.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, want = 0, []
    for row in rows:
        ids = np.array([*library(row.text or ""), 0], "<u4")
        want.append((row.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    simple8b.write_ids(docs([]), str(tmp_path / "none"), JSON)
    assert simple8b.read_ids(spark, str(tmp_path / "none")).count() == 0


def check_packed(rows, texts, library, padding):
    """Each id in one piece; sequences gapless; little padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, copies in texts.items():
        want = np.array([*library(copies[0] or ""), 0], "<u4")
        own = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert all(r.doc_tokens == len(want) for r in own)
        assert sum(r.length for r in own) == len(want) * len(copies)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes())
    padded = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    assert padded <= padding


def test_packing(docs, library):
    table = docs(ODD).coalesce(1)
    texts = {}
    for row in table.collect():
        texts.setdefault(row.doc_id, []).append(row.text)
    check_packed(packing.pack(table, JSON).collect(), texts, library, 1024)
    assert packing.pack(docs([]), JSON).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60), st.integers(1, 20))
def test_tiers_fill_every_window_but_the_last(lengths, every):
    packer, windows = packing.TierPacker(), []
    for doc, length in enumerate(lengths):
        windows += packer.add(doc, length)
        if doc % every == 0:
            windows += packer.flush()
    windows += packer.flush(last=True)
    seen = {}
    for tier, window in windows:
        assert sum(p[2] for p in window) <= tier
        for doc, start, length in window:
            seen.setdefault(doc, []).append((start, start + length))
    assert len(seen) == len(lengths)
    for doc, spans in seen.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == lengths[doc]
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sum(sum(p[2] for p in w) < t for t, w in windows) <= 2
