"""Byte-level BPE of whole texts with vocabularies of public tokenizers, remembering what was encoded before.

A text is cut at its spaces. A piece that follows a space, and neither begins nor ends in white space, is encoded
alone with that space: the split pattern puts a boundary in front of it whatever stands around it. Each worker
remembers the ids of the pieces it has met, in a memory of bounded size that starts anew when it is full; a text in
which white space meets a space is split by the pattern as a whole.
"""

from __future__ import annotations

import base64
import functools
from array import array

import numpy as np
import regex
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from offerloom.llm.arrow import gather

#: Pieces and pre-tokens in one of the two generations that a worker remembers (about 400 MB in all); results do not
#: depend on it.
REMEMBERED = 600_000

#: The pattern that splits text before the merges: a fixed value of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

END_ID = 0

#: Marks that often end a word; each is a pre-token after letters.
MARKS = frozenset(".,;:!?")


def byte_letters() -> list[str]:
    """A visible character for each byte, as byte-level vocabularies write them: printable Latin-1 as it is, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def letters_of(text: str, table: dict[int, str]) -> str:
    if text.isascii() and text.isprintable():  # only the space has another letter
        return text.replace(" ", table[0x20])
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(table)


class _Memory(dict):
    """A dict that fills what is missing with ``fill(key)``."""

    def __init__(self, fill):
        super().__init__()
        self.fill = fill

    def __missing__(self, key):
        value = self[key] = self.fill(key)
        return value


class _Generation:
    """Pre-tokens (their ids as bytes) and pieces (a place in the pool of ids) met since the memory was last renewed."""

    def __init__(self, encoder: PieceEncoder):
        self.words = _Memory(encoder.word)
        self.pieces = _Memory(encoder.piece)
        self.pool = array("I")
        self.starts = array("q", [0])

    def store(self, ids: bytes) -> int:
        self.pool.frombytes(ids)
        self.starts.append(len(self.pool))
        return len(self.starts) - 2


class PieceEncoder:
    """Ids of texts; ``encode_word`` gives those of one pre-token, ``encode_text`` those of a text that holds one of ``added``.

    Two generations are kept: what the older one knows moves to the newer when met again, and when the newer is full
    the older goes.
    """

    def __init__(self, encode_word, remembered: int = REMEMBERED, added: tuple[str, ...] = (), encode_text=None):
        self.split = regex.compile(PATTERN).findall
        self.encode_word = encode_word
        self.added = added
        self.encode_text = encode_text
        self.remembered = remembered
        self.new = self.old = _Generation(self)

    def word(self, word: str) -> bytes:
        known = self.old.words.get(word)
        return array("I", self.encode_word(word)).tobytes() if known is None else known

    def piece(self, piece: str) -> int:
        """The place of the ids of a space and the piece; -1 if they cannot stand alone."""
        old = self.old
        known = old.pieces.get(piece) if old is not self.new else None
        if known is not None:
            return known if known < 0 else self.new.store(old.pool[old.starts[known] : old.starts[known + 1]].tobytes())
        if piece.isalpha():
            return self.new.store(self.new.words[" " + piece])
        if piece[-1:] in MARKS and piece[:-1].isalpha():  # a word and a mark: what the pattern makes of them
            return self.new.store(self.new.words[" " + piece[:-1]] + self.new.words[piece[-1]])
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return -1
        return self.new.store(self.whole(" " + piece))

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.new.words.__getitem__, self.split(text)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.new.pieces) > self.remembered or len(self.new.words) > self.remembered:
            self.old, self.new = self.new, _Generation(self)
        new = self.new
        units: list[str] = []
        firsts, sizes = [], []
        for text in texts:
            special = any(token in text for token in self.added)
            parts = [""] if special else text.split(" ")
            firsts.append(None if special else parts[0])
            parts[0] = "a"  # any known piece; replaced below
            sizes.append(len(parts))
            units += parts
        codes = np.fromiter(map(new.pieces.__getitem__, units), np.int64, len(units))
        begins = np.cumsum(sizes) - sizes
        odd = np.minimum.reduceat(codes, begins) < 0
        known, used = len(new.starts), len(new.pool)
        for k, (text, first) in enumerate(zip(texts, firsts, strict=True)):
            if first is None:
                codes[begins[k]] = new.store(array("I", self.encode_text(text)).tobytes())
                continue
            if not first or first[-1].isspace():
                odd[k] = True
            codes[begins[k]] = new.store(self.whole(text if odd[k] else first))
        bounds, pool = np.frombuffer(new.starts, np.int64), np.frombuffer(new.pool, np.uint32)
        counts = bounds[codes + 1] - bounds[codes]
        alone = np.repeat(odd, sizes)
        alone[begins] = False
        counts[alone] = 0
        ids = gather(pool, bounds[codes], counts)
        del bounds, pool  # so that the arrays can shrink: ids of whole texts are not kept
        del new.starts[known:], new.pool[used:]
        return ids, np.add.reduceat(counts, begins)


@functools.cache
def library_encoder(path: str) -> PieceEncoder:
    """By the tokenizers library: pre-tokens go to its BPE model, texts that hold an added token to the whole of it."""
    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    table = dict(enumerate(byte_letters()))
    return PieceEncoder(
        lambda word: [token.id for token in model.tokenize(letters_of(word, table))],
        added=tuple(token.content for token in tokenizer.get_added_tokens_decoder().values()),
        encode_text=lambda text: tokenizer.encode(text, add_special_tokens=False).ids,
    )


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def piece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model: a byte-mapped piece for each token, scored by its negative rank, identity normalisation."""
    letters = byte_letters()
    proto = sentencepiece_model_pb2.ModelProto()
    piece = sentencepiece_model_pb2.ModelProto.SentencePiece
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        proto.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank), type=piece.NORMAL)
    proto.pieces.add(piece="<unk>", score=0.0, type=piece.UNKNOWN)
    proto.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.BPE
    proto.trainer_spec.vocab_size = len(proto.pieces)
    proto.trainer_spec.unk_id = len(proto.pieces) - 1
    proto.trainer_spec.bos_id = proto.trainer_spec.eos_id = proto.trainer_spec.pad_id = -1
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = False
    proto.normalizer_spec.remove_extra_whitespaces = False
    proto.normalizer_spec.escape_whitespaces = False
    return proto.SerializeToString()


class RankCoder:
    """Encodes by ranks through sentencepiece, decodes by the inverse mapping."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        ordered = sorted(ranks, key=ranks.get)
        self.rank_of_piece = np.array([ranks[token] for token in ordered], np.uint32)
        model = sentencepiece.SentencePieceProcessor(model_proto=piece_model(ranks))
        table = dict(enumerate(byte_letters()))

        def encode_word(word: str) -> list[int]:
            whole = ranks.get(word.encode("utf-8", "surrogatepass"))
            if whole is not None:  # a pre-token that is a token needs no merges
                return [whole]
            return self.rank_of_piece[model.encode(letters_of(word, table))].tolist()

        self.encoder = PieceEncoder(encode_word)
        lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        by_rank = {rank: token for token, rank in ranks.items()}
        self.bytes = np.frombuffer(b"".join(by_rank.get(r, b"") for r in range(len(lengths))), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(texts)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, one after the other, and how many each id has."""
        counts = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return self.bytes[at], counts


@functools.cache
def rank_coder(path: str) -> RankCoder:
    return RankCoder(path)
