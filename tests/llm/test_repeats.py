import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from offerloom.llm import substrings, suffixes
from tests.llm.conftest import ODD

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_words(rows, window):
    texts = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    least = {}
    for i, words in texts:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if i is not None:
                least[key] = min(i, least.get(key, i))
    out = []
    for i, words in texts:
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and least[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = defaultdict(int)
    for _, data in texts:
        for k in range(len(data) - length + 1):
            seen[data[k : k + length]] += 1
    out = []
    for i, data in texts:
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if seen[data[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def mixture(seed, n, words=400):
    """Texts that share passages of many lengths, with edits, long runs of one word, and copies."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 120))] for _ in range(6)]
    rows = list(ODD)
    for k in range(n):
        own = []
        while len(own) < rng.randint(0, words):
            kind = rng.random()
            if kind < 0.5:
                part = list(rng.choice(passages))
                begin = rng.randrange(len(part))
                part = part[begin : begin + rng.randint(1, 100)]
                if rng.random() < 0.3:
                    part[rng.randrange(len(part))] = "edit"
            elif kind < 0.6:
                part = [rng.choice(vocabulary)] * rng.randint(1, 60)
            else:
                part = [rng.choice(vocabulary) + str(rng.randrange(1000)) for _ in range(rng.randint(1, 30))]
            own += part
        rows.append((1000 + rng.randrange(10**6), rng.choice([" ", "\n", "  "]).join(own)))
    rows += [(7_000_000 + k, rows[-1][1]) for k in range(5)]
    return rows


@pytest.mark.parametrize("seed,window,width", [(1, 13, 9), (2, 13, 9), (3, 4, 2)])
def test_substrings(docs, seed, window, width):
    rows = mixture(seed, 60)
    got = substrings.remove_repeats(docs(rows).repartition(3), window, width).collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == brute_words(rows, window)
    for r in got:
        words = WORD.findall(r.kept_text)
        assert hashlib.sha256(" ".join(words).encode()).hexdigest() == r.kept_sha256


def test_substrings_of_nothing(docs):
    assert substrings.remove_repeats(docs([])).count() == 0


@pytest.mark.parametrize("seed,length,width", [(1, 400, 192), (2, 60, 20), (3, 60, 60)])
def test_suffixes(docs, seed, length, width):
    rows = mixture(seed, 40)
    got = suffixes.remove_repeats(docs(rows).repartition(3), length, width).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute_bytes(rows, length)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_suffixes_of_nothing(docs):
    assert suffixes.remove_repeats(docs([])).count() == 0
