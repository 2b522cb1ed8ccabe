import random
import re
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_divergence, test_line_join, test_simhash
from tests.llm.conftest import ODD

WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus():
    """Documents that pass the rules, with shared lines, near copies and shared passages, and some that do not."""
    rng = random.Random(7)
    plain = ["the", "of", "and", "to", "in", "a", "is", "that"]
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(400)]

    def words(n):
        return [rng.choice(plain) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]

    lines = [" ".join(words(rng.randint(6, 30))) for _ in range(15)]
    passages = [words(40) for _ in range(4)]
    rows = [(None if r[0] is None else r[0], r[1], r[2] if len(r) > 2 else "en") for r in ODD]
    for k in range(40):
        own = [" ".join(words(rng.randint(5, 40))) for _ in range(rng.randint(3, 8))]
        own.insert(rng.randrange(len(own)), rng.choice(lines))
        if k % 3 == 0:
            own.append(" ".join(words(4) + rng.choice(passages) + words(4)))
        rows.append((100 + k, "\n".join(own), "en"))
        if k % 5 == 0:  # copies whose lines are broken elsewhere, so that line dedup leaves them
            every = WORD.findall(rows[-1][1])
            rows.append((1000 + k, "\n".join(" ".join(every[i : i + 4]) for i in range(0, len(every), 4)), "en"))
            rows.append((2000 + k, "\n".join(" ".join(every[i : i + 3]) for i in range(0, len(every), 3)), "en"))
        if k == 6:
            rows.append((3000 + k, "!!! ".join(w.upper() for w in words(90)), "en"))
    return rows


def without_passages(rows):
    least = {}
    for i, text, _ in rows:
        words = WORD.findall(text or "")
        for k in range(len(words) - 12):
            if i is not None:
                key = tuple(words[k : k + 13])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, text, lang in rows:
        words = WORD.findall(text or "")
        gone = set()
        for k in range(len(words) - 12):
            if i is not None and least[tuple(words[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        parts = re.findall("[^\x20\x09-\x0d]+[\x20\x09-\x0d]*", text or "")
        head = re.match("[\x20\x09-\x0d]*", text or "").group()
        out.append((i, head + "".join(p for k, p in enumerate(parts) if k not in gone), lang))
    return out


def brute(rows):
    """The rows after each of the first four stages."""
    verdict = dict.fromkeys([v[0] for v in test_divergence.brute(rows) if v[-1]])
    rows = [r for r in rows if r[0] in verdict]
    yield rows
    gone = test_line_join.brute(rows)
    rows = [
        (i, "\n".join(line for k, line in enumerate(text.split("\n")) if (i, k) not in gone), lang) for i, text, lang in rows
    ]
    yield rows
    prints = [test_simhash.brute_print(text) for _, text, _ in rows]
    roots = test_simhash.brute_components(prints, [r[0] for r in rows])
    rows = [r for r, root in zip(rows, roots) if r[0] is None or r[0] == root]
    yield rows
    yield without_passages(rows)


def test_stages_against_brute_force(spark, docs):
    rows = corpus()
    table = docs(rows)
    columns = table.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "substrings", "packing"]
    counts = [len(rows)]
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], brute(rows)):
        table = stage(spark, table, "")
        assert table.columns == columns
        got = [(r.doc_id, r.text) for r in table.collect()]
        assert sorted(got, key=str) == sorted([(i, text or "") for i, text, _ in want], key=str)
        counts.append(len(got))
        table = spark.createDataFrame(table.collect(), table.schema)
        rows = want
    assert counts[1] < counts[0] and counts[3] < counts[2]
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, table, "").collect()
    for i, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == ids.tobytes()
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in own)


def test_stages_of_nothing(spark, docs):
    table = docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, "").count() == 0
