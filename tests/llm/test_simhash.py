import random
import re
import tracemalloc

import numpy as np
import xxhash
from pyspark.sql import functions as F

from offerloom.llm import simhash
from offerloom.llm.components import components
from tests.llm.conftest import ODD


def brute_print(text, size=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(prints))]


def test_fingerprints_and_components(docs):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéFG") for _ in range(5)) for _ in range(300)]
    rows = list(ODD)
    for k in range(40):
        words = [rng.choice(vocabulary) for _ in range(120)]
        rows.append((100 + k, " ".join(words)))
        for c in range(3):
            words[rng.randrange(120)] = rng.choice(vocabulary)
            rows.append((300 + 3 * k + c, rng.choice(["  ", " \n"]).join(words)))
    table = docs(rows)
    got = simhash.near_duplicates(table).collect()
    prints = [brute_print(r[1]) for r in rows]
    want = list(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], brute_components(prints, [r[0] for r in rows])))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_one_row_of_each_component(spark):
    """Ids repeated with other texts, repeated rows, null ids, and columns of any name."""
    rng = random.Random(8)
    one, two = (" ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(90)) for _ in range(2))
    rows = [(1, one), (1, two), (1, one), (2, one + " x"), (3, two), (None, one), (None, None), (4, ""), (5, None), (6, "only this")]
    names = ["s_n", "s_id", "row", "t", "root", "kept", "q_row"]
    schema = f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}"
    table = spark.createDataFrame([(*r, *names) for r in rows], schema)
    got = simhash.one_of_each(table.repartition(3))
    assert got.columns == table.columns
    assert all(tuple(r)[2:] == tuple(names) for r in got.collect())
    texts = [r[1] for r in rows]
    parts = brute_components([brute_print(t) for t in texts], list(range(len(rows))))
    kept = {}
    for (doc, text), part in zip(rows, parts):
        if doc is not None:
            kept[part] = min(doc, kept.get(part, doc))
    assert len(set(parts[:5])) == 2
    found = sorted((r.doc_id, len(r.text or "")) for r in got.collect() if r.doc_id is not None)
    assert [f[0] for f in found] == sorted(kept.values())
    assert sorted(len(r.text or "") for r in got.collect() if r.doc_id == 1) == sorted((len(one), len(two)))
    assert sum(r.doc_id is None for r in got.collect()) == 2
    assert simhash.one_of_each(table.limit(0)).count() == 0


def test_anchors_lose_no_pair(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 300, np.uint64)
    extra = []
    for v in values[:150]:
        for bits in range(1, 7):
            extra.append(v ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, bits, replace=False))))
    center = values[0]
    dense = [center ^ np.uint64((1 << i) | (1 << j)) for i in range(40) for j in range(i)]
    values = np.unique(np.concatenate([values, np.array(extra, np.uint64), np.array(dense, np.uint64)]))
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    roots = {r.node: r.root for r in components(simhash.linked(frame)).collect()}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    signed = values.view(np.int64).tolist()
    label = brute_components([int(v) for v in values], signed)
    mine = [roots.get(v, v) for v in signed]
    assert near.sum() > len(values)
    assert mine == label


def test_links_of_a_dense_group_stay_few():
    rng = np.random.default_rng(2)
    values = np.unique(np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 500, np.uint64)))
    points, homes = np.zeros(len(values), np.uint64), np.ones(len(values), bool)
    assert len(simhash.anchor_links(points, values, homes)) == len(values) - 1


def test_links_of_a_dense_group_are_not_kept(monkeypatch):
    monkeypatch.setattr(simhash, "STEP_PAIRS", 1 << 16)
    values = np.array([(1 << i) | (1 << j) for i in range(64) for j in range(i + 1)], np.uint64)  # all within 4 bits
    points, homes = np.zeros(len(values), np.uint64), np.ones(len(values), bool)
    tracemalloc.start()
    links = simhash.anchor_links(points, values, homes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == len(values) - 1
    assert peak < 20 << 20


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(100)}}
    assert components(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0
