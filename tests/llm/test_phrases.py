import random
import re
from collections import Counter

import numpy as np

from offerloom.llm import phrases
from tests.llm.conftest import ODD


def brute(rows, top=phrases.TOP):
    counts, totals = Counter(), Counter()
    for _, text, *more in rows:
        lang = (more[0] if more else "en") or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= 30}
    rows = []
    for (lang, words), a in found.items():
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((2000000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        inside = any(
            g == lang and len(q) > len(words) and 100 * f >= 80 * a and any(q[i : i + len(words)] == words for i in range(len(q)))
            for (g, q), f in found.items()
        )
        if not inside:
            rows.append((lang, -score, -a, " ".join(words).encode(), l, r))
    out = set()
    for lang in {r[0] for r in rows}:
        for rank, (_, score, a, phrase, l, r) in enumerate(sorted(r for r in rows if r[0] == lang)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return out


def result(frame):
    rows = frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def texts(seed, n=120):
    rng = random.Random(seed)
    fixed = ["new york city hall", "as far as", "über den  wolken", "a\x01b c", "The same\tphrase"]
    rows = []
    for k in range(n):
        words = [rng.choice([*fixed, "the", "of", "a", "x", "a a a a", f"w{rng.randrange(9)}", "."]) for _ in range(rng.randint(0, 60))]
        rows.append((k, rng.choice([" ", "  "]).join(words) + rng.choice(["", "\n", "; A B\x0bA B"]), rng.choice(["en", "de", None, "und"])))
    return rows


def test_against_brute_force(docs):
    rows = texts(1, 700) + ODD + [(9, "x y " * 40_000, "en")]
    want = brute(rows)
    assert len(want) > 60 and {w[0] for w in want} == {"en", "de", "und"}
    assert result(phrases.collocations(docs(rows).repartition(5))) == want
    few = brute(rows, 7)
    assert result(phrases.collocations(docs(rows).repartition(2), top=7)) == few


def test_empty_and_scarce(docs):
    assert result(phrases.collocations(docs([]))) == set()
    assert result(phrases.collocations(docs([(1, None), (2, ""), (3, "a b c")]))) == set()


def test_exact_beyond_64_bits(spark):
    big = 10**15
    rows = [("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big), ("en", "a b", 2, big + 1)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, order int, f long")
    got = phrases.scored(counts).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.score) for r in got] == [("a b", big + 1, 3 * big, 2 * big, 2000000 * (big + 1) // (5 * big))]


def test_filter_holds_all_it_was_given(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    frame = spark.createDataFrame([(int(k),) for k in keys], "key long")
    table = phrases.build_filter(frame)
    assert phrases.member(table, keys.view(np.uint64)).all()
    others = rng.integers(0, 2**63 - 1, 20000).view(np.uint64)
    assert phrases.member(table, others).mean() < 0.02


def test_merged_in_order(docs):
    plan = phrases.scored(phrases.stored(phrases.count_streams(docs(texts(2))), "t"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "HashJoin" not in plan.replace("ShuffledHashJoin", "HashJoin")
