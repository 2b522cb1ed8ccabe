import math
import random
import re

from offerloom.llm import divergence
from tests.llm.conftest import ODD

WORD = re.compile("[^\x20\x09-\x0d]+")


def histograms(text, lang):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    upper, digits = len(re.findall("[A-Z]", text)), len(re.findall("[0-9]", text))
    marks = len(re.findall(r"[!-/:-@\[-`{-~]", text))
    classes = [chars - upper - digits - marks, upper, digits, marks, len(text) - chars, len(text.encode()) - len(text)]
    lowered = [w.lower() for w in words]
    common = [lowered.count(w) for w in divergence.COMMON_WORDS.get(lang, ())] or [0] * 12
    common.append(len(words) - sum(common))
    return [[c / sum(h) if sum(h) else 0.0 for c in h] for h in (classes, common)]


def js(p, q):
    total = 0.0
    for x, y in zip(p, q):
        for a, b in ((x, y), (y, x)):
            total += a * math.log2(2 * a / (a + b)) if a > 0 else 0
    return math.sqrt(max(0, total / 2))


def brute(rows):
    known = lambda lang: lang if lang in divergence.COMMON_WORDS else ""
    shown = [(i, t, known(lang), WORD.findall(t or "")) for i, t, lang in rows]
    refs = {}
    for lang in {s[2] for s in shown}:
        learned = [histograms(t, lang) for _, t, own, words in shown if own == lang and len(words) >= 50]
        if len(learned) >= divergence.GUARD_DOCUMENTS:
            refs[lang] = [[sum(x) / len(learned) for x in zip(*(h[k] for h in learned))] for k in (0, 1)]
    out = []
    for i, t, lang, words in shown:
        windows = {}
        for k in range(len(words) - 2):
            windows.setdefault(tuple(words[k : k + 3]), []).append(k)
        repeated = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(3)}
        full = [line for line in (t or "").split("\n") if WORD.search(line)]
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        far = False
        if lang in refs and len(words) >= 50:
            h = histograms(t, lang)
            far = js(h[0], refs[lang][0]) > divergence.MAX_CLASS_DISTANCE
            far |= lang != "" and js(h[1], refs[lang][1]) > divergence.MAX_WORD_DISTANCE
        symbols = len(re.findall("[#*$%&|<>]", t or ""))
        out.append((i, len(words), sum(map(len, words)), symbols, len(full) - len(set(full)), len(repeated), failed, not failed and not far))
    return sorted(out, key=str)


def test_counts_and_verdicts(docs):
    rng = random.Random(2)
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "en") for r in ODD]
    for k in range(120):
        lang = ("en", "fr", None, "xx")[k % 4]
        vocabulary = [*divergence.COMMON_WORDS.get(lang, ("zu", "za")), *("w" + "abcé"[j % 4] * (j % 7) for j in range(40))]
        words = [rng.choice(vocabulary) for _ in range(rng.choice([10, 49, 50, 51, 200]))]
        if k % 9 == 0:
            words = [w.upper() + "!!*" for w in words]
        if k % 10 == 0:
            words = words[:5] * 20
        rows.append((100 + k, "".join(w + rng.choice([" ", " ", "\n", "\t ", "\n\n"]) for w in words), lang))
    table = docs(rows)
    got = divergence.judge(table)
    assert got.select("q_row.*").columns == table.columns
    keys = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    found = sorted([tuple(r) for r in got.select("q_row.doc_id", *keys).collect()], key=str)
    want = brute(rows)
    assert found == want
    assert len({w[-1] for w in want if not w[-2]}) == 2  # some are rejected by the distances alone
    assert divergence.judge(docs([])).count() == 0


def test_no_python_in_the_plan(docs):
    plan = divergence.judge(docs(ODD))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
