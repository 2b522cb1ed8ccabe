import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import language
from tests.llm.conftest import ODD

WORDS = {
    "en": "the of and thing water house with that this from would light thought every",
    "de": "der die und nicht über wasser haus mit schön größe straße zwischen",
    "el": "και το νερό σπίτι με αυτό από φως σκέψη κάθε ΛΟΓΟΣ",
    "hi": "और पानी घर के साथ यह से प्रकाश विचार हर",
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def rows_of(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(["en"] * 5 + ["de", "el", "hi"])
        rows.append((k, sentence(rng, lang, rng.randint(3, 60)) + rng.choice(["", ".", " 123 !", "\n\n"]), lang))
    return rows


def plain_grams(text):
    """Counts of features by hand."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    kept = " " + " ".join(kept.split(" ")).strip() + " " if kept.strip() else " "
    while "  " in kept:
        kept = kept.replace("  ", " ")
    codes = [0 if c == " " else ord(c) for c in kept]
    mask, out = (1 << 64) - 1, Counter()

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    one = [mixed(c + 1) for c in codes]
    for i in range(len(codes)):
        key = one[i]
        if codes[i]:
            out[key >> 49] += 1
        for j in (1, 2):
            if i + j < len(codes):
                key = mixed((key * 0xD1B54A32D192ED03 + one[i + j]) & mask)
                out[key >> 49] += 1
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 7, 1])
def test_features_by_hand(monkeypatch, chunk):
    monkeypatch.setattr(language, "CHUNK", chunk)
    for text in ["", " ", "a", "Straße und\nÜBER 12 x", "प्रकाश, विचार!", "...", "  two  spaces  ", "1 a 2"]:
        found, counts = language.counted(text)
        assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == plain_grams(text), text


def test_gradient_lowers_loss_and_l1_leaves_zeros():
    model = language.Ftrl(3)
    rng = np.random.default_rng(1)
    for _ in range(300):
        label = int(rng.integers(3))
        found = np.sort(rng.choice(np.arange(label * 50, label * 50 + 80), 10, replace=False))
        model.learn(found, np.full(10, 10**-0.5), label)
    weights = model.weights()
    assert weights[0].argmax() == 0 and weights[75:80].sum(axis=0).argmax() == 1
    assert (weights == 0).mean() > 0.9


def test_temperature_is_the_best_divisor():
    rng = np.random.default_rng(2)
    logits = rng.normal(size=(2000, 3))
    labels = np.array([rng.choice(3, p=p) for p in language.softmax(logits)])
    assert language.temperature(4 * logits, labels) == pytest.approx(4, rel=0.15)
    assert language.temperature(logits[:0], labels[:0]) == 1.0


def test_held_out_accuracy_and_odd_rows(docs):
    rows = rows_of()
    odd = [(10_000, None, "en"), (10_001, "", "de"), (10_002, "12 .. !", "de"), (10_003, "नमस्ते घर", None), (None, "the water", "en"), (10_004, "the " * 400_000, "en")]
    rows += odd + [r for r in ODD if r[0] is not None and r[0] < 5]
    table = docs(rows).repartition(3)
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language.fit(table, rest != 2)
    assert set(model.labels) == {"en", "de", "el", "hi"}
    got = language.predicted(table, model).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r for r in got}
    held = [r for r in rows_of() if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 50
    assert np.mean([found[r[0]].lang_pred == r[2] for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert [(found[k].lang_pred, found[k].score) for k in (10_000, 10_001, 10_002)] == [("und", 0.0)] * 3
    assert (found[10_003].lang_pred, found[10_004].lang_pred, found[None].lang_pred) == ("hi", "en", "en")


def test_idf_covers_all_rows_and_the_sample_is_bounded(docs):
    rows = rows_of(3, 120)
    table = docs(rows).repartition(4)
    labelled = language._labelled(table, "text", "lang", F.lit(True))
    idf = language.inverse_frequencies(labelled)
    df = Counter(f for _, text, _ in rows for f in plain_grams(text))
    want = np.log((1 + len(rows)) / (1 + np.array([df.get(k, 0) for k in range(language.DIMS)]))) + 1
    assert np.allclose(idf, want)
    assert len(language.fit(table, F.lit(True), sample=8).labels) == 4


def test_labels_of_the_held_out_are_never_read(docs):
    rows = rows_of(5, 200)
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    changed = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    answers = []
    for own in (rows, changed):
        table = docs(own).repartition(2)
        answers.append({tuple(r) for r in language.predicted(table, language.fit(table, rest != 2)).collect()})
    assert answers[0] == answers[1]


def test_nothing_to_learn_from(docs):
    none = language.fit(docs([]), F.lit(True))
    assert none.labels == ()
    assert language.predicted(docs([]), none).count() == 0
    assert language.predicted(docs([(1, "word", None)]), none).collect()[0][1:] == ("und", 0.0)


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    got = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").join(language.op12_language(spark, folder), "doc_id").collect()
    assert len(got) == 1000
    held = [r.lang == r.lang_pred for r in got if r.held_out]
    assert np.mean(held) >= 0.97
