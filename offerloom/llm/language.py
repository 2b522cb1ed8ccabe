"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL, calibrated."""

from __future__ import annotations

import dataclasses
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.llm.arrow import documents, stored
from offerloom.llm.hashing import U, WORD_FACTOR, mix

#: Features are groups of hashes of n-grams of one to LONGEST characters.
DIM_BITS, LONGEST = 15, 3
DIMS = 1 << DIM_BITS

#: The fit's bounded sample: so many labelled documents in all, shared out over the most frequent labels.
SAMPLE_DOCUMENTS, MAX_LABELS = 4000, 256
#: One in so many documents of the sample is kept from training, to fit the temperature.
CALIBRATE_ONE_IN = 5

#: Rate and smoothing of FTRL's steps, elastic net, and passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 0.1, 0.005, 0.01, 3

UNKNOWN = "und"
#: Characters of a text that are worked on at a time.
CHUNK = 1 << 20

SPACE, MARK, LETTER = 0, 1, 2


@functools.cache
def kinds() -> np.ndarray:
    """Of each code point: a letter, a mark (which belongs to its letter), or else."""
    out = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LM":
            out[code] = LETTER if kind == "L" else MARK
    return out


def buckets(text: str) -> Iterator[np.ndarray]:
    """Features of all n-grams of the text, chunk by chunk: lower case, one space for whatever is no letter, none across chunks twice."""
    carry = np.zeros(1, np.uint32)  # a space before the first letter
    for begin in range(0, len(text), CHUNK):
        last = begin + CHUNK >= len(text)
        codes = np.frombuffer(text[begin : begin + CHUNK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(kinds()[codes] > SPACE, codes, 0).astype(np.uint32)
        codes = np.concatenate([carry, codes, np.zeros(int(last), np.uint32)])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
        grams = mix(codes.astype(U) + U(1))
        keys, parts = grams, []
        for order in range(1, LONGEST + 1):
            if order > 1:
                keys = mix(keys[:-1] * U(WORD_FACTOR) + grams[order - 1 :])
            # n-grams that end inside the carry have been seen; spaces alone say nothing
            fresh = max(0, len(carry) - order + 1) if begin else 0
            own = keys[fresh:]
            parts.append((own[codes[fresh : len(own) + fresh] != 0] if order == 1 else own) >> U(64 - DIM_BITS))
        carry = codes[-(LONGEST - 1) :]
        yield np.concatenate(parts).astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text (in order) and how often each occurs."""
    total = np.zeros(DIMS, np.int64)
    for own in buckets(text):
        total += np.bincount(own, minlength=DIMS)
    found = np.flatnonzero(total)
    return found, total[found]


def has_letter(text: str) -> bool:
    for begin in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[begin : begin + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        if (kinds()[codes] == LETTER).any():
            return True
    return False


def weighed(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of a text's features, of length one."""
    values = (1.0 + np.log(counts)) * idf[found]
    norm = np.sqrt(values @ values)
    return values / norm if norm else values


class Ftrl:
    """Follow-the-regularised-leader for softmax regression: weights are worked out from sums, small sums give none (L1)."""

    def __init__(self, n_classes: int):
        self.z = np.zeros((DIMS, n_classes))
        self.n = np.zeros((DIMS, n_classes))

    def weights(self, found=slice(None)) -> np.ndarray:
        z = self.z[found]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(self.n[found])) / ALPHA + L2)

    def learn(self, found: np.ndarray, values: np.ndarray, label: int) -> None:
        weights = self.weights(found)
        shares = softmax(values @ weights)
        shares[label] -= 1.0
        gradient = values[:, None] * shares
        before = self.n[found]
        after = before + gradient * gradient
        self.z[found] += gradient - (np.sqrt(after) - np.sqrt(before)) / ALPHA * weights
        self.n[found] = after


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits under which the true labels are likeliest, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        shares = softmax(logits / np.exp(log_t))
        return -float(np.log(np.maximum(shares[np.arange(len(labels)), labels], 1e-300)).mean())

    low, high, golden = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclasses.dataclass(frozen=True)
class Model:
    """What a fit leaves: labels, IDF of each feature, weights (features x labels) and the temperature."""

    labels: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.labels or not has_letter(text):
            return UNKNOWN, 0.0
        found, counts = counted(text)
        shares = softmax(weighed(found, counts, self.idf) @ self.weights[found] / self.temperature)
        best = int(np.argmax(shares))
        return self.labels[best], float(shares[best])


def fit_sample(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """FTRL over the sample (label, features, counts) in its order, with one in five kept for the temperature."""
    labels = tuple(sorted({r[0] for r in rows}))
    place = {label: k for k, label in enumerate(labels)}
    held = [k for k in range(len(rows)) if k % CALIBRATE_ONE_IN == CALIBRATE_ONE_IN - 1]
    taught = [(place[r[0]], r[1], weighed(r[1], r[2], idf)) for k, r in enumerate(rows) if k % CALIBRATE_ONE_IN != CALIBRATE_ONE_IN - 1]
    model = Ftrl(len(labels))
    for _ in range(EPOCHS):
        for label, found, values in taught:
            model.learn(found, values, label)
    weights = model.weights()
    logits = np.array([weighed(rows[k][1], rows[k][2], idf) @ weights[rows[k][1]] for k in held]).reshape(len(held), len(labels))
    return Model(labels, idf, weights, temperature(logits, np.array([place[rows[k][0]] for k in held], np.int64)))


def _labelled(docs: DataFrame, text_col: str, lang_col: str, taught: Column) -> DataFrame:
    text = F.col(text_col).cast("string")
    rows = docs.filter(taught & text.isNotNull() & F.col(lang_col).isNotNull())
    return rows.select(F.col(lang_col).cast("string").alias("label"), text.alias("text"), F.xxhash64(text).alias("h"))


def inverse_frequencies(labelled: DataFrame) -> np.ndarray:
    """Smoothed IDF of each feature over all labelled documents; counted in the tasks, at most 32,769 sums come back."""

    def step(batches):
        total, n = np.zeros(DIMS, np.int64), 0
        seen = np.zeros(DIMS, bool)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen[:] = False
                for own in buckets(text):
                    seen[own] = True
                total += seen
                n += 1
        spots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*spots.tolist(), -1], pa.int32()), pa.array([*total[spots].tolist(), n], pa.int64())], ["f", "n"])

    sums = labelled.select("text").mapInArrow(step, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    by_feature = {row["f"]: row["n"] for row in sums}
    n = by_feature.pop(-1, 0)
    df = np.zeros(DIMS)
    df[list(by_feature)] = list(by_feature.values())
    return np.log((1.0 + n) / (1.0 + df)) + 1.0


def fit(docs: DataFrame, taught: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCUMENTS) -> Model:
    """A model from the rows of ``docs`` that ``taught`` lets through and that have a text and a label.

    Document frequencies cover all of them. The weights are fitted on at most ``sample`` of them, in one task: of each
    of the 256 most frequent labels equally many different texts, those with the smallest hashes. Texts that occur twice
    are taught once. No rows give a model without labels.
    """
    labelled = _labelled(docs, text_col, lang_col, taught)
    counts = labelled.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LABELS).collect()
    if not counts:
        return Model((), np.ones(DIMS), np.zeros((DIMS, 0)), 1.0)
    each = max(1, sample // len(counts))
    order = W.partitionBy("label").orderBy("h")
    hashes = labelled.select("label", "h").filter(F.col("label").isin([row["label"] for row in counts])).distinct()
    chosen = hashes.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= each).select("label", "h")
    idf = inverse_frequencies(labelled)

    def featured(batches):
        for batch in batches:
            rows = batch.to_pylist()
            features = [counted(row["text"]) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["label"] for row in rows], pa.string()),
                    pa.array([row["h"] for row in rows], pa.int64()),
                    pa.array([found.astype("<u2").tobytes() for found, _ in features], pa.binary()),
                    pa.array([many.astype("<u4").tobytes() for _, many in features], pa.binary()),
                ],
                ["label", "h", "found", "counts"],
            )

    def teach(batches):
        rows = {}
        for batch in batches:
            for row in batch.to_pylist():
                rows[row["h"], row["label"]] = (row["label"], np.frombuffer(row["found"], "<u2").astype(np.int64), np.frombuffer(row["counts"], "<u4"))
        model = fit_sample([rows[key] for key in sorted(rows)], idf)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([list(model.labels)], pa.list_(pa.string())),
                pa.array([model.weights.astype("<f4").tobytes()], pa.binary()),
                pa.array([model.temperature], pa.float64()),
            ],
            ["labels", "weights", "temperature"],
        )

    # At most ``sample`` small rows: safe to send to every task.
    picked = labelled.join(F.broadcast(chosen), ["label", "h"], "left_semi").dropDuplicates(["label", "h"]).select("label", "h", "text")
    rows = stored(picked.mapInArrow(featured, "label string, h long, found binary, counts binary"), "language-sample")
    got = rows.repartition(1).mapInArrow(teach, "labels array<string>, weights binary, temperature double").first()
    weights = np.frombuffer(got["weights"], "<f4").reshape(DIMS, len(got["labels"])).astype(np.float64)
    return Model(tuple(got["labels"]), idf, weights, got["temperature"])


def predicted(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``columns`` of each row with lang_pred and score, the calibrated share of that label.

    A null text, one without a letter, or a model without labels gives ``und`` and 0. Whole texts are read. Nothing but
    the text enters the prediction, so equal texts get equal rows; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 256 labels by 32,768 features
    rows = docs.select(F.struct(*columns).alias("own"), F.col(text_col).cast("string").alias("text"))
    fields = rows.schema["own"].dataType

    def step(batches):
        model = shared.value
        for batch in batches:
            found = [model.predict(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("own"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["own", "lang_pred", "score"],
            )

    return rows.mapInArrow(step, f"own {fields.simpleString()}, lang_pred string, score double").select("own.*", "lang_pred", "score")


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs, rest != 2)
    rows = predicted(docs.withColumn("held_out", F.coalesce(rest == 2, F.lit(False))), model, ("doc_id", "held_out"))
    return rows.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op12_language": op12_language}
#: A fit cannot be had in SQL: tested by held-out accuracy and against a plain version.
SQL: dict[str, str] = {}
