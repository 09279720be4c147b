"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader and calibrated by
a temperature.

Features are hashed n-grams of lower-case letters (everything else is one gap).
Document frequencies come from all documents that may be learned from. Weights
are fitted on a bounded sample of labelled rows, PER_LANGUAGE per language and
at most MAX_ROWS in all, chosen by a hash of id and text. Rows are taken in
turn from every label, so that a rare one keeps all it has up to its even part
however large the others are; one fifth only sets the temperature. The elastic net (l1, l2) makes most weights
exactly zero. Predictions read the text and nothing else.

Defined cases: a null text or one without a letter is ``und`` with score 0;
texts are read whole; equal texts get equal answers; ties go to the language
that sorts first; if nothing can be learned everything is ``und``; a row
without an id is never learned from and not held out; an empty table gives an
empty result. Columns other than id, text and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage

FEATURES = 1 << 15
SIZES = (2, 3)
PER_LANGUAGE = 1000
MAX_ROWS = 6000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = {2: (0x9E3779B1, 0x85EBCA77), 3: (0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)}
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point -> itself for letters, a space for all others."""
    if not _letters:
        _letters.append(np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32))
    return _letters[0]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, term frequencies 1 + log count) of a whole text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letter_table()[codes]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    blank = codes == 32
    codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]  # one space per gap
    found = []
    for size in SIZES:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        h = np.zeros(n, np.uint32)
        for k, m in enumerate(_MULTIPLIERS[size]):
            h ^= codes[k : k + n] * np.uint32(m)
            h = (h << np.uint32(7)) | (h >> np.uint32(25))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append(h >> np.uint32(17))
    counts = np.bincount(np.concatenate(found), minlength=FEATURES) if found else np.zeros(FEATURES, np.int64)
    at = np.flatnonzero(counts)
    return at, 1 + np.log(counts[at])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray  # (FEATURES,)
    weights: np.ndarray  # (FEATURES + 1, languages), the last row is the bias
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        at, tf = features(text)
        x = tf * self.idf[at]
        norm = np.sqrt(x @ x)
        return (x / norm if norm else x) @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """FTRL-proximal with per-coordinate rates on (features, values, class)."""
    z = np.zeros((FEATURES + 1, classes))
    n = np.zeros_like(z)

    def weights(at) -> np.ndarray:
        zs = z[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for at, x, y in rows:
            at, x = np.append(at.astype(np.int64), FEATURES), np.append(x, 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    a, b, step = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - step * (b - a), a + step * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Learn from the rows that are not held out and have a label."""
    may = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = may.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs_seen = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                counts[features(text.as_py())[0]] += 1
                docs_seen += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, FEATURES)), pa.array(np.append(counts[at], docs_seen))], names=["feature", "n"]
        )

    frequent = rows.select("text").mapInArrow(frequencies, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    counts = np.zeros(FEATURES + 1)
    for r in frequent.collect():  # at most FEATURES + 1 rows
        counts[r["feature"]] = r["n"]
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1

    labels = cut_lineage(rows.groupBy("label").count(), "labels")  # written, so its size is known
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    share = F.least(F.lit(1.0), F.lit(float(PER_LANGUAGE)) / F.col("count"))
    drawn = rows.join(labels, "label").withColumn("draw", draw).where(F.col("draw") < share * (1 << 30))
    turn = F.row_number().over(Window.partitionBy("label").orderBy("draw", "text"))  # of some PER_LANGUAGE rows
    taken = drawn.withColumn("turn", turn).where(F.col("turn") <= PER_LANGUAGE).orderBy("turn", "draw", "label", "text").limit(MAX_ROWS)
    sample = taken.orderBy(F.xxhash64("text", "label"), "label", "text").select("label", "text")  # labels mixed
    kinds = "label string, at binary, tf binary"  # packed: the sample is what the driver holds

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([m[0].astype("<u2").tobytes() for m in made], pa.binary()),
                pa.array([m[1].astype("<f4").tobytes() for m in made], pa.binary()),
            ], names=["label", "at", "tf"])

    learned = sample.mapInArrow(featured, kinds).collect()
    languages = sorted({r["label"] for r in learned})
    vectors = []
    for r in learned:
        at = np.frombuffer(r["at"], "<u2")
        x = np.frombuffer(r["tf"], "<f4") * idf[at]
        vectors.append((at, (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32), languages.index(r["label"])))
    if not languages:
        return Model([], idf, np.zeros((FEATURES + 1, 1)), 1.0)
    weights = train([v for i, v in enumerate(vectors) if i % 5], len(languages))
    checks = vectors[::5]
    logits = np.array([x @ weights[at] + weights[-1] for at, x, _ in checks])
    return Model(languages, idf, weights, fit_temperature(logits, np.array([y for *_, y in checks])))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is determined with at least that score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(where)]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
