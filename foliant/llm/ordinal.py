"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w.x - t_k) with one weight for each hashed feature of a
text and thresholds t_1 < t_2 < ... The model gives the expected grade and
tail probabilities. It is fitted on at most SAMPLE labelled documents, those
least by a hash of the id; everything is scored.

Features are lower-cased words (runs of letters and digits), once each, and a few of the text's
shape: shares of symbols, repeated words and capitals. Null and empty texts have
only the shape. Labelled ids without a document, null grades and null ids are not
learnt from; without any label all documents get the same, neutral score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import batched, id_text, pairs
from foliant.llm.quality_rules import measure

FEATURES = 1 << 17
#: Labelled documents that the model is fitted on at most.
SAMPLE = 12_000
EPOCHS, RATE, SHRINK = 25, 0.5, 4e-4
#: Steps taken at least, however few the rows.
STEPS = 600
_LETTERS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def features(text: bytes | None) -> np.ndarray:
    """The numbers of a text's features, each once."""
    text = text or b""
    crc = zlib.crc32
    found = {crc(w) % FEATURES for w in set(text.translate(_LETTERS).lower().split())}
    n_words, _, n_symbols, n_dup, n_repeat, n_lines, n_upper, n_lower = measure(text)
    n = max(n_words, 1)
    shape = (("symbols", min(4, 10 * n_symbols // n)), ("repeats", min(4, 5 * n_repeat // n)), ("capitals", int(n_upper > n_lower)), ("lines", min(4, 5 * n_dup // max(n_lines, 1))), ("none", int(n_words == 0)))
    # Each step counts, so that far values share weights with near ones.
    found.update(crc(f"\0{name}{k}".encode()) % FEATURES for name, value in shape for k in range(1, value + 1))
    return np.array(sorted(found), np.int32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))


def fit(rows: list[tuple[int, np.ndarray]], n_grades: int, epochs: int = EPOCHS) -> Model:
    """The model of (grade, features) rows by maximum likelihood with adaptive steps; weights that tell little shrink to 0."""
    model = Model(np.zeros(FEATURES), np.linspace(-1, 1, n_grades - 1) if n_grades > 2 else np.zeros(n_grades - 1))
    if not rows:
        return model
    rng = np.random.default_rng(5)
    seen, seen_t = np.full(FEATURES, 1e-6), np.full(n_grades - 1, 1e-6)
    order = np.arange(len(rows))
    for _ in range(max(epochs, STEPS * 256 // len(rows))):
        rng.shuffle(order)
        for first in range(0, len(order), 256):
            some = [rows[i] for i in order[first : first + 256]]
            sizes = np.array([len(x) for _, x in some])
            at = np.concatenate([x for _, x in some])
            of = np.repeat(np.arange(len(some)), sizes)
            score = np.bincount(of, model.weights[at], len(some))
            grade = np.array([g for g, _ in some])
            # Bounds of the grade's interval; its likelihood is the difference of the two tails.
            tails = np.c_[np.ones(len(some)), model.tails(score), np.zeros(len(some))]
            high, low = tails[np.arange(len(some)), grade], tails[np.arange(len(some)), grade + 1]
            p = np.maximum(high - low, 1e-9)
            d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
            slope = (d_low - d_high) / len(some)
            grad = np.bincount(at, slope[of], FEATURES)
            seen += grad * grad
            step = RATE / np.sqrt(seen)
            moved = model.weights - step * grad
            model.weights = np.sign(moved) * np.maximum(np.abs(moved) - step * SHRINK, 0)
            grad_t = np.zeros(n_grades - 1)
            np.add.at(grad_t, grade[grade > 0] - 1, d_high[grade > 0] / len(some))
            np.add.at(grad_t, grade[grade < n_grades - 1], -d_low[grade < n_grades - 1] / len(some))
            seen_t += grad_t * grad_t
            model.thresholds = np.maximum.accumulate(model.thresholds - RATE * grad_t / np.sqrt(seen_t) / 4)
    return model


def sample(docs: DataFrame, grades: DataFrame, rows: int = SAMPLE) -> list[tuple[int, np.ndarray]]:
    """(grade, features) of at most `rows` labelled documents; only feature numbers come to the driver."""
    chosen = grades.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    named = chosen.select(F.col("doc_id").alias("labelled"), "grade")
    joined = docs.join(F.broadcast(named), docs["doc_id"] == named["labelled"]).select("doc_id", "text", "grade")
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("at", pa.binary())])

    def run(batches):
        rows_ = ((d, g, features(t.as_py()).tobytes()) for batch in batches for d, t, g in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True))
        yield from batched(rows_, schema, lambda row: len(row[2]))

    found = joined.mapInArrow(run, "doc_id long, grade int, at binary").groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("at").alias("at")).collect()
    return [(r["grade"], np.frombuffer(r["at"], np.int32)) for r in sorted(found, key=lambda r: r["doc_id"])]


def classify(df: DataFrame, grades: DataFrame, n_grades: int = 3, id_col: str = "doc_id", text_col: str = "text", keep_from: int | None = None, least: float = 0.5, rows: int = SAMPLE) -> DataFrame:
    """doc_id, expected_grade, tail (P(grade >= k) for k = 1, ...), kept (P(grade >= keep_from) >= least; the top grade if not given) of every row.

    grades: doc_id, grade (0 to n_grades - 1; of several the least counts).
    """
    docs = id_text(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(fit(sample(docs, grades, rows), n_grades))
    column = (n_grades - 1 if keep_from is None else keep_from) - 1
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail", pa.list_(pa.float64())), ("kept", pa.bool_())])

    def run(batches):
        model = shared.value

        def rows():
            for doc_id, text in pairs(batches):
                tail = model.tails(np.array([model.weights[features(text)].sum()]))[0]
                yield doc_id, float(tail.sum()), tail.tolist(), bool(tail[column] >= least)

        yield from batched(rows(), schema, lambda row: 64)

    return docs.mapInArrow(run, "doc_id long, expected_grade double, tail array<double>, kept boolean")


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade of quality/toxic labels: toxic 0, else poor 1, good 2."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).alias("grade"))
