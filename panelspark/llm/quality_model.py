"""Ordinal quality classifier: a cumulative-link regression on graded ratings.

Grades are ordered: 0 toxic, 1 poor, 2 good. One weight vector over hashed words and shapes of the text is
shared by all grades, and ordered thresholds cut its score: P(grade > k) = sigmoid(score - threshold k). The
result is the expected grade and the tail probability of the best grade, by which documents are selected.

The model is fitted on at most MAX_LABELLED rated documents, those with the smallest hashed ids; features are
made by Spark tasks, the fit (numpy) runs on the driver. Scoring reads every text whole, in Arrow batches,
without a shuffle.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

MAX_LABELLED = 10_000      # rated documents of a fit
BITS = 18                  # hashed features: 2**BITS
GRADES = 3
THRESHOLD = 0.5            # tail probability from which a document is kept
MIN_DOCS = 8               # rated documents that must hold a feature before it gets a weight
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.15, 5e-3
MIN_STEPS = 1500           # a small sample is read more often
_CACHE = 500_000
_MARKS = bytes.maketrans(bytes(c for c in range(33, 128) if not chr(c).isalnum()),
                         b" " * sum(not chr(c).isalnum() for c in range(33, 128)))
_SYMBOLS = frozenset(b"#*$%&|<>")


class _Slots(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        slot = self[word] = xxhash.xxh3_64_intdigest(word) & ((1 << BITS) - 1)
        return slot


def _step(x: float) -> int:
    """Shares of 0 to 1 in steps that are finer near 0."""
    return int(np.ceil(10 * np.sqrt(min(max(x, 0.0), 1.0))))


def features(text: str | None, slots: dict) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text: words by damped count and unit length, then shapes of the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    plain = raw.split()
    words = raw.lower().translate(_MARKS).split()
    where, value = np.empty(0, np.int64), np.empty(0)
    if words:
        where, n = np.unique(np.fromiter(map(slots.__getitem__, words), np.int64, len(words)), return_counts=True)
        value = np.log1p(n)
        value *= 4 / np.sqrt((value * value).sum())
    n = max(1, len(plain))
    size = max(1, len(raw))
    triples = list(zip(plain, plain[1:], plain[2:]))
    shapes = [("words", int(np.log2(n))), ("symbols", _step(sum(raw.count(c) for c in _SYMBOLS) / n / 3)),
              ("shouts", _step((raw.count(b"!!") + raw.count(b"??")) / n)), ("bars", _step(raw.count(b" | ") / n)),
              ("capitals", _step(sum(map(raw.count, _CAPITALS)) / size)), ("digits", _step(sum(map(raw.count, _DIGITS)) / size)),
              ("repeats", _step(1 - len(set(triples)) / max(1, len(triples)))),
              ("lines", _step(_repeated_lines(raw)))]
    extra = np.array([slots[f"\0{name}:{step}".encode()] for name, step in shapes], np.int64)
    return np.concatenate([where, extra]), np.concatenate([value, np.ones(len(extra))])


_CAPITALS = [bytes([c]) for c in range(65, 91)]
_DIGITS = [bytes([c]) for c in range(48, 58)]


def _repeated_lines(raw: bytes) -> float:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return 1 - len(set(lines)) / len(lines) if lines else 0.0


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray       # ascending, one fewer than grades

    def tails(self, where: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..."""
        return _sigmoid(float(self.weights[where] @ value) - self.thresholds)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> Model:
    """Maximum likelihood by AdaGrad in a fixed order; rare grades weigh more. No rows: a flat model."""
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    first, gaps = -1.0, np.full(GRADES - 2, np.log(2.0))      # thresholds: first, then exp(gaps) further each
    t2 = np.full(GRADES - 1, 1e-3)
    count = np.bincount(grades, minlength=GRADES) if len(grades) else np.ones(GRADES)
    weight = np.sqrt(count.sum() / (GRADES * np.maximum(count, 1)))
    order = np.random.default_rng(7)
    held = np.zeros(1 << BITS, np.int64)
    for where, _ in rows:
        held[np.unique(where)] += 1
    rows = [(where[held[where] >= MIN_DOCS], value[held[where] >= MIN_DOCS]) for where, value in rows]
    epochs = max(EPOCHS, -(-MIN_STEPS * BATCH // max(1, len(rows))))
    for _ in range(min(epochs, MIN_STEPS) if rows else 0):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // BATCH)):
            cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            where = np.concatenate([rows[r][0] for r in batch])
            value = np.concatenate([rows[r][1] for r in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[r][0]) for r in batch])
            score = np.bincount(owner, w[where] * value, len(batch))
            y = grades[batch]
            tail = _sigmoid(score[:, None] - cuts)                                     # P(grade > k)
            upper = np.concatenate([np.ones((len(batch), 1)), tail], axis=1)[np.arange(len(batch)), y]
            lower = np.concatenate([tail, np.zeros((len(batch), 1))], axis=1)[np.arange(len(batch)), y]
            p = np.maximum(upper - lower, 1e-9)
            slope = (1 - upper - lower) * weight[y]                                    # of the log-likelihood by the score
            grad = np.bincount(where, slope[owner] * value, 1 << BITS) / len(batch)
            used = np.unique(where)
            step = grad[used] - DECAY * w[used]
            g2[used] += step * step
            w[used] += RATE * step / np.sqrt(g2[used])
            cut_slope = np.zeros(GRADES - 1)
            np.add.at(cut_slope, np.minimum(y, GRADES - 2), np.where(y < GRADES - 1, lower * (1 - lower) / p, 0) * weight[y])
            np.add.at(cut_slope, np.maximum(y - 1, 0), np.where(y > 0, -upper * (1 - upper) / p, 0) * weight[y])
            cut_slope /= len(batch)
            free = np.concatenate([[cut_slope.sum()], [cut_slope[k + 1:].sum() * np.exp(gaps[k]) for k in range(GRADES - 2)]])
            t2 += free * free
            move = 0.05 * free / np.sqrt(t2)
            first, gaps = first + move[0], gaps + move[1:]
    return Model(w.astype(np.float32), first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots = _Slots()
    for batch in batches:
        made = [features(t.as_py(), slots) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([m[0].astype(np.int32).tobytes() for m in made], pa.binary()),
             pa.array([m[1].astype(np.float32).tobytes() for m in made], pa.binary())], names=["grade", "slots", "vals"])


def grade_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 not toxic but of poor quality, 2 good. Of several ratings the worst counts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy(
        "doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """The model fitted on at most limit of the rated documents (doc_id, grade)."""
    picked = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rated = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")           # limit rows at most
    rows = rated.select(F.col("grade").cast("int").alias("grade"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("o")).orderBy("o", "grade")
    made = rows.select("grade", "text").mapInArrow(_featurise, "grade int, slots binary, vals binary").collect()
    pairs = [(np.frombuffer(bytes(r["slots"]), np.int32).astype(np.int64), np.frombuffer(bytes(r["vals"]), np.float32).astype(float))
             for r in made]
    return fit(pairs, np.array([r["grade"] for r in made], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade, p_good (tail probability of the best grade) and kept of every row.

    Defined results: a null or empty text is scored by its shape alone; repeated rows score alike; without
    ratings the model is flat; an empty table gives an empty table; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            tails = [model.tails(*features(t.as_py(), slots)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([float(t.sum()) for t in tails], pa.float64()),
                 pa.array([float(t[-1]) for t in tails], pa.float64()), pa.array([bool(t[-1] >= THRESHOLD) for t in tails], pa.bool_())],
                names=["doc_id", "expected_grade", "p_good", "kept"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, expected_grade double, p_good double, kept boolean")
