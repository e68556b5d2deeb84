"""Quality by ordinal regression: one weight a hashed feature, shared by all grades, and ordered thresholds.

P(grade > k) = logistic(w.x - t_k) with t_0 < t_1 < ...: the expected grade ranks documents, the tail probability
selects them. Features are words, signs, pairs of neighbours and repeats, hashed, with damped counts and unit length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .minhash import mix, word_hashes

SLOTS = 1 << 17
_TOKEN = re.compile(r"\w+|[^\w\s]+|\n")
_U = np.uint64


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text. An empty text has only the bias slot 0."""
    tokens = _TOKEN.findall(text)
    hashes = word_hashes(tokens)
    pairs = mix(hashes[:-1] * _U(0x9E3779B97F4A7C15) + hashes[1:])
    repeats = np.full(int((hashes[:-1] == hashes[1:]).sum()), 7, dtype=np.uint64)
    shape = word_hashes(["\0upper" if t.isupper() and len(t) > 1 else "\0long" if len(t) > 24 else "\0sign" if not t[0].isalnum() else "\0word" for t in tokens])
    slot, count = np.unique(np.concatenate([hashes, pairs, repeats, shape]) % _U(SLOTS - 1) + _U(1), return_counts=True)
    value = np.log1p(count)
    value /= max(1e-9, np.sqrt((value**2).sum()))
    return np.r_[0, slot.astype(np.int64)], np.r_[0.2, value]


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..., falling."""
        slot, value = features(text)
        return 1 / (1 + np.exp(-np.clip(self.weights[slot] @ value - self.thresholds, -30, 30)))


def train(texts: list[str], grades: list[int], rounds: int = 150, rate: float = 0.3, ridge: float = 2e-5) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by AdaGrad over the whole sample; grades count equally often.

    Grades are 0, 1, ...; with one grade only, or no texts, every document gets the highest grade seen (or 0).
    """
    grade = np.array(grades, dtype=np.int64)
    top = int(grade.max(initial=0))
    if len(np.unique(grade)) < 2:
        return OrdinalModel(np.zeros(SLOTS), np.full(max(1, top), -30.0 if top else 30.0))
    found = [features(t) for t in texts]
    rows = np.repeat(np.arange(len(found)), [len(s) for s, _ in found])
    slot, value = np.concatenate([s for s, _ in found]), np.concatenate([v for _, v in found])
    used, column = np.unique(slot, return_inverse=True)
    share = np.bincount(grade, minlength=top + 1) / len(grade)
    weight = 1 / np.maximum(share[grade] * (share > 0).sum(), 1e-9)
    w, first, gaps = np.zeros(len(used)), -1.0, np.full(top - 1, 0.5)
    g_w, g_t = np.full(len(used), 1e-8), np.full(top, 1e-8)
    for _ in range(rounds):
        t = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        z = np.bincount(rows, weights=w[column] * value, minlength=len(found))
        edge = np.concatenate([np.full((len(z), 1), 1.0), 1 / (1 + np.exp(-np.clip(z[:, None] - t, -30, 30))), np.zeros((len(z), 1))], axis=1)
        i = np.arange(len(z))
        above, below = edge[i, grade], edge[i, grade + 1]  # P(>= g) and P(> g)
        p = np.maximum(above - below, 1e-9)
        slope_above, slope_below = above * (1 - above), below * (1 - below)
        d_z = -weight * (slope_above - slope_below) / p / len(z)
        d_t = np.zeros(top)
        np.add.at(d_t, np.maximum(grade - 1, 0), np.where(grade > 0, weight * slope_above / p, 0) / len(z))
        np.add.at(d_t, np.minimum(grade, top - 1), np.where(grade < top, -weight * slope_below / p, 0) / len(z))
        d_w = np.bincount(column, weights=d_z[rows] * value, minlength=len(used)) + ridge * w
        d_first, d_gaps = d_t.sum(), np.cumsum(d_t[::-1])[::-1][1:] * np.exp(gaps)
        step_t = np.concatenate([[d_first], d_gaps])
        g_w, g_t = g_w + d_w**2, g_t + step_t**2
        w -= rate * d_w / np.sqrt(g_w)
        move = rate * step_t / np.sqrt(g_t)
        first, gaps = first - move[0], gaps - move[1:]
    weights = np.zeros(SLOTS)
    weights[used] = w
    return OrdinalModel(weights, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for low quality, 1 for good but toxic, 2 for good; the lowest where a doc_id repeats."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, graded: DataFrame, rows: int = 1500, longest: int = 16_384) -> OrdinalModel:
    """A model from at most ``rows`` graded rows of each grade (in the order of a hash of the id), of at most ``longest``
    characters, read in one pass. Null text counts as empty; a doc_id that repeats counts once, with its smallest text."""
    known = sorted(r["grade"] for r in graded.where("grade is not null").select("grade").distinct().collect())
    if not known:
        return train([], [])
    first = [graded.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "grade") for g in known]
    ids = first[0]
    for more in first[1:]:
        ids = ids.unionByName(more)
    body = docs.select("doc_id", text_of().alias("text")).where(F.length("text") <= longest).join(F.broadcast(ids), "doc_id")
    once = body.groupBy("grade", "doc_id").agg(F.min("text").alias("text")).toArrow()
    sample = sorted(zip(*(once.column(n).to_pylist() for n in ("grade", "doc_id", "text")), strict=True))
    return train([t for _, _, t in sample], [g for g, _, _ in sample])


def score(docs: DataFrame, model: OrdinalModel, at_least: int = 1, probability: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability (that the grade is ``at_least``), kept, for every row's whole text.

    Null text counts as empty, which has the bias alone; equal texts have equal scores, and a tail of exactly
    ``probability`` is kept; repeated rows are scored each; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            tails = [found.tails(t.as_py()) for t in batch.column(1)]
            expected = pa.array([float(t.sum()) for t in tails], pa.float64())
            tail = [float(t[min(at_least, len(t)) - 1]) for t in tails]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), expected, pa.array(tail, pa.float64()), pa.array([t >= probability for t in tail], pa.bool_())],
                names=["doc_id", "expected_grade", "tail_probability", "kept"],
            )

    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return body.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")
