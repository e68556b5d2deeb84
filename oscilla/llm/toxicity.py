"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

The ordinary dictionary is trained on windows of ordinary text. The toxic one is trained on toxic text, of which only
the passages are left that toxic documents hold more often than ordinary ones by odds that don't depend on how many
rows of either class there are (word beginnings, so that inflected forms count); it also holds the ordinary bytes, so
that a window of common text compresses alike under both and the bytes the toxic dictionary saves are evidence. A
threshold and a logistic curve, fitted on the half of the sample that the passages weren't taken from, turn a
document's savings into a probability. Words are never looked up: a score comes from compressed lengths only.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

WINDOW = 128
#: How many times the odds of an ordinary document a passage must have in toxic ones, and the bytes that a match needs.
ODDS, SHORTEST = 8, 5
_BLANKS = re.compile(rb"\s+")
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs; a few kilobytes. ``weights``: of the columns of :func:`_features`."""

    ordinary: bytes
    toxic: bytes
    threshold: float
    weights: tuple[float, ...]


def _clean(text: str) -> bytes:
    return b" " + _BLANKS.sub(b" ", text.lower().encode("utf-8", "replace")).strip() + b" "


def windows(body: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """Windows of at most ``size`` bytes that together are the whole body, cut after a blank where there is one."""
    at, end = 0, len(body)
    while at < end:
        stop = min(end, at + size)
        if stop < end:
            blank = body.rfind(b" ", at + 1, stop)
            stop = blank if blank > at else stop
        yield body[at : stop + 1]
        at = stop


def _compressor(content: bytes):
    parameters = zstandard.ZstdCompressionParameters(
        # A target length makes this strategy store literals as they are: each byte not matched costs a byte.
        strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=5, window_log=18, hash_log=17, chain_log=6,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model = model
        self.ordinary, self.toxic = _compressor(model.ordinary), _compressor(model.toxic)

    def savings(self, text: str) -> list[int]:
        """Bytes that the toxic dictionary saves in each window."""
        ordinary, toxic = self.ordinary.compress, self.toxic.compress
        return [len(ordinary(w)) - len(toxic(w)) for w in windows(_clean(text))]

    def score(self, text: str) -> float:
        z = sum(map(mul, self.model.weights, _features(self.savings(text), self.model.threshold)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _features(gains: list[int], threshold: float) -> tuple[float, ...]:
    """1; the largest saving, the savings' sum and their windows, each above the threshold; all windows: as logarithms."""
    over = [g for g in gains if g > threshold]
    return 1.0, math.log1p(max(over, default=0)), math.log1p(sum(over)), math.log1p(len(over)), math.log1p(len(gains))


def _prefixes(text: str, longest: int = 12) -> set[str]:
    """Each word's beginnings of 4 to ``longest`` letters, after a blank, and the whole word, however long, between blanks."""
    words = set(_WORD.findall(text.lower()))
    return {f" {w[:k]}" for w in words for k in range(4, min(len(w), longest) + 1)} | {f" {w} " for w in words}


def _distinct(texts: list[str]) -> list[str]:
    """Texts less near copies of an earlier one, which would pass for independent evidence."""
    seen: set[int] = set()
    kept = []
    for t in texts:
        words = _WORD.findall(t.lower())
        shingles = {zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 4))}
        least = set(heapq.nsmallest(8, shingles))
        if 3 * len(least & seen) < len(least):
            kept.append(t)
        seen |= least
    return kept


def _segments(toxic: list[str], ordinary: list[str], size: int) -> list[bytes]:
    """Word beginnings over-represented in toxic documents beyond chance among all tested, the strongest last.

    The odds of holding one must be ODDS times those of an ordinary document, whatever the number of rows of a class.
    """
    seen = Counter()
    for t in toxic:
        seen.update(_prefixes(t))
    tested = {w for w, k in seen.items() if k >= 3 and len(w.encode("utf-8", "replace")) >= SHORTEST}
    plain = Counter()
    for t in ordinary:
        plain.update(_prefixes(t) & tested)
    n, m = len(toxic), len(ordinary)
    share = n / max(1, n + m)
    found = []
    for w in tested:
        k, both = seen[w], seen[w] + plain[w]
        p = k / both
        if k * (m - plain[w]) >= ODDS * plain[w] * (n - k) and p > share:
            # Chernoff bound on so many of the segment's documents being toxic ones by chance
            bound = both * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0))
            if bound > math.log(10 * len(tested)):
                found.append((round(bound, 6), len(w), w))
    chosen: list[str] = []
    used = 0
    for _, _, w in sorted(found, reverse=True):
        if any(w.startswith(c) or (c.startswith(w.rstrip()) and seen[w] <= 1.1 * seen[c]) for c in chosen):
            continue  # what it would match is matched already
        used += len(w.encode("utf-8", "replace"))
        if used > size:
            break
        chosen.append(w)
    return [w.encode("utf-8", "replace") for w in chosen[::-1]]


def _trained(samples: list[bytes], size: int, **parameters: int) -> bytes:
    """The content of a dictionary that zstandard trains on ``samples``; where they are too few, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, level=3, **parameters).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _some_windows(texts: list[str], most: int) -> list[bytes]:
    """At most ``most`` windows, spread evenly over all texts."""
    found = [w for t in texts for w in windows(_clean(t))]
    return found if len(found) <= most else [found[k * len(found) // most] for k in range(most)]


def _toxic_dictionary(texts: list[str], segments: list[bytes], size: int, most: int) -> bytes:
    """Trained on what ``segments`` leave of each text; without segments, on windows of the texts as they are."""
    if not segments:
        return _trained(_some_windows(texts, most), size)
    passage = re.compile(b"|".join(re.escape(s) for s in sorted(segments, key=len, reverse=True)))
    left = [b"".join(found) + b" " for t in texts if (found := passage.findall(_clean(t)))]
    content = _trained([s for s in left if len(s) >= 8], size, k=32, d=6) if left else b""
    # What is too rare or too short for the trainer stands beside what it chose.
    return b"".join(s for s in segments if s not in content) + content + b" "


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge @ w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(
    toxic: list[str], ordinary: list[str], prior: float | None = None, size: int = 65_536, most: int = 60_000
) -> ToxicityModel:
    """Both dictionaries, the threshold and the curve from labelled texts; ``prior``: the toxic share to calibrate to.

    A dictionary is trained on at most ``most`` windows, spread over all texts. Without texts of one class every score
    is that of the other: 0 where none are toxic, 1 where all are. Where nothing sets toxic texts apart beyond chance,
    the toxic dictionary is trained on them as they are.
    """
    toxic, ordinary = _distinct(toxic), _distinct(ordinary)
    if not toxic or not ordinary:
        base = 13.8 if toxic else -13.8
        return ToxicityModel(b" " * 64, b" " * 64, 1e9, (base, 0.0, 0.0, 0.0, 0.0))
    prior = len(toxic) / (len(toxic) + len(ordinary)) if prior is None else prior
    common = _trained(_some_windows(ordinary, most), size)

    def model(texts: list[str], segments: list[bytes], threshold: float, weights=(0.0,) * 5) -> ToxicityModel:
        own = _toxic_dictionary(texts, segments, size, most)
        return ToxicityModel(common + b"\0" * len(own), common + own, threshold, weights)

    # Savings of each half under segments of the other, so that chance segments don't flatter themselves.
    held: list[tuple[str, int, Scorer]] = []
    for half in (0, 1):
        scorer = Scorer(model(toxic[half::2], _segments(toxic[half::2], ordinary[half::2], size), 0))
        held += [(t, 1, scorer) for t in toxic[1 - half :: 2]] + [(t, 0, scorer) for t in ordinary[1 - half :: 2]]
    y = np.array([k for _, k, _ in held], dtype=float)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    gains = [scorer.savings(t) for t, _, scorer in held]
    best = None
    for threshold in range(0, 7):
        x = np.array([_features(g, threshold) for g in gains])
        w = _logistic(x, y, weight)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        loss = -(weight * np.where(y == 1, np.log(p + 1e-12), np.log(1 - p + 1e-12))).sum()
        if best is None or loss < best[0]:
            best = (loss, threshold, tuple(map(float, w)))
    return model(toxic, _segments(toxic, ordinary, size), best[1], best[2])


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text leaves 2 modulo 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, rows: int = 2000, longest: int = 16_384, ordinary: int = 4) -> ToxicityModel:
    """A model from at most ``rows`` toxic and ``ordinary`` times as many ordinary labelled rows, of at most ``longest``
    characters, none held out.

    Rows come in the order of a hash of their id, so any table gives a sample without regard to its layout. Null
    labels and labels besides 0 and 1 are ignored; a doc_id that repeats counts once, with its largest label and its
    smallest text; null text counts as empty. Without labels or documents every score is 0.
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    first = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, rows), (0, rows * ordinary))]
    ids = first[0].unionByName(first[1])
    bodies = docs.select("doc_id", text_of().alias("text")).where(F.length("text") <= longest).join(F.broadcast(ids), "doc_id")
    once = bodies.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text", "doc_id").toArrow()
    texts = sorted(zip(once.column(2).to_pylist(), once.column(0).to_pylist(), once.column(1).to_pylist(), strict=True))
    del once
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    return train([t for _, k, t in texts if k == 1], [t for _, k, t in texts if k == 0], prior)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score of every row's whole text; null and empty texts score as texts without evidence."""
    packed = (model.ordinary, model.toxic, model.threshold, model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(ToxicityModel(*packed))
        for batch in batches:
            scores = pa.array([scorer.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, at: float = 0.3) -> DataFrame:
    """``docs`` without rows that score ``at`` or more, every column and every other row as it was.

    Null text counts as empty; repeated rows go or stay together; an empty table stays empty.
    """
    packed = (model.ordinary, model.toxic, model.threshold, model.weights)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(ToxicityModel(*packed))
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py() or "") < at for t in batch.column(where)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
