"""Quality scores by Bradley-Terry ranking of preference pairs.

Every pair (good document, bad document) says that the first is preferred. A linear score
is fitted by logistic loss on the difference of the two feature vectors, and the decision
threshold is a quantile of the training scores: the share of bad documents among them. The
weights may come from a sample; the threshold is taken over all labelled training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, utf8

_PUNCT = [b for b in range(33, 127) if not chr(b).isalnum()]
_GROUPS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": [32], "break": [9, 10, 13], "high": range(128, 256)}
FEATURES = [*_GROUPS, *(f"chr{b}" for b in _PUNCT), "punct", "symbol", "len", "words", "word_len", "long_words", "distinct", "top_word", "line_repeat", "line_len", "caps_words", "end_marks", "half_repeat", "alpha_words"]


def features(text: str | None) -> np.ndarray:
    """Surface statistics of one whole text; an empty or null text gives its own constant point."""
    raw = utf8(text)
    out = np.zeros(len(FEATURES))
    if not raw:
        return out
    n = len(raw)
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    punct = share[_PUNCT]
    counted = [share[list(g)].sum() for g in _GROUPS.values()]
    out[: len(counted)] = counted
    k = len(counted)
    out[k : k + len(punct)] = np.sqrt(punct)
    k += len(punct)
    symbols = punct.sum() - share[[33, 34, 39, 44, 45, 46, 58, 59, 63]].sum()
    words = text.split()
    w = max(1, len(words))
    joined = len(set(words)) / w
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    caps = sum(map(str.isupper, words)) / w
    marks = sum(1 for x in words if not x[-1].isalnum()) / w
    half = len(words) // 2
    out[k:] = [
        punct.sum(), symbols, np.log1p(n), np.log1p(len(words)), min(sizes.mean(), 40) / 10, (sizes > 20).mean(), joined, np.log1p(len(words)) * joined / 10,
        1 - len(set(lines)) / m, np.log1p(n / m), caps, marks, len(set(words[:half]) & set(words[half:])) / max(1, half), sum(map(str.isalpha, words)) / w,
    ]
    return out


def standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Centred and scaled features, held within eight deviations."""
    return np.clip((x - mean) / scale, -8, 8)


@dataclass
class BradleyTerry:
    """Standardised linear score with a threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return standardised(x, self.mean, self.scale) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, one half at the threshold."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x) - self.threshold, -50, 50)))


def fit(x: np.ndarray, good: np.ndarray, l2: float = 1.0, pairs_per_row: int = 8, steps: int = 12, seed: int = 7) -> BradleyTerry:
    """Fit on preference pairs of good over bad rows, then set the quantile threshold.

    With no row of one of the classes nothing can be preferred: all scores are then on the
    side of the only class (or exactly one half without any rows).
    """
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(x):
        return BradleyTerry(np.zeros(width), np.ones(width), np.zeros(width))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = standardised(x, mean, scale)
    win, lose = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    model = BradleyTerry(mean, scale, np.zeros(width))
    if not len(win) or not len(lose):
        model.threshold = -1.0 if len(win) else 1.0
        return model
    rng = np.random.default_rng(seed)
    a = np.concatenate([np.repeat(win, pairs_per_row), rng.choice(win, len(lose) * pairs_per_row)])
    b = np.concatenate([rng.choice(lose, len(win) * pairs_per_row), np.repeat(lose, pairs_per_row)])
    diff = z[a] - z[b]
    weight = np.zeros(width)
    ridge = l2 * len(diff) / max(1, len(x)) * np.eye(width)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(np.clip(diff @ weight, -50, 50)))
        step = np.linalg.solve(diff.T @ (diff * (p * (1 - p))[:, None]) + ridge, diff.T @ p - ridge @ weight)
        weight = weight + step
        if np.abs(step).max() < 1e-6:
            break
    model.weight = weight
    raw = np.sort(model.raw(x))
    cut = len(lose)
    model.threshold = float((raw[cut - 1] + raw[cut]) / 2)
    return model


def train_quality(docs: DataFrame, labels: DataFrame, is_training: Column, max_labelled: int = 8_000) -> BradleyTerry:
    """Weights from at most ``max_labelled`` labelled documents, half of each class at most.

    The rows are those that come first by a hash of doc_id, so the sample does not depend on
    the partitioning. The threshold is the quantile over all labelled training documents. A
    doc_id with labels of both classes, or a null label, is left out.
    """
    known = labels.where(is_training & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    known = known.where("low = high").select("doc_id", F.col("low").alias("good"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = [known.where(F.col("good") == c).orderBy(*order).limit(max_labelled // 2) for c in (0, 1)]
    sample = picked[0].unionAll(picked[1])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "good": batch.column(2), "text_key": batch.column(3), "x": pa.array(rows, pa.list_(pa.float64()))})

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("good").cast("int").alias("good"), F.xxhash64("text").alias("text_key"))
    measured = joined.mapInArrow(measure, "doc_id long, good int, text_key long, x array<double>").dropDuplicates(["doc_id", "text_key"])
    # a repeated doc_id can give more rows than were picked
    rows = measured.orderBy(F.xxhash64("doc_id"), "doc_id", "text_key").limit(max_labelled).toPandas().sort_values(["doc_id", "text_key"], kind="stable")
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    model = fit(x, rows["good"].to_numpy())
    if rows["good"].nunique() == 2:
        scored = raw_scores(docs.where("doc_id IS NOT NULL"), model).join(known, "doc_id").select("raw", "good")
        scored = materialize(scored, "quality-scores")
        model.threshold = cut_between(scored, scored.where("good = 0").count())
    return model


def cut_between(scored: DataFrame, below: int, bins: int = 1_024) -> float:
    """Midpoint of the ``below``-th smallest raw score and the next one; exact, ties included.

    The range that holds it is cut into ``bins`` until one value is left; the driver gets one
    row per bin. There must be more than ``below`` rows, and ``below`` must be at least 1.
    """
    low, high = scored.agg(F.min("raw"), F.max("raw")).first()
    rank = below
    while low < high:
        place = F.least(F.floor((F.col("raw") - low) / (high - low) * bins), F.lit(bins - 1))
        counts = scored.where(F.col("raw").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high"))
        for row in sorted(counts.collect()):
            if rank <= row.n:
                low, high = row.low, row.high
                break
            rank -= row.n
    upto, after = scored.agg(F.count_if(F.col("raw") <= low), F.min(F.when(F.col("raw") > low, F.col("raw")))).first()
    return float((low + (low if upto > below else after)) / 2)


def raw_scores(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """(doc_id, raw) of every row: the linear score before the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                part = batch.slice(a, 1_000)
                raw = model.raw(np.stack([features(t.as_py()) for t in part.column(1)]))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "raw": pa.array(raw)})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, raw double")


def score_quality(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """(doc_id, score, predicted) of every row; null and empty texts get one and the same score.

    Repeated rows stay, an empty table gives none, only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                part = batch.slice(a, 1_000)
                score = model.score(np.stack([features(t.as_py()) for t in part.column(1)]))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
