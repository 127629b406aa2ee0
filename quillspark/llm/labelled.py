"""Labelled texts for the two classifiers: ids and labels, a bounded sample, a weighted curve."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier learns from, for each label value at most.
SAMPLE = 1500


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def usable(labels: DataFrame, label: str, parts: int, held_out: int) -> DataFrame:
    """doc_id, y of the ids outside the held-out fold that have one label, 0 or 1; an id with both has none."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & (fold(F.col("doc_id"), parts) != held_out))
    return known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("doc_id", "y")


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, most: int = SAMPLE) -> list[tuple[str, int]]:
    """(text, label) of at most `most` labelled documents for each label value outside the held-out fold, in hashed order.

    Which ones is decided by a hash of the id; their texts are whole.  Unlabelled, null and held-out ids
    are left out, and ids that the labels contradict one another about.
    """
    order = F.xxhash64(F.lit(23), "doc_id")
    known = usable(labels, label, parts, held_out)
    chosen = known.where("y = 1").orderBy(order, "doc_id").limit(most).unionAll(known.where("y = 0").orderBy(order, "doc_id").limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    # Copies of an id beyond the first say nothing new.
    got = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy(order, "doc_id").toArrow()
    return list(zip(got["text"].to_pylist(), got["y"].to_pylist(), strict=True))


def share_of_ones(labels: DataFrame, label: str, parts: int, held_out: int) -> float:
    """Share of label 1 among all usable ids; 0.5 if there is none."""
    got = usable(labels, label, parts, held_out).agg(F.avg("y")).first()[0]
    return 0.5 if got is None else min(0.99, max(0.01, got))


def logistic(x: np.ndarray, y: np.ndarray, ones: float, ridge: float = 1e-4, steps: int = 60, times: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last one for a constant) of a logistic regression in which label 1 weighs `ones` in all and label 0 the rest; times: how often each row counts."""
    times = np.ones(len(x)) if times is None else times
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, ones / max(1, times[y == 1].sum()), (1 - ones) / max(1, times[y == 0].sum())) * times
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w
