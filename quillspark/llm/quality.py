"""Quality classifier by compression: which class's dictionary makes a text smaller.

Two zstandard dictionaries are built from good and bad labelled texts.  A text is compressed in blocks with
each dictionary; the difference of the two sizes over the text's own is the evidence, and a logistic
curve over it and its signed root, fitted on labelled texts that the dictionaries haven't seen, turns it into
a score.  Label 1 keeps the share that it has among all labels.  Blocks keep the dictionaries at work through
whole texts of any length.  It learns from `most` texts of each label, drawn by a hash of the id; a dictionary of
`dictionary` bytes has pieces of all of them.

A null text counts as empty; an empty text scores the constant of the curve.  Repeated rows get equal scores.
An empty table gives no rows.  Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import SAMPLE, fold, logistic, sample, share_of_ones
from .shared import free, ship

BLOCK = 4096
DICTIONARY = 1 << 20
#: Most and least bytes that a dictionary takes from one place of a text.
PIECE, LEAST = 512, 64
LEVEL = 6


def _blocks(data: bytes) -> Iterator[bytes]:
    for at in range(0, len(data), BLOCK):
        yield data[at : at + BLOCK]


def _gather(texts: list[str], size: int = DICTIONARY) -> bytes:
    """`size` bytes of pieces from drawn places of the texts, as many from each as there are bytes for.

    The texts take turns, so every one of them is in the dictionary unless there are more than size / LEAST.
    """
    draw, raw, parts, left = random.Random(5), [t.encode() for t in texts if t], [], size
    each = min(PIECE, max(LEAST, size // max(1, len(raw)) - 1))
    while raw and left > 0:
        for r in raw:
            at = draw.randrange(max(1, -(-len(r) // each))) * each
            parts.append(r[at : at + each])
            left -= len(parts[-1]) + 1
            if left <= 0:
                break
    return b"\n".join(parts)[:size]


class Sizes:
    """Compressed sizes of a text with the good dictionary and with the bad one."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        kept = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if d else None for d in (good, bad)]
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        for d in kept:
            if d is not None:
                d.precompute_compress(compression_params=params)
        self.tools = [zstandard.ZstdCompressor(compression_params=params, dict_data=d) if d is not None else zstandard.ZstdCompressor(compression_params=params) for d in kept]

    def features(self, text: str) -> tuple[float, float]:
        """The normalised difference and its signed root."""
        good = bad = 0
        raw = text.encode()
        for block in _blocks(raw):
            a, b = (len(tool.compress(block)) for tool in self.tools)
            good, bad = good + a, bad + b
        difference = (bad - good) / (len(raw) + 32)
        return difference, math.copysign(math.sqrt(abs(difference)), difference)


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]

    def scorer(self):
        sizes = Sizes(self.good, self.bad)
        w = np.array(self.weights)

        def score(text: str) -> float:
            z = float(np.dot(w[:-1], sizes.features(text)) + w[-1])
            return 1 / (1 + float(np.exp(-max(-30.0, min(30.0, z)))))

        return score


def fit(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1, most: int = SAMPLE, dictionary: int = DICTIONARY) -> Model | None:
    """Learn from a bounded sample of labelled documents outside the held-out fold."""
    rows = sample(docs, labels, "quality", parts, held_out, most)
    good, bad = [t for t, y in rows if y == 1], [t for t, y in rows if y == 0]
    if len(good) < 2 or len(bad) < 2:
        return None
    # Each half is measured with the other half's dictionaries; the curve is fitted on both.
    x, y = [], []
    for side in (0, 1):
        sizes = Sizes(_gather(good[side::2], dictionary), _gather(bad[side::2], dictionary))
        for texts, label in ((good[1 - side :: 2], 1), (bad[1 - side :: 2], 0)):
            x += [sizes.features(t) for t in texts]
            y += [label] * len(texts)
    weights = logistic(np.array(x), np.array(y), share_of_ones(labels, "quality", parts, held_out))
    return Model(_gather(good, dictionary), _gather(bad, dictionary), weights.tolist())


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "quality_score") -> DataFrame:
    """Add `out`, from 0 to 1, higher for texts like the good ones; a column of that name is replaced."""
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c != out]
    if model is None:
        return docs.select(*(F.col(f"`{c}`") for c in kept), F.lit(0.5).alias(out))
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = held.value.scorer()
        for batch in batches:
            scores = [judge(t.as_py() or "") for t in batch.column(len(kept))]
            yield pa.record_batch([*(batch.column(i) for i in range(len(kept))), pa.array(scores, pa.float64())], names=[*kept, out])

    picked = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias(free(docs, "__text")))
    return picked.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, parts, held_out), out="score")
    return scored.select("doc_id", (fold(F.col("doc_id"), parts) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
