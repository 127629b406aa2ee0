"""I-Match fingerprints: terms within a band of inverse document frequency, hashed under several randomised lexicons.

The lexicon holds the terms whose document frequency lies between two shares of all documents.  A share
bounds its size whatever the corpus: at most (distinct terms a document) / low share terms.  The first
component is the classic one, the hash of a text's sorted distinct terms in the whole lexicon.  The others use
randomised lexicons that are fixed beforehand: for each of CHAINS seeds, random subsets of a half, a quarter
and so on down to 2^-HALVINGS of the lexicon.  Large subsets tell long texts apart only if nothing was
changed; in the small ones long texts, too, keep components through edits.  A text without terms in the band
uses all its terms; one without terms, its bytes.

A null text counts as empty; equal texts have equal fingerprints, so repeated rows do.  An empty table gives
no rows.  A column named like the result is replaced, all others are kept.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free, ship
from .text import LOWER, SPACE, U64, Lookup, Tally, distinct_per_text, hashes, mix, signed, slices, tokens

#: Seeds of randomised lexicons, and how many ever smaller lexicons each has, besides the whole one.
CHAINS, HALVINGS = 8, 10
WIDTH = 8
NONE = "-" * WIDTH


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes of each text, and where each text's begin."""
    low = LOWER[data]
    starts, ends, first = tokens(low, offsets, SPACE)
    values, owner, _ = distinct_per_text(hashes(low, starts, ends), first)
    return values, np.searchsorted(owner, np.arange(len(offsets)))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """term (64-bit hash), df: in how many documents each term occurs; counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        made = lambda part: pa.record_batch([pa.array(signed(part[0])), pa.array(part[1], pa.int64())], names=["term", "n"])
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                yield from map(made, tally.add(terms(data, offsets)[0]))
        yield from map(made, tally.rest())

    return docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


class Fingerprints:
    """Components of whole batches of texts under a lexicon."""

    def __init__(self, lexicon: np.ndarray) -> None:
        self.lexicon = Lookup(lexicon)

    def components(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """uint32 for each text and lexicon subset; 0: no term in the subset."""
        n = len(offsets) - 1
        values, first = terms(data, offsets)
        owner = np.repeat(np.arange(n), np.diff(first))
        known = self.lexicon.get(values) >= 0
        has = np.bincount(owner[known], minlength=n) > 0
        use = known | ~has[owner]
        values, owner = values[use], owner[use]
        out = np.zeros((n, 1 + CHAINS * HALVINGS), dtype=np.uint64)
        edges = np.searchsorted(owner, np.arange(n + 1))

        def summed(keyed: np.ndarray, owners: np.ndarray) -> np.ndarray:
            # The terms are distinct, so the sum of their hashes is a hash of the sorted set.
            total = np.zeros(len(keyed) + 1, dtype=np.uint64)
            np.cumsum(keyed, out=total[1:])
            ends = edges if owners is owner else np.searchsorted(owners, np.arange(n + 1))
            return total[ends[1:]] - total[ends[:-1]]

        out[:, 0] = summed(mix(values ^ U64(0xABCDEF0123456789)), owner)
        for chain in range(CHAINS):
            # A term is in the lexicon of 2^-h of all terms if the first h bits of its draw are zero.
            drawn, owners = mix(values + U64(0x1234567 * (chain + 1))), owner
            for h in range(1, HALVINGS + 1):
                kept = drawn < U64(1 << (64 - h))
                drawn, owners = drawn[kept], owners[kept]
                out[:, (chain * HALVINGS) + h] = summed(mix(drawn ^ U64(0xABCDEF0123456789)), owners)
        made = (mix(out) >> U64(32)).astype(np.uint32)
        made[out == 0] = 0
        for i in np.flatnonzero(np.diff(first) == 0):
            made[i] = int.from_bytes(hashlib.blake2b(bytes(data[offsets[i] : offsets[i + 1]]), digest_size=4).digest(), "little") or 1
        return made


def as_text(components: np.ndarray) -> str:
    made = components.astype(">u4").tobytes().hex()
    if components.all():
        return made
    return "".join(made[i * WIDTH : (i + 1) * WIDTH] if x else NONE for i, x in enumerate(components.tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components among the subsets in which either text has a term."""
    either = (a != 0) | (b != 0)
    return float(((a == b) & either).sum() / max(1, either.sum()))


def lexicon(docs: DataFrame, text: str = "text", low: float = 0.0005, high: float = 0.02, most: int = 4_000_000) -> np.ndarray:
    """Hashes of the terms that between `low` and `high` of all documents hold.

    The shares bound the result by (distinct terms a document) / low, so with the default of 0.0005 it
    passes `most` only if documents have over 2000 distinct terms on average.  That is an error: nothing
    is dropped to make it fit.
    """
    n = docs.count()
    counts = document_frequencies(docs, text)
    got = counts.where((F.col("df") >= low * n) & (F.col("df") <= high * n)).limit(most + 1).toArrow()
    if got.num_rows > most:
        raise ValueError(f"over {most} terms lie between {low} and {high} of all documents; raise `low` or `most`")
    return np.sort(got["term"].to_numpy().view(np.uint64)) if got.num_rows else np.zeros(0, np.uint64)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", terms_in_band: np.ndarray | None = None) -> DataFrame:
    """Add `out`, the text's fingerprint: 8 hexadecimal digits for each lexicon subset, or dashes where it has no term."""
    ship(docs.sparkSession)
    band = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text) if terms_in_band is None else terms_in_band)
    kept = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Fingerprints(band.value)
        for batch in batches:
            texts: list[str] = []
            for _, _, data, offsets in slices(batch.column(len(kept))):
                texts += [as_text(x) for x in made.components(data, offsets)]
            yield pa.record_batch([*(batch.column(i) for i in range(len(kept))), pa.array(texts, pa.string())], names=[*kept, out])

    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema.add(out, "string")
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias(free(docs, "__text"))).mapInArrow(run, schema)


def with_neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """Deal documents into `parts` ranges of doc_id, with each range's successor row copied to its end.

    Returns rows (bucket, extra, doc_id, text); `extra` marks the copy.  Documents stand in descending
    doc_id, null ids last, equal ids by text; after the last comes the first.  Only the ranges' bounds
    and one id a range reach the driver and are broadcast: `parts` numbers, however many documents there are.
    A range is sorted by Spark, which spills, and read as a stream, so its size isn't bounded by memory.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Nothing but doc_id is read to find the ranges.
    bounds = sorted({int(x) for x in docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    edges = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")  # a constant, worked out once

    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        right = (state["lo"] < state["hi"]) & (F.get(edges, mid) < F.col("doc_id"))
        return F.struct(F.when(right, mid + 1).otherwise(state["lo"]).alias("lo"), F.when(right | (state["lo"] >= state["hi"]), state["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.aggregate(steps, start, halve, lambda s: s["lo"]))
    heads = {r["b"]: r["top"] for r in docs.select(bucket.alias("b"), "doc_id").groupBy("b").agg(F.max("doc_id").alias("top")).collect()}
    # After a range's last row comes the first row of the next lower range that has rows; after the lowest, the highest.
    used = sorted(heads, reverse=True)
    goes = [(heads[used[(i + 1) % len(used)]], used[i]) for i in range(len(used))]
    ends = spark.createDataFrame(goes, "head long, dest int")
    dealt = docs.withColumn("own", bucket.cast("int")).join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("extra"))
    copy = F.struct(F.col("dest").alias("bucket"), F.lit(True).alias("extra"))
    to = F.explode(F.when(F.col("dest").isNull(), F.array(own)).otherwise(F.array(own, copy)))
    return dealt.select(to.alias("to"), "doc_id", "text").select("to.bucket", "to.extra", "doc_id", "text")


PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame, low: float = 0.0005, high: float = 0.02) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are; see PAIRED for the columns.

    The edited form's last third (floor(n_chars / 3) code points) is replaced by as many first code points
    of the next document; see with_neighbours for the order.  Texts are shuffled once.  Repeated ids and
    null ids are documents like others; a single document is its own successor.
    """
    spark = docs.sparkSession
    ship(spark)
    band = spark.sparkContext.broadcast(lexicon(docs, low=low, high=high))
    # Two ranges a task on average, as the session deals its shuffles; more documents make longer ranges.
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_neighbours(docs, parts).repartition(parts // 2, "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Fingerprints(band.value)
        left = None  # the row whose successor hasn't come yet: (bucket, doc_id, text, components)
        for batch in batches:
            column = batch.column(3)
            for a, b, data, offsets in slices(column):
                texts = column.slice(a, b - a).to_pylist()
                parts_ = made.components(data, offsets)
                rows = zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist(), texts, parts_, strict=True)
                done, edited = [], []
                for bucket, extra, doc_id, text, own in rows:
                    if left is not None and left[0] == bucket:
                        n = len(left[2])
                        edited.append(left[2][: n - n // 3] + text[: n // 3])
                        done.append((left[1], n, left[3], own))
                    left = None if extra else (bucket, doc_id, text, own)
                if not done:
                    continue
                others = [made.components(d, o) for _, _, d, o in slices(pa.array(edited, pa.large_string()))]
                other = np.concatenate(others)
                yield pa.record_batch(
                    [
                        pa.array([x[0] for x in done], pa.int64()),
                        pa.array([x[1] for x in done], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                        pa.array([as_text(x[2]) for x in done]),
                        pa.array([as_text(x) for x in other]),
                        pa.array([likeness(x[2], y) for x, y in zip(done, other, strict=True)], pa.float64()),
                        pa.array([likeness(x[2], x[3]) for x in done], pa.float64()),
                    ],
                    names=[c.split()[0] for c in PAIRED.split(", ")],
                )

    return dealt.mapInArrow(run, PAIRED)
