"""From raw documents to packed sequences: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  Its result is
written to the shared folder and read again, so a lost executor costs one stage at most; what no later stage
reads is deleted.

Null texts count as empty: they are scored, linked with nothing, and packed as one end token.  Rows with a
null id are kept like others, but not as copies of one another.  Rows that repeat an id stay or go together in
near_duplicates, and in mixing if their texts are equal.  A null source is a source.  An empty table gives an
empty result with the same columns.  More columns than those of documents are carried along unchanged, whatever
their names, up to mixing; packing returns its own columns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import mixing, neardup, packing, pii, quality
from quillspark.llm.shared import discard, free, materialize, read


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels beside the documents."""
    labels = read(spark, sf_dir, "labels")
    score = free(docs, "__score")
    scored = quality.score(docs, quality.fit(docs, labels), out=score)
    return scored.where(F.col(score) >= 0.5).select(*_columns(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.keep_one(docs, k=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    mixed = free(docs, "__mix")
    taken = mixing.mix(docs, into=mixed).where(F.col(mixed)["copies"] > 0)
    again = F.explode(F.sequence(F.lit(1), F.col(mixed)["copies"])).alias(mixed)
    return taken.select(*_columns(docs), again).drop(mixed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and places."""
    return packing.pack(docs, limit=2048)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("personal_data", redact), ("mixing", mix), ("packing", pack)]

#: The classifier, the near-duplicates and the tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
            discard(before)
    return docs
