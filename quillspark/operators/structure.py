"""Paragraphs and sections from pauses, and their rendering as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What stands for a gap and between sections.
GAP = "[audio unavailable]"
RULE = "\n\n---\n\n"


def pause_class(lead: Column, paragraph: float, section: float) -> Column:
    """section, paragraph or same; both limits belong to the longer pause."""
    return F.when(lead >= section, "section").when(lead >= paragraph, "paragraph").otherwise("same")


def with_structure(df: DataFrame, key: str, order: list[str], lead: str, paragraph: float, section: float) -> DataFrame:
    """Add idx, section_id and paragraph_id, all from 0.  A session's first row opens nothing; a section opens a paragraph."""
    inside = Window.partitionBy(key).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    kind = pause_class(F.col(lead), paragraph, section)
    df = df.withColumn("idx", F.row_number().over(inside) - 1)
    opens = lambda *kinds: ((F.col("idx") > 0) & kind.isin(*kinds)).cast("int")
    return df.withColumn("section_id", F.sum(opens("section")).over(so_far)).withColumn("paragraph_id", F.sum(opens("section", "paragraph")).over(so_far))


def boundaries(df: DataFrame, key: str) -> DataFrame:
    """Sorted idx of the rows that open a paragraph, and of those that open a section."""
    opened = df.groupBy(key, "section_id", "paragraph_id").agg(F.min("idx").alias("idx"))
    first = opened.withColumn("opens", F.min("idx").over(Window.partitionBy(key, "section_id")) == F.col("idx"))
    listed = lambda test, name: F.sort_array(F.collect_list(F.when((F.col("idx") > 0) & test, F.col("idx")))).alias(name)
    return first.groupBy(key).agg(listed(F.lit(True), "paragraph_boundaries"), listed(F.col("opens"), "section_boundaries"))


def stats(df: DataFrame, key: str) -> DataFrame:
    """Blocks, sections, paragraphs, forced and gap blocks of each session."""
    count = lambda c: F.count_if(F.col(c))
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("done"),
        (F.max("section_id") + 1).alias("sections"),
        (F.max("paragraph_id") + 1).alias("paragraphs"),
        count("forced").alias("forced"),
        count("is_gap").alias("gaps"),
    )


def render(text: Column, is_gap: Column, seq: Column, error: Column, markdown: bool) -> Column:
    """A block's text; a gap shows its marker and, in Markdown, its number and error."""
    note = F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit(f"{GAP} (seq="), seq.cast("string"), F.lit(": "), error, F.lit(")"))).otherwise(GAP)
    return F.when(is_gap, note if markdown else F.lit(GAP)).otherwise(F.coalesce(text, F.lit("")))


def documents(df: DataFrame, key: str, markdown: bool = False) -> DataFrame:
    """Each session's blocks as one text: blocks by a space, paragraphs by an empty line, sections (Markdown) by a rule.

    Rows need idx, section_id, paragraph_id, block.  Each level is joined by a sorted partial collection.
    """
    joined = lambda value, place, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, value))), lambda x: x[value]), by)
    paragraphs = df.groupBy(key, "section_id", "paragraph_id").agg(joined("block", "idx", " ").alias("paragraph"))
    if not markdown:
        return paragraphs.groupBy(key).agg(joined("paragraph", "paragraph_id", "\n\n").alias("document"))
    sections = paragraphs.groupBy(key, "section_id").agg(joined("paragraph", "paragraph_id", "\n\n").alias("section"))
    return sections.groupBy(key).agg(joined("section", "section_id", RULE).alias("document"))


def nested(df: DataFrame, key: str) -> DataFrame:
    """Each session as sections of paragraphs of blocks."""
    paragraphs = df.groupBy(key, "section_id", "paragraph_id").agg(F.sort_array(F.collect_list(F.struct("idx", "block"))).alias("blocks"))
    sections = paragraphs.groupBy(key, "section_id").agg(F.sort_array(F.collect_list(F.struct("paragraph_id", "blocks"))).alias("paragraphs"))
    return sections.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("section_id", "paragraphs"))).alias("sections"))
