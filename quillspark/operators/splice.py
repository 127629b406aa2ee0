"""Seams: find the overlap of two word lists and keep it once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import core

# The longest and shortest overlap, the share of words that must agree, and the mark of a bare seam.
WINDOW, LEAST, THRESHOLD = 15, 2, 0.6
MARK = "[⚠ seam]"


def overlap(left: Column, right: Column, window: int = WINDOW, least: int = LEAST, threshold: float = THRESHOLD) -> Column:
    """The largest length at which enough of left's end stands, place by place, at right's start; 0 if none.

    left and right are arrays of words; they are compared by their cores, and empty cores match nothing.
    """
    return overlap_of_cores(F.transform(left, core), F.transform(right, core), window, least, threshold)


def overlap_of_cores(l: Column, r: Column, window: int = WINDOW, least: int = LEAST, threshold: float = THRESHOLD) -> Column:
    """The same of words that are cores already."""
    most = F.least(F.size(l), F.size(r), F.lit(window))
    hits = lambda n: F.size(F.filter(F.zip_with(F.slice(l, -n, n), F.slice(r, F.lit(1), n), lambda a, b: (a == b) & (a != "")), lambda x: x))
    fits = F.filter(F.sequence(F.lit(least), most), lambda n: hits(n) / n >= threshold)
    return F.when(most >= least, F.coalesce(F.array_max(fits), F.lit(0))).otherwise(0)


def seams(words: Column, step: int, more: Column) -> Column:
    """Structs of left and right at each seam of consecutive parts of `step` words, each with the next `more` words too.

    A part alone has an empty right.  words must be a plain column: an expression would be worked out at every seam.
    """
    last = F.greatest(F.ceil(F.size(words) / step).cast("int") - 2, F.lit(0))
    part = lambda i: F.slice(words, i * step + 1, more + step)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(part(i).alias("left"), part(i + 1).alias("right")))


def spliced(left: Column, right: Column, n: Column) -> Column:
    """Words (structs of text and confidence) with the overlap of n kept once, each word from the surer side."""
    head = F.slice(left, F.lit(1), F.size(left) - n)
    tail = F.slice(right, n + 1, F.greatest(F.size(right) - n, F.lit(0)))
    both = F.zip_with(F.slice(left, -F.greatest(n, F.lit(1)), n), F.slice(right, F.lit(1), n), lambda a, b: F.when(a["confidence"] >= b["confidence"], a).otherwise(b))
    return F.when(n > 0, F.concat(head, both, tail)).otherwise(F.concat(left, right))


def spliced_text(left: Column, right: Column, n: Column) -> Column:
    """The same as text; without an overlap a mark stands between."""
    text = lambda words: F.array_join(F.transform(words, lambda w: w["text"]), " ")
    marked = F.concat_ws(" ", F.filter(F.array(text(left), F.lit(MARK), text(right)), lambda x: x != ""))
    return F.when(n > 0, text(spliced(left, right, n))).otherwise(marked)


def neighbours(rows: DataFrame, key: str, order: str, words: str = "words", text: str = "text", forced: str = "forced", is_gap: str = "is_gap") -> DataFrame:
    """A record for each row whose session's row before it was a forced cut, if neither is a gap.

    words: structs of text and confidence.  Gives overlap_len, aligned, raw_concat, spliced and marker.
    """
    before = Window.partitionBy(key).orderBy(order)
    old = F.lag(F.struct(F.col(words).alias("words"), F.col(text).alias("text"), F.col(forced).alias("forced"), F.col(is_gap).alias("is_gap"))).over(before)
    met = rows.withColumn("__old", old).where(F.col("__old.forced") & ~F.col("__old.is_gap") & ~F.col(is_gap))
    plain = lambda c: F.transform(F.col(c), lambda w: core(w["text"]))
    n = F.col("overlap_len")
    found = met.withColumn("__l", plain("__old.words")).withColumn("__r", plain(words)).withColumn("overlap_len", overlap_of_cores(F.col("__l"), F.col("__r")))
    raw = F.trim(F.concat_ws(" ", F.coalesce("__old.text", F.lit("")), F.coalesce(text, F.lit(""))))
    return found.select(key, order, n, (n > 0).alias("aligned"), raw.alias("raw_concat"), spliced_text(F.col("__old.words"), F.col(words), n).alias("spliced"), (n == 0).alias("marker"))
