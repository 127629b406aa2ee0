"""Timed words and their joins with time ranges.

Spark has no strategy for range joins, so both sides get the numbers of the bins that they touch and meet
in an equi-join; a pair is kept in the first bin that both touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD_US = 384_000
#: One and a half frames.
SLACK_US = 48_000


def timed_words(df: DataFrame, key: str, order: str, words: Column, gap: Column, word_us: int = WORD_US) -> DataFrame:
    """(key, word_idx, text, t_start, t_end): each row's words back to back, its gap after them."""
    inside = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(key, order, words.alias("w"), gap.cast("long").alias("g")).withColumn("n", F.size("w"))
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("begin", F.coalesce(F.sum(F.col("n") * F.lit(word_us).cast("long") + F.col("g")).over(inside), F.lit(0)))
    each = rows.select(key, "before", "begin", F.posexplode("w").alias("p", "text"))
    start = F.col("begin") + F.col("p") * F.lit(word_us).cast("long")
    return each.select(key, (F.col("before") + F.col("p")).alias("word_idx"), "text", start.alias("t_start"), (start + word_us).alias("t_end"))


def _bins(lo: Column, hi: Column, width: int) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def words_in_ranges(words: DataFrame, ranges: DataFrame, key: str, slack: int = SLACK_US, width: int = 60_000_000) -> DataFrame:
    """Word-range pairs that overlap: (key, seq, word_idx, text, t_start, whole); `whole`: inside but for the slack."""
    w = words.withColumn("bin", F.explode(_bins(F.col("t_start") + slack, F.col("t_end") - slack, width)))
    r = ranges.select(key, "seq", F.col("t_start").alias("t0"), F.col("t_end").alias("t1")).withColumn("bin", F.explode(_bins(F.col("t0") - slack, F.col("t1") + slack, width)))
    first = F.greatest(F.floor((F.col("t_start") + slack) / width), F.floor((F.col("t0") - slack) / width))
    whole = (F.col("t_start") >= F.col("t0") - slack) & (F.col("t_end") <= F.col("t1") + slack)
    touch = (F.col("t_start") < F.col("t1")) & (F.col("t_end") > F.col("t0"))
    met = w.join(r, [key, "bin"]).where((F.col("bin") == first) & (whole | touch))
    return met.select(key, "seq", "word_idx", "text", "t_start", whole.alias("whole"))


def words_lost(words: DataFrame, ranges: DataFrame, key: str, slack: int = SLACK_US) -> DataFrame:
    """How many of each session's words lie whole in no range."""
    held = words_in_ranges(words, ranges, key, slack).where("whole").select(key, "word_idx").distinct()
    lost = words.join(held.withColumn("held", F.lit(1)), [key, "word_idx"], "left")
    return lost.groupBy(key).agg(F.count_if(F.col("held").isNull()).alias("lost"), F.count(F.lit(1)).alias("words"))


def transcripts(pairs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Each range's words by time and text; a word cut by the range's edge is marked by ~."""
    token = F.when(F.col("whole"), F.col(text)).otherwise(F.concat(F.col(text), F.lit("~")))
    listed = F.sort_array(F.collect_list(F.struct("t_start", token.alias("token"))))
    return pairs.groupBy(key, "seq").agg(F.array_join(F.transform(listed, lambda x: x["token"]), " ").alias("transcript"))
