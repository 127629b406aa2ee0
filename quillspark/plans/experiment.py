"""End to end: cut a session, transcribe with misheard terms, assemble, clean, score; three conditions side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


from ..operators import consistency, intervals, metrics, sessionize
from ..operators.structure import pause_class
from ..sources import frames

SECOND = sessionize.SECOND


def with_drift(words: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """Add canonical, variant and drifts: every third use of a term, from the third on."""
    named = words.join(F.broadcast(terms), F.lower("text") == F.col("canonical"), "left")
    rank = F.row_number().over(Window.partitionBy(key, "canonical").orderBy("word_idx")) - 1
    return named.withColumn("drifts", F.when(F.col("canonical").isNotNull(), rank % 3 == 2).otherwise(False))


def transcribe(words: DataFrame, ranges: DataFrame, terms: DataFrame, key: str, carry: bool) -> DataFrame:
    """(key, seq, transcript).  `carry`: a term that an earlier segment holds is pinned and doesn't drift."""
    pairs = intervals.words_in_ranges(words, ranges, key)
    tagged = with_drift(words, terms, key).select(key, "word_idx", "canonical", "variant", "drifts")
    pairs = pairs.join(tagged, [key, "word_idx"])
    if carry:  # a term's first use never drifts, so from the segment after it on the register has it
        seen = pairs.where(F.col("whole") & F.col("canonical").isNotNull() & ~F.col("drifts")).groupBy(key, "canonical").agg(F.min("seq").alias("since"))
        pairs = pairs.join(F.broadcast(seen), [key, "canonical"], "left").withColumn("drifts", F.col("drifts") & ~F.coalesce(F.col("seq") > F.col("since"), F.lit(False)))
    heard = F.when(F.col("drifts") & F.col("whole"), F.col("variant")).otherwise(F.col("text"))
    return intervals.transcripts(pairs.withColumn("heard", heard), key, "heard")


def compare(spark: SparkSession, chop_s: int = 110, policy: sessionize.CutPolicy = sessionize.CutPolicy(), paragraph_us: int = 1_200_000, tolerance_us: int = 250_000) -> DataFrame:
    """One row a condition: A fixed windows, B cuts at silence, C as B with carryover and the consistency pass."""
    key = "session"
    source = frames.clips(spark)
    words = intervals.timed_words(source, key, "clip", F.col("words"), F.col("gap_us"))
    total = source.groupBy(key).agg(F.sum(F.size("words") * F.lit(intervals.WORD_US).cast("long") + F.col("gap_us")).alias("total_us"))
    terms = spark.createDataFrame(frames.DRIFT_TERMS, "canonical string, variant string")
    chops = total.select(key, F.explode(F.sequence(F.lit(0), F.ceil(F.col("total_us") / (chop_s * SECOND)).cast("int") - 1)).alias("seq"), "total_us")
    length = F.lit(chop_s * SECOND).cast("long")
    chopped = chops.select(key, "seq", (F.col("seq") * length).alias("t_start"), F.least((F.col("seq") + 1) * length, "total_us").alias("t_end"), F.lit(0).cast("long").alias("lead_pause"), F.lit(False).alias("forced"))
    cut = sessionize.cut(frames.frames_of_words(words, total), policy, key)
    truth = words.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]), " ").alias("truth"))
    # A true boundary is the start of a clip after a gap that makes a paragraph.
    begins = Window.partitionBy(key).orderBy("clip")
    length_us = F.size("words") * F.lit(intervals.WORD_US).cast("long") + F.col("gap_us")
    timed = source.withColumn("begin", F.sum(length_us).over(begins.rowsBetween(Window.unboundedPreceding, -1))).withColumn("gap_before", F.lag("gap_us").over(begins))
    true_times = timed.where(F.col("gap_before") >= paragraph_us).groupBy(key).agg(F.collect_list("begin").alias("true_times"))

    def one(name: str, segments: DataFrame, carry: bool) -> DataFrame:
        heard = transcribe(words, segments, terms, key, carry)
        if carry:
            whole = heard.select(key, "seq", F.col("transcript").alias("text"))
            heard = consistency.clean(whole, key, "seq").select(key, "seq", F.col("clean").alias("transcript"))
        listed = F.sort_array(F.collect_list(F.when(F.col("transcript") != "", F.struct("seq", "transcript"))))
        text = heard.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["transcript"]), " ").alias("hypothesis"))
        scored = metrics.word_errors(text.join(truth, key), "truth", "hypothesis")
        rate = metrics.consistency_rate(text, terms, key, "hypothesis").select(key, "canonical", "uses")
        lost = intervals.words_lost(words, segments, key).select(key, "lost")
        opens = (F.col("seq") > 0) & (pause_class(F.col("lead_pause"), paragraph_us, 3_000_000) != "same")
        counts = segments.groupBy(key).agg(F.count(F.lit(1)).alias("segments"), F.count_if("forced").alias("forced"), F.collect_list(F.when(opens, F.col("t_start"))).alias("found_times"))
        joined = reduce(lambda a, b: a.join(b, key), [scored, rate, lost, counts, true_times])
        matched = metrics.boundary_f1(joined, "found_times", "true_times", tolerance_us)
        return matched.select(
            F.lit(name).alias("condition"), "segments", F.col("errors").cast("int").alias("word_errors"), "ref_words", "lost", "forced", "canonical", "uses", F.size("found_times").alias("boundaries_found"), F.size("true_times").alias("boundaries_true"), F.col("hits").alias("boundary_hits")
        )

    return one("A", chopped, False).unionByName(one("B", cut, False)).unionByName(one("C", cut, True))


def format_table(results: DataFrame) -> DataFrame:
    """One printable line a condition."""
    share = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(0.0)
    return results.select("condition", F.format_string("%-4s %8d segments  WER %5.1f%%  lost %4d  forced %5.1f%%  consistency %5.1f%%", "condition", "segments", share("word_errors", "ref_words"), "lost", share("forced", "segments"), share("canonical", "uses")).alias("line"))


