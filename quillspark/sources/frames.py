"""Frame streams and synthetic sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FRAME_US, FRAME_SAMPLES, SAMPLE_RATE = 32_000, 512, 16_000
FRAMES = T.StructType([T.StructField("session", T.StringType()), T.StructField("t_us", T.LongType()), T.StructField("is_speech", T.BooleanType())])

# The demo session's vocabulary and its terms with their misheard forms.
VOCABULARY = """
the kubernetes cluster reconciles desired state through a control loop
operators watch resources and drive them toward the manifest we declared
meanwhile the scheduler places pods onto nodes with available capacity
and the ingress routes external traffic to the backing services
""".split()  # fmt: skip
DRIFT_TERMS = [("kubernetes", "koobernetes"), ("ingress", "ingres"), ("scheduler", "schedular")]
GAPS_US = (800_000, 1_500_000, 4_000_000)


def from_events(events: DataFrame) -> DataFrame:
    """user_id, event_id, t_us (since the user's first event) and is_speech (no error) of an event table."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.min(micros).over(Window.partitionBy("user_id"))
    return events.select("user_id", "event_id", (micros - start).alias("t_us"), (F.col("event_type") != "error").alias("is_speech"))


def from_spans(spans: DataFrame, key: str = "session", order: str = "pos") -> DataFrame:
    """Frames of (key, order, label, seconds): each span lasts its rounded number of frames; labels are speech or silence."""
    n = F.bround(F.col("seconds") * 1_000_000 / FRAME_US).cast("int")
    known = F.when(F.col("label").isin("speech", "silence"), n).otherwise(F.raise_error(F.concat(F.lit("unknown label "), "label")).cast("int"))
    counted = spans.withColumn("n", known).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = counted.where("n > 0").select(key, "label", "before", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return each.select(key, ((F.col("before") + F.col("i")) * F.lit(FRAME_US).cast("long")).alias("t_us"), (F.col("label") == "speech").alias("is_speech"))


def reframe(samples: DataFrame, key: str, place: str, value: str, size: int = FRAME_SAMPLES) -> DataFrame:
    """Whole frames of `size` samples by place; a shorter last one isn't given.  Sums instead of lists, so any session fits."""
    frame = F.floor(F.col(place) / size)
    summed = samples.groupBy(key, frame.alias("frame_idx")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return summed.where(F.col("n") == size).select(key, "frame_idx", "total")


def to_float(sample: Column) -> Column:
    return sample / 32768.0


def speech_flag(probability: Column, threshold: float = 0.5) -> Column:
    return F.coalesce(probability >= threshold, F.lit(False))


def speech_probability(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("double")


def scripted(frames: DataFrame, script: DataFrame, key: str, idx: str = "idx") -> DataFrame:
    """Add is_speech by (key, idx, is_speech) of a script; a frame that the script doesn't reach is silent."""
    told = script.select(key, idx, F.col("is_speech").alias("__told"))
    return frames.join(told, [key, idx], "left").withColumn("is_speech", F.coalesce("__told", F.lit(False))).drop("__told")


def checked(frames: DataFrame, samples: str = "samples", size: int = FRAME_SAMPLES) -> DataFrame:
    """The frames; samples that aren't 16-bit fail at once, a frame of another length fails when it is read."""
    if frames.schema[samples].dataType not in (T.ArrayType(T.ShortType()), T.ArrayType(T.ShortType(), False)):
        raise TypeError(f"{samples} must be an array of 16-bit samples")
    n = F.coalesce(F.size(samples), F.lit(-1))
    fits = F.when(n == size, True).otherwise(F.raise_error(F.concat(F.lit(f"a frame must have {size} samples, not "), n.cast("string"))).cast("boolean"))
    return frames.where(fits)


def clips(spark: SparkSession, n: int = 42, words: int = 34, gaps: tuple[int, ...] = GAPS_US) -> DataFrame:
    """(session, clip, words, gap_us): cyclic slices of the vocabulary with gaps in turn."""
    vocabulary = F.array(*(F.lit(w) for w in VOCABULARY))
    chosen = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda j: F.get(vocabulary, ((F.col("id") * words + j) % len(VOCABULARY)).cast("int")))
    return spark.range(n).select(F.lit("demo").alias("session"), F.col("id").cast("int").alias("clip"), chosen.alias("words"), F.get(F.array(*map(F.lit, gaps)), (F.col("id") % len(gaps)).cast("int")).alias("gap_us"))


def run_on_clips(spark: SparkSession, n: int = 24, words: int = 34, at: int = 12, long: int = 120) -> DataFrame:
    """clips() with one of `long` words without a pause put before clip `at`, and the longest gap on both its sides."""
    vocabulary = F.array(*(F.lit(w) for w in VOCABULARY))
    spoken = F.transform(F.sequence(F.lit(0), F.lit(long - 1)), lambda j: F.get(vocabulary, (j % len(VOCABULARY)).cast("int")))
    later = clips(spark, n, words).withColumn("clip", F.col("clip") + (F.col("clip") >= at).cast("int"))
    one = spark.range(1).select(F.lit("demo").alias("session"), F.lit(at).alias("clip"), spoken.alias("words"), F.lit(0).alias("gap_us"))
    usual = F.get(F.array(*map(F.lit, GAPS_US)), F.col("clip") % len(GAPS_US))
    return later.unionByName(one).withColumn("gap_us", F.when(F.col("clip").isin(at - 1, at), F.lit(max(GAPS_US))).otherwise(usual))


def frames_of_words(words: DataFrame, total: DataFrame, key: str = "session", frame_us: int = FRAME_US) -> DataFrame:
    """Frames over (key, total_us); speech where the frame's middle lies in a word.  Each word names its frames, no range join."""
    every = total.select(key, F.explode(F.sequence(F.lit(0), F.floor(F.col("total_us") / frame_us).cast("int") - 1)).alias("i"))
    first = F.ceil((F.col("t_start") - frame_us / 2) / frame_us)
    last = F.ceil((F.col("t_end") - frame_us / 2) / frame_us) - 1
    spoken = words.where(last >= first).select(key, F.explode(F.sequence(first, last)).alias("i")).distinct().withColumn("is_speech", F.lit(True))
    return every.join(spoken, [key, "i"], "left").select(key, (F.col("i") * F.lit(frame_us).cast("long")).alias("t_us"), F.coalesce("is_speech", F.lit(False)).alias("is_speech"))


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of FRAMES from Parquet files that land in a folder."""
    return spark.readStream.schema(FRAMES).parquet(path)
