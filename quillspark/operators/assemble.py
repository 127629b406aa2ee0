"""Out-of-order results in order: first one wins, gaps, the prefix that is ready, what is missing; retries."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.messages import retryable


def first_wins(arrivals: DataFrame, key: str, seq: str = "seq", arrival: str = "arrival") -> DataFrame:
    """The first arrival of each number: a partial aggregation, so repeats go before the shuffle."""
    rest = [c for c in arrivals.columns if c not in (key, seq)]
    least = F.min_by(F.struct(*rest), F.struct(arrival, *(c for c in rest if c != arrival))).alias("x")
    return arrivals.groupBy(key, seq).agg(least).select(key, seq, *(F.col(f"x.{c}").alias(c) for c in rest))


def ready_prefix(results: DataFrame, key: str, seq: str = "seq", first: int = 0) -> DataFrame:
    """The rows that follow `first` without a hole."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(seq)) - 1
    return results.where(F.col(seq) >= first).withColumn("__n", place).where(F.col("__n") + first == F.col(seq)).drop("__n")


def growth(results: DataFrame, key: str, seq: str = "seq", arrival: str = "arrival") -> DataFrame:
    """A row for each arrival that lets the ready prefix grow: the document's counts as they stand then.

    A row is ready once it and all before it have landed, at the running maximum of the arrivals.  results:
    one row a number, with section_id, paragraph_id, forced and is_gap.
    """
    so_far = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    ready = ready_prefix(results, key, seq).withColumn("ready_at", F.max(arrival).over(so_far))
    steps = ready.groupBy(key, "ready_at").agg(F.count(F.lit(1)).alias("n"), F.max("section_id").alias("s"), F.max("paragraph_id").alias("p"), F.count_if("forced").alias("f"), F.count_if("is_gap").alias("g"))
    then = Window.partitionBy(key).orderBy("ready_at").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c, name: F.sum(c).over(then).alias(name)
    return steps.select(key, "ready_at", total("n", "done"), (F.max("s").over(then) + 1).alias("sections"), (F.max("p").over(then) + 1).alias("paragraphs"), total("f", "forced"), total("g", "gaps"))


def missing(results: DataFrame, key: str, seq: str = "seq", first: int = 0) -> DataFrame:
    """Numbers from `first` to each session's last that have no row."""
    inside = Window.partitionBy(key).orderBy(seq)
    before = F.coalesce(F.lag(seq).over(inside), F.lit(first - 1))
    holes = results.select(key, seq).distinct().withColumn("__b", before).where(F.col(seq) - F.col("__b") > 1)
    return holes.select(key, F.explode(F.sequence(F.col("__b") + 1, F.col(seq) - 1)).alias("missing"))


def assert_complete(results: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The results; reading a session with a hole fails."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    top = F.max(seq).over(Window.partitionBy(key))
    told = F.concat(F.lit("missing results in session "), F.col(key).cast("string"))
    return results.withColumn("__ok", F.when(n == top + 1, True).otherwise(F.raise_error(told).cast("boolean"))).where("__ok").drop("__ok")


def with_gaps(results: DataFrame, key: str, seq: str = "seq", first: int = 0) -> DataFrame:
    """The results and a row for each missing number, with is_gap; a gap's other columns are null."""
    holes = missing(results, key, seq, first).withColumnRenamed("missing", seq)
    return results.withColumn("is_gap", F.lit(False)).unionByName(holes.withColumn("is_gap", F.lit(True)), allowMissingColumns=True)


def capped(requests: DataFrame, key: str, order: str, arrives: str, takes: str, cap: int = 4) -> DataFrame:
    """Add starts and ends of requests that at most `cap` workers serve, first come first served within a key.

    A fold over rows that Spark sorts; its state is the times at which the workers are free.
    """
    names = [*requests.columns, "starts", "ends"]
    at = [names.index(c) for c in (key, arrives, takes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, free = None, []
        for batch in batches:
            starts, ends = [], []
            for k, t, d in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if k != now or not free:
                    now, free = k, [0] * cap
                begin = max(t, free[0])
                heapq.heapreplace(free, begin + d)
                starts.append(begin)
                ends.append(begin + d)
            yield pa.record_batch([*batch.columns, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=names)

    usable = requests.where(F.col(key).isNotNull() & F.col(arrives).isNotNull() & F.col(takes).isNotNull())
    dealt = usable.repartition(key).sortWithinPartitions(key, arrives, order)
    return dealt.mapInArrow(run, requests.schema.add("starts", "long").add("ends", "long"))


def faulty(requests: DataFrame, faults: DataFrame, key: str, seq: str = "seq", retries: int = 2) -> DataFrame:
    """(key, seq, attempt, outcome, latency_s): what every allowed attempt of each request would end in.

    faults: (key, seq, latency_s, raises, transient): kinds of error that the first attempts meet one after
    the other, then `raises` if there is one, else success.  A request without a row succeeds at once.
    """
    planned = requests.select(key, seq).join(faults.select(key, seq, "latency_s", "raises", "transient"), [key, seq], "left")
    each = planned.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(retries))))
    passing = F.get(F.coalesce("transient", F.array().cast("array<string>")), F.col("attempt"))
    kind = F.coalesce(passing, "raises", F.lit("ok"))
    return each.select(key, seq, "attempt", F.when(retryable(kind), "retryable").otherwise(kind).alias("outcome"), F.coalesce("latency_s", F.lit(0.0)).alias("latency_s"))


def outcomes(attempts: DataFrame, key: str, seq: str, attempt: str = "attempt", outcome: str = "outcome", retries: int = 2, base_s: float = 0.5) -> DataFrame:
    """Where each request ends: the first attempt (from 0) that succeeds, can't be retried or is the last allowed.

    outcome: ok, or retryable, or any other word for an error that isn't.  Gives attempts made, whether the
    request became a gap and the seconds waited between attempts.
    """
    last = (F.col(outcome) != "retryable") | (F.col(attempt) == retries)
    ended = attempts.where(last & (F.col(attempt) <= retries)).groupBy(key, seq).agg(F.min(F.struct(attempt, outcome)).alias("x"))
    waited = base_s * (F.pow(F.lit(2.0), F.col(f"x.{attempt}")) - 1)
    return ended.select(key, seq, (F.col(f"x.{attempt}") + 1).alias("attempts"), F.col(f"x.{outcome}").alias("outcome"), (F.col(f"x.{outcome}") != "ok").alias("is_gap"), waited.alias("waited_s"))


def peak_concurrency(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Most intervals open at once; one that ends as another starts isn't open with it."""
    events = intervals.select(key, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e")).select(key, "e.*")
    moved = events.groupBy(key, "t", "d").agg(F.sum("d").alias("n"))
    run = Window.partitionBy(key).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return moved.withColumn("open", F.sum("n").over(run)).groupBy(key).agg(F.max("open").alias("peak"))


def queue_depth(intervals: DataFrame, key: str, start: str, end: str, limit: int = 8) -> DataFrame:
    """At each start, how many intervals are open with it, and whether that is more than `limit`."""
    events = intervals.select(key, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e")).select(key, "e.*")
    moved = events.groupBy(key, "t", "d").agg(F.sum("d").alias("n"))
    run = Window.partitionBy(key).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    depth = moved.withColumn("depth", F.sum("n").over(run)).where("d = 1")
    return depth.select(key, "t", "depth", (F.col("depth") > limit).alias("over_limit"))
