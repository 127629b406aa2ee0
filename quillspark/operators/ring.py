"""Retention of a recording: what may be forgotten, and which byte ranges can still be read.

Each session's events come in an order of their own: `write` adds samples, `confirm` says that nothing before a
sample is needed any more, `pin` keeps everything from a sample on (the last pin counts).  The base is the
first sample still held: it moves up to the least of what is confirmed, pinned and written, never back.  All of
it is running sums and maxima, so a long session is sorted and spilled by Spark, not held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("write", "confirm", "pin")


def retention(events: DataFrame, key: str, order: str, kind: str = "kind", value: str = "value") -> DataFrame:
    """Add written, confirmed, pinned (null without a pin) and base after each event.

    value: the number of samples written, or the sample that is confirmed or pinned.  A null value or an
    unknown kind changes nothing.
    """
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    of = lambda name: F.when(F.col(kind) == name, F.col(value))
    wide = events.withColumn("written", F.coalesce(F.sum(of("write")).over(so_far), F.lit(0)).cast("long"))
    wide = wide.withColumn("confirmed", F.greatest(F.lit(0), F.coalesce(F.max(of("confirm")).over(so_far), F.lit(0))).cast("long"))
    wide = wide.withColumn("pinned", F.last(of("pin"), ignorenulls=True).over(so_far).cast("long"))
    return wide.withColumn("base", F.greatest(F.lit(0).cast("long"), F.max(F.least("confirmed", "pinned", "written")).over(so_far)))


def sliced(start: Column, end: Column, base: Column, written: Column, rate: int, frame_bytes: int = 2) -> Column:
    """Byte range that a request for seconds from start to end reads, or why it can't: pruned or unwritten."""
    first, last = F.rint(start * rate).cast("long"), F.rint(end * rate).cast("long")
    error = F.when(first < base, "pruned").when(last > written, "unwritten")
    byte = lambda x: F.when(error.isNull(), (x - base) * frame_bytes)
    return F.struct(error.alias("error"), byte(first).alias("from_byte"), byte(last).alias("to_byte"))
