"""Sessions of a frame stream: minimum and maximum length, pause, overlap after a forced cut."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECOND = 1_000_000
SEGMENT = "seq int, t_start long, t_end long, lead_pause long, forced boolean"


@dataclass(frozen=True)
class CutPolicy:
    """Limits in microseconds."""

    minimum: int = 6 * SECOND
    pause: int = 600_000
    maximum: int = 108 * SECOND
    overlap: int = 2 * SECOND

    def widened(self, pause: int) -> "CutPolicy":
        return replace(self, pause=pause)


@dataclass
class Cutter:
    """One session's state: frames go in by time, at most one segment comes out for each."""

    policy: CutPolicy
    seq: int = 0
    open: bool = False
    start: int = 0
    content: int = 0
    spoken: int = 0
    ended: int = 0
    lead: int = 0

    def frame(self, t: int, speech: bool) -> tuple | None:
        if speech:
            if not self.open:
                self.open, self.start, self.content, self.lead = True, t, t, max(0, t - self.ended)
            self.spoken = t
        elif not self.open:
            return None
        if t - self.start >= self.policy.maximum:
            return self._cut(t, True)
        if not speech and t - self.spoken >= self.policy.pause and self.spoken - self.content >= self.policy.minimum:
            return self._cut(self.spoken, False)
        return None

    def flush(self) -> tuple | None:
        """What is left at the end; an overlap without new speech is nothing."""
        made = self._cut(self.spoken, False) if self.open and self.spoken > self.content else None
        self.open = False
        return made

    def _cut(self, end: int, forced: bool) -> tuple:
        made = (self.seq, self.start, end, self.lead, forced)
        self.seq, self.ended, self.open = self.seq + 1, end, forced
        if forced:
            self.start, self.content, self.spoken, self.lead = max(0, end - self.policy.overlap), end, end, 0
        return made


def cut(frames: DataFrame, policy: CutPolicy, key: str = "session", time: str = "t_us", speech: str = "is_speech", order: tuple[str, ...] = ()) -> DataFrame:
    """Segments (key and SEGMENT) of each session's frames, in the order of time and `order`.

    The rule is a fold that can't be split: sessions are spread over tasks, sorted by Spark (which spills)
    and streamed through a fold with constant memory, however long a session is.
    """
    kind = frames.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in SEGMENT.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cutter, rows = None, None, []
        for batch in batches:
            for k, t, s in zip(batch[key].tolist(), batch[time].tolist(), batch[speech].tolist(), strict=True):
                if cutter is None or k != now:
                    if cutter is not None and (made := cutter.flush()):
                        rows.append((now, *made))
                    now, cutter = k, Cutter(policy)
                if made := cutter.frame(t, s):
                    rows.append((k, *made))
            if rows:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if cutter is not None and (made := cutter.flush()):
            yield pd.DataFrame([(now, *made)], columns=names)

    picked = frames.select(key, time, speech, *order).where(F.col(key).isNotNull() & F.col(time).isNotNull())
    dealt = picked.withColumn(speech, F.coalesce(speech, F.lit(False))).repartition(key).sortWithinPartitions(key, time, *order)
    return dealt.mapInPandas(run, f"{key} {kind}, {SEGMENT}")


def fixed_chop(frames: DataFrame, length: int, key: str = "session", time: str = "t_us") -> DataFrame:
    """Windows of a fixed length from 0 to each session's last frame; the last one is shorter."""
    ends = frames.groupBy(key).agg(F.max(time).alias("total"))
    seq = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("total") / length).cast("int") - 1)))
    cut_ = ends.where("total > 0").select(key, "total", seq.alias("seq"))
    return cut_.select(key, "seq", (F.col("seq") * F.lit(length).cast("long")).alias("t_start"), F.least((F.col("seq") + 1) * F.lit(length).cast("long"), "total").alias("t_end"))


def gap_sessions(frames: DataFrame, pause: int, key: str = "session", time: str = "t_us", speech: str = "is_speech", order: tuple[str, ...] = ()) -> DataFrame:
    """Runs of speech without limits on length: a new one after at least `pause` without speech."""
    inside = Window.partitionBy(key).orderBy(time, *order)
    spoken = frames.where(F.col(speech))
    new = F.coalesce((F.col(time) - F.lag(time).over(inside) >= pause).cast("int"), F.lit(0))
    numbered = spoken.withColumn("__new", new).withColumn("seq", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy(key, "seq").agg(F.min(time).alias("t_start"), F.max(time).alias("t_end"), F.count(F.lit(1)).alias("frames"))


def forced_rate(segments: DataFrame, key: str = "session") -> DataFrame:
    return segments.groupBy(key).agg(F.count(F.lit(1)).alias("segments"), F.count_if("forced").alias("forced"), (F.count_if("forced") / F.count(F.lit(1))).alias("forced_rate"))
