"""Mix sources to target weights by hash thresholds.

Words are summed by source and hash bucket; running sums over the few thousand buckets of a source show in
which bucket its budget ends; only that bucket is split again by the hash's next bits, until single hashes
remain.  A document is then taken by comparing its own hash with its source's threshold: nothing is sorted
and no document meets another.  All statistics are partial sums, so a source may hold any share of rows.

A null text has size 0.  A null source is a source, last in order.  Repeated rows have one hash and are
taken or left together.  Empty tables give no rows.  Reruns agree: hashes depend on doc_id and text alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, free, materialize

BITS, LEVELS, TOTAL = 12, 3, 63


def words(text: Column) -> Column:
    """Number of runs of [^\\x20\\x09-\\x0D]; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column) -> Column:
    """63 bits that decide on a document."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text, F.lit(11)), 1)


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Add target to (source, source_size): share by weight, none above cap x size, the excess reshared.

    Sources in code-point order, null last, take the weights in turn.  In order of size over weight the
    capped sources come first, so one pass of running sums finds the final level.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(place) - 1) % len(weights)
    weight = reduce(lambda a, i: F.when(turn == i, float(weights[i])).otherwise(a), range(len(weights)), F.lit(None).cast("double"))
    w = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    w = w.withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    every = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(every) * share - F.col("before")) / F.col("open"))
    w = w.withColumn("final", F.min(F.when(F.col("most") > F.col("level") * F.col("weight"), F.struct(F.col("most") / F.col("weight"), "source", "level"))).over(every)["level"])
    return w.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("final") * F.col("weight"), F.col("most"))).alias("target"))


def thresholds(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From (source, size, u): source, source_size, target, whole (copies of every document), below (documents with u below get one more)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(totals, weights, share, cap)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = materialize(plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    bounds = plan.select(F.col("source").alias("s"), "need", F.lit(0).cast("long").alias("prefix"))
    for level in range(1, LEVELS + 2):
        last = level == LEVELS + 1
        shift = 0 if last else TOTAL - BITS * level
        above = TOTAL - BITS * (level - 1)
        inside = sized.join(bounds, sized["source"].eqNullSafe(bounds["s"]) & (F.shiftright("u", above) == F.col("prefix") if level > 1 else F.lit(True)))
        cells = inside.groupBy("s", "need", F.shiftright("u", shift).alias("cell")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("s").orderBy("cell")
        summed = cells.withColumn("upto", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        # The cell in which the budget ends; at the last level a cell is one hash and is taken if that comes nearer.
        edge = F.min(F.when(F.col("upto") >= F.col("need"), F.struct("cell", (F.col("need") - F.col("upto") + F.col("n")).alias("left"), "n"))).alias("edge")
        found = summed.groupBy("s").agg(edge, F.max("cell").alias("top"), F.max("need").alias("need"))
        if last:
            end = F.when(F.col("need") <= 0, 0).when(F.col("edge").isNull(), F.col("top") + 1).when(F.col("edge.left") * 2 > F.col("edge.n"), F.col("edge.cell") + 1).otherwise(F.col("edge.cell"))
            ends = materialize(found.select("s", end.cast("long").alias("below")))
        else:
            cell = F.coalesce(F.col("edge.cell"), F.col("top"))
            bounds = materialize(found.select("s", F.coalesce(F.col("edge.left"), F.col("need")).alias("need"), cell.alias("prefix")))
    joined = plan.join(ends, plan["source"].eqNullSafe(ends["s"]), "left")
    return joined.select("source", "source_size", "target", "whole", F.when(F.col("need") > 0, F.coalesce("below", F.lit(0))).otherwise(0).cast("long").alias("below"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", into: str | None = None, **how) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the document).

    With `into`, these four are the fields of one column of that name; else columns of their names in the
    input are replaced.  `how`: weights, share, cap of `thresholds`.  The limits, a row a source, are
    broadcast if Spark finds them small enough.
    """
    names = (into,) if into else ("size", "source_size", "target", "copies")
    kept = [c for c in docs.columns if c not in names]
    t, s = F.col(f"`{text}`").cast("string"), F.col(f"`{source}`").cast("string")
    u = draw(F.col(f"`{doc_id}`").cast("string"), t)
    sized = materialize(docs.select(s.alias("source"), words(t).alias("size"), u.alias("u")))
    side = free(docs, "__limits")
    limits = materialize(thresholds(sized, **how).select(F.struct("source", "source_size", "target", "whole", "below").alias(side)))
    discard(sized)
    limit = lambda c: F.col(side).getField(c)
    out = docs.join(limits, s.eqNullSafe(limit("source")))
    copies = limit("whole") + (u < limit("below")).cast("long")
    made = [words(t).alias("size"), limit("source_size").alias("source_size"), limit("target").alias("target"), copies.alias("copies")]
    return out.select(*(F.col(f"`{c}`") for c in kept), *([F.struct(*made).alias(into)] if into else made))
