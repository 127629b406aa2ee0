"""Exact top-k search by inner product: a KD-tree for each shard, searched best box first.

Vectors become integers, floor(scale * x).  Equal (id, vector) rows are folded into one with a count; shards
are hash buckets of about `shard_rows` vectors.  Rows are sorted by shard with the vectors first: a task builds
each shard's tree once and streams the queries past it, so it holds one shard and one batch of queries
whatever the table's size, and what is shuffled grows with the vectors plus queries times shards.  Every
query first meets one shard to get a k-th score; that bound goes with it to the other shards, where boxes are
bounded as they are reached, the root first, and only those that can reach the bound are opened.  Each shard
returns at most k rows a query; their best k are kept by a partial aggregation.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, ship

LONG = 2**63 - 1


class KDTree:
    """Median splits of the widest dimension down to `leaf` points; every node keeps its tight bounding box."""

    def __init__(self, points: np.ndarray, leaf: int = 64) -> None:
        self.order = np.arange(len(points))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        lows, highs = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            node, rows = len(self.spans), points[self.order[lo:hi]]
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = node
                self.children[parent] = tuple(pair)
            low, high = rows.min(axis=0), rows.max(axis=0)
            self.spans.append((lo, hi))
            self.children.append(None)
            lows.append(low)
            highs.append(high)
            axis = int(np.argmax(high - low)) if rows.shape[1] else 0
            if hi - lo > leaf and rows.shape[1] and high[axis] > low[axis]:
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(rows[:, axis], mid)]
                self.children[node] = (-1, -1)
                todo += [(lo, lo + mid, node, 0), (lo + mid, hi, node, 1)]
        self.points, self.low, self.high = points[self.order], np.array(lows), np.array(highs)

    def search(self, query: np.ndarray, ids: np.ndarray, copies: np.ndarray, k: int, least) -> list[tuple]:
        """The k best (score, id, copies), equal scores by smaller id; nothing below `least` is sought."""
        best: list[tuple] = []  # a heap with the worst first: (score, -id, copies)
        held, kth = 0, least
        zero = query.dtype.type(0) if query.dtype != object else 0
        up, down = np.maximum(query, zero), np.minimum(query, zero)
        # The highest inner product that a point in the node's box can have.
        held_to = (lambda x: x) if query.dtype != object else np.frompyfunc(lambda x: max(-LONG, min(LONG, x)), 1, 1)
        bound_of = lambda node: held_to(up @ self.high[node] + down @ self.low[node])
        heap = [(-bound_of(0), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    reach = bound_of(child)
                    if reach >= kth:
                        heapq.heappush(heap, (-reach, child))
                continue
            lo, hi = self.spans[node]
            scores = held_to(self.points[lo:hi] @ query)
            for i in np.flatnonzero(scores >= kth):
                at = self.order[lo + i]
                if copies[at] > 0:
                    n = min(int(copies[at]), k)
                    heapq.heappush(best, (scores[i], -int(ids[at]), n))
                    held += n
                    while held - best[0][2] >= k:
                        held -= heapq.heappop(best)[2]
                    if held >= k:
                        kth = max(kth, best[0][0])
        return best


def quantize(df: DataFrame, vector: str = "embedding", scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null for a vector that is null, empty or holds null or non-finite values."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _top(x: np.ndarray) -> int:
    return max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))


class Shard:
    """One shard's vectors, with a tree in the type that holds every inner product with a batch of queries exactly."""

    def __init__(self, rows: pa.Table, leaf: int) -> None:
        self.points, self.leaf = _matrix(rows["vec"]), leaf
        self.ids, self.copies = rows["ident"].to_numpy(), rows["n"].to_numpy().copy()
        self.row_of = {x: i for i, x in enumerate(rows["own"].to_pylist())}
        self.top, self.trees = _top(self.points), {}

    def answers(self, asked: pa.Table, k: int) -> Iterator[tuple[int, int, int, int]]:
        """(query's key, score, id, copies) of the best rows of every query."""
        queries = _matrix(asked["vec"])
        most = self.top * _top(queries) * max(1, self.points.shape[1])
        kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
        if kind not in self.trees:
            self.trees[kind] = KDTree(self.points.astype(kind), self.leaf)
        queries, keys, least = queries.astype(kind), asked["own"].to_numpy(), asked["bound"].to_pylist()
        for i in range(len(queries)):
            mine = self.row_of.get(keys[i])  # a query leaves out one copy of its own row
            if mine is not None:
                self.copies[mine] -= 1
            floor = least[i] if least[i] is not None else -float("inf")
            for score, minus_id, n in self.trees[kind].search(queries[i], self.ids, self.copies, k, floor):
                yield int(keys[i]), int(score), -minus_id, n
            if mine is not None:
                self.copies[mine] += 1


def _meet(k: int, leaf: int):
    """Answers from rows sorted by (dim, shard, asks): a shard's vectors, then its queries."""
    names = ["query_key", "score", "vec_id", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        place, shard = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = [table.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            changed = np.zeros(max(0, len(marks[0]) - 1), dtype=bool)
            for x in marks:
                changed |= x[1:] != x[:-1]
            edges = [0, *(np.flatnonzero(changed) + 1), table.num_rows] if table.num_rows else [0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                here, rows = (marks[0][lo], marks[1][lo]), table.slice(lo, hi - lo)
                if here != place:
                    place, shard, held = here, None, []
                if not marks[2][lo]:
                    held.append(rows)
                elif held or shard:
                    if shard is None:
                        shard, held = Shard(pa.concat_tables(held), leaf), []
                    found = list(shard.answers(rows, k))
                    if found:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

    return run, "query_key long, score long, vec_id long, n long"


def search(vectors: DataFrame, is_query: Column, k: int = 10, ident: str = "vec_id", vector: str = "embedding", scale: int = 1024, shard_rows: int = 8192, leaf: int = 64) -> DataFrame:
    """For each row of `is_query` its k best others: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id.  Rows with a null id, or a vector that is null, empty or holds null or
    non-finite values, take no part.  Vectors of different lengths are not compared.  Repeated rows are
    separate candidates and separate queries; a query leaves out one row, its own.  Scores beyond 64 bits
    are held at the largest.  An empty table gives no rows; a query with fewer candidates has fewer rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select(F.col(f"`{ident}`").cast("long").alias("vec_id"), quantize(vectors, vector, scale).alias("vec"), is_query.alias("asks"))
    base = base.where(F.col("vec").isNotNull() & F.col("vec_id").isNotNull())
    folded = base.groupBy("vec_id", "vec").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("asks"))
    folded = materialize(folded.withColumn("own", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")))
    rows = folded.count()
    # Smaller shards for a small table, so that there is work for more than one task.
    shards = max(1, -(-rows // shard_rows), min(48, rows // 512))
    shard = F.pmod(F.xxhash64("own"), F.lit(shards)).cast("int")
    candidates = folded.select("dim", shard.alias("shard"), F.lit(False).alias("asks"), F.col("vec_id").alias("ident"), "own", "vec", "n", F.lit(None).cast("long").alias("bound"))
    queries = folded.where("asks").select("dim", shard.alias("shard"), F.lit(True).alias("asks"), F.col("vec_id").alias("ident"), "own", "vec", "n", F.lit(None).cast("long").alias("bound"))
    run, schema = _meet(k, leaf)

    def meet(asked: DataFrame) -> DataFrame:
        dealt = candidates.unionByName(asked).repartition(max(shards, 2), "dim", "shard").sortWithinPartitions("dim", "shard", "asks")
        return dealt.mapInArrow(run, schema)

    # Its own shard gives every query a first k-th score.
    found = materialize(meet(queries))
    kth = found.groupBy("query_key").agg(F.min("score").alias("kth"), F.sum("n").alias("held")).where(F.col("held") >= k)
    bounded = queries.drop("bound").join(kth.select(F.col("query_key").alias("own"), F.col("kth").alias("bound")), "own", "left")
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda x: x != F.col("home")))
    rest = bounded.withColumnRenamed("shard", "home").withColumn("shard", others).drop("home")
    both = found.unionByName(meet(rest)) if shards > 1 else found
    # A shard's answers for a query are at most k rows, so no group holds more than k times the shards; folded in halves.
    salted = both.withColumn("salt", F.pmod(F.xxhash64("vec_id", "score"), F.lit(max(1, shards // 16))))
    best = lambda d, keys: d.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "n"))), 1, k).alias("top"))
    part = best(salted, ["query_key", "salt"]).select("query_key", F.inline("top")).withColumn("score", -F.col("minus"))
    top = best(part, ["query_key"]).select("query_key", F.posexplode("top").alias("pos", "x"))
    copies = top.select("query_key", "pos", "x.vec_id", (-F.col("x.minus")).alias("score"), F.explode(F.sequence(F.lit(1), F.col("x.n"))).alias("copy"))
    ranked = copies.groupBy("query_key").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "copy", "vec_id", "score"))), 1, k).alias("top"))
    asked = folded.where("asks").select(F.col("own").alias("query_key"), F.col("vec_id").alias("query_id"), F.col("n").alias("times"))
    out = ranked.join(asked, "query_key").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
