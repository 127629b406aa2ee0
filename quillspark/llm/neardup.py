"""Near-duplicates by MinHash bands, screened with odd sketches and confirmed on full shingle sets.

1. One pass over the texts gives each document's set size, two digests of its set, its bands and its odd
   sketch: its MinHash samples folded into a bitmap of parities.  Equal sets become one node.
2. Nodes that share a band meet in a bucket.  The population count of two sketches' XOR estimates their
   likeness; pairs well below the threshold go.  First every node is paired with the nearest of its
   buckets' leaders, so a group of near copies gives as many pairs as it has members.
3. A second pass makes the full sets of the paired nodes; intersections decide; links become components.
4. In buckets that hold several components, nodes outside the bucket's largest one meet all of other
   components, in blocks of at most BLOCK nodes and WEIGHT shingles a side.  A first pass over the sketches
   keeps the nodes that have a likely partner; these bring their full sets, and each block confirms its
   pairs by itself.  Pairs never leave a task: what comes out are the kept nodes and then the links that
   join components in that block, so both stay linear in a group's size, and no link is lost.

With R rows a band and B bands, a pair at likeness 0.8 shares no band with probability (1 - 0.8^R)^B,
about 1e-6; pairs above it, less.

A null text counts as empty; an empty text is linked with nothing and is its own component.  Rows with a
null id aren't linked (component null, kept true).  Repeated rows are in one component; an empty table
gives no rows.  Components are named by their smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, few_files, free, materialize, ship
from .text import LOWER, SPACE, U64, distinct_per_text, hashes, mix, signed, slices, tokens

ROWS, BANDS = 5, 35
#: MinHash samples: the first make the bands, all of them the sketch.
SAMPLES = 2 * ROWS * BANDS
BITS = 1024
#: Most differing bits of two sketches that go on to the full sets: those of likeness 0.8 and five deviations.
MOST_BITS = 180
#: Nodes and shingles of one side of a block.
BLOCK, WEIGHT = 2000, 1 << 22
#: Columns of the bitmaps that confirm a block's pairs, and pairs confirmed at once.
COLUMNS, AT_ONCE = 8192, 20_000
FILTER_BITS = 1 << 24
_rng = np.random.Generator(np.random.PCG64(97))
_MULTIPLY = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_SALT = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, and where each text's begin; fewer words are one shingle."""
    low = LOWER[data]
    starts, ends, first = tokens(low, offsets, SPACE)
    words = hashes(low, starts, ends)
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(begin[-1]) - begin[owner] + first[owner]
    made = np.full(len(at), 7, dtype=np.uint64)
    for i in range(k):
        here = at + i < first[owner + 1]
        made[here] = mix(made[here] * U64(0x9DDFEA08EB382D69) + words[at[here] + i])
    values, owners, _ = distinct_per_text(made, begin)
    return values, np.searchsorted(owners, np.arange(len(n) + 1))


def _digests(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each set."""
    totals = (np.concatenate([[U64(0)], np.cumsum(mix(values ^ U64(s)), dtype=np.uint64)]) for s in (3, 5))
    return [mix(t[first[1:]] - t[first[:-1]] + np.diff(first).astype(np.uint64)) for t in totals]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), check (a second digest), bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                values, first = shingle_sets(data, offsets, k)
                size = np.diff(first)
                some = np.flatnonzero(size)
                low, at = values.astype(np.uint32), first[some]
                samples = np.empty((SAMPLES, len(some)), dtype=np.uint32)
                if len(some):
                    for i in range(SAMPLES):
                        samples[i] = np.minimum.reduceat(low * _MULTIPLY[i] + _ADD[i], at)
                digests = _digests(values, first)
                bands = np.empty((len(some), BANDS), dtype=np.uint64)
                for j in range(BANDS):
                    h = np.full(len(some), j + 1, dtype=np.uint64)
                    for i in range(ROWS):
                        h = mix(h * U64(0xC2B2AE3D27D4EB4F) + samples[j * ROWS + i])
                    bands[:, j] = h
                places = (mix(samples.T.astype(np.uint64) + _SALT[None, :]) % U64(BITS)).astype(np.int64)
                flips = np.bincount((places + np.arange(len(some))[:, None] * BITS).ravel(), minlength=len(some) * BITS)
                sketch = np.packbits((flips & 1).astype(np.uint8)).reshape(len(some), BITS // 8)
                rank = np.cumsum(size > 0) - 1
                full = [bool(x) for x in size > 0]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(size, pa.int64()),
                        pa.array(signed(digests[0]), mask=size == 0),
                        pa.array(signed(digests[1])),
                        pa.array([signed(bands[rank[i]]) if full[i] else None for i in range(b - a)], pa.list_(pa.int64())),
                        pa.array([sketch[rank[i]].tobytes() if full[i] else None for i in range(b - a)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "check", "bands", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest long, check long, bands array<long>, sketch binary")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of whole groups from rows sorted by their first `keys` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        changed = np.zeros(table.num_rows - 1, dtype=bool)
        for i in range(keys):
            x = table.column(i).to_numpy()
            changed |= x[1:] != x[:-1]
        cut = np.flatnonzero(changed)
        if len(cut):
            yield table.slice(0, cut[-1] + 1)
            held = table.slice(cut[-1] + 1).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _group_starts(table: pa.Table, keys: int) -> np.ndarray:
    new = np.ones(table.num_rows, dtype=bool)
    if table.num_rows > 1:
        new[1:] = False
        for i in range(keys):
            x = table.column(i).to_numpy()
            new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new) - 1


def _apart(sketch: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the pairs' sketches; as many as there are if the set sizes alone rule likeness 0.8 out."""
    small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    bits = np.full(len(a), BITS, dtype=np.int64)
    left = np.flatnonzero(small * 100 >= large * 80)
    for part in np.array_split(left, max(1, len(left) // 100_000)):
        bits[part] = np.bitwise_count(sketch[a[part]] ^ sketch[b[part]]).sum(axis=1)
    return bits


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = b"".join(table["sketch"].to_pylist())
    return table["node"].to_numpy(), table["size"].to_numpy(), np.frombuffer(rows, dtype=np.uint64).reshape(table.num_rows, BITS // 64)


def _pairs(node: np.ndarray, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(node[a]), pa.array(node[b]), pa.array(bits, pa.int64())], names=["a", "b", "bits"])


def leader_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node with the first node of its bucket that it may be alike, in buckets sorted together."""
    for table in _grouped(batches, 2):
        group = _group_starts(table, 2)
        node, size, sketch = _columns(table)
        left = np.arange(len(node))
        while len(left):
            g = group[left]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            leader = np.repeat(left[first], np.diff(np.append(first, len(left))))
            others = leader != left
            a, b = left[others], leader[others]
            bits = _apart(sketch, size, a, b)
            ok = bits <= MOST_BITS
            if ok.any():
                yield _pairs(node, a[ok], b[ok], bits[ok])
            left = a[~ok]


def _likely(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a table of whole blocks that must be confirmed; see `blocks` for its columns.

    A pair counts in the first band that it shares only, and in one block of a bucket.
    """
    group = _group_starts(table, 3)
    node, size, sketch = _columns(table)
    comp, band = table["comp"].to_numpy(), table["band"].to_numpy()
    asks, there, other = (table[c].to_numpy() for c in ("asks", "there", "other"))
    bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)
    found = []
    for far in range(1, len(group)):
        a = np.flatnonzero(group[far:] == group[:-far])
        if not len(a):
            break
        b = a + far
        first = asks[a] & there[b] & (~other[b] | (node[a] < node[b]))
        second = asks[b] & there[a] & (~other[a] | (node[b] < node[a]))
        a = a[(comp[a] != comp[b]) & (first | second)]
        a = a[_apart(sketch, size, a, a + far) <= MOST_BITS]
        a = a[(bands[a] == bands[a + far]).argmax(axis=1) == band[a]]
        found.append((a, a + far))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def likely_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blocks that have a partner to be confirmed in their block."""
    for table in _grouped(batches, 3):
        rows = np.unique(np.concatenate(_likely(table)))
        if len(rows):
            yield from table.take(pa.array(rows)).combine_chunks().to_batches()


def common(values: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a, b) of sets: values from offsets[i] to offsets[i + 1]."""
    _, where, times = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    use = np.flatnonzero(times[where] > 1)  # what one set alone holds is in no intersection
    row, column = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[use], column[where[use]]
    out = np.zeros(len(a), dtype=np.int64)
    for lo in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        here = (column >= lo) & (column < lo + COLUMNS)
        bits = np.zeros((len(offsets) - 1, COLUMNS), dtype=bool)
        bits[row[here], column[here] - lo] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        packed = packed[:, : -(-min(COLUMNS, int(column.max()) + 1 - lo) // 64)]
        for i in range(0, len(a), AT_ONCE):
            out[i : i + AT_ONCE] += np.bitwise_count(packed[a[i : i + AT_ONCE]] & packed[b[i : i + AT_ONCE]]).sum(axis=1, dtype=np.int64)
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n things that each reaches by the links (a, b)."""
    name = np.arange(n)
    while True:
        low = np.minimum(name[a], name[b])
        new = name.copy()
        np.minimum.at(new, name[a], low)
        np.minimum.at(new, name[b], low)
        new = new[new[name]]
        if (new == name).all():
            return name
        name = new


def block_links(percent: int):
    """Links (a, b) between components, as many as join what a block's confirmed pairs join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 3):
            a, b = _likely(table)
            if not len(a):
                continue
            group = _group_starts(table, 3)
            comp = table["comp"].to_numpy()
            grams = table["grams"].combine_chunks()
            offsets, values = grams.offsets.to_numpy(), grams.values.to_numpy()
            order = np.argsort(group[a], kind="stable")
            a, b = a[order], b[order]
            edges = np.searchsorted(group[a], np.arange(group[-1] + 2))
            first = np.searchsorted(group, np.arange(group[-1] + 2))
            joined = []
            for g in np.flatnonzero(np.diff(edges)):
                lo, hi = first[g], first[g + 1]
                x, y = a[edges[g] : edges[g + 1]] - lo, b[edges[g] : edges[g + 1]] - lo
                own = offsets[lo : hi + 1]
                size = np.diff(own)
                both = common(values[own[0] : own[-1]], own - own[0], x, y)
                ok = both * 100 >= percent * (size[x] + size[y] - both)
                if ok.any():
                    names, at = np.unique(comp[lo:hi], return_inverse=True)
                    root = forest(len(names), at[x[ok]], at[y[ok]])
                    moved = np.flatnonzero(root != np.arange(len(names)))
                    joined.append((names[moved], names[root[moved]]))
            if joined:
                yield pa.record_batch([pa.array(np.concatenate([p[i] for p in joined])) for i in (0, 1)], names=["a", "b"])

    return run


def blocks(members: DataFrame, nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of the blocks of buckets with several components, sorted together by block (bucket, i, j).

    A node outside its bucket's largest component (`other`) asks, in its part i, all members' parts j.
    `asks` and `there` say in which of the two parts a row is meant in this block.
    """
    labelled = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = labelled.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
    held = per.groupBy("bucket").agg(F.max(F.struct("n", "grams", "comp")).alias("top"), F.sum("n").alias("n"), F.sum("grams").alias("grams"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    parts = lambda n, grams: F.ceil(F.greatest(n / BLOCK, grams / WEIGHT)).cast("int")
    mixed = held.select("bucket", F.col("top.comp").alias("largest"), parts(F.col("n"), F.col("grams")).alias("js"), parts(F.col("n") - F.col("top.n"), F.col("grams") - F.col("top.grams")).alias("is"))
    dealt = labelled.join(mixed, "bucket").withColumn("other", F.col("comp") != F.col("largest"))
    dealt = dealt.withColumn("own_i", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("is")).cast("int")).withColumn("own_j", F.pmod(F.xxhash64("node"), F.col("js")).cast("int"))
    place = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    meant = F.transform(F.sequence(F.lit(0), F.col("is") - 1), lambda i: place(i, F.col("own_j")))
    asking = F.transform(F.sequence(F.lit(0), F.col("js") - 1), lambda j: place(F.col("own_i"), j))
    dealt = dealt.join(nodes.select("node", "sketch", "bands"), "node")
    to = dealt.withColumn("to", F.explode(F.when(F.col("other"), F.array_distinct(F.concat(asking, meant))).otherwise(meant)))
    asks, there = F.col("other") & (F.col("own_i") == F.col("to.i")), F.col("own_j") == F.col("to.j")
    rows = to.select("bucket", "to.i", "to.j", "node", "size", "comp", "band", asks.alias("asks"), there.alias("there"), "other", "sketch", "bands")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")


def nearest(found: DataFrame) -> DataFrame:
    """(a, b), a < b: for each node the partner that seems nearest over all its buckets."""
    kept = found.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("x")).select("a", "x.b")
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node of edges (a, b) but its component's smallest, with that one; alternating large and small stars."""
    both = lambda e: e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        e = both(e)
        least = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return e.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()

    with few_files(edges.sparkSession):  # light work on tables that shrink
        edges, mark = materialize(small(edges.where("a <> b").distinct())), None
        while True:
            before, edges = edges, materialize(small(large(edges)))
            discard(before)
            seen = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
            if seen == mark:
                return edges
            mark = seen


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, grams (the whole set) of the wanted nodes; docs has doc_id and text, wanted has node, digest, check and rep (the id of one such document).

    A bitmap of fixed size, broadcast, lets most other texts pass unread; it may let some through, never stops one.
    """
    place = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))
    words = wanted.select(F.floor(place / 32).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(rep), {FILTER_BITS}) % 32 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    got = words.toArrow()
    table = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    table[got["w"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).to_numpy()
            keep = (held.value[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1) != 0
            for _, _, data, offsets in slices(batch.column(1).filter(pa.array(keep))):
                values, first = shingle_sets(data, offsets, k)
                digests = _digests(values, first)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(values)))
                yield pa.record_batch([*(pa.array(signed(d)) for d in digests), lists], names=["digest", "check", "grams"])

    found = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("p")).mapInArrow(run, "digest long, check long, grams array<long>")
    return found.join(wanted.select("node", "digest", "check"), ["digest", "check"]).dropDuplicates(["node"]).select("node", "grams")


def link(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs; see the module's docstring.

    Links: 100 * intersection >= percent * union of the sets of distinct k-word shingles; percent is 80 or more.
    """
    if percent < 80:
        raise ValueError("bands and sketches are made for a likeness of 0.8 or more")
    ship(docs.sparkSession)
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    signed_ = materialize(signatures(docs, k))
    usable = signed_.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    alike = usable.groupBy("digest", "check").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("size"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    nodes = materialize(alike.withColumn("node", F.monotonically_increasing_id()))  # numbers that are the rows' own: both digests tell sets apart
    placed = nodes.select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = materialize(placed.join(shared, "bucket"))

    led = members.select("bucket", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK)).cast("int").alias("part"), "node", "size").join(nodes.select("node", "sketch"), "node")
    led = led.select("bucket", "part", "node", "size", "sketch").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "node")
    pairs = materialize(nearest(led.mapInArrow(leader_pairs, "a long, b long, bits long")))
    needed = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(needed.join(nodes.select("node", "digest", "check", "rep"), "node"))
    sets = materialize(_sets(docs, wanted, k))
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    edges = materialize(pairs.join(left, "a").join(right, "b").where(both * 100 >= percent * (F.size("ga") + F.size("gb") - both)).select("a", "b"))
    discard(pairs, wanted, sets)
    comp = _whole(edges)

    dealt = blocks(members, nodes, comp)
    kept = materialize(dealt.mapInArrow(likely_nodes, dealt.schema))
    wanted = materialize(kept.select("node").distinct().join(nodes.select("node", "digest", "check", "rep"), "node"))
    full = kept.join(_sets(docs, wanted, k), "node").select(*dealt.columns, "grams")
    across = materialize(full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node").mapInArrow(block_links(percent), "a long, b long"))
    discard(kept, wanted, members, edges)
    joined = _whole(across).select(F.col("node").alias("comp"), F.col("comp").alias("last"))

    named = nodes.select("node", "digest", "check", "rep").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = named.join(joined, "comp", "left").withColumn("comp", F.coalesce("last", "comp")).select("digest", "check", "rep", "comp")
    names = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(names, "comp").select("digest", "check", "component_id"))
    discard(nodes, comp, across)
    out = signed_.select("doc_id", "n_shingles", "digest", "check").join(named, ["digest", "check"], "left")
    own_name = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own_name.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _whole(edges: DataFrame) -> DataFrame:
    """node, comp of all nodes of edges (a, b), the components' smallest ones too."""
    stars = components(edges)
    made = materialize(stars.unionAll(stars.select("b", "b").distinct()).toDF("node", "comp"))
    discard(stars)
    return made


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Documents without those that have a near copy, direct or through others, with a smaller id.

    Rows that repeat an id stay or go together; rows with a null id stay.
    """
    name = free(docs, "__kept")
    kept = link(docs, k, percent).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
