"""Consistent terms: cluster like-sounding and like-spelt words of a session and rewrite the rare ones."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import affix_parts, common_words, core, phonetic_key, words_of


def cores(texts: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """(key, core, n, first, surface): each session's cores, how often and where first, and the form used most (the earlier of equals)."""
    each = texts.select(key, order, F.posexplode(words_of(F.col(text))).alias("pos", "token"))
    place = F.struct(order, "pos")
    forms = each.withColumn("surface", affix_parts(F.col("token"))[1]).withColumn("core", core(F.col("surface"))).where("core <> ''")
    counted = forms.groupBy(key, "core", "surface").agg(F.count(F.lit(1)).alias("__uses"), F.min(place).alias("__at"))
    best = F.min_by("surface", F.struct((-F.col("__uses")).alias("uses"), "__at"))
    return counted.groupBy(key, "core").agg(F.sum("__uses").alias("n"), F.min("__at").alias("first"), best.alias("surface"))


def candidates(counted: DataFrame, min_len: int = 5) -> DataFrame:
    return counted.where((F.length("core") >= min_len) & ~F.array_contains(common_words(), F.col("core")))


#: Words up to this length meet by forms with letters left out, of which they have a bounded number.
SHORT = 24
#: Words of a session whose forms one task sorts at once; a larger session's forms are dealt over several tasks by their hashes.
PART = 20_000
#: Pairs that a task holds before it hands them on.
HELD = 200_000


def met(found: DataFrame, key: str, distance: int = 2) -> DataFrame:
    """Pairs (a, b) of a session's cores that sound alike or may be spelt alike, a first, with both sides' n, at and surface.

    sound: each core with the first of its session that has the same phonetic key, a star instead of all pairs.
    Others share what two words within the distance must share: shorter ones a form with as many letters left out,
    longer ones one of distance + 1 segments.  Forms never leave their task; a pair may come more than once.
    """
    if distance not in (1, 2):
        raise ValueError("the distance must be 1 or 2")
    inside, short, held_most = Window.partitionBy(key), SHORT, HELD
    numbered = found.where(F.col(key).isNotNull()).select(key, "core", "n", "surface", phonetic_key(F.col("core")).alias("phonetic"), F.rank().over(inside.orderBy("first")).alias("at"), F.row_number().over(inside.orderBy("first")).alias("place"), F.ceil(F.count(F.lit(1)).over(inside) / PART).cast("int").alias("parts"))
    dealt = numbered.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition(key, "part").sortWithinPartitions(key, "part", "place")

    def sessions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(batch.column("place").to_numpy() == 1)
            if len(begins) and (held or begins[-1]):
                yield pa.Table.from_batches([*held, batch.slice(0, begins[-1])])
                held = []
            held.append(batch.slice(begins[-1]) if len(begins) else batch)
        if held:
            yield pa.Table.from_batches(held)

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        return x ^ (x >> np.uint64(28))

    def forms(cores: list[str], size: np.ndarray, group: np.ndarray, part: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shorter words' forms with up to `distance` letters left out, and whose they are."""
        letters = np.frombuffer("".join(cores).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        letters = (letters + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        letters ^= letters >> np.uint64(29)
        begin = np.cumsum(size) - size
        step = 0xD1342543DE82EF95
        back = np.uint64(pow(step, -1, 1 << 64))
        signs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for n in np.unique(size[size <= short + distance]):
            power = np.array([pow(step, i, 1 << 64) for i in range(n)], dtype=np.uint64)
            i, j = np.triu_indices(n, 1)
            same_length = np.flatnonzero(size == n)
            for rows in np.array_split(same_length, -(-len(same_length) // 5000)):
                word = letters[begin[rows][:, None] + np.arange(n)] * power
                upto = np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum(word, axis=1, dtype=np.uint64)], axis=1)
                whole = upto[:, -1:]
                made = [whole, upto[:, :-1] + (whole - upto[:, 1:]) * back]
                if distance == 2:
                    made.append(upto[:, i] + (upto[:, j] - upto[:, i + 1]) * back + (whole - upto[:, j + 1]) * (back * back))
                sign = mixed(np.concatenate(made, axis=1))
                # A form belongs to the same part in each of its session's tasks.
                mine = (sign >> np.uint64(20)) % parts[rows].astype(np.uint64)[:, None] == part[rows].astype(np.uint64)[:, None]
                signs.append(mixed(sign + group[rows].astype(np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F))[mine])
                owners.append(np.repeat(rows, mine.sum(axis=1)))
        return np.concatenate(signs), np.concatenate(owners)

    def by_forms(table: pa.Table, cores: list[str], size: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        signs, owners = forms(cores, size, group, table["part"].to_numpy(), table["parts"].to_numpy())
        order = np.argsort(signs)
        signs, owners = signs[order], owners[order]
        left, far = np.arange(len(signs)), 0
        while len(left):
            far += 1
            left = left[: np.searchsorted(left, len(signs) - far)]
            left = left[signs[left] == signs[left + far]]
            for some in np.array_split(left, max(1, -(-len(left) // held_most))):
                yield owners[some], owners[some + far]

    def by_segments(table: pa.Table, cores: list[str], size: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        long = np.flatnonzero(size > short).tolist()
        part, parts = (table[c].to_pylist() if long else [] for c in ("part", "parts"))
        many = distance + 1

        def pieces(i: int, m: int, shifts: range) -> Iterator[tuple]:
            one, word = m // many, cores[i]
            for k in range(many):
                for at in {max(0, k * one + shift) for shift in shifts}:
                    piece = word[at : at + (one if k < distance else m - k * one)]
                    if parts[i] == 1 or zlib.crc32(piece.encode()) % parts[i] == part[i]:
                        yield group[i], m, k, piece

        places: dict[tuple, list[int]] = {}
        for i in long:
            for sign in pieces(i, len(cores[i]), range(1)):
                places.setdefault(sign, []).append(i)
        for i in long:
            n = len(cores[i])
            for m in range(n - distance, n + distance + 1):
                for sign in pieces(i, m, range(-distance, distance + 1)):
                    if others := places.get(sign):
                        yield np.full(len(others), i), np.array(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sessions(batches):
            cores, at, group = table["core"].to_pylist(), table["at"].to_numpy(), np.cumsum(table["place"].to_numpy() == 1)
            size = np.fromiter(map(len, cores), np.int64, len(cores))

            def made(a: np.ndarray, b: np.ndarray, sound: bool, table: pa.Table = table) -> Iterator[pa.RecordBatch]:
                for lo in range(0, len(a), 5000):
                    x, y = (table.take(pa.array(v[lo : lo + 5000])) for v in (a, b))
                    columns = [x[key], *(t[c] for c in ("core", "n", "at", "surface") for t in (x, y)), pa.array([sound] * len(x))]
                    yield from pa.table(columns, names=names).combine_chunks().to_batches()

            # Rows stand in the order of their places, so the first of a sound is its session's first.
            heads: dict[tuple, int] = {}
            lead = np.array([i if p else heads.setdefault((g, s), i) for i, (p, g, s) in enumerate(zip(table["part"].to_pylist(), group.tolist(), table["phonetic"].to_pylist(), strict=True))], dtype=np.int64)
            alike = np.flatnonzero(lead != np.arange(len(lead)))
            yield from made(lead[alike], alike, True)
            held: list[np.ndarray] = []
            for way in (by_forms, by_segments):
                for a, b in way(table, cores, size, group):
                    ok = (at[a] != at[b]) & (np.abs(size[a] - size[b]) <= distance)
                    a, b = a[ok], b[ok]
                    held.append(np.where(at[a] < at[b], a, b) * len(at) + np.where(at[a] < at[b], b, a))
                    if sum(map(len, held)) > held_most or len(held) > 5000:
                        held = [np.unique(np.concatenate(held))]
                        if len(held[0]) > held_most // 2:
                            yield from made(held[0] // len(at), held[0] % len(at), False)
                            held = []
            if held:
                rest = np.unique(np.concatenate(held))
                yield from made(rest // len(at), rest % len(at), False)

    names = [key, "a", "b", "a_n", "b_n", "a_at", "b_at", "a_surface", "b_surface", "sound"]
    kinds = [found.schema[key].dataType, *[T.StringType()] * 2, *[found.schema["n"].dataType] * 2, *[T.IntegerType()] * 2, *[T.StringType()] * 2, T.BooleanType()]
    return dealt.mapInArrow(run, T.StructType([T.StructField(c, kind) for c, kind in zip(names, kinds, strict=True)]))


def spelling_edges(found: DataFrame, key: str, distance: int = 2) -> DataFrame:
    """Pairs of a session's cores within an edit distance of 1 or 2, each once; the built-in distance decides."""
    near = F.levenshtein("a", "b", distance).between(0, distance)
    return met(found, key, distance).where(~F.col("sound") & near).select(key, "a", "b").distinct()


def remap(texts: DataFrame, key: str, order: str, text: str = "text", distance: int = 2, min_len: int = 5, min_cluster: int = 2) -> DataFrame:
    """(key, core, replacement): what to write for the minority cores of clusters that have a strict winner.

    Clusters are found by union-find over one session's links at a time.
    """
    found = candidates(cores(texts, key, order, text), min_len)
    edges = met(found, key, distance).where(F.col("sound") | F.levenshtein("a", "b", distance).between(0, distance))

    def rewrite(table: pa.Table) -> pa.Table:
        rows = {c: table[c].to_pylist() for c in table.column_names if c != key}
        about: dict[str, tuple] = {}
        for side in "ab":
            for core_, n, at, surface in zip(rows[side], rows[f"{side}_n"], rows[f"{side}_at"], rows[f"{side}_surface"], strict=True):
                about[core_] = -n, -len(core_), at, surface
        parent = {c: c for c in about}

        def find(x: str) -> str:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(rows["a"], rows["b"], strict=True):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        clusters: dict[str, list[str]] = {}
        for c in about:
            clusters.setdefault(find(c), []).append(c)
        old, new = [], []
        for cluster in clusters.values():
            first, second, *_ = ranked = sorted(cluster, key=about.__getitem__)
            if about[first][0] != about[second][0] and -sum(about[c][0] for c in cluster) >= min_cluster:
                old += ranked[1:]
                new += [about[first][3]] * (len(ranked) - 1)
        return pa.table({key: pa.array([table[key][0].as_py()] * len(old), table[key].type), "core": pa.array(old, pa.string()), "replacement": pa.array(new, pa.string())})

    return edges.groupBy(key).applyInArrow(rewrite, T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("core", T.StringType()), T.StructField("replacement", T.StringType())]))


def clean(texts: DataFrame, key: str, order: str, text: str = "text", **how) -> DataFrame:
    """(key, order, clean): each row's text with minority cores rewritten; a session without any keeps its texts as they are."""
    new = remap(texts, key, order, text, **how)
    each = texts.select(key, order, F.posexplode(words_of(F.col(text))).alias("pos", "token"))
    lead, word, trail = affix_parts(F.col("token"))
    named = each.select(key, order, "pos", "token", lead.alias("lead"), core(word).alias("core"), trail.alias("trail"))
    put = named.join(new, [key, "core"], "left").withColumn("token", F.coalesce(F.concat("lead", "replacement", "trail"), "token"))
    rebuilt = put.groupBy(key, order).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
    changed = new.select(key).distinct().withColumn("changed", F.lit(True))
    wide = texts.select(key, order, text).join(changed, key, "left").join(rebuilt, [key, order], "left")
    joined = F.coalesce(F.array_join(F.transform("t", lambda x: x["token"]), " "), F.lit(""))
    return wide.select(key, order, F.when(F.col("changed"), joined).otherwise(F.col(text)).alias("clean"))
