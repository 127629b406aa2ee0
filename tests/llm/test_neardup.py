import random

from quillspark.llm import neardup


def brute(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    name = list(range(len(rows)))

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                name[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def link(spark, rows, k=2):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in neardup.link(df, k=k).collect()), key=str)


def test_groups_chains_and_edges_match_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefgh") * rnd.randint(1, 3) + str(rnd.randint(0, 400))
    rows, n = [], 0
    for size, edits in ((60, 1), (60, 3), (120, 6), (12, 1), (5, 0), (400, 20)):
        base = [word() for _ in range(size)]
        for _ in range(14):
            rows.append((n, " ".join(base)))
            n += 1
            for _ in range(edits):  # each copy is made from the one before, so a group is a chain
                base[rnd.randrange(size)] = word()
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "One\x0btwo"), (n + 6, "É"), (n + 7, "é"), (n + 8, " ".join(word() for _ in range(30_000)))]
    want = sorted(brute(rows, 2), key=str)
    assert link(spark, rows) == want
    monkeypatch.setattr(neardup, "BLOCK", 4)  # buckets are split and their blocks meet
    assert link(spark, rows) == want


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    got = link(spark, [(5, "a b c"), (5, "a b c"), (5, "x y z"), (9, "x y z"), (None, "a b c")])
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False), (None, 2, None, True)], key=str)
    assert link(spark, []) == []


def test_keep_one_keeps_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "x"), (2, text + " end", None), (3, "else", "z"), (4, None, "n")], "doc_id long, text string, node string")
    got = neardup.keep_one(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4]


def test_a_large_group_below_the_threshold_gives_rows_in_proportion(spark, monkeypatch):
    """Near copies of one text at a likeness about 0.78: nearly all pairs must be confirmed, but none leaves its task."""
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for i in range(600):
        own = list(base)
        for at in rnd.sample(range(140), 9):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 600, 50)]
    for size in (2000, 100):  # whole buckets, and buckets in blocks
        monkeypatch.setattr(neardup, "BLOCK", size)
        made = {}
        write = neardup.materialize
        monkeypatch.setattr(neardup, "materialize", lambda d: made.setdefault(tuple(d.columns), []).append(n := (w := write(d)).count()) or w)  # noqa: F841
        assert link(spark, rows) == sorted(brute(rows, 2), key=str)
        monkeypatch.setattr(neardup, "materialize", write)
        assert max(made["a", "b"]) <= len(rows)  # of some 180,000 pairs


def test_intersections_and_forest_match_sets():
    import numpy as np

    rnd = random.Random(3)
    sets = [sorted(rnd.sample(range(60), rnd.randint(0, 50))) for _ in range(40)] + [list(range(20_000))] * 2
    offsets = np.cumsum([0] + [len(s) for s in sets])
    a, b = np.array([(i, j) for i in range(42) for j in range(i)]).T
    got = neardup.common(np.array(sum(sets, []), dtype=np.int64), offsets, a, b)
    assert got.tolist() == [len(set(sets[i]) & set(sets[j])) for i, j in zip(a, b)]
    assert neardup.forest(7, np.array([5, 6, 2]), np.array([6, 1, 3])).tolist() == [0, 1, 2, 2, 4, 1, 1]


def test_a_column_named_like_the_helper_stays(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, None, 9)], "doc_id long, text string, __kept int")
    assert sorted(tuple(r) for r in neardup.keep_one(df).collect()) == [(1, "a b c d e f", 7), (3, None, 9)]
