import hashlib
import json
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import imatch, licenses, mixing, packing, ppm, quality, topk, toxicity
from quillspark.llm.shared import tokenizer_path
from quillspark.llm.text import Lookup, hash_of

EDGES = [None, "", " ", "a", "É é́ Σας ΣΑΣ", "the cat " * 3000, "x" * 100_000, "<|endoftext|> it's 12 don't", "tab\tnew\nline\x0b\x0c"]


def test_lookup_finds_what_it_holds():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 2**63, 5000, dtype=np.uint64))
    table = Lookup(keys)
    assert (table.get(keys) == np.arange(len(keys))).all()
    assert (table.get(rnd.integers(2**63, 2**64 - 1, 5000, dtype=np.uint64)) == -1).all()
    assert (Lookup(np.zeros(0, np.uint64)).get(keys) == -1).all()


# ---- top-k ------------------------------------------------------------------------------------------------


def test_topk_matches_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.25, 0.7]) for _ in range(6)]) for i in range(400)]
    rows += [(100, [0.1] * 6), (7, rows[7][1]), (200, rows[200][1]), (500, None), (600, []), (700, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (800, [float("nan")] * 6), (900, [1.0, 2.0]), (None, [0.5] * 6), (1000, [3.0e30] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, own int")
    got = topk.search(df, F.col("vec_id") % 100 == 0, k=10, shard_rows=50, leaf=8).collect()
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for at, (q, v) in enumerate(good):
        if q % 100 == 0:
            hits = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for j, (i, w) in enumerate(good) if j != at and len(w) == len(v))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits[:10])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, F.col("vec_id") % 100 == 0).count() == 0


# ---- fingerprints -----------------------------------------------------------------------------------------


def test_fingerprints_of_edited_texts(spark):
    rnd = random.Random(3)
    rows = [(i * 3 % 101, " ".join(f"w{int(rnd.paretovariate(0.7)) % 5000}" for _ in range(rnd.randint(0, 120)))) for i in range(101)]
    rows += [(200 + i, t) for i, t in enumerate(EDGES)] + [(200, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in imatch.compare_edited(df, low=0.01, high=0.5).collect():
        got.setdefault((r["doc_id"], r["n_chars"]), []).append(r)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    assert sum(map(len, got.values())) == len(rows)
    prints = {}
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        sha = hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()
        found = [r for r in got[d, len(t)] if r["edited_sha256"] == sha]
        assert found, d
        assert prints.setdefault(t, found[0]["fingerprint"]) == found[0]["fingerprint"]
        assert 0 <= found[0]["near_edited"] <= 1 and 0 <= found[0]["near_next"] <= 1
    every = [r for x in got.values() for r in x]
    assert sum(r["near_edited"] for r in every) > sum(r["near_next"] for r in every)
    one = imatch.compare_edited(spark.createDataFrame([(1, "only one here")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0
    assert imatch.compare_edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_and_likeness_match_sets_of_terms(spark):
    """A second implementation on Python sets: which terms each lexicon keeps of each text."""

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = ((x ^ (x >> shift)) * factor) % 2**64
        return x

    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.6)) % 900}" for _ in range(rnd.choice([3, 30, 300])))) for i in range(60)]
    rows += [(100, rows[5][1]), (101, rows[5][1].upper()), (102, "nothing here is in the band"), (103, "")]
    low, high, n = 0.04, 0.4, len(rows)
    terms = {i: set(t.lower().split()) for i, t in rows}
    often = {}
    for ts in terms.values():
        for t in ts:
            often[t] = often.get(t, 0) + 1
    band = {t for t, c in often.items() if low * n <= c <= high * n}

    def parts(ts):
        ts = (ts & band) or ts
        out = [frozenset(ts)]
        for chain in range(imatch.CHAINS):
            draw = {t: mixed((hash_of(t) + 0x1234567 * (chain + 1)) % 2**64) for t in ts}
            out += [frozenset(t for t in ts if draw[t] < 2 ** (64 - h)) for h in range(1, imatch.HALVINGS + 1)]
        return out

    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = imatch.lexicon(df, low=low, high=high)
    assert sorted(held.tolist()) == sorted(hash_of(t) for t in band)
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint(df, terms_in_band=held).collect()}
    cut = {i: [f[j : j + imatch.WIDTH] for j in range(0, len(f), imatch.WIDTH)] for i, f in got.items()}
    want = {i: parts(ts) for i, ts in terms.items() if ts}
    for i in want:
        assert [c == imatch.NONE for c in cut[i]] == [not s for s in want[i]]
        for j in want:
            assert [a == b for a, b in zip(cut[i], cut[j])] == [a == b for a, b in zip(want[i], want[j])], (i, j)
    order = sorted(want, reverse=True)
    near = {r["doc_id"]: r["near_next"] for r in imatch.compare_edited(df.where("doc_id <> 103"), low=low * n / (n - 1), high=high * n / (n - 1)).collect()}
    for i, j in zip(order, order[1:]):
        either = [(a, b) for a, b in zip(want[i], want[j]) if a or b]
        assert abs(near[i] - sum(a == b for a, b in either) / len(either)) < 1e-12
    assert got[100] == got[101] == got[5]


def test_a_lexicon_too_large_is_an_error(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    try:
        imatch.lexicon(df, low=0.1, high=1.0, most=3)
    except ValueError:
        return
    raise AssertionError


def test_fingerprint_keeps_clashing_columns(spark):
    df = spark.createDataFrame([("a b c", 1, "x"), ("a b c", 2, None), (None, 3, "z")], "text string, __text int, fingerprint string")
    got = imatch.fingerprint(df).orderBy("__text").collect()
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != got[2]["fingerprint"]


# ---- licenses ---------------------------------------------------------------------------------------------


def test_a_kept_column_named_like_a_result_gives_way_and_long_texts_are_scanned_whole(spark):
    long = "word " * 200_000 + "cc by end"
    df = spark.createDataFrame([(1, long, 5, "a"), (2, None, 6, "b")], "doc_id long, text string, score int, __text string")
    got = licenses.scan(df, keep=("doc_id", "score", "__text")).orderBy("doc_id")
    assert got.columns == ["doc_id", "__text", *licenses.OUT]
    assert [(r["score"], r["n_words"], r["first_word"], r["__text"]) for r in got.collect()] == [(1.0, 200_003, 200_000, "a"), (0.0, 0, None, "b")]


def test_license_places(spark):
    texts = ["CC-BY cc by 4.0; all rights\nreserved", "General Public License general public", None, "", "all rights é reserved", "cc by " * 500, "Released under the MIT License.", "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and associated documentation files"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(df).collect()), key=str)
    assert len(got) == 9 and got[0] == got[1]
    by = {r[0]: r for r in got}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(p, label) for phrase, label in licenses.BASE.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        at = [p for p, _ in places]
        assert by[i][1:6] == (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))), i
    assert by[6][6] == "mit" and by[7][6] == "mit" and by[2][7] == 0.0
    assert licenses.scan(df.where("doc_id < 0")).count() == 0


# ---- packing ----------------------------------------------------------------------------------------------


def test_word_tokens_match_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    own, theirs = packing.WordTokens(path), Tokenizer.from_file(path)
    rnd = random.Random(5)
    texts = [t for t in EDGES if t] + ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(0xC0, 0x24F), rnd.randint(0x300, 0x36F), rnd.randint(0x370, 0x3FF), rnd.randint(0x4E00, 0x9FFF), 0x1F600, 0xA0, 0x2028, 0x1C])) for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_packing_round_trip(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["cat", "dog", "zebra7"]) for _ in range(rnd.randint(0, 90)))) for i in range(150)] + [(900 + i, t) for i, t in enumerate(EDGES)] + [(3, "twice"), (3, "twice"), (None, "no id")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), limit=64).collect()
    own = packing.WordTokens(tokenizer_path("word_bpe_49k.json"))
    want = []
    for d, t in rows:
        ids = own.encode(t or "") + b"\0" * 4
        want += [(d, at // 256, at // 4, len(ids[at : at + 256]) // 4, zlib.crc32(ids[at : at + 256])) for at in range(0, len(ids), 256)]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    ends, total = {}, 0
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
        total += r["length"]
    assert max(ends.values()) <= 64 and len(ends) <= math.ceil(total / 64) * 1.05 + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit_is_whole(seed):
    rnd = np.random.default_rng(seed)
    lengths = rnd.integers(1, 65, 500)
    bins, offsets = packing.best_two_fit(lengths, 64)
    for b in np.unique(bins):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        assert (offsets[at] == np.append(0, np.cumsum(lengths[at])[:-1])).all() and lengths[at].sum() <= 64
    left: list[int] = []  # first fit, longest first
    for n in sorted(lengths.tolist(), reverse=True):
        at = next((i for i, x in enumerate(left) if x >= n), None)
        if at is None:
            left.append(64 - n)
        else:
            left[at] -= n
    assert len(np.unique(bins)) <= len(left)


# ---- classifiers ------------------------------------------------------------------------------------------


def labelled(spark, kind):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(["the", "ing", "er", "on", "at", "es", "re"]) for _ in range(rnd.randint(1, 3)))
    docs, labels = [], []
    for i in range(400):
        words, bad = [word() for _ in range(rnd.randint(20, 120))], rnd.random() < 0.3
        if bad and kind == "quality":
            words = [w.upper() + "!!" for w in words]
        if bad and kind == "toxic":
            words.insert(rnd.randrange(len(words)), rnd.choice(["moron", "idiot", "scum"]) if i % 2 else rnd.choice(["m0ron", "1diot", "sc um", "idiooot", "$cum", "i d i o t"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad) if kind == "quality" else 1, int(bad)))
    docs += [(1000 + i, t) for i, t in enumerate(EDGES)] + [(0, docs[0][1]), (None, "no id")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def accuracy(got, labels, column, parts, fold):
    truth = {r["doc_id"]: r[column] for r in labels.collect() if r[column] is not None and r["doc_id"] is not None}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


def test_quality_on_the_held_out_fold(spark):
    docs, labels = labelled(spark, "quality")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and accuracy(got, labels, "quality", 3, 1) > 0.95
    assert {r["score"] for r in quality.score(docs, None, out="s").select(F.col("s").alias("score")).collect()} == {0.5}
    kept = quality.score(docs.withColumn("__text", F.lit(1)), None)
    assert kept.columns == ["doc_id", "text", "__text", "quality_score"]


def test_toxicity_learns_from_every_labelled_text(spark):
    import random

    rnd = random.Random(6)
    ids = spark.range(4400).where("crc32(cast(cast(id as string) as binary)) % 5 <> 0").orderBy(F.xxhash64(F.lit(23), "id"), "id").toPandas()["id"].tolist()
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    ones, rows = 0, []
    for i in ids:
        ones += i % 2
        # The later ones, in the order of the hash, have a word that the others lack.
        rows.append((i, f"{word()} {word()} {word()} the " + ("" if i % 2 == 0 else "scumbag" if ones <= 1500 else "zorgle")))
    assert ones > 1600
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    assert model.lexicon.keys() == {"scumbag", "zorgle"}
    assert {r["predicted"] for r in toxicity.classify(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")).where("doc_id % 2 = 1").collect()} == {1}


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = labelled(spark, "toxic")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count() and accuracy(got, labels, "toxic", 5, 0) > 0.9
    empty = docs.where("doc_id < 0")
    assert toxicity.classify(empty, labels).count() == 0


def test_finder_sees_what_a_scan_of_the_words_sees():
    from collections import Counter

    model = toxicity.CharacterModel(Counter({"moron": 40, "idiot": 40, "scum": 40, "the": 60, "thing": 9}))
    lexicon = {"moron": 5.0, "idiot": 5.0, "scum": 5.0}
    find, restorer = toxicity.Finder(lexicon, model), toxicity.Restorer(model)
    texts = ["", "the moron, the", "m0r0n!! IDIOOOT", "i d i o t", "x m.o.r.o.n. y", "s-c-u-m $cum", "a b c d", "the thing " * 50 + "1di0t", "é scum\tidiot"]
    for t in texts * 2:
        assert find(t) == toxicity.words_of(t, restorer) & lexicon.keys(), t
    assert [sorted(find(t)) for t in texts[:5]] == [[], ["moron"], ["idiot", "moron"], ["idiot"], ["moron"]]


def test_toxicity_sees_every_disguise_that_it_prices():
    from collections import Counter

    words = ["idiot", "stupid", "loser", "ass", "shit", "boob"]
    model = toxicity.CharacterModel(Counter(dict.fromkeys(words, 40) | {"the": 60, "thing": 9}))
    lexicon = dict.fromkeys(words, 5.0)
    find, restorer = toxicity.Finder(lexicon, model), toxicity.Restorer(model)
    spelt = {"iidiot": "idiot", "stuupid": "stupid", "loserr": "loser", "a$$": "ass", "1053r": "loser", "5h!7": "shit", "s h.i t": "shit", "i d.i o.t": "idiot", "b o o b": "boob"}
    for written, word in spelt.items():
        for t in (written, f"the {written}, the thing"):
            assert find(t) == toxicity.words_of(t, restorer) & lexicon.keys() == {word}, t


def test_viterbi_finds_the_cheapest_path_of_the_lattice():
    """All restorations of short words, priced one by one, against the decoder's."""
    from collections import Counter

    model = toxicity.CharacterModel(Counter({"moron": 9, "idiot": 9, "at": 30, "it": 30, "a": 20, "tool": 5}))

    def price(written, letters):
        """The least price of writing so for `letters`, by trying every reading of the first character."""
        from functools import cache

        def language(text):
            out = 0.0
            for w in text.split(" "):
                s = f"  {w} "
                out += sum(model.cost(s[i - 2 : i + 1]) for i in range(2, len(s)))
            return out

        @cache
        def channel(i, j):
            if i == len(written):
                return 0.0 if j == len(letters) else math.inf
            c, ways = written[i], []
            sign = toxicity.IMITATES.get(c)
            if sign is None and not c.isalnum():
                ways.append(toxicity.GAP + channel(i + 1, j))
                if j < len(letters) and letters[j] == " ":
                    ways.append(channel(i + 1, j + 1))
                return min(ways)
            reads = [(c, 0.0)] if c.isalpha() else [(x, toxicity.SWAP) for x in sign] + [(c, toxicity.KEEP_SIGN)] * c.isalnum()
            for x, extra in reads:
                if j < len(letters) and letters[j] == x:
                    ways.append(extra + channel(i + 1, j + 1))
                if j and letters[j - 1] == x:
                    ways.append(extra + toxicity.REPEAT + channel(i + 1, j))
            if sign is not None:
                ways.append(toxicity.DROP + channel(i + 1, j))
            return min(ways, default=math.inf)

        return channel(0, 0) + language(letters)

    import itertools

    for written in ("m0ron", "id10t", "a a t", "t00l", "i t", "aatt", "1t", "a.t", "to0l"):
        reads = [["", c] if c.isalpha() else ["", " "] if c in " ." else ["", c, *toxicity.IMITATES[c]] for c in written]
        tried = {t for t in ("".join(x) for x in itertools.product(*reads)) if t and t == t.strip() and "  " not in t}
        best = min(price(written, t) for t in tried)
        got = toxicity.restore(written, model)
        assert abs(price(written, got) - best) < 1e-9, (written, got)


def test_gaps_of_any_width_and_words_in_a_row():
    from collections import Counter

    model = toxicity.CharacterModel(Counter({"moron": 40, "idiot": 40, "poop": 40, "the": 60, "thing": 9, "a": 50}))
    lexicon = dict.fromkeys(["moron", "idiot", "poop"], 5.0)
    find, restorer = toxicity.Finder(lexicon, model), toxicity.Restorer(model)
    rnd = random.Random(2)
    for t, want in [("m  o  r  o  n", {"moron"}), ("m o r o n m o r o n", {"moron"}), ("m\to\tr\to\tn", {"moron"}), ("p o o p", {"poop"}), ("a m o r o n", {"moron"}), ("the m o r o n i d i o t thing", {"moron", "idiot"}), (" ".join("moron" * 40), {"moron"}), ("m" + "o" * 200 + "ron", {"moron"}), ("x" * 60 + "moron", set())]:
        assert find(t) == want == toxicity.words_of(t, restorer) & lexicon.keys(), t[:40]
    for _ in range(300):
        t = "".join(rnd.choice(["m", "o", "r", "n", "0", "i", "d", "1", "t", " ", "  ", ".", "-", "!", "$", "\n", "the ", "É"]) for _ in range(rnd.randint(0, 40)))
        assert find(t) == toxicity.words_of(t, restorer) & lexicon.keys(), t


def test_words_of_letters_are_restored_without_the_lattice(monkeypatch):
    """The same words as by the lattice, each run of a letter by the letters beside it."""
    from collections import Counter

    model = toxicity.CharacterModel(Counter({"moron": 40, "idiot": 40, "poop": 40, "the": 60, "thing": 9, "a": 50, "élan": 5}))
    rnd = random.Random(3)
    words = ["".join(rnd.choice("moronpaté") * rnd.choice([1, 1, 1, 2, 3, 5]) for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    assert all(toxicity.restore(w, model) == toxicity.restore(f"-{w}", model) for w in words)  # a gap before it: all of it through the lattice
    text = " ".join(words) + " the moooron, thhing. poop"
    want, find = toxicity.words_of(text, toxicity.Restorer(model)), toxicity.Finder({"moron": 5.0, "poop": 5.0, "idiot": 5.0}, model)
    decoded = []
    monkeypatch.setattr(toxicity, "restore", lambda *a: decoded.append(a[0]))
    assert find(text) == {"moron", "poop"} <= want and toxicity.Reader(model)(text) == want and not decoded
    # A figure or a sign behind a beginning that no sought word has: not decoded either.
    assert find("thing$$$ xm0r0n thhing!! élan9 " + text) == {"moron", "poop"} and not decoded


def test_reader_sees_what_a_scan_of_the_words_sees():
    from collections import Counter

    model = toxicity.CharacterModel(Counter({"moron": 40, "idiot": 40, "the": 60, "thing": 9, "a": 50}))
    read, restorer = toxicity.Reader(model), toxicity.Restorer(model)
    rnd = random.Random(4)
    for _ in range(400):
        t = "".join(rnd.choice(["m", "o", "r", "n", "0", "i", "d", "1", "t", " ", "  ", ".", "-", "!", "$", ",", "\n", "the ", "É", "\u0301", "²", "\u2028", "𝒳", "😀"]) for _ in range(rnd.randint(0, 40)))
        assert read(t) == toxicity.words_of(t, restorer), t


def test_patterns_read_every_character_alike():
    every = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    for p in (toxicity.WORD, toxicity.SPACED, toxicity.LETTERS, toxicity.DISGUISED, toxicity.ODD, toxicity.ALONE):
        for text in ("".join(every), " ".join(every), "a".join(every), "".join(c + c for c in every), "ab-".join(every)):
            assert [m.span() for m in p.basic.finditer(text)] == [m.span() for m in p.any.finditer(text)]
    assert toxicity.LETTERS.findall("ab𐐷c 😀d") == ["ab𐐷c", "d"]


def test_contradictory_labels_and_copies_of_either_label(spark):
    from quillspark.llm.labelled import sample

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] * 2 + [(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    got = sample(docs, labels, "toxic", 5, 0)
    held = {i for i in range(8) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sorted(got) == sorted((f"text {i}", i % 2) for i in set(range(8)) - held - {1})
    assert toxicity.without_copies([({"a", "b", "c", "d"}, 0), ({"a", "b", "c", "d"}, 0), ({"a", "b", "c", "d"}, 1)]) == [({"a", "b", "c", "d"}, 0), ({"a", "b", "c", "d"}, 1)]


def test_every_sampled_text_is_in_the_dictionary():
    texts = [f"<{i:05d}>" * 200 for i in range(1500)]
    held = quality._gather(texts)
    assert len(held) == quality.DICTIONARY and all(t[:7].encode() in held for t in texts)
    small = quality._gather(texts, 1 << 16)
    assert len(small) == 1 << 16 and len(quality._gather(["short"] * 3, 400)) == 400 and quality._gather([]) == b""


def test_quality_features_match_plain_compression():
    import zstandard

    good, bad = b"the good text of the land " * 9, b"BUY!! NOW!! " * 9
    text = "the good land " * 700
    size = []
    for d in (good, bad):
        tool = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        raw = text.encode()
        size.append(sum(len(tool.compress(raw[i : i + quality.BLOCK])) for i in range(0, len(raw), quality.BLOCK)))
    value = (size[1] - size[0]) / (len(text.encode()) + 32)
    assert value > 0 and abs(quality.Sizes(good, bad).features(text)[0] - value) < 0.002
    assert quality.Sizes(good, bad).features("") == (0.0, 0.0)


# ---- language model ---------------------------------------------------------------------------------------


def test_unigram_base_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ppm, "HEAD", 0.02)  # most words go through the join
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.5)) % 200}" for _ in range(rnd.randint(0, 60)))) for i in range(120)] + [(300 + i, t) for i, t in enumerate(EDGES)] + [(1, "again"), (1, "again"), (None, "no id")]
    got = ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    split = lambda t: (t or "").encode().lower().split() + [None]
    counts = {}
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 10:
            for w in split(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), len(split(t)), sum(w in counts for w in split(t)), n, round(sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in split(t)), 6)) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- mixing -----------------------------------------------------------------------------------------------


def fill(sizes, weights, budget, cap=2.0):
    target, open_ = dict.fromkeys(sizes, 0.0), dict(sizes)
    while open_:
        part = {s: budget * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > cap * sizes[s]]
        if not over:
            return target | part
        for s in over:
            target[s], budget = cap * sizes[s], budget - cap * sizes[s]
            del open_[s]
    return target


def test_the_mix_in_one_column_keeps_the_others(spark):
    df = spark.createDataFrame([(i, "w w", "a", 99, 98) for i in range(9)], "doc_id long, text string, source string, size int, copies int")
    got = mixing.mix(df, into="m").collect()
    assert {(r["size"], r["copies"], r["m"]["size"]) for r in got} == {(99, 98, 2)}
    assert abs(sum(r["m"]["copies"] * 2 for r in got) - got[0]["m"]["target"]) <= 2


def test_mix_meets_its_targets(spark):
    rnd = random.Random(10)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 9)), rnd.choice(["a", "a", "a", "a", "b", "ä", "Z", None]), i) for i in range(3000)] + [(5000 + i, t, "edge", 0) for i, t in enumerate(EDGES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(df.repartition(3)).collect()}
    sizes = {}
    for d, t, s, _ in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 2 and again[r["doc_id"]] == r["copies"]
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= 10 for s in sizes if s != "edge")
    assert mixing.mix(df.where("doc_id < 0")).count() == 0


def test_fixed_values_are_small():
    assert len(licenses.template_grams()) < 200 and hash_of("a") != hash_of("b")
    assert json.load(open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8"))["model"]["type"] == "BPE" and os.path.isabs(tokenizer_path("word_bpe_49k.json"))
