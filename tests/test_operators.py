import io
import json
import wave

import pytest
from pyspark.sql import functions as F

from quillspark.functions import messages, text
from quillspark import catalog
from quillspark.operators import assemble, consistency, glossary, intervals, metrics, ring, sessionize, splice, structure
from quillspark.sources import frames


def one(df):
    return df.collect()[0]


def test_structure_boundaries(spark):
    rows = [("s", i, p, False, False) for i, p in enumerate([0.0, 1.2, 3.0])]
    df = structure.with_structure(spark.createDataFrame(rows, "k string, seq int, lead double, forced boolean, is_gap boolean"), "k", ["seq"], "lead", 1.2, 3.0)
    b = one(structure.boundaries(df, "k"))
    assert (b["paragraph_boundaries"], b["section_boundaries"]) == ([1, 2], [2])
    s = one(structure.stats(df, "k"))
    assert (s["done"], s["sections"], s["paragraphs"]) == (3, 2, 3)


def test_first_long_pause_opens_nothing(spark):
    df = structure.with_structure(spark.createDataFrame([("s", 0, 5.0)], "k string, seq int, lead double"), "k", ["seq"], "lead", 1.2, 3.0)
    assert one(df)["section_id"] == 0


def seam(spark, left, right):
    schema = "l array<struct<text:string,confidence:double>>, r array<struct<text:string,confidence:double>>"
    df = spark.createDataFrame([(left, right)], schema)
    n = splice.overlap(F.transform("l", lambda w: w["text"]), F.transform("r", lambda w: w["text"]))
    return one(df.withColumn("n", n).select("n", splice.spliced_text(F.col("l"), F.col("r"), F.col("n")).alias("t")))


def test_seam_keeps_the_surer_word(spark):
    got = seam(spark, [("the", 0.9), ("dog", 0.3), ("ran", 0.9)], [("the", 0.9), ("dawg", 0.8), ("ran", 0.9)])
    assert tuple(got) == (3, "the dawg ran")


def test_seam_without_overlap_is_marked(spark):
    assert tuple(seam(spark, [("a", 1.0)], [("b", 1.0)])) == (0, "a [⚠ seam] b")
    assert tuple(seam(spark, [], [("b", 1.0)])) == (0, "[⚠ seam] b")


def test_seams_reach_the_end_of_a_long_text(spark, tmp_path):
    texts = {6: [f"w{i}" for i in range(1000)], 15: [f"w{i}" for i in range(28)], 4: []}
    spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.seam_splice(spark, str(tmp_path)).collect()))
    one = [(4, 1, 0, False, "[⚠ seam]"), (15, 1, 0, False, " ".join(texts[15]) + " [⚠ seam]")]
    want = [(6, n + 1, 6, True, " ".join(texts[6][28 * n : 28 * n + 62])) for n in range(35)]
    assert got == one[:1] + want + one[1:] and got[-2][4].endswith("w999")


def test_seam_restores_the_original(spark):
    words = [f"w{i}" for i in range(30)]
    for k in (2, 5, 10):
        got = seam(spark, [(w, 1.0) for w in words[:20]], [(w, 1.0) for w in words[20 - k :]])
        assert tuple(got) == (k, " ".join(words))


def cleaned(spark, *texts):
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "k string, seq int, text string")
    return [r["clean"] for r in consistency.clean(df, "k", "seq").orderBy("seq").collect()]


def test_majority_form_wins(spark):
    assert cleaned(spark, "kubernetes " * 8 + "coobernetes,") == ["kubernetes " * 8 + "kubernetes,"]


def test_no_strict_winner_changes_nothing(spark):
    assert cleaned(spark, "kubernetes  coobernetes") == ["kubernetes  coobernetes"]


def test_clean_keeps_blocks_apart(spark):
    assert cleaned(spark, "kubernetes kubernetes", "", "kubernetis ok") == ["kubernetes kubernetes", "", "kubernetes ok"]


def test_near_spellings_of_short_and_long_words(spark):
    import random

    rnd = random.Random(5)
    words = "kubernetes kubernetis coobernetes ingress ingres ingrss schedule scheduler schedular abcde abcdf abxyz".split()
    for n in (22, 23, 24, 25, 26, 27, 60, 400):  # on both sides of the border between the two ways to meet
        base = [rnd.choice("abcdefghij") for _ in range(n)]
        for edits in (0, 1, 2, 2, 2, 3):
            w = list(base)
            for _ in range(edits):
                at, what = rnd.randrange(len(w)), rnd.randrange(3)
                w[at : at + (what != 0)] = [] if what == 1 else [rnd.choice("xyz")]
            words.append("".join(w))
    words = list(dict.fromkeys(words))
    df = spark.createDataFrame([("s", 0, " ".join(words))], "k string, seq int, text string")
    found = consistency.candidates(consistency.cores(df, "k", "seq"))
    got = {tuple(r)[1:] for r in consistency.spelling_edges(found, "k").collect()}
    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) <= 2 and brute_wer(a, b) <= 2}


def test_spelling_pairs_of_a_session_in_several_parts(spark, monkeypatch):
    import random

    rnd = random.Random(8)
    words = list(dict.fromkeys("".join(rnd.choice("abc") for _ in range(rnd.choice((5, 6, 7, 9, 24, 26, 30)))) for _ in range(150)))
    words += [w[:3] + w[4:] + "a" for w in words if len(w) > 20 and w[:3] + w[4:] + "a" not in words]
    df = spark.createDataFrame([(k, 0, " ".join(words[k:])) for k in (0, 60, 149)] + [(None, 0, " ".join(words))], "k int, seq int, text string")
    want = {(k, a, b) for k in (0, 60, 149) for i, a in enumerate(words[k:]) for b in words[k + i + 1 :] if abs(len(a) - len(b)) <= 2 and brute_wer(a, b) <= 2}
    monkeypatch.setattr(consistency, "PART", 40)
    monkeypatch.setattr(consistency, "HELD", 50)
    got = [tuple(r) for r in consistency.spelling_edges(consistency.candidates(consistency.cores(df, "k", "seq")), "k").collect()]
    assert len(got) == len(want) and set(got) == want


def test_remap_reads_its_texts_once(spark):
    df = spark.createDataFrame([("s", 0, "kubernetes kubernetes kubernetis")], "k string, seq int, text string")
    made = consistency.remap(df, "k", "seq")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert [tuple(r) for r in made.collect()] == [("s", "kubernetis", "kubernetes")]


def test_many_distinct_words_are_told_apart_and_too_many_are_an_error(spark, monkeypatch):
    a = " ".join(f"w{i}" for i in range(3000))
    df = spark.createDataFrame([(a, a + " more"), (a, a.replace("w7 ", ""))], "r string, h string")
    assert [r["errors"] for r in metrics.word_errors(df, "r", "h").collect()] == [1, 1]
    monkeypatch.setattr(metrics, "LETTERS", 100)
    try:
        metrics.word_errors(df, "r", "h").collect()
    except Exception as e:
        assert "distinct tokens" in str(e)
        return
    raise AssertionError


def test_context_tail_passes_over_blank_rows(spark):
    rows = [(0, "the first words")] + [(i, [None, "", "  "][i % 3]) for i in range(1, 300)] + [(300, "later")]
    df = spark.createDataFrame([(1, i, t) for i, t in rows], "k int, seq int, text string")
    got = {r["seq"]: r["tail"] for r in glossary.context_tail(df, "k", "seq").collect()}
    assert got[0] == "" and {got[i] for i in range(1, 301)} == {"the first words"}


def test_pinned_terms_come_from_earlier_rows_within_the_budget(spark):
    rows = [("s", 0, "we use Kubernetes and Ingress"), ("s", 1, None), ("s", 2, "then kubernetes again"), ("s", 3, "end"), ("t", 0, "other")]
    df = spark.createDataFrame(rows, "k string, seq int, text string")
    found = glossary.terms(df, ["k", "seq"])
    of = lambda **how: {(r["k"], r["seq"]): r["carried"] for r in glossary.carried(found, df, "k", "seq", **how).collect()}
    assert of() == {("s", 0): [], ("s", 1): ["Kubernetes", "Ingress"], ("s", 2): ["Kubernetes", "Ingress"], ("s", 3): ["Kubernetes", "Ingress"], ("t", 0): []}
    assert of(max_terms=1)["s", 3] == ["Kubernetes"] and of(max_chars=7)["s", 3] == ["Ingress"]


def test_ring_forgets_what_is_confirmed_but_not_pinned(spark):
    events = [("write", 100), ("confirm", 40), ("pin", 20), ("confirm", 90), ("pin", 95), ("write", 10), ("confirm", 500), ("pin", None), (None, 3)]
    df = spark.createDataFrame([(1, i, k, v) for i, (k, v) in enumerate(events)], "k int, seq int, kind string, value long")
    got = ring.retention(df, "k", "seq").orderBy("seq").collect()
    assert [r["base"] for r in got] == [0, 40, 40, 40, 90, 90, 95, 95, 95] and got[-1]["written"] == 110
    asked = spark.createDataFrame([(0.095, 0.105), (0.09, 0.1), (0.1, 0.2)], "s double, e double")
    read = [tuple(r["x"]) for r in asked.select(ring.sliced(F.col("s"), F.col("e"), F.lit(95), F.lit(110), 1000).alias("x")).collect()]
    assert read == [(None, 0, 20), ("pruned", None, None), ("unwritten", None, None)]


def test_capped_requests_never_exceed_the_cap(spark):
    rows = [("a", i, i // 3, 5 + i % 4) for i in range(40)] + [("b", 0, 7, 1), (None, 1, 1, 1)]
    got = assemble.capped(spark.createDataFrame(rows, "k string, seq int, t long, d long"), "k", "seq", "t", "d", 4).collect()
    one_ = [r for r in got if r["k"] == "a"]
    assert len(got) == 41 and all(r["starts"] >= r["t"] and r["ends"] == r["starts"] + r["d"] for r in got)
    assert max(sum(r["starts"] <= x["starts"] < r["ends"] for r in one_) for x in one_) == 4
    assert [r["starts"] for r in sorted(one_, key=lambda r: r["seq"])] == sorted(r["starts"] for r in one_)


def test_seam_records_need_a_forced_cut_and_no_gap(spark):
    w = lambda *words: [(x, 0.5) for x in words]
    rows = [(0, w("a", "b", "c", "d"), "a b c d", True, False), (1, w("c", "d", "e"), "c d e", False, False), (2, w("x"), "x", True, False), (3, [], None, True, True), (4, w("y", "z"), "y z", True, False), (5, w("q", "r"), "q r", False, False)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, seq int, words array<struct<text:string,confidence:double>>, text string, forced boolean, is_gap boolean")
    got = [tuple(r)[1:] for r in splice.neighbours(df, "k", "seq").orderBy("seq").collect()]
    assert got == [(1, 2, True, "a b c d c d e", "a b c d e", False), (5, 0, False, "y z q r", f"y z {splice.MARK} q r", True)]


def test_gap_rows_stand_for_missing_numbers(spark):
    df = spark.createDataFrame([("s", 0, "a"), ("s", 3, "d")], "k string, seq int, text string")
    got = sorted(tuple(r) for r in assemble.with_gaps(df, "k").select("seq", "text", "is_gap").collect())
    assert got == [(0, "a", False), (1, None, True), (2, None, True), (3, "d", False)]


def test_null_text_is_no_term(spark):
    df = spark.createDataFrame([("s", 0, None), ("s", 1, "x Kafka broker42 the")], "k string, seq int, text string")
    found = glossary.terms(df, ["k", "seq"])
    assert sorted(r["core"] for r in found.collect()) == ["broker42", "kafka"]


def test_budget_passes_over_long_terms(spark):
    df = spark.createDataFrame([(["aaaa", "bbbbbbbbbb", "cc"],)], "t array<string>")
    assert one(df.select(glossary.budgeted(F.col("t"), 5, 7).alias("x")))["x"] == ["aaaa", "cc"]


def test_words_lost_at_a_range_edge(spark):
    words = spark.createDataFrame([("s", i, w, i * 384_000, (i + 1) * 384_000) for i, w in enumerate("abcde")], "k string, word_idx int, text string, t_start long, t_end long")
    ranges = spark.createDataFrame([("s", 0, 0, 1_000_000), ("s", 1, 1_000_000, 2_020_000)], "k string, seq int, t_start long, t_end long")
    assert one(intervals.words_lost(words, ranges, "k"))["lost"] == 1
    got = intervals.transcripts(intervals.words_in_ranges(words, ranges, "k"), "k")
    assert {r["seq"]: r["transcript"] for r in got.collect()} == {0: "a b c~", 1: "c~ d e"}


def brute_wer(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_errors(spark):
    pairs = [("a b c", "a x c"), ("A, b! c.", "a b c"), ("a b", ""), ("", ""), ("", "x"), (None, None), ("the cat sat on the mat", "cat the sat on mat mat mat"), ("éa ea", "ea éa")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")
    got = {r["id"]: (r["errors"], r["wer"]) for r in metrics.word_errors(df, "a", "b").collect()}
    norm = lambda t: "".join(c for c in (t or "").lower() if c.isalnum() or c in "_ ").split()
    for i, (a, b) in enumerate(pairs):
        assert got[i][0] == brute_wer(norm(a), norm(b)), i
    assert got[0][1] == 1 / 3 and got[1][1] == 0 and got[2][1] == 1 and got[3][1] == 0 and got[4][1] == 1


def test_boundary_f1(spark):
    cases = [([1.0, 2.0], [1.0, 2.0], 1.0), ([5.0], [1.0], 0.0), ([], [1.0], 0.0), ([], [], 1.0), ([1.0, 1.1], [1.05], 2 / 3)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(cases)], "id int, p array<double>, t array<double>")
    got = {r["id"]: r["f1"] for r in metrics.boundary_f1(df, "p", "t", 0.25).collect()}
    assert all(abs(got[i] - f) < 1e-12 for i, (_, _, f) in enumerate(cases))


def test_assembly_first_wins_and_waits(spark):
    df = spark.createDataFrame([("s", 2, "c", 0), ("s", 0, "a", 1), ("s", 0, "again", 2), ("s", 3, "d", 3)], "k string, seq int, text string, arrival int")
    got = assemble.first_wins(df, "k")
    assert {r["seq"]: r["text"] for r in got.collect()} == {0: "a", 2: "c", 3: "d"}
    assert [r["text"] for r in assemble.ready_prefix(got, "k").collect()] == ["a"]
    assert [r["missing"] for r in assemble.missing(got, "k").collect()] == [1]


def test_retries(spark):
    rows = [("s", 0, 0, "retryable"), ("s", 0, 1, "retryable"), ("s", 0, 2, "ok"), ("s", 1, 0, "bad_request"), ("s", 1, 1, "ok"), ("s", 2, 0, "retryable"), ("s", 2, 1, "retryable"), ("s", 2, 2, "retryable")]
    got = assemble.outcomes(spark.createDataFrame(rows, "k string, seq int, attempt int, outcome string"), "k", "seq")
    assert {r["seq"]: (r["attempts"], r["is_gap"], r["waited_s"]) for r in got.collect()} == {0: (3, False, 1.5), 1: (1, True, 0.0), 2: (3, True, 1.5)}


def test_phonetic_key_and_affixes(spark):
    df = spark.createDataFrame([("kubernetes", "“x-ray,”"), ("coobernetes", "..."), ("12345", "é!")], "a string, b string")
    lead, word, trail = text.affix_parts(F.col("b"))
    rows = df.select(text.phonetic_key(F.col("a")).alias("k"), lead.alias("l"), word.alias("w"), trail.alias("t")).collect()
    assert rows[0]["k"] == rows[1]["k"] and rows[2]["k"] == ""
    assert [(r["l"], r["w"], r["t"]) for r in rows] == [("“", "x-ray", ",”"), ("...", "", ""), ("", "é", "!")]


def test_request_json_drops_nulls(spark):
    df = spark.createDataFrame([(16000, 1, [], "p", None, None, ["a"], None, None)], "sample_rate int, channels int, language_codes array<string>, stt_prompt string, prompt string, keyterms_prompt array<string>, keyterms array<string>, word_boost array<string>, llm_instruction string")
    assert one(df.select(messages.request_json().alias("j")))["j"] == '{"sample_rate":16000,"channels":1,"stt_prompt":"p","keyterms":["a"]}'


def test_faults_pass_or_last(spark):
    requests = spark.createDataFrame([("s", i) for i in range(5)], "k string, seq int")
    faults = spark.createDataFrame([("s", 1, 0.1, None, ["timeout", "server"]), ("s", 2, 0.2, "auth", ["timeout"]), ("s", 3, 0.0, "server", None), ("s", 4, 0.3, None, None)], "k string, seq int, latency_s double, raises string, transient array<string>")
    attempts = assemble.faulty(requests, faults, "k")
    got = {r["seq"]: (r["attempts"], r["outcome"]) for r in assemble.outcomes(attempts, "k", "seq").collect()}
    assert got == {0: (1, "ok"), 1: (3, "ok"), 2: (2, "auth"), 3: (3, "retryable"), 4: (1, "ok")}
    assert {r["seq"]: r["latency_s"] for r in attempts.where("attempt = 0").collect()} == {0: 0.0, 1: 0.1, 2: 0.2, 3: 0.0, 4: 0.3}


def test_documents_grow_when_the_hole_is_filled(spark):
    rows = [("s", 0, 2, 0, 0, False, False), ("s", 1, 1, 0, 1, True, False), ("s", 2, 5, 1, 2, False, True), ("s", 4, 0, 1, 2, False, False)]
    df = spark.createDataFrame(rows, "k string, seq int, arrival int, section_id int, paragraph_id int, forced boolean, is_gap boolean")
    got = [tuple(r) for r in assemble.growth(df, "k").orderBy("ready_at").collect()]
    assert got == [("s", 2, 2, 1, 2, 1, 0), ("s", 5, 3, 2, 3, 1, 1)]


def test_frames_are_checked_and_scripted(spark):
    good = spark.createDataFrame([("s", 0, [0] * 512), ("s", 7, [1] * 512)], "k string, idx int, samples array<smallint>")
    assert frames.checked(good).count() == 2
    with pytest.raises(TypeError):
        frames.checked(good.withColumn("samples", F.col("samples").cast("array<int>")))
    with pytest.raises(Exception, match="512"):
        frames.checked(good.withColumn("samples", F.slice("samples", 1, 5))).collect()
    script = spark.createDataFrame([("s", 0, True), ("s", 1, True)], "k string, idx int, is_speech boolean")
    assert {r["idx"]: r["is_speech"] for r in frames.scripted(good, script, "k").collect()} == {0: True, 7: False}


def test_a_run_on_forces_a_cut(spark):
    source = frames.run_on_clips(spark)
    words = intervals.timed_words(source, "session", "clip", F.col("words"), F.col("gap_us"))
    total = source.groupBy("session").agg(F.sum(F.size("words") * F.lit(intervals.WORD_US).cast("long") + F.col("gap_us")).alias("total_us"))
    cut = sessionize.cut(frames.frames_of_words(words, total), sessionize.CutPolicy(maximum=40 * sessionize.SECOND), "session")
    assert cut.where("forced").count() >= 1
    assert source.where("clip in (11, 12) and gap_us = 4000000").count() == 2 and source.count() == 25


def test_wav_lengths_read_the_header(spark):
    made = io.BytesIO()
    with wave.open(made, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 4 * 2000)
    df = spark.createDataFrame([(bytearray(made.getvalue()),), (None,)], "audio binary")
    assert [r[0] for r in df.select(text.wav_seconds(F.col("audio"))).collect()] == [0.25, None]
    with pytest.raises(Exception, match="RIFF"):
        spark.createDataFrame([(bytearray(b"no sound at all"),)], "audio binary").select(text.wav_seconds(F.col("audio"))).collect()


def test_snapshot_message_has_sections_and_seams(spark, tmp_path):
    rows = [(0, t, x) for t, x in enumerate(["alpha beta gamma", "beta gamma delta", "one two", None, "three"])]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = json.loads(one(catalog.snapshots(spark, str(tmp_path)))["message"])
    assert (got["type"], got["seq"], got["final"], got["stats"]["done"]) == ("document", 4, True, 5)
    blocks = [b["block"] for s in got["sections"] for p in s["paragraphs"] for b in p["blocks"]]
    assert [b["turn"] for b in blocks] == [0, 1, 2, 3, 4]
