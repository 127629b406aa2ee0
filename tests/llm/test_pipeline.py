import random

import corpus_pipeline
from quillspark.llm.shared import materialize


def test_stages_take_effect(spark, tmp_path):
    rnd = random.Random(1)
    word = lambda: rnd.choice(["the", "ing", "er", "on", "at"]) + rnd.choice(["ab", "cd", "ef", ""]) + str(rnd.randint(0, 99))
    rows, labels = [], []
    for i in range(120):
        words, bad = [word() for _ in range(60)], i % 4 == 0
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + (" mail me@x.org" if i == 7 else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not bad), 0))
    rows += [(500, rows[7][1], "en", "s1", 1), (501, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, str(tmp_path)))
        seen[name] = now.collect()
        if name != "packing":
            assert now.columns == docs.columns
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    good = {i for i in range(120) if i % 4}
    assert good <= ids("quality") and len(ids("quality") & set(range(0, 120, 4))) <= 3
    assert 500 in ids("quality") and 500 not in ids("near_duplicates") and good <= ids("near_duplicates")
    assert [r["text"][-12:] for r in seen["personal_data"] if r["doc_id"] == 7] == ["mail <EMAIL>"]
    assert {r["doc_id"] for r in seen["packing"]} == ids("mixing") and len(seen["mixing"]) > len(ids("mixing"))


def test_every_stage_takes_odd_tables_and_keeps_other_columns(spark, tmp_path):
    """Nulls, repeated rows and ids, a very long text, clashing names; and an empty table."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, size long, copies long, __score double, __kept int, __mix int, __text string, score double"
    more = (99, 98, 0.25, 7, 8, "t", 0.75)
    text = "the river ran past the old mill and the town slept on until the bells rang again at dawn " * 2
    rows = [(i, f"{text} {i} " * 2, "en", "s", 1, *more) for i in range(30)]
    rows += [rows[3], (4, "another text of the same id", None, None, None, *more), (None, "no id", "en", "s", 1, *more), (None, None, None, None, None, *(None,) * 7)]
    rows += [(60, " ".join(f"w{i}" for i in range(60_000)), "en", "s", 1, *more), (61, "", "en", "s", 0, *more), (62, None, "en", "s", 0, *more)]
    labels = [(i, i % 2, 0) for i in range(30)] + [(0, 1, 1), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    full = spark.createDataFrame(rows, kind)
    for docs in (full, full.where("doc_id < 0")):
        docs = materialize(docs)
        for name, stage in corpus_pipeline.STAGES[:4]:
            got = stage(spark, docs, str(tmp_path))
            assert got.columns == docs.columns, name
            kept = got.collect()
            allowed = {tuple(r)[5:] for r in docs.collect()}
            assert {tuple(r)[5:] for r in kept} <= allowed, name
            if name == "near_duplicates" and docs.count():
                ids = [r["doc_id"] for r in kept]
                assert ids.count(None) == 2 and {60, 61, 62, 4} <= set(ids)
        packed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
