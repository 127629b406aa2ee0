import random
import time

from pyspark.sql import functions as F

from quillspark.llm import pii


def spans(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii_spans"]] for r in pii.find_spans(df).collect()}


def test_running_sums(spark):
    rnd = random.Random(1)
    lists = [[rnd.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 127, 128, 129, 300, 20_000)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>").select("i", "x", pii.running(F.col("x")).alias("s")).collect()
    for r in got:
        want, at = [], 0
        for n in r["x"]:
            want.append(at)
            at += n
        assert r["s"] == want, r["i"]


def test_a_hundred_thousand_matches_take_time_in_proportion(spark):
    text = lambda n: " ".join(f"a{i}@x.org" for i in range(n))
    spans(spark, [text(10)])
    took = []
    for n in (10_000, 100_000):
        began = time.time()
        found = spans(spark, [text(n)])[0]
        took.append(time.time() - began)
        assert len(found) == n and found[-1] == ("email", len(text(n)) - len(f"a{n - 1}@x.org"), len(text(n)))
    assert took[1] < 30 * max(took[0], 1)


def test_a_long_secret_is_redacted_whole(spark):
    key = "Ab3_" * 50
    text = f"token={key} end"
    assert spans(spark, [text])[0] == [("secret", 0, 6 + len(key))]
    df = spark.createDataFrame([(text,)], "text string")
    assert pii.redact(df).first()["text"] == "<SECRET> end"


def test_repeated_rows_stay_repeated_and_other_columns_too(spark):
    df = spark.createDataFrame([(1, "me@x.org", "r", "h", [1])] * 3 + [(2, None, None, None, None)], "doc_id long, text string, __row string, __pii_text string, pii_spans array<int>")
    got = pii.find_spans(df).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 1, 2] and {(r["__row"], r["__pii_text"]) for r in got} == {("r", "h"), (None, None)}
    assert [len(r["pii_spans"]) for r in got if r["doc_id"] == 1] == [1, 1, 1]
    assert [tuple(r) for r in pii.redact(df.where("doc_id = 1").limit(1)).collect()] == [(1, "<EMAIL>", "r", "h", [1])]
