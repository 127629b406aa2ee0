from pyspark.sql import functions as F

from quillspark.operators.sessionize import CutPolicy, cut
from quillspark.sources import frames
from quillspark.streaming import operators as streaming


def run(stream, spark, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", spark.conf.get("spark.checkpoint.dir") + "/" + name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streamed_cuts_equal_batch(spark, tmp_path):
    rows = [("a", 0, "speech", 8.0), ("a", 1, "silence", 0.7), ("a", 2, "speech", 7.0), ("b", 0, "speech", 130.0)]
    all_frames = frames.from_spans(spark.createDataFrame(rows, "session string, pos int, label string, seconds double"))
    wide = all_frames.withColumn("is_end", F.lit(False)).cache()
    half = 5_000_000
    wide.where(F.col("t_us") < half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    wide.where(F.col("t_us") >= half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ends = spark.createDataFrame([(k, 10**12, False, True) for k in "ab"], wide.schema)
    ends.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(wide.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in run(streaming.cut(source, CutPolicy()), spark, "cuts").collect())
    assert got == sorted(tuple(r) for r in cut(all_frames, CutPolicy()).collect())


def test_streamed_assembly_waits_for_the_hole(spark, tmp_path):
    schema = "session string, seq int, text string, is_gap boolean"
    for part in ([("s", 1, "b", False), ("s", 1, "later", False)], [("s", 0, "a", False)], [("s", 3, "d", False)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(streaming.assemble(source), spark, "assembled").collect()
    assert [(r["seq"], r["text"]) for r in sorted(got, key=lambda r: r["seq"])] == [(0, "a"), (1, "b")]


def test_an_end_row_frees_a_streamed_session(spark, tmp_path):
    schema = "session string, seq int, text string, is_gap boolean"
    for part in ([("s", 0, "a", False), ("s", 2, "c", False)], [("s", None, None, None)], [("s", 0, "new", False), ("s", 2, "z", False)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(streaming.assemble(source), spark, "freed").collect()
    assert [(r["seq"], r["text"]) for r in got] == [(0, "a"), (0, "new")]


def test_streamed_term_counts_and_each_batch(spark, tmp_path):
    for part in (["We use Kubernetes", "plain text"], ["Then Kubernetes again", None]):
        spark.createDataFrame([("s", t) for t in part], "session string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("session string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(streaming.term_counts(source), spark, "terms", "complete").collect()
    assert {r["core"]: r["n"] for r in got} == {"kubernetes": 2}
    sizes = []
    q = streaming.on_each_batch(source, lambda batch, i: sizes.append((i, batch.count())), spark.conf.get("spark.checkpoint.dir") + "/each")
    q.awaitTermination(60)
    assert sizes == [(0, 2), (1, 2)]
