"""The registered queries of the operators, each with SQL for another engine that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import messages, text
from .operators import assemble, consistency, glossary, intervals, metrics, ring, sessionize, splice, structure
from .plans import experiment
from .sources import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOUR = 3_600_000_000
POLICY = sessionize.CutPolicy(minimum=12 * HOUR, pause=6 * HOUR, maximum=72 * HOUR, overlap=12 * HOUR)
PARAGRAPH, SECTION = 12 * HOUR, 24 * HOUR
WIDER = 10 * HOUR

# ---- bindings of the tables -------------------------------------------------------------------------------

FRAMES_SQL = """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
  epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS t, event_type <> 'error' AS sp FROM events"""


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.from_events(table(spark, sf_dir, "events"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as assembled segments: pauses, forced cuts and gaps by formula."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    return c.select(
        "conv_id",
        "turn",
        "text",
        ((F.col("turn") * 7919 + F.col("conv_id") * 10473) % 4000).alias("lead_ms"),
        ((F.col("conv_id") + F.col("turn")) % 5 == 0).alias("forced"),
        ((F.col("conv_id") * 3 + F.col("turn")) % 11 == 0).alias("is_gap"),
        F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, "timeout").alias("error"),
    )


TURNS_SQL = """SELECT conv_id, turn, text, (turn * 7919 + conv_id * 10473) % 4000 AS lead_ms, (conv_id + turn) % 5 = 0 AS forced,
  (conv_id * 3 + turn) % 11 = 0 AS is_gap, CASE WHEN (conv_id + turn) % 2 = 0 THEN 'timeout' END AS error
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"""
STRUCTURED_SQL = f"""SELECT *, sum(CASE WHEN idx > 0 AND lead_ms >= 3000 THEN 1 ELSE 0 END) OVER w AS section_id,
  sum(CASE WHEN idx > 0 AND lead_ms >= 1200 THEN 1 ELSE 0 END) OVER w AS paragraph_id
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM ({TURNS_SQL}))
  WINDOW w AS (PARTITION BY conv_id ORDER BY idx)"""

# ---- structure --------------------------------------------------------------------------------------------


@query(
    f"""SELECT user_id, event_id, lead_us, CASE WHEN lead_us >= {SECTION} THEN 'section' WHEN lead_us >= {PARAGRAPH} THEN 'paragraph' ELSE 'same' END AS pause_class,
  CAST(rn - 1 AS BIGINT) AS idx,
  CAST(sum(CASE WHEN rn > 1 AND lead_us >= {SECTION} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS section_id,
  CAST(sum(CASE WHEN rn > 1 AND lead_us >= {PARAGRAPH} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS paragraph_id
  FROM (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY rn), 0) AS lead_us FROM ({FRAMES_SQL}))
  WINDOW w AS (PARTITION BY user_id ORDER BY rn)"""
)
def pause_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_frames(spark, sf_dir)
    lead = F.coalesce(F.col("t_us") - F.lag("t_us").over(Window.partitionBy("user_id").orderBy("t_us", "event_id")), F.lit(0).cast("long"))
    f = structure.with_structure(f.withColumn("lead_us", lead), "user_id", ["t_us", "event_id"], "lead_us", PARAGRAPH, SECTION)
    return f.select("user_id", "event_id", "lead_us", structure.pause_class(F.col("lead_us"), PARAGRAPH, SECTION).alias("pause_class"), F.col("idx").cast("long").alias("idx"), "section_id", "paragraph_id")


def structured_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.with_structure(turns(spark, sf_dir), "conv_id", ["turn"], "lead_ms", 1200, 3000)


@query(f"SELECT conv_id, count(*) AS done, CAST(max(section_id) + 1 AS BIGINT) AS sections, CAST(max(paragraph_id) + 1 AS BIGINT) AS paragraphs, count(*) FILTER (WHERE forced) AS forced, count(*) FILTER (WHERE is_gap) AS gaps FROM ({STRUCTURED_SQL}) GROUP BY conv_id")
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.stats(structured_turns(spark, sf_dir), "conv_id")


@query(
    f"""SELECT conv_id, array_to_string(coalesce(list(idx ORDER BY idx) FILTER (WHERE p), []), ',') AS paragraph_boundaries,
  array_to_string(coalesce(list(idx ORDER BY idx) FILTER (WHERE s), []), ',') AS section_boundaries FROM (
  SELECT conv_id, idx, idx > 0 AND lead_ms >= 1200 AS p, idx > 0 AND lead_ms >= 3000 AS s FROM ({STRUCTURED_SQL})) GROUP BY conv_id"""
)
def boundary_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = structure.boundaries(structured_turns(spark, sf_dir), "conv_id")
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return b.select("conv_id", flat("paragraph_boundaries"), flat("section_boundaries"))


@query(
    f"""WITH b AS (SELECT *, CASE WHEN is_gap THEN '{structure.GAP}' ELSE coalesce(text, '') END AS block FROM ({STRUCTURED_SQL})),
  p AS (SELECT conv_id, section_id, paragraph_id, string_agg(block, ' ' ORDER BY idx) AS paragraph FROM b GROUP BY ALL)
  SELECT conv_id, string_agg(paragraph, chr(10) || chr(10) ORDER BY paragraph_id) AS document FROM p GROUP BY conv_id"""
)
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = structured_turns(spark, sf_dir)
    return structure.documents(t.withColumn("block", structure.render(F.col("text"), F.col("is_gap"), F.col("turn"), F.col("error"), False)), "conv_id")


@query(
    f"""WITH b AS (SELECT *, CASE WHEN is_gap AND error IS NOT NULL THEN '{structure.GAP} (seq=' || turn || ': ' || error || ')' WHEN is_gap THEN '{structure.GAP}' ELSE coalesce(text, '') END AS block FROM ({STRUCTURED_SQL})),
  p AS (SELECT conv_id, section_id, paragraph_id, string_agg(block, ' ' ORDER BY idx) AS paragraph FROM b GROUP BY ALL),
  s AS (SELECT conv_id, section_id, string_agg(paragraph, chr(10) || chr(10) ORDER BY paragraph_id) AS sect FROM p GROUP BY ALL)
  SELECT conv_id, string_agg(sect, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY section_id) AS document FROM s GROUP BY conv_id"""
)
def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = structured_turns(spark, sf_dir)
    return structure.documents(t.withColumn("block", structure.render(F.col("text"), F.col("is_gap"), F.col("turn"), F.col("error"), True)), "conv_id", markdown=True)


# ---- sessions ---------------------------------------------------------------------------------------------


def cut_sql(pause: int) -> str:
    p = POLICY
    return f"""WITH RECURSIVE f AS MATERIALIZED (SELECT user_id, rn, t, sp FROM ({FRAMES_SQL})),
  step AS (
    SELECT user_id, CAST(0 AS BIGINT) AS rn, false AS op, CAST(0 AS BIGINT) AS st, CAST(0 AS BIGINT) AS co, CAST(0 AS BIGINT) AS la, CAST(0 AS BIGINT) AS en, CAST(0 AS BIGINT) AS le, CAST(0 AS BIGINT) AS seq,
      CAST(NULL AS BOOLEAN) AS cut, CAST(0 AS BIGINT) AS c_st, CAST(0 AS BIGINT) AS c_en, CAST(0 AS BIGINT) AS c_le FROM (SELECT DISTINCT user_id FROM f)
    UNION ALL
    SELECT user_id, rn, CASE WHEN forced THEN true WHEN clean THEN false ELSE op1 END,
      CASE WHEN forced THEN greatest(0, t - {p.overlap}) ELSE st1 END, CASE WHEN forced THEN t ELSE co1 END, CASE WHEN forced THEN t ELSE la1 END,
      CASE WHEN forced THEN t WHEN clean THEN la1 ELSE en END, CASE WHEN forced THEN 0 ELSE le1 END, CASE WHEN forced OR clean THEN seq + 1 ELSE seq END,
      CASE WHEN forced THEN true WHEN clean THEN false END, st1, CASE WHEN forced THEN t ELSE la1 END, le1
    FROM (SELECT *, op1 AND t - st1 >= {p.maximum} AS forced, op1 AND NOT sp AND t - st1 < {p.maximum} AND t - la1 >= {pause} AND la1 - co1 >= {p.minimum} AS clean
      FROM (SELECT s.user_id, f.rn, f.t, f.sp, s.en, s.seq, s.op OR f.sp AS op1,
        CASE WHEN f.sp AND NOT s.op THEN f.t ELSE s.st END AS st1, CASE WHEN f.sp AND NOT s.op THEN f.t ELSE s.co END AS co1,
        CASE WHEN f.sp THEN f.t ELSE s.la END AS la1, CASE WHEN f.sp AND NOT s.op THEN greatest(0, f.t - s.en) ELSE s.le END AS le1
        FROM step s JOIN f ON f.user_id = s.user_id AND f.rn = s.rn + 1)))
  , seg AS (SELECT user_id, seq - 1 AS seq, c_st AS t_start, c_en AS t_end, c_le AS lead_pause, cut AS forced FROM step WHERE cut IS NOT NULL
    UNION ALL SELECT user_id, seq, st, la, le, false FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS back FROM step) WHERE back = 1 AND op AND la > co)"""


def cut_events(spark: SparkSession, sf_dir: str, policy: sessionize.CutPolicy = POLICY) -> DataFrame:
    return sessionize.cut(event_frames(spark, sf_dir), policy, "user_id", order=("event_id",))


@query(cut_sql(POLICY.pause) + " SELECT user_id, CAST(seq AS INTEGER) AS seq, t_start, t_end, lead_pause, forced FROM seg")
def cut_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_events(spark, sf_dir)


@query(cut_sql(WIDER) + " SELECT user_id, CAST(seq AS INTEGER) AS seq, t_start, t_end, lead_pause, forced FROM seg")
def cut_policy_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_events(spark, sf_dir, POLICY.widened(WIDER))


@query(cut_sql(POLICY.pause) + " SELECT user_id, count(*) AS segments, count(*) FILTER (WHERE forced) AS forced, count(*) FILTER (WHERE forced) / count(*) AS forced_rate FROM seg GROUP BY user_id")
def forced_cut_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize.forced_rate(cut_events(spark, sf_dir), "user_id")


@query(
    f"""SELECT user_id, CAST(i AS INTEGER) AS seq, i * {72 * HOUR} AS t_start, least((i + 1) * {72 * HOUR}, total) AS t_end
  FROM (SELECT user_id, total, unnest(range(CAST(ceil(total / {72 * HOUR}) AS BIGINT))) AS i FROM (SELECT user_id, max(t) AS total FROM ({FRAMES_SQL}) GROUP BY user_id) WHERE total > 0)"""
)
def fixed_chop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize.fixed_chop(event_frames(spark, sf_dir), 72 * HOUR, "user_id")


@query(
    f"""SELECT user_id, CAST(s AS INTEGER) AS seq, min(t) AS t_start, max(t) AS t_end, count(*) AS frames FROM (
  SELECT *, sum(CASE WHEN t - prev >= {POLICY.pause} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS s FROM (
  SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY rn) AS prev FROM ({FRAMES_SQL}) WHERE sp)) GROUP BY user_id, s"""
)
def simple_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize.gap_sessions(event_frames(spark, sf_dir), POLICY.pause, "user_id", order=("event_id",))


@query(f"SELECT user_id, rn // 16 AS frame_idx, CAST(sum(event_id) AS BIGINT) AS total FROM (SELECT user_id, event_id, rn - 1 AS rn FROM ({FRAMES_SQL})) GROUP BY ALL HAVING count(*) = 16")
def reframed(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "event_id")) - 1
    return frames.reframe(event_frames(spark, sf_dir).withColumn("place", place), "user_id", "place", "event_id", 16)


@query(
    f"""SELECT user_id AS session, ((before + i) * 32000) AS t_us, sp AS is_speech FROM (
  SELECT user_id, sp, before, unnest(range(n)) AS i FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM (SELECT user_id, rn, sp, 1 + event_id % 7 AS n FROM ({FRAMES_SQL}))))"""
)
def spans_to_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_frames(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "event_id")))
    spans = f.select(F.col("user_id").alias("session"), "pos", F.when(F.col("is_speech"), "speech").otherwise("silence").alias("label"), ((1 + F.col("event_id") % 7) * 0.032).alias("seconds"))
    return frames.from_spans(spans)


@query(f"SELECT user_id, CAST(rn - 1 AS BIGINT) AS idx, rn % 4 <> 0 AND sp AS is_speech, CASE WHEN rn % 4 <> 0 AND sp THEN 1.0 ELSE 0.0 END::DOUBLE AS probability FROM ({FRAMES_SQL})")
def scripted_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech by a script that leaves every fourth frame out."""
    f = event_frames(spark, sf_dir).withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "event_id")).cast("long") - 1)
    got = frames.scripted(f.select("user_id", "idx"), f.where("idx % 4 <> 3"), "user_id")
    return got.select("user_id", "idx", "is_speech", frames.speech_probability(F.col("is_speech")).alias("probability"))


RUN_ON_SQL = f"""WITH c AS (SELECT i AS clip, CASE WHEN i = 12 THEN 120 ELSE 34 END AS n, CASE WHEN i < 12 THEN i * 34 WHEN i = 12 THEN 0 ELSE (i - 1) * 34 END AS off, CASE WHEN i IN (11, 12) THEN 4000000 ELSE [800000, 1500000, 4000000][i % 3 + 1] END AS gap FROM (SELECT unnest(range(25)) AS i)),
  b AS (SELECT *, coalesce(sum(n * 384000 + gap) OVER w, 0) AS start_us, coalesce(sum(n) OVER w, 0) AS before FROM c WINDOW w AS (ORDER BY clip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT 'demo' AS session, CAST(before + j AS BIGINT) AS word_idx, [{", ".join(f"'{w}'" for w in frames.VOCABULARY)}][(off + j) % {len(frames.VOCABULARY)} + 1] AS text, CAST(start_us + j * 384000 AS BIGINT) AS t_start, CAST(start_us + (j + 1) * 384000 AS BIGINT) AS t_end FROM (SELECT *, unnest(range(n)) AS j FROM b)"""


@query(RUN_ON_SQL)
def run_on_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated session with one long clip that has no pause, word by word."""
    return intervals.timed_words(frames.run_on_clips(spark), "session", "clip", F.col("words"), F.col("gap_us"))


# ---- timed words and ranges -------------------------------------------------------------------------------

WORDS_SQL = r"""SELECT conv_id, CAST(before + p - 1 AS BIGINT) AS word_idx, word AS text, CAST(start_us + (p - 1) * 384000 AS BIGINT) AS t_start, CAST(start_us + p * 384000 AS BIGINT) AS t_end FROM (
  SELECT conv_id, before, start_us, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM (
  SELECT *, coalesce(sum(len(w)) OVER b, 0) AS before, coalesce(sum(len(w) * 384000 + gap) OVER b, 0) AS start_us FROM (
  SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '\S+') AS w, [800000, 1500000, 4000000][(turn % 3 + 1)::INT] AS gap FROM conversations)
  WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""
CHOP = 5_000_000
RANGES_SQL = f"SELECT conv_id, CAST(i AS INTEGER) AS seq, i * {CHOP} AS t0, least((i + 1) * {CHOP}, total) AS t1 FROM (SELECT conv_id, total, unnest(range(CAST(ceil(total / {CHOP}) AS BIGINT))) AS i FROM (SELECT conv_id, max(t_end) AS total FROM words GROUP BY conv_id))"
PAIRS_SQL = f"WITH words AS MATERIALIZED ({WORDS_SQL}), ranges AS ({RANGES_SQL}), pairs AS (SELECT w.conv_id, seq, word_idx, text, t_start, t_start >= t0 - 48000 AND t_end <= t1 + 48000 AS whole FROM words w JOIN ranges r ON w.conv_id = r.conv_id AND ((t_start >= t0 - 48000 AND t_end <= t1 + 48000) OR (t_start < t1 AND t_end > t0)))"


def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    gap = F.get(F.array(*(F.lit(g) for g in frames.GAPS_US)), (F.col("turn") % 3).cast("int"))
    return intervals.timed_words(c, "conv_id", "turn", text.words_of(F.col("text")), gap)


def word_ranges(words: DataFrame) -> DataFrame:
    return sessionize.fixed_chop(words, CHOP, "conv_id", "t_end")


@query(WORDS_SQL)
def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_words(spark, sf_dir)


@query(PAIRS_SQL + " SELECT conv_id, seq, word_idx, text FROM pairs WHERE whole")
def words_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = turn_words(spark, sf_dir)
    return intervals.words_in_ranges(w, word_ranges(w), "conv_id").where("whole").select("conv_id", "seq", "word_idx", "text")


@query(PAIRS_SQL + " SELECT conv_id, seq, word_idx, text || '~' AS text FROM pairs WHERE NOT whole")
def straddlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = turn_words(spark, sf_dir)
    cut = intervals.words_in_ranges(w, word_ranges(w), "conv_id").where("not whole")
    return cut.select("conv_id", "seq", "word_idx", F.concat("text", F.lit("~")).alias("text"))


@query(PAIRS_SQL + " SELECT conv_id, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.whole AND p.conv_id = w.conv_id AND p.word_idx = w.word_idx)) AS lost, count(*) AS words FROM words w GROUP BY conv_id")
def words_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = turn_words(spark, sf_dir)
    return intervals.words_lost(w, word_ranges(w), "conv_id")


@query(PAIRS_SQL + " SELECT conv_id, seq, string_agg(token, ' ' ORDER BY t_start, token) AS transcript FROM (SELECT *, text || CASE WHEN whole THEN '' ELSE '~' END AS token FROM pairs) GROUP BY conv_id, seq")
def simulated_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = turn_words(spark, sf_dir)
    return intervals.transcripts(intervals.words_in_ranges(w, word_ranges(w), "conv_id"), "conv_id")


# ---- assembly ---------------------------------------------------------------------------------------------

ARRIVALS_SQL = """SELECT conv_id, turn AS seq, text, (turn * 5 + conv_id) % 8 AS arrival FROM conversations
  UNION ALL SELECT conv_id, turn, 'again', 100 + turn FROM conversations WHERE (conv_id + turn) % 4 = 0"""
ASSEMBLED_SQL = f"SELECT conv_id, seq, text, arrival FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, seq ORDER BY arrival, text) AS r FROM ({ARRIVALS_SQL})) WHERE r = 1"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    once = c.select("conv_id", F.col("turn").alias("seq"), "text", ((F.col("turn") * 5 + F.col("conv_id")) % 8).alias("arrival"))
    again = c.where((F.col("conv_id") + F.col("turn")) % 4 == 0).select("conv_id", F.col("turn").alias("seq"), F.lit("again").alias("text"), (100 + F.col("turn")).alias("arrival"))
    return once.unionByName(again)


@query(ASSEMBLED_SQL)
def ordered_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.first_wins(arrivals(spark, sf_dir), "conv_id")


@query(f"SELECT conv_id, seq, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS n FROM ({ASSEMBLED_SQL}) WHERE arrival <> 3) WHERE n = seq")
def ready_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = assemble.first_wins(arrivals(spark, sf_dir), "conv_id").where("arrival <> 3")
    return assemble.ready_prefix(landed, "conv_id").select("conv_id", "seq", "text")


@query(
    f"""WITH landed AS (SELECT * FROM ({ASSEMBLED_SQL}) WHERE arrival <> 3),
  every AS (SELECT conv_id, unnest(range(max(seq) + 1)) AS missing FROM landed GROUP BY conv_id)
  SELECT conv_id, missing FROM every e WHERE NOT EXISTS (SELECT 1 FROM landed l WHERE l.conv_id = e.conv_id AND l.seq = e.missing)"""
)
def missing_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.missing(assemble.first_wins(arrivals(spark, sf_dir), "conv_id").where("arrival <> 3"), "conv_id")


@query(
    f"""WITH a AS (SELECT user_id, (rn - 1) // 3 AS seq, (rn - 1) % 3 AS attempt, CASE WHEN event_type = 'error' THEN 'bad_request' WHEN event_type IN ('view', 'click') THEN 'retryable' ELSE 'ok' END AS outcome
    FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)),
  e AS (SELECT *, row_number() OVER (PARTITION BY user_id, seq ORDER BY attempt) AS r FROM a WHERE outcome <> 'retryable' OR attempt = 2)
  SELECT user_id, seq, attempt + 1 AS attempts, outcome, outcome <> 'ok' AS is_gap, 0.5 * (pow(2, attempt) - 1) AS waited_s FROM e WHERE r = 1"""
)
def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    kind = F.when(F.col("event_type") == "error", "bad_request").when(F.col("event_type").isin("view", "click"), "retryable").otherwise("ok")
    a = e.select("user_id", n.alias("n"), kind.alias("outcome")).select("user_id", F.floor(F.col("n") / 3).alias("seq"), (F.col("n") % 3).alias("attempt"), "outcome")
    return assemble.outcomes(a, "user_id", "seq")


SPANS_SQL = "SELECT user_id % 10 AS lane, epoch_us(ts) AS s, epoch_us(ts) + (1 + event_id % 50) * 600000000 AS e FROM events"
SWEEP_SQL = f"SELECT lane, t, d, sum(n) OVER (PARTITION BY lane ORDER BY t, d) AS depth FROM (SELECT lane, t, d, sum(d) AS n FROM (SELECT lane, s AS t, 1 AS d FROM ({SPANS_SQL}) UNION ALL SELECT lane, e, -1 FROM ({SPANS_SQL})) GROUP BY ALL)"


def request_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("lane"), start.alias("s"), (start + (1 + F.col("event_id") % 50) * 600_000_000).alias("e"))


@query(f"SELECT lane, CAST(max(depth) AS BIGINT) AS peak FROM ({SWEEP_SQL}) GROUP BY lane")
def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.peak_concurrency(request_spans(spark, sf_dir), "lane", "s", "e")


@query(f"SELECT lane, t, CAST(depth AS BIGINT) AS depth, depth > 8 AS over_limit FROM ({SWEEP_SQL}) WHERE d = 1")
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.queue_depth(request_spans(spark, sf_dir), "lane", "s", "e")


@query(
    f"""WITH landed AS (SELECT * FROM ({ASSEMBLED_SQL}) WHERE arrival <> 3), every AS (SELECT conv_id, unnest(range(max(seq) + 1)) AS seq FROM landed GROUP BY conv_id)
  SELECT conv_id, seq, text, l.conv_id IS NULL AS is_gap FROM (SELECT conv_id, seq FROM every UNION SELECT conv_id, seq FROM landed) e LEFT JOIN landed l USING (conv_id, seq)""".replace("l.conv_id IS NULL", "l.arrival IS NULL")
)
def assembly_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = assemble.first_wins(arrivals(spark, sf_dir), "conv_id").where("arrival <> 3")
    return assemble.with_gaps(landed, "conv_id").select("conv_id", "seq", "text", "is_gap")


@query(f"SELECT conv_id, seq, text, arrival FROM ({ASSEMBLED_SQL}) WHERE conv_id IN (SELECT conv_id FROM ({ASSEMBLED_SQL}) GROUP BY conv_id HAVING count(*) = max(seq) + 1)")
def complete_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions without a hole; the check fails on any other."""
    landed = assemble.first_wins(arrivals(spark, sf_dir), "conv_id")
    whole = landed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("top")).where("n = top + 1").select("conv_id")
    return assemble.assert_complete(landed.join(whole, "conv_id", "left_semi"), "conv_id").select("conv_id", "seq", "text", "arrival")


@query(
    f"""WITH p AS (SELECT a.conv_id, a.seq, section_id, paragraph_id, forced, is_gap, row_number() OVER w - 1 AS n, max(arrival) OVER w AS ready_at FROM ({ASSEMBLED_SQL}) a JOIN ({STRUCTURED_SQL}) s ON s.conv_id = a.conv_id AND s.turn = a.seq WINDOW w AS (PARTITION BY a.conv_id ORDER BY a.seq)),
  g AS (SELECT conv_id, ready_at, count(*) AS n, max(section_id) AS s, max(paragraph_id) AS p, count(*) FILTER (WHERE forced) AS f, count(*) FILTER (WHERE is_gap) AS g FROM p WHERE n = seq GROUP BY conv_id, ready_at)
  SELECT conv_id, ready_at, CAST(sum(n) OVER w AS BIGINT) AS done, CAST(max(s) OVER w + 1 AS BIGINT) AS sections, CAST(max(p) OVER w + 1 AS BIGINT) AS paragraphs, CAST(sum(f) OVER w AS BIGINT) AS forced, CAST(sum(g) OVER w AS BIGINT) AS gaps FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY ready_at)"""
)
def document_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document's counts each time that an arrival lets it grow."""
    known = structured_turns(spark, sf_dir).select("conv_id", F.col("turn").alias("seq"), "section_id", "paragraph_id", "forced", "is_gap")
    return assemble.growth(assemble.first_wins(arrivals(spark, sf_dir), "conv_id").join(known, ["conv_id", "seq"]), "conv_id")


@query(
    """WITH r AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS f FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
  o AS (SELECT conv_id, turn, CASE f WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 1 END AS attempts, CASE f WHEN 2 THEN 'auth' WHEN 3 THEN 'retryable' WHEN 5 THEN 'media' ELSE 'ok' END AS outcome FROM r)
  SELECT conv_id, turn AS seq, attempts, outcome, outcome <> 'ok' AS is_gap, 0.5 * (pow(2, attempts - 1) - 1) AS waited_s FROM o"""
)
def fault_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How requests end whose faults a table scripts: passing errors, lasting ones, both, none."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").alias("seq"))
    f = ((F.col("conv_id") + F.col("seq")) % 6).cast("int")
    passing = F.when(f == 1, F.array(F.lit("timeout"))).when(f == 4, F.array(F.lit("server"), F.lit("timeout"))).when(f == 5, F.array(F.lit("server")))
    faults = c.where(f != 0).select("conv_id", "seq", (f / 10).alias("latency_s"), F.when(f == 2, "auth").when(f == 3, "server").when(f == 5, "media").alias("raises"), passing.alias("transient"))
    return assemble.outcomes(assemble.faulty(c, faults, "conv_id"), "conv_id", "seq")


CAP = 4
TAKES_SQL = f"SELECT user_id, event_id, t, 1 + (event_id * 7919) % {30 * HOUR} AS d, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ({FRAMES_SQL})"


@query(
    f"""WITH RECURSIVE q AS MATERIALIZED ({TAKES_SQL}), s AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS starts, CAST(NULL AS BIGINT) AS ends, [0, 0, 0, 0]::BIGINT[] AS free FROM (SELECT DISTINCT user_id FROM q)
    UNION ALL SELECT user_id, q.rn, greatest(t, free[1]), greatest(t, free[1]) + d, list_sort(list_append(free[2:], greatest(t, free[1]) + d)) FROM s JOIN q USING (user_id) WHERE q.rn = s.rn + 1)
  SELECT q.user_id, event_id, starts, ends FROM q JOIN s USING (user_id, rn)"""
)
def capped_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each of a user's requests starts and ends if four at most run at once."""
    f = event_frames(spark, sf_dir).select("user_id", "event_id", "t_us", (1 + (F.col("event_id") * 7919) % F.lit(30 * HOUR)).cast("long").alias("takes"))
    return assemble.capped(f, "user_id", "event_id", "t_us", "takes", CAP).select("user_id", "event_id", "starts", "ends")


RING_SQL = f"""SELECT user_id, event_id, rn, ['write', 'write', 'confirm', 'write', 'pin'][event_id % 5 + 1] AS kind, CASE WHEN event_id % 5 IN (2, 4) THEN (event_id * 31) % 40000 ELSE 1600 + event_id % 900 END AS value FROM ({FRAMES_SQL})"""


@query(
    f"""WITH e AS ({RING_SQL}), r AS (SELECT *, coalesce(sum(value) FILTER (WHERE kind = 'write') OVER w, 0) AS written, coalesce(max(value) FILTER (WHERE kind = 'confirm') OVER w, 0) AS confirmed,
    last_value(CASE WHEN kind = 'pin' THEN value END IGNORE NULLS) OVER w AS pinned FROM e WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT *, max(least(confirmed, pinned, written)) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS base FROM r),
  q AS (SELECT *, (event_id * 13) % 30000 AS s0, (event_id * 13) % 30000 + 800 AS s1 FROM b)
  SELECT user_id, event_id, CAST(written AS BIGINT) AS written, CAST(base AS BIGINT) AS base, CASE WHEN s0 < base THEN 'pruned' WHEN s1 > written THEN 'unwritten' END AS error,
    CASE WHEN s0 >= base AND s1 <= written THEN CAST((s0 - base) * 2 AS BIGINT) ELSE -1 END AS from_byte, CASE WHEN s0 >= base AND s1 <= written THEN CAST((s1 - base) * 2 AS BIGINT) ELSE -1 END AS to_byte FROM q"""
)
def ring_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's recording holds after every event, and the bytes that a request then reads."""
    i = F.col("event_id")
    kind = F.get(F.array(*(F.lit(k) for k in ("write", "write", "confirm", "write", "pin"))), (i % 5).cast("int"))
    value = F.when((i % 5).isin(2, 4), (i * 31) % 40000).otherwise(1600 + i % 900)
    f = event_frames(spark, sf_dir).withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "event_id")))
    held = ring.retention(f.select("user_id", "event_id", "at", kind.alias("kind"), value.alias("value")), "user_id", "at")
    first = (i * 13) % 30000
    got = held.withColumn("x", ring.sliced(first / 16000.0, (first + 800) / 16000.0, F.col("base"), F.col("written"), 16000))
    byte = lambda c: F.coalesce(f"x.{c}", F.lit(-1)).alias(c)
    return got.select("user_id", "event_id", "written", "base", "x.error", byte("from_byte"), byte("to_byte"))


# ---- terms ------------------------------------------------------------------------------------------------

_COMMON_SQL = "[" + ", ".join(f"'{w}'" for w in sorted(set(text.COMMON))) + "]"
TERMS_SQL = rf"""SELECT conv_id, turn, core, arg_min(token, pos) AS term, min(pos) AS pos FROM (
  SELECT *, regexp_replace(lower(token), '[^a-z0-9]', '', 'g') AS core FROM (
  SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9''\-]*') AS w FROM conversations)))
  WHERE core <> '' AND ((pos > 0 AND regexp_full_match(token, '[A-Z][A-Za-z0-9]+')) OR (regexp_full_match(core, '[a-z]{{6,}}') AND NOT list_contains({_COMMON_SQL}, core)) OR (length(core) >= 3 AND regexp_matches(core, '[0-9]') AND regexp_matches(core, '[a-z]')))
  GROUP BY conv_id, turn, core"""
REGISTRY_SQL = f"SELECT conv_id, core, count(*) AS n, coalesce(arg_min(term, turn) FILTER (WHERE regexp_matches(term, '^[A-Z]')), arg_min(term, turn)) AS display FROM ({TERMS_SQL}) GROUP BY conv_id, core"


def turn_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.terms(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


@query(f"SELECT conv_id, turn, core, term, CAST(pos AS BIGINT) AS pos FROM ({TERMS_SQL})")
def extract_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_terms(spark, sf_dir).withColumn("pos", F.col("pos").cast("long"))


@query(REGISTRY_SQL)
def term_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.registry(turn_terms(spark, sf_dir), "conv_id", "turn")


@query(
    f"""SELECT conv_id, array_to_string(list_reduce(list_prepend({{'n': 0::BIGINT, 'chars': 0::BIGINT, 'out': ['']}}, list_transform(terms, lambda x: {{'n': 0::BIGINT, 'chars': 0::BIGINT, 'out': [x]}})),
    lambda a, x: CASE WHEN a.n < 20 AND a.chars + length(x.out[1]) <= 120 THEN {{'n': a.n + 1, 'chars': a.chars + length(x.out[1]), 'out': list_concat(a.out, x.out)}} ELSE a END).out[2:], ' ') AS keyterms
  FROM (SELECT conv_id, list(display ORDER BY n DESC, length(core) DESC, core) AS terms FROM ({REGISTRY_SQL}) GROUP BY conv_id)"""
)
def keyterms_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = glossary.keyterms(glossary.registry(turn_terms(spark, sf_dir), "conv_id", "turn"), "conv_id", max_terms=20, max_chars=120)
    return k.select("conv_id", F.array_join("keyterms", " ").alias("keyterms"))


@query(
    f"""WITH found AS MATERIALIZED ({TERMS_SQL}) SELECT conv_id, turn,
  (SELECT count(DISTINCT core) FROM found f WHERE f.conv_id = c.conv_id AND f.turn < c.turn) AS prior_new_terms,
  (SELECT count(*) FROM found f WHERE f.conv_id = c.conv_id AND f.turn < c.turn) AS prior_seen FROM conversations c"""
)
def carryover_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.carryover(turn_terms(spark, sf_dir), table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(
    f"""WITH found AS MATERIALIZED ({TERMS_SQL}), seen AS (SELECT c.conv_id, c.turn, f.core, count(*) AS n, coalesce(arg_min(f.term, f.turn) FILTER (WHERE regexp_matches(f.term, '^[A-Z]')), arg_min(f.term, f.turn)) AS display
    FROM conversations c JOIN found f ON f.conv_id = c.conv_id AND f.turn < c.turn GROUP BY c.conv_id, c.turn, f.core),
  taken AS (SELECT conv_id, turn, list(display ORDER BY n DESC, length(core) DESC, core)[1:100] AS terms FROM seen GROUP BY conv_id, turn)
  SELECT conv_id, turn, coalesce(array_to_string(terms, ' '), '') AS carried FROM conversations LEFT JOIN taken USING (conv_id, turn)"""
)
def carried_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that each turn is pinned to by those before it."""
    return glossary.carried(turn_terms(spark, sf_dir), table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumn("carried", F.array_join("carried", " "))


@query(
    """SELECT conv_id, turn, right(coalesce((SELECT string_agg(trim(p.text), ' ' ORDER BY p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND trim(p.text) <> ''), ''), 200) AS tail FROM conversations c"""
)
def context_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.context_tail(table(spark, sf_dir, "conversations"), "conv_id", "turn")


# ---- consistency ------------------------------------------------------------------------------------------

CORES_SQL = rf"""cores AS MATERIALIZED (SELECT conv_id, core, sum(k)::BIGINT AS n, min(pl) AS first, arg_min(surface, pl - k * 1000000000000) AS surface FROM (
  SELECT conv_id, core, surface, count(*) AS k, min(turn * 1000000 + pos) AS pl FROM (
  SELECT conv_id, turn, pos, surface, regexp_replace(lower(surface), '[^a-z0-9]', '', 'g') AS core FROM (
  SELECT conv_id, turn, pos, regexp_extract(token, '^([^\p{{L}}\p{{N}}_]*)(.*?)([^\p{{L}}\p{{N}}_]*)$', 2) AS surface FROM (
  SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM conversations)))) WHERE core <> '' GROUP BY ALL) GROUP BY conv_id, core),
  cand AS MATERIALIZED (SELECT *, list_reduce(list_prepend('', string_split(translate(replace(regexp_replace(core, '[^a-z]', '', 'g'), 'x', 'ks'), 'cqzeiou', 'kksaaaa'), '')), lambda a, x: CASE WHEN right(a, 1) = x THEN a ELSE a || x END) AS phonetic FROM cores WHERE length(core) >= 5 AND NOT list_contains({_COMMON_SQL}, core))"""
SPELLING_SQL = "SELECT x.conv_id, x.core AS a, y.core AS b FROM cand x JOIN cand y ON x.conv_id = y.conv_id AND x.first < y.first AND abs(length(x.core) - length(y.core)) <= 2 AND levenshtein(x.core, y.core) <= 2"
REMAP_SQL = f"""WITH RECURSIVE {CORES_SQL}, edge AS MATERIALIZED ({SPELLING_SQL} UNION SELECT x.conv_id, x.core, y.core FROM cand x JOIN cand y ON x.conv_id = y.conv_id AND x.phonetic = y.phonetic AND x.core <> y.core),
  twoway AS MATERIALIZED (SELECT conv_id, a, b FROM edge UNION SELECT conv_id, b, a FROM edge),
  reach AS (SELECT conv_id, core AS a, core AS b FROM cand UNION SELECT r.conv_id, r.a, e.b FROM reach r JOIN twoway e ON e.conv_id = r.conv_id AND e.a = r.b),
  comp AS (SELECT conv_id, a AS core, min(b) AS comp FROM reach GROUP BY ALL),
  ranked AS (SELECT c.conv_id, core, comp, n, surface, row_number() OVER (PARTITION BY c.conv_id, comp ORDER BY n DESC, length(core) DESC, first) AS r, sum(n) OVER (PARTITION BY c.conv_id, comp) AS total FROM comp c JOIN cand USING (conv_id, core)),
  remap AS MATERIALIZED (SELECT m.conv_id, m.core, w.surface AS replacement FROM ranked m JOIN ranked w ON w.conv_id = m.conv_id AND w.comp = m.comp AND w.r = 1 JOIN ranked s ON s.conv_id = m.conv_id AND s.comp = m.comp AND s.r = 2 WHERE m.r > 1 AND m.total >= 2 AND w.n <> s.n)"""


@query(f"WITH {CORES_SQL} SELECT conv_id, phonetic, count(*) AS members, arg_min(core, first) AS head FROM cand GROUP BY conv_id, phonetic")
def phonetic_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consistency.candidates(consistency.cores(table(spark, sf_dir, "conversations"), "conv_id", "turn"))
    return found.groupBy("conv_id", text.phonetic_key(F.col("core")).alias("phonetic")).agg(F.count(F.lit(1)).alias("members"), F.min_by("core", "first").alias("head"))


@query(f"WITH {CORES_SQL} {SPELLING_SQL}")
def similar_term_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consistency.candidates(consistency.cores(table(spark, sf_dir, "conversations"), "conv_id", "turn"))
    return consistency.spelling_edges(found, "conv_id")


@query(REMAP_SQL + " SELECT conv_id, core, replacement FROM remap")
def consistency_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.remap(table(spark, sf_dir, "conversations"), "conv_id", "turn")


CLEAN_SQL = (
    REMAP_SQL
    + r""" SELECT c.conv_id, c.turn, CASE WHEN c.conv_id IN (SELECT conv_id FROM remap) THEN coalesce(t.joined, '') ELSE c.text END AS clean FROM conversations c LEFT JOIN (
  SELECT conv_id, turn, string_agg(coalesce(p[1] || replacement || p[3], token), ' ' ORDER BY pos) AS joined FROM (
  SELECT w.*, replacement FROM (SELECT conv_id, turn, pos, token, p, regexp_replace(lower(p[2]), '[^a-z0-9]', '', 'g') AS core FROM (
  SELECT *, [regexp_extract(token, '^([^\p{L}\p{N}_]*)(.*?)([^\p{L}\p{N}_]*)$', 1), regexp_extract(token, '^([^\p{L}\p{N}_]*)(.*?)([^\p{L}\p{N}_]*)$', 2), regexp_extract(token, '^([^\p{L}\p{N}_]*)(.*?)([^\p{L}\p{N}_]*)$', 3)] AS p FROM (
  SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM conversations)))) w LEFT JOIN remap USING (conv_id, core)) GROUP BY conv_id, turn) t USING (conv_id, turn)"""
)


@query(CLEAN_SQL)
def consistency_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.clean(table(spark, sf_dir, "conversations"), "conv_id", "turn")


# ---- seams and scores -------------------------------------------------------------------------------------

SEAM_STEP = 28
SEAM_SQL = rf"""WITH d AS (SELECT doc_id, doc_id % 9 AS k, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM documents),
  p AS (SELECT doc_id, unnest(list_transform(range(greatest(CAST(ceil(len(w) / {SEAM_STEP}) AS BIGINT) - 1, 1)), lambda i: {{'seam': i + 1, 'l': w[i * {SEAM_STEP} + 1:(i + 1) * {SEAM_STEP} + k], 'r': w[(i + 1) * {SEAM_STEP} + 1:(i + 2) * {SEAM_STEP} + k]}})) AS x FROM d),
  s AS (SELECT doc_id, x.seam AS seam, x.l AS l, x.r AS r FROM p),
  n AS (SELECT *, list_transform(l, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS a, list_transform(r, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS b FROM s),
  o AS (SELECT *, coalesce(list_max(list_filter(range(2, least(len(l), len(r), 15) + 1), lambda m: len(list_filter(range(1, m + 1), lambda i: a[len(a) - m + i] = b[i] AND b[i] <> '')) / m >= 0.6)), 0) AS overlap FROM n)
  SELECT doc_id, CAST(seam AS INTEGER) AS seam, CAST(overlap AS INTEGER) AS overlap_len, overlap > 0 AS aligned, CASE WHEN overlap > 0 THEN array_to_string(list_concat(l, r[overlap + 1:]), ' ') ELSE array_to_string(list_filter([array_to_string(l, ' '), '[⚠ seam]', array_to_string(r, ' ')], lambda x: x <> ''), ' ') END AS spliced FROM o"""


@query(SEAM_SQL)
def seam_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text in overlapping parts, put together again at each seam."""
    sure = lambda words: F.transform(words, lambda w: F.struct(w.alias("text"), F.lit(1.0).alias("confidence")))
    cut = lambda words: splice.seams(F.col(words), SEAM_STEP, (F.col("doc_id") % 9).cast("int"))
    # What a generator makes isn't worked out again.
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(text.words_of(F.col("text")))).alias("w"))
    d = d.select("doc_id", "w", F.explode(F.array(F.transform("w", text.core))).alias("c"))
    d = d.select("doc_id", F.posexplode(F.arrays_zip(cut("w").alias("words"), cut("c").alias("cores"))).alias("at", "x"))
    d = d.select("doc_id", (F.col("at") + 1).alias("seam"), "x.words.left", "x.words.right", splice.overlap_of_cores(F.col("x.cores.left"), F.col("x.cores.right")).alias("overlap_len"))
    return d.select("doc_id", "seam", "overlap_len", (F.col("overlap_len") > 0).alias("aligned"), splice.spliced_text(sure(F.col("left")), sure(F.col("right")), F.col("overlap_len")).alias("spliced"))


VERBATIM_SQL = f"(SELECT conv_id, turn, CASE WHEN is_gap THEN '' ELSE coalesce(text, '') END AS text FROM ({TURNS_SQL}))"
SNAPSHOT = "type string, seq bigint, sections array<struct<section_id:bigint,paragraphs:array<struct<paragraph_id:bigint,blocks:array<struct<idx:bigint,block:struct<turn:bigint,verbatim:string,clean:string,is_gap:boolean,forced:boolean,error:string,lead_ms:bigint,seam:struct<overlap_len:int,spliced:string>>>>>>>>, stats struct<done:bigint,sections:bigint,paragraphs:bigint,forced:bigint,gaps:bigint>, final boolean"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, message): each session as one nested JSON message with its seams and counts."""
    t = structured_turns(spark, sf_dir).withColumn("verbatim", F.when(F.col("is_gap"), "").otherwise(F.coalesce("text", F.lit(""))))
    cleaned = consistency.clean(t, "conv_id", "turn", "verbatim")
    met = splice.neighbours(t.withColumn("words", messages.result(F.col("verbatim"))["words"]), "conv_id", "turn", text="verbatim")
    seam = met.select("conv_id", "turn", F.struct("overlap_len", "spliced").alias("seam"))
    t = t.join(cleaned, ["conv_id", "turn"]).join(seam, ["conv_id", "turn"], "left")
    t = t.withColumn("block", F.struct("turn", "verbatim", "clean", "is_gap", "forced", "error", "lead_ms", "seam"))
    stats = structure.stats(t, "conv_id").select("conv_id", F.struct("done", "sections", "paragraphs", "forced", "gaps").alias("stats"))
    last = t.groupBy("conv_id").agg(F.max("turn").alias("seq"))
    whole = structure.nested(t, "conv_id").join(stats, "conv_id").join(last, "conv_id")
    return whole.select("conv_id", F.to_json(F.struct(F.lit("document").alias("type"), "seq", "sections", "stats", F.lit(True).alias("final"))).alias("message"))


@query(
    CLEAN_SQL.replace("FROM conversations", f"FROM {VERBATIM_SQL}").replace("WITH RECURSIVE ", f"""WITH RECURSIVE st AS MATERIALIZED ({STRUCTURED_SQL}), tot AS MATERIALIZED (SELECT conv_id, count(*) AS done, max(section_id) + 1 AS sections, max(paragraph_id) + 1 AS paragraphs, count(*) FILTER (WHERE forced) AS forced_blocks, count(*) FILTER (WHERE is_gap) AS gaps, max(turn) AS seq FROM st GROUP BY conv_id),
  nb AS MATERIALIZED (SELECT conv_id, turn, l, w, list_transform(l, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS a, list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS b FROM (
    SELECT *, lag(w) OVER o AS l, lag(forced) OVER o AS lf, lag(is_gap) OVER o AS lg FROM (SELECT conv_id, turn, forced, is_gap, CASE WHEN is_gap THEN [] ELSE regexp_extract_all(coalesce(text, ''), '\\S+') END AS w FROM st) WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) WHERE lf AND NOT lg AND NOT is_gap),
  sm AS MATERIALIZED (SELECT conv_id, turn, coalesce(list_max(list_filter(range(2, least(len(l), len(w), 15) + 1), lambda m: len(list_filter(range(1, m + 1), lambda i: a[len(a) - m + i] = b[i] AND b[i] <> '')) / m >= 0.6)), 0) AS k FROM nb),
  """, 1).replace("SELECT c.conv_id, c.turn, CASE WHEN", "SELECT c.conv_id, c.turn, st.section_id::BIGINT AS section_id, st.paragraph_id::BIGINT AS paragraph_id, c.text AS verbatim, st.is_gap, st.forced, st.error, st.lead_ms, coalesce(sm.k, -1)::INTEGER AS overlap_len, tot.done, tot.sections::BIGINT AS sections, tot.paragraphs::BIGINT AS paragraphs, tot.forced_blocks, tot.gaps, tot.seq, CASE WHEN", 1)
    + " JOIN st ON st.conv_id = c.conv_id AND st.turn = c.turn JOIN tot ON tot.conv_id = c.conv_id LEFT JOIN sm ON sm.conv_id = c.conv_id AND sm.turn = c.turn"
)
def document_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that each session's message holds, read back from it; a block without a seam has overlap_len -1."""
    m = snapshots(spark, sf_dir).select("conv_id", F.from_json("message", SNAPSHOT).alias("m"))
    s = m.select("conv_id", "m.seq", "m.stats.*", F.explode("m.sections").alias("s")).withColumnRenamed("forced", "forced_blocks")
    p = s.select("*", "s.section_id", F.explode("s.paragraphs").alias("p"))
    b = p.select("*", "p.paragraph_id", F.explode("p.blocks").alias("b")).drop("s", "p")
    return b.select("conv_id", "seq", "done", "sections", "paragraphs", "forced_blocks", "gaps", "section_id", "paragraph_id", "b.block.turn", "b.block.verbatim", "b.block.clean", "b.block.is_gap", "b.block.forced", "b.block.error", "b.block.lead_ms", F.coalesce("b.block.seam.overlap_len", F.lit(-1)).alias("overlap_len"))


LIVE_SQL = rf"""SELECT *, lag(w) OVER o AS before FROM (SELECT conv_id, turn, forced, is_gap, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM ({TURNS_SQL})) WINDOW o AS (PARTITION BY conv_id ORDER BY turn)"""


@query(
    f"""WITH live AS (SELECT conv_id, turn, (conv_id + turn) % 2 = 0 AS forced, is_gap, list_concat(coalesce(before[greatest(1, len(before) - (conv_id + turn) % 4 + 1):] , []), w) AS w FROM ({LIVE_SQL})),
  s AS (SELECT *, lag(w) OVER o AS l, lag(forced) OVER o AS lf, lag(is_gap) OVER o AS lg, lag(turn) OVER o AS lt FROM live WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
  n AS (SELECT *, list_transform(l, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS a, list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS b FROM s WHERE lf AND NOT lg AND NOT is_gap),
  o AS (SELECT *, coalesce(list_max(list_filter(range(2, least(len(l), len(w), 15) + 1), lambda m: len(list_filter(range(1, m + 1), lambda i: a[len(a) - m + i] = b[i] AND b[i] <> '')) / m >= 0.6)), 0) AS k FROM n)
  SELECT conv_id, turn, CAST(k AS INTEGER) AS overlap_len, k > 0 AS aligned, trim(array_to_string(l, ' ') || ' ' || array_to_string(w, ' ')) AS raw_concat,
    CASE WHEN k > 0 THEN array_to_string(list_concat(l[1:len(l) - k], list_transform(range(1, k + 1), lambda i: CASE WHEN (len(l) - k + i + lt) % 10 >= (i + turn) % 10 THEN l[len(l) - k + i] ELSE w[i] END), w[k + 1:]), ' ')
      ELSE array_to_string(list_filter([array_to_string(l, ' '), '{splice.MARK}', array_to_string(w, ' ')], lambda x: x <> ''), ' ') END AS spliced, k = 0 AS marker FROM o"""
)
def seam_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn that follows a forced cut put together with the one before, whose last words it begins with."""
    t, inside = turns(spark, sf_dir), Window.partitionBy("conv_id").orderBy("turn")
    live = t.withColumn("w", text.words_of(F.col("text"))).withColumn("before", F.lag("w").over(inside))
    k = ((F.col("conv_id") + F.col("turn")) % 4).cast("int")
    tail = F.when(k > 0, F.slice("before", F.greatest(F.lit(1), F.size("before") - k + 1), k)).otherwise(F.array().cast("array<string>"))
    words = F.concat(F.coalesce(F.when(F.size("before") > 0, tail), F.array().cast("array<string>")), F.col("w"))
    sure = F.transform("__w", lambda w, i: F.struct(w.alias("text"), ((i + 1 + F.col("turn")) % 10 / 10).alias("confidence")))
    live = live.withColumn("__w", words).select("conv_id", "turn", "is_gap", ((F.col("conv_id") + F.col("turn")) % 2 == 0).alias("forced"), F.array_join("__w", " ").alias("text"), sure.alias("words"))
    return splice.neighbours(live, "conv_id", "turn")


@query(
    r"""WITH RECURSIVE p AS MATERIALIZED (SELECT conv_id, turn, r, h, len(r) AS n, len(h) AS m FROM (SELECT conv_id, turn, h, lag(h) OVER w AS r, lag(text) OVER w AS before
    FROM (SELECT conv_id, turn, text, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]', '', 'g'), '\S+') AS h FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE before IS NOT NULL),
  d AS (SELECT conv_id, turn, 0 AS k, 0 AS i, 0 AS v, CAST(NULL AS INTEGER) AS u FROM p UNION ALL
    SELECT conv_id, turn, k + 1, i + s, min(CASE WHEN s = 0 THEN v + 1 ELSE least(v + 1, u + CASE WHEN r[i + 1] = h[k - i] THEN 0 ELSE 1 END) END)::INTEGER, min(CASE WHEN s = 0 THEN v END)::INTEGER
    FROM (SELECT *, unnest([0, 1]) AS s FROM d) JOIN p USING (conv_id, turn) WHERE i + s <= n AND k + 1 - i - s <= m GROUP BY conv_id, turn, k, i + s)
  SELECT conv_id, turn, v AS errors, CAST(n AS INTEGER) AS ref_words, CASE WHEN n > 0 THEN round(v / n, 6) WHEN m > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS wer FROM p JOIN d USING (conv_id, turn) WHERE k = n + m AND i = n"""
)
def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors of each turn against the one before."""
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    scored = metrics.word_errors(c.where("before is not null"), "before", "text")
    return scored.select("conv_id", "turn", "errors", "ref_words", F.round("wer", 6).alias("wer"))


@query(
    f"""WITH g AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY rn) AS d FROM ({FRAMES_SQL})),
  l AS (SELECT user_id, coalesce(list(t ORDER BY t) FILTER (WHERE d >= {PARAGRAPH}), []) AS p, coalesce(list(t + (t // 1000000) % {20} * {HOUR // 4} ORDER BY t + (t // 1000000) % {20} * {HOUR // 4}) FILTER (WHERE d >= {SECTION}), []) AS q FROM g GROUP BY user_id),
  m AS (SELECT user_id, len(p) AS predicted, len(q) AS truth, list_reduce(list_prepend({{'n': 0::BIGINT, 'u': []::BIGINT[], 'x': 0::BIGINT}}, list_transform(p, lambda x: {{'n': 0::BIGINT, 'u': []::BIGINT[], 'x': x}})),
    lambda a, y: CASE WHEN len(list_filter(range(1, len(q) + 1), lambda i: NOT list_contains(a.u, i) AND abs(q[i] - y.x) <= {2 * HOUR})) = 0 THEN a
      ELSE {{'n': a.n + 1, 'u': list_append(a.u, list_filter(range(1, len(q) + 1), lambda i: NOT list_contains(a.u, i) AND abs(q[i] - y.x) <= {2 * HOUR})[1]), 'x': 0::BIGINT}} END).n AS hits FROM l)
  SELECT user_id, CAST(predicted AS BIGINT) AS predicted, CAST(truth AS BIGINT) AS truth, hits, CASE WHEN predicted + truth = 0 THEN 1.0 WHEN predicted = 0 THEN 0.0 ELSE hits / predicted END::DOUBLE AS precision,
    CASE WHEN predicted + truth = 0 THEN 1.0 WHEN truth = 0 THEN 0.0 ELSE hits / truth END::DOUBLE AS recall, CASE WHEN predicted + truth = 0 THEN 1.0 ELSE 2 * hits / (predicted + truth) END::DOUBLE AS f1 FROM m"""
)
def boundary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_frames(spark, sf_dir)
    d = f.withColumn("d", F.col("t_us") - F.lag("t_us").over(Window.partitionBy("user_id").orderBy("t_us", "event_id")))
    moved = F.col("t_us") + (F.floor(F.col("t_us") / 1_000_000) % 20) * (HOUR // 4)
    lists = d.groupBy("user_id").agg(F.collect_list(F.when(F.col("d") >= PARAGRAPH, F.col("t_us"))).alias("p"), F.collect_list(F.when(F.col("d") >= SECTION, moved)).alias("q"))
    scored = metrics.boundary_f1(lists, "p", "q", 2 * HOUR)
    return scored.select("user_id", F.size("p").cast("long").alias("predicted"), F.size("q").cast("long").alias("truth"), F.col("hits").cast("long").alias("hits"), "precision", "recall", "f1")


TERM_PAIRS = [("the", "teh"), ("and", "adn"), ("with", "from"), ("that", "this")]
_PAIRS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TERM_PAIRS) + ") AS v(canonical, variant)"
NORMAL_SQL = r"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]', '', 'g'), '\S+')"


def term_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERM_PAIRS, "canonical string, variant string")


@query(
    f"""WITH t AS (SELECT conv_id, unnest({NORMAL_SQL}) AS token FROM conversations), h AS (SELECT conv_id, count(*) FILTER (WHERE token IN (SELECT canonical FROM {_PAIRS_SQL})) AS canonical, count(*) FILTER (WHERE token IN (SELECT canonical FROM {_PAIRS_SQL}) OR token IN (SELECT variant FROM {_PAIRS_SQL})) AS uses FROM t GROUP BY conv_id)
  SELECT conv_id, coalesce(canonical, 0) AS canonical, coalesce(uses, 0) AS uses, CASE WHEN coalesce(uses, 0) = 0 THEN 1.0 ELSE round(canonical / uses, 6) END::DOUBLE AS rate FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN h USING (conv_id)"""
)
def terminology_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.consistency_rate(table(spark, sf_dir, "conversations"), term_pairs(spark), "conv_id")
    return r.withColumn("rate", F.round("rate", 6))


@query(
    rf"""SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, canonical, CAST(rank AS BIGINT) AS rank, rank % 3 = 2 AS drifts FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, canonical ORDER BY turn, pos) - 1 AS rank FROM (
  SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM conversations)) JOIN {_PAIRS_SQL} ON token = canonical)"""
)
def drift_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = metrics.occurrences(table(spark, sf_dir, "conversations"), term_pairs(spark), "conv_id", "turn")
    return o.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "canonical", F.col("rank").cast("long").alias("rank"), "drifts")


# ---- checks and messages ----------------------------------------------------------------------------------


@query(
    """SELECT event_id, CASE WHEN NOT rate > 0 THEN 'sample_rate' WHEN fmt NOT IN ('pcm', 'wav') THEN 'audio_format' WHEN both_prompts THEN 'prompt_alias' WHEN plen > 6000 THEN 'stt_prompt' WHEN ilen > 2048 THEN 'llm_instruction' WHEN two THEN 'keyterm_alias' WHEN n > 100 THEN 'keyterm_count' WHEN n * 5 * (event_id % 40) > 8000 THEN 'keyterm_chars' END AS violation
  FROM (SELECT event_id, (event_id % 13) * 1000 AS rate, CASE WHEN event_id % 17 = 0 THEN 'mp3' WHEN event_id % 2 = 0 THEN 'pcm' ELSE 'wav' END AS fmt, event_id % 19 = 0 AS both_prompts, (event_id % 23) * 300 AS plen, (event_id % 29) * 100 AS ilen, event_id % 31 = 0 AS two, event_id % 110 AS n FROM events)"""
)
def config_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    many = F.transform(F.sequence(F.lit(0), (i % 110).cast("int")), lambda _: F.repeat(F.lit("abcde"), (i % 40).cast("int")))
    terms = F.slice(many, F.lit(1), (i % 110).cast("int"))
    config = e.select(
        "event_id",
        ((i % 13) * 1000).alias("sample_rate"),
        F.lit(1).alias("channels"),
        F.when(i % 17 == 0, "mp3").when(i % 2 == 0, "pcm").otherwise("wav").alias("audio_format"),
        F.repeat(F.lit("p"), ((i % 23) * 300).cast("int")).alias("stt_prompt"),
        F.when(i % 19 == 0, "other").alias("prompt"),
        terms.alias("keyterms_prompt"),
        F.when(i % 31 == 0, F.array(F.lit("x"))).alias("keyterms"),
        F.lit(None).cast("array<string>").alias("word_boost"),
        F.repeat(F.lit("i"), ((i % 29) * 100).cast("int")).alias("llm_instruction"),
    )
    return config.select("event_id", messages.violation().alias("violation"))


@query(
    """SELECT event_id, code, CASE WHEN code = 200 THEN 'ok' WHEN code = 404 THEN 'auth' WHEN code = 400 THEN 'bad_request' WHEN code = 415 THEN 'media' WHEN code BETWEEN 500 AND 599 THEN 'server' ELSE 'other' END AS kind, code BETWEEN 500 AND 599 AS retryable
  FROM (SELECT event_id, [200, 404, 400, 415, 500, 503, 302, 600][event_id % 8 + 1] AS code FROM events)"""
)
def status_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*(F.lit(c) for c in (200, 404, 400, 415, 500, 503, 302, 600)))
    e = table(spark, sf_dir, "events").select("event_id", F.get(codes, (F.col("event_id") % 8).cast("int")).alias("code"))
    return e.withColumn("kind", messages.status_class(F.col("code"))).withColumn("retryable", messages.retryable(F.col("kind")))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS text, CAST(event_id % 3 AS INTEGER) AS words, CASE WHEN event_id % 4 = 0 OR event_id % 4 = 1 THEN CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END ELSE 'fixed ' || event_type END AS best FROM events"""
)
def response_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    words = F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (i % 3).cast("int")), lambda _: F.struct(F.col("event_type").alias("text")))
    sent = F.to_json(F.struct(F.when(i % 5 != 0, F.col("event_type")).alias("text"), F.when(i % 3 != 0, words).alias("words"), F.when(i % 4 == 0, "").when(i % 4 != 1, F.concat(F.lit("fixed "), "event_type")).alias("llm_response")))
    got = table(spark, sf_dir, "events").select("event_id", messages.decoded(sent).alias("x"))
    return got.select("event_id", F.col("x.text").alias("text"), F.size("x.words").alias("words"), text.best_text(F.col("x.llm_response"), F.col("x.text")).alias("best"))


@query("SELECT 'A' AS condition, 6 AS segments, 38 AS word_errors, 1428 AS ref_words, 5 AS lost, 0 AS forced, 72 AS canonical, 105 AS uses, 0 AS boundaries_found, 27 AS boundaries_true, 0 AS boundary_hits UNION ALL SELECT 'B', 42, 33, 1428, 0, 0, 72, 105, 27, 27, 27 UNION ALL SELECT 'C', 42, 0, 1428, 0, 0, 105, 105, 27, 27, 27")
def abc_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-condition comparison over the generated demo session, against its known integers."""
    return experiment.compare(spark)


@query(
    """SELECT event_id, printf('{"type":"pending","seq":%d,"t_start":%d.%d,"t_end":%d.%d,"duration_s":%d.0,"lead_pause":0.5,"forced":%s,"done":%d,"total":%d}', event_id % 50, event_id % 90, event_id % 10, event_id % 90 + 7, event_id % 10, 7, CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END, event_id % 5, 9) AS message,
  event_id % 200 > 110 AS too_long, CASE WHEN event_id % 2 = 0 THEN 'audio.wav' ELSE 'audio.pcm' END AS filename, (event_id % 7) * 2 / 4.0 AS seconds, 'Technical dictation; keep terminology consistent. Recent context: ' || event_type AS prompt FROM events"""
)
def messages_and_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending messages, limits, file parts, lengths and prompts by formula."""
    i = F.col("event_id")
    start = (i % 90) + (i % 10) / 10
    segment = F.struct((i % 50).alias("seq"), start.alias("t_start"), (start + 7).alias("t_end"), F.lit(0.5).alias("lead_pause"), (i % 3 == 0).alias("forced"))
    audio = F.repeat(F.lit("ab"), (i % 7).cast("int")).cast("binary")
    return table(spark, sf_dir, "events").select(
        "event_id",
        messages.pending_json(segment, i % 5, F.lit(9)).alias("message"),
        messages.too_long((i % 200).cast("double")).alias("too_long"),
        messages.audio_part(F.when(i % 2 == 0, "wav").otherwise("pcm"))["filename"].alias("filename"),
        text.pcm_seconds(audio, 1, 2).alias("seconds"),
        glossary.prompt(F.col("event_type")).alias("prompt"),
    )


@query(
    r"""SELECT user_id, printf('{"type":"init","total_s":%d.5,"sample_rate":16000,"n_segments":%d,"forced_cut_rate":0.25,"paragraph_pause_s":1.2,"section_pause_s":3.0,"drift_terms":[{"canonical":"a","drift":"%s"},{"canonical":"b","drift":"y"}],"paragraph_boundary_times":[1.5,%d.25]}', user_id % 60, n, event_type, n) AS message,
  '{"type":"init","mode":"live","sample_rate":16000,"n_segments":null,"paragraph_pause_s":1.2,"section_pause_s":3.0,"drift_terms":[],"paragraph_boundary_times":[]}' AS live FROM (SELECT user_id, count(*) AS n, min(event_type) AS event_type FROM events GROUP BY user_id)"""
)
def init_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages that open each user's session, replayed and live."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_type").alias("e"))
    pair = lambda a, b: F.struct(F.lit(a).alias("canonical"), b.alias("variant"))
    terms = F.array(pair("b", F.lit("y")), pair("a", F.col("e")))
    told = messages.init_json(F.col("user_id") % 60 + 0.5, F.lit(16000), F.col("n"), F.lit(0.25), terms, F.array(F.lit(1.5), F.col("n") + 0.25))
    return u.select("user_id", told.alias("message"), messages.live_init_json(F.lit(16000)).alias("live"))


@query("SELECT event_id, CAST((event_id % 300) / (8000 * (event_id % 3 + 1)) AS DOUBLE) AS seconds, CAST(len(regexp_extract_all(event_type, '\\S+')) AS INTEGER) AS words FROM events")
def audio_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of generated WAV files by their headers, and the words of generated results."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")

    def little(value: Column, size: int) -> Column:
        return F.concat(*(F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size)))

    n, rate = i % 300, 8000 * (i % 3 + 1)
    plain = lambda s: F.lit(s.encode().hex())
    head = [plain("RIFF"), little(36 + n * 2, 4), plain("WAVEfmt "), little(F.lit(16), 4), little(F.lit(1), 2), little(F.lit(1), 2), little(rate, 4), little(rate * 2, 4), little(F.lit(2), 2), little(F.lit(16), 2), plain("data"), little(n * 2, 4)]
    audio = F.unhex(F.concat(*head, F.repeat(F.lit("0000"), n.cast("int"))))
    return e.select("event_id", text.wav_seconds(audio).alias("seconds"), F.size(messages.result(F.col("event_type"))["words"]).alias("words"))
