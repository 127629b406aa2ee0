"""Requests, responses and messages as JSON and their checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words_of

# The interface's limits.
PROMPT_CHARS, INSTRUCTION_CHARS, TERMS, TERM_CHARS, LONGEST_S = 6000, 2048, 100, 8000, 110.0
RESPONSE = "text string, words array<struct<text:string,confidence:double>>, confidence double, llm_response string, llm_error string, audio_duration_ms bigint, session_id string, request_time_ms bigint, sync_time_ms bigint"
_ALIASES = ("keyterms_prompt", "keyterms", "word_boost")


def violation(c: str = "") -> Column:
    """The first rule that a request configuration breaks, or null.  `c`: prefix of its columns, such as "config."."""
    col = lambda name: F.col(f"{c}{name}")
    given = sum((col(a).isNotNull().cast("int") for a in _ALIASES), F.lit(0))
    terms = F.coalesce(*(col(a) for a in _ALIASES))
    chars = F.aggregate(F.transform(terms, F.length), F.lit(0), lambda a, n: a + n)
    rules = [
        (~F.coalesce(col("sample_rate") > 0, F.lit(False)), "sample_rate"),
        (~F.coalesce(col("channels") > 0, F.lit(False)), "channels"),
        (~F.coalesce(col("audio_format").isin("pcm", "wav"), F.lit(False)), "audio_format"),
        (col("stt_prompt").isNotNull() & col("prompt").isNotNull(), "prompt_alias"),
        (F.length(col("stt_prompt")) > PROMPT_CHARS, "stt_prompt"),
        (F.length(col("prompt")) > PROMPT_CHARS, "prompt"),
        (F.length(col("llm_instruction")) > INSTRUCTION_CHARS, "llm_instruction"),
        (given > 1, "keyterm_alias"),
        (F.size(terms) > TERMS, "keyterm_count"),
        (chars > TERM_CHARS, "keyterm_chars"),
    ]
    found = F.lit(None).cast("string")
    for test, name in reversed(rules):
        found = F.when(test, name).otherwise(found)
    return found


def too_long(seconds: Column) -> Column:
    return seconds > LONGEST_S


def status_class(code: Column) -> Column:
    """What an HTTP status means: ok or the kind of error."""
    return F.when(code == 200, "ok").when(code == 404, "auth").when(code == 400, "bad_request").when(code == 415, "media").when((code >= 500) & (code < 600), "server").otherwise("other")


def retryable(kind: Column) -> Column:
    return kind.isin("server", "timeout")


def audio_part(audio_format: Column) -> Column:
    wav = audio_format == "wav"
    return F.struct(F.when(wav, "audio.wav").otherwise("audio.pcm").alias("filename"), F.when(wav, "audio/wav").otherwise("audio/pcm").alias("mime"))


def decoded(json: Column) -> Column:
    """A response as a struct: a missing text is empty, missing words are none, a missing confidence of a word is 0."""
    x = F.from_json(json, RESPONSE)
    words = F.transform(F.coalesce(x["words"], F.array().cast("array<struct<text:string,confidence:double>>")), lambda w: F.struct(F.coalesce(w["text"], F.lit("")).alias("text"), F.coalesce(w["confidence"], F.lit(0.0)).alias("confidence")))
    return x.withField("text", F.coalesce(x["text"], F.lit(""))).withField("words", words)


def result(text: Column, confidence: float = 1.0, session: str = "canned", took_ms: int = 10) -> Column:
    """A response as `decoded` gives it, made from a text whose words are all sure."""
    none = lambda kind: F.lit(None).cast(kind)
    words = F.transform(words_of(text), lambda w: F.struct(w.alias("text"), F.lit(1.0).alias("confidence")))
    times = [F.lit(took_ms).cast("long").alias(n) for n in ("request_time_ms", "sync_time_ms")]
    return F.struct(
        F.coalesce(text, F.lit("")).alias("text"), words.alias("words"), F.lit(confidence).alias("confidence"), none("string").alias("llm_response"), none("string").alias("llm_error"), none("long").alias("audio_duration_ms"), F.lit(session).alias("session_id"), *times
    )


def request_json(c: str = "") -> Column:
    """The fields that go over the wire; nulls and an empty list of languages stay away."""
    names = ("sample_rate", "channels", "language_codes", "stt_prompt", "prompt", *_ALIASES, "llm_instruction")
    value = lambda n: F.when(F.size(F.col(f"{c}{n}")) > 0, F.col(f"{c}{n}")) if n == "language_codes" else F.col(f"{c}{n}")
    return F.to_json(F.struct(*(value(n).alias(n) for n in names)))


def pending_json(segment: Column, done: Column, total: Column) -> Column:
    """The message for a segment (struct of seq, t_start, t_end, lead_pause in seconds, forced) under way; times to three places."""
    to3 = lambda x: F.bround(x, 3)
    return F.to_json(
        F.struct(
            F.lit("pending").alias("type"),
            segment["seq"].alias("seq"),
            to3(segment["t_start"]).alias("t_start"),
            to3(segment["t_end"]).alias("t_end"),
            to3(segment["t_end"] - segment["t_start"]).alias("duration_s"),
            to3(segment["lead_pause"]).alias("lead_pause"),
            segment["forced"].alias("forced"),
            done.alias("done"),
            total.alias("total"),
        )
    )


def init_json(total_s: Column, sample_rate: Column, segments: Column, forced_rate: Column, terms: Column, times: Column, paragraph_s: float = 1.2, section_s: float = 3.0) -> Column:
    """The message that opens a replayed session.  terms: structs of canonical and variant; times: true boundaries in seconds."""
    named = F.transform(F.array_sort(terms), lambda t: F.struct(t["canonical"].alias("canonical"), t["variant"].alias("drift")))
    return F.to_json(
        F.struct(
            F.lit("init").alias("type"),
            F.bround(total_s, 3).alias("total_s"),
            sample_rate.alias("sample_rate"),
            segments.alias("n_segments"),
            F.bround(forced_rate, 4).alias("forced_cut_rate"),
            F.lit(paragraph_s).alias("paragraph_pause_s"),
            F.lit(section_s).alias("section_pause_s"),
            named.alias("drift_terms"),
            F.transform(times, lambda t: F.bround(t, 3)).alias("paragraph_boundary_times"),
        )
    )


def live_init_json(sample_rate: Column, paragraph_s: float = 1.2, section_s: float = 3.0) -> Column:
    """The message that opens a live session, of which neither length nor truth is known."""
    empty = F.array().cast("array<double>")
    told = [F.lit("init").alias("type"), F.lit("live").alias("mode"), sample_rate.alias("sample_rate"), F.lit(None).cast("int").alias("n_segments")]
    limits = [F.lit(paragraph_s).alias("paragraph_pause_s"), F.lit(section_s).alias("section_pause_s")]
    return F.to_json(F.struct(*told, *limits, empty.alias("drift_terms"), empty.alias("paragraph_boundary_times")), {"ignoreNullFields": "false"})
