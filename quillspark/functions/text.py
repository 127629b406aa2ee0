"""Scalar text functions as column expressions."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The common words that are no terms.
COMMON = """
the be to of and a in that have i it for not on with he as you do at this but his
by from they we say her she or an will my one all would there their what so up out if
about who get which go me when make can like time no just him know take people into year
your good some could them see other than then now look only come its over think also back
after use two how our work first well way even new want because any these give day most us
are was were been being has had did does said got get made through toward onto with
into over under between while during before after above below here there where when very
much many more less each every both few such same other another around across along
state states thing things place places part parts kind number numbers
""".split()  # fmt: skip


def common_words() -> Column:
    return F.array(*(F.lit(w) for w in sorted(set(COMMON))))


def core(token: Column) -> Column:
    """Lower-case letters a-z and digits of a token."""
    return F.regexp_replace(F.lower(token), "[^a-z0-9]", "")


def words_of(text: Column) -> Column:
    """Runs of anything but white space; null: none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def normal_words(text: Column) -> Column:
    """Lower-case words without anything but letters, digits and underscores."""
    return words_of(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", ""))


_AFFIXES = r"(?s)^([^\p{L}\p{N}_]*)(.*?)([^\p{L}\p{N}_]*)$"


def affix_parts(token: Column) -> tuple[Column, Column, Column]:
    """What stands before the first and after the last letter or digit, and the word between."""
    return tuple(F.regexp_extract(token, _AFFIXES, i) for i in (1, 2, 3))


def phonetic_key(word: Column) -> Column:
    """Consonant skeleton of a core: like-sounding letters as one, any vowel as a, runs as one letter."""
    letters = F.regexp_replace(word, "[^a-z]", "")
    return F.regexp_replace(F.translate(F.replace(letters, F.lit("x"), F.lit("ks")), "cqzeiou", "kksaaaa"), r"(.)\1+", "$1")


def best_text(revised: Column, verbatim: Column) -> Column:
    """The revised text unless it is null or empty, else the verbatim one, else empty."""
    return F.coalesce(F.nullif(revised, F.lit("")), verbatim, F.lit(""))


def term_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9][A-Za-z0-9'\-]*"), F.lit(0))


def is_term(token: Column, place: Column) -> Column:
    """A capitalised word that doesn't open the text, a long uncommon word, or letters mixed with digits."""
    c = core(token)
    proper = (place > 0) & token.rlike("^[A-Z][A-Za-z0-9]+$")
    rare = c.rlike("^[a-z]{6,}$") & ~F.array_contains(common_words(), c)
    mixed = (F.length(c) >= 3) & c.rlike("[0-9]") & c.rlike("[a-z]")
    return (c != "") & (proper | rare | mixed)


def pcm_seconds(audio: Column, rate: Column | int, channels: Column | int) -> Column:
    """Length of 16-bit samples."""
    return F.octet_length(audio) / (F.lit(rate) * F.lit(channels) * 2)


def wav_seconds(audio: Column, rate: int = 16_000) -> Column:
    """Length of WAV files by their headers, `rate` where a header names none; null: null, no WAV: an error."""

    def seconds(files: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> float | None:
            if data is None:
                return None
            with wave.open(io.BytesIO(data), "rb") as w:
                return w.getnframes() / (w.getframerate() or rate)

        return files.map(one).astype("float64")

    return F.pandas_udf(seconds, "double")(audio)
