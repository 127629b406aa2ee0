"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is a Spark SQL expression; no Python runs on executors.  Patterns start only where a run of
their characters starts and use possessive repeats, and the places of matches are running sums taken in
chunks, so the time stays linear in the text's length and in the number of matches.

A null text counts as empty.  Empty texts and empty tables give no spans.  Repeated rows give repeated
rows.  The operator adds the columns named in its docstring; a column of that name in the input is
replaced, all others are kept, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds, in the order in which spans at the same place are listed.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "secret", "ssn")
KINDS = BASE + EXTRA


@dataclass(frozen=True)
class Kind:
    pattern: str
    #: a cheap test that a text without it holds no match
    guard: str
    prior: float
    #: lower-case words nearby that make the kind likelier
    context: str


RULES = {
    "email": Kind(r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"mail|contact|write"),
    "ip": Kind(r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "", 0.6, r"\bip\b|host|server|address"),
    "card": Kind(r"[0-9](?:[ -]?[0-9])++", "", 0.7, r"card|visa|master|amex|credit|pay"),
    "phone": Kind(r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.7, r"phone|tel|call|mobile|fax"),
    "iban": Kind(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.8, r"iban|account|bank|konto|compte|cuenta"),
    "secret": Kind(r"(?i)(?<![a-z0-9])(?:api[_-]?key|secret|token|password)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[a-z0-9_/+=.-]{16,}+", "=:", 0.6, r"key|secret|token|password|auth"),
    "ssn": Kind(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, r"\bssn\b|social security"),
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    parts = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, doubled(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN passes the mod-97 check: first four characters to the end, letters as 10 to 35."""
    flat = F.regexp_replace(code, " ", "")
    turned = F.split(F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4)), "")
    step = lambda a, c: F.when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).when(c == "", a).otherwise((a * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    """Whether the kind's own check holds for a proposed span."""
    if kind == "ip":
        return hit.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.length(_digits(hit)).between(12, 19) & luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(hit, " ", "")).between(15, 34) & mod97(hit)
    if kind == "ssn":
        return ~hit.rlike("^(?:000|666|9)") & ~hit.rlike("-00-|-0000$")
    return F.lit(True)


def _guard(text: Column, kind: str) -> Column:
    guard = RULES[kind].guard
    tests = [text.contains(c) for c in guard] or [text.rlike("[0-9]")]
    any_of = tests[0]
    for t in tests[1:]:
        any_of = any_of | t
    return any_of


def _proposals(df: DataFrame, text: str, kind: str, pieces: str, hits: str) -> DataFrame:
    """Add the kind's matches and the pieces of text around them (one more than matches)."""
    pattern = RULES[kind].pattern
    none = F.array().cast("array<string>")
    df = df.withColumn(hits, F.when(_guard(F.col(text), kind), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    return df.withColumn(pieces, F.when(F.size(hits) > 0, F.split(F.col(text), pattern, -1)).otherwise(none))


#: Numbers that one accumulator lists; an accumulator is copied with each number that it gets.
CHUNK = 128


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(numbers: Column) -> Column:
    """The sum of all earlier numbers at each place of an array<int>."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))
    inside = lambda x: F.aggregate(x, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["sums"], F.array(a["at"])).alias("sums")))

    def in_chunks(x: Column, level: int) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(x), F.lit(1)) - 1) / CHUNK).cast("int")), lambda i: inside(F.slice(x, i * CHUNK + 1, F.lit(CHUNK))))

        def moved(made: Column) -> Column:
            totals = F.transform(made, lambda m: m["at"])
            before = in_chunks(totals, level - 1) if level else inside(totals)["sums"]
            return F.flatten(F.zip_with(made, before, lambda m, b: F.transform(m["sums"], lambda n: n + b)))

        return _let(chunks, moved)

    return in_chunks(numbers, 1)


def _spans(kind: str, pieces: Column, hits: Column) -> Column:
    """array<struct<start, rank, end, kind, validated, score>> of the kind's accepted spans, in code points."""
    rule = RULES[kind]
    lengths = F.zip_with(pieces, hits, lambda p, h: F.length(p) + F.coalesce(F.length(h), F.lit(0)))
    starts = F.zip_with(running(lengths), pieces, lambda at, p: at + F.length(p))

    def one(start: Column, i: Column, hit: Column) -> Column:
        nearby = F.lower(F.concat(F.substring(pieces[i], -48, 48), F.lit(" "), F.substring(pieces[i + 1], 1, 24)))
        good = _confirmed(kind, hit)
        score = F.lit(rule.prior) + F.when(nearby.rlike(rule.context), 0.3).otherwise(0.0) + F.when(good, 0.0).otherwise(-1.0)
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.length(hit)).alias("end"), F.lit(kind).alias("kind"), good.alias("validated"), F.round(F.least(score, F.lit(1.0)), 3).alias("score"))

    pairs = F.zip_with(starts, hits, lambda s, h: F.struct(s.alias("s"), h.alias("h")))
    made = F.transform(pairs, lambda x, i: F.when(x["h"].isNotNull(), one(x["s"], i, x["h"])))
    return F.filter(made, lambda x: x.isNotNull() & x["validated"] & ((F.lit(kind in BASE)) | (x["score"] >= 0.5)))


def find_spans(df: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """Add `out`: array<struct<start, rank, end, kind, validated, score>>, sorted by start, then kind.

    Matches are leftmost and non-overlapping within a kind; kinds may overlap one another.
    """
    columns = [c for c in df.columns if c != out]
    row, hidden = "__row", "__pii_text"
    kept = F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(0))
    df = df.select(kept.alias(row), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(hidden))
    for kind in KINDS:
        df = _proposals(df, hidden, kind, f"__{kind}_p", f"__{kind}_h")
    found = [F.when(F.size(f"__{k}_h") > 0, _spans(k, F.col(f"__{k}_p"), F.col(f"__{k}_h"))) for k in KINDS]
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,validated:boolean,score:double>>")
    spans = F.array_sort(F.concat(*(F.coalesce(x, empty) for x in found)))
    return df.select(*(F.col(row).getField(c).alias(c) for c in columns), spans.alias(out))


def _replaced(kind: str, pieces: Column, hits: Column) -> Column:
    """The kind's matches, the accepted ones as <KIND>."""

    def one(hit: Column, i: Column) -> Column:
        good = _confirmed(kind, hit)
        if kind == "ssn":  # only its context can tell it from other numbers
            nearby = F.lower(F.concat(F.substring(pieces[i], -48, 48), F.lit(" "), F.substring(pieces[i + 1], 1, 24)))
            good = good & nearby.rlike(RULES[kind].context)
        return F.when(good, F.lit(f"<{kind.upper()}>")).otherwise(hit)

    return F.transform(hits, one)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace accepted spans by <KIND>, one kind after another; same columns, a null text stays null."""
    columns = df.columns
    row, hidden = "__row", "__pii_text"
    df = df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias(row), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(hidden))
    for kind in ("email", "secret", "phone", "iban", "card", "ip", "ssn"):
        df = _proposals(df, hidden, kind, "__p", "__h")
        pieces, hits = F.col("__p"), F.col("__h")
        keep = _replaced(kind, pieces, hits)
        joined = F.array_join(F.flatten(F.zip_with(pieces, keep, lambda p, h: F.array(p, F.coalesce(h, F.lit(""))))), "")
        df = df.withColumn(hidden, F.when(F.size("__h") > 0, joined).otherwise(F.col(hidden))).drop("__p", "__h")
    old = lambda c: F.col(row).getField(c)
    return df.select(*(F.when(old(c).isNotNull(), F.col(hidden)).alias(c) if c == text else old(c).alias(c) for c in columns))


def digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the named kinds' spans, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
