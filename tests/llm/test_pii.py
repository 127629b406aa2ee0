import hashlib
import re

from hypothesis import given
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    spans = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if good:
                spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(spans))


FIXED = [
    None,
    "",
    "a@b.c%d@e.f x@y a@b.comx_y@c.de",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111",
    "+1 (555) 555-0100 +49 30 1234567890 +1",
    "é😀 4111111111111111 😀 mail é@b.de ü@x.de a@b.de",
    "a" * 200_000 + "@b.c",
    "a.b@c.d " * 400,
    "IBAN DE89 3704 0044 0532 0130 00, DE89 3704 0044 0532 0130 01",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ssn 123-45-6789 and 123-45-6789',
]


def digests(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = pii.find_spans(df)
    return [tuple(r)[1:] for r in found.select("doc_id", pii.digest(F.col("pii_spans"), pii.BASE), pii.digest(F.col("pii_spans"), pii.KINDS)).orderBy("doc_id").collect()]


def test_base_spans_match_plain_patterns(spark):
    got = digests(spark, FIXED)
    assert [g[0] for g in got] == [brute(t) for t in FIXED]
    assert "iban:5:32" in got[9][1] and "iban:34" not in got[9][1]
    assert "secret:0:49" in got[10][1] and "ssn:55:66" in got[10][1]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.@+-() aé%_4", max_size=80), min_size=40, max_size=60))
def test_base_spans_of_random_texts(spark, texts):
    assert [g[0] for g in digests(spark, texts)] == [brute(t) for t in texts]


def test_redaction_leaves_nothing_and_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "mail a@b.de, card 4111111111111111, not 4111111111111112", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, __p string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got == {1: "mail <EMAIL>, card <CARD>, not 4111111111111112", 2: None, 3: ""}
    assert pii.redact(df).columns == df.columns


def test_empty_table_and_digest(spark):
    df = spark.createDataFrame([], "doc_id long, text string, pii_spans int")
    assert pii.find_spans(df).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
