"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import imatch, licenses, mixing, neardup, packing, pii, ppm, quality, topk, toxicity
from .shared import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.digest(F.col("pii_spans"), pii.BASE), 256).alias("base_sha256"), pii.digest(F.col("pii_spans"), pii.KINDS).alias("spans"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_edited(read(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), limit=2048)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), parts=3, held_out=1)


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(read(spark, sf_dir, "documents"), k=2, percent=80)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), parts=5, held_out=0)


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read(spark, sf_dir, "documents"), parts=10, held_out=0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_topk, op3_imatch, op4_licenses, op5_packing, op6_quality, op7_neardup, op8_toxicity, op9_ppm, op10_mixing)}

_TOPK_SQL = """WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.vec) + 1), lambda i: q.vec[i] * c.vec[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.vec) = len(c.vec))
  SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w),
  e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY ALL),
  l AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * c >= 80 * (nx + ny - c)),
  t AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
  reach AS (SELECT DISTINCT x AS a, x AS b FROM t UNION SELECT r.a, t.y FROM reach r JOIN t ON t.x = r.b),
  m AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
  SELECT doc_id, len(g) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM s LEFT JOIN m ON m.a = s.doc_id"""

_TEMPLATES_SQL = ", ".join(f"({n}, '{label}', '{phrase}', {str(base).lower()})" for n, (label, phrase, base) in enumerate([(label, p, True) for p, label in licenses.BASE.items()] + [(label, p, False) for label, p in licenses.TEMPLATES]))
_LICENSES_SQL = rf"""WITH tw AS (SELECT template, label, base, CASE WHEN base THEN 2 ELSE {licenses.K} END AS k, string_split(phrase, ' ') AS w FROM (VALUES {_TEMPLATES_SQL}) AS v(template, label, phrase, base)),
  tg AS (SELECT template, label, base, k, len(w) - k + 1 AS grams, i AS tpos, array_to_string(w[i + 1:i + k], ' ') AS gram FROM (SELECT *, unnest(range(len(w) - k + 1)) AS i FROM tw)),
  d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  dg AS (SELECT doc_id, k, i AS pos, array_to_string(w[i + 1:i + k], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, (VALUES (2), ({licenses.K})) AS kk(k))),
  votes AS (SELECT doc_id, template, label, base, k, grams, pos - tpos AS diagonal, list(DISTINCT tpos) AS tposes, min(pos) AS low, max(pos) AS high FROM dg JOIN tg USING (k, gram) GROUP BY ALL),
  b AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(DISTINCT label) AS labels FROM votes WHERE base AND len(tposes) = grams GROUP BY doc_id),
  j AS (SELECT *, sum(jump) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {licenses.SLACK} THEN 0 ELSE 1 END AS jump FROM votes WHERE NOT base)),
  sp AS (SELECT doc_id, template, label, grams, span, len(list_distinct(flatten(list(tposes)))) / grams AS cover, min(low) AS low, max(high) AS high FROM j GROUP BY doc_id, template, label, grams, span),
  m AS (SELECT doc_id, list(DISTINCT label) AS labels, max(cover) AS cover FROM sp WHERE cover >= {licenses.COVER} AND high - low <= 2 * (grams + {licenses.K}) GROUP BY doc_id)
  SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(cover, 0.0) END::DOUBLE AS score
  FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)"""

#: The others need hashes, compression, tokenizers or models that SQL doesn't have; tests hold them against brute force.
ORACLES: dict[str, str] = {"op2_topk": _TOPK_SQL, "op4_licenses": _LICENSES_SQL, "op7_neardup": _NEAR_SQL}
