"""Scores: word error rate, boundary F1, terminology consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normal_words, words_of


#: Distinct tokens of a pair that can be told apart: one code point each, from U+3400 to the surrogates.
LETTERS = 0xD800 - 0x3400


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _place(ordered: Column, token: Column) -> Column:
    """Where a token stands in a sorted array that holds it, by halving."""

    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        right = F.get(ordered, mid) < token
        return F.struct(F.when(right, mid + 1).otherwise(state["lo"]).alias("lo"), F.when(right, state["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(ordered) + 1)).cast("int") + 1)
    start = F.struct(F.lit(0).alias("lo"), (F.size(ordered) - 1).alias("hi"))
    return F.aggregate(steps, start, halve, lambda a: a["lo"])


def _as_letters(tokens: Column, vocabulary: Column) -> Column:
    """Tokens as one character each, so that the built-in character distance counts tokens."""
    letter = lambda t: F.decode(F.unhex(F.hex(_place(vocabulary, t) + 0x3400)), "UTF-16BE")
    return F.array_join(F.transform(tokens, letter), "")


def token_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two arrays of tokens; an error if they have more than LETTERS distinct ones."""
    vocabulary = F.array_sort(F.array_distinct(F.concat(reference, hypothesis)))

    def distance(v: Column) -> Column:
        apart = F.levenshtein(_as_letters(reference, v), _as_letters(hypothesis, v))
        return F.when(F.size(v) <= LETTERS, apart).otherwise(F.raise_error(F.lit(f"more than {LETTERS} distinct tokens in a pair")).cast("int"))

    return _let(vocabulary, distance)


def word_errors(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Add errors, ref_words, wer; an empty reference scores 0 if the hypothesis is empty, too, else 1."""
    wide = df.withColumn("__r", normal_words(F.col(reference))).withColumn("__h", normal_words(F.col(hypothesis)))
    wide = wide.withColumn("errors", token_distance(F.col("__r"), F.col("__h"))).withColumn("ref_words", F.size("__r"))
    rate = F.when(F.col("ref_words") > 0, F.col("errors") / F.col("ref_words")).otherwise(F.when(F.size("__h") > 0, 1.0).otherwise(0.0))
    return wide.withColumn("wer", rate).drop("__r", "__h")


def matches(predicted: Column, truth: Column, tolerance: float) -> Column:
    """One-to-one matches: each predicted value in order takes the first unused true one within the tolerance."""
    start = F.struct(F.lit(0).alias("n"), F.array_sort(truth).alias("left"))

    def step(a: Column, p: Column) -> Column:
        near = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a["left"]), F.lit(1))), lambda i: F.coalesce(F.abs(F.get(a["left"], i - 1) - p) <= tolerance, F.lit(False)))
        first = F.get(near, F.lit(0))
        rest = F.concat(F.slice(a["left"], F.lit(1), first - 1), F.slice(a["left"], first + 1, F.size(a["left"])))
        return F.when(first.isNull(), a).otherwise(F.struct((a["n"] + 1).alias("n"), rest.alias("left")))

    return F.aggregate(F.array_sort(predicted), start, step, lambda a: a["n"])


def boundary_f1(df: DataFrame, predicted: str, truth: str, tolerance: float) -> DataFrame:
    """Add hits, precision, recall, f1; nothing predicted and nothing true is perfect."""
    p, t = F.size(predicted), F.size(truth)
    wide = df.withColumn("hits", matches(F.col(predicted), F.col(truth), tolerance))
    both = (p == 0) & (t == 0)
    share = lambda n: F.when(both, 1.0).when(n > 0, F.col("hits") / n).otherwise(0.0)
    return wide.withColumn("precision", share(p)).withColumn("recall", share(t)).withColumn("f1", F.when(both, 1.0).when(p + t > 0, 2 * F.col("hits") / (p + t)).otherwise(0.0))


def occurrences(texts: DataFrame, terms: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Each use of a canonical term in a session with its rank from 0; every third one, from the third on, drifts."""
    each = texts.select(key, order, F.posexplode(words_of(F.lower(F.col(text)))).alias("pos", "token"))
    used = each.join(terms.select("canonical", "variant"), F.col("token") == F.col("canonical"))
    rank = F.row_number().over(Window.partitionBy(key, "canonical").orderBy(order, "pos")) - 1
    return used.withColumn("rank", rank).withColumn("drifts", F.col("rank") % 3 == 2)


def consistency_rate(texts: DataFrame, terms: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Share of canonical forms among uses of terms in either form; 1 without any."""
    each = texts.select(key, F.explode(normal_words(F.col(text))).alias("token"))
    forms = terms.select(F.col("canonical").alias("token"), F.lit(1).alias("good")).unionByName(terms.select(F.col("variant").alias("token"), F.lit(0).alias("good")))
    hit = each.join(forms, "token").groupBy(key).agg(F.sum("good").alias("canonical"), F.count(F.lit(1)).alias("uses"))
    every = texts.select(key).distinct().join(hit, key, "left").fillna(0, ["canonical", "uses"])
    return every.withColumn("rate", F.when(F.col("uses") > 0, F.col("canonical") / F.col("uses")).otherwise(1.0))
