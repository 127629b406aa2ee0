"""A running register of terms: counts by observation, display forms, budgeted top terms, carryover."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import core, is_term, term_tokens

# The budget, and the sentence that opens a prompt.
MAX_TERMS, MAX_CHARS, TAIL_CHARS = 100, 8000, 200
SITUATION = "Technical dictation; keep terminology consistent."


def terms(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, core, term, pos): the distinct terms of each row, in the form that was first taken for one."""
    each = texts.select(*keys, F.posexplode(term_tokens(F.col(text))).alias("pos", "token"))
    taken = each.where(is_term(F.col("token"), F.col("pos"))).withColumn("core", core(F.col("token")))
    return taken.groupBy(*keys, "core").agg(F.min_by("token", "pos").alias("term"), F.min("pos").alias("pos"))


def registry(found: DataFrame, key: str, order: str) -> DataFrame:
    """(key, core, n, display): in how many rows of a session a term was seen, and its first capitalised form, else its first."""
    upper = F.col("term").rlike("^[A-Z]")
    first = F.min_by("term", F.col(order))
    first_upper = F.min_by(F.when(upper, F.col("term")), F.when(upper, F.col(order)))
    return found.groupBy(key, "core").agg(F.count(F.lit(1)).alias("n"), F.coalesce(first_upper, first).alias("display"))


def budgeted(ranked: Column, max_terms: int = MAX_TERMS, max_chars: int = MAX_CHARS) -> Column:
    """Displays from an array in rank order: a term too long for what is left is passed over, later ones may fit."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, term: Column) -> Column:
        fits = (a["n"] < max_terms) & (a["chars"] + F.length(term) <= max_chars)
        taken = F.struct((a["n"] + 1).alias("n"), (a["chars"] + F.length(term)).alias("chars"), F.concat(a["out"], F.array(term)).alias("out"))
        return F.when(fits, taken).otherwise(a)

    return F.aggregate(ranked, start, step, lambda a: a["out"])


def keyterms(registered: DataFrame, key: str, max_terms: int = MAX_TERMS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Each session's terms within the budget: more often seen first, then longer, then by core."""
    rank = F.struct((-F.col("n")).alias("a"), (-F.length("core")).alias("b"), F.col("core").alias("c"), F.col("display").alias("d"))
    ranked = F.transform(F.sort_array(F.collect_list(rank)), lambda x: x["d"])
    return registered.groupBy(key).agg(budgeted(ranked, max_terms, max_chars).alias("keyterms"))


def carryover(found: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """For each row the distinct terms of all earlier rows of its session, and how often they were seen.

    Sums over a window that ends before the row: a term counts as new in the row that first shows it.
    """
    new = found.groupBy(key, "core").agg(F.min(order).alias(order)).groupBy(key, order).agg(F.count(F.lit(1)).alias("new_terms"))
    seen = found.groupBy(key, order).agg(F.count(F.lit(1)).alias("seen"))
    wide = rows.select(key, order).join(new, [key, order], "left").join(seen, [key, order], "left").fillna(0, ["new_terms", "seen"])
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"prior_{c}")
    return wide.select(key, order, total("new_terms"), total("seen"))


def carried(found: DataFrame, rows: DataFrame, key: str, order: str, max_terms: int = MAX_TERMS, max_chars: int = MAX_CHARS) -> DataFrame:
    """For each row the register's budgeted terms of all rows before it, best first: what the next segment is pinned to.

    A fold over rows that Spark sorts; its state is one session's register.
    """
    each = found.groupBy(key, order).agg(F.sort_array(F.collect_list(F.struct("core", "term"))).alias("__found"))
    wide = rows.select(key, order).where(F.col(key).isNotNull() & F.col(order).isNotNull()).join(each, [key, order], "left")
    schema = rows.select(key, order).schema.add("carried", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, register = None, {}
        for batch in batches:
            out = []
            for k, terms_ in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != now:
                    now, register = k, {}
                left, taken = max_chars, []
                for _, _, _, display in sorted((-n, -len(c), c, display) for c, (n, display) in register.items()):
                    if len(taken) == max_terms:
                        break
                    if len(display) <= left:
                        taken.append(display)
                        left -= len(display)
                out.append(taken)
                for t in terms_ or []:
                    n, display = register.get(t["core"], (0, t["term"]))
                    upper = "A" <= t["term"][:1] <= "Z" and not "A" <= display[:1] <= "Z"
                    register[t["core"]] = (n + 1, t["term"] if upper else display)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], names=[key, order, "carried"])

    return wide.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def context_tail(rows: DataFrame, key: str, order: str, text: str = "text", chars: int = TAIL_CHARS) -> DataFrame:
    """For each row the last characters of the session's text before it.

    Only the last `chars` texts with anything in them can matter: these are numbered, and the window's frame
    is bounded by their numbers, so blank rows take no room in it.
    """
    clean = rows.withColumn("__t", F.nullif(F.right(F.rtrim(F.trim(F.col(text))), F.lit(chars)), F.lit("")))
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    clean = clean.withColumn("__n", F.count("__t").over(so_far))  # texts before this row
    before = Window.partitionBy(key).orderBy("__n").rangeBetween(-chars, -1)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("__t").isNotNull(), F.struct("__n", "__t"))).over(before)), lambda x: x["__t"]), " ")
    return clean.select(key, order, F.right(joined, F.lit(chars)).alias("tail"))


def prompt(tail: Column, situation: str = SITUATION) -> Column:
    return F.trim(F.concat(F.lit(situation + " Recent context: "), tail))
