"""Language-model scores by prediction by partial matching over bytes, beside a unigram baseline over words.

Byte n-grams up to ORDER bytes of context are counted over all training texts (summed in each task before
the shuffle) and form a trie of contexts.  A byte is predicted from its longest known context; if that
hasn't seen the byte, the model escapes to the next shorter one (method C: as likely as the number of
distinct bytes seen there), leaving out the bytes that the longer context would have predicted.  With the
contexts nested, each escape's weights depend on one context and are tabled beforehand, so whole
batches are scored by lookups.

A byte's probability depends on its n-gram of ORDER + 1 symbols alone.  The table sent to tasks has those
n-grams that make up at least SHARE of all: 1 / SHARE at most, whatever the corpus; all others, seen in
training or not, meet their probabilities in a join, so every counted n-gram is in the model.  Likewise the
word counts sent to tasks are those of words that make up at least HEAD of all tokens; all rarer words meet
their counts in a join.  Trie is the same model in one process, for counts that fit there.

A null text counts as empty: its one token is the end.  A null id counts as training text.  Repeated rows
are counted and scored as often as they come.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold
from .shared import materialize, ship
from .text import LOWER, SPACE, U64, Lookup, Tally, distinct_per_text, hash_of, hashes, signed, slices, tokens

ORDER = 5
SHARE = 5e-7
HEAD = 2.5e-7
#: A symbol is a byte + 1; 0 stands before a text and after it.
WIDTH = 9
SYMBOLS = 257
#: The end token's key: that of a word that no text can hold.
END = hash_of("\n")


def mask(n: int) -> int:
    return (1 << (WIDTH * n)) - 1


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ORDER + 1 symbols that end at each byte and at each text's end, and where each text's begin."""
    n, size = len(offsets) - 1, np.diff(offsets)
    begin = offsets + np.arange(n + 1)  # one more symbol for each text's end
    padded = np.zeros(len(data) + n * (1 + ORDER) + ORDER, dtype=np.uint64)
    at = np.arange(len(data)) + np.repeat(np.arange(n) * (1 + ORDER), size) + ORDER
    padded[at] = LOWER[data].astype(np.uint64) + U64(1)
    code = np.zeros(len(padded) - ORDER, dtype=np.uint64)
    for i in range(ORDER + 1):
        code <<= U64(WIDTH)
        code |= padded[i : i + len(code)]
    real = np.repeat(np.arange(n) * ORDER, size + 1) + np.arange(begin[-1])
    return code[real], begin


def counts(training: DataFrame) -> DataFrame:
    """kind (0: word, 1: n-gram), key, c over the texts; words by hash, the end token among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = Tally(), Tally(600_000)
        made = lambda kind, part: pa.record_batch([pa.array(np.full(len(part[0]), kind, dtype=np.int32)), pa.array(signed(part[0])), pa.array(part[1], pa.int64())], names=["kind", "key", "n"])
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                low = LOWER[data]
                starts, ends, _ = tokens(low, offsets, SPACE)
                words = np.append(hashes(low, starts, ends), np.full(len(offsets) - 1, END, dtype=np.uint64))
                for kind, keys in ((0, words), (1, grams(data, offsets)[0])):
                    for part in tallies[kind].add(keys):
                        yield made(kind, part)
        for kind in (0, 1):
            for part in tallies[kind].rest():
                yield made(kind, part)

    return training.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("c"))


class Trie:
    """Tables of the model: per order, n-grams with their counts and contexts with their escapes."""

    def __init__(self, levels: list[tuple[np.ndarray, ...]]) -> None:
        """levels: for each context length from 0 to ORDER the kept n-gram codes and counts, and the codes,
        totals and distinct symbols of all contexts that have one; these two count n-grams that aren't kept, too."""
        self.codes, self.contexts, self.owner = [], [], []
        self.log_count = []
        self.escape, self.plain = [], []  # of a context by itself: log10 of the escape, of the sum it divides by
        self.less_escape, self.less_sum = [], []  # of a context's next shorter one, without the context's own bytes
        old = None
        for order, (codes, n, contexts, total, kinds) in enumerate(levels):
            at, at2 = np.argsort(codes), np.argsort(contexts)
            codes, n = codes[at], n[at].astype(np.float64)
            contexts, total, kinds = contexts[at2], total[at2].astype(np.float64), kinds[at2].astype(np.float64)
            of = np.searchsorted(contexts, codes >> U64(WIDTH))
            kept = np.bincount(of, weights=n, minlength=len(contexts))
            # What isn't kept is left to shorter contexts, so it adds to the escape.
            away = kinds + total - kept
            self.codes.append(codes)
            self.contexts.append(contexts)
            self.owner.append(of)
            self.log_count.append(np.log10(n))
            self.plain.append(np.log10(total + kinds))
            self.escape.append(np.log10(away / (total + kinds)))
            if old is None:
                self.less_escape.append(np.zeros(0))
                self.less_sum.append(np.zeros(0))
            else:
                codes0, n0, contexts0, kept0, away0 = old
                shorter = np.searchsorted(codes0, codes & U64(mask(order)))
                gone = np.bincount(of, weights=n0[shorter], minlength=len(contexts))
                up = np.searchsorted(contexts0, contexts & U64(mask(order - 1)))
                rest, rest_away = kept0[up] - gone, away0[up] - np.bincount(of, minlength=len(contexts))
                both = np.maximum(rest + rest_away, 1e-300)
                self.less_sum.append(np.log10(both))
                self.less_escape.append(np.where(rest_away > 0, np.log10(np.maximum(rest_away, 1e-300) / both), 0.0))
            old = codes, n, contexts, kept, away
        self.free = float(-np.log10(max(1, SYMBOLS - len(self.codes[0]))))

    def ready(self) -> "Trie":
        self.gram_at = [Lookup(c) for c in self.codes]
        self.context_at = [Lookup(c) for c in self.contexts]
        return self

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each code."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        longer = np.full(len(codes), -1)  # the longer context from which a position escaped
        for order in range(ORDER, -1, -1):
            here = codes if order == ORDER else codes[left] & U64(mask(order + 1))
            gram = self.gram_at[order].get(here)
            hit = gram >= 0
            if order == ORDER:
                context = np.full(len(here), -1)
                miss = np.flatnonzero(~hit)
                context[miss] = self.context_at[order].get(here[miss] >> U64(WIDTH))
                context[hit] = self.owner[order][gram[hit]]
                out[hit] = self.log_count[order][gram[hit]] - self.plain[order][context[hit]]
            else:
                context = self.context_at[order].get(here >> U64(WIDTH))
                barred = longer >= 0
                found = np.flatnonzero(hit)
                divisor = np.where(barred[found], self.less_sum[order + 1][longer[found]] if len(self.less_sum[order + 1]) else 0.0, self.plain[order][context[found]])
                out[left[found]] += self.log_count[order][gram[found]] - divisor
            lost = np.flatnonzero(~hit)
            known = context[lost] >= 0
            if order == ORDER:
                out[lost[known]] += self.escape[order][context[lost[known]]]
            else:
                bar = longer[lost] >= 0
                a, b = lost[bar], lost[~bar & known]
                if len(a):
                    out[left[a]] += self.less_escape[order + 1][longer[a]]
                out[left[b]] += self.escape[order][context[b]]
            left = lost if order == ORDER else left[lost]
            longer = context[lost]
        out[left] += self.free
        return out


def seen(by_gram: DataFrame) -> DataFrame:
    """code, c, p of all n-grams of the longest order: count and log10 probability."""
    # A context has at most SYMBOLS n-grams.
    around = by_gram.groupBy(F.shiftright("key", WIDTH)).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"), F.collect_list(F.struct(F.col("key").alias("code"), "c")).alias("own"))
    return around.select("total", "kinds", F.inline("own")).select("code", "c", (F.log10("c") - F.log10(F.col("total") + F.col("kinds"))).alias("p"))


def escaped(asked: DataFrame, by_gram: DataFrame) -> DataFrame:
    """code, p: log10 probability of the last symbol of n-grams that training hasn't seen, by their shorter contexts."""
    every_order = lambda code: F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.col(code).bitwiseAND(F.lit(mask(j + 1))).alias("code")) for j in range(ORDER + 1)))).alias("x")
    every = materialize(by_gram.select(every_order("key"), "c").groupBy("x.j", "x.code").agg(F.sum("c").alias("c")))
    # gone: what the next shorter context has counted of the symbols that this one has, and so excludes.
    shorter = every.select((F.col("j") + 1).alias("j"), F.col("code").alias("suffix"), F.col("c").alias("less"))
    nested = every.withColumn("suffix", F.expr(f"code & (shiftleft(1L, {WIDTH} * j) - 1)")).join(shorter, ["j", "suffix"], "left")
    contexts = nested.groupBy("j", F.shiftright("code", WIDTH).alias("context")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum("less"), F.lit(0)).alias("gone"))
    steps = asked.select(F.col("code").alias("whole"), every_order("code")).select("whole", "x.j", "x.code", F.shiftright("x.code", WIDTH).alias("context"))
    found = steps.join(every, ["j", "code"], "left").join(contexts, ["j", "context"], "left")
    wide = found.groupBy("whole").agg(*(F.max(F.when(F.col("j") == j, F.col(name))).alias(f"{name}{j}") for j in range(ORDER + 1) for name in ("c", "total", "kinds", "gone")))
    p = -F.log10(F.greatest(F.lit(1), SYMBOLS - F.coalesce("kinds0", F.lit(0))))
    for j in range(ORDER + 1):
        longer = lambda name, j=j: F.coalesce(f"{name}{j + 1}", F.lit(0)) if j < ORDER else F.lit(0)
        kinds = F.col(f"kinds{j}") - longer("kinds")
        divisor = F.log10(F.col(f"total{j}") - longer("gone") + kinds)
        p = F.when(F.col(f"c{j}").isNotNull(), F.log10(f"c{j}") - divisor).otherwise(F.when(kinds > 0, F.log10(kinds) - divisor).otherwise(0.0) + p)
    return wide.select(F.col("whole").alias("code"), p.alias("p"))


def score(docs: DataFrame, parts: int = 10, held_out: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; see the module's docstring.

    base_score: log10 probability under the unigram words of the texts outside the held-out fold;
    score: that of the text's lower-cased bytes and its end under the byte model.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = F.coalesce(fold(F.col("doc_id"), parts) == held_out, F.lit(False))
    counted = materialize(counts(docs.where(~out).select("text")))
    by_word = counted.where("kind = 0")
    sums = by_word.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = sums["n"] or 0, sums["v"]
    head = by_word.where(F.col("c") >= HEAD * n).select("key", "c").toArrow()
    order = np.argsort(head["key"].to_numpy().view(np.uint64))
    keys, often = head["key"].to_numpy().view(np.uint64)[order], head["c"].to_numpy()[order]
    by_gram = counted.where("kind = 1")
    model = materialize(seen(by_gram))
    frequent = model.where(F.col("c") >= SHARE * (by_gram.agg(F.sum("c")).first()[0] or 0)).select("code", "p").toArrow()
    held = spark.sparkContext.broadcast((keys, often, frequent["code"].to_numpy().view(np.uint64), frequent["p"].to_numpy()))

    def listed(name: str, values: np.ndarray, owner: np.ndarray, tf: np.ndarray, many: int) -> pa.ListArray:
        items = pa.StructArray.from_arrays([pa.array(signed(values)), pa.array(tf, pa.int64())], [name, "tf"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(many + 1)).astype(np.int32)), items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, c, codes, p = held.value
        place, gram_at = Lookup(words_), Lookup(codes)
        p = np.append(p, 0.0)  # the last is for n-grams that aren't in the table: place -1
        logs = np.log10(c + 0.1)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                low = LOWER[data]
                starts, ends, first = tokens(low, offsets, SPACE)
                words = hashes(low, starts, ends)
                got = place.get(words)
                owner, many = np.repeat(np.arange(b - a), np.diff(first)), b - a
                known = got >= 0
                base = np.bincount(owner[known], weights=logs[got[known]], minlength=many)
                n_known = np.bincount(owner[known], minlength=many)
                rare = np.flatnonzero(~known)
                tail, tail_owner, tf = distinct_per_text(words[rare], np.searchsorted(owner[rare], np.arange(many + 1)))
                code, begin = grams(data, offsets)
                at = gram_at.get(code)
                total = np.add.reduceat(p[at], begin[:-1])
                miss = np.flatnonzero(at < 0)
                grams_, grams_owner, grams_tf = distinct_per_text(code[miss], np.searchsorted(miss, begin))
                lists = listed("key", tail, tail_owner, tf, many), listed("code", grams_, grams_owner, grams_tf, many)
                yield pa.record_batch([batch.column(0).slice(a, many), batch.column(2).slice(a, many), pa.array(np.diff(first) + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(total), *lists], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "grams"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<key:long,tf:long>>, grams array<struct<code:long,tf:long>>"
    rows = materialize(docs.withColumn("held_out", out).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    # The end token is no rare word, but a small corpus may hold no training text at all.
    end = int(by_word.where(F.col("key") == F.lit(END - (1 << 64) if END >> 63 else END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    rare = rows.select("row", F.inline("tail")).join(by_word.select("key", "c"), "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = rare.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 0.1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf"))).alias("more_known"))
    # Only texts outside the training can hold n-grams that it hasn't seen.
    new = rows.where("held_out").select(F.inline("grams")).select("code").distinct().join(model, "code", "left_anti")
    scores = model.select("code", "p").unionAll(escaped(new, by_gram))
    more_score = rows.select("row", F.inline("grams")).join(scores, "code").groupBy("row").agg(F.sum(F.col("tf") * F.col("p")).alias("more_score"))
    whole = rows.drop("tail", "grams").join(more, "row", "left").join(more_score, "row", "left")
    divisor = float(np.log10(n + 0.1 * (v + 1)))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + float(np.log10(end + 0.1)) - F.col("n_tokens") * divisor
    known = F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(end > 0)
    return whole.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
