"""Toxicity behind disguises: a noisy channel restores words before a learned lexicon scores them.

A word written with figures and signs for letters, with letters repeated or spaced out is a lattice: every
character may stand for itself, for a letter that it imitates, for a second copy of the letter before, or
for nothing; a gap between letters may stand for nothing or end a word; each at a price.  Viterbi decoding
under a character model of the training words picks the restored words.  All tokens go in but those of
letters without a doubled one, whose lattice has a single path, and all runs of characters that stand alone,
however long and however wide their gaps.  In words of letters only, each run of a letter is settled by the
letters beside it, to the same result.

The lexicon has the words whose presence in the restored text speaks for the label (signed likelihood
ratio); all labelled texts outside the held-out fold count, near copies once; a logistic curve over the strongest of a text's hits and the sum of the others is the score.  A null
text counts as empty; empty texts score the curve's constant.  Repeated rows get equal scores; an empty
table gives no rows.  Without labels of both kinds every score is 0.  Ids with contradictory labels aren't
learned from.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import fold, logistic, share_of_ones, usable
from .shared import discard, free, materialize, ship

# Signs and the letters they imitate.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Prices, as natural logarithms of the channel's probabilities.
SWAP, REPEAT, DROP, KEEP_SIGN, GAP = 0.7, 0.4, 4.0, 6.0, 0.8
_BASIC = "".join(chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000)
#: The basic plane's characters of a property, as a set of `re` has them.
_RANGES = {p: "".join(f"{m[0]}-{m[-1]}" for m in regex.findall(rf"{p}+", _BASIC)) for p in (r"\p{L}", r"\p{N}")}


class Pattern:
    r"""A pattern with \p{L} and \p{N} only inside sets; texts of the basic plane are searched by `re`, which is faster, for the same characters."""

    def __init__(self, source: str) -> None:
        self.any = regex.compile(source)
        for name, ranges in _RANGES.items():
            source = source.replace(name, ranges)
        self.basic = re.compile(source)

    def _for(self, text: str) -> re.Pattern | regex.Pattern:
        return self.basic if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else self.any

    def findall(self, text: str) -> list[str]:
        return self._for(text).findall(text)

    def match(self, text: str) -> re.Match | regex.Match | None:
        return self._for(text).match(text)

    def search(self, text: str) -> re.Match | regex.Match | None:
        return self._for(text).search(text)


_SIGNS = regex.escape("".join(IMITATES))
WORD = Pattern(rf"[\p{{L}}\p{{N}}{_SIGNS}]+(?:[-._*~'’]+[\p{{L}}\p{{N}}{_SIGNS}]+)*")
#: Three or more characters that stand alone, with anything but letters, figures and signs between them.
SPACED = Pattern(r"(?<![\p{L}\p{N}])[\p{L}\p{N}@$!|](?:[^\p{L}\p{N}@$!|]++[\p{L}\p{N}@$!|](?![\p{L}\p{N}])){2,}+")
ALONE = Pattern(r"[\p{L}\p{N}@$!|]")
LETTERS = Pattern(r"[\p{L}]+")
#: A token whose lattice has more than one path.
DISGUISED = Pattern(r"[^\p{L}]|([\p{L}])\1")
#: What makes more of a token than its plain words: a figure, a sign, or a gap before a further character.
ODD = Pattern(rf"[\p{{N}}{_SIGNS}]|[-._*~'’](?=[\p{{L}}\p{{N}}{_SIGNS}])")
#: Characters that end no gap and stand for nothing at a token's ends.
ENDS = ".,;:?"
#: A character twice or more.
RUN = re.compile(r"(.)\1+", re.DOTALL)
#: Share of the character model's words that the lexicon's words get, so that disguises of them are seen through.
SUSPECT = 0.02
CACHE = 200_000


def trigrams(words: Counter[str]) -> Counter[str]:
    """Letter trigrams of words between spaces; each word has one that ends with a space."""
    three: Counter[str] = Counter()
    for w, n in words.items():
        s = f"  {w} "
        for i in range(2, len(s)):
            three[s[i - 2 : i + 1]] += n
    return three


class CharacterModel:
    """Letter trigrams with interpolated lower orders; a word starts and ends with a space."""

    def __init__(self, words: Counter[str], counted: dict[str, int] | None = None) -> None:
        """counted: trigrams of further words, as `trigrams` gives them."""
        three = trigrams(words)
        three.update(counted or {})
        two: Counter[str] = Counter()
        one: Counter[str] = Counter()
        for g, n in three.items():
            two[g[1:]] += n
            one[g[2]] += n
        total = sum(one.values()) + 1
        of_two: Counter[str] = Counter()
        of_one: Counter[str] = Counter()
        for g, n in three.items():
            of_two[g[:2]] += n
        for g, n in two.items():
            of_one[g[0]] += n
        self.tables = {"three": dict(three), "two": dict(two), "one": dict(one), "of_two": dict(of_two), "of_one": dict(of_one), "total": total}
        self.memo: dict[str, float] = {}
        self.kept: dict[tuple[str, str, str], str] = {}

    def cost(self, gram: str) -> float:
        got = self.memo.get(gram)
        if got is None:
            t = self.tables
            p = 0.1 * t["one"].get(gram[2], 0.1) / t["total"] + 1e-7
            p += 0.3 * t["two"].get(gram[1:], 0) / max(1, t["of_one"].get(gram[1], 0))
            p += 0.6 * t["three"].get(gram, 0) / max(1, t["of_two"].get(gram[:2], 0))
            got = self.memo[gram] = -math.log(p)
        return got


def restore_plain(word: str, model: CharacterModel) -> str:
    """`restore` of a word of letters only.

    All ways meet behind each run of a letter: how much of it stays depends on the letters beside it alone.
    """

    def stays(m: re.Match) -> str:
        run, (at, end) = m[0], m.span()
        key = (word[at - 1] if at else " ", run, word[end] if end < len(word) else " ")
        got = model.kept.get(key)
        if got is None:
            before, letter, after, n = key[0], run[0], key[2], len(run)
            best, many = REPEAT * (n - 1) + model.cost(before + letter + after), 1
            for k in (2, n):
                price = model.cost(before + letter * 2) + (k - 2) * model.cost(letter * 3) + (n - k) * REPEAT + model.cost(letter * 2 + after)
                if price < best:
                    best, many = price, k
            got = letter * many
            if len(model.kept) < CACHE and n < 64:
                model.kept[key] = got
        return got

    return RUN.sub(stays, word)


def restore(written: str, model: CharacterModel) -> str:
    """The likeliest words behind written characters, parted by spaces; in time linear in their number."""
    # By the last two letters: the price and the letters so far, as a chain (letters before, letter).
    best: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    in_gap, memo = False, model.memo
    # There is one best way up to the first of the last like letters that it begins with.
    head = 0
    while head < len(written) and written[head].isalpha():
        head += 1
    if head:
        head = len(written[:head].rstrip(written[head - 1])) + 1
        letters = restore_plain(written[:head], model)
        best = {f"  {letters}"[-2:]: (0.0, ((None, letters[:-1]), letters[-1]))}
    for c in written[head:]:
        sign = IMITATES.get(c)
        if sign is None and not c.isalnum():
            if not in_gap:
                ended = [(price + model.cost(state + " "), chain) for state, (price, chain) in best.items() if state != "  "]
                after = {state: (price + GAP, chain) for state, (price, chain) in best.items() if state != "  "}
                if ended:
                    price, chain = min(ended, key=lambda x: x[0])
                    after["  "] = (price, (chain, " "))
                if "  " in best and ("  " not in after or best["  "][0] < after["  "][0]):
                    after["  "] = best["  "]
                best, in_gap = after, True
            continue
        in_gap = False
        choices = [(c, 0.0)] if c.isalpha() else [(x, SWAP) for x in sign or ""] + ([(c, KEEP_SIGN)] if c.isalnum() else [])
        after = {}
        for state, (price, chain) in best.items():
            for letter, extra in choices:
                new, known = state[1] + letter, memo.get(state + letter)
                cost = price + extra + (model.cost(state + letter) if known is None else known)
                if new not in after or cost < after[new][0]:
                    after[new] = (cost, (chain, letter))
                if chain and chain[1] == letter:  # one more copy of the letter before
                    cost = price + extra + REPEAT
                    if state not in after or cost < after[state][0]:
                        after[state] = (cost, chain)
            if sign is not None and (state not in after or price + DROP < after[state][0]):
                after[state] = (price + DROP, chain)
        best = after
    chain = min(((price + (model.cost(state + " ") if state != "  " else 0.0), state) for state, (price, _) in best.items()))[1]
    chain, letters = best[chain][1], []
    while chain:
        letters.append(chain[1])
        chain = chain[0]
    return "".join(reversed(letters)).strip()


def spaced(low: str) -> set[str]:
    """The text's runs of characters that stand alone, each gap one space."""
    return {" ".join(ALONE.findall(m)) for m in SPACED.findall(low)}


def token_words(low: str, restored: Callable[[str], str]) -> set[str]:
    """Distinct words of a lower-case text, disguised ones also restored, but not those spaced out over it."""
    found = set(LETTERS.findall(low))
    if not ODD.search(low):
        for w in [w for w in found if RUN.search(w)]:
            found.update(restored(w).split())
        return found
    for w in {w for w in WORD.findall(low) if DISGUISED.search(w)}:
        found.update(restored(w).split())
    return found


def words_of(text: str, restored: Callable[[str], str]) -> set[str]:
    """Distinct words of a text, disguised ones also restored."""
    low = text.lower()
    found = token_words(low, restored)
    for run in spaced(low):
        found.update(restored(run).split())
    return found


class Restorer(dict):
    def __init__(self, model: CharacterModel) -> None:
        self.model = model

    def __call__(self, word: str) -> str:
        return self[word]

    def __missing__(self, word: str) -> str:
        if word.isalpha():  # quicker than to remember
            return restore_plain(word, self.model)
        made = restore(word, self.model)
        if len(self) < CACHE and len(word) < 64:
            self[word] = made
        return made


class Reader(dict):
    """`words_of` with one model; the words of a white-space-delimited token are worked out once."""

    def __init__(self, characters: CharacterModel) -> None:
        self.restorer = Restorer(characters)

    def __missing__(self, token: str) -> tuple[str, ...]:
        word = token.strip(ENDS)
        made = ((word, self.restorer(word)) if RUN.search(word) else (word,)) if word.isalpha() else tuple(token_words(token, self.restorer))
        if len(self) < CACHE and len(token) < 64:
            self[token] = made
        return made

    def __call__(self, text: str) -> set[str]:
        low = text.lower()
        found = set(itertools.chain.from_iterable(map(self.__getitem__, set(low.split()))))
        for run in spaced(low):
            found.update(self.restorer(run).split())
        return found


class Finder:
    """The lexicon's words in texts, plain or disguised; what a white-space-delimited token holds is worked out once."""

    def __init__(self, lexicon: dict[str, float], characters: CharacterModel) -> None:
        self.lexicon, self.restorer = lexicon, Restorer(characters)
        # Restoring a word of letters only changes how long its runs are.
        self.thin = {RUN.sub(r"\1", w) for w in lexicon}
        self.heads = {w[:i] for w in self.thin for i in range(len(w) + 1)}
        self.clean: set[str] = set()  # tokens known to hold none
        self.known: dict[str, frozenset[str]] = {}

    def _restored(self, word: str) -> str:
        # Letters stay, and without a gap there is one word: one that begins otherwise than the lexicon's can't be in it.
        if word.isalpha():
            return self.restorer(word) if RUN.sub(r"\1", word) in self.thin else ""
        head = LETTERS.match(word)
        if head and RUN.sub(r"\1", head[0]) not in self.heads and all(c.isalnum() or c in IMITATES for c in word):
            return ""
        return self.restorer(word)

    def _of(self, token: str) -> frozenset[str]:
        got = frozenset(token_words(token, self._restored) & self.lexicon.keys())
        if got:
            if len(self.known) < CACHE:
                self.known[token] = got
        elif len(self.clean) < CACHE and len(token) < 64:
            self.clean.add(token)
        return got

    def __call__(self, text: str) -> set[str]:
        low = text.lower()
        found: set[str] = set()
        plain, odd = set(low.split()) - self.clean, []
        for t in [t for t in plain if t in self.known]:
            found |= self.known[t]
            plain.discard(t)
        if ODD.search(" ".join(plain)):
            odd = [t for t in plain if not t.strip(ENDS).isalpha() and ODD.search(t)]
            plain.difference_update(odd)
        # Plain tokens are looked at together; most hold none.
        if plain and not self.thin.isdisjoint(LETTERS.findall(RUN.sub(r"\1", " ".join(plain)))):
            odd += plain
        elif len(self.clean) < CACHE:
            self.clean.update(t for t in plain if len(t) < 64)
        for t in odd:
            found |= self._of(t)
        # Letters spaced out over tokens.
        for run in spaced(low):
            found |= self.lexicon.keys() & set(self.restorer(run).split())
        return found


@dataclass
class Model:
    characters: CharacterModel
    lexicon: dict[str, float]
    weights: list[float]

    def features(self, found: set[str]) -> tuple[float, float]:
        hits = sorted((self.lexicon[w] for w in found & self.lexicon.keys()), reverse=True)
        return (hits[0] if hits else 0.0), sum(hits[1:])


def copy_key(words: set[str]) -> tuple[int, ...]:
    """The three least word hashes, which near copies share."""
    return tuple(sorted(zlib.crc32(w.encode()) for w in words)[:3])


def without_copies(rows: list[tuple[set[str], int]]) -> list[tuple[set[str], int]]:
    """Rows whose three least word hashes no row of their label before has: near copies would make chance words look like evidence."""
    seen: set[tuple] = set()
    out = []
    for words, y in rows:
        key = (y, *copy_key(words))
        if key not in seen:
            seen.add(key)
            out.append((words, y))
    return out


def training(docs: DataFrame, labels: DataFrame, parts: int, held_out: int) -> DataFrame:
    """text, y, side, fresh of all labelled documents outside the held-out fold, one text an id, written to the shared folder.

    side: a half by hash; fresh: the smallest id of those of its label that share the three least word hashes.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [",".join(map(str, copy_key(set(LETTERS.findall(t.lower()))))) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(keys, pa.string())], names=["doc_id", "y", "copy"])

    known = usable(labels, "toxic", parts, held_out)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & (fold(F.col("doc_id"), parts) != held_out))
    # Joined as below, so that both joins read one shuffle of the texts.
    first = texts.join(known, "doc_id").mapInArrow(keyed, "doc_id long, y int, copy string").groupBy("y", "copy").agg(F.min("doc_id").alias("doc_id"))
    known = known.join(first.select("doc_id", F.lit(True).alias("fresh")).distinct(), "doc_id", "left")
    whole = texts.join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("fresh").alias("fresh"))
    return materialize(whole.select("text", "y", F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(2)).cast("int").alias("side"), F.coalesce("fresh", F.lit(False)).alias("fresh")))


def presence(train: DataFrame, reader: Callable[[], Callable[[str], set[str]]] | None = None) -> DataFrame:
    """kind, word, n0 to n3: in how many fresh texts of each side and label (2 * side + y) each word is (kind 0); without a reader, plain
    words, and how often each trigram of the plain words of all texts occurs (kind 1, in n0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, held, plain = reader and reader(), [Counter() for _ in range(4)], Counter()

        def rest() -> pa.RecordBatch:
            grams = trigrams(plain)
            words = list(set().union(*held))
            columns = [pa.array([0] * len(words) + [1] * len(grams), pa.int32()), pa.array([*words, *grams], pa.string())]
            columns += [pa.array([n.get(w, 0) for w in words] + (list(grams.values()) if i == 0 else [0] * len(grams)), pa.int64()) for i, n in enumerate(held)]
            for n in (*held, plain):
                n.clear()
            return pa.record_batch(columns, names=["kind", "word", "n0", "n1", "n2", "n3"])

        for batch in batches:
            for text, y, side, fresh in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if read is None:
                    words = LETTERS.findall(text.lower())
                    plain.update(words)
                if fresh:
                    held[2 * side + y].update(set(words) if read is None else read(text))
            if max(sum(map(len, held)), len(plain)) > CACHE:
                yield rest()
        yield rest()

    found = train.mapInArrow(run, "kind int, word string, n0 long, n1 long, n2 long, n3 long")
    return found.groupBy("kind", "word").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(4)))


def evidence(counted: DataFrame, texts: list[int], sides: list[tuple[int, ...]], least: float = 15.0) -> list[dict[str, float]]:
    """For each choice of sides the words whose presence speaks for label 1 beyond chance (likelihood ratio above `least`), with their log odds.

    texts: how many fresh texts each of n0 to n3 is out of.
    """

    def odds(side: tuple[int, ...]) -> Column:
        n, (b, a) = [max(1, sum(texts[2 * s + y] for s in side)) for y in (0, 1)], [sum((F.col(f"n{2 * s + y}") for s in side), F.lit(0)) for y in (0, 1)]
        pa_, pb, p = a / n[1], b / n[0], (a + b) / (n[0] + n[1])
        log = lambda k, m, q: F.when(k > 0, k * F.log(q)).otherwise(0.0) + F.when(m > k, (m - k) * F.log(1 - q)).otherwise(0.0)
        ratio = 2 * (log(a, F.lit(n[1]), pa_) + log(b, F.lit(n[0]), pb) - log(a, F.lit(n[1]), p) - log(b, F.lit(n[0]), p))
        return F.when((a >= 3) & (pa_ > 3 * pb) & (ratio >= least), F.log(((a + 0.5) / (n[1] + 1)) / ((b + 0.5) / (n[0] + 1))))

    names = [f"odds{i}" for i in range(len(sides))]
    found = counted.where("kind = 0").select("word", *(odds(side).alias(x) for side, x in zip(sides, names, strict=True)))
    got = found.where(F.coalesce(*names).isNotNull()).toArrow().to_pylist()
    return [{r["word"]: r[x] for r in got if r[x] is not None} for x in names]


def features(train: DataFrame, characters: CharacterModel, lexicons: list[dict[str, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (features, label) of the texts by the evidence of the half that they aren't in, and how many texts have them."""
    held = train.sparkSession.sparkContext.broadcast((characters, lexicons))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, by_side = held.value
        find, models = Finder(by_side[0] | by_side[1], chars), [Model(chars, lexicon, []) for lexicon in by_side]
        for batch in batches:
            many = Counter((*models[1 - side].features(find(text)), y) for text, y, side, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield pa.record_batch([pa.array([k[i] for k in many], kind) for i, kind in enumerate((pa.float64(), pa.float64(), pa.int32()))] + [pa.array(list(many.values()), pa.int64())], names=["a", "b", "y", "n"])

    got = train.mapInArrow(run, "a double, b double, y int, n long").groupBy("a", "b", "y").agg(F.sum("n").alias("n")).orderBy("a", "b", "y").toArrow()
    a, b, y, n = (got[c].to_numpy() for c in ("a", "b", "y", "n"))
    return np.column_stack([a, b]), y, n


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0) -> Model | None:
    """Learn from all labelled documents outside the held-out fold; only counts, the lexicon and distinct features leave the tasks."""
    ship(docs.sparkSession)
    train = training(docs, labels, parts, held_out)
    texts = [0, 0, 0, 0]
    for r in train.where("fresh").groupBy("side", "y").count().collect():
        texts[2 * r["side"] + r["y"]] = r["count"]
    if not (texts[0] + texts[2] and texts[1] + texts[3]):
        discard(train)
        return None
    counted = materialize(presence(train))
    grams = counted.where("kind = 1").select("word", "n0").toArrow()
    grams = dict(zip(grams["word"].to_pylist(), grams["n0"].to_pylist(), strict=True))
    each = max(1, int(SUSPECT * sum(n for g, n in grams.items() if g[2] == " ")))
    characters = CharacterModel(Counter(dict.fromkeys(evidence(counted, texts, [(0, 1)])[0], each)), grams)
    discard(counted)
    held = docs.sparkSession.sparkContext.broadcast(characters)

    # The curve is fitted on evidence from the other half, so that chance words don't count.
    *halves, lexicon = evidence(presence(train, lambda: Reader(held.value)), texts, [(0,), (1,), (0, 1)])
    x, y, n = features(train, characters, halves)
    discard(train)
    return Model(characters, lexicon, logistic(x, y, share_of_ones(labels, "toxic", parts, held_out), times=n).tolist())


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "toxicity_score") -> DataFrame:
    """Add `out`, from 0 to 1, higher for toxic texts; a column of that name is replaced."""
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c != out]
    if model is None:
        return docs.select(*(F.col(f"`{c}`") for c in kept), F.lit(0.0).alias(out))
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        find, w = Finder(m.lexicon, m.characters), m.weights

        def judge(value: str) -> float:
            a, b = m.features(find(value))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] * a + w[1] * b + w[2]))))

        for batch in batches:
            scores = [judge(t.as_py() or "") for t in batch.column(len(kept))]
            yield pa.record_batch([*(batch.column(i) for i in range(len(kept))), pa.array(scores, pa.float64())], names=[*kept, out])

    picked = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias(free(docs, "__text")))
    return picked.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, parts, held_out), out="score")
    return scored.select("doc_id", (fold(F.col("doc_id"), parts) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
