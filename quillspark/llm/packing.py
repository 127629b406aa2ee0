"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Tokens are those of a public BPE vocabulary with word ends.  Words are cut at white space, and each
distinct word is encoded once for a worker (up to `CACHE` words are remembered), so most of the text costs
one dictionary lookup a word.  Only piece lengths and checksums are shuffled, dealt evenly over tasks of
about `DOCS_A_TASK` documents; a task keeps one short piece a document and packs them by itself.

In a task a sequence starts with the longest piece left and is filled greedily with the longest that fits.
Then its smallest piece is replaced by two unpacked ones if these fill the widened gap more tightly.

A null text counts as empty: one token, the end.  Repeated rows are packed as often as they come.  An
empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, tokenizer_path

CACHE = 150_000
DOCS_A_TASK = 50_000
# Unicode's white space.
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
END_OF_WORD = b"\xff"  # a byte that UTF-8 doesn't have


class WordTokens(dict):
    """Little-endian 32-bit ids of a white-space-delimited word, as the vocabulary's own tokenizer gives them."""

    def __init__(self, path: str) -> None:
        import tiktoken

        model = json.load(open(path, encoding="utf-8"))
        # The file writes bytes as printable characters: the printable Latin-1 bytes as themselves, the others from 256 up.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        added = {t["content"] for t in model["added_tokens"]}

        def raw(token: str) -> bytes:
            ends = token.endswith("</w>")
            return bytes(byte_of[c] for c in (token[:-4] if ends else token)) + END_OF_WORD * ends

        ids = {raw(t): i for t, i in model["model"]["vocab"].items() if t not in added}
        # A word's last byte joins its end first of all; then merges go by their order in the file.
        ranks = {bytes([b]): b for b in range(256)}
        for b in range(255):
            ranks[bytes([b]) + END_OF_WORD] = len(ranks)
        for m in model["model"]["merges"]:
            left, right = m if isinstance(m, list) else m.split(" ")
            ranks.setdefault(raw(left) + raw(right), len(ranks))
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.bytes_of = [b""] * len(ranks)
        for b, r in ranks.items():
            self.bytes_of[r] = ids.get(b, 0).to_bytes(4, "little")
        cut = next(p["pattern"]["Regex"] for p in model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # The tokenizer's white space, which differs from that of Python's regular expressions.
        self.split = regex.compile(cut.replace(r"\s", SPACES)).findall
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in model["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None

    def _plain(self, word: str) -> bytes:
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")  # lower case goes letter by letter
        word = word.lower()
        pieces = (word,) if word.isascii() and word.isalpha() else self.split(word)
        encode, of = self.core.encode_single_piece, self.bytes_of
        return b"".join([of[i] for p in pieces for i in encode(p.encode() + END_OF_WORD)])

    def __missing__(self, key: bytes) -> bytes:
        word = key.decode()
        if self.special and "<|" in word:
            made = b"".join(self.added.get(p) or self._plain(p) for p in self.special.split(word))
        else:
            made = self._plain(word)
        if len(self) < CACHE and len(key) < 64:
            self[key] = made
        return made

    def encode(self, text: str) -> bytes:
        """Ids of a text; only ASCII white space parts words here, so that no other character is touched."""
        return b"".join(map(self.__getitem__, text.encode().split()))


_tables: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's table, kept from task to task."""
    if path not in _tables:
        _tables[path] = WordTokens(path)
    return _tables[path]


def pieces(docs: DataFrame, limit: int = 2048, vocabulary: str = "word_bpe_49k.json", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids, cut where they pass `limit`; an end token, id 0, closes a document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = word_tokens(tokenizer_path(vocabulary)).encode, 4 * limit
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for ident, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(value.as_py() or "") + b"\0\0\0\0"
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    rows.append((ident, at // step, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")


class Lengths:
    """Unpacked pieces by length, with the longest one up to any length at hand."""

    def __init__(self, lengths: np.ndarray, limit: int) -> None:
        order = np.argsort(lengths, kind="stable")
        at = np.searchsorted(lengths[order], np.arange(limit + 2))
        self.stack = [order[at[n] : at[n + 1]][::-1].tolist() for n in range(limit + 1)]
        self.floor = np.maximum.accumulate(np.where(np.diff(at) > 0, np.arange(limit + 1), 0))
        self.distinct = [n for n in range(1, limit + 1) if self.stack[n]]
        self.array = np.array(self.distinct, dtype=np.int64)

    def take(self, length: int) -> int:
        item = self.stack[length].pop()
        if not self.stack[length]:
            i = bisect_left(self.distinct, length)
            del self.distinct[i]
            self.array = np.delete(self.array, i)
            end = self.distinct[i] if i < len(self.distinct) else len(self.floor)
            self.floor[length:end] = self.distinct[i - 1] if i else 0
        return item

    def give(self, length: int, item: int) -> None:
        self.stack[length].append(item)
        if len(self.stack[length]) == 1:
            i = bisect_left(self.distinct, length)
            self.distinct.insert(i, length)
            self.array = np.insert(self.array, i, length)
            end = self.distinct[i + 1] if i + 1 < len(self.distinct) else len(self.floor)
            self.floor[length:end] = length

    def two(self, room: int) -> tuple[int, int]:
        """The two unpacked lengths with the largest sum up to room, or zeros."""
        first = self.array[: np.searchsorted(self.array, room - 1, side="right")]
        if not len(first):
            return 0, 0
        second = self.floor[room - first]
        for i in np.flatnonzero(second == first):
            if len(self.stack[first[i]]) < 2:
                second[i] = self.floor[first[i] - 1]
        total = np.where(second > 0, first + second, 0)
        best = int(np.argmax(total))
        return (int(first[best]), int(second[best])) if total[best] else (0, 0)


def best_two_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its sequence (from 0) and its offset there."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    left, number = Lengths(lengths, limit), 0
    while left.distinct:
        held = [(n := left.distinct[-1], left.take(n))]
        gap = limit - n
        while gap and (n := int(left.floor[gap])):
            held.append((n, left.take(n)))
            gap -= n
        if gap and left.distinct:
            small, item = held[-1] if len(held) > 1 else (0, -1)
            a, b = left.two(gap + small)
            if a + b > small:
                if small:
                    held.pop()
                    left.give(small, item)
                held += [(a, left.take(a)), (b, left.take(b))]
        at = 0
        for n, item in held:
            bins[item], offsets[item] = number, at
            at += n
        number += 1
    return bins, offsets


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, limit: int = 2048, **how) -> DataFrame:
    """Every piece of every document with its sequence and place; see PACKED.  `how`: see pieces()."""
    tasks = max(1, -(-docs.count() // DOCS_A_TASK))
    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        short: list[pa.Table] = []

        def out(rows: pa.Table, sequence: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
            columns = [rows[c].cast(schema.field(c).type) for c in schema.names[:5]]
            yield from pa.table([*columns, pa.array(number + sequence), pa.array(offset)], schema=schema).to_batches(max_chunksize=50_000)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            whole = rows["length"].to_numpy() == limit
            if whole.any():
                full = rows.filter(pa.array(whole))
                yield from out(full, np.arange(full.num_rows), np.zeros(full.num_rows, dtype=np.int64))
                number += full.num_rows
            short.append(rows.filter(pa.array(~whole)))
        if short:
            rows = pa.concat_tables(short).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            yield from out(rows, *best_two_fit(rows["length"].to_numpy(), limit))

    return pieces(docs, limit, **how).repartition(tasks).mapInArrow(run, PACKED)
