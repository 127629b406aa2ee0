"""The stateful operators over streams; each shares its rule with the batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import core, is_term, term_tokens
from ..operators.sessionize import SEGMENT, Cutter, CutPolicy

CUTTER_STATE = "seq int, open boolean, start long, content long, spoken long, ended long, lead long"


def cut(frames: DataFrame, policy: CutPolicy, key: str = "session") -> DataFrame:
    """Segments as they close.  Rows: key, t_us, is_speech, is_end; a session's frames come in time order from batch
    to batch and in any order within one.  A row with is_end flushes the session and frees its state."""
    kind = frames.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in SEGMENT.split(", "))]

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cutter = Cutter(policy, *state.get) if state.exists else Cutter(policy)
        rows, ended = [], False
        frame = pd.concat(list(batches)).sort_values("t_us", kind="stable")
        for t, speech, end in zip(frame["t_us"].tolist(), frame["is_speech"].tolist(), frame["is_end"].tolist(), strict=True):
            if end:
                ended = True
            elif made := cutter.frame(t, bool(speech)):
                rows.append((group[0], *made))
        if ended:
            if made := cutter.flush():
                rows.append((group[0], *made))
            state.remove()
        else:
            state.update((cutter.seq, cutter.open, cutter.start, cutter.content, cutter.spoken, cutter.ended, cutter.lead))
        yield pd.DataFrame(rows, columns=names)

    return frames.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {SEGMENT}", CUTTER_STATE, "append", GroupStateTimeout.NoTimeout)


def assemble(results: DataFrame, key: str = "session") -> DataFrame:
    """Results (key, seq, text, is_gap) in the order of seq without holes: a late one waits, the first of a number wins.

    A row whose seq is null ends its session and frees the state; what still waits behind a hole then goes unsaid.
    """
    kind = results.schema[key].dataType.simpleString()
    out = f"{key} {kind}, seq int, text string, is_gap boolean"

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor, seqs, texts, gaps = state.get if state.exists else (0, [], [], [])
        waiting = {s: (t, g) for s, t, g in zip(seqs, texts, gaps, strict=True)}
        ended = False
        for frame in batches:
            for seq, text, gap in zip(frame["seq"].tolist(), frame["text"].tolist(), frame["is_gap"].tolist(), strict=True):
                if pd.isna(seq):
                    ended = True
                elif (seq := int(seq)) >= cursor:
                    waiting.setdefault(seq, (text, bool(gap)))
        rows = []
        while cursor in waiting:
            rows.append((group[0], cursor, *waiting.pop(cursor)))
            cursor += 1
        left = sorted(waiting)
        if ended:
            state.remove()
        else:
            state.update((cursor, left, [waiting[s][0] for s in left], [waiting[s][1] for s in left]))
        yield pd.DataFrame(rows, columns=[key, "seq", "text", "is_gap"])

    return results.groupBy(key).applyInPandasWithState(run, out, "cursor int, seqs array<int>, texts array<string>, gaps array<boolean>", "append", GroupStateTimeout.NoTimeout)


def term_counts(texts: DataFrame, key: str = "session", text: str = "text") -> DataFrame:
    """(key, core, n): in how many rows of a session each term was seen so far; a built-in streaming aggregation."""
    tokens = F.transform(term_tokens(F.col(text)), lambda t, i: F.when(is_term(t, i), core(t)))
    each = texts.select(key, F.explode(F.array_distinct(F.filter(tokens, lambda x: x.isNotNull()))).alias("core"))
    return each.groupBy(key, "core").agg(F.count(F.lit(1)).alias("n"))


def on_each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each micro-batch to `act`, such as a document snapshot's writer."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
