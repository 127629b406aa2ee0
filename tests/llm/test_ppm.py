import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import ppm
from quillspark.llm.text import slices


def brute(train: list[bytes], text: bytes, order: int) -> tuple[float, float]:
    """log10 probability of text under PPM-C with exclusion, and the largest error of a distribution's sum."""
    counts: list[dict] = [{} for _ in range(order + 1)]
    pad = lambda t: [0] * order + [b + 1 for b in t] + [0]
    for t in train:
        s = pad(t)
        for i in range(order, len(s)):
            for j in range(order + 1):
                at = counts[j].setdefault(tuple(s[i - j : i]), {})
                at[s[i]] = at.get(s[i], 0) + 1

    def probability(context: list[int], symbol: int) -> float:
        p, barred = 1.0, set()
        for j in range(order, -1, -1):
            here = counts[j].get(tuple(context[len(context) - j :]))
            if here is None:
                continue
            left = {s: n for s, n in here.items() if s not in barred}
            total = sum(left.values()) + len(left)
            if symbol in left:
                return p * left[symbol] / total
            if left:
                p *= len(left) / total
            barred |= set(here)
        return p / max(1, 257 - len(barred))

    s = pad(text)
    total, worst = 0.0, 0.0
    for i in range(order, len(s)):
        total += np.log10(probability(s[i - order : i], s[i]))
        worst = max(worst, abs(sum(probability(s[i - order : i], x) for x in range(257)) - 1))
    return total, worst


def test_trie_matches_a_plain_implementation():
    train = [b"the cat sat on the mat", b"the hat", b"", b"a cat, a hat, a mat" * 3]
    asked = ["the rat sat", "", "zzz", "the cat sat on the mat", "aéé hat"]
    arr = pa.array([t.decode() for t in train])
    codes = np.concatenate([ppm.grams(d, o)[0] for _, _, d, o in slices(arr)])
    levels = []
    for j in range(ppm.ORDER + 1):
        code, n = np.unique(codes & np.uint64(ppm.mask(j + 1)), return_counts=True)
        context, first, kinds = np.unique(code >> np.uint64(ppm.WIDTH), return_index=True, return_counts=True)
        levels.append((code, n, context, np.add.reduceat(n, first), kinds))
    trie = ppm.Trie(levels).ready()
    for t in asked:
        for _, _, d, o in slices(pa.array([t])):
            got = trie.log10(ppm.grams(d, o)[0]).sum()
        want, worst = brute(train, t.encode(), ppm.ORDER)
        assert abs(got - want) < 1e-9, t
        assert worst < 1e-9


@pytest.mark.parametrize("share", [1e-9, 0.02, 2.0])
def test_score_keeps_every_ngram(spark, monkeypatch, share):
    monkeypatch.setattr(ppm, "SHARE", share)
    texts = ["the cat sat on the mat", "the hat", "", "a cat, a hat, a mat" * 3, "the rat sat", "zzz", "aéé hat", None, "The cat sat on a hat", "q"] * 2
    got = ppm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), parts=3).collect()
    assert len(got) == len(texts) and {r.held_out for r in got} == {True, False}
    train = [(texts[r.doc_id] or "").lower().encode() for r in got if not r.held_out]
    for r in got:
        want, worst = brute(train, (texts[r.doc_id] or "").lower().encode(), ppm.ORDER)
        assert abs(r.score - want) < 1e-9 and worst < 1e-9, texts[r.doc_id]
