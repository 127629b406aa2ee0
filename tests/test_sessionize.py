import random

from quillspark.operators.sessionize import Cutter, CutPolicy, cut
from quillspark.sources import frames

#: Whole ticks instead of time: a segment has 5 ticks of content at least and 20 at most, a pause 3.
TICKS = CutPolicy(minimum=5, pause=3, maximum=20, overlap=4)


def segments(pattern, policy=TICKS):
    """Segments (seq, start, end, lead, forced) of a string with a mark for each tick: # is speech."""
    cutter = Cutter(policy)
    made = [cutter.frame(t, mark == "#") for t, mark in enumerate(pattern)] + [cutter.flush()]
    return [x for x in made if x]


def test_a_pause_ends_a_segment_that_is_long_enough():
    assert segments("..#######....###") == [(0, 2, 8, 2, False), (1, 13, 15, 5, False)]


def test_a_pause_in_little_content_doesnt():
    assert segments("###....####") == [(0, 0, 10, 0, False)]


def test_a_shorter_pause_doesnt_either():
    assert segments("########..#####") == [(0, 0, 14, 0, False)]


def test_the_longest_segment_is_forced_and_the_next_begins_before_its_end():
    assert segments("#" * 30) == [(0, 0, 20, 0, True), (1, 16, 29, 0, False)]


def test_an_overlap_without_new_speech_is_nothing():
    assert segments("#" * 21 + "." * 9) == [(0, 0, 20, 0, True)]


def test_speech_is_kept_and_limits_hold_in_drawn_sessions():
    rnd = random.Random(31)
    for _ in range(400):
        pattern = "".join(rnd.choice("#.") * rnd.choice([1, 2, 3, 5, 8, 13, 40]) for _ in range(rnd.randint(0, 12)))
        out = segments(pattern)
        spoken = [t for t, mark in enumerate(pattern) if mark == "#"]
        lost = [t for t in spoken if not any(a <= t <= b for _, a, b, _, _ in out)]
        assert lost in ([], spoken[-1:]), pattern  # a last tick alone has no length
        for seq, start, end, lead, forced in out:
            assert end - start <= TICKS.maximum and (not forced or end - start == TICKS.maximum) and lead >= 0
            assert start in spoken or out[seq - 1][4], pattern
        assert sum(b - a for _, a, b, _, _ in out) <= len(pattern) + TICKS.overlap * sum(x[4] for x in out)


def test_whole_tables_of_sessions_give_the_folds_rows(spark):
    rnd = random.Random(7)
    patterns = {f"s{i}": "".join(rnd.choice("##.") * rnd.randint(1, 9) for _ in range(rnd.randint(1, 15))) for i in range(12)}
    rows = [(k, t, t, mark == "#") for k, x in patterns.items() for t, mark in enumerate(x)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "session string, frame_idx long, t_us long, is_speech boolean")
    got = sorted(tuple(r) for r in cut(df, TICKS).collect())
    assert got == sorted((k, *x) for k, y in patterns.items() for x in segments(y))


def test_cut_of_nothing(spark):
    assert cut(spark.createDataFrame([], frames.FRAMES), CutPolicy()).count() == 0
