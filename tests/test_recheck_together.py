import random

import numpy as np
from test_vocabulary import WORDS, list_batch, made_up, readings, slipped

from inkstream.functions import wordclass
from inkstream.functions.vocabulary import Vocabulary, readings as as_readings
from inkstream.plans import live
from inkstream.streaming import recheck as R

LONG = ["x" * 31 + "y", "x" * 32 + "y", "yx" * 40, "é" * 20]


def test_distances_and_scores_of_many_pairs_are_those_of_each():
    r, known = random.Random(1), Vocabulary()
    words = ["", "a", "the", "for", "were", "was", *WORDS, *LONG, *made_up(r, 80)]
    words += [slipped(r, w) for w in words]
    pairs = [(r.choice(words), r.choice(words)) for _ in range(4000)] + list(zip(words, words[len(words) // 2 :])) + [(w, w) for w in words]
    a, b = (known.add([p[side] for p in pairs]) for side in (0, 1))
    assert R.distances(known, a, b).tolist() == [wordclass.distance(x, y) for x, y in pairs]
    assert R.pair_scores(known, a, b).tolist() == [R.pair_score(x, y) for x, y in pairs]
    assert R.distances(known, a[:0], b[:0]).tolist() == []


def test_alignments_of_many_windows_are_those_of_each():
    r, known, looks = random.Random(2), Vocabulary(), []
    for _ in range(400):
        page = r.choices(WORDS + made_up(r, 10) + [""], k=r.randint(0, 16))
        heard = [slipped(r, w) if r.random() < 0.3 else w for w in page[r.randint(0, 3) :] if r.random() < 0.9][:10]
        looks.append((heard, page))
    assert R.aligned_together(known, looks) == [R.aligned(*x) for x in looks]
    assert R.aligned_together(known, []) == []


def test_windows_cut_from_sessions_give_the_flags_of_windows_as_rows(spark):
    kind = "session int, tokens array<string>, heard array<struct<text string, start double, end double, confidence double>>, kept string"
    rows = [(i, page, [(t, a, z, None if c != c else c) for t, _, a, z, c in said], "k") for i, (page, said) in enumerate(readings(random.Random(5), 60))]
    rows += [(90, None, None, None), (91, ["the", "cat"], None, "k"), (92, [None, "the"], [(None, 0.0, 0.1, 0.9), ("a", None, 0.5, 0.9), ("the", 0.5, None, 0.9)], "k"), (93, [], [("the", 0.0, 0.1, 0.9)], "k")]
    some = spark.createDataFrame(rows, kind)
    for hop in (3, 8):
        plain = R.flags(R.windows(some, "tokens", "heard", 0.4, hop))
        found = R.session_flags(some, "tokens", "heard", 0.4, hop)
        assert found.schema == plain.select(found.columns).schema
        told = sorted(found.collect(), key=str)
        assert told == sorted(plain.select(found.columns).collect(), key=str) and len(told) > 20
    assert R.session_flags(some.limit(0), "tokens", "heard", 0.4).count() == 0


def test_live_flags_have_no_row_for_each_window(spark, small):
    plan = live.live_flags(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_only_windows_that_differ_are_looked_at():
    known, r = Vocabulary(), random.Random(6)
    page = made_up(r, 800)
    said = [("slipped" if i % 80 == 4 else w, "", i * 0.4, i * 0.4 + 0.3, 0.9) for i, w in enumerate(page)]
    rows, numbers, looks = R._looks(as_readings(list_batch([(page, said), ([], said), (page, [])]), known), known, 0.4, 8)
    assert rows == [0] * 10 and numbers == list(range(0, 100, 10)) and [x.cursor for x in looks] == [80 * k for k in range(10)]
    assert np.isclose(looks[1].heard[4].start, 84 * 0.4)
