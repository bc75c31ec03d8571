"""Word classes and the second look at windows, against brute force and told cases."""

import random
from functools import cache

import pytest

from pyspark.sql import functions as F

from inkstream.functions import wordclass as W
from inkstream.operators.structure import slip_kind
from inkstream.streaming import recheck as R


@pytest.mark.parametrize("a, b, same", [("colour", "color", True), ("organised", "organized", True), ("four", "for", False), ("theatre", "theater", True), ("twentyone", "21", True), ("fifth", "5th", True), ("o'clock", "oclock", True), ("travelled", "traveled", True), ("licence", "license", True), ("grey", "gray", True), ("1,740", "1740", True), ("here", "her", False), ("", "", False)])
def test_same_word(a, b, same):
    assert W.same_word(a, b) == same == W.same_word(b, a)


@pytest.mark.parametrize("word, value", [("seventeenhundredforty", 1740), ("twomillionthree", 2_000_003), ("1,740", 1740), ("3rd", 3), ("zero", 0), ("nineteenth", 19), ("eightyfive", 85), ("hundred", 100), ("cat", None), ("", None), ("fivecats", None)])
def test_number_value(word, value):
    assert W.number_value(word) == value


@pytest.mark.parametrize("expected, heard, kind", [("five", "six", "number"), ("child", "children", "inflection"), ("walk", "walked", "inflection"), ("abroad", "road", "onset"), ("the", "a", "swap"), ("on", "in", "swap"), ("their", "the", None), ("boat", "train", None), ("five", "5", None)])
def test_slip_kinds(expected, heard, kind):
    assert W.slip(expected, heard) == kind


def test_distance_is_that_of_all_edits():
    @cache
    def plain(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(plain(a[1:], b) + 1, plain(a, b[1:]) + 1, plain(a[1:], b[1:]) + (a[0] != b[0]))

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 6))) for _ in range(2))
        assert W.distance(a, b) == plain(a, b)
        assert W.near(a, b) == (bool(a and b) and (a == b or max(len(a), len(b)) >= 5 and plain(a, b) <= 1))


def best_of_all(heard, page):
    """The score of the best alignment, over every way to pair words."""

    def score(i, j):
        if i == len(heard):
            return 0.0
        options = [R.UNWRITTEN + score(i + 1, j)]
        if j < len(page):
            options += [R.pair_score(page[j], heard[i]) + score(i + 1, j + 1), R.UNREAD + score(i, j + 1)]
        return max(options)

    return max(score(0, j) for j in range(len(page) + 1))


def scored(heard, page, pairs):
    total, at, j = 0.0, 0, None
    for p in pairs:
        total += R.UNWRITTEN * (p.heard - at) + R.pair_score(page[p.expected], heard[p.heard])
        total += R.UNREAD * (p.expected - j - 1) if j is not None else 0
        at, j = p.heard + 1, p.expected
    return total + R.UNWRITTEN * (len(heard) - at)


def test_alignments_are_the_best_of_all():
    r = random.Random(2)
    for _ in range(400):
        page = r.choices(["the", "a", "boat", "boats", "river", "rivers", "five", "six", "in"], k=r.randint(0, 5))
        heard = r.choices(["the", "a", "boat", "boats", "river", "rivets", "five", "six", "in", "zebra"], k=r.randint(0, 5))
        pairs = R.aligned(heard, page)
        assert scored(heard, page, pairs) == pytest.approx(best_of_all(heard, page))
        assert all(a.heard < b.heard and a.expected < b.expected for a, b in zip(pairs, pairs[1:]))


def heard(text, confidence=0.95, start=0.0):
    out = []
    for i, w in enumerate(text.split()):
        word, _, c = w.partition("@")
        out.append(R.Heard(word, word.lower(), start + 0.4 * i, start + 0.4 * i + 0.3, float(c or confidence)))
    return out


PAGE = "she kept the old letter on the table beside seventeen hundred and forty books".split()


@pytest.mark.parametrize(
    "said, found",
    [
        ("she kept the old letter on the table", None),
        ("she kept the old letter in the table", ("on", "in", "swap")),
        ("she kept the old letter in@0.4 the table", ("on", "in@0.4", "swap")),  # pinned by its neighbours
        ("she kept the old letters on the table", ("letter", "letters", "inflection")),
        ("she kept the cold letter on the table", ("old", "cold", "onset")),
        ("she kept the old kettle on the table", ("letter", "kettle", "similar")),
        ("she kept the old zebra on the table", ("letter", "zebra", "mismatch")),
        ("she kept the old zebra@0.5 on the table", None),
        ("thank you bye", None),
        ("blank audio", None),
        ("zebra", None),
        ("she keptthe old letter on the table", None),
    ],
)
def test_flags_of_a_phrase(said, found):
    flag = R.flagged(PAGE, [h._replace(word=h.text) for h in heard(said)], 0, 8)
    assert (flag and (flag.expected, flag.heard.partition("@")[0], flag.kind)) == (found and (found[0], found[1].partition("@")[0], found[2]))


def test_a_dismissed_slip_is_not_told_and_hides_what_only_sounds_alike():
    said = heard("she kept the old kettle in the table")
    assert R.flagged(PAGE, said, 0, 8).heard == "in"
    assert R.flagged(PAGE, said, 0, 8, dismissed=frozenset(["5-in"])) is None
    assert R.flagged(PAGE, heard("she kept the old kettle on the table"), 0, 8, dismissed=frozenset(["5-in"])).kind == "similar"


def test_numbers_as_figures():
    assert R.flagged(PAGE, heard("the table beside 1740 books"), 6, 14) is None
    assert R.flagged(PAGE, heard("the table beside 1750 books"), 6, 14)[:3] == (9, "seventeen", "1750")
    six = "it was six forty six when the bell rang".split()
    assert R.flagged(six, heard("it was 646 when the bell rang"), 0, 9) is None
    assert [h.word for h in R.spelled(heard("was 646 when"), six)] == ["was", "six", "forty", "six", "when"]


def test_a_lone_word_in_the_middle_of_a_reading():
    assert R.flagged(PAGE, heard("kettle"), 4, 8)[2:] == ("kettle", 0.0, 0.3, 0.95, "similar") or R.flagged(PAGE, heard("zebra"), 4, 8).kind == "lone"
    assert R.flagged(PAGE, heard("zebra"), 4, 8).kind == "lone" and R.flagged(PAGE, heard("zebra"), 0, 8) is None
    assert R.flagged(PAGE, heard("zebra", 0.8), 4, 8) is None and R.flagged([], heard("zebra"), 4, 8) is None


def test_windows_give_the_same_flags_as_single_calls(spark):
    words = [w for _ in range(9) for w in PAGE]
    said = [(("zebra" if i in (18, 60) else w), i * 0.4, i * 0.4 + 0.3, 0.95) for i, w in enumerate(words)]
    rows = spark.createDataFrame([("s", words, said, "k"), ("none", [], [], "k"), ("null", None, None, "k")], "session string, tokens array<string>, heard array<struct<text:string,start:double,end:double,confidence:double>>, kept string")
    cut = R.windows(rows, "tokens", "heard", 0.4)
    assert cut.count() == -(-len(words) // 8)
    found = [(r.session, r.window, r.expected_index, r.heard, r.kept) for r in R.flags(cut).collect()]
    assert sorted(found) == [("s", 2, 18, "zebra", "k"), ("s", 7, 60, "zebra", "k")]
    assert [r.expected_index for r in R.flags(cut, dismissed=R.F.array(R.F.lit("18-zebra"))).collect()] == [60]
    assert R.flags(cut.limit(0)).count() == 0


def test_slip_kinds_as_columns(spark):
    cases = {("five", "six"): "number", ("5", "five"): "same", ("12", "21"): "number", ("children", "child"): "inflection", ("ox", "oxen"): "inflection", ("walk", "walked"): "inflection", ("the", "a"): "short-swap", ("abroad", "road"): "onset", ("boat", "zebra"): "other"}
    rows = spark.createDataFrame([(*k, v) for k, v in cases.items()], "a string, b string, kind string")
    assert [r for r in rows.select("a", "b", "kind", slip_kind(F.col("a"), F.col("b")).alias("found")).collect() if r.kind != r.found] == []
