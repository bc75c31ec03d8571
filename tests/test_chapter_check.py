"""The whole check of a chapter on cases of each kind, scored: all and nothing but what is labelled."""

import pytest

from inkstream.functions import spelling
from inkstream.operators import proof

WORDS = "array<struct<text string, start double, end double, confidence double>>"


def said(text, gaps=(), confidence=0.9, step=0.4):
    """Words of 0.3 s, 0.1 s apart, with longer gaps before the words that are named."""
    at, out = 0.1, []
    for i, w in enumerate(text.split()):
        at += dict(gaps).get(i, 0.0)
        out.append((w, at, at + step - 0.1, confidence))
        at += step
    return out


#: name -> (written, heard, measured silences, what is found: (kind, expected, heard))
CASES = {
    "other word": ("Her coat hung by the stove.", said("her coat hung on the stove"), [], [("sub", "by", "on")]),
    "sentence left out": ("It rained. Nobody came to the fair. We went home.", said("it rained we went home"), [], [("skip", "Nobody came to the fair", "")]),
    "word added": ("The gate was shut.", said("the old gate was shut"), [], [("insert", "", "old")]),
    "figures": ("In 1848 they left with 21 carts.", said("in eighteen forty eight they left with twenty one carts"), [], []),
    "spacing": ("An icebox, half-empty, was any more use.", said("an ice box half empty was anymore use"), [], []),
    "marks": ("The café was naïve.", said("the cafe was naive"), [], []),
    "gap in a sentence": ("He opened the box and looked at the letter.", said("he opened the box and looked at the letter", [(5, 6.0)]), [], [("pause", "Pause > 4s", "")]),
    "gap between sentences": ("He opened the box. Then he looked.", said("he opened the box then he looked", [(4, 6.0)]), [], []),
    "silence within words": ("He opened the box and looked at the letter.", said("he opened the box and looked at the letter", step=2.0), [(8.0, 14.0)], [("pause", "Pause > 4s", "")]),
    "short silences": ("He opened the box and looked.", said("he opened the box and looked", [(2, 9.0)]), [(0.5, 1.0)], []),
    "near slips are one": ("One red apple fell from the tree.", said("one green pear fell from the tree"), [], [("sub", "red apple", "green pear")]),
    "unsure": ("The Wymondham road is long.", said("the windham road is long", confidence=0.1), [], []),
    "listed": ("Well the er road is long.", said("well the road is long"), [], []),
    "year the long way": ("It opened in 1871 by the river.", said("it opened in one thousand eight hundred seventy one by the river"), [], []),
    "year with a zero": ("The map is of 1706.", said("the map is of seventeen oh six"), [], []),
    "late year": ("Since 2031 nobody came.", said("since twenty thirty one nobody came"), [], []),
    "ordinal": ("On the 5th night it froze.", said("on the fifth night it froze"), [], []),
    "scale words": ("They paid 3200000 for it.", said("they paid three million two hundred thousand for it"), [], []),
    "single numbers": ("Two. Five. Now.", said("two five now"), [], []),
    "sounds alike": ("We saw their mare by the sea.", said("we saw there mayor by the see"), [], []),
    "sounds alike with marks": ("It's whose coat?", said("its who's coat"), [], []),
    "same letters, other sound": ("She read the wind and led.", said("she red the wind and lead"), [], [("sub", "read", "red"), ("sub", "led", "lead")]),
    "two spellings": ("The neighbour travelled to the grey centre, organising ploughs.", said("the neighbor traveled to the gray center organizing plows"), [], []),
    "guarded spellings": ("Four hours they filled it.", said("for hours they filed it"), [], [("sub", "Four", "for"), ("sub", "filled", "filed")]),
    "closed compound": ("A half-open door.", said("a halfopen door"), [], []),
    "compound read closed": ("By the farm yard wall.", said("by the farmyard wall"), [], []),
    "slip in a compound": ("The half-open door.", said("the half shut door"), [], [("sub", "half-open", "shut")]),
    "room before the first word": ("He turned the key.", said("he turned the key", [(0, 6.0)]), [(0.0, 5.9)], []),
    "sure of another word": ("The Wymondham path is long.", said("the windsor path is long"), [], [("sub", "Wymondham", "windsor")]),
    "no confidence at all": ("The Wymondham lane is long.", said("the windsor lane is long", confidence=None), [], [("sub", "Wymondham", "windsor")]),
    "nothing heard": ("Two words.", [], [], [("skip", "Two words", "")]),
    "nothing written": ("", said("hello there"), [], [("insert", "", "hello there")]),
}


ALIKE = "their there they're\nmare mayor\nsea see\n\nit's its\nwhose who's\n"


def test_cases_of_every_kind(spark, tmp_path):
    (tmp_path / "alike.txt").write_text(ALIKE)
    classes = spelling.read_classes(spark, str(tmp_path / "alike.txt"))
    rows = [(name, text, heard, [(a, z) for a, z in silences], None) for name, (text, heard, silences, _) in CASES.items()]
    chapters = spark.createDataFrame(rows, f"doc_id string, text string, heard {WORDS}, silences array<struct<start double, end double>>, duration double")
    found = proof.checked(chapters, classes=classes, floor=0.4, suppressed=["er"]).orderBy("doc_id", "t_start").collect()
    by = {name: [] for name in CASES}
    for r in found:
        by[r.doc_id].append((r.kind, r.expected, r.heard))
    assert {n: x for n, x in by.items() if x != CASES[n][3]} == {}
    labels = spark.createDataFrame([(n, *x) for n, c in CASES.items() for x in c[3]], "doc_id string, kind string, expected string, heard string")
    score = proof.scores(spark.createDataFrame(found, "doc_id string, pickup_id string, t_start double, t_end double, kind string, expected string, heard string, confidence double, pickups long"), labels, ["doc_id", "kind", "expected", "heard"]).first()
    assert score.precision == score.recall == 1.0 and score.true_positives == sum(len(c[3]) for c in CASES.values())
    assert all(r.t_end >= r.t_start and r.pickup_id.startswith("pickup-") for r in found)


@pytest.mark.parametrize(
    "word, american",
    [("colours", "colors"), ("Favourite", "favorite"), ("hour", "hour"), ("four", "four"), ("realised", "realized"), ("rise", "rise"), ("analysing", "analyzing"), ("theatres", "theaters"), ("acre", "acre"), ("more", "more"),
     ("signalling", "signaling"), ("filled", "filled"), ("calling", "calling"), ("marvellous", "marvelous"), ("callous", "callous"), ("dialogues", "dialogs"), ("rogue", "rogue"), ("storeys", "stories"), ("ploughing", "plowing"), ("cheques", "checks"), ("jeweller", "jeweler"), ("zebra", "zebra")],
)
def test_spellings(word, american):
    assert spelling.american_spelling(word) == american == spelling.american_spelling(american)


def test_a_table_of_classes_that_is_too_large_is_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "alike.txt").write_text(ALIKE)
    monkeypatch.setattr(spelling, "MAX_CLASSES", 3)
    with pytest.raises(ValueError):
        spelling.read_classes(spark, str(tmp_path / "alike.txt"))


def test_words_of_no_use_and_a_duration(spark):
    heard = [("one", 0.0, 0.3, 0.9), ("", 0.3, 0.4, 0.9), ("two", float("nan"), 0.5, 0.9), ("two", 0.6, 9.0, None), ("three", 20.0, 21.0, 0.9)]
    chapters = spark.createDataFrame([(1, "One two.", heard, 2.0)], f"doc_id long, text string, heard {WORDS}, duration double")
    assert proof.checked(chapters).collect() == []


@pytest.mark.parametrize(
    "written, heard, expected",
    [
        ("He had 21 cats", "he had twenty one cats", [("he", "matched"), ("had", "matched"), ("twenty one", "matched"), ("cats", "matched")]),
        ("A half-empty cup", "a half empty cup", [("a", "matched"), ("half empty", "matched"), ("cup", "matched")]),
        ("See Leominster now", "see lem ster now", [("see", "matched"), ("lem ster", "different"), ("now", "matched")]),
        ("a b c d", "a x y d", [("a", "matched"), ("x", "different"), ("y", "different"), ("d", "matched")]),
        ("a b c d e", "a x y e", [("a", "matched"), ("", "missing"), ("", "missing"), ("", "missing"), ("e", "matched")]),
    ],
)
def test_tokens_have_what_was_heard(spark, written, heard, expected):
    rows = spark.createDataFrame([(1, written.split(), said(heard))], f"doc_id long, tokens array<string>, heard {WORDS}")
    found = proof.token_alignment(rows).orderBy("token_index").collect()
    assert [r.heard for r in found] == [h for h, _ in expected]
    states = {r.heard: r.state for r in found}
    assert all(states[h] == s for h, s in expected if h != "twenty one")


def test_readings_and_ranges(spark):
    rows = spark.createDataFrame([(1, "Ann saw Ann and Ann".split(), said("ann saw anne and")), (2, ["Ann"], said("Ann!"))], f"doc_id long, tokens array<string>, heard {WORDS}")
    alignment = proof.token_alignment(rows)
    places = spark.createDataFrame([("ann", 1, 0, 1), ("ann", 1, 2, 1), ("ann", 1, 4, 1), ("ann", 2, 0, 1), ("ann", 3, 0, 1)], "phrase string, doc_id long, token_index int, n_tokens int")
    found = {r.reading: r["count"] for r in proof.readings(places, alignment, ["phrase"]).collect()}
    assert found == {"ann": 2, "anne": 1, "#silent": 1, "#no-audio": 1}
    picked = spark.createDataFrame([(1, 0, 2), (1, 2, 4), (1, 4, 4)], "doc_id long, first int, last int")
    assert {(r.first, r.last): r.timing for r in proof.redo_ranges(alignment, picked).collect()} == {(0, 2): "ready", (2, 4): "partial", (4, 4): "unavailable"}
    assert [(r.timed, r.tokens) for r in proof.coverage(alignment).orderBy("doc_id").collect()] == [(4, 5), (1, 1)]
