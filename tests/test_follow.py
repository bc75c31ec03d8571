"""The follower: told cases, nine readings of one page, and a stream against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from inkstream.sources.tables import spread
from inkstream.streaming import follow as L
from inkstream.streaming.recheck import Heard, usable

SCRIPT = "the fox jumped over the lazy dog and slept beside the river".split()


def hear(text, confidence=0.75, step=0.36):
    return [Heard(w, w.lower().strip(".,"), step * i, step * i + 0.3, confidence) for i, w in enumerate(text.split())]


def read(reading, said, window):
    state, places = L.State(), []
    for i in range(0, len(said), window):
        state, more = reading.read(state, said[i : i + window], i)
        places += more
    return state, places


@pytest.mark.parametrize(
    "said, cursor, events",
    [
        ("the fox jumped", 3, ["match"] * 3),
        ("the jumped over", 4, ["match", "skip", "match"]),
        ("the fix jumped ower", 3, ["match", "miss", "skip", "miss"]),
        ("the fox leaped over", 4, ["match", "match", "miss", "skip"]),
        ("an fox", 2, ["swap", "match"]),
        ("the fox sorry jumped", 3, ["match", "match", "cue", "match"]),
        ("the fox jumped over the lazy over the lazy dog", 7, ["match"] * 6 + ["miss", "wait", "miss", "match"]),
        ("zebra quagga okapi the", 1, ["miss"] * 3 + ["match"]),
        ("fox zebra quagga okapi the", 2, ["skip", "miss", "miss", "lost", "halted"]),
    ],
)
def test_following(said, cursor, events):
    state, places = L.Reading(SCRIPT).read(L.State(), hear(said))
    assert [p.event for p in places] == events and cursor == state.cursor
    assert [p.seq for p in places] == list(range(len(places)))


def test_a_run_of_misses_halts_where_it_began_and_carries_on():
    page = "lantern harbor beside quiet window winter rain moved softly copper".split()
    reading = L.Reading(page)
    state, places = reading.read(L.State(), hear("lantern ballroom erupted laughter winter"))
    assert [p.event for p in places] == ["match", "miss", "miss", "lost", "halted"] and (state.cursor, state.halted) == (1, True)
    state, places = reading.read(state.resumed(), hear("a b c d e ballroom erupted laughter harbor")[5:], 5)
    assert not state.halted and places[-1].event == "match" and state.cursor == 2
    assert L.Reading(page, halting=False).read(L.State(), hear("lantern ballroom erupted laughter"))[1][-1].event == "miss"


def test_a_word_waits_until_it_is_confirmed():
    page = "go to bed now if we can see it up on top of it".split()
    reading = L.Reading(page, proofing=True)
    state, places = reading.read(L.State(), hear("can"))
    assert [p.event for p in places] == ["wait"] and state.waiting == ("can", 6) and state.cursor == 0
    state, places = reading.read(state, [h._replace(end=h.end + 2) for h in hear("see")], 1)
    assert [(p.event, p.index) for p in places] == [("skip", 7)] and state.cursor == 8 and state.waiting is None


def test_late_and_repeated_words_do_not_count():
    reading, said = L.Reading(SCRIPT), hear("the fox jumped")
    state, _ = reading.read(L.State(), said)
    assert [p.event for p in reading.read(state, said)[1]] == ["late"] * 3
    assert [p.event for p in reading.read(state, [said[2]._replace(end=said[2].end + 0.5)])[1]] == ["echo"]


def test_proofing_flags_the_first_slip_that_has_an_anchor():
    reading = L.Reading("the quiet harbor beside window".split(), proofing=True)
    assert [p.event for p in reading.read(L.State(), hear("the noisy kettle beside window", 0.95))[1]] == ["match", "flag", "passed", "match", "match"]
    assert reading.read(L.State(), hear("zebra noisy", 0.95))[1][0].event == "miss"
    assert [p.event for p in L.Reading("lantern harbor beside".split(), proofing=True).read(L.State(), hear("kettle harbor beside", 0.95))[1]] == ["flag", "match", "match"]


#: A page and nine readings of it, with their outcomes.
LINES = [
    "The lantern waited beside the quiet harbor.",
    "Beyond the window, winter rain moved softly.",
    "A copper kettle whispered on the stove.",
    "Mara folded the letter and checked the clock.",
    "Footsteps faded slowly beneath the stone arch.",
    "At dawn, three fishing boats crossed the silver water.",
    "She closed the book and listened for the bell.",
]
BROKEN, AWAY = "Beyond the window winter", "The ballroom erupted with music and laughter"
#: Nine readings: what is said (numbers are lines), then the line that is reached, or the one that it halts at; whether it goes back.
READINGS = {
    "clean_sequential": ([0, 1, 2, 3], 3, False, False),
    "restart_current_line": ([0, BROKEN, 1, 2], 2, False, True),
    "restart_with_editing_phrase": ([0, BROKEN, "Sorry, start again", 1, 2], 2, False, True),
    "repeat_previous_line": ([0, 1, 0, 1, 2], 2, False, True),
    "repeat_after_next_line_start": ([0, 1, "A copper kettle", 1, 2], 2, False, True),
    "skip_one_line": ([0, 2, 3], 1, True, False),
    "skip_two_lines": ([0, 3, 4], 1, True, False),
    "jump_after_partial_line": ([0, BROKEN, 3, 4], 1, True, False),
    "unrelated_sentence": ([0, AWAY, 1], 1, True, False),
}
PAGE = [w.lower().strip(".,") for line in LINES for w in line.split()]
LINE_OF = [i for i, line in enumerate(LINES) for _ in line.split()]


def spoken(parts):
    return " ".join(LINES[p] if isinstance(p, int) else p for p in parts).replace("harbor", "harbour")


@pytest.mark.parametrize("window", (1, 2, 3))
@pytest.mark.parametrize("name", READINGS)
def test_nine_readings_of_a_page(name, window):
    parts, line, halts, back = READINGS[name]
    state, places = read(L.Reading(PAGE, LINE_OF), hear(spoken(parts)), window)
    assert state.halted == halts
    if halts:
        assert LINE_OF[state.cursor] == line
    else:
        assert state.cursor > max(k for k, x in enumerate(LINE_OF) if x == line) - 1
        assert back == any(p.event == "restart" for p in places)


def test_states_are_read_as_they_were_written():
    r = random.Random(1)
    for name in READINGS:
        said, reading, state = hear(spoken(READINGS[name][0])), L.Reading(PAGE, LINE_OF), L.State()
        for i, h in enumerate(said):
            state = reading.read(state, [h], i)[0]
            assert L.State.load(state.dump()) == state
            if state.halted and r.random() < 0.5:
                state = state.resumed()


HEARD = "session string, window long, seq long, text string, start double, end double, confidence double, resume boolean"


def table(window=3):
    rows = []
    for name in READINGS:
        rows += [(name, i // window, i, h.text, h.start, h.end, h.confidence, i // window % 4 == 3) for i, h in enumerate(hear(spoken(READINGS[name][0])))]
    return rows


def test_a_stream_is_the_batch_also_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = table()
    script = spark.createDataFrame([(name, PAGE, LINE_OF) for name in READINGS], "session string, words array<string>, lines array<int>")
    whole = sorted(tuple(r) for r in L.followed(spark.createDataFrame(rows, HEARD), script).collect())
    # "laughter" is a sound
    assert len(whole) == len(rows) - 1 and {"halted", "jump", "lost", "restart", "cue"} <= {r[4] for r in whole}
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (0, 1, 2):
        spark.createDataFrame([r for r in rows if min(r[1] // 3, 2) == part], HEARD).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(HEARD).option("maxFilesPerTrigger", 1).parquet(folder)
        query = L.follow_stream(stream, script).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(180)  # each part is a new run of the query from its checkpoint
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("session", "seq", "index", "cursor", "event").collect()) == whole


def test_sessions_in_rows_are_counted_alike(spark):
    said = {name: [tuple(h[:1]) + tuple(h[2:]) for h in hear(spoken(parts))] for name, (parts, *_) in READINGS.items()}
    kind = "name string, words array<string>, heard array<struct<text string, start double, end double, confidence double>>"
    rows = spark.createDataFrame([(k, PAGE, v) for k, v in said.items()] + [("none", None, None), ("silent", PAGE, [])], kind)
    for r in L.counted(spread(rows), "words", "heard").collect():
        reading, state, places = L.Reading(PAGE), L.State(), []
        words = hear(spoken(READINGS[r.name][0])) if r.name in READINGS else []
        for i in range(0, len(words), 3):
            state, more = reading.read(state.resumed() if state.halted else state, usable(words[i : i + 3]), i)
            places += more
        assert r.cursor == state.cursor and all(r[e] == sum(p.event == e for p in places) for e in L.EVENTS)
    assert L.counted(rows.limit(0), "words", "heard").count() == 0


def test_no_words_and_null_times(spark):
    rows = [("a", 0, 0, None, 0.0, 0.3, 0.9, None), ("a", 0, 1, "the", None, 0.7, 0.9, None), ("b", 0, 0, "the", 0.0, 0.3, None, None)]
    script = spark.createDataFrame([("a", SCRIPT, None)], "session string, words array<string>, lines array<int>")
    found = L.followed(spark.createDataFrame(rows, HEARD), script).collect()
    assert [(r.session, r.event) for r in found] == [("b", "miss")]
