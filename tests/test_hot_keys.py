"""Operators on one key of 200,000 rows, and against brute force on small ones."""

import random

import pytest
from pyspark.sql import functions as F

from inkstream.functions import respell
from inkstream.operators import books, decisions, live, structure
from inkstream.streaming import windows

HOT = 200_000


def plain_seat(segments, t):
    top = max(a for a, _, _ in segments)
    holders = [(a, s) for a, z, s in segments if a <= t < z or a == top and a <= t <= z]
    return min(holders)[1] if holders else min(segments, key=lambda x: (abs(x[0] - t), x[0]))[2]


def test_seats_are_those_of_a_search_of_all_segments(spark):
    r = random.Random(1)
    spoken, asked = [], []
    for k in range(40):
        starts = r.sample(range(60), r.randint(1, 9))
        spoken += [(k, float(a), a + r.choice([0.5, 3.0, 10.0, 25.0]), f"s{a}") for a in starts]
        asked += [(k, i, r.choice([r.randint(-3, 90), r.uniform(0, 80)]) * 1.0) for i in range(30)]
    found = live.seats_at(spark.createDataFrame(asked, "k int, i int, at double"), spark.createDataFrame(spoken, "k int, start double, end double, seat string"), ["k"], "at", "seat").collect()
    assert {(x.k, x.i): x.seat for x in found} == {(k, i): plain_seat([s[1:] for s in spoken if s[0] == k], t) for k, i, t in asked}


def test_no_one_speaks(spark):
    asked = spark.createDataFrame([(1, 2.0)], "k int, at double")
    assert [x.seat for x in live.seats_at(asked, spark.createDataFrame([], "k int, start double, end double, seat string"), ["k"], "at", "seat").collect()] == [None]


def hot(spark):
    return spark.range(HOT).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") * 1.0).alias("x"))


def test_a_hot_chapter_of_segments_and_pickups(spark):
    spoken = hot(spark).select("k", F.col("x").alias("start"), (F.col("x") + 0.75).alias("end"), F.concat(F.lit("s"), "i").alias("seat"))
    found = live.seats_at(hot(spark).select("k", "i", (F.col("x") + 0.5).alias("at")), spoken, ["k"], "at", "seat")
    assert found.where(F.col("seat") == F.concat(F.lit("s"), "i")).count() == HOT


def test_a_hot_chapter_of_clips(spark):
    rows = hot(spark).select("k", (F.col("x") * 3).alias("t_start"), (F.col("x") * 3 + 1).alias("t_end"))
    whole = books.clips(rows, ["k"], 2.0, 30.0).agg(F.sum("pickups").alias("n"), F.max("number").alias("m"), F.max(F.col("clip_end") - F.col("clip_start")).alias("longest")).first()
    clips, start, end, longest = 0, None, None, 0.0
    for i in range(HOT):
        a, z = max(0.0, i * 3.0 - 2), i * 3.0 + 3
        if start is not None and a <= end and z - start <= 30:
            end = max(end, z)
        else:
            clips, start, end = clips + 1, a, z
        longest = max(longest, end - start)
    assert (whole.n, whole.m, whole.longest) == (HOT, clips, longest)


def test_a_hot_document_of_sentences(spark):
    ranges = hot(spark).select("k", F.col("i").alias("sentence"), (F.col("i") * 3).cast("int").alias("first"), (F.col("i") * 3 + 2).cast("int").alias("last"))
    tokens = hot(spark).select("k", (F.col("i") * 3 + 1).cast("int").alias("token"))
    found = structure.line_ranges(ranges, tokens, "k", 1)
    assert found.where((F.col("token") - F.col("first")).isin(4, 1) & (F.col("last") - F.col("token")).isin(4, 1)).count() == HOT


def test_a_hot_session_of_levels_and_steps(spark):
    rows = hot(spark).withColumn("v", F.pmod("i", F.lit(97)) / 100)
    values = [i % 97 / 100 for i in range(HOT)]
    mean = 0.4
    for v in values:
        mean = mean * 0.7 + v * 0.3
    assert live.paces(rows, ["k"], ["i"], "v").first().pace == pytest.approx(mean)
    found = live.input_qualities(rows, ["k"], ["i"], "v").first()
    assert (found.peak, found.ambient, found.label) == (0.96, sorted(values[-64:])[int(63 * 0.25)], "noisy")


def test_a_pronouncing_dictionary_feeds_respellings(spark):
    lines = [";;; remark", "LEE  L IY1", "LEE(2)  L EY1", "Mary  M EH1 R IY0", "broken", ""]
    lexicon = structure.pronunciations(spark.createDataFrame(list(enumerate(lines)), "line int, value string"))
    assert sorted(tuple(x) for x in lexicon.collect()) == [("lee", "L IY1", 2), ("mary", "M EH1 R IY0", 1)]
    assert respell.suggested(spark.createDataFrame([("Mary Lee",)], "spelling string"), lexicon).first().respell == "MER-ee LEE"


def test_time_of_recording_and_counts_of_pickups(spark):
    kind = "s double, n double, p array<struct<start double, end double>>"
    rows = spark.createDataFrame([(10.0, 70.0, [(20.0, 30.0), (5.0, 12.0), (65.0, None)]), (10.0, 5.0, []), (0.0, 9.0, [(0.0, 20.0)])], kind)
    assert [x.t for x in rows.select(decisions.recording_seconds(F.col("s"), F.col("n"), F.col("p")).alias("t")).collect()] == [43.0, 0.0, 0.0]
    found = windows.pickup_counts(spark.createDataFrame([("a", "open"), ("a", "done"), ("a", "ignored"), ("b", "open")], "k string, status string"), ["k"])
    assert sorted(tuple(x) for x in found.collect()) == [("a", 1, 2), ("b", 1, 0)]
