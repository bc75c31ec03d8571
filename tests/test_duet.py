"""Two readers, better times and noise cleaning against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstream.operators import duet, signal
from inkstream.plans import live


def plain_mix(n1, n2, segments, rate, narrator, fade):
    mask, cross = [0] * len(n1), round(fade * rate)
    for start, end, seat in sorted(segments, key=lambda s: s[0]):
        seat = narrator if seat == "narration" else seat
        for i in range(math.floor(start * rate), min(len(n1), math.ceil(end * rate))):
            mask[i] = 2 if seat == "N2" else 1
    two = [m == 2 for m in mask]
    share = [float(t) for t in two]
    half = max(1, cross // 2)
    for i in range(1, len(two)) if cross else ():
        if two[i] != two[i - 1]:
            low, high = max(0, i - half), min(len(two) - 1, i + half)
            for k in range(low, high + 1):
                amount = (k - low) / max(1, high - low)
                share[k] = amount if two[i] else 1 - amount
    return [a * (1 - s) for a, s in zip(n1, share)], [b * s for b, s in zip(n2, share)]


@pytest.mark.parametrize("fade, narrator, size", [(0.02, "N1", 50), (0.13, "N2", 16), (0.0, "N1", 64), (0.3, "N1", 8)])
def test_a_mix_is_that_of_a_plain_loop_whatever_the_chunks(spark, fade, narrator, size):
    r = random.Random(size)
    files, rows, told = {}, [], []
    for f in ("a", "b", "quiet"):
        n = r.randint(150, 260)
        n1, n2 = ([r.uniform(-1, 1) for _ in range(n)] for _ in range(2))
        segments = [(s := round(r.uniform(0, n / 100), 3), round(s + r.uniform(0.01, 0.6), 3), r.choice(["N1", "N2", "narration"])) for _ in range(0 if f == "quiet" else 9)]
        files[f] = n1, n2, segments
        rows += [(f, k, n, n1[k * size : (k + 1) * size], n2[k * size : (k + 1) * size]) for k in range(-(-n // size))]
        told += [(f, *s) for s in segments] + [(f, 1.0, 0.5, "N2"), (f, 0.1, 0.2, "N9")]
    tracks = spark.createDataFrame(rows, "f string, chunk long, length long, n1 array<double>, n2 array<double>").repartition(4)
    found = duet.mixed(tracks, spark.createDataFrame(told, "f string, start double, end double, seat string"), ["f"], 100, size, narrator, fade).collect()
    for f, (n1, n2, segments) in files.items():
        mine = sorted((x for x in found if x.f == f), key=lambda x: x.chunk)
        mix, first, second = (np.concatenate([x[c] for x in mine]) for c in ("mix", "first", "second"))
        a, b = plain_mix(n1, n2, segments, 100, narrator, fade)
        assert np.allclose(first, a) and np.allclose(second, b) and np.allclose(mix, first + second)


def test_spans_share_out_what_was_heard(spark):
    heard = [(0.5 * i, 0.5 * i + 0.4) for i in range(10)]
    kind = "f string, at int, seat string, tokens int, heard array<struct<start double, end double>>, duration double"
    rows = [("a", 0, "N1", 3, heard, 4.2), ("a", 1, "N2", 0, heard, 4.2), ("a", 2, "N2", 2, heard, 4.2), ("a", 3, "N1", 5, heard, 4.2), ("b", 0, "N1", 1, [(1.0, 1.0)], 8.0), ("b", 1, "N2", 3, None, 8.0), ("c", 0, "N1", 2, heard, 0.0)]
    found = {(r.f, r.at): (r.start, r.end) for r in duet.span_times(spark.createDataFrame(rows, kind), ["f"], "at").collect()}
    assert found == {("a", 0): (0.0, 1.4), ("a", 2): (1.5, 2.4), ("a", 3): (2.5, 4.2), ("b", 0): (0.0, 2.0), ("b", 1): (2.0, 8.0)}


def test_times_are_refined_for_a_whole_chapter_or_not_at_all(spark):
    base = [(c, i, f"w{i}", float(i), i + 0.5, 0.9) for c in ("good", "few", "falls") for i in range(10)] + [("good", 10, "x", None, None, 0.9)]
    later = [(c, i, i + 0.1, i + 0.4) for c, n in (("good", 8), ("few", 7)) for i in range(n)] + [("falls", i, 0.2 if i == 4 else i + 0.1, i + 0.4) for i in range(10)]
    found = duet.refined(spark.createDataFrame(base, "c string, token_index int, written string, start double, end double, confidence double"), spark.createDataFrame(later, "c string, token_index int, start double, end double"), ["c"]).collect()
    by = {(r.c, r.token_index): r for r in found}
    assert len(by) == 30 and {r.c for r in found if r.adopted} == {"good"} and by["few", 0].coverage == 0.7
    assert (by["good", 3].start, by["good", 3].confidence, by["good", 9].start, by["good", 9].confidence) == (3.1, None, 9.0, 0.9)
    assert by["falls", 4].start == 4.0 and by["few", 1].confidence == 0.9


def plain_check(a, b, size, floor):
    active = altered = row = 0
    for i in range(0, len(a), size):
        x, y = np.array(a[i : i + size]), np.array(b[i : i + size])
        if np.isnan(y).any() or (np.abs(y) > 1.0001).any():
            return False
        before, after, dot = (x * x).sum(), (y * y).sum(), (x * y).sum()
        level = 10 * math.log10(max(before / len(x), 1e-20))
        if level < floor + 10:
            row = 0
            continue
        active += 1
        change, like = 10 * math.log10(max(after, 1e-20) / max(before, 1e-20)), dot / math.sqrt(max(before * after, 1e-30))
        strong = level >= floor + 18
        bad = change < (-3 if strong else -6) or change > 0.5 or like < (0.98 if strong else 0.9)
        altered, row = altered + bad, row + 1 if bad else 0
        if row >= 5:
            return False
    return active > 0 and altered / active <= 0.02


def test_cleaning_is_checked_frame_by_frame(spark):
    r, size = np.random.default_rng(1), 10
    voice = r.normal(0, 0.1, 1200) * np.repeat(np.tile([1, 1, 1, 0.001], 30), 10)
    cases = {"same": voice, "softer": voice * 0.9, "gone": voice * 0.1, "turned": -voice, "louder": voice * 1.2, "nan": np.where(np.arange(1200) == 7, np.nan, voice), "over": np.where(np.arange(1200) == 7, 1.5, voice)}
    cases["one frame"] = np.where((np.arange(1200) >= 40) & (np.arange(1200) < 50), 0, voice)
    cases["five in a row"] = np.where((np.arange(1200) >= 40) & (np.arange(1200) < 100), voice * 0.2, voice)
    rows = [(name, i, float(v), float(w)) for name, y in cases.items() for i, (v, w) in enumerate(zip(voice, y))]
    framed = signal.cleaned_frames(spark.createDataFrame(rows, "f string, i int, a double, b double"), ["f"], "i", "a", "b", size)
    floors = spark.createDataFrame([(name, -60.0) for name in cases], "f string, floor_db double")
    found = {x.f: x.safe for x in signal.cleaning_check(framed, floors, ["f"]).collect()}
    assert found == {name: plain_check(voice, y, size, -60.0) for name, y in cases.items()} and found["same"] and found["one frame"] and not found["gone"]


def test_attempts_at_cleaning(spark):
    rows = spark.createDataFrame([(-58.0,), (-40.0,), (-90.0,), (float("-inf"),)], "p double")
    assert [x.a for x in rows.select(signal.cleaning_attempts(F.col("p"), -60.0).alias("a")).collect()] == [[4, 12], [12], [4, 12], [12]]


def plain_refined(base, later):
    """Words of a chapter as [index, start, end, confidence], whether their new times are taken, and how many have one."""
    ok = lambda s, e: s is not None and e is not None and not math.isnan(s) and e >= s
    words = [(i, s, e, p, later[i] if ok(*later[i]) else None) for i, (s, e, p) in enumerate(base) if ok(s, e)]
    starts = [x[0] if x else s for _, s, _, _, x in words]
    share = sum(x is not None for *_, x in words) / len(words) if words else 0
    taken = share >= 0.8 and all(a <= b for a, b in zip(starts, starts[1:]))
    return [(i, *((*x, None) if taken and x else (s, e, p)), taken, share) for i, s, e, p, x in words]


def test_f21_chapters_in_rows_are_refined_as_their_words_are(spark):
    r, nan = random.Random(7), float("nan")
    chapters, expected = {}, {}
    for c in range(60):
        n, gaps = r.choice([0, 1, 5, 12]), r.choice([0, 0, 0.1, 0.4])
        odd = lambda s, e: r.choice([(None, e), (nan, e), (s, None), (e, s)])
        base = [(*(odd(i, i + 0.5) if r.random() < 0.05 else (float(i), i + 0.5)), 0.9) for i in range(n)]
        later = [(None, None) if (x := r.random()) < gaps else odd(i + 0.1, i + 0.4) if x > 0.97 else (i + 0.1 - (3 if r.random() < 0.02 else 0), i + 0.4) for i in range(n)]
        chapters[c], expected[c] = (base, later), plain_refined(base, later)
    rows = [(c, [f"w{i}" for i in range(len(b))], *([[float(x) if x is not None else None for x in column] for column in zip(*b)] or [[], [], []]), *([[float(x) if x is not None else None for x in column] for column in zip(*z)] or [[], []])) for c, (b, z) in chapters.items()]
    arrays = spark.createDataFrame(rows, "c int, written array<string>, start array<double>, end array<double>, confidence array<double>, later_start array<double>, later_end array<double>")
    want = sorted((c, i, f"w{i}", s, e, p, taken, share) for c, found in expected.items() for i, s, e, p, taken, share in found)
    assert sorted(tuple(x) for x in duet.refined_chapters(arrays, ["c"]).collect()) == want and {x[6] for x in want} == {True, False}
    words = lambda columns: arrays.select("c", F.posexplode(F.arrays_zip("written", *columns)).alias("token_index", "w")).select("c", "token_index", "w.written", *[F.col(f"w.{x}").alias(x.removeprefix("later_")) for x in columns])
    aligned = words(["later_start", "later_end"]).drop("written").where("start is not null")
    rows_of = duet.refined(words(["start", "end", "confidence"]), aligned, ["c"])
    assert sorted(tuple(x) for x in rows_of.collect()) == want
    assert "Join" not in rows_of._jdf.queryExecution().executedPlan().toString()


def test_f21_words_of_timelines_are_not_dealt(spark, small):
    plan = live.refined_timelines(spark, small)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("partial_sum", 1)[0]  # only sums of a document travel, and the texts where a file has few splits
    assert above.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning") == 1
    assert "Window" not in plan and "Join" not in plan and plan.count("regexp_extract_all") == 1
