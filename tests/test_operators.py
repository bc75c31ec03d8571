"""Operators on small inputs with known results."""

import io
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstream.functions.levels import dbfs, format_db, range_status, rms
from inkstream.functions.text import spoken_pieces, stable_id
from inkstream.functions.timecode import minutes_seconds, subtitle_time
from inkstream.operators import proof, signal, structure
from inkstream.sources import files


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_differing_runs_are_shortest_scripts():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in "ab")
        i = j = gone = 0
        for i0, i1, j0, j1 in proof.differing_runs(a, b):
            assert a[i:i0] == b[j:j0]
            i, j, gone = i1, j1, gone + i1 - i0
        assert a[i:] == b[j:] and gone == len(a) - common(a, b)


CASES = [
    ("My uncle kept bees behind the mill.", "My uncle kept bees beside the mill", [("sub", "behind", "beside")]),
    ("Rain fell. Both ships were late. Nobody minded.", "Rain fell Nobody minded", [("skip", "Both ships were late", "")]),
    ("A candle burned.", "A tall candle burned", [("insert", "", "tall")]),
    ("Élan für Zoë.", "elan fur zoe", []),
    ("Red green", "", [("skip", "Red green", "")]),
]


@pytest.mark.parametrize("written, said, expected", CASES)
def test_alignment(spark, written, said, expected):
    heard = [(w, 0.1 + 0.4 * i, 0.4 + 0.4 * i, 0.9) for i, w in enumerate(said.split())]
    rows = spark.createDataFrame([(1, written, heard)], "doc_id long, text string, heard array<struct<text:string,start:double,end:double,confidence:double>>")
    found = proof.align(rows.select("doc_id", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0).alias("tokens"), "heard")).collect()
    assert [(r.kind, r.expected, r.heard) for r in found] == expected
    assert all(r.t_end >= r.t_start for r in found)


def test_suppression_and_confidence(spark):
    rows = spark.createDataFrame([(1, "sub", "um", "er", 0.9), (2, "insert", "", "um um", 0.9), (3, "pause", "um", "", None), (4, "sub", "um on", "in", 0.1)], "id int, kind string, expected string, heard string, confidence double")
    assert {r.id for r in proof.unsuppressed(rows, ["um"]).collect()} == {3, 4}
    assert {r.id for r in proof.confident(rows, 0.4).collect()} == {1, 2, 3}


def test_chapters(spark):
    text = "Contents\nChapter 1\nChapter 2\n\nfront words here\n# Chapter 1\none two\nthree\nChapter II The end\nfour\n"
    rows = structure.split_chapters(spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id long, text string")).orderBy("doc_id", "chapter").collect()
    titled = [(r.title, r.words) for r in rows if r.doc_id == 1]
    assert ("Chapter 1", 3) in titled and ("Chapter II The end", 1) in titled
    assert [(r.chapter, r.words) for r in rows if r.doc_id == 2] == [(0, 0)] and [r.words for r in rows if r.doc_id == 3] == [1]


def test_levels_and_timecodes(spark):
    row = spark.range(1).select(
        dbfs(rms(F.array(*[F.lit(0.1)] * 8))).alias("a"), dbfs(F.lit(0.0)).alias("b"), format_db(F.lit(-3.25)).alias("c"), range_status(F.lit(-20.0), F.lit(-23.0), F.lit(-18.0)).alias("d"),
        minutes_seconds(F.lit(3661.5)).alias("e"), subtitle_time(F.lit(61.0625)).alias("f"), stable_id(F.lit("a"), F.lit("b")).alias("g"),
    ).first()
    assert abs(row.a + 20) < 1e-9 and row.b == -math.inf and row.c == "−3.3 dBFS" and row.d == "pass"
    assert row.e == "1:01:01.500" and row.f == "00:01:01,063"
    assert row.g == fnv("a|b")


def fnv(text):
    h, units = 0x811C9DC5, text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = (h ^ int.from_bytes(units[i : i + 2], "little")) * 0x01000193 % 2**32
    return f"{h:08x}"


def test_ids_are_over_utf_16_units(spark):
    texts = ["", "é", "日本", "a🙂b", "x" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", stable_id(F.col("t"), F.lit(1)).alias("id")).collect()
    assert {r.t: r.id for r in rows} == {t: fnv(f"{t}|1") for t in texts}


def test_pauses_stay_and_nothing_is_merged_across_them(spark):
    rows = [(1, "sub", "a", "b", 0.0, 1.0, 0.9), (1, "pause", "Pause", "", 5.0, 9.0, 0.5), (1, "skip", "c", "", 9.1, 9.2, 0.8), (1, "insert", "", "d", 9.3, 9.4, 0.7)]
    pickups = spark.createDataFrame(rows, "doc_id long, kind string, expected string, heard string, t_start double, t_end double, confidence double")
    found = [(r.kind, r.expected, r.heard, r.t_start, r.t_end, r.pickups) for r in proof.merged(pickups, ["doc_id"], 10.0).orderBy("t_start").collect()]
    assert found == [("sub", "a", "b", 0.0, 1.0, 1), ("pause", "Pause", "", 5.0, 9.0, 1), ("sub", "c", "d", 9.1, 9.4, 2)]


def test_edges_warn_at_the_edge(spark):
    row = spark.range(1).select(*[range_status(F.lit(x), F.lit(-23.0), F.lit(-18.0)).alias(n) for n, x in (("a", -22.5), ("b", -22.4), ("c", -18.5), ("d", -23.1))]).first()
    assert tuple(row) == ("warn", "pass", "warn", "fail")


def test_spoken_pieces_have_no_marks(spark):
    row = spark.createDataFrame([("Café-Noël ’tis",)], "t string").select(spoken_pieces(F.col("t")).alias("p")).first()
    assert row.p == ["cafe", "noel", "tis"]


def test_loudness_of_a_sine(spark):
    rate = 8000
    x = np.sin(2 * np.pi * 997 * np.arange(rate * 2) / rate) * 0.1
    rows = spark.createDataFrame([(x.tolist(), rate), ([0.0] * rate, rate)], "x array<double>, rate int").withColumn("p", signal.block_powers("x", "rate"))
    loud, silent = [r[0] for r in rows.select(signal.integrated_lufs(F.col("p"))).collect()]
    assert abs(loud + 23.0) < 0.15 and silent == -math.inf


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿one\r\ntwo\rthree".encode("utf-16-le"))
    assert files.text_files(spark, str(tmp_path / "*.txt")).first().text == "one\ntwo\nthree"
    w = files.WORD_NS.strip("{}")
    doc = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Kept</w:t><w:tab/></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:p><w:r><w:t>Next</w:t></w:r></w:p></w:body></w:document>'
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", doc)
    (tmp_path / "a.docx").write_bytes(packed.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    rows = {r.path[-6:]: r for r in files.docx_files(spark, str(tmp_path / "*.docx")).collect()}
    assert rows["a.docx"].text == "Kept\t\nNext" and rows["b.docx"].error
    (tmp_path / "a.wav").write_bytes(files.wav_bytes(np.array([0.0, 0.5, -1.0, np.nan]), 4))
    frames = files.wav_frames(spark, str(tmp_path / "*.wav"), 0.5).orderBy("frame").collect()
    assert [len(f.samples) for f in frames] == [2, 2] and abs(frames[0].samples[1] - 0.5) < 1e-4
