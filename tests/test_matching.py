"""Units of matching, retakes, peaks between samples, e-books."""

import io
import zipfile

import numpy as np
import pytest

from inkstream.functions.units import match_units, units
from inkstream.operators import proof, signal
from inkstream.sources import files


@pytest.mark.parametrize(
    ("spoken", "keys"),
    [
        ("nineteen ninety nine", ["1999"]),
        ("one thousand nine hundred and ninety-nine", ["1999"]),
        ("nineteen oh five", ["1905"]),
        ("one three", ["1", "3"]),
        ("one and three dogs", ["1", "3", "dogs"]),
        ("and one", ["and", "1"]),
        ("one and a half", ["1", "and", "a", "half"]),
        ("twenty-first of June", ["21#ord", "of", "june"]),
        ("21st of 007", ["21#ord", "of", "7"]),
        ("two million three hundred thousand and five", ["2300005"]),
        ("a hundred", ["a", "100"]),
        ("twenty one hundred", ["2100"]),
        ("ten five", ["15"]),
        ("nineteen eleven twelve", ["19", "1112"]),
        ("oh and five", ["0", "and", "5"]),
        ("thousandth", ["1000#ord"]),
        ("Café naïve", ["cafe", "naive"]),
        ("", []),
    ],
)
def test_numbers_and_words_become_keys(spoken, keys):
    assert [k for k, _, _ in units(spoken.split())] == keys


def test_units_point_at_their_tokens_and_take_classes(spark):
    assert units(["in", "twenty-one", "hundred", "—", "see"], {"see": "sea"}) == [("in", 0, 0), ("2100", 1, 2), ("sea", 4, 4)]
    found = spark.createDataFrame([(["See"],), (None,), ([],)], "w array<string>").select(match_units("w", {"see": "sea"}).alias("u")).collect()
    assert [[tuple(u) for u in r.u] for r in found] == [[("sea", 0, 0)], [], []]


def heard(text, confidence=None, step=0.5):
    return [(w, i * step, i * step + 0.4, confidence) for i, w in enumerate(text.split())]


WORDS = "array<struct<text string, start double, end double, confidence double>>"


def test_folded_alignment_leaves_only_what_differs(spark):
    rows = [(1, "In 1999 he left the old house".split(), heard("in nineteen ninety nine he left the house")), (2, "All 21 rows".split(), heard("all twenty-one rows")), (3, "Gone".split(), [])]
    found = proof.align(spark.createDataFrame(rows, f"doc_id long, tokens array<string>, heard {WORDS}"), fold=True).orderBy("doc_id").collect()
    assert [(r.doc_id, r.kind, r.expected, r.heard, r.i0, r.i1, r.j0, r.j1) for r in found] == [(1, "skip", "old", "", 5, 6, 7, 7), (3, "skip", "Gone", "", 0, 1, 0, 0)]


def test_retakes_are_verified(spark):
    rows = [
        (1, "He left in 1999.", heard("he left in nineteen ninety nine", 0.1)),
        (2, "He left the house", heard("he left a house", 0.9)),
        (3, "He left the house", heard("he left a house", 0.2)),
        (4, "", heard("x")),
        (5, None, None),
        (6, "a b", heard("a b c d e f g h i j")),
        (7, "go go go", heard("go go")),
    ]
    found = {r.k: (r.status, r.expected_excerpt, r.heard_excerpt) for r in proof.verified(spark.createDataFrame(rows, f"k int, text string, heard {WORDS}")).collect()}
    assert found == {
        1: ("match", None, None), 2: ("mismatch", "the", "a"), 3: ("inconclusive", None, None), 4: ("inconclusive", None, None),
        5: ("inconclusive", None, None), 6: ("mismatch", "", "c d e f g h"), 7: ("mismatch", "go", ""),
    }


def peak_by_definition(x, factor=4, radius=16):
    top = max(map(abs, x), default=0.0)
    for i in range(len(x) - 1):
        for p in range(1, factor):
            at = [(j, i + p / factor - j) for j in range(max(0, i - radius + 1), min(len(x) - 1, i + radius) + 1)]
            taps = [(j, np.sinc(d) * (0.5 + 0.5 * np.cos(np.pi * d / radius)) if abs(d) < radius else 0.0) for j, d in at]
            top = max(top, abs(sum(x[j] * t for j, t in taps) / sum(t for _, t in taps)))
    return top


def test_true_peak_is_the_interpolated_one():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 31, 32, 33, 90):
        x = r.uniform(-1, 1, n)
        assert signal.true_peak(x) == pytest.approx(peak_by_definition(list(x)), abs=1e-12)
    assert signal.true_peak(np.sin(np.pi / 2 * np.arange(400) + np.pi / 4)) == pytest.approx(1.0, abs=0.02)


def test_repair_must_be_local(spark):
    base = [0.1] * 100
    rows = [(1, base, [0.101] + base[1:]), (2, base, [0.2] * 100), (3, base, base[1:]), (4, base, [float("nan")] + base[1:]), (5, [], []), (6, None, base)]
    frame = spark.createDataFrame(rows, "k int, a array<double>, b array<double>")
    found = {r.k: r.r.accepted for r in frame.select("k", signal.repair_check(frame.a, frame.b).alias("r")).collect()}
    assert found == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def book(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


PACKAGE = """<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="text/b%20c.xhtml"/><item id="a" href="a.xhtml"/></manifest>
<spine><itemref idref="b"/><itemref idref="a"/><itemref idref="missing"/></spine></package>"""


def test_e_books_are_read_in_spine_order(spark, tmp_path):
    pages = {"OPS__text__b c_dot_xhtml": "<html><head><title>no</title></head><body><h1>One &amp; two</h1><p>A  long\nline<br/>next</p><script>x</script></body></html>", "OPS__a_dot_xhtml": "<body><p>Last</p></body>"}
    container = '<container xmlns="c"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'
    (tmp_path / "good.epub").write_bytes(book(**{"META-INF__container_dot_xml": container, "OPS__book_dot_opf": PACKAGE}, **pages))
    (tmp_path / "bad.epub").write_bytes(b"nothing")
    (tmp_path / "out.epub").write_bytes(book(**{"book_dot_opf": PACKAGE.replace("a.xhtml", "../a.xhtml")}))
    found = {r.path.rsplit("/")[-1]: r for r in files.epub_files(spark, str(tmp_path)).collect()}
    assert found["good.epub"].text == "One & two\nA long line\nnext\n\nLast"
    assert found["bad.epub"].text is None and found["bad.epub"].error
    assert "not a link" in found["out.epub"].error
