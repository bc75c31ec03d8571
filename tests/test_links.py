"""Respelling, names in scripts and slices of styled spans against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkstream.functions import respell as R
from inkstream.operators import links


def plain_respell(phones):
    parsed = []
    for p in phones.split():
        m = re.fullmatch(r"([A-Za-z]+)([0-2])?", p)
        if not m or m[1].upper() not in R.VOWELS | R.CONSONANTS:
            return None
        parsed.append((m[1].upper(), int(m[2] or 0)))
    at = [i for i, (p, _) in enumerate(parsed) if p in R.VOWELS]
    if not at:
        return None
    legal, starts = set(R.ONSETS.split(",")), [0]
    for v, w in zip(at, at[1:]):
        cluster = [p for p, _ in parsed[v + 1 : w]]
        size = min(3, len(cluster))
        while size > 1 and " ".join(cluster[-size:]) not in legal:
            size -= 1
        if len(cluster) == 1 and parsed[v][1] == 1 and parsed[v][0] in R.CHECKED:
            size = 0
        starts.append(w - size)
    mark = 1 if any(parsed[v][1] == 1 for v in at) else 2
    out = []
    for a, z, v in zip(starts, [*starts[1:], len(parsed)], at):
        text = "".join((R.VOWELS | R.CONSONANTS)[p] for p, _ in parsed[a:z])
        out.append(text.upper() if parsed[v][1] == mark else text)
    return "-".join(out)


def test_respelling_is_that_of_a_plain_loop(spark):
    r = random.Random(1)
    cases = ["L IY1 OW0 M IH2 N S T ER0", "M EH1 R IY0", "", "  ", "B R", "Q AH0", "AH", "iy1 ow0", "S T R IH1 NG", "AO1 AO2", "L1 IY1"]
    cases += [" ".join(r.choice([v + r.choice("012") for v in R.VOWELS] + [*R.CONSONANTS] * 2) for _ in range(r.randint(1, 12))) for _ in range(500)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([*cases, None])], "i int, p string")
    found = {x.i: x.s for x in rows.select("i", R.respelt(F.col("p")).alias("s")).collect()}
    assert found.pop(len(cases)) is None and found[0] == "LEE-oh-min-ster" and found[1] == "MER-ee"
    assert found == {i: plain_respell(c) for i, c in enumerate(cases)}


def test_suggestions_need_every_part(spark):
    lexicon = spark.createDataFrame([("mary", "M EH1 R IY0"), ("lee", "L IY1"), ("lee", "M IY1"), ("odd", "Q")], "word string, phones string")
    names = spark.createDataFrame([("Mary-Lee",), ("“Mary”",), ("Mary Poppins",), ("",), (None,), ("odd",), ("Mary-Lee",)], "spelling string")
    found = [(x.spelling, x.respell) for x in R.suggested(names, lexicon).collect()]
    assert len(found) == 7 and dict(found) == {"Mary-Lee": "MER-ee LEE", "“Mary”": "MER-ee", "Mary Poppins": None, "": None, None: None, "odd": None}


def plain_links(text, glossary):
    text = text or ""
    by = {}
    for id_, spelling, source in sorted(glossary, key=lambda g: (g[2] != "user", g[0])):
        if re.search(r"[^\W_]", spelling):
            by.setdefault(spelling.strip().lower(), id_)
    letter = lambda c: bool(re.match(r"[^\W_]", c))
    found = []
    for word, id_ in by.items():
        for i in range(len(text) - len(word) + 1):
            z = i + len(word)
            if text.lower()[i:z] == word and not (i and letter(text[i - 1])) and not (z < len(text) and letter(text[z])):
                found.append((i, -z, id_))
    pieces, end = [], 0
    for start, less, id_ in sorted(found):
        if start >= end:
            pieces += [(text[end:start], None)] * (start > end) + [(text[start:-less], id_)]
            end = -less
    return pieces + [(text[end:], None)] * (end < len(text) or not text)


def test_names_are_linked_leftmost_and_longest(spark):
    r = random.Random(2)
    glossary = [("1", "Ann", "auto"), ("2", "Ann Lee", "auto"), ("3", "lee of York", "user"), ("4", "O'Neil", "auto"), ("5", "ann", "user"), ("6", "'tis", "auto"), ("7", "--", "auto"), ("8", "York (old)", "auto"), ("9", "élan", "auto"), ("10", "of", "auto")]
    bits = ["Ann", "ann", "LEE", "of", "York", "(old)", "O'Neil", "O", "Neil", "'tis", "tis", "Élan", "élans", "--", "Annie", "x1", "é"]
    texts = ["".join(w + r.choice([" ", " ", ", ", "-", ""]) for w in r.choices(bits, k=r.randint(0, 14))) for _ in range(200)] + ["", None, "Ann Lee of York", "Ann", "(Ann)"]
    spans = spark.createDataFrame([("d", i, t, "bold") for i, t in enumerate(texts)], "doc string, at int, text string, style string")
    rows = links.linked(spans, spark.createDataFrame(glossary, "id string, spelling string, source string"), ["doc", "at"]).collect()
    by = {}
    for x in sorted(rows, key=lambda x: (x.at, x.piece)):
        assert x.style == "bold" and (texts[x.at] or "")[x.start : x.start + len(x.text)] == x.text
        by.setdefault(x.at, []).append((x.text, x.glossary_id))
    assert by == {i: plain_links(t, glossary) for i, t in enumerate(texts)}


def test_no_glossary_and_no_spans(spark):
    spans = spark.createDataFrame([(1, "Ann"), (2, None)], "at int, text string")
    none = spark.createDataFrame([], "id string, spelling string, source string")
    assert sorted((x.at, x.text, x.glossary_id) for x in links.linked(spans, none, ["at"]).collect()) == [(1, "Ann", None), (2, "", None)]
    assert links.linked(spans.limit(0), none, ["at"]).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_slices_keep_styles(spark, seed):
    r = random.Random(seed)
    spans = [(d, i, "".join(r.choices("ab cé", k=r.randint(0, 6))), r.choice(["b", "i", None])) for d in (1, 2) for i in range(25)]
    ranges = [(d, k, a := r.randint(0, 60), a + r.randint(-3, 40)) for d in (1, 2, 3) for k in range(6)]
    found = {}
    for x in links.sliced(spark.createDataFrame(spans, "d int, i int, text string, style string"), ["d"], "i", spark.createDataFrame(ranges, "d int, range int, start int, end int"), ["style"]).collect():
        found.setdefault((x.d, x.range), {})[x.at] = (x.text, x.style)
    for d, k, a, z in ranges:
        letters = [(c, s) for dd, _, t, s in spans if dd == d for c in t][a : max(a, z)]
        plain = []
        for c, s in letters:
            if plain and plain[-1][1] == s:
                plain[-1] = (plain[-1][0] + c, s)
            else:
                plain.append((c, s))
        assert [x for _, x in sorted(found.get((d, k), {}).items())] == plain


def test_a_word_that_begins_many_names_is_not_compared_with_each(spark):
    n = 400
    glossary = spark.createDataFrame([(str(i), f"the n{i}", "auto") for i in range(n)], "id string, spelling string, source string")
    spans = spark.createDataFrame([(1, " ".join(f"the n{i}" for i in range(0, n, 2)) + " the other")], "at int, text string")
    found = links.matches(spans, glossary, ["at"])
    assert {x.id for x in found.collect()} == {str(i) for i in range(0, n, 2)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert [line.count("core#") for line in joins if "core#" in line] == [2] and not any("first#" in line for line in joins)
