"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from inkstream.llm import chunks, phrases
from tests.llm.test_text_operators import ODD

UPPER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(rows, least=10, longest=3, share=50, first=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang or "und", tuple(words[i : i + size])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    dropped = {(lang, p[i : i + s]) for (lang, p), b in found.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) if 100 * b >= share * f[lang, p[i : i + s]]}
    out = []
    for lang in n:
        mine = []
        for (code, p), a in found.items():
            if code == lang and (code, p) not in dropped:
                score, _, left, right = min((1_000_000 * a * a // (f[code, p[:k]] * f[code, p[k:]]), k, f[code, p[:k]], f[code, p[k:]]) for k in range(1, len(p)))
                mine.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(mine)[:first])]
    return sorted(out)


def found(spark, rows, **bounds):
    docs = spark.createDataFrame([(t, c, "x", 1, 2, 3) for c, t in rows], "text string, lang string, phrase string, n int, a int, shard int").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(docs, **bounds).collect())


def some(seed, size, vocabulary=25):
    r = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "a'b", "日本", " ", *[f"w{i}" for i in range(vocabulary)]]
    weights = [1 / (i + 1) for i in range(len(words))]
    signs = [" "] * 12 + [". ", ", ", "\t", "\n", "  ", "\r\n", ";"]
    return [(r.choice(["en", "en", "en", "de", None, "und", "x\ny"]), "".join(w + r.choice(signs) for w in r.choices(words, weights, k=r.randint(0, 90)))) for _ in range(size)]


@pytest.mark.parametrize("bounds", ((1_500_000, 1_500_000), (400, 60)))
def test_phrases_are_those_of_a_plain_count(spark, monkeypatch, bounds):
    monkeypatch.setattr(phrases, "CHUNK", bounds[0])
    monkeypatch.setattr(phrases, "SHARD", bounds[1])
    rows = [*some(1, 250), *[("en", t) for t in ODD], *[(None, "many many many many")] * 30, ("en", "in a hot place " * 20_000)]
    expected = plain(rows)
    assert len(expected) > 100 and {len(p.split(" ")) for _, _, p, *_ in expected} == {2, 3}
    assert found(spark, rows) == expected
    assert found(spark, rows, least=4, words=4, share=80, first=17) == plain(rows, 4, 4, 80, 17)


def test_no_rows_no_words_and_nothing_frequent(spark):
    assert found(spark, []) == found(spark, [("en", ""), (None, None), ("de", " . ,\n")]) == found(spark, [("en", "one two three")]) == []


def test_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("lang", "text").collect()
    assert sorted(tuple(r) for r in phrases.op13_collocations(spark, small).collect()) == plain([(r.lang, r.text) for r in docs])


def test_a_product_may_pass_64_bits():
    a = 3_000_000_000
    assert 1_000_000 * a * a > 2**64
    chunk = phrases.Chunk.__new__(phrases.Chunk)
    chunk.n, chunk.langs, chunk.lang_of, chunk.words = 2, ["en"], np.array([0, 0]), [type("W", (), {"as_py": lambda self, w=w: w})() for w in ("x", "y")]
    level = lambda positions, totals: type("L", (), {"lists": phrases.Lists(np.ones(len(positions), int), np.array(positions)), "frequent": np.ones(len(positions), bool), "owned": np.ones(len(positions), bool), "total": np.array(totals)})()
    chunk.levels = [level([0, 1], [a + 7, a]), level([1], [a])]
    assert list(chunk.candidates(50)) == [("en", "x y", a, a + 7, a, 1_000_000 * a * a // ((a + 7) * a), False)]


def test_long_texts_are_parted_at_ends_of_pieces(monkeypatch):
    text = b"One two. three\tFOUR, five " * 50
    whole = [t for part in phrases.parted(text) for t in part]
    monkeypatch.setattr(phrases, "STEP", 40)
    parts = list(phrases.parted(text))
    assert len(parts) > 5 and [t for part in parts for t in part] == whole
    assert all(a[-1] == b"\n" for a, _ in pairwise(parts))


def test_answers_are_read_as_they_were_written():
    r = np.random.default_rng(1)
    for n in (0, 1, 9, 300):
        frequent, owned = r.random(n) < 0.4, r.random(n) < 0.5
        m = int(frequent.sum())
        ids, totals = r.integers(0, 2**32, m), r.integers(0, 2**50, m)
        back = phrases.opened(phrases.sealed(frequent, owned, ids, totals), n)
        assert all(np.array_equal(a, b) for a, b in zip(back, (frequent, owned, ids, totals)))
    assert chunks.unpacked(chunks.packed(np.arange(5)), np.int64, 5).tolist() == [0, 1, 2, 3, 4]
