import random

import numpy as np
import pyarrow as pa

from inkstream.functions import wordclass
from inkstream.functions.text import _normal
from inkstream.functions.vocabulary import Vocabulary, sketches
from inkstream.operators import proof
from inkstream.streaming import follow
from inkstream.streaming.recheck import Heard, usable

WORDS = "the of and seven 7 colour color letter ladder grey gray programme program realised realized travelled traveled twenty centre center again sorry thanks blank don't dont naïve o'er".split()


def made_up(r, n):
    return ["".join(r.choices("antheiors", k=r.randint(1, 11))) for _ in range(n)]


def slipped(r, word):
    at = r.randrange(max(1, len(word)))
    return word[:at] + r.choice(["", "x", word[at : at + 1] * 2, "a"]) + word[at + 1 :]


def test_words_are_at_least_half_as_many_edits_apart_as_sketches_have_bits():
    r = random.Random(1)
    for a in WORDS + made_up(r, 300):
        b = a
        for _ in range(r.randint(1, 3)):
            b = slipped(r, b) or "a"
        x, y = sketches([a, b]).tolist()
        assert (x ^ y).bit_count() <= 2 * wordclass.distance(a, b)
    assert sketches(["", "", "é", "\ud800"]).tolist()[:2] == [0, 0]


def test_places_leave_out_no_word_that_fits():
    r, known = random.Random(2), Vocabulary()
    page = [w.replace("'", "") for w in WORDS] + made_up(r, 200)
    page += [slipped(r, slipped(r, w)) for w in page]
    places = follow.Places(known, known.add(page))
    known.add(heard := [w for w in page if w] + [slipped(r, w) or "a" for w in page if w])
    left, asked = 0, 0
    for w in heard:
        found = set(places.maybe(w, 5, 400))
        assert {k for k in range(5, min(400, len(page))) if follow._fits(w)[page[k]]} <= found
        left, asked = left + len(found), asked + 395
    assert left < asked / 5


def test_words_are_encoded_by_their_normal_forms():
    known = Vocabulary()
    distinct, (page, said), ids = known.encoded(pa.array(["The", "É", None, "7", "x'Y"]), pa.array(["the", "seven", ""]))
    assert [known.words[ids[k]] for k in page] == ["the", "e", "", "7", "x'y"] == [_normal(x or "") for x in ("The", "É", None, "7", "x'Y")]
    assert ids[page[0]] == ids[said[0]] and distinct[said[0]] == "the" and known.number[ids[page[3]]] == known.number[ids[said[1]]] >= 0
    british, american = known.add(["colour", "color"])
    assert known.spelling[british] == known.spelling[american] and known.is_spelled_otherwise(british) and not known.is_spelled_otherwise(ids[page[0]])
    assert all(wordclass.dialect_key(a) == wordclass.dialect_key(b) for a, b in (("realised", "realized"), ("centre", "center"), ("grey", "gray"), ("ours", "ours")))


def readings(r, n):
    """Pages, and what was heard of them, with slips, repeats, jumps back and ahead, sounds, and times that fall back or are equal."""
    for _ in range(n):
        page = r.choices(WORDS + made_up(r, 60) + [""], k=r.choice([0, 3, 40, 400]))
        said, at, clock = [], 0, 0.0
        while at < len(page):
            word, clock = page[at], clock + r.choice([0.4] * 40 + [0.0, 1.5, -0.5])
            kind = r.random()
            text = slipped(r, word) if kind < 0.03 and word else r.choice(WORDS) if kind < 0.05 else word
            said.append((text, text, clock, clock + 0.3 - 0.4 * (kind > 0.99), r.choice([0.9, 0.95, 0.3, float("nan")])))
            at += r.choice([1] * 60 + [0, 2, 5, 30, -3])
            at = max(at, 0)
        yield page, said[:500]


def list_batch(pages):
    columns = [[p for p, _ in pages], *([[w[k] for w in said] for _, said in pages] for k in (0, 2, 3, 4))]
    kinds = [pa.list_(pa.string())] * 2 + [pa.list_(pa.float64())] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["_words", "_text", "_start", "_end", "_confidence"])


def test_stretches_give_what_windows_give_one_by_one(monkeypatch):
    monkeypatch.setattr(follow, "STRETCH", 7)
    pages = list(readings(random.Random(3), 120))
    for window in (1, 2, 3):
        known, batch = Vocabulary(), list_batch(pages)
        assert known.start() is None
        found = [follow._followed_alone(s, known, window, follow.Bars(), True) for at in (0, 50) for s in follow._sessions(batch.slice(at, [50, 70][at > 0]), known)]
        for (page, said), (cursor, *counts) in zip(pages, found, strict=True):
            reading, state, events = follow.Reading([_normal(w) for w in page]), follow.State(), []
            words = [Heard(t, _normal(n), a, z, min(1.0, max(0.0, c))) for t, n, a, z, c in said]
            for i in range(0, len(words), window):
                state, places = reading.read(state.resumed() if state.halted else state, usable(words[i : i + window]), i)
                events += [p.event for p in places]
            assert (cursor, counts) == (state.cursor, [events.count(e) for e in follow.EVENTS])


def test_a_stand_in_reading_is_the_same_made_in_columns_and_beside_the_matcher(spark):
    r = random.Random(8)
    texts = [" ".join(r.choices(["The", "cat", "sat", "Élan"], k=k)) for k in [*range(1, 8)] * 30 + [300]]
    docs = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), (-7, texts[-1]), (2**57, texts[-1]), (None, texts[-1]), (9, "..")], "doc_id long, text string")
    rows = proof.stand_in_transcript(docs).select("doc_id", "tokens", "heard", *((high - low + 1).alias("said") for low, high in [proof.stand_in_places("doc_id", "tokens")])).collect()
    batch = pa.RecordBatch.from_arrays([pa.array([x.doc_id for x in rows], pa.int64()), pa.array([x.tokens for x in rows], pa.list_(pa.string()))], names=["doc_id", "_words"])
    known = Vocabulary()
    for at in (0, 100):
        made, some = proof.stand_in_readings("doc_id")(batch.slice(at, [100, 999][at > 0]), known), rows[at : at + [100, 999][at > 0]]
        for k, x in enumerate(some):
            said = range(*made.words[k : k + 2].tolist())
            assert [(made.text(i), made.starts[i], made.ends[i], made.sure[i]) for i in said] == [tuple(w) for w in x.heard] and len(said) == max(0, x.said if x.tokens else 0)
            assert [known.words[made.heard[i]] for i in said] == [_normal(w.text) for w in x.heard]
            assert [known.words[w] for w in made.page[slice(*made.pages[k : k + 2].tolist())]] == [_normal(w) for w in x.tokens]


def test_few_words_of_the_page_are_compared_with_a_slip(monkeypatch):
    compared = []
    missing, fits = follow._Fits.__missing__, follow.Places.fits
    monkeypatch.setattr(follow._Fits, "__missing__", lambda self, w: compared.append(w) or missing(self, w))
    monkeypatch.setattr(follow.Places, "fits", lambda self, at, word, written: compared.append(word) or fits(self, at, word, written))
    r = random.Random(4)
    page = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(2000)]
    said = [("slipped" if i % 50 == 7 else w, i * 0.4, i * 0.4 + 0.3) for i, w in enumerate(page)]
    known = Vocabulary()
    batch = list_batch([(page, [(w, w, a, z, 0.9) for w, a, z in said])])
    (session,) = follow._sessions(batch, known)
    cursor, *_ = follow._followed_alone(session, known, 3, follow.Bars(), True)
    assert cursor == 2000 and 0 < len(compared) < 40 * 10  # a page in which each slip is compared with 48 words and 64 has thousands
    assert np.count_nonzero(~session.clean) == 0
