"""Fill-in-middle and piece encoding against brute force and the library, on small and odd inputs."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from inkstream.llm import fim, piece_bpe
from tests.llm.test_text_operators import ODD

EXTRA = "doc_id long, text string, n string, form string, ids string, agrees string, kept string"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def frame(spark, texts, keys=None):
    return spark.createDataFrame([(i, t, "n", "f", "i", "a", "kept") for i, t in zip(keys or range(len(texts)), texts)], EXTRA)


def plain_fim(key, text):
    text = text or ""
    parts = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("size", [0, 1, 63, 64, 511, 512, 513, 5000])
def test_rank_and_select(size):
    r = np.random.default_rng(size)
    for share in (0.0, 0.01, 0.5, 1.0):
        bits = r.random(size) < share
        packed = fim.Bits(bits)
        assert packed.rank(np.arange(size + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
        ones = np.flatnonzero(bits)
        assert packed.select(np.arange(len(ones))).tolist() == ones.tolist()


def test_fill_in_middle_is_the_definition(spark, small):
    r = random.Random(5)
    texts = [*ODD, *["".join(r.choices("ab \n\t\x0bé日🙂<>PSM", k=r.randint(0, 60))) for _ in range(600)], "a <P> b " * 9, "x<", "<P", "word " * 300_000]
    texts += [t + "<S>" for t in ODD if t] + [x.text for x in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    rows = fim.fill_in_middle(frame(spark, texts)).withColumn("back", fim.restored(fim.F.col("form"), fim.F.col("output"))).collect()
    assert len(rows) == len(texts) and {x.form for x in rows} == {"plain", "psm", "spm"}
    for x in rows:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == plain_fim(x.doc_id, texts[x.doc_id])
        assert x.back == (texts[x.doc_id] or "") and (x.ids, x.agrees, x.kept) == ("i", "a", "kept")


def test_fill_in_middle_of_null_and_repeated_keys_and_of_no_rows(spark):
    texts = ["one two three four five"] * 3 + [None]
    rows = fim.fill_in_middle(frame(spark, texts, [None, 7, 7, None])).collect()
    assert sorted(map(str, [(x.doc_id, x.output) for x in rows])) == sorted(map(str, [(k, plain_fim(k, t)[4]) for k, t in zip([None, 7, 7, None], texts)]))
    assert fim.fill_in_middle(frame(spark, [])).count() == 0


def test_a_run_of_texts_is_cut_like_single_texts(spark, monkeypatch):
    texts = [f"{i} some words " * (i % 5) for i in range(200)]
    whole = fim.fill_in_middle(frame(spark, texts)).collect()
    monkeypatch.setattr(fim, "STEP", 50)
    assert sorted(fim.fill_in_middle(frame(spark, texts)).collect()) == sorted(whole)


@pytest.fixture(scope="module")
def pieces():
    return piece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_are_those_of_the_library(spark, pieces, library, small):
    r = random.Random(2)
    texts = [*ODD, "▁x", "\x00", "<s></s><unk>", "ﬁ", " " * 5000, "a" * 5000, "the" * 3000, *["".join(r.choices("ab \n\t'sT.9é日🙂▁\x00�　", k=r.choice([3, 30, 150]))) for _ in range(800)]]
    texts += [x.text for x in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    rows = piece_bpe.round_trip(frame(spark, texts), pieces).collect()
    assert len(rows) == len(texts)
    for x in rows:
        text = texts[x.doc_id] or ""
        assert x.ids == library.encode(text) and x.decoded == library.decode(x.ids) and x.agrees and x.kept == "kept" and x.form == "f"


def test_both_agendas_agree(pieces):
    r = random.Random(3)
    for _ in range(500):
        unit = "▁" * r.randint(0, 4) + "".join(r.choices("theingador. é", k=r.randint(1, 60)))
        assert pieces.merged(unit) == pieces.merged_long(unit)


def test_any_ids_decode_like_the_library(pieces, library):
    r = random.Random(4)
    for _ in range(5000):
        ids = [r.choice([0, 1, 2, 259, 28705, r.randint(3, 258), r.randint(3, 258), r.randint(0, 31999)]) for _ in range(r.randint(0, 9))]
        assert pieces.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_a_library_that_differs_is_told(pieces, library):
    found = [np.array(library.encode(t), np.int32) for t in ("one", "two")]
    assert pieces.agrees(["one", "two"], found, ["one", "two"]) == [True, True]
    assert pieces.agrees(["one", "two"], [found[0], found[0]], ["one", "two"]) == [True, False]
    assert pieces.agrees(["one", "two"], found, ["one", "twos"]) == [True, False]


def test_null_and_repeated_keys_no_rows_and_other_models(spark, pieces):
    rows = piece_bpe.round_trip(frame(spark, ["a b", "a b", None], [None, None, 3]), pieces).collect()
    assert sorted((x.doc_id or 0, x.decoded) for x in rows) == [(0, "a b"), (0, "a b"), (3, "")]
    assert piece_bpe.round_trip(frame(spark, []), pieces).count() == 0
    with pytest.raises(ValueError):
        piece_bpe.Pieces(b"")
