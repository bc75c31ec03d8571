"""Steps over all words of all texts: what they find, and that they do it without joining strings, folding arrays or counting what
nobody asked for."""

import re

from pyspark.sql import functions as F

from inkstream.functions.text import WORD
from inkstream.operators import glossary, proof, structure
from inkstream.sources.tables import DROPPED, FOLLOWED, LENGTH, MODULUS, REPLACED, STEP


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f5_the_stand_in_reading_is_that_of_a_plain_loop(spark):
    rows = [(k, "w " * n) for k in (*range(97), None) for n in (0, 1, 2, 3, 99)]
    read = proof.stand_in_transcript(spark.createDataFrame(rows, "doc_id long, text string"))
    for key, tokens, heard in read.select("doc_id", "tokens", "heard").collect():
        plain = []
        for i, t in enumerate(tokens):
            slip = (key * 31 + i) % MODULUS if key is not None else -1
            said = {DROPPED: [], REPLACED: [("slipped", 0.0)], FOLLOWED: [(t, 0.0), ("added", 0.05)]}.get(slip, [(t, 0.0)])
            plain += [(x, i * STEP + late, i * STEP + late + LENGTH, 0.9) for x, late in said]
        assert [tuple(w) for w in heard] == plain
    assert "flatten" not in _plan(read)


def test_f8_words_that_are_no_names_are_not_counted(spark):
    docs = spark.createDataFrame([(1, "Anna's hat. The Anna-Lena said: ΟΔΟΣ’s way"), (2, "anna ANNA'S Bob"), (3, None)], "doc_id long, text string")
    names = spark.createDataFrame([("anna",), ("nobody",), ("οδος",)], "spelling string")
    found = glossary.guide_rows(names, glossary.tokens(docs, "doc_id"), "doc_id")
    assert {tuple(r) for r in found.collect()} == {("anna", "anna", 3, 2), ("nobody", "nobody", 0, 0), ("οδος", "οδος", 1, 1)}
    plan = _plan(found)
    assert plan.index("LeftSemi") > plan.rindex("Aggregate")


def test_f19_tokens_with_their_neighbours(spark):
    docs = spark.createDataFrame([(1, "Anna's x2-b. Said ’s Mr Bob’S")], "doc_id long, text string")
    found = glossary.tokens(docs, "doc_id")
    assert [tuple(r)[1:] for r in found.collect()] == [
        ("Anna's", "anna", True, True, None, "x2-b"), ("x2-b", "x2-b", False, False, "anna", None), ("Said", "said", True, True, None, "s"),
        ("s", "s", False, False, "said", "mr"), ("Mr", "mr", True, False, "s", "bob"), ("Bob’S", "bob", True, False, "mr", None),
    ]
    assert "lambdafunction" not in _plan(found)


def test_f17_f20_places_of_phrases_of_any_size(spark):
    texts = {1: "a b c a b d e", 2: "b a b c d", 3: "", 4: "a"}
    phrases = {1: "a", 2: "a b", 3: "a b c", 4: "a b c d", 5: "c a b d e", 6: "x", 7: "", 8: "a b"}
    frame = lambda d, k: spark.createDataFrame(list(d.items()), f"{k} int, t string").select(k, F.regexp_extract_all("t", F.lit(WORD), 0).alias("w"))
    found = structure.phrase_places(frame(texts, "doc_id"), frame(phrases, "item_id"), "doc_id", "item_id")
    plain = set()
    for d, t in texts.items():
        for k, p in phrases.items():
            w, q = re.findall(r"\w", t), re.findall(r"\w", p)
            plain |= {(k, d, i, len(q), " ".join(w[max(0, i - 4) : i + len(q) + 4])) for i in range(len(w)) if q and w[i : i + len(q)] == q}
    assert {tuple(r) for r in found.collect()} == plain and len(plain) == found.count()
    hits = structure._starts(frame(texts, "doc_id"), frame(phrases, "item_id").select("item_id", F.col("w").alias("_p"), F.least(F.size("w"), F.lit(3)).alias("_n")), "doc_id", "item_id", 3)
    assert "array_join" not in _plan(hits) and "lambdafunction" not in _plan(hits)


def test_f16_kinds_of_slips(spark):
    pairs = {
        ("one", "1"): "same", ("two", "3"): "number", ("the", "a"): "short-swap", ("the", "of"): "other", ("cat", "cats"): "inflection", ("walked", "walk"): "inflection",
        ("walk", "walkers"): "other", ("walker", "lker"): "onset", ("understand", "der"): "piece", ("planet", "planes"): "near", ("planet", "plain"): "other", ("abcdefgh", "abcdxxgh"): "near",
        ("s", "is"): "other", ("9x", "9x1"): "other", ("men", "man"): "inflection",
    }
    rows = spark.createDataFrame(list(pairs), "a string, b string").withColumn("kind", structure.slip_kind(F.col("a"), F.col("b")))
    assert {(a, b): k for a, b, k in rows.collect()} == pairs
    assert "concat(" not in _plan(rows)
