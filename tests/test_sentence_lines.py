"""Sentences of texts and the range of every token, against a plain loop."""

import pytest
import regex
from pyspark.sql import functions as F

from inkstream.functions.text import words
from inkstream.operators import structure
from inkstream.plans import texts

ODD = [
    "Dr. Smith met Mrs. Jones. They sat! Why? No.\nEnd",
    "etc. e.g. this, St. Ives.. and ETC. more",
    None, "", " . ! ", "one", "one.", "—one’s—two-three. four",
    "a b. c\r\nd. İst. ſt. gó. x",
    "。漢字。かな！ 数3.5 x. 3.5", "co-op. co. Co-.. No?! yes…", "Mr.\nX. Mr.\u0085Y. mr.'s", "word." * 30,
]


def plain_sentences(text):
    pairs = regex.findall(structure.TOKEN_AND_GAP, text or "")
    ends = [i for i, (w, gap) in enumerate(pairs) if regex.search("[\n!?。！？]", gap) or ("." in gap and w.lower() not in structure.ABBREVIATIONS) or i == len(pairs) - 1]
    return [(a + 1, z) for a, z in zip([-1, *ends], ends)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")


def test_f22_sentences_are_those_of_a_plain_loop(docs):
    found = sorted((x.doc_id, x.sentence, x["first"], x["last"]) for x in structure.sentence_ranges(docs).collect())
    assert found == [(d, k, a, z) for d, text in enumerate(ODD) for k, (a, z) in enumerate(plain_sentences(text))] and len(found) > 60


@pytest.mark.parametrize("more", [0, 1, 3])
def test_f22_every_token_has_its_sentence_and_those_beside_it(spark, docs, more):
    found = sorted(tuple(x) for x in structure.token_lines(docs, more=more).select("doc_id", "token", "first", "last").collect())
    want = []
    for d, text in enumerate(ODD):
        s = plain_sentences(text)
        want += [(d, t, s[max(k - more, 0)][0], s[min(k + more, len(s) - 1)][1]) for k, (a, z) in enumerate(s) for t in range(a, z + 1)]
    assert found == want
    tokens = docs.select("doc_id", words(F.col("text")).alias("w")).selectExpr("doc_id", "posexplode(w) AS (token, _)").select("doc_id", "token")
    looked_up = structure.line_ranges(structure.sentence_ranges(docs), tokens, "doc_id", more).select("doc_id", "token", "first", "last")
    assert sorted(tuple(x) for x in looked_up.collect()) == want


def test_f22_no_token_travels_and_texts_are_gone_through_once(spark, small):
    for query in (texts.line_ranges, texts.sentence_ranges):
        plan = query(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Window" not in plan and plan.count("regexp_extract_all") == 1
