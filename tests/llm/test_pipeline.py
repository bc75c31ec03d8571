"""Each stage of the pipeline against a plain version, on real documents and odd rows: nulls, empty texts, repeats, ties, more
columns, empty tables."""

import math

import public_tokenizers
import pytest
import tiktoken
from test_set_operators import plain_classes, plain_matches
from test_text_operators import plain_base

import corpus_pipeline
from inkstream.llm import bpe, quality, secrets

STAGES = dict(corpus_pipeline.STAGES)
ODD = [(90_001, None), (90_002, ""), (90_003, " "), (90_004, "one two"), (90_004, "one two"), (90_005, "One two"), (90_006, "password=b7db7aa4a5fcc78305 " * 3), (90_007, "x" * 50_000), (None, "no id")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, id string, class string, ids string"


@pytest.fixture(scope="module")
def docs(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 3000").orderBy("doc_id").limit(60).select("doc_id", "text").collect()
    items = spark.read.parquet(f"{small}/benchmark.parquet").where("text is not null").orderBy("item_id").limit(3).collect()
    rows = [(r.doc_id, r.text) for r in rows] + [(80_000 + r.item_id, "before this " + r.text + " after it") for r in items] + ODD
    rows += [(70_000 + i, t) for i, t in rows[:5]]  # exact copies
    return spark.createDataFrame([(i, t, "en", "s", None, "a", "b", "c", "d") for i, t in rows], SCHEMA)


def plain(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def order(rows):
    return sorted(rows, key=str)


def test_quality_keeps_what_scores_enough(spark, small, docs):
    model = quality.fitted(docs, spark.read.parquet(f"{small}/labels.parquet"))

    def score(text):
        if not model.fitted:
            return 0.5
        x = (quality.np.array(quality.features(text or "")) - model.mean) / model.spread
        return 1 / (1 + math.exp(-(model.base + model.slope * (float(x @ model.weights) - model.threshold))))

    kept = STAGES["quality"](spark, docs, small)
    assert kept.columns == docs.columns
    assert order(plain(kept)) == order((i, t) for i, t in plain(docs) if score(t) >= quality.CUT)


def test_near_duplicates_keep_one_of_each_class(spark, small, docs):
    rows = plain(docs)
    classes = plain_classes([(i, t) for i, t in dict(rows).items() if i is not None])
    kept = STAGES["near_duplicates"](spark, docs, small)
    assert kept.columns == docs.columns
    assert order(plain(kept)) == order({(i, t) for i, t in rows if i is None or classes[i] == i})


def test_decontamination_drops_what_holds_an_item(spark, small, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    few = docs.where("doc_id >= 70000 or doc_id is null or doc_id % 5 = 0")
    few = spark.createDataFrame(few.collect(), SCHEMA)
    held = {i for i, _ in plain_matches([(i, t) for i, t in plain(few) if i is not None and len(t or "") < 9000], items)}
    kept = plain(STAGES["decontamination"](spark, few, small))
    assert len(held) >= 3 and not held & {i for i, _ in kept}
    every = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    lost = [(i, t) for i, t in plain(few) if (i, t) not in kept]
    assert {i for i, _ in plain_matches(lost, every)} == {i for i, _ in lost}


def test_secrets_are_marked_and_nothing_else_is_changed(spark, small, docs):
    out = STAGES["secrets"](spark, docs, small)
    assert out.columns == docs.columns
    found = out.select("doc_id", "text", "n_chars", "lang").collect()
    assert order((r.doc_id, r.text) for r in found) == order((i, secrets.redacted(t or "", secrets.spans(t or ""), "[SECRET]")) for i, t in plain(docs))
    assert all(r.n_chars == len(r.text) and r.lang == "en" and not plain_base(r.text.replace("[SECRET]", "")) or "[SECRET]" in r.text or not plain_base(r.text) for r in found)


def test_encoding_is_that_of_the_library(spark, small, docs):
    codec = bpe.standard_codec()
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rows = STAGES["encoding"](spark, docs, small).collect()
    assert order((r.doc_id, r.ids) for r in rows) == order((i, other.encode_ordinary(t or "")) for i, t in plain(docs))


@pytest.mark.parametrize("name", STAGES)
def test_no_documents(spark, small, docs, name):
    assert STAGES[name](spark, docs.limit(0), small).count() == 0
