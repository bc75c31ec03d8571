"""Cross-entropy by models of every word against the definition."""

import math
from collections import Counter

import pytest

from inkstream.llm import chunks, lm_score


def plain(text, counted, size):
    """-ln p(b | a), the mean over a text, one pair at a time."""
    parted = lambda t: ["", *(t or "").lower().split(), ""]
    joint = Counter(p for t in counted for p in zip(parted(t), parted(t)[1:]))
    word, seen = Counter(), Counter(a for a, _ in joint)
    for (_, b), n in joint.items():
        word[b] += n
    each = []
    for a, b in zip(parted(text), parted(text)[1:]):
        unigram = (word[b] + 1) / (sum(word.values()) + size)
        p = max(joint[a, b] - 0.75, 0) / word[a] + 0.75 * seen[a] / word[a] * unigram if word[a] else unigram
        each.append(-math.log(p))
    return sum(each) / len(each)


@pytest.mark.parametrize("bounds", ((100, 100), (3000, 70), (2_000_000, 2_000_000)))
def test_losses_are_of_every_word(spark, monkeypatch, bounds):
    monkeypatch.setattr(chunks, "CHUNK", bounds[0])
    monkeypatch.setattr(chunks, "SHARD", bounds[1])
    monkeypatch.setattr(lm_score, "MAX_SENT", bounds[0] - 100)
    texts = {i: " ".join(f"w{(i * j * 7) % 5000} The" for j in range(120 + i)) for i in range(60)} | {100: "", 101: None, 102: "The the THE", 103: "w7"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for targets in ("doc_id % 3 = 0", "false"):
        rows = lm_score.cross_entropy(docs, docs.where(targets)).collect()
        assert sorted(r.doc_id for r in rows) == sorted(texts)
        folds = {r.doc_id: r.f for r in docs.select("doc_id", lm_score.fold("doc_id").alias("f")).collect()}
        size = len({w for t in texts.values() for w in (t or "").lower().split()}) + 1
        assert size > 2048
        for r in rows:
            others = [i for i in texts if folds[i] != folds[r.doc_id]]
            assert r.n_tokens == len((texts[r.doc_id] or "").split()) + 1
            assert abs(r.background_loss - plain(texts[r.doc_id], [texts[i] for i in others], size)) < 1e-5
            assert abs(r.target_loss - plain(texts[r.doc_id], [texts[i] for i in others if targets != "false" and i % 3 == 0], size)) < 1e-5


def test_rare_words_of_one_shape_differ(spark):
    """Two texts of other words but equal shapes: what the target holds of one, it does not hold of the other."""
    common = " ".join(f"c{i:04d} " * 3 for i in range(2100))
    rows = [(i, common + (" rareword" * 2)) for i in range(20)] + [(100, "rareword rareword"), (101, "restword restword")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.target_loss for r in lm_score.cross_entropy(docs, docs.where("doc_id < 20")).collect()}
    assert found[100] < found[101] - 1


def test_without_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.cross_entropy(docs, docs).count() == 0
