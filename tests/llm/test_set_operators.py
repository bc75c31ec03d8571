"""Top-k, near duplicates, decontamination, substring removal and the pipeline against brute force on small inputs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from inkstream.llm import chunks, decontaminate, near_dup, substring_dedup, topk
from inkstream.llm._common import WordCodes
from inkstream.llm.components import components
from inkstream.llm.fm_index import FmIndex, suffix_order


def prose(r, n, most=400):
    return [f"w{min(int(r.paretovariate(0.6)), most)}" for _ in range(n)]


def test_suffix_order_and_backward_search():
    r = random.Random(5)
    for _ in range(30):
        parts = [[r.randint(1, 3) for _ in range(r.randint(1, 20))] for _ in range(r.randint(1, 12))]
        text = np.array([x for p in parts for x in [*p, 0]])
        marks = np.where(text == 0, np.cumsum(text == 0) - 1000, text)
        assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: marks[i:].tolist())
        owner = np.cumsum(text == 0) - (text == 0)
        index, most = FmIndex(text, 4, owner), 5
        ends = np.arange(1, len(text) + 1)
        found = list(zip(ends.tolist(), *(x.tolist() for x in index.statistics(text, ends, most))))
        for end, length, low, high in found:
            def places(k):
                part = text[end - k : end].tolist()
                return [i for i in range(len(text) - k + 1) if text[i : i + k].tolist() == part] if k <= end and 0 not in part else []

            assert length == max([k for k in range(1, most + 1) if len(places(k)) > 1], default=0)
            if length:
                assert sorted(index.documents[low:high].tolist()) == sorted(owner[places(length)].tolist())
        same = [(low, high) for _, length, low, high in found if length == 3]
        if same:
            least = index.least_documents(*map(np.array, zip(*same)))
            assert least.tolist() == [index.documents[a:z].min() for a, z in same]


def plain_removal(docs, n):
    words = [(i, substring_dedup.find_words(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("hot", [2, 2000])
def test_substring_removal(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    r = random.Random(hot)
    shared = [prose(r, r.choice([12, 13, 14, 30, 60])) for _ in range(6)]
    docs = [(0, None), (1, ""), (2, "one two"), (3, "a b " * 60), (4, "a b " * 60), (5, "\x1c  x y " * 20), (6, "\x1c  x y " * 20)]
    for i in range(10, 70):
        parts = [prose(r, r.randint(0, 40)) if r.random() < 0.5 else r.choice(shared) for _ in range(r.randint(1, 5))]
        docs.append((i, r.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    docs += [(i + 100, t) for i, t in docs[10:20]] + [docs[20], docs[21], docs[21]]
    for order in (docs, docs[::-1]):
        rows = substring_dedup.deduplicated(spark.createDataFrame([(i, t, "k") for i, t in order], "doc_id long, text string, ranges string")).collect()
        assert sorted(tuple(x) for x in rows) == plain_removal(docs, 13)
    assert substring_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_of_equal_hash_halves_are_not_equal(spark):
    """Two words whose hashes agree in the upper 32 bits, before twelve equal words."""
    rest = " ".join(f"common{k}" for k in range(12))
    docs = [(1, f"k19697 {rest}"), (2, f"k34370 {rest}"), (3, f"k19697 {rest}")]
    rows = substring_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {1: 0, 2: 0, 3: 13}


def plain_top(rows, k):
    out = []
    rows = sorted((i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v))
    for q, qv in sorted(set(rows)):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


def test_alike_vectors_leave_blocks_unread():
    r = np.random.default_rng(5)
    centres = r.normal(size=(64, 16)) * 200
    rows = np.floor(np.repeat(centres, 64, 0) + r.normal(size=(4096, 16)) * 4).astype(np.int64)
    ids = r.permutation(4096)
    order = topk._order(rows, ids)
    blocks = topk.Blocks(ids[order], np.ones(4096, np.int64), rows[order].astype(float))
    scored = []
    for q in range(0, 4096, 97):
        found, n = blocks.search(int(ids[q]), rows[q].astype(float), 5)
        scored.append(n)
        assert [(-s, i) for i, s, _ in found] == sorted((-int(rows[q] @ v), int(i)) for i, v in zip(ids, rows) if i != ids[q])[:5]
    assert np.mean(scored) < 0.35 * len(blocks.forward)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_exact_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "ROWS_PER_SHARD", 64)
    monkeypatch.setattr(topk, "QUERIES_PER_GROUP", 3)
    monkeypatch.setattr(topk, "BLOCK", 16)
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 8))
    rows = [(int(i), [float(np.float32(x)) for x in (centres[i % 6] + r.normal(size=8) * 0.1) * scale]) for i in range(400)]
    rows += [(50, rows[50][1]), (401, rows[7][1]), (402, rows[7][1]), (402, rows[7][1]), (7, rows[7][1]), (7, rows[7][1]), (450, None), (500, [None] * 8), (550, [float("nan")] * 8), (600, [float("inf")] + [0.0] * 7), (None, rows[3][1]), (650, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "cast(embedding as array<float>) embedding", "1 as score")
    found = [tuple(x) for x in topk.exact_top_k(df, df.vec_id % 50 == 0, 5).collect()]
    assert sorted(found) == plain_top(rows, 5)
    one = df.where("vec_id = 0")
    assert topk.exact_top_k(one, one.vec_id % 50 == 0, 5).count() == 0
    assert topk.exact_top_k(df.limit(0), df.vec_id % 50 == 0, 5).count() == 0


def grown(r, text, edits):
    words = text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"new{r.random()}"
    return " ".join(words)


def plain_classes(docs):
    """From the definition: the exact frequency of every word, dictionaries of shingles, all pairs."""
    texts = {i: t or "" for i, t in docs}
    words = {i: t.lower().split() for i, t in texts.items()}
    held = Counter(w for x in words.values() for w in set(x))
    level = {w: round(math.log1p(len(texts) / n) * 1024) for w, n in held.items()}
    sets = {}
    for i, x in words.items():
        n = min(5, len(x))
        sets[i] = Counter()
        for k in range(len(x) - n + 1 if n else 0):
            sets[i][tuple(x[k : k + n])] += sum(level[w] for w in x[k : k + n])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j:
                shared = sum((sets[i] & sets[j]).values())
                if texts[i] == texts[j] or shared and shared * 5 >= 4 * sum((sets[i] | sets[j]).values()):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("small, bounds", [(2, 300), (2, 2_000_000), (16, 1000)])
def test_near_duplicate_classes(spark, monkeypatch, small, bounds):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(chunks, "CHUNK", bounds)
    monkeypatch.setattr(chunks, "SHARD", bounds)
    r = random.Random(11)
    docs = [(0, None), (1, ""), (2, " "), (3, "one"), (4, "One"), (5, "a b c"), (6, "a b c"), (7, "a b d")]
    for base in range(6):
        text = " ".join(prose(r, 150, 5000))
        docs.append((len(docs), text))
        for copies in range(r.choice([1, 3, 40])):
            docs.append((len(docs), grown(r, text, r.choice([0, 1, 2, 3, 6]))))
    chain = " ".join(prose(r, 200, 5000))
    for _ in range(12):
        docs.append((len(docs), chain))
        chain = grown(r, chain, 3)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, id int, class int")
    found = {x["id"]: x["class"] for x in near_dup.classes(df).collect()}
    assert found == plain_classes(docs)
    assert near_dup.classes(df.limit(0)).count() == 0


def test_texts_a_little_less_alike_than_the_limit_make_few_pairs(spark, monkeypatch):
    """60 variants of one text, all pairs just below the limit: nothing is linked and hardly a pair is compared."""
    monkeypatch.setattr(near_dup, "SMALL", 2)
    r = random.Random(3)
    base = [f"b{k}" for k in range(200)]
    docs = [(i, " ".join(base[:168] + [f"own{i}x{k}" for k in range(22)])) for i in range(60)] + [(60 + i, " ".join(base + [f"own{i}"])) for i in range(6)]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    compared = []
    monkeypatch.setattr(near_dup, "links_of", lambda pairs, sets, real=near_dup.links_of: (compared.append(pairs.count()), real(pairs, sets))[1])
    found = {x["id"]: x["class"] for x in near_dup.classes(df).collect()}
    assert found == plain_classes(docs)
    assert sum(compared) < 600  # all pairs are 2145


def test_ids_that_repeat_are_one_document(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, text), (3, "x y z"), (3, text), (4, "x y z"), (5, "other words"), (5, "other words"), (None, text)]
    found = {x["id"]: x["class"] for x in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    kept = near_dup.keep_first(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted((x.doc_id or 0) for x in kept.collect()) == [0, 1, 5]


def test_icws_agrees_as_often_as_sets_are_similar():
    r = np.random.default_rng(4)
    sampler, agreed, expected = near_dup.Sampler(), [], []
    for trial in range(60):
        codes = np.unique(r.integers(1, 2**63, 300).astype(np.uint64))
        w = r.integers(1000, 9000, len(codes)) * 2
        v = (w * r.choice([1, 1, 1, 2, 0.5], len(codes))).astype(np.int64)
        a, b = (codes[:280], w[:280]), (codes[20:], v[20:])
        agreed.append((sampler.samples(*a) == sampler.samples(*b)).mean())
        shared, total = near_dup.shared_and_total(a, b)
        expected.append(shared / total)
    assert abs(np.mean(agreed) - np.mean(expected)) < 0.03


def test_components(spark):
    r = random.Random(6)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {x.node: x["class"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}


def plain_matches(docs, items):
    lexicon, out = WordCodes(decontaminate.bare), {}
    for i, t in docs:
        words = decontaminate.Words(t or "", lexicon)
        for item, x in items:
            own = decontaminate.Words(x or "", lexicon)
            size = len(own.codes)
            if not size:
                continue
            n = min(5, size)
            make = lambda w, s: decontaminate.weighted(decontaminate.grams(w.codes[s : s + size], n), w.letters(s, s + size, n))
            wanted = make(own, 0)
            best = max([(decontaminate.similarity(make(words, s), wanted), -s) for s in range(len(words.codes) - size + 1)], default=(0, 0))
            if best[0] >= 0.8:
                out[i, item] = (round(best[0], 9), -best[1])
    return out


@pytest.mark.parametrize("most", [32 << 20, 700])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MAX_ITEM_BYTES", most)
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 10 if most == 700 else 8192)
    r = random.Random(8)
    items = [(k, " ".join(prose(r, r.randint(14, 40), 3000))) for k in range(12)] + [(20, "four words only here"), (21, None), (22, "..."), (23, "solo")]
    docs = [(0, None), (1, ""), (2, "..."), (3, "Four, words (only) HERE!"), (4, "word " * 500)]
    for i in range(10, 60):
        _, text = r.choice(items[:12])
        text = grown(r, text, r.choice([0, 0, 1, 1, 2])) if r.random() < 0.7 else text.upper() + "!"
        docs.append((i, " ".join([*prose(r, r.randint(0, 60), 3000), text, *prose(r, r.randint(0, 60), 3000)])))
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, item_id int")
    found = decontaminate.matches(df, spark.createDataFrame(items, "item_id long, text string"))
    rows = {(x.doc_id, x.item_id): (round(x.similarity, 9), x.start_word) for x in found.collect()}
    assert rows == plain_matches(docs, items) and len(rows) > 15
    assert decontaminate.matches(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_index_returns_all_within_the_radius_and_few_others():
    r = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(400)]
    index = decontaminate.Index(texts)
    for _ in range(200):
        flips = r.choice(decontaminate.BITS, int(r.integers(0, 90)), replace=False)
        bits = index.bits[:1].copy()
        bits[0, flips] ^= True
        assert ((0, 0) in index.near(bits, 30)) == (len(flips) <= decontaminate.RADIUS)
        assert index.near(bits, 31) == []
    rows, _ = index.candidates(r.random((300, decontaminate.BITS)) > 0.5)
    assert len(rows) / (300 * 400) < 0.012


def test_windows_at_the_limit_are_found():
    """Windows that are 0.8 to 0.85 similar to their item, and more similar ones."""
    r = random.Random(4)
    texts = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randint(20, 60)))) for i in range(400)]
    index, lexicon = decontaminate.Index(texts), WordCodes(decontaminate.bare)
    near, other = [0, 0], [0, 0]
    for i, text in texts:
        words = text.split()
        changed = [f"z{k}" for k in range(r.randint(0, len(words) // 9))]
        window = " ".join([*changed, *words[len(changed) :]])
        size = len(words)
        own, mine = (decontaminate.Words(t, lexicon) for t in (text, window))
        exact = decontaminate.similarity(*(decontaminate.weighted(decontaminate.grams(w.codes, 5), w.letters(0, size, 5)) for w in (own, mine)))
        if exact >= 0.8:
            kind = near if exact < 0.85 else other
            kind[0] += 1
            kind[1] += i in index.find(window, lexicon)
    assert other[0] == other[1] and near[0] > 30 and near[0] == near[1]


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, names = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = spark.createDataFrame(stage(spark, kept, folder).collect(), docs.schema)
        assert kept.columns == names and 0 < kept.count() <= before
    last = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
    assert last.count() == kept.count()
    good = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1")
    left = kept.join(good, "doc_id").count() / good.count()
    assert left > 0.8
