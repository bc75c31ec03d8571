"""Near-duplicate classes by improved consistent weighted sampling.

A document is a weighted set of five-word shingles (lower-cased words; all words, where there are fewer than five): the
weight of a shingle is how often it occurs times the inverse document frequencies of its words. Frequencies are those of
every word over all documents: chunks of documents ask the shards of a table of counts (see chunks), and nothing is
broadcast. An inverse frequency is ln(1 + N / n) in 1024ths, so weights are whole numbers and sums exact in any order.

ICWS draws SAMPLES samples of a set; two documents agree in one with the probability of their weighted Jaccard similarity.
Samples are banded, and documents that share a band are candidates; their exact weighted Jaccard similarity decides a
link, and classes are the connected components of the links.

Hot groups: exact copies are reduced to one representative before any pair is formed. A bucket of at most SMALL different
texts gives all its pairs. A larger bucket first links each member to a leader, then (twice) to the member that has least of its own, so a group
of thousands of near copies costs a few times as many comparisons as it has members. Members of a bucket that then are still
of several classes meet by prefixes: with
shingles ordered by how many hold them (those of a single class first), two sets of similarity SIMILAR or more share one that
stands in the first ninth of the lighter set's weight and in the first fifth of the heavier one's. That loses no link, and
pairs that cannot be that similar for what each has of its own (shingles of no other class) are not compared: texts that are
all a little less alike than SIMILAR make hardly a pair.

Null texts are empty; texts without words are in a class only with identical texts. A row without an id takes no part. Rows
that repeat an id are one document, linked by any of its texts. Equal texts and ties: a class is named by its smallest id.
An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstream.llm import chunks as C
from inkstream.llm._common import ODD, discard, grams, mixed, stored, table, whole_text
from inkstream.llm.components import components

WORDS, SIMILAR = 5, 0.8
#: The same as whole numbers: shared x PARTS >= total of both x WHOLES. The prefixes above follow from it.
WHOLES, PARTS = 4, 5
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
SMALL = 16
#: Steps of an inverse document frequency to one.
STEPS = 1024
#: Shingles times samples that are worked on at once.
CELLS = 8_192
#: Shingles of documents that a verifying task remembers.
HELD = 4_000_000

Weighted = tuple[np.ndarray, np.ndarray]  # codes in order, weights


def levels(documents: int, found: np.ndarray) -> np.ndarray:
    """Inverse document frequencies, in STEPS to one."""
    return np.rint(np.log1p(documents / np.maximum(found, 1)) * STEPS).astype(np.int64)


def shingle_set(codes: np.ndarray, level: np.ndarray) -> Weighted:
    """The weighted set of a document's words, given by their codes and levels."""
    n = min(WORDS, len(codes))
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.concatenate([[0], np.cumsum(level)])
    distinct, first, count = np.unique(grams(codes, n), return_index=True, return_counts=True)
    return distinct, count * (total[n:] - total[:-n])[first]


def shared_and_total(a: Weighted, b: Weighted) -> tuple[int, int]:
    """Weights of what two sets share and of both together; their ratio is the similarity."""
    _, i, j = np.intersect1d(a[0], b[0], True, True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared, int(a[1].sum() + b[1].sum()) - shared


def alike(a: Weighted, b: Weighted) -> bool:
    shared, total = shared_and_total(a, b)
    return total > 0 and shared * PARTS >= total * WHOLES


def _gamma2_quantiles(n: int) -> np.ndarray:
    """x with P(Gamma(2,1) <= x) = (i + 1/2) / n, by bisection."""
    p, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low


class Sampler:
    """ICWS: for each sample k and shingle s, r and c ~ Gamma(2,1) and b ~ U(0,1) by the hash of (k, s);
    t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r; the sample is (s, t) of the least a."""

    def __init__(self):
        q = _gamma2_quantiles(1 << 16)
        self.r, self.log_c = q.astype(np.float32), np.log(q).astype(np.float32)
        self.seeds = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * ODD) | np.uint64(1)

    def samples(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        log_w, n = np.log(weights).astype(np.float32), len(codes)
        out = np.empty(SAMPLES, np.uint64)
        step = max(1, 1 + CELLS // n)  # samples at a time, as many as stay in the processor's cache
        with np.errstate(over="ignore"):
            for at in range(0, SAMPLES, step):
                h = codes * self.seeds[at : at + step, None]
                h ^= h >> np.uint64(32)
                h *= ODD
                parts = h.view(np.uint16).reshape(-1, n, 4)
                r, a = self.r[parts[:, :, 3]], self.log_c[parts[:, :, 2]]
                b = parts[:, :, 1].astype(np.float32)
                b *= np.float32(1 / 65536)
                t = log_w / r
                t += b
                np.floor(t, out=t)
                np.subtract(t, b, out=b)
                b += 1
                b *= r
                a -= b
                s = a.argmin(1)
                level = t[np.arange(len(s)), s].astype(np.int64) & 0xFFFFFFFF
                out[at : at + step] = codes[s] + level.astype(np.uint64) * ODD
        return mixed(out)

    def bands(self, samples: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = samples.reshape(BANDS, ROWS)
            return mixed((x * self.seeds[:ROWS]).sum(1, dtype=np.uint64)).view(np.int64)


def frequencies(chunks: DataFrame) -> DataFrame:
    """For each chunk the number of documents that hold its words (see chunks.answered)."""
    shards = C.shards_for(chunks.agg(F.sum("n_words")).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = C.Chunk(row)
                size = len(chunk.words)
                owner = np.repeat(np.arange(len(chunk.lengths)), chunk.lengths)
                counts = np.bincount(np.unique(owner * size + chunk.places) % size, minlength=size)
                yield from C.table_of(list(C.requests(chunk, chunk.words, [counts], shards))).to_batches()

    def totals(shard: C.Shard) -> list[bytes]:
        found = shard.totals[0, 0]
        return [C.packed(found[shard.at[part]].astype(np.uint32)) for _, part in shard.parts()]

    return C.answered(chunks.mapInArrow(run, C.REQUEST), 1, totals, 0)


def sets_of(mine: pa.Table, found: pa.Table, documents: int, wanted: set[int] | None = None) -> Iterator[tuple[int, int, Weighted]]:
    """(chunk, id, set) of the documents of a chunk that have words."""
    for row in mine.to_pylist():
        chunk = C.Chunk(row)
        counted = np.concatenate([C.unpacked(blob, np.uint32, n) for n, blob in C.answers_of(found, 0)])
        level, ends = levels(documents, counted), np.cumsum(chunk.lengths)
        for i, low, high in zip(chunk.keys, (ends - chunk.lengths).tolist(), ends.tolist()):
            if high - low > 2 and (wanted is None or i in wanted):
                at = chunk.places[low + 1 : high - 1]
                yield chunk.chunk, i, shingle_set(chunk.words[at], level[at])


def band_codes(chunks: DataFrame, answers: DataFrame, documents: int) -> DataFrame:
    """(chunk, id, codes): the codes of the BANDS bands of every text that has words."""

    def run(_: tuple, mine: pa.Table, found: pa.Table) -> pa.Table:
        sampler, of, ids, codes = Sampler(), [], [], [np.empty(0, np.int64)]
        for chunk, i, own in sets_of(mine, found, documents):
            of.append(chunk)
            ids.append(i)
            codes.append(sampler.bands(sampler.samples(*own)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(codes)))
        return pa.table([pa.array(of, pa.int64()), pa.array(ids, pa.int64()), lists], names=["chunk", "id", "codes"])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, "chunk long, id long, codes array<long>")


def set_rows(chunks: DataFrame, answers: DataFrame, documents: int, members: DataFrame) -> DataFrame:
    """(id, n, codes, weights): the sets of the members, packed. members: (chunk, id)."""
    wanted = members.groupBy("chunk").agg(F.collect_set("id").alias("ids"))  # no more than a chunk's documents
    right = answers.select("chunk", "shard", "kind", "n", "answer").withColumn("ids", F.lit(None).cast("array<long>"))
    right = right.unionByName(wanted.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def run(_: tuple, mine: pa.Table, found: pa.Table) -> pa.Table:
        ids = {i for x in found.column("ids").to_pylist() if x for i in x}
        rows = [(i, len(own[0]), C.packed(np.diff(own[0], prepend=np.uint64(0))), C.packed(own[1].astype(np.uint64))) for _, i, own in sets_of(mine, found, documents, ids)] if ids else []
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["id", "n", "codes", "weights"])

    return chunks.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(run, "id long, n long, codes binary, weights binary")


def unpacked_set(n: int, codes: bytes, weights: bytes) -> Weighted:
    return np.cumsum(C.unpacked(codes, np.uint64, n), dtype=np.uint64), C.unpacked(weights, np.uint64, n).astype(np.int64)


def links_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose exact weighted Jaccard similarity is SIMILAR or more. sets: as set_rows gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Weighted] = {}
        size = 0

        def of(i: int, n: int, codes: pa.Scalar, weights: pa.Scalar) -> Weighted:
            """The set of a document; a task meets the documents of a group again and again."""
            nonlocal size
            key = (i, n, codes := codes.as_py())
            if (found := held.get(key)) is None:
                if size > HELD:
                    held.clear()
                    size = 0
                found = held[key] = unpacked_set(n, codes, weights.as_py())
                size += n + 10
            return found

        for batch in batches:
            a, n_a, codes_a, weights_a, b, n_b, codes_b, weights_b = (batch.column(c) for c in ("a", "n_a", "codes_a", "weights_a", "b", "n_b", "codes_b", "weights_b"))
            left, right = (list(zip(x.to_pylist(), n.to_pylist(), c, w)) for x, n, c, w in ((a, n_a, codes_a, weights_a), (b, n_b, codes_b, weights_b)))
            yield batch.select(["a", "b"]).filter(pa.array([alike(of(*x), of(*y)) for x, y in zip(left, right)], pa.bool_()))

    side = lambda s: sets.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "codes", "weights")])
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.sortWithinPartitions("a").select("a", "n_a", "codes_a", "weights_a", "b", "n_b", "codes_b", "weights_b").mapInArrow(run, "a long, b long").distinct()


def shingle_rows(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, class, shingle, weight, total, n) of the members' sets, stored; n is how many members hold the shingle if those of
    several classes do, else 0. members: (id, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, weights = unpacked_set(row["n"], row["codes"], row["weights"])
                n = len(codes)
                columns = [pa.array(np.full(n, row["id"])), pa.array(np.full(n, row["class"])), pa.array(codes.view(np.int64)), pa.array(weights), pa.array(np.full(n, weights.sum()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "class", "shingle", "weight", "total"])

    rows = stored(sets.join(members.distinct(), "id").select("id", "class", "n", "codes", "weights").mapInArrow(run, "id long, class long, shingle long, weight long, total long"), "shingles")
    held = rows.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    held = stored(held.select("shingle", "n"), "held")
    return stored(rows.join(held, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0))), "shingles")


def met_by_hub(unsettled: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the one that has least of its own, the likeliest to be what the others were copied from."""
    shared = rows.groupBy("id").agg((F.sum(F.when(F.col("n") > 0, F.col("weight")).otherwise(0)) / F.max("total")).alias("shared"))
    large = unsettled.join(shared, "id")
    hubs = large.groupBy("band", "code").agg(F.max_by(F.struct("id", "class"), F.struct("shared", "id")).alias("hub"))
    spokes = unsettled.join(stored(hubs, "hubs"), ["band", "code"]).where(F.col("class") != F.col("hub.class"))
    return spokes.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def met_by_prefix(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of members of different classes, all those of similarity SIMILAR or more among them."""
    own = F.sum(F.when(F.col("n") == 0, F.col("weight")).otherwise(0)).over(Window.partitionBy("id"))
    before = Window.partitionBy("id").orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumns({"before": F.coalesce(F.sum("weight").over(before), F.lit(0)), "own": own}).where("n > 0")
    ranked = stored(ranked.where(F.col("before") * PARTS <= F.col("total") * (PARTS - WHOLES)).select("id", "class", "shingle", "total", "before", "own"), "prefixes")
    light = ranked.where(F.col("before") * (PARTS + WHOLES) <= F.col("total") * (PARTS - WHOLES))
    light = light.select("shingle", F.col("id").alias("x"), F.col("class").alias("of_x"), F.col("total").alias("total_x"), F.col("own").alias("own_x"), F.col("before").alias("before_x"))
    shared, shared_x = F.col("total") - F.col("own"), F.col("total_x") - F.col("own_x")
    # neither shares what is its own, so this is the least that both hold together
    possible = F.least(shared, shared_x) * PARTS >= (F.col("own") + F.col("own_x") + F.greatest(shared, shared_x)) * WHOLES
    # what stands before the first shingle that both have is shared by neither; a pair meets at that one for certain
    first = F.least(F.col("total") - F.col("before"), F.col("total_x") - F.col("before_x")) * (PARTS + WHOLES) >= (F.col("total") + F.col("total_x")) * WHOLES
    met = ranked.join(light, "shingle").where(first & (F.col("class") != F.col("of_x")) & (F.struct("total_x", "x") < F.struct("total", "id")) & (F.col("total_x") * PARTS >= F.col("total") * WHOLES) & possible)
    return met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class): a row for each distinct id of df; the class is its smallest id, and the id itself where it has no duplicate."""
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), whole_text(F.col(text)).alias("text"))
    slim = stored(docs.select("id", F.md5("text").alias("sum")), "sums")
    copies = stored(slim.groupBy("sum").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sum", "first"), "copies")
    copied = slim.join(copies, "sum").where("id <> first").select("id", "first").distinct()
    several = slim.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    by_text = copied.join(several, "id", "left_semi").select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b"))
    copied = stored(copied.join(several, "id", "left_anti"), "copies")
    chunks = stored(C.chunked(docs, "id", "text"), "chunks")
    documents = chunks.agg(F.sum(F.size("keys"))).first()[0] or 0
    answers = stored(frequencies(chunks), "frequencies")
    bands = stored(band_codes(chunks, answers, documents), "bands")
    rows = bands.join(copied.select("id"), "id", "left_anti").select("chunk", "id", F.posexplode("codes").alias("band", "code"))
    sizes = rows.groupBy("band", "code").agg(F.count(F.lit(1)).alias("m"), F.min_by("id", F.xxhash64("band", "id")).alias("leader")).where("m > 1")
    members = stored(rows.join(stored(sizes, "sizes"), ["band", "code"]), "buckets")
    sets = stored(set_rows(chunks, answers, documents, members.select("chunk", "id").distinct()), "sets")
    for done in (chunks, answers, bands):
        discard(done)
    small = members.where(F.col("m") <= SMALL)
    every = small.select("band", "code", F.col("id").alias("a")).join(small.select("band", "code", F.col("id").alias("b")), ["band", "code"]).where("a < b").select("a", "b")
    star = members.where((F.col("m") > SMALL) & (F.col("id") != F.col("leader"))).select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
    links = stored(links_of(every.union(star).distinct(), sets).union(by_text), "verified")
    found = components(links)
    for by_hub in (True, True, False):
        large = members.where(F.col("m") > SMALL).select("band", "code", "id").join(found.select(F.col("node").alias("id"), "class"), "id", "left").withColumn("class", F.coalesce("class", "id"))
        mixed_ones = stored(large.groupBy("band", "code").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("band", "code"), "unsettled")
        unsettled = stored(large.join(mixed_ones, ["band", "code"], "left_semi"), "unsettled")
        if unsettled.isEmpty():
            break
        rows = shingle_rows(unsettled.select("id", "class"), sets)
        more = stored(links_of(met_by_hub(unsettled, rows) if by_hub else met_by_prefix(rows), sets), "verified")
        discard(rows)
        if not more.isEmpty():
            links = stored(links.union(more), "verified")
            found = components(links)
    for done in (members, sets, links):
        discard(done)
    first = slim.select("id").distinct().join(copied, "id", "left").withColumn("rep", F.coalesce("first", "id"))
    return first.join(found.select(F.col("node").alias("rep"), "class"), "rep", "left").select("id", F.coalesce("class", "rep").alias("class"))


def op8_near_dup(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id of every document: documents of a class are near or exact copies, linked directly or by others."""
    return classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"))


def keep_first(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class, the document of smallest id; of rows that repeat this id, one. All documents without a
    word, null ones too, are copies of each other only if their texts are equal (null is empty)."""
    rest = classes(docs).where("id <> class").select(F.col("id").alias("doc_id"))
    kept = docs.join(rest, "doc_id", "left_anti")
    repeated = stored(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(once)
    return kept.select(*docs.columns)
