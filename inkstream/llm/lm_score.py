"""Language-model scores by cross-entropy difference, of bigram models of every word.

The target model counts the documents of the target, the background model all documents. Both are of every lower-cased
word of the corpus and one symbol before the first and after the last word, interpolated absolute discounting over add-one
unigrams, and differ in their data alone. A document's score is the mean over its tokens of (loss under the target model -
loss under the background model): the lower, the more it is like the target. Documents are dealt to two folds by the hash
of their key, and each is scored by the models of the other fold, which have not seen it.

No count is cut off and none is collected: chunks of documents ask the shards of the counts (see chunks). With c(ab), c(a)
the counts of a pair and a word, s(a) the distinct words after a, and u(b) = (c(b) + 1) / (N + V),

    p(b | a) = max(c(ab) - D, 0) / c(a) + D s(a) / c(a) u(b),    and u(b) where c(a) = 0

Chunks first ask for c(ab). A shard marks one entry of every pair for each model, so that the marked entries of a word's
pairs, added up over all chunks, are s(a); with c(a) they are what chunks ask for next. Only N and V reach the driver.

Null and empty texts have one token (the end). The key is unique in docs; rows that repeat one are scored each. Without
target documents the target's model is uniform. Other columns of docs are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.llm import chunks as C
from inkstream.llm._common import stored, table

DISCOUNT = 0.75
#: Keys of target documents up to which they are sent to all executors; beyond it they are joined by a shuffle.
MAX_SENT = 1_000_000
MODELS = ("background", "target")
PAIRS, WORDS = 0, 1  # kinds of answers


def fold(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(key).cast("string")), F.lit(2)).cast("int")


def pair_requests(chunks: DataFrame, shards: int) -> DataFrame:
    """How often the pairs of a chunk stand in all its documents and in those of the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = C.Chunk(row)
                first, second, which, doc = chunk.pairs()
                counts = [np.bincount(which, minlength=len(first)), np.bincount(which[chunk.marks[doc]], minlength=len(first))]
                yield from C.table_of(list(C.requests(chunk, C.pair_codes(chunk.words[first], chunk.words[second]), counts, shards))).to_batches()

    return chunks.mapInArrow(run, C.REQUEST)


def pair_answers(shard: C.Shard) -> list[bytes]:
    """For each pair whether the other fold has it, and if so how often, and whether this entry is the marked one of a model."""
    marked = [shard.firsts(k) for k in (0, 1)]
    out = []
    for _, part in shard.parts():
        at, side = shard.at[part], shard.side[part][0]
        other = shard.totals[1 - side][:, at]
        there = other[0] > 0
        flags = C.packed(np.concatenate([np.packbits(x) for x in (there, *(m[part] for m in marked))]))
        values = other[:, there].astype(np.uint32).ravel()
        out.append(np.array([len(flags), len(values)], np.uint32).tobytes() + flags + C.packed(values))
    return out


def read_pair_answers(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(counts of the other fold, marks), both by model and pair."""
    counts, marks = [np.empty((2, 0), np.int64)], [np.empty((2, 0), bool)]
    for n, blob in C.answers_of(found, PAIRS):
        size, n_values = np.frombuffer(blob[:8], np.uint32).tolist()
        flags = C.unpacked(blob[8 : 8 + size], np.uint8, 3 * (-(-n // 8)))
        there, *mine = (np.unpackbits(x, count=n).astype(bool) for x in np.split(flags, 3))
        own = np.zeros((2, n), np.int64)
        own[:, there] = C.unpacked(blob[8 + size :], np.uint32, n_values).reshape(2, -1)
        counts.append(own)
        marks.append(np.stack(mine))
    return np.concatenate(counts, 1), np.concatenate(marks, 1)


def word_requests(chunks: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    """c(a) and this chunk's part of s(a), of either model."""

    def run(key: tuple, mine: pa.Table, found: pa.Table) -> pa.Table:
        out: list[dict] = []
        for row in mine.to_pylist():
            chunk = C.Chunk(row)
            first, _, which, doc = chunk.pairs()
            size, of = len(chunk.words), first[which]
            seen = [np.bincount(first[m], minlength=size) for m in read_pair_answers(found)[1]]
            out += C.requests(chunk, chunk.words, [np.bincount(of, minlength=size), np.bincount(of[chunk.marks[doc]], minlength=size), *seen], shards)
        return C.table_of(out)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, C.REQUEST)


def word_answers(shard: C.Shard) -> list[bytes]:
    """c(a) and s(a) of the other fold, of either model."""
    return [C.packed(shard.totals[1 - shard.side[part][0]][:, shard.at[part]].astype(np.uint32).ravel()) for _, part in shard.parts()]


def losses(chunk: C.Chunk, found: pa.Table, totals: dict[str, int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, target loss, background loss) of each document. totals: tokens by model and fold; size: distinct words."""
    first, second, which, doc = chunk.pairs()
    joint, _ = read_pair_answers(found)
    counted = np.concatenate([C.unpacked(blob, np.uint32, 4 * n).reshape(4, n) for n, blob in C.answers_of(found, WORDS)], 1).astype(np.int64)
    tokens, means = chunk.lengths - 1, []
    for model in (1, 0):
        word, seen = counted[model], counted[2 + model]
        unigram = (word[second] + 1.0) / (totals[f"{MODELS[model]}_{1 - chunk.side}"] + size)
        after = np.maximum(word[first], 1)
        p = np.maximum(joint[model] - DISCOUNT, 0) / after + np.where(word[first] > 0, DISCOUNT * seen[first] / after, 1.0) * unigram
        means.append(np.bincount(doc, -np.log(p)[which], len(tokens)) / tokens)
    return tokens, means[0], means[1]


def cross_entropy(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, target_loss, background_loss (means per token) and score, their difference. targets: a row for each
    key of the target."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType
    aimed = targets.select(F.col(key).alias("_key"), F.lit(True).alias("_mark")).distinct()
    aimed = F.broadcast(aimed) if aimed.count() <= MAX_SENT else aimed
    chunks = stored(C.chunked(docs.select(key, text).join(aimed, F.col(key) == F.col("_key"), "left"), key, text, fold(key), F.col("_mark")), "lm-chunks")
    shards = [C.shards_for(n or 0) for n in chunks.agg(F.sum("n"), F.sum("n_words")).first()]
    pairs = stored(C.answered(pair_requests(chunks, shards[0]), 2, pair_answers, PAIRS), "lm-pairs")
    spark._jvm.System.gc()  # lets Spark remove the shuffle files of the requests
    words = stored(C.answered(word_requests(chunks, pairs, shards[1]), 4, word_answers, WORDS), "lm-words")
    spark._jvm.System.gc()
    size = words.agg(F.sum("size")).first()[0] or 0
    totals = {f"{m}_{s}": 0 for m in MODELS for s in (0, 1)}
    for r in chunks.groupBy("side").agg(F.sum("n_tokens").alias("n"), F.sum("n_marked").alias("m")).collect():
        totals[f"background_{r['side']}"], totals[f"target_{r['side']}"] = r["n"], r["m"]

    def run(_: tuple, mine: pa.Table, found: pa.Table) -> pa.Table:
        parts = []
        for i, row in enumerate(mine.to_pylist()):
            tokens, target, background = losses(C.Chunk(row), found, totals, size)
            parts.append(pa.table([mine.column("keys")[i].values, pa.array(tokens), pa.array(target), pa.array(background)], names=[key, "n_tokens", "target_loss", "background_loss"]))
        return pa.concat_tables(parts)

    fields = [T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), *[T.StructField(f"{m}_loss", T.DoubleType()) for m in reversed(MODELS)]]
    scored = chunks.groupBy("chunk").cogroup(pairs.union(words).groupBy("chunk")).applyInArrow(run, T.StructType(fields))
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op2_cross_entropy(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every document; the target is what labels.quality marks 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cross_entropy(docs, table(spark, sf_dir, "labels").where("quality = 1"))
