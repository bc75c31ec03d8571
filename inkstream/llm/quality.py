"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. It is learnt from preference pairs (a row labelled 1 is
preferred to a row labelled 0) by logistic loss on the difference of their features. A quantile of the strengths, at the
share of 0 among the labelled rows, is the threshold; the score is a logistic curve that is exactly 0.3 there.

The model is fitted on the driver from at most MAX_LABELLED labelled rows, those of smallest hash, so its cost does not
grow with the input; every document is scored where it is read, without a shuffle. Labels, language, source and id are
never features. Null texts are empty texts and get a score too. Where the labels do not hold both classes every
document scores 0.5. Repeated rows are scored once each (a labelled id that repeats teaches once), a null id is not held out,
no documents give no rows, and columns of the input are carried along but for one of the score's name. Labels that are null,
or contradict each other for a document, teach nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.llm._common import strings, table, whole_text

#: Labelled rows and preference pairs that a model is fitted on, at most.
MAX_LABELLED, MAX_PAIRS = 20_000, 200_000
CUT = 0.3
SYMBOLS = [i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,'-"]
FEATURES = ("words", "word_length", "symbols", "shouted", "exclaimed", "bars", "distinct", "repeated", "commonest", "same_lines", "stops", "joined")


def features(text: str) -> list[float]:
    """Numbers between 0 and about 1 that describe a whole text; all 0 for the empty text."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, lines = len(words), text.split("\n")
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    counts = Counter(words)
    return [
        math.log1p(n) / 10,
        min(1.0, sum(map(len, words)) / n / 20),
        raw[SYMBOLS].sum() / n / 3,
        sum(map(str.isupper, words)) / n,
        raw[33] / n,
        raw[124] / n,
        len(counts) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        (max(counts.values()) - 1) / n,
        1 - len(set(lines)) / len(lines),
        min(1.0, raw[46] / n),
        sum(map(str.isalpha, words)) / n,
    ]


def with_features(df: DataFrame, text: str, out: str) -> DataFrame:
    kept = [c for c in df.columns if c not in (out, text)]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(map(float, features(x))) for x in strings(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(found, pa.list_(pa.float64()))], names=[*kept, out])

    return df.select(*kept, whole_text(F.col(text)).alias(text)).mapInArrow(run, schema)


class Ranking:
    """strength(x) = weights . (x - mean) / spread; score = logistic(slope x (strength - threshold) + logit(cut))."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cut: float = CUT, seed: int = 7):
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.fitted = bool(len(good) and len(bad))
        if not self.fitted:
            return
        self.mean, self.spread = x.mean(0), x.std(0)
        self.spread[self.spread < 1e-9] = 1.0
        z = (x - self.mean) / self.spread
        pick = np.random.default_rng(seed)
        pairs = min(MAX_PAIRS, 20 * len(x))
        d = z[pick.choice(good, pairs)] - z[pick.choice(bad, pairs)]
        w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps on the mean logistic loss with a ridge
            p = 1 / (1 + np.exp(d @ w))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + 1e-3 * np.eye(len(w)), d.T @ p / pairs - 1e-3 * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        strength = np.sort(z @ w)
        k = len(bad)  # the quantile at the share of 0
        self.threshold = float((strength[k - 1] + strength[k]) / 2)
        self.slope = 2.0 / max(1e-9, float(strength.std()))
        self.base = math.log(cut / (1 - cut))

    def score(self, x: Column) -> Column:
        if not self.fitted:
            return F.lit(0.5)
        per = self.weights / self.spread * self.slope
        const = self.base - self.slope * self.threshold - float(per @ self.mean)
        terms = F.lit(const)
        for i, c in enumerate(per.tolist()):
            terms = terms + x[i] * F.lit(c)
        return 1 / (1 + F.exp(-terms))


def held_out(key: Column) -> Column:
    """Null keys are not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Ranking:
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key))).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("top")).where("y = top").select(key, "y")
    known = known.orderBy(F.xxhash64(key), key).limit(MAX_LABELLED)
    rows = with_features(docs.select(key, text).join(F.broadcast(known), key), text, "x").groupBy(key).agg(F.min("x").alias("x"), F.min("y").alias("y")).collect()
    return Ranking(np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows]))


def scored(docs: DataFrame, model: Ranking, text: str = "text", out: str = "score") -> DataFrame:
    """docs without its text, and with a score from 0 to 1."""
    return with_features(docs, text, "__quality_features").withColumn(out, model.score(F.col("__quality_features"))).drop("__quality_features")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not rejected."""
    model = fitted(docs, table(spark, sf_dir, "labels"))
    kept = list(docs.columns)
    carried = docs.withColumn("__quality_text", whole_text(F.col("text")))
    return scored(carried, model, "__quality_text", "__quality_score").where(F.col("__quality_score") >= CUT).select(*kept)
