"""Exact top-k inner products with block-at-a-time pruning.

Components are the terms of a vector and their integer values the term weights. A shard sorts its rows so that alike
vectors are neighbours, cuts them into document-range blocks and keeps their rows in this order in a table, built once. A block
has a forward index (its rows' values) and, per term, the largest and the smallest value, which are taken again for each pair of a
shard and a group of queries; the k-th score is that of the shard. For a query, the sum over terms of
weight x maximum (or minimum, for a negative weight) bounds every score in a block; blocks are scored by falling bound until
it is below the k-th score so far. The result is exact for any data; what pruning saves depends on how the vectors cluster:
groups of alike vectors leave most blocks unread, while of vectors in random directions every block has to be read, as the
sum of maxima over many terms is then far above any score.

Rows are dealt to shards and queries to groups by hash, so every task holds a bounded number of both; each pair of a
shard and a group is one row, and each query keeps k rows of each shard for the final merge. The query set is a stated
part of the rows, searched against all rows in blocks; no all-pairs join takes place.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Equal rows are
candidates each (they are counted first and kept once); a query's own id is never its candidate, and rows that repeat a
query's id are that query, with the best of either vector. A vector shorter than another counts as zero in the terms it
lacks. Ties go to the smaller id. Fewer than k candidates: all of them. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from inkstream.llm._common import stored, table

ROWS_PER_SHARD, QUERIES_PER_GROUP, BLOCK = 8192, 65_536, 32
#: Blocks that are scored at once.
AT_ONCE = 16


def integer_vector(v: Column) -> Column:
    """floor(256 x) of each component; null where the vector takes no part."""
    x = v.cast("array<double>")
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(fit, F.transform(x, lambda c: F.floor(c * 256).cast("long")))


def _matrix(vectors: pd.Series) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _order(matrix: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Neighbours are alike: rows sorted by their nearest of about sqrt(n) rows of the shard, then by how near, then by id."""
    pivots = matrix[:: max(1, int(len(ids) ** 0.5))].astype(np.float64)
    score = matrix.astype(np.float64) @ pivots.T
    near = np.argmax(score, 1)
    return np.lexsort((ids, -score[np.arange(len(ids)), near], near))


class Blocks:
    """The index of a shard. count: how often each row stands in the table."""

    def __init__(self, ids: np.ndarray, count: np.ndarray, matrix: np.ndarray):
        n, width = matrix.shape
        whole = -(-n // BLOCK) * BLOCK
        self.ids, self.count = np.full(whole, -1), np.zeros(whole, np.int64)
        self.ids[:n], self.count[:n] = ids, count
        self.forward = np.zeros((whole, width), matrix.dtype)
        self.forward[:n] = matrix
        self.forward[n:] = matrix[-1:]
        self.forward = self.forward.reshape(-1, BLOCK, width)
        self.top, self.low = self.forward.max(1), self.forward.min(1)

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
        """The k best (id, score, count) for a query, ties to the smaller id, and how many blocks were scored."""
        bounds = self.top @ np.maximum(q, 0) + self.low @ np.minimum(q, 0)
        order = np.argsort(-bounds, kind="stable")
        score, where, at, least = np.empty(0, q.dtype), np.empty(0, np.int64), 0, None
        while at < len(order) and (least is None or bounds[order[at]] >= least):
            few = order[at : at + AT_ONCE]
            if least is not None:
                few = few[bounds[few] >= least]
            at += len(few)
            found = (self.forward[few] @ q).ravel()
            place = (few[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            use = (self.count[place] > 0) & (self.ids[place] != own)
            if least is not None:
                use &= found >= least
            score, where = np.concatenate([score, found[use]]), np.concatenate([where, place[use]])
            keep = np.lexsort((self.ids[where], np.unique(-score, return_inverse=True)[1]))[:k]
            score, where = score[keep], where[keep]
            if len(score) == k:
                least = score[-1]
        return [(int(self.ids[w]), int(s), int(self.count[w])) for w, s in zip(where, score)], at


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """Floats where their sums are exact, else Python's whole numbers."""
    peak = [max(1, *(abs(int(y)) for y in (x.max(), x.min()))) if x.size else 1 for x in (a, b)]
    return np.float64 if peak[0] * peak[1] * max(a.shape[1], 1) < 2**53 else object


PACKED = "ids binary, counts binary, n_terms int, terms binary"


def _packed(rows: pd.DataFrame, sort: bool) -> pd.DataFrame:
    ids, counts, matrix = rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), _matrix(rows["v"])
    if sort:
        order = _order(matrix, ids)
        ids, counts, matrix = ids[order], counts[order], matrix[order]
    return pd.DataFrame({"ids": [ids.tobytes()], "counts": [counts.tobytes()], "n_terms": [matrix.shape[1]], "terms": [matrix.tobytes()]})


def _unpacked(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, counts = (np.frombuffer(row[f"{c}_{side}"], np.int64) for c in ("ids", "counts"))
    return ids, counts, np.frombuffer(row[f"terms_{side}"], np.int64).reshape(len(ids), row[f"n_terms_{side}"])


def exact_top_k(df: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score."""
    rows = df.select(F.col(key).cast("long").alias("id"), is_query.alias("is_query"), integer_vector(F.col(vector)).alias("v"))
    rows = rows.where("id is not null and v is not null").groupBy("id", "v").agg(F.bool_or("is_query").alias("is_query"), F.count(F.lit(1)).alias("n"))
    rows = stored(rows, "topk-rows")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    shards, groups = -(-max(n, 1) // ROWS_PER_SHARD), -(-max(n_queries, 1) // QUERIES_PER_GROUP)
    dealt = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(parts)).cast("int")

    def packed(part: DataFrame, name: str, sort: bool) -> DataFrame:
        keyed = lambda key, rows: _packed(rows, sort).assign(**{name: key[0]})
        return part.groupBy(name).applyInPandas(keyed, f"{PACKED}, {name} int")

    side = lambda df, s, keys: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "counts", "n_terms", "terms")])
    index = stored(packed(rows.select("id", "v", "n", dealt(shards, 1).alias("shard")), "shard", True), "topk-index")
    asked = packed(rows.where("is_query").select("id", "v", "n", dealt(groups, 2).alias("part")), "part", False)
    asked = side(asked, "q", ["part"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                (ids, counts, a), (asking, _, b) = (_unpacked(row, s) for s in "rq")
                width = max(a.shape[1], b.shape[1])
                a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
                kind = _kind(a, b)
                blocks, found = Blocks(ids, counts, a.astype(kind)), []
                for own, q in zip(asking.tolist(), b.astype(kind)):
                    found += [(own, i, max(-(2**63), min(2**63 - 1, s)), n) for i, s, n in blocks.search(own, q, k)[0]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found) if found else [[]] * 4)], names=["query_id", "vec_id", "score", "n"])

    # The queries of all shards together are as many as queries times shards: they are dealt to the shards, never broadcast by the driver.
    ranked = side(index, "r", ["shard"]).repartition(shards, "shard").hint("shuffle_hash")
    parts = ranked.join(asked.repartition(shards, "shard"), "shard").mapInArrow(run, "query_id long, vec_id long, score long, n long")
    each = parts.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The 5 best rows of embeddings for each vec_id divisible by 50."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ORACLE = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5"""
