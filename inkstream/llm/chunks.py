"""Corpus statistics by chunks: each chunk asks the shards of a table of counts once, and is answered once.

A chunk is a row: some CHUNK words of whole documents, as places in a list of the chunk's distinct words. What is counted
(words, pairs) is known by a 64-bit code. A chunk sums up its own counts, sorts them by code and cuts them at the shards,
which are equal ranges of codes; a shard adds up what all chunks send and answers every chunk in the order it asked in. So
a count crosses the network once for each chunk that holds it and not once for each document, a code that stands everywhere
costs a shard one entry a chunk, and every document gets the exact counts of all documents without a table that is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.llm._common import ODD, WordCodes, mixed, strings, whole_text

#: Words of a chunk and entries of a shard, about: bounds on the memory of a task, not on the input.
CHUNK, SHARD = 1_500_000, 1_000_000
#: The word before the first and after the last of a document.
EDGE = np.uint64(1)


def packed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T
    return pa.compress(np.ascontiguousarray(planes).data, codec="zstd", asbytes=True)


def unpacked(blob: bytes, kind, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, kind)
    size = np.dtype(kind).itemsize
    raw = pa.decompress(blob, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


CHUNK_FIELDS = [T.StructField(name, kind) for name, kind in (("chunk", T.LongType()), ("side", T.IntegerType()), ("n", T.LongType()), ("n_words", T.LongType()), ("n_tokens", T.LongType()), ("n_marked", T.LongType()), ("lengths", T.BinaryType()), ("marks", T.BinaryType()), ("words", T.BinaryType()), ("places", T.BinaryType()))]


def chunked(docs: DataFrame, key: str, text: str, side: Column | None = None, mark: Column | None = None) -> DataFrame:
    """Chunks of documents; those of a chunk are of one side (0 or 1). mark: a boolean that goes with each document.
    n counts words and edges, n_words distinct ones, n_tokens pairs of neighbours, n_marked those of marked documents."""
    rows = docs.select(F.col(key).alias("key"), whole_text(F.col(text)).alias("text"), (F.lit(0) if side is None else side).alias("side"), (F.lit(False) if mark is None else F.coalesce(mark, F.lit(False))).alias("mark"))
    schema = T.StructType([*CHUNK_FIELDS, T.StructField("keys", T.ArrayType(docs.schema[key].dataType))])
    size = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, open_, made = WordCodes(str.lower), {}, TaskContext.get().partitionId() << 32

        def closed(side: int) -> pa.RecordBatch:
            nonlocal made
            keys, marks, parts, _, kind = open_.pop(side)
            made += 1
            words, places = np.unique(np.concatenate(parts), return_inverse=True)
            lengths = np.array(list(map(len, parts)), np.uint32)
            blobs = (packed(lengths), packed(np.array(marks, np.uint8)), packed(np.diff(words, prepend=np.uint64(0))), packed(places.astype(np.uint32)))
            tokens = lengths.astype(np.int64) - 1
            numbers = (len(places), len(words), int(tokens.sum()), int(tokens[np.array(marks, bool)].sum()))
            columns = [pa.array([made], pa.int64()), pa.array([side], pa.int32()), *[pa.array([x], pa.int64()) for x in numbers], *[pa.array([b], pa.binary()) for b in blobs], pa.array([keys], pa.list_(kind))]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            kind = batch.column("key").type
            for k, x, s, m in zip(batch.column("key").to_pylist(), strings(batch.column("text")), batch.column("side").to_pylist(), batch.column("mark").to_pylist()):
                keys, marks, parts, held, _ = open_.setdefault(s, [[], [], [], 0, kind])
                words = x.split()
                own = np.full(len(words) + 2, EDGE, np.uint64)
                own[1:-1] = codes.of(words)
                keys.append(k)
                marks.append(bool(m))
                parts.append(own)
                open_[s][3] = held + len(own)
                if open_[s][3] >= size:
                    yield closed(s)
        for s in list(open_):
            yield closed(s)

    return rows.mapInArrow(run, schema)


class Chunk:
    """A chunk read back: codes of its distinct words in order, place of each word, document of each word."""

    def __init__(self, row: dict):
        self.chunk, self.side, self.keys = row["chunk"], row["side"], row["keys"]
        count = len(self.keys)
        self.lengths = unpacked(row["lengths"], np.uint32, count).astype(np.int64)
        self.marks = unpacked(row["marks"], np.uint8, count).astype(bool)
        self.words = np.cumsum(unpacked(row["words"], np.uint64, row["n_words"]), dtype=np.uint64)
        self.places = unpacked(row["places"], np.uint32, row["n"]).astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, which, document): places of the two words of each distinct pair of neighbours, in the order of
        their codes; for each pair as it stands, which of these it is and whose."""
        ends = np.cumsum(self.lengths) - 1
        starts = np.ones(len(self.places), bool)
        starts[ends] = False
        at = np.flatnonzero(starts)
        distinct, which = np.unique(self.places[at] * len(self.words) + self.places[at + 1], return_inverse=True)
        first, second = np.divmod(distinct, len(self.words))
        order = np.argsort(pair_codes(self.words[first], self.words[second]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return first[order], second[order], place[which], np.repeat(np.arange(len(self.lengths)), self.lengths - 1)


def pair_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * ODD
        x ^= x >> np.uint64(32)
        x += b
        return mixed(x)


REQUEST = "chunk long, side int, shard int, n long, codes binary, counts binary"
REQUEST_SCHEMA = pa.schema([("chunk", pa.int64()), ("side", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])


def requests(chunk: Chunk, codes: np.ndarray, counts: list[np.ndarray], shards: int) -> Iterator[dict]:
    """What a chunk asks of each shard. codes: in order, distinct; counts: of each kind, in the order of codes."""
    shard = ((codes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    edges = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[s], edges[s + 1])
        sent = np.concatenate([c[part] for c in counts]).astype(np.uint32)
        yield {"chunk": chunk.chunk, "side": chunk.side, "shard": s, "n": int(edges[s + 1] - edges[s]), "codes": packed(np.diff(codes[part], prepend=np.uint64(0))), "counts": packed(sent)}


class Shard:
    """All requests to a shard, added up. `totals` of a kind and side are by distinct code; `at` says which code each
    entry of the requests is, one request after the other."""

    def __init__(self, rows: pa.Table, kinds: int):
        self.n = rows.column("n").to_numpy()
        self.chunks = rows.column("chunk").to_pylist()
        sides = rows.column("side").to_numpy()
        codes = np.concatenate([np.cumsum(unpacked(c.as_py(), np.uint64, n), dtype=np.uint64) for c, n in zip(rows.column("codes"), self.n)])
        counts = [unpacked(c.as_py(), np.uint32, n * kinds).reshape(kinds, n) for c, n in zip(rows.column("counts"), self.n)]
        self.counts = np.concatenate(counts, 1)
        distinct, self.at = np.unique(codes, return_inverse=True)
        self.size, self.side = len(distinct), np.repeat(sides, self.n)
        self.totals = np.zeros((2, kinds, self.size), np.int64)
        for s in np.unique(sides).tolist():
            mine = self.side == s
            for k in range(kinds):
                self.totals[s, k] = np.bincount(self.at[mine], self.counts[k, mine], self.size)

    def firsts(self, kind: int) -> np.ndarray:
        """Marks one entry of each code that its side has counted at all."""
        out = np.zeros(len(self.at), bool)
        for s in (0, 1):
            mine = np.flatnonzero((self.side == s) & (self.counts[kind] > 0))
            out[mine[np.unique(self.at[mine], return_index=True)[1]]] = True
        return out

    def parts(self) -> Iterator[tuple[int, slice]]:
        """Each chunk that asks, and where its entries stand."""
        ends = np.cumsum(self.n)
        return zip(self.chunks, map(slice, ends - self.n, ends))


def answered(asked: DataFrame, kinds: int, answer: Callable[[Shard], list[bytes]], kind: int) -> DataFrame:
    """(chunk, shard, kind, n, size, answer): what `answer` makes for each request (of n codes) to a shard; size is the shard's
    number of distinct codes, on its first row, else 0."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard = Shard(rows, kinds)
        n = len(shard.n)
        columns = [pa.array(shard.chunks, pa.int64()), pa.array([key[0].as_py()] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array(shard.n), pa.array([shard.size] + [0] * (n - 1), pa.int64()), pa.array(answer(shard), pa.binary())]
        return pa.table(columns, names=["chunk", "shard", "kind", "n", "size", "answer"])

    return asked.groupBy("shard").applyInArrow(run, "chunk long, shard int, kind int, n long, size long, answer binary")


def answers_of(rows: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """(codes, answer) of a kind in the order of shards, which is that of codes."""
    found = zip(*(rows.column(c).to_pylist() for c in ("kind", "shard", "n", "answer")))
    return [(n, a) for _, n, a in sorted((s, n, a) for k, s, n, a in found if k == kind)]


def shards_for(entries: int) -> int:
    return max(1, -(-entries // SHARD))


def table_of(rows: list[dict]) -> pa.Table:
    """Requests as an Arrow table."""
    return pa.Table.from_pylist(rows, schema=REQUEST_SCHEMA)
