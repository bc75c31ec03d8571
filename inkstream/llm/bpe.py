"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a vocabulary entry is resolved by one
probe and one comparison. Tier two takes the misses: their bytes are nodes of a linked list and a heap yields the pair of
lowest rank, leftmost first, so a pre-token of n bytes costs O(n log n).

Every row is encoded by itself (no shuffle). Null texts are empty texts; an empty text has no ids and decodes to no bytes.
Repeated rows are encoded once each, null keys are carried along, no rows give no rows; columns of the input that bear names of
the result's own are replaced.
The vocabulary is a parameter (a rank file's path); its size is fixed and checked before it is broadcast.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.llm._common import strings, table, whole_text

#: A vocabulary beyond this is refused rather than broadcast.
MAX_VOCABULARY = 1_000_000
#: Chunks of text, and pre-tokens that are not in the vocabulary, that one worker process remembers at a time.
MEMO = 500_000


class MinimalPerfectHash:
    """Hash and displace: n keys to n slots. A bucket's displacement moves all its keys to free slots together."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = n = len(keys)
        self.m = max(1, n // per_bucket)
        first, second = self._hashes(keys)
        bucket = (first % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.m + 1))
        self.shift = np.zeros(self.m, np.int64)
        self.slot_of_key = np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        sizes = np.diff(starts)
        tries = np.arange(512, dtype=np.uint64)[:, None]
        for b in np.argsort(-sizes, kind="stable"):
            mine = order[starts[b] : starts[b + 1]]
            if len(mine) < 2:
                break
            at = np.uint64(0)
            while True:
                slots = self._slots(second[mine][None, :], tries + at)
                free = ~taken[slots].any(1)
                if len(mine) > 1:
                    free &= (np.diff(np.sort(slots, 1), axis=1) > 0).all(1)
                if free.any():
                    k = int(np.argmax(free))
                    self.shift[b], taken[slots[k]], self.slot_of_key[mine] = int(at) + k, True, slots[k]
                    break
                at += np.uint64(512)
        left = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(sizes == 1):  # a bucket of one key names its slot outright
            self.shift[b] = -1 - (slot := int(next(left)))
            self.slot_of_key[order[starts[b]]] = slot
        self._shift = self.shift.tolist()

    @staticmethod
    def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h = [xxhash.xxh3_128_intdigest(k) for k in keys]
        return np.array([x >> 64 for x in h], np.uint64), np.array([x & (2**64 - 1) for x in h], np.uint64)

    def _slots(self, second: np.ndarray, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (second ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(key)
        d = self._shift[(h >> 64) % self.m]
        if d < 0:
            return -1 - d
        x = ((h & 0xFFFFFFFFFFFFFFFF) ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return (x >> 32) % self.n


class Codec:
    """The two-tier encoder and the decoder of one rank file."""

    def __init__(self, entries: list[tuple[bytes, int]], pattern: str):
        if not 0 < len(entries) <= MAX_VOCABULARY:
            raise ValueError(f"a vocabulary of {len(entries)} entries; from 1 to {MAX_VOCABULARY} are taken")
        self.pattern = pattern
        self.ranks = dict(entries)
        self.bytes_of = dict((rank, token) for token, rank in entries)
        keys = list(self.ranks)
        self.hash = MinimalPerfectHash(keys)
        self.slots: list[tuple[bytes, int, bytes]] = [(b"", 0, b"")] * len(keys)
        for key, slot in zip(keys, self.hash.slot_of_key.tolist()):
            self.slots[slot] = (key, self.ranks[key], array("i", [self.ranks[key]]).tobytes())
        self._ready()

    def _ready(self) -> None:
        self.find = regex.compile(self.pattern).findall
        #: A run of white space that splitting at single spaces would cut.
        self.joined = regex.compile(r"\s (?:\s|$)|  ").search
        self.memo: dict[str, bytes] = {}
        self.missed: dict[bytes, bytes] = {}
        #: Where each rank's bytes stand in `entries`.
        ranks = np.fromiter(self.bytes_of, np.int64, len(self.bytes_of))
        self.place = np.zeros(ranks.max() + 1, np.int32)
        self.place[ranks] = np.arange(len(ranks))
        self.entries = pa.array(self.bytes_of.values(), pa.binary())

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "joined", "memo", "missed", "place", "entries")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def merged(self, token: bytes) -> list[int]:
        """Tier two: merge the pair of lowest rank, leftmost first, until no pair is in the vocabulary."""
        rank_of, n = self.ranks.get, len(token)
        after = list(range(1, n + 2))  # where the next part starts, and so where this one ends
        before = list(range(-1, n))
        pair = [rank_of(token[i : i + 2], -1) for i in range(n - 1)] + [-1]  # rank of a part joined with the next
        bits = n.bit_length()  # entries of short tokens are small numbers
        low = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & low
            if pair[i] != entry >> bits:
                continue  # one of the two has been merged since
            j = after[i]
            after[i] = k = after[j]
            pair[i] = pair[j] = -1
            if k < n:
                before[k] = i
                pair[i] = r = rank_of(token[i : after[k]], -1)
                if r >= 0:
                    heappush(heap, r << bits | i)
            if (h := before[i]) >= 0:
                pair[h] = r = rank_of(token[h:k], -1)
                if r >= 0:
                    heappush(heap, r << bits | h)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[token[i : after[i]]])
            i = after[i]
        return ids

    def token_ids(self, token: bytes) -> list[int]:
        key, rank, _ = self.slots[self.hash.slot(token)]
        return [rank] if key == token else self.merged(token)

    def _packed_token(self, token: bytes) -> bytes:
        key, _, packed = self.slots[self.hash.slot(token)]
        if key == token:
            return packed
        if (found := self.missed.get(token)) is None:
            if len(self.missed) >= MEMO:
                self.missed.clear()
            self.missed[token] = found = array("i", self.merged(token)).tobytes()
        return found

    def _packed(self, chunk: str) -> bytes:
        return b"".join([self._packed_token(token.encode("utf-8", "surrogatepass")) for token in self.find(chunk)])

    def _remembered(self, chunk: str) -> bytes:
        if (found := self.memo.get(chunk)) is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[chunk] = found = self._packed(" " + chunk)
        return found

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where those of each begin and the last end.

        No pre-token continues over a single space between two other characters, so such chunks are encoded (and remembered) one by
        one, each once however often these texts have it; a text with longer runs of white space is matched as a whole."""
        whole = [self.joined(x) is not None for x in texts]
        parts = pc.split_pattern(pa.array(["" if w else x for x, w in zip(texts, whole)], pa.large_string()), " ")
        starts = parts.offsets.to_numpy()
        chunks = parts.values.dictionary_encode()
        packed = list(map(self._remembered, chunks.dictionary.to_pylist()))
        at = chunks.indices.to_numpy().copy()
        at[starts[:-1]] = np.arange(len(packed), len(packed) + len(texts))  # a text's beginning has no space before it
        packed += [self._packed(x if w else x.partition(" ")[0]) for x, w in zip(texts, whole)]
        found = pa.array(packed, pa.large_binary()).take(pa.array(at))
        offsets, data = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1], found.buffers()[2]
        return np.frombuffer(data, "<i4", offsets[-1] // 4) if data else np.empty(0, "<i4"), offsets[starts] // 4

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of the ids of each text."""
        found = self.entries.take(pa.array(self.place[ids]))
        ends = np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1][offsets]
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends), found.buffers()[2]])


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as file:
        return [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, file) if token]


def round_trip(df: DataFrame, codec: Codec, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df without its text and with two columns: the ids of each whole text, and the bytes that these ids decode to."""
    kept = [c for c in df.columns if c not in (text, ids, decoded)]
    shared = df.sparkSession.sparkContext.broadcast(codec)
    schema = T.StructType([*[f for f in df.schema.fields if f.name in kept], T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            rest = batch.select(kept)
            for at in range(0, batch.num_rows, 256):  # small results at a time, whatever the batch holds
                found, offsets = coder.encode_all(strings(batch.column(text).slice(at, 256)))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([*rest.slice(at, 256).columns, lists, coder.decode_all(found, offsets)], names=[*kept, ids, decoded])

    return df.select(*kept, whole_text(F.col(text)).alias(text)).mapInArrow(run, schema)


def standard_codec() -> Codec:
    import public_tokenizers

    return Codec(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = round_trip(docs.select("doc_id", "text"), codec)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return digests(table(spark, sf_dir, "documents"), standard_codec())


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the columns of digests and the ids themselves, for every document that is left; null texts have
    no ids, repeated rows come out once each."""
    coded = round_trip(docs.select("doc_id", "text"), standard_codec())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
