"""Benchmark decontamination by SimHash over item-sized windows.

A benchmark item is a weighted set of five-word shingles (words lower-cased, without the punctuation around them; the
weight is the letters a shingle has, times how often it occurs). A window of a document is as long as an item, in words; a
document of fewer words than the item is one window. Windows that hold shingles of items of their length for at least SIMILAR
of their weight (no other can be that similar) get a BITS-bit SimHash of their own weighted shingles.

Items are indexed by BLOCKS equal blocks of their fingerprints. Two fingerprints within RADIUS bits agree in some block up to
RADIUS // BLOCKS bits: the index holds every block value with its neighbours up to NEAR bits, a window looks up its own values
with theirs, and so gets all items within the radius, and of unlike ones less than one in a hundred. What similarity 0.8 means for
fingerprints is a distance of 15 % of the bits, and the radius is 20 %, 2.5 standard deviations more; of items beyond the
radius those that agree in some block come too, which leaves hardly one of a million out. The exact weighted Jaccard
similarity of window and item then decides: SIMILAR or more is contamination. Items of fewer than five words are one shingle.

The items are a reference set: their index is broadcast while it has at most MAX_ITEMS items (30 kB each) and MAX_ITEM_BYTES of
text, and beyond that the items are dealt into parts, one pass over the documents each. Every document is scanned where it
is read, whole, without a shuffle. Null and empty texts hold no window; null or wordless items are never found. Documents
and items that repeat an id are looked at each; of windows that are alike the first is given; empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm._common import ODD, WordCodes, grams, mixed, strings, table, whole_text

WORDS, SIMILAR = 5, 0.8
BITS, RADIUS, BLOCKS = 288, 59, 12
WIDTH = BITS // BLOCKS
NEAR = RADIUS // BLOCKS // 2  # of the bits in which a block may differ, half on either side
MAX_ITEMS, MAX_ITEM_BYTES = 8192, 32 << 20
STRIP = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "“”‘’«»…–—¡¿"


def bare(word: str) -> str:
    return word.lower().strip(STRIP)


class Words:
    """The words of a text that are more than punctuation, and their codes."""

    def __init__(self, text: str, lexicon: WordCodes):
        self.written = text.split()
        codes = lexicon.of(self.written)
        self.places = np.flatnonzero(codes)
        self.codes = codes[self.places]

    def letters(self, start: int, end: int, n: int) -> np.ndarray:
        """Letters of each shingle of n words that lies in the words from start to end."""
        total = np.cumsum([0, *(len(bare(self.written[i])) for i in self.places[start:end].tolist())])
        return total[n:] - total[:-n]


Weighted = tuple[np.ndarray, np.ndarray]


def weighted(shingles: np.ndarray, letters: np.ndarray) -> Weighted:
    codes, at = np.unique(shingles, return_inverse=True)
    return codes, np.bincount(at, letters, len(codes))


def similarity(a: Weighted, b: Weighted) -> float:
    _, i, j = np.intersect1d(a[0], b[0], True, True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total > 0 else 0.0


def planes(codes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each shingle and bit."""
    with np.errstate(over="ignore"):
        words = np.stack([mixed(codes + ODD * np.uint64(i)) for i in range(-(-BITS // 64))], 1)
    return np.unpackbits(words.view(np.uint8).reshape(len(codes), -1), axis=1)[:, :BITS].astype(np.int32) * 2 - 1


def block_values(bits: np.ndarray) -> np.ndarray:
    """Rows of bits -> the values of their blocks."""
    return bits.reshape(len(bits), BLOCKS, WIDTH) @ (1 << np.arange(WIDTH, dtype=np.int64))


#: A block value with each of these is every value up to NEAR bits away.
NEIGHBOURS = np.array([0, *(reduce(int.__or__, (1 << b for b in bits)) for k in range(1, NEAR + 1) for bits in combinations(range(WIDTH), k))], np.int64)


class Index:
    """Items by fingerprint blocks, and their shingles by length."""

    def __init__(self, items: list[tuple[int, str]]):
        lexicon = WordCodes(bare)
        self.items: list[tuple[int, int, Weighted]] = []
        bits = []
        for item, text in items:
            words = Words(text, lexicon)
            size = len(words.codes)
            if size:
                n = min(WORDS, size)
                shingles, letters = grams(words.codes, n), words.letters(0, size, n)
                self.items.append((item, size, weighted(shingles, letters)))
                bits.append(letters @ planes(shingles) > 0)
        self.lengths = np.array([size for _, size, _ in self.items], np.int64)
        self.bits = np.array(bits, bool).reshape(-1, BITS)
        self.prints = np.packbits(self.bits, axis=1)
        self.blocks = []  # of each block: values in order, where the items of each begin, items
        for values in block_values(self.bits).T:
            every = (values[:, None] ^ NEIGHBOURS).ravel()
            order = np.argsort(every, kind="stable")
            known, first = np.unique(every[order], return_index=True)
            self.blocks.append((known.astype(np.int32), np.append(first, len(every)).astype(np.int32), (order // len(NEIGHBOURS)).astype(np.int32)))
        held: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        for _, size, (codes, _) in self.items:
            held[min(WORDS, size), size].append(codes)
        self.of_length = {k: np.unique(np.concatenate(x)) for k, x in held.items()}
        self.known = {n: np.unique(np.concatenate([x for (m, _), x in self.of_length.items() if m == n])) for n in {m for m, _ in held}}
        self.maps = {}
        for n, codes in self.known.items():
            self.maps[n] = np.zeros(1 << 20, bool)
            self.maps[n][codes >> np.uint64(44)] = True

    def candidates(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of the items whose fingerprint agrees with a row of bits in some block up to RADIUS // BLOCKS bits."""
        rows, found = [], []
        for values, (known, first, items) in zip(block_values(bits).T, self.blocks):
            near = (values[:, None] ^ NEIGHBOURS).ravel().astype(np.int32)
            at = np.minimum(np.searchsorted(known, near), max(len(known) - 1, 0))
            hit = np.flatnonzero(known[at] == near) if len(known) else np.empty(0, np.int64)
            low, count = first[at[hit]], first[at[hit] + 1] - first[at[hit]]
            each = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            rows.append(np.repeat(hit // len(NEIGHBOURS), count))
            found.append(items[each])
        both = np.unique(np.concatenate(rows) * len(self.items) + np.concatenate(found))
        return np.divmod(both, max(len(self.items), 1))

    def near(self, bits: np.ndarray, length: int) -> list[tuple[int, int]]:
        """(row, item) of all items of this length within RADIUS of a row of bits."""
        rows, items = self.candidates(bits)
        same = self.lengths[items] == length
        rows, items = rows[same], items[same]
        close = np.bitwise_count(np.packbits(bits, axis=1)[rows] ^ self.prints[items]).sum(1, dtype=np.int64) <= RADIUS
        return list(zip(rows[close].tolist(), items[close].tolist()))

    def find(self, text: str, lexicon: WordCodes) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of its most similar window; the first of equals."""
        words = Words(text, lexicon)
        codes = words.codes
        best: dict[int, tuple[float, int, int]] = {}
        for n, known in self.known.items():
            shingles = grams(codes, n)
            hit = np.flatnonzero(self.maps[n][shingles >> np.uint64(44)])
            hit = hit[_among(shingles[hit], known)]
            if not len(hit):
                continue
            for (m, length), own in self.of_length.items():
                if m == n and len(at := hit[_among(shingles[hit], own)]):
                    last = max(0, len(codes) - length)  # a shorter text is one window
                    low, high = np.maximum(at - (length - n), 0), np.minimum(at, last) + 1
                    low = np.minimum(low, last)
                    edge = np.bincount(low, minlength=last + 2) - np.bincount(high, minlength=last + 2)
                    self._windows(length, n, np.flatnonzero(np.cumsum(edge) > 0), words, shingles, own, best)
        return best

    def _windows(self, length: int, n: int, starts: np.ndarray, words: Words, shingles: np.ndarray, own: np.ndarray, best: dict) -> None:
        size = min(length, len(words.codes))
        m = size - n + 1
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > m) + 1):
            for part in (run[i : i + 4096] for i in range(0, len(run), 4096)):
                first, last = int(part[0]), int(part[-1]) + m
                letters, mine = words.letters(first, last + n - 1, n), shingles[first:last]
                total, known = (np.concatenate([[0], np.cumsum(x)]) for x in (letters, letters * _among(mine, own)))
                spans = part - first
                part = part[known[spans + m] - known[spans] >= SIMILAR * (total[spans + m] - total[spans]) - 1e-9]
                if not len(part):
                    continue
                sums = np.zeros((len(mine) + 1, BITS), np.int32 if total[-1] < 2**31 else np.int64)
                np.cumsum(planes(mine) * letters[:, None], axis=0, out=sums[1:])
                for few in (part[i : i + 64] for i in range(0, len(part), 64)):
                    rows, items = self.candidates(sums[few - first + m] - sums[few - first] > 0)
                    same = self.lengths[items] == length
                    for k, i in zip(rows[same].tolist(), items[same].tolist()):
                        s = int(few[k])
                        item, _, wanted = self.items[i]
                        found = similarity(weighted(mine[s - first : s - first + m], letters[s - first : s - first + m]), wanted)
                        if found >= SIMILAR and found > best.get(item, (0.0,))[0]:
                            best[item] = (found, s, size)


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are among the known ones, which are in order."""
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, similarity, start_word, n_words): the best window of each document for each item that it holds."""
    rows = items.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), whole_text(F.col(item_text)).alias("t"))
    size, count = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(1, -(-size // MAX_ITEM_BYTES), -(-count // MAX_ITEMS))
    name = docs.schema[key].dataType.simpleString()
    found = None
    for part in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).orderBy("item", "t").collect()
        shared = docs.sparkSession.sparkContext.broadcast(Index([(r["item"], r["t"]) for r in mine]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, lexicon = shared.value, WordCodes(bare)
            for batch in batches:
                out = [(i, item, *hit) for i, x in enumerate(strings(batch.column("_text"))) for item, hit in sorted(index.find(x, lexicon).items())]
                if out:
                    at, those, score, start, n = zip(*out)
                    columns = [batch.column(key).take(pa.array(at)), pa.array(those, pa.int64()), pa.array(score), pa.array(start, pa.int32()), pa.array(n, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "item_id", "similarity", "start_word", "n_words"])

        one = docs.select(key, whole_text(F.col(text)).alias("_text")).mapInArrow(run, f"`{key}` {name}, item_id long, similarity double, start_word int, n_words int")
        found = one if found is None else found.unionByName(one)
    return found


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words for each benchmark item that a document holds."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_uncontaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark item."""
    held = matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(*docs.columns)
