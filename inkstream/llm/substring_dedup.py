"""Removal of word sequences that an earlier document has too, by FM-index shards.

A window is MIN_WORDS consecutive words. A word is removed where a window that covers it also starts in a document of
smaller id; windows are judged on the input.

Every window has an anchor, the five-word sequence of smallest hash in it, and windows of one anchor are neighbours: a
stretch. Equal windows have equal anchors, so:
1. anchors of all documents are counted by a pre-aggregated grouping; those of a single document are dropped;
2. stretches of the others go to shards by their anchor. Where very many documents share an anchor (HOT), its windows go
   one by one, by their own hash, so that no anchor fills a shard. A task that has met the same stretch in a smaller
   document, by a 128-bit digest of its words, settles it at once, so of equal stretches few are shipped;
3. each shard puts its different stretches into a compressed FM-index and streams them through backward search over its
   wavelet matrix, for matching statistics at the end of each window; the interval of a match of MIN_WORDS holds the
   documents that have it, and the smallest decides. In a shard words are compared themselves; only what a task has
   settled before rests on the digest. The index compresses its transform, not the document of each suffix;
4. the ranges return to their documents.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return, unchanged. Null and
empty texts have none. Rows that repeat an id are one document each, of equal id, and remove nothing from each other; a row
without an id loses and removes nothing. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm._common import MEMO, WordCodes, discard, grams, raw_texts, stored, table, whole_text
from inkstream.llm.fm_index import FmIndex

MIN_WORDS, ANCHOR = 13, 5
#: Documents that share an anchor from which on its windows are dealt one by one; stretches of a shard, about.
HOT, PER_SHARD = 2000, 100_000
#: What a word is. bytes.split() parts the UTF-8 bytes of a text at the same six characters, and is what the tasks use.
find_words = re.compile(r"[^\x20\x09-\x0D]+").findall


def anchors_of(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all five-word sequences, and where the anchor of each window stands among them."""
    five = grams(codes, ANCHOR)
    return five, np.lib.stride_tricks.sliding_window_view(five, n - ANCHOR + 1).argmin(1) + np.arange(len(codes) - n + 1)


def stretches(codes: np.ndarray, n: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of each stretch of a document."""
    if len(codes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    five, at = anchors_of(codes, n)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return five[at[first]], first, np.diff(np.append(first, len(at)))


def anchor_rows(docs: DataFrame, n: int) -> DataFrame:
    """(anchor, id, stretch): stretch is 16 x its first window + its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCodes()
        for batch in batches:
            ids, rows = batch.column("id").to_pylist(), []
            for at in range(0, len(ids), 256):
                found = [stretches(words.of(x.split()), n) for x in raw_texts(batch.column("text").slice(at, 256))]
                anchors, first, count = (np.concatenate(x) for x in zip(*found))
                owner = np.repeat(np.array(ids[at : at + 256], np.int64), [len(x[0]) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(owner), pa.array((first * 16 + count).astype(np.int32))], names=["anchor", "id", "stretch"])

    return docs.mapInArrow(run, "anchor long, id long, stretch int")


def shipped(candidates: DataFrame, n: int) -> DataFrame:
    """(id, start, route, words, text) of each stretch; text, its words as they are, is null where a smaller document of the
    task had the same (by a 128-bit digest of the words). Documents come in the order of their ids, whatever the files' is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, met = WordCodes(), {}
        for batch in batches:
            out: list[tuple] = []
            for own, text, cold, hot in zip(batch.column("id").to_pylist(), raw_texts(batch.column("text")), batch.column("cold").to_pylist(), batch.column("hot").to_pylist()):
                words = text.split()
                five, at = anchors_of(codes.of(words), n)
                routes = five[at].tolist()
                whole = b" ".join(words)
                edges = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
                wanted = [(x >> 4, (x & 15) + n - 1, False) for x in cold] + [(w, n, True) for x in hot for w in range(x >> 4, (x >> 4) + (x & 15))]
                for start, size, alone in wanted:
                    part = whole[edges[start] : edges[start + size] - 1]
                    key = xxhash.xxh3_128_intdigest(part)
                    route = key & 0xFFFFFFFFFFFFFFFF if alone else routes[start]
                    if met.get(key, own) < own:
                        out.append((own, start, route >> 1, size, None))
                        continue
                    if len(met) > MEMO:
                        met.clear()
                    met[key] = own
                    out.append((own, start, route >> 1, size, part))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int16(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["id", "start", "route", "words", "text"])

    return candidates.sortWithinPartitions("id").select("id", "text", "cold", "hot").mapInArrow(run, "id long, start int, route long, words short, text binary")


class Symbols(dict):
    """word -> its number in a shard, from 1."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def runs(removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def search_shard(rows: pd.DataFrame, n: int = MIN_WORDS) -> pd.DataFrame:
    """(id, start, end): the word ranges that this shard's stretches have removed. Words are compared as they are."""
    settled = rows[rows["text"].isna()]
    rows = rows[rows["text"].notna()].sort_values("id", kind="stable")
    out = [(settled["id"].to_numpy(), settled["start"].to_numpy(), settled["start"].to_numpy() + settled["words"].to_numpy())]
    if len(rows):
        first = rows.groupby("text", sort=False)["id"].transform("first")
        later = rows["id"] > first  # the whole stretch stands in a smaller document
        gone = rows[later]
        out.append((gone["id"].to_numpy(), gone["start"].to_numpy(), gone["start"].to_numpy() + gone["words"].to_numpy()))
        rows = rows[~later]
        different = rows.drop_duplicates("text")
        size = different["words"].to_numpy(np.int64)
        ends = np.cumsum(size + 1) - 1  # of each sequence: where its 0 stands
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        spot = np.ones(len(text), bool)
        spot[ends] = False
        numbers = Symbols()
        text[spot] = np.fromiter(map(numbers.__getitem__, b" ".join(different["text"]).split()), np.int64, int(size.sum()))
        owners, owner = np.unique(different["id"].to_numpy(), return_inverse=True)
        owner = np.repeat(owner, size + 1)
        index = FmIndex(text, len(numbers) + 1, owner)
        windows = size - n + 1
        starts = np.repeat(ends - size, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        length, low, high = index.statistics(text, starts + n, n)
        long = np.flatnonzero(length == n)
        earlier = starts[long[index.least_documents(low[long], high[long]) < owner[starts[long]]]]
        covered = np.zeros(len(text) + 1, np.int64)
        np.add.at(covered, earlier, 1)
        np.add.at(covered, earlier + n, -1)
        begin, end = runs(np.cumsum(covered)[:-1] > 0)  # the 0s part the sequences
        of = np.searchsorted(ends, begin)
        base = ends - size
        found = pd.DataFrame({"text": different["text"].to_numpy()[of], "a": begin - base[of], "b": end - base[of]})
        hits = rows.merge(found, on="text")
        out.append((hits["id"].to_numpy(), (hits["start"] + hits["a"]).to_numpy(), (hits["start"] + hits["b"]).to_numpy()))
    return pd.DataFrame({name: np.concatenate(x).astype(np.int64) for name, x in zip(("id", "start", "end"), zip(*out))})


def repeated_ranges(docs: DataFrame, n: int = MIN_WORDS) -> DataFrame:
    """(id, ranges): the word ranges, as start x 2^32 + end, that windows of n words of smaller documents cover. docs: (id, text)."""
    anchors = stored(anchor_rows(docs, n), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    shared = stored(shared.select("anchor", (F.col("n") > HOT).alias("is_hot")), "shared")  # as a table of its own, so that Spark may split a hot anchor
    found = anchors.join(shared, "anchor").select("id", "stretch", "is_hot")
    found = stored(found.groupBy("id").agg(*[F.collect_list(F.when(F.col("is_hot") == hot, F.col("stretch"))).alias(name) for name, hot in (("cold", False), ("hot", True))]), "candidates")
    for done in (anchors, shared):
        discard(done)
    total = found.agg(F.sum(F.size("cold") + 9 * F.size("hot"))).first()[0] or 0
    shards = max(1, -(-total // PER_SHARD))
    docs.sparkSession._jvm.System.gc()  # lets Spark remove the shuffle files of the anchors
    sent = shipped(found.join(docs, "id"), n).withColumn("shard", F.pmod(F.when(F.col("text").isNull(), F.xxhash64("id")).otherwise(F.col("route")), F.lit(shards)).cast("int")).drop("route")
    ranges = sent.groupBy("shard").applyInPandas(lambda rows: search_shard(rows, n), "id long, start long, end long")
    ranges = stored(ranges.groupBy("id").agg(F.collect_set(F.shiftleft("start", 32) + F.col("end")).alias("ranges")), "ranges")
    discard(found)
    docs.sparkSession._jvm.System.gc()
    return ranges


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = MIN_WORDS) -> DataFrame:
    """(key, n_words, n_removed, kept): the words that stay, joined by one space."""
    docs = df.select(F.col(key).cast("long").alias("id"), whole_text(F.col(text)).alias("text"))
    joined = docs.join(repeated_ranges(docs.where("id is not null"), n), "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, kept = [], [], []
            for x, ranges in zip(raw_texts(batch.column("text")), batch.column("ranges").to_pylist()):
                words = x.split()
                counts.append(len(words))
                if ranges:
                    stay = np.ones(len(words), bool)
                    for r in ranges:
                        stay[r >> 32 : r & 0xFFFFFFFF] = False
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                gone.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[key, "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"`{key}` long, n_words long, n_removed long, kept string")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - {MIN_WORDS - 1})) AS i FROM d WHERE len(w) >= {MIN_WORDS}),
    k AS (SELECT doc_id, i, array_to_string(w[i:i + {MIN_WORDS - 1}], ' ') AS k FROM s),
    f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
    hit AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {MIN_WORDS - 1})) AS p FROM k JOIN f USING (k) WHERE first < doc_id),
    r AS (SELECT doc_id, list(p) AS gone FROM hit GROUP BY doc_id),
    o AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN r USING (doc_id))
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
           sha256(coalesce(array_to_string(list_filter(w, lambda x, j: NOT list_contains(gone, j)), ' '), '')) AS kept_sha256
    FROM o"""
