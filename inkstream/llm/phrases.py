"""Phrase collocation mining by vertical positional inverted lists.

Documents are laid out in chunks of some CHUNK words. A chunk keeps, for each of its words, the ascending list of positions at
which it stands; the end of a piece takes a position of its own, so words of two pieces are never neighbours. Phrases grow by
a word at a time: the lists of the frequent phrases are merge-joined with the postings of the frequent words one position on,
and the length of a list is the exact frequency of its phrase in the chunk. What is frequent is asked of shards, which are
ranges of hashed phrases: each chunk names its phrases and the lengths of their lists once, a shard adds up what all chunks
say and answers with the total and an id for each phrase that reaches the threshold. A longer phrase is then known by the ids
of the phrase it extends and of its last word, so nothing is compared by hash alone, and no list, count or vocabulary is
broadcast or collected. A word that stands everywhere has one entry a chunk; a document may be parted at the end of any piece.

Null texts are empty texts, a null language is `und`. Repeated rows count each. Ties are broken by the order that the result
states. No rows, and texts without words, give no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstream.llm._common import discard, stored, table, whole_text
from inkstream.llm.chunks import packed, pair_codes, unpacked

#: Positions of a chunk, entries of a shard and bytes that are parted at a time, about: bounds on memory, not on the input.
CHUNK, SHARD, STEP = 1_500_000, 1_500_000, 1 << 20
LEAST, WORDS, SHARE, FIRST = 10, 3, 50, 2000
#: Parts of a language that are ranked before the whole is.
SALTS = 64
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Lower case for A-Z, a space for a tab, and \n for whatever ends a piece.
PLAIN = bytes(10 if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
TOKENS = re.compile(rb"[^ \n]+|\n").findall

CHUNK_SCHEMA = "chunk long, n long, n_words long, langs array<string>, counts array<long>, words array<string>, hashes binary, lang_of binary, lengths binary, positions binary"
WORD_REQUEST = "chunk long, shard int, n long, words array<string>, counts binary"
REQUEST = "chunk long, shard int, n long, first binary, last binary, counts binary"
ANSWER = "chunk long, level int, shard int, n long, found binary"


class Index(dict):
    """word -> its number among all words of a chunk, of one language."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]):
        super().__init__({b"\n": 0})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.names)
        self.names.append((self.lang, word))
        return at


def key_of(lang: str, word: bytes) -> bytes:
    return lang.encode("utf-8", "surrogatepass") + b"\n" + word


def parted(text: bytes) -> Iterator[list[bytes]]:
    """Words and ends of pieces, some STEP bytes at a time."""
    plain, at = text.translate(PLAIN), 0
    while at < len(plain):
        end = plain.find(b"\n", at + STEP) + 1 or len(plain)
        yield TOKENS(plain[at:end])
        at = end


def chunked(docs: DataFrame, lang: str, text: str) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), whole_text(F.col(text)).alias("text"))
    size = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        names, indexes, parts, held = [("", b"\n")], {}, [], 0

        def closed() -> pa.RecordBatch:
            nonlocal made, names, indexes, parts, held
            made += 1
            codes = np.concatenate(parts)
            hashes = np.array([xxhash.xxh3_64_intdigest(key_of(x, w)) for x, w in names[1:]], np.uint64)
            by_hash = np.argsort(hashes)  # so words stand in the order of shards, however many there will be
            number = np.zeros(len(names), np.int64)
            number[by_hash + 1] = np.arange(1, len(names))
            codes = number[codes]
            names = [names[i + 1] for i in by_hash.tolist()]
            order = np.argsort(codes, kind="stable")
            lengths = np.bincount(codes, minlength=len(names) + 1)
            positions = order[lengths[0] :].astype(np.uint32)
            langs = sorted(indexes)
            place = {x: i for i, x in enumerate(langs)}
            lang_of = np.array([place[x] for x, _ in names], np.uint32)
            counts = np.bincount(lang_of, lengths[1:], len(langs)).astype(np.int64)
            delta = lambda x: packed(np.diff(x, prepend=x.dtype.type(0)))
            columns = [[made], [len(codes)], [len(lang_of)], [langs], [counts], [[w.decode() for _, w in names]], [delta(hashes[by_hash])], [packed(lang_of)], [packed(lengths[1:].astype(np.uint32))], [delta(positions)]]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string())] + [pa.binary()] * 4
            names, indexes, parts, held = [("", b"\n")], {}, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in CHUNK_SCHEMA.split(", ")])

        for batch in batches:
            for code, whole in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                for tokens in parted(whole):
                    index = indexes.get(code) or indexes.setdefault(code, Index(code, names))
                    tokens.append(b"\n")
                    parts.append(np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens)))
                    held += len(tokens)
                    if held >= size:
                        yield closed()
        if len(names) > 1:
            yield closed()

    return rows.mapInArrow(run, CHUNK_SCHEMA)


class Lists:
    """Positions of the last word of each phrase, list by list, ascending in each."""

    def __init__(self, lengths: np.ndarray, positions: np.ndarray):
        self.lengths, self.positions = lengths, positions

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def placed(self, kept: np.ndarray, n: int) -> np.ndarray:
        """The kept phrase whose last word stands at each of n positions, or -1: the lists in one, in the order of positions."""
        owner = self.owners()
        chosen = kept[owner]
        out = np.full(n, -1, np.int64)
        out[self.positions[chosen]] = owner[chosen]
        return out

    def extended(self, kept: np.ndarray, words: Lists, frequent: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, Lists]:
        """Merges the kept lists with the postings of frequent words one position on: (phrase, word) of each phrase that is one
        word longer, and its list."""
        phrase, word = self.placed(kept, n)[:-1], words.placed(frequent, n)[1:]
        met = np.flatnonzero((phrase >= 0) & (word >= 0))
        keys = phrase[met] * len(words.lengths) + word[met]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        first, last = np.divmod(keys[starts], len(words.lengths))
        return first, last, Lists(np.diff(starts, append=len(keys)), met[order] + 1)


class Level:
    """Phrases of a chunk that have the same number of words, and what the shards say of them (by phrase; where `frequent` is
    false the rest has no meaning). order: the phrases as the requests name them."""

    def __init__(self, lists: Lists, order: np.ndarray, shard: np.ndarray):
        self.lists, self.order, self.shard = lists, order, shard

    def told(self, found: pa.Table, level: int) -> Level:
        size = len(self.order)
        self.frequent, self.owned = np.zeros(size, bool), np.zeros(size, bool)
        self.id, self.total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at, rows = 0, (found.column(c).to_pylist() for c in ("level", "shard", "n", "found"))
        for _, shard, n, blob in sorted(row for row in zip(*rows) if row[0] == level):
            frequent, owned, ids, totals = opened(blob, n)
            mine = self.order[at : at + n]
            self.frequent[mine], self.owned[mine] = frequent, owned
            self.id[mine[frequent]] = ids.astype(np.int64) | shard << 32
            self.total[mine[frequent]] = totals
            at += n
        assert at == size, "every phrase of a chunk is answered once"
        return self


def sealed(frequent: np.ndarray, owned: np.ndarray, ids: np.ndarray, totals: np.ndarray) -> bytes:
    flags, ids = np.packbits(np.concatenate([frequent, owned])).tobytes(), packed(ids.astype(np.uint32))
    return flags + len(ids).to_bytes(4, "little") + ids + packed(totals.astype(np.uint64))


def opened(blob: bytes, n: int) -> tuple[np.ndarray, ...]:
    """(frequent, owned) of n phrases, (id, total) of the frequent ones."""
    at = -(-2 * n // 8)
    flags = np.unpackbits(np.frombuffer(blob[:at], np.uint8), count=2 * n).astype(bool)
    m, size = int(flags[:n].sum()), int.from_bytes(blob[at : at + 4], "little")
    return flags[:n], flags[n:], unpacked(blob[at + 4 : at + 4 + size], np.uint32, m), unpacked(blob[at + 4 + size :], np.uint64, m).astype(np.int64)


class Chunk:
    """A chunk read back, level by level."""

    def __init__(self, row: pa.Table, shards: list[int]):
        get = lambda name: row.column(name)[0].as_py()
        self.chunk, self.n, self.shards = get("chunk"), get("n"), shards
        self.langs, size = get("langs"), get("n_words")
        self.words = row.column("words").combine_chunks().flatten()
        self.lang_of = unpacked(get("lang_of"), np.uint32, size)
        lengths = unpacked(get("lengths"), np.uint32, size).astype(np.int64)
        positions = np.cumsum(unpacked(get("positions"), np.uint32, int(lengths.sum())), dtype=np.uint32).astype(np.int64)
        hashes = np.cumsum(unpacked(get("hashes"), np.uint64, size), dtype=np.uint64)
        self.levels = [Level(Lists(lengths, positions), np.arange(size), ranged(hashes, shards[0]))]
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # (phrase, word) of each longer phrase

    def grown(self, found: pa.Table) -> None:
        """Reads what is known of the last level and makes the next."""
        words, last = self.levels[0], self.levels[-1].told(found, len(self.levels))
        first, word, lists = last.lists.extended(last.frequent, words.lists, words.frequent, self.n)
        codes = pair_codes(last.id[first].astype(np.uint64), words.id[word].astype(np.uint64))
        self.levels.append(Level(lists, np.argsort(codes), ranged(codes, self.shards[1])))
        self.parts.append((first, word))

    def requests(self) -> Iterator[dict]:
        level = self.levels[-1]
        shard = level.shard[level.order]
        edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)).tolist() if len(shard) else [0]
        for start, end in zip(edges, edges[1:]):
            mine = level.order[start:end]
            out = {"chunk": self.chunk, "shard": int(shard[start]), "n": end - start, "counts": packed(level.lists.lengths[mine].astype(np.uint32))}
            if self.parts:
                first, word = self.parts[-1]
                a, b = self.levels[-2].id[first[mine]].astype(np.uint64), self.levels[0].id[word[mine]].astype(np.uint64)
                yield out | {"first": packed(a), "last": packed(b)}
            else:
                yield out | {"words": [key_of(self.langs[self.lang_of[i]], self.words[i].as_py().encode()).decode() for i in mine.tolist()]}

    def candidates(self, share: int) -> Iterator[tuple]:
        """(lang, phrase, a, l, r, score, drops) of each frequent phrase of two words or more that this chunk owns; for each
        phrase in it that it drops, a row with that phrase, drops true and no numbers."""
        at = [level.lists.placed(level.frequent, self.n) for level in self.levels]  # the phrase of each length that ends at a position
        totals = [level.total for level in self.levels]
        word_at = at[0]
        for size, level in enumerate(self.levels[1:], 2):
            starts = np.cumsum(level.lists.lengths) - level.lists.lengths
            for p in np.flatnonzero(level.frequent & level.owned).tolist():
                end, a = int(level.lists.positions[starts[p]]), int(level.total[p])
                words = [int(word_at[end - i]) for i in range(size - 1, -1, -1)]
                lang = self.langs[self.lang_of[words[0]]]
                texts = [self.words[w].as_py() for w in words]
                best = None
                for k in range(1, size):
                    left, right = int(totals[k - 1][at[k - 1][end - size + k]]), int(totals[size - k - 1][at[size - k - 1][end]])
                    score = 1_000_000 * a * a // (left * right)
                    if best is None or score < best[2]:
                        best = left, right, score
                yield lang, " ".join(texts), a, *best, False
                for inner in range(2, size):
                    for i in range(size - inner + 1):
                        if 100 * a >= share * int(totals[inner - 1][at[inner - 1][end - size + i + inner]]):
                            yield lang, " ".join(texts[i : i + inner]), None, None, None, None, True


def ranged(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def asked(chunks: DataFrame, answers: DataFrame | None, levels: int, shards: list[int]) -> DataFrame:
    """What each chunk asks of the shards about its phrases of `levels` words."""
    schema = REQUEST if answers else WORD_REQUEST
    kinds = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}[kind]) for name, kind in (x.split() for x in schema.split(", "))])

    def of(row: pa.Table, found: pa.Table | None) -> pa.Table:
        chunk = Chunk(row, shards)
        for _ in range(levels - 1):
            chunk.grown(found)
        return pa.Table.from_pylist(list(chunk.requests()), schema=kinds)

    if answers is None:
        return chunks.mapInArrow(lambda batches: (b for batch in batches for i in range(batch.num_rows) for b in of(pa.Table.from_batches([batch.slice(i, 1)]), None).to_batches()), schema)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda _, mine, found: of(mine, found), schema)


def answered(requests: DataFrame, level: int, least: int) -> DataFrame:
    """Adds up what is asked of each shard. An id is the shard and a number in it; a phrase is owned by one chunk that has it."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_numpy()
        counts = np.concatenate([unpacked(c.as_py(), np.uint32, k) for c, k in zip(rows.column("counts"), n)])
        if level == 1:
            at = rows.column("words").combine_chunks().flatten()
            at = pc.dictionary_encode(at).indices.to_numpy()
        else:
            first, last = (np.concatenate([unpacked(c.as_py(), np.uint64, k) for c, k in zip(rows.column(name), n)]) for name in ("first", "last"))
            order = np.lexsort((last, first))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(first[order]) != 0) | (np.diff(last[order]) != 0)
            at = np.empty(len(order), np.int64)
            at[order] = np.cumsum(new) - 1
        totals = np.zeros(int(at.max()) + 1, np.int64)
        np.add.at(totals, at, counts.astype(np.int64))
        frequent = totals >= least
        ids = np.cumsum(frequent) - 1
        owned = np.zeros(len(at), bool)
        owned[np.unique(at, return_index=True)[1]] = True
        blobs, ends = [], np.cumsum(n)
        for part in map(slice, ends - n, ends):
            mine = at[part]
            chosen = mine[frequent[mine]]
            blobs.append(sealed(frequent[mine], owned[part], ids[chosen], totals[chosen]))
        size = len(n)
        return pa.table([rows.column("chunk"), pa.array([level] * size, pa.int32()), rows.column("shard"), rows.column("n"), pa.array(blobs, pa.binary())], names=[x.split()[0] for x in ANSWER.split(", ")])

    return requests.groupBy("shard").applyInArrow(run, ANSWER)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, words: int = WORDS, share: int = SHARE, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `first` phrases of 2 to `words` words that stand at least
    `least` times. a, l, r: occurrences of the phrase and of its two parts at the cut of lowest score; score:
    floor(1,000,000 a a / (l r)); n: words of the language. A phrase inside a longer one is dropped if that has at least
    `share` percent of its occurrences."""
    chunks = stored(chunked(docs, lang, text), "phrase-chunks")
    size = chunks.agg(F.sum("n_words"), F.sum("n")).first()
    shards = [max(1, -(-(x or 0) // SHARD)) for x in size]
    answers, used = None, [chunks]
    for level in range(1, words + 1):
        told = stored(answered(asked(chunks, answers, level, shards), level, least), f"phrase-level-{level}")
        answers = told if answers is None else answers.union(told)
        used.append(told)

    def run(_: tuple, mine: pa.Table, found: pa.Table) -> pa.Table:
        chunk = Chunk(mine, shards)
        for _ in range(words - 1):
            chunk.grown(found)
        chunk.levels[-1].told(found, words)
        rows = list(chunk.candidates(share))
        columns = list(zip(*rows)) if rows else [[]] * 7
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 2 + [pa.int64()] * 4 + [pa.bool_()])], names=["lang", "phrase", "a", "l", "r", "score", "drops"])

    made = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, "lang string, phrase string, a long, l long, r long, score long, drops boolean")
    made = stored(made, "phrase-candidates")
    counts = chunks.select(F.explode(F.arrays_zip("langs", "counts")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.counts").alias("n"))
    counts = stored(counts, "phrase-words")
    for part in used:
        discard(part)
    kept = made.where("not drops").drop("drops").join(made.where("drops").select("lang", "phrase").distinct(), ["lang", "phrase"], "left_anti")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(*best))
    few = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", place("salt")).where(F.col("rank") <= first)
    ranked = few.withColumn("rank", place()).where(F.col("rank") <= first)
    return ranked.join(counts, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = r"""
    WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    p AS (SELECT d, lang, unnest(regexp_split_to_array(text, '[.,;:!?
-
]')) AS piece, generate_subscripts(regexp_split_to_array(text, '[.,;:!?
-
]'), 1) AS p FROM d),
    s AS (SELECT d, lang, p, regexp_extract_all(piece, '[^ 	]+') AS words FROM p),
    t AS (SELECT d, lang, p, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM s),
    x AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM t WINDOW o AS (PARTITION BY d, p ORDER BY i)),
    one AS (SELECT lang, w, count(*) AS f FROM x GROUP BY ALL),
    two AS (SELECT lang, w, w2, count(*) AS f FROM x WHERE w2 IS NOT NULL GROUP BY ALL),
    three AS (SELECT lang, w, w2, w3, count(*) AS f FROM x WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
    n AS (SELECT lang, count(*) AS n FROM x GROUP BY ALL),
    c AS (
        SELECT t.lang, t.w || ' ' || t.w2 AS phrase, t.f AS a, u.f AS l, v.f AS r, 1 AS k
        FROM two t JOIN one u ON u.lang = t.lang AND u.w = t.w JOIN one v ON v.lang = t.lang AND v.w = t.w2
        WHERE t.f >= 10 AND NOT EXISTS (SELECT 1 FROM three b WHERE b.lang = t.lang AND b.w = t.w AND b.w2 = t.w2 AND 100 * b.f >= 50 * t.f)
          AND NOT EXISTS (SELECT 1 FROM three b WHERE b.lang = t.lang AND b.w2 = t.w AND b.w3 = t.w2 AND 100 * b.f >= 50 * t.f)
        UNION ALL
        SELECT t.lang, t.w || ' ' || t.w2 || ' ' || t.w3, t.f, u.f, v.f, 1
        FROM three t JOIN one u ON u.lang = t.lang AND u.w = t.w JOIN two v ON v.lang = t.lang AND v.w = t.w2 AND v.w2 = t.w3
        UNION ALL
        SELECT t.lang, t.w || ' ' || t.w2 || ' ' || t.w3, t.f, u.f, v.f, 2
        FROM three t JOIN two u ON u.lang = t.lang AND u.w = t.w AND u.w2 = t.w2 JOIN one v ON v.lang = t.lang AND v.w = t.w3),
    e AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM c),
    g AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    h AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM g)
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
    FROM h JOIN n USING (lang) WHERE rank <= 2000"""
