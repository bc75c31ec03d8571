"""Fill-in-middle transformation by succinct rank and select.

The tokens of a text (white space and the word after it, or the white space at its end) are marked by one bit at the byte
where each begins. The bits of a run of texts are packed into one bitvector with a directory of popcounts; a text's total
popcount is its number of tokens n, and select at the two drawn ranks gives the bytes at which it is cut. A second bitvector,
of the bytes that begin a code point, gives lengths in code points by rank.

Every row is cut by itself (no shuffle), and the draws depend on nothing but the seed and the row's key, so a lost task gives
the same rows again. Null texts are empty texts, of no tokens and in plain form. A null key draws as the empty text would.
Repeated rows are transformed alike, once each; no rows give no rows. Columns of the input that bear names of this
operator's own are replaced, all others are carried along.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.llm._common import table, whole_text

#: Bytes of text that are packed together, about; a longer text is packed alone.
STEP = 4 << 20
SEED, RATE, SPM = 42, 50, 80
SENTINELS = re.compile(rb"<[PSM]>")
OWN = ("n", "form", "prefix_chars", "middle_chars", "output")


class Bits:
    """A packed bitvector. `before` has the ones before each block of 512 bits, `inside` those of a block before each of its
    eight words."""

    def __init__(self, bits: np.ndarray):
        blocks = len(bits) // 512 + 1
        raw = np.zeros(blocks * 64, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        raw[: len(packed)] = packed
        self.words = raw.view("<u8")
        counts = np.bitwise_count(self.words).reshape(blocks, 8).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts.sum(1))])
        self.inside = np.cumsum(counts, 1) - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        rest = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at >> 9] + self.inside.ravel()[word] + np.bitwise_count(rest)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The position of each one, counted from 0."""
        block = np.searchsorted(self.before, ranks, "right") - 1
        left = ranks - self.before[block]
        word = (self.inside[block] <= left[:, None]).sum(1) - 1
        left = left - self.inside[block, word]
        bits = np.unpackbits(self.words[block * 8 + word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * 512 + word * 64 + np.argmax(np.cumsum(bits, 1) > left[:, None], 1)


def token_starts(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Bits:
    """Marks the first byte of every token of the texts data[begin:end]."""
    space = (data == 32) | ((data - np.uint8(9)) <= 4)
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[begin[begin < end]] = True
    return Bits(starts)


def draws(key: str, seed: int) -> tuple[int, ...]:
    h = hashlib.sha256(f"{seed}:{key}".encode("utf-8", "surrogatepass")).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def cut(data: np.ndarray, begin: np.ndarray, end: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, first cut, second cut) of each text, the cuts as bytes of data; drawn: two numbers for each text."""
    bits = token_starts(data, begin, end)
    first = bits.rank(begin)
    n = bits.rank(end) - first
    units = np.sort(drawn % (n[:, None] + 1), 1)
    cuts = np.repeat(end[:, None], 2, 1)
    inner = units < n[:, None]
    cuts[inner] = bits.select((first[:, None] + units)[inner])
    return n, cuts[:, 0], cuts[:, 1]


def transformed(keys: list[str], texts: pa.Array, seed: int, rate: int, spm: int) -> tuple[list, ...]:
    """n, form, prefix_chars, middle_chars, output of a run of texts (binary, no nulls)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    begin, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    h = np.array([draws(k, seed) for k in keys], np.int64).reshape(-1, 4)
    n, one, two = cut(data, begin, end, h[:, :2])
    whole = data.tobytes()
    plain = (h[:, 2] % 100 >= rate) | (begin == end)
    if not plain.all():
        plain |= np.array([not p and SENTINELS.search(whole, a, b) is not None for p, a, b in zip(plain.tolist(), begin.tolist(), end.tolist())], bool)
    chars = Bits((data & 0xC0) != 0x80)
    at = [chars.rank(x) for x in (begin, one, two)]
    forms, outputs = [], []
    for p, s, a, x, y, b in zip(plain.tolist(), (h[:, 3] % 100 < spm).tolist(), *(v.tolist() for v in (begin, one, two, end))):
        prefix, middle, suffix = whole[a:x], whole[x:y], whole[y:b]
        forms.append("plain" if p else "spm" if s else "psm")
        outputs.append(whole[a:b] if p else b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle if s else b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle)
    return n, forms, pa.array(at[1] - at[0], mask=plain), pa.array(at[2] - at[1], mask=plain), outputs


def runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of texts of about STEP bytes."""
    at, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        total += size
        if total >= STEP:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """df without its text, and: n tokens; form (plain, psm or spm); prefix_chars and middle_chars (null where plain); output.
    rate: percent of texts that are cut; spm: percent of those whose suffix comes first. A text that holds a sentinel stays plain."""
    kept = [c for c in df.columns if c != text and c not in OWN]
    schema = T.StructType([*[f for f in df.schema.fields if f.name in kept], *[T.StructField(c, t) for c, t in zip(OWN, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).cast(pa.binary())
            rest = batch.select(list(range(len(kept))))
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)) if len(texts) else np.empty(0, np.int32)
            for a, b in runs(sizes):
                n, forms, prefix, middle, outputs = transformed(keys[a:b], texts.slice(a, b - a), seed, rate, spm)
                columns = [pa.array(n, pa.int64()), pa.array(forms), prefix, middle, pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, *columns], names=schema.names)

    drawn_by = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return df.select(*[F.col(c) for c in kept], drawn_by.alias("_drawn_by"), whole_text(F.col(text)).alias("_whole_text")).mapInArrow(run, schema)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from; no text that is cut holds a sentinel, so the parts are found by them."""
    front, middle = F.substring_index(output, "<M>", 1), F.substring_index(output, "<M>", -1)
    after = F.substr(front, F.lit(4))
    psm = F.concat(F.substring_index(after, "<S>", 1), middle, F.substring_index(front, "<S>", -1))
    spm = F.concat(F.substring_index(front, "<P>", -1), middle, F.substring_index(after, "<P>", 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


ORACLE = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    t AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS parts,
                 [CAST('0x' || substr(h, CAST(1 + 8 * i AS INT), 8) AS BIGINT) for i in range(4)] AS h FROM d),
    c AS (SELECT *, CAST(len(parts) AS BIGINT) AS n FROM t),
    u AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                 CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c),
    s AS (SELECT *, coalesce(array_to_string(parts[1:a], ''), '') AS p, coalesce(array_to_string(parts[a + 1:b], ''), '') AS m, coalesce(array_to_string(parts[b + 1:], ''), '') AS s FROM u)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM s"""
