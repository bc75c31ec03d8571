"""Encoding and decoding by a SentencePiece vocabulary of merge type.

A text is normalised as the model says (white space escaped, one put before the first word) and cut into characters. An
agenda, a heap ordered by score and then from the left, holds the adjacent pairs of symbols whose joined text is a piece; the
best is merged and its new neighbours are entered, until the agenda is empty. Characters without a piece become bytes. As no
piece goes on after a word's end into the next white space (nor, in most vocabularies, from letters into other signs), which
is checked on the vocabulary, the agenda of a text falls apart into those of its units (white space and the word after it),
and equal units are worked out once a worker.
Each Arrow batch is encoded and decoded by the sentencepiece library too, and a column says whether both agree.

Every row is encoded by itself (no shuffle). Null texts are empty texts, without ids, and decode to the empty text. Repeated
rows are encoded once each, null keys are carried along, no rows give no rows; columns of the input that bear names of this
operator's own are replaced. The vocabulary is a parameter; its size is checked before it is broadcast.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.llm._common import strings, table, whole_text

#: A vocabulary beyond this is refused rather than broadcast.
MAX_VOCABULARY = 1_000_000
#: Units that one worker process remembers at a time, and the longest of them: bounds on memory, not on the input.
MEMO, LONGEST = 500_000, 64
SPACE = "▁"
#: Between these and other characters units are cut, where no piece has both side by side.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
OWN = ("ids", "decoded", "agrees")
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2


def fields(message: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a protocol buffer message; fixed-width values stay bytes."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    at = 0
    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, message[at : at + size]
        at += size


class Pieces:
    """The pieces of one model file, its encoder and its decoder."""

    def __init__(self, model: bytes):
        self.model = model
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(model):
            if number == 1:
                own = dict(fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        kinds = {k for _, _, k in pieces}
        if not 0 < len(pieces) <= MAX_VOCABULARY:
            raise ValueError(f"a vocabulary of {len(pieces)} pieces; from 1 to {MAX_VOCABULARY} are taken")
        if trainer.get(3) != MERGES or kinds & {USER, UNUSED} or not trainer.get(35) or trainer.get(24):
            raise ValueError("taken are merge-type vocabularies with byte fallback, without user-defined or unused pieces")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("taken are models that keep characters and repeated white space and escape it")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        self.rank: dict[str, tuple[float, int]] = {p: (-s, i) for i, (p, s, k) in enumerate(pieces) if k == NORMAL}
        places = {s: i for i, s in enumerate(sorted({s for s, _ in self.rank.values()}))}
        self.order, self.none = {p: places[s] for p, (s, _) in self.rank.items()}, len(places)
        self.bytes = [0] * 256
        self.surface: list[bytes | None] = []  # None: a control piece
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
                self.surface.append(bytes([int(p[3:5], 16)]))
            else:
                unknown = trainer.get(44, " ⁇ ".encode())
                self.surface.append(unknown if k == UNKNOWN else b"" if k == CONTROL else p.replace(SPACE, " ").encode())
        self.is_byte, self.is_control = (np.array([k == kind for _, _, k in pieces]) for kind in (BYTE, CONTROL))
        self.leading = np.array([k == NORMAL and p.startswith(SPACE) for p, _, k in pieces])
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.words_apart = self.apart and not any(re.search(f"[{LETTERS}][^{LETTERS}]|[^{SPACE}{LETTERS}][{LETTERS}]", p) for p in self.rank)
        self._ready()

    def _ready(self) -> None:
        inner = f"{SPACE}*[{LETTERS}]+|{SPACE}*[^{SPACE}{LETTERS}]+" if self.words_apart else f"{SPACE}*[^{SPACE}]+"
        self.units = re.compile(f"{inner}|{SPACE}+").findall
        self.memo: dict[str, bytes] = {}
        self.library = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("units", "memo", "library")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def merged(self, unit: str) -> bytes:
        """The ids of a unit, by the agenda of its adjacent pairs. That of a short unit is a list, searched for its best."""
        if len(unit) > LONGEST:
            return self.merged_long(unit)
        order, none, symbols = self.order.get, self.none, list(unit)
        agenda = [order(a + b, none) for a, b in zip(symbols, unit[1:])]
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            joined = symbols[i] + symbols.pop(i + 1)
            symbols[i] = joined
            del agenda[i]
            if i < len(agenda):
                agenda[i] = order(joined + symbols[i + 1], none)
            if i:
                agenda[i - 1] = order(symbols[i - 1] + joined, none)
        return self.ids_of(symbols)

    def ids_of(self, symbols: list[str]) -> bytes:
        ids = array("i")
        for symbol in symbols:
            if found := self.rank.get(symbol):
                ids.append(found[1])
            else:
                ids.extend(self.bytes[b] for b in symbol.encode("utf-8", "replace"))
        return ids.tobytes()

    def merged_long(self, unit: str) -> bytes:
        rank, n = self.rank.get, len(unit)
        before = list(range(-1, n))
        made = [0] * (n + 1)  # where the symbol that begins here ends; 0 where none begins
        for i in range(n):
            made[i] = i + 1
        agenda = [(found[0], i, i + 2) for i in range(n - 1) if (found := rank(unit[i : i + 2]))]
        heapify(agenda)
        while agenda:
            _, i, end = heappop(agenda)
            j = made[i]
            if not j or j >= end or made[j] != end:
                continue  # one of the two has been merged since
            made[i], made[j] = end, 0
            if end < n:
                before[end] = i
                if found := rank(unit[i : made[end]]):
                    heappush(agenda, (found[0], i, made[end]))
            if i and (found := rank(unit[before[i] : end])):
                heappush(agenda, (found[0], before[i], end))
        symbols, i = [], 0
        while i < n:
            symbols.append(unit[i : made[i]])
            i = made[i]
        return self.ids_of(symbols)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<i4")
        whole = self.prefix + text.replace(" ", SPACE)
        if not self.apart:
            return np.frombuffer(self.merged(whole), "<i4")
        units, memo = self.units(whole), self.memo
        if len(memo) > MEMO:
            memo.clear()
        for unit in set(units).difference(memo):
            memo[unit] = self.merged(unit)
        out = np.frombuffer(b"".join(map(memo.__getitem__, units)), "<i4")
        for unit in units if len(whole) > LONGEST * len(units) else ():
            if len(unit) > LONGEST:
                memo.pop(unit, None)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids. Of the first text, one leading white space is dropped if the model puts it there; bytes that
        are no UTF-8 become U+FFFD one by one."""
        if not len(ids):
            return ""
        parts = list(map(self.surface.__getitem__, ids.tolist()))
        if self.prefix:
            for i, piece in enumerate(ids.tolist()):
                if not self.is_byte[piece] and self.leading[piece]:
                    parts[i] = parts[i][1:]
                    break
                if parts[i]:
                    break
        try:
            if not self.is_control[ids].any():  # these part bytes from each other
                return b"".join(parts).decode()
        except UnicodeDecodeError:
            pass
        bytes_, out, i = self.is_byte[ids], [], 0
        while i < len(parts):
            if not bytes_[i]:
                out.append(parts[i].decode())
                i += 1
                continue
            j = i
            while j < len(parts) and bytes_[j]:
                j += 1
            out.append(by_bytes(b"".join(parts[i:j])))
            i = j
        return "".join(out)

    def agrees(self, texts: list[str], found: list[np.ndarray], back: list[str]) -> list[bool]:
        """Whether the library gives the same ids, and the same text of them, for each text of a batch."""
        import sentencepiece

        if self.library is None:
            self.library = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        theirs = self.library.encode(texts, num_threads=1, out_type="numpy")
        return [np.array_equal(a, b) and t == self.library.decode(b) for a, b, t in zip(found, theirs, back)]


def by_bytes(run: bytes) -> str:
    out = []
    while run:
        try:
            out.append(run.decode())
            break
        except UnicodeDecodeError as e:
            out.append(run[: e.start].decode() + "�")
            run = run[e.start + 1 :]
    return "".join(out)


def read_model(path: str) -> Pieces:
    with open(path, "rb") as file:
        return Pieces(file.read())


def round_trip(df: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """df without its text, and: ids of each whole text; decoded, the text of these ids; agrees, whether the library says so."""
    kept = [c for c in df.columns if c != text and c not in OWN]
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    kinds = (T.ArrayType(T.IntegerType(), False), T.StringType(), T.BooleanType())
    schema = T.StructType([*[f for f in df.schema.fields if f.name in kept], *[T.StructField(c, t) for c, t in zip(OWN, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            rest = batch.select(list(range(len(kept))))
            for at in range(0, batch.num_rows, 256):  # small results at a time, whatever the batch holds
                texts = strings(batch.column(len(kept)).slice(at, 256))
                found = [coder.encode(x) for x in texts]
                back = [coder.decode(x) for x in found]
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([*rest.slice(at, 256).columns, lists, pa.array(back, pa.string()), pa.array(coder.agrees(texts, found, back), pa.bool_())], names=schema.names)

    return df.select(*[F.col(c) for c in kept], whole_text(F.col(text)).alias("_whole_text")).mapInArrow(run, schema)


def op12_piece_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, and agrees."""
    import public_tokenizers

    coded = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), read_model(public_tokenizers.path("piece_bpe_32k.model")))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agrees",
    )
