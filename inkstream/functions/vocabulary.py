"""What the matchers ask of words, as arrays with a place for each distinct word: worked out once a word, and asked for many at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions.text import _Normals
from inkstream.functions.wordclass import _PIECE, CLASSES, CLOSED, dialect_key, is_function, number_value

#: Distinct words of a worker that are remembered, and readings whose words are encoded together; bounds on memory, not on
#: the input.
REMEMBERED, TOGETHER = 300_000, 512
_CLASSES = {w: sum((w in c) << k for k, c in enumerate(CLASSES)) for w in CLOSED}
_NUMBER = re.compile(rf"\d|{_PIECE.pattern}")


def _number(word: str) -> int | None:
    """`number_value` of a word in normal form; most words are told by their first letters to be none."""
    return number_value(word) if not word.isascii() or _NUMBER.match(word) else None


#: Kinds of letters that a sketch tells apart, and the lengths; the bit that words of eight letters and more have.
KINDS, LENGTHS = 26, 12
EIGHT = np.uint64(1 << 2 * KINDS + 7)


def sketches(words: Sequence[str]) -> np.ndarray:
    """For each word as bits: which letters it has once and twice, and how long it is. A letter put in or left out changes one bit of
    both parts at most, a letter changed two of the first; so words are at least half as many edits apart as their sketches have bits."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    kind = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % KINDS
    times = np.bincount(np.repeat(np.arange(len(words)), size) * KINDS + kind, minlength=len(words) * KINDS).reshape(-1, KINDS)
    bits = np.concatenate([times > 0, times > 1, np.arange(LENGTHS) < size[:, None]], 1)
    return np.packbits(bits, 1, "little").view(np.uint64).ravel()


class Vocabulary:
    """Words in normal form, numbered as they come."""

    def __init__(self):
        self.normal = _Normals()
        self._clear()

    def _clear(self) -> None:
        self.ids, self.words, self._spellings, self._numbers, self._shared = {}, [], {}, {}, set()
        self.size, self.spelling, self.number = (np.empty(0, np.int64) for _ in range(3))
        self.sketch, self.classes, self.function = np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, bool)

    def start(self) -> None:
        """Before words are encoded that are asked for together: forgets those before, if they are too many."""
        if len(self.words) > REMEMBERED:
            self._clear()

    def add(self, words: Sequence[str]) -> np.ndarray:
        """The numbers of words in normal form."""
        ids, new = self.ids, []
        for w in words:
            if w not in ids:
                ids[w] = len(ids)
                new.append(w)
        if new:
            self.words += new
            more = lambda old, values: np.concatenate([old, np.fromiter(values, old.dtype, len(new))])
            known, number = self._numbers, map(_number, new)
            self.size = more(self.size, map(len, new))
            self.sketch = np.concatenate([self.sketch, sketches(new)])
            self.spelling = more(self.spelling, map(self._spelling, new))
            self.number = more(self.number, (-1 if x is None else known.setdefault(x, len(known)) for x in number))
            self.classes = more(self.classes, (_CLASSES.get(w, 0) for w in new))
            self.function = more(self.function, map(is_function, new))
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def _spelling(self, word: str) -> int:
        key, n = dialect_key(word), len(self._spellings)
        found = self._spellings.setdefault(key, n)
        if found < n:
            self._shared.add(found)
        return found

    def is_spelled_otherwise(self, word: int) -> bool:
        """Whether another word of the vocabulary is a spelling of this one."""
        return int(self.spelling[word]) in self._shared

    def encoded(self, *columns: pa.Array) -> tuple[list[str], list[np.ndarray], np.ndarray]:
        """Arrays of written words: the distinct ones as they are written, the place of each word among these, and the numbers of their
        normal forms. A null is an empty word."""
        coded = pa.concat_arrays([c.cast(pa.large_string()) for c in columns]).fill_null("").dictionary_encode()
        written = coded.dictionary.to_pylist()
        places = np.split(coded.indices.to_numpy(), np.cumsum([len(c) for c in columns])[:-1])
        return written, places, self.add([w.lower() if w.isascii() and w.isalnum() else self.normal[w] for w in written])


class Readings(NamedTuple):
    """Pages, and what was heard of them, one after the other. page, heard: numbers of a vocabulary."""

    page: np.ndarray
    pages: np.ndarray  # where each page begins, and the end
    heard: np.ndarray
    words: np.ndarray  # where what is heard of each begins, and the end
    distinct: list[str]
    written: np.ndarray  # which of the distinct words each heard one is, as the recogniser wrote it
    starts: np.ndarray
    ends: np.ndarray
    sure: np.ndarray  # from 0 to 1

    def text(self, at: int) -> str:
        return self.distinct[self.written[at]]


Made = Callable[[pa.RecordBatch, Vocabulary], Readings]


def sent(words: str, heard: str | Made) -> tuple[list[Column], Made]:
    """The columns that `readings` asks for, from a column of words and one of what is heard (text, start, end, confidence), and what makes
    readings of them; or, for what is heard, a function that makes it beside the words (`_words`) and the other columns."""
    if callable(heard):
        return [F.col(words).alias("_words")], heard
    return [F.col(words).alias("_words"), *(F.col(heard)[x].alias(f"_{x}") for x in ("text", "start", "end", "confidence"))], readings


def readings(batch: pa.RecordBatch, known: Vocabulary) -> Readings:
    """The readings of rows with _words, _text, _start, _end and _confidence (arrays). A time that is null is not a number."""
    lists = [batch.column(c) for c in ("_words", "_text", "_start", "_end", "_confidence")]
    pages, words = (c.offsets.to_numpy() for c in lists[:2])
    page, text, *numbers = (c.values.slice(c.offsets[0].as_py(), c.offsets[-1].as_py() - c.offsets[0].as_py()) for c in lists)
    distinct, (on_page, written), ids = known.encoded(page, text)
    starts, ends, sure = (x.to_numpy(zero_copy_only=False).astype(float) for x in numbers)
    return Readings(ids[on_page], pages - pages[0], ids[written], words - words[0], distinct, written, starts, ends, np.clip(np.nan_to_num(sure), 0.0, 1.0))
