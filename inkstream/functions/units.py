"""What is compared when a reading is matched with a page: numbers as digits, words that sound alike as one class.

A run of number words is written as one letter per word, and the grammar of spoken figures is a regular expression over
those letters. British and American spellings are one; homophones are a parameter (word -> class), as they depend on the accent.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from inkstream.functions.spelling import american_spelling
from inkstream.functions.text import _normal
from inkstream.operators.idioms import lists

#: Number words, their ordinals and what they stand for.
ONES = "one two three four five six seven eight nine".split()
ONES_ORDINAL = "first second third fourth fifth sixth seventh eighth ninth".split()
TEENS = "eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TEENS_ORDINAL = "eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
TENS = "ten twenty thirty forty fifty sixty seventy eighty ninety".split()
TENS_ORDINAL = "tenth twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth".split()
ZEROS = "zero oh nought naught".split()
HUNDRED, SCALES = 100, {"thousand": 10**3, "million": 10**6, "billion": 10**9}

#: word -> (letter, value): Z zero, D 1-9, E 11-19, Y 10-90 by tens, H hundred, S larger; small letters are ordinals.
NUMBER_WORDS = (
    {w: ("Z", 0) for w in ZEROS}
    | {w: (c, first + step * i) for c, first, step, names in (("D", 1, 1, ONES), ("d", 1, 1, ONES_ORDINAL), ("E", 11, 1, TEENS), ("e", 11, 1, TEENS_ORDINAL), ("Y", 10, 10, TENS), ("y", 10, 10, TENS_ORDINAL)) for i, w in enumerate(names)}
    | {"hundred": ("H", HUNDRED), "hundredth": ("h", HUNDRED)}
    | {w + end: (c, n) for w, n in SCALES.items() for end, c in (("", "S"), ("th", "s"))}
)
RUN = re.compile(r"[A-Z](?:&?[A-Z])*(?:&?[a-z])?|[a-z]")
_PAIR = "(?:Y(?:&?D)?|E|D)"
FIGURE = re.compile(f"Z|(?:{_PAIR}|H(?:&?{_PAIR})?)(?:&?H(?:&?{_PAIR})?)*")
WRITTEN = re.compile(r"0*(\d+?)(st|nd|rd|th)?", re.ASCII)
SPLIT = re.compile(r"[\s‐-―\-]+")


def _figure(letters: str, values: list[int]) -> int:
    total = 0
    for letter, value in zip(letters, values):
        total = (total or 1) * value if letter == "H" else total + value
    return total


def _figures(letters: str, values: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """(place of the first word, value) of each figure spoken side by side."""
    return [(m.start(), _figure(m[0], values[m.start() : m.end()])) for m in FIGURE.finditer(letters, low, high)]


def number_at(letters: str, values: list[int], at: int) -> tuple[str, int]:
    """(key, words) of the number that begins at a number word.

    Scales bind all that is spoken into one number; two figures of two digits, or one with a zero and a digit, are a year;
    otherwise only the first figure is taken."""
    run = RUN.match(letters, at)
    spoken, ordinal = letters[: run.end()].upper(), "#ord" if letters[run.end() - 1].islower() else ""
    scales = [i for i in range(at, run.end()) if spoken[i] == "S"]
    bounds = [at, *(i + 1 for i in scales), run.end()]
    parts = [_figures(spoken, values, a, b) for a, b in zip(bounds, bounds[1:])]
    if scales:
        lasts = [p[-1][1] if p else 0 for p in parts]
        return f"{sum((n or 1) * values[i] for n, i in zip(lasts, scales)) + lasts[-1]}{ordinal}", run.end() - at
    figures = parts[0]
    said = [n for _, n in figures]
    two = [10 <= n <= 99 for n in said]
    year = two == [True, True] or (len(said) == 3 and two[0] and said[1] == 0 and 1 <= said[2] <= 9)
    if len(said) == 1 or year:
        return "".join(map(str, said)) + ordinal, run.end() - at
    return str(said[0]), 1 if spoken[at] == "Z" else figures[1][0] - at


class _Pieces(dict):
    """token -> (piece, what it is as a number word, key of any other word, whether that is a number in digits) of each of its pieces,
    remembered while there are few enough."""

    def __missing__(self, token: str | None) -> tuple:
        if len(self) > 200_000:
            self.clear()
        self[token] = found = tuple((p, NUMBER_WORDS.get(p), *_key(p)) for p in map(_normal, SPLIT.split(token or "")) if p)
        return found


def _key(word: str) -> tuple[str, bool]:
    written = WRITTEN.fullmatch(word)
    return (written[1] + ("#ord" if written[2] else ""), True) if written else (american_spelling(word), False)


_PIECES = _Pieces()


def units(tokens: list[str], classes: dict[str, str] | None = None) -> list[tuple[str, int, int]]:
    """(key, first token, last token) of each unit; a token without letters or digits has none."""
    pieces = [(p, i) for i, t in enumerate(tokens) for p in _PIECES[t]]
    plain = [(p[2] if p[3] or not classes else classes.get(p[2], p[2]), i, i) for p, i in pieces]
    found, done, end, letters, values = [], 0, 0, "", []
    for k in [k for k, (p, _) in enumerate(pieces) if p[1]]:
        if k < done:
            continue
        if k >= end:  # the number words that stand together from here on
            end = first = k
            while end < len(pieces) and (pieces[end][0][1] or pieces[end][0][0] == "and" and end + 1 < len(pieces) and pieces[end + 1][0][1]):
                end += 1
            letters = "".join(p[1][0] if p[1] else "&" for p, _ in pieces[first:end])
            values = [p[1][1] if p[1] else 0 for p, _ in pieces[first:end]]
        key, n = number_at(letters, values, k - first)
        found += plain[done:k]
        found.append((key, pieces[k][1], pieces[k + n - 1][1]))
        done = k + n
    return found + plain[done:]


UNIT = T.StructType([T.StructField("key", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])


def match_units(tokens: Column, classes: dict[str, str] | None = None) -> Column:
    """The units of an array of tokens (null: none). classes: a word's class, for homophones, by its American spelling."""

    @F.arrow_udf(T.ArrayType(UNIT))
    def of(rows: pa.Array) -> pa.Array:
        kind, parts, ends = to_arrow_type(T.ArrayType(UNIT)), ([], [], []), [0]
        for row in lists(rows):
            found = units(row, classes)
            for part, column in zip(parts, zip(*found)):
                part += column
            ends.append(ends[-1] + len(found))
        columns = [pa.array(c, f.type) for c, f in zip(parts, kind.value_type)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)), type=kind)

    return of(tokens)
