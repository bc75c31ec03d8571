"""Text functions as column expressions: they stay in the JVM, inside whole-stage code where Spark allows it."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The written form of a manuscript word, and finished words per hour of narration.
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*(?:-[\p{L}\p{N}]+)*"
COUNTED_WORD = r"[\p{L}\p{N}]+(?:['’.\-][\p{L}\p{N}]+)*"
WORDS_PER_HOUR = 9300
DASHES = r"[\s‐-―\-]+"

#: Letters that are one letter and its marks, and that letter: what canonical decomposition (NFKD) makes of them, as a table for
#: translate(), which stays in the JVM. Letters that become several (ligatures) are left as they are.
_BARE = {chr(i): bare for i in range(0xA0, 0x3000) if len(bare := "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.category(c).startswith("M"))) == 1 and bare != chr(i) and bare.isalnum()}


def unmarked(text: Column) -> Column:
    """A text without the marks of its letters (é is e)."""
    return F.regexp_replace(F.translate(text, "".join(_BARE), "".join(_BARE.values())), r"\p{M}", "")


def words(text: Column) -> Column:
    """The manuscript words of a text, in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(COUNTED_WORD))


def minutes(words: Column) -> Column:
    return words / F.lit(WORDS_PER_HOUR) * 60


#: The marks of Latin letters.
_MARKS = dict.fromkeys(range(0x300, 0x370))


def _normal(token: str) -> str:
    if token.isascii():
        bare = token.lower()
    else:
        bare = unicodedata.normalize("NFKD", token.replace("’", "'").replace("‘", "'")).translate(_MARKS)
        bare = (bare if bare.isascii() else "".join(c for c in bare if not unicodedata.category(c).startswith("M"))).lower()
    if bare.isascii() and bare.isalnum():
        return bare
    return "".join(c for c in bare if c.isalpha() or c.isnumeric() or c == "'").strip("'")


class _Normals(dict):
    """token -> its normal form, remembered while there are few enough."""

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[token] = found = _normal(token)
        return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalized_words(tokens: pd.Series) -> pd.Series:
    """Words without case, marks and punctuation, for matching (Spark has no Unicode normalisation of its own)."""
    known = _Normals()
    return tokens.map(lambda x: [known[t] for t in x])


@F.pandas_udf(T.StringType())
def normalized_word(token: pd.Series) -> pd.Series:
    """The same for one word a row, best applied to distinct words."""
    return token.map(_normal)


def spoken_pieces(text: Column) -> Column:
    """A text split at white space and dashes, lower-cased, without marks and what is neither letter, digit nor apostrophe."""
    plain = F.lower(unmarked(F.translate(F.coalesce(text, F.lit("")), "’‘", "''")))
    pieces = F.transform(F.split(plain, DASHES), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}']", ""), F.lit("'")))
    return F.filter(pieces, lambda x: x != "")


def ngrams(tokens: Column, n: int) -> Column:
    """(position from 0, n words joined by a space) of each run of n tokens."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("position"), F.array_join(F.slice(tokens, i + 1, n), " ").alias("gram")))


def similar(a: Column, b: Column) -> Column:
    """Long enough words that differ by one letter (two from eight letters on)."""
    longest = F.greatest(F.length(a), F.length(b))
    return (longest >= 5) & (F.abs(F.length(a) - F.length(b)) <= 2) & F.levenshtein(a, b, 2).between(0, F.when(longest >= 8, 2).otherwise(1))


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def marker_label(expected: Column, heard: Column, kind: Column, most: int = 96) -> Column:
    """expected → heard [kind], cut to `most` characters with an ellipsis."""
    shown = lambda c: F.when(c.isNull() | (c == ""), "—").otherwise(c)
    text = F.concat(shown(expected), F.lit(" → "), shown(heard), F.lit(" ["), kind, F.lit("]"))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


@F.pandas_udf(T.StringType())
def _fnv1a(texts: pd.Series) -> pd.Series:
    """32-bit FNV-1a over the UTF-16 units of each text, all texts of a batch at once, one unit after the other."""
    units = [np.frombuffer(x.encode("utf-16-le", "surrogatepass"), "<u2") for x in texts]
    length = np.array(list(map(len, units)), np.int64)
    flat, starts = np.concatenate([*units, np.zeros(1, "<u2")]).astype(np.uint32), np.cumsum(length) - length
    h = np.full(len(units), 0x811C9DC5, np.uint32)
    for i in range(int(length.max(initial=0))):
        on = length > i
        h[on] = (h[on] ^ flat[starts[on] + i]) * np.uint32(0x01000193)
    return pd.Series([f"{x:08x}" for x in h.tolist()], dtype=object)


def stable_id(*parts: Column) -> Column:
    """32-bit FNV-1a of the parts joined by |, as eight hex digits, over UTF-16 units."""
    return _fnv1a(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
