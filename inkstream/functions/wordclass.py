"""Classes of single words, in normal form: what counts as the same word, what a narrator may have said in its place, and which
words carry the content of a sentence. Plain functions on strings, for the matchers that run inside Arrow functions."""

from __future__ import annotations

import re
from functools import lru_cache

from inkstream.functions.units import ONES, ONES_ORDINAL, TEENS, TEENS_ORDINAL, TENS, TENS_ORDINAL

#: Words by class.
FUNCTION_WORDS = frozenset("a an and as at be but by for from i in is it of on or the to we you".split())
DETERMINERS = frozenset("a an the this that these those".split())
PREPOSITIONS = frozenset(
    "about above across after against along among around at before behind below beneath beside between beyond by down during for from in inside into near of off on onto out "
    "outside over past through throughout to too toward towards under underneath until up upon with within without".split()
)
PRONOUNS = frozenset("he her hers him his i it its me my mine our ours she their theirs them they us we you your yours".split())
AUXILIARIES = frozenset("am are be been being did do does had has have is was were".split())
CLASSES = (DETERMINERS, PREPOSITIONS, PRONOUNS, AUXILIARIES)
CLOSED = frozenset().union(*CLASSES)
#: Spellings of one word that no rule gives, British and American.
SPELLINGS = dict(
    x.split("/")
    for x in "grey/gray mould/mold smoulder/smolder moustache/mustache plough/plow tyre/tire kerb/curb pyjamas/pajamas aluminium/aluminum jewellery/jewelry programme/program "
    "aeroplane/airplane sceptical/skeptical judgement/judgment whisky/whiskey draught/draft cheque/check storey/story gaol/jail".split()
)
#: Endings of one word in two spellings, each from a length of the word on.
ENDINGS = [
    (0, re.compile(r"([^\W\d_]{3,})our"), r"\1or"),
    (5, re.compile(r"([^\W\d_]{3,})re$"), r"\1er"),
    (6, re.compile(r"is(e|ed|es|ing|ation|ations)$"), r"iz\1"),
    (6, re.compile(r"ys(e|ed|es|ing)$"), r"yz\1"),
    (6, re.compile(r"ogue$"), "og"),
    (6, re.compile(r"ence$"), "ense"),
    (8, re.compile(r"ll(ed|ing|er|est|ous)$"), r"l\1"),
]
#: How a word ends that one of these may change, but for the first, which holds a part.
_ANY_END = ("re", "ogue", "ence", *(x + y for x, ends in (("is", "e ed es ing ation ations"), ("ys", "e ed es ing"), ("ll", "ed ing er est ous")) for y in ends.split()))
#: Plurals that no rule gives, and endings that make one word of another.
PLURALS = dict(
    x.split("/")
    for x in "children/child men/man women/woman gentlemen/gentleman people/person feet/foot teeth/tooth geese/goose mice/mouse lice/louse oxen/ox lives/life wives/wife knives/knife "
    "leaves/leaf halves/half shelves/shelf thieves/thief wolves/wolf loaves/loaf".split()
)
INFLECTIONS = frozenset("s es ed ing er est".split())

_SCALES = {"hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9}
UNIT_WORDS = {"zero": 0} | {w: n for names, first, step in ((ONES, 1, 1), (ONES_ORDINAL, 1, 1), (TEENS, 11, 1), (TEENS_ORDINAL, 11, 1), (TENS, 10, 10), (TENS_ORDINAL, 10, 10)) for n, w in enumerate(names, 0) for n in [first + step * n]}
_PIECE = re.compile("|".join(sorted([*UNIT_WORDS, *_SCALES], key=len, reverse=True)))
_DIGITS = re.compile(r"(\d+)(?:st|nd|rd|th)?", re.ASCII)


@lru_cache(100_000)
def number_value(token: str) -> int | None:
    """The number that digits, or number words written together, stand for; null for any other word."""
    raw = token.lower().replace(",", "")
    if written := _DIGITS.fullmatch(raw):
        return int(written[1])
    at, done, open_ = 0, 0, 0
    while at < len(raw):
        piece = _PIECE.match(raw, at)
        if piece is None:
            return None
        at, scale = piece.end(), _SCALES.get(piece[0])
        open_ = max(open_, 1) * scale if scale else open_ + UNIT_WORDS[piece[0]]
        if scale and scale > 100:
            done, open_ = done + open_, 0
    return done + open_ if raw else None


def dialect_key(token: str) -> str:
    """The spelling that stands for all spellings of a word."""
    key = token.replace("'", "")
    if key in SPELLINGS:
        return SPELLINGS[key]
    if "our" not in key and not key.endswith(_ANY_END):
        return key
    for least, ending, other in ENDINGS:
        if len(key) >= least:
            key = ending.sub(other, key, count=1)
    return key


def same_word(a: str, b: str) -> bool:
    """One spoken word, written in two ways."""
    if a == b or not a or not b:
        return a == b != ""
    value = number_value(a)
    return value is not None and value == number_value(b) or dialect_key(a) == dialect_key(b)


@lru_cache(200_000)
def distance(a: str, b: str) -> int:
    """Letters put in, left out or changed between two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


_letters = lru_cache(200_000)(frozenset)


def least_distance(a: str, b: str) -> int:
    """What the distance is at least: an edit changes a length by one and the letters that only one word has by two."""
    return max(abs(len(a) - len(b)), (len(_letters(a) ^ _letters(b)) + 1) // 2)


def near(a: str, b: str) -> bool:
    """Equal, or long enough and a letter apart (two from eight letters on)."""
    if a == b:
        return a != ""
    m, n = len(a), len(b)
    most = 2 if m >= 8 or n >= 8 else 1
    return -most <= m - n <= most and (m >= 5 or n >= 5) and m > 0 < n and least_distance(a, b) <= most and distance(a, b) <= most


def alike(heard: str, expected: str) -> bool:
    return heard == expected != "" or same_word(heard, expected) or near(heard, expected)


def likeness(a: str, b: str, least: float = 0.0) -> float:
    """From 0 to 1; what cannot reach `least`, by the lengths alone, is 0."""
    if not a or not b or a != b and 1 - abs(len(a) - len(b)) / max(len(a), len(b)) < least and not same_word(a, b):
        return 0.0
    return 1.0 if same_word(a, b) else 1 - distance(a, b) / max(len(a), len(b))


def is_function(token: str) -> bool:
    return token in FUNCTION_WORDS or token in CLOSED


def is_content(token: str) -> bool:
    return len(token) >= 4 and token not in FUNCTION_WORDS or number_value(token) is not None


def _by_length(a: str, b: str) -> tuple[str, str]:
    return (a, b) if len(a) <= len(b) else (b, a)


def slip(expected: str, heard: str) -> str | None:
    """How the one became the other, if in a bounded way: another number, an inflection, a lost onset of one or two letters, or
    another word of the same closed class."""
    if not expected or not heard or expected == heard:
        return None
    said, meant = number_value(heard), number_value(expected)
    if said is not None and meant is not None and said != meant:
        return "number"
    short, long = _by_length(heard, expected)
    if PLURALS.get(long) == short or PLURALS.get(short) == long or len(short) >= 3 and long.startswith(short) and long[len(short) :] in INFLECTIONS:
        return "inflection"
    if long.endswith(short) and 1 <= len(long) - len(short) <= 2:
        return "onset"
    return "swap" if any(expected in c and heard in c for c in CLASSES) else None


def is_swap(expected: str, heard: str) -> bool:
    """A small word, or a number, said for another of its kind."""
    if expected == heard:
        return False
    if heard in CLOSED and any(expected in c and heard in c for c in CLASSES):
        return True
    said = number_value(heard)
    return said is not None and (meant := number_value(expected)) is not None and said != meant


def is_plausible(expected: str, heard: str) -> bool:
    return slip(expected, heard) is not None or near(heard, expected)


def is_piece(heard: str, expected: str) -> bool:
    """One word is a part of the other, without a slip that explains it: a recogniser's fragment."""
    if not heard or not expected or heard == expected or slip(expected, heard):
        return False
    short, long = _by_length(heard, expected)
    return short not in CLOSED and short != long and short in long
