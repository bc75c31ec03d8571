"""One spelling for each word, and one class for words that sound alike, so that neither counts as a slip.

British spellings fold to American ones by rules whose guards keep different words apart (four, hour, filled, rise). Which
words sound alike depends on the accent, so that table is the caller's: a text file with a group of words in each line.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Pairs that no rule gives, British and American.
PAIRS = (
    "aeroplane/airplane aluminium/aluminum anaemia/anemia anaesthetic/anesthetic archaeology/archeology cheque/check defence/defense diarrhoea/diarrhea distil/distill draught/draft "
    "encyclopaedia/encyclopedia enrol/enroll enrolment/enrollment fulfil/fulfill fulfilment/fulfillment foetus/fetus gaol/jail grey/gray instalment/installment instil/instill "
    "haemoglobin/hemoglobin jewellery/jewelry kerb/curb licence/license manoeuvre/maneuver mediaeval/medieval mould/mold moult/molt moustache/mustache oesophagus/esophagus "
    "oestrogen/estrogen offence/offense paediatric/pediatric plough/plow practise/practice pretence/pretense programme/program pyjamas/pajamas sceptic/skeptic sceptical/skeptical "
    "skilful/skillful smoulder/smolder speciality/specialty storey/story sulphur/sulfur tyre/tire wilful/willful woollen/woolen"
)
#: Endings of a British spelling within their guards, and the American one.
RULES = [
    (re.compile(r"([a-z]{2})our(?=(?:s?|ed|ing|ite|ful|less|able)$)"), r"\1or"),
    (re.compile(r"([a-z]{3})is(?=e[sd]?$|ing$|ation)"), r"\1iz"),
    (re.compile(r"([a-z]{3})ys(?=e[sd]?$|ing$)"), r"\1yz"),
    (re.compile(r"([a-z]{2}[bcdfgklmnpqstvxz])re(?=[sd]?$)"), r"\1er"),
    (re.compile(r"^([a-z]*?[aeiouy][a-z]*?[^aeiouy][a-z]*?[aeiouy][a-z]*)ll(?=(?:ed|ing|ers?|est|ous)$)"), r"\1l"),
    (re.compile(r"([a-z]{4})ogue(?=s?$)"), r"\1og"),
]
_ANY = re.compile("our|is|ys|re|ll|ogue")
#: Words in groups that sound alike; a larger table is refused rather than sent to every task.
MAX_CLASSES = 200_000


def inflected(word: str) -> list[str]:
    """A word with the endings that a page may give it: plain, -s, -ed, -ing, -er, -ers."""
    if re.search(r"[^aeiou]y$", word):
        stem = word[:-1]
        return [word, stem + "ies", stem + "ied", word + "ing", stem + "ier", stem + "iers"]
    mute = word.endswith("e")
    stem, e = word.removesuffix("e"), "" if mute else "e"
    return [word, word + ("es" if re.search(r"(?:s|sh|ch|x|z)$", word) else "s"), word + e + "d", stem + "ing", word + e + "r", word + e + "rs"]


IRREGULAR = {a: b for pair in PAIRS.split() for a, b in zip(*map(inflected, pair.split("/")))}


@lru_cache(500_000)
def american_spelling(word: str) -> str:
    """The one spelling of a word; a word without another is left as it is."""
    plain = word.lower()
    if plain in IRREGULAR:
        return IRREGULAR[plain]
    if _ANY.search(plain):
        for british, american in RULES:
            plain = british.sub(american, plain)
    return plain


def classes_of(groups: Iterable[Iterable[str]]) -> dict[str, str]:
    """word -> class of words that sound alike, with and without apostrophes; a class is named by its first word."""
    found: dict[str, str] = {}
    for group in groups:
        first, *rest = (w.strip().lower() for w in group)
        for word in (first, *rest):
            found |= {word: f"~{first}", word.replace("'", ""): f"~{first}"}
    return found


def read_classes(spark: SparkSession, path: str) -> dict[str, str]:
    """The groups of a text file, a group in each line, its words parted by white space; a table that is too large is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    words = lines.agg(F.sum(F.size(F.split(F.trim("value"), r"\s+")))).first()[0] or 0
    if words > MAX_CLASSES:
        raise ValueError(f"{words} words that sound alike; up to {MAX_CLASSES} are taken")
    return classes_of(r["value"].split() for r in lines.collect())
