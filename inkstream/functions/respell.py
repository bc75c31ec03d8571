"""Pronunciations as a narrator can read them: `L IY1 OW0 M IH2 N S T ER0` is LEE-oh-min-ster.

Phones become one letter each (a vowel is followed by its stress), so syllables are cut by regular expressions: a syllable
begins with the longest cluster of consonants that an English word may begin with. All of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How phones are written for a reader, vowels and consonants.
VOWELS = dict(x.split("/") for x in "AA/ah AE/a AH/uh AO/aw AW/ow AY/y EH/e ER/er EY/ay IH/i IY/ee OW/oh OY/oy UH/uu UW/oo".split())
CONSONANTS = dict(x.split("/") for x in "B/b CH/ch D/d DH/th F/f G/g HH/h JH/j K/k L/l M/m N/n NG/ng P/p R/r S/s SH/sh T/t TH/th V/v W/w Y/y Z/z ZH/zh".split())
#: Clusters that begin words, and vowels that a reader expects to see closed by a consonant.
ONSETS = (
    "B L,B R,D R,D W,F L,F R,G L,G R,G W,HH Y,K L,K R,K W,K Y,M Y,P L,P R,P Y,S F,S K,S L,S M,S N,S P,S T,S W,SH R,T R,T W,TH R,TH W,V R,S K R,S K W,S P L,S P R,S T R,B Y,F Y"
)
CHECKED = "AE EH IH AH UH AA AO".split()

_LETTER = {p: chr(ord("A") + i) for i, p in enumerate(VOWELS)} | {p: chr(ord("a") + i) for i, p in enumerate(CONSONANTS)}
_V, _C = (f"[{''.join(_LETTER[p] for p in group)}]" for group in (VOWELS, CONSONANTS))
_BEGINS = "|".join(sorted(("".join(_LETTER[p] for p in x.split()) for x in ONSETS.split(",")), key=len, reverse=True))
#: In this order: a stressed short vowel keeps a single consonant; else the longest cluster goes on; two vowels are parted.
CUTS = [
    (f"([{''.join(_LETTER[p] for p in CHECKED)}]1{_C})(?={_V})", "$1-"),
    (f"([0-2]{_C}*?)({_BEGINS}|{_C})(?={_V})", "$1-$2"),
    (f"([0-2])(?={_V})", "$1-"),
]


def _lookup(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def respelt(phones: Column) -> Column:
    """Syllables of a pronunciation joined by hyphens, those that are stressed in capitals; null for what is none."""
    parts = F.filter(F.split(F.trim(phones), r"\s+"), lambda p: p != "")
    letters, spelled = _lookup(_LETTER), _lookup({_LETTER[p]: text for p, text in (VOWELS | CONSONANTS).items()})
    symbol = lambda p: F.upper(F.regexp_extract(p, r"^([A-Za-z]+)[0-2]?$", 1))
    stress = lambda p: F.when(symbol(p).isin(*VOWELS), F.coalesce(F.nullif(F.regexp_extract(p, r"([0-2])$", 1), F.lit("")), F.lit("0"))).otherwise("")
    coded = F.array_join(F.transform(parts, lambda p: F.concat(F.try_element_at(letters, symbol(p)), stress(p))), "")
    known = (F.size(parts) > 0) & F.forall(parts, lambda p: F.map_contains_key(letters, symbol(p))) & F.exists(parts, lambda p: symbol(p).isin(*VOWELS))
    for pattern, cut in CUTS:
        coded = F.regexp_replace(coded, pattern, cut)
    mark = F.when(F.contains(coded, F.lit("1")), "1").otherwise("2")

    def syllable(s: Column) -> Column:
        text = F.array_join(F.transform(F.regexp_extract_all(s, F.lit("[A-Za-z]"), 0), lambda c: F.try_element_at(spelled, c)), "")
        return F.when(F.contains(s, mark), F.upper(text)).otherwise(text)

    return F.when(known, F.array_join(F.transform(F.split(coded, "-"), syllable), "-"))


def suggested(names: DataFrame, lexicon: DataFrame, spelling: str = "spelling") -> DataFrame:
    """names and respell: of names whose every part (between spaces and dashes) a lexicon has, the parts' respellings joined by
    spaces; else null. lexicon: word (lower case), phones; its first pronunciation counts. One join by part, none by name."""
    bare = lambda p: F.lower(F.regexp_replace(F.regexp_replace(p, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", ""))
    pieces = F.filter(F.split(F.trim(F.coalesce(F.col(spelling), F.lit(""))), r"[\s‐-―-]+"), lambda p: p != "")
    distinct = names.select(spelling).distinct()
    each = distinct.select(spelling, F.posexplode(F.transform(pieces, bare)).alias("_at", "_word"))
    known = lexicon.groupBy("word").agg(F.min("phones").alias("phones")).select(F.col("word").alias("_word"), respelt(F.col("phones")).alias("_said"))
    met = each.join(known, "_word", "left").groupBy(spelling).agg(F.bool_and(F.col("_said").isNotNull()).alias("_all"), F.array_sort(F.collect_list(F.struct("_at", "_said"))).alias("_parts"))
    whole = met.select(F.col(spelling).alias("_spelling"), F.when(F.col("_all"), F.array_join(F.transform("_parts", lambda p: p["_said"]), " ")).alias("respell"))
    return names.join(whole, F.col(spelling) == F.col("_spelling"), "left").drop("_spelling")
