"""Names and pronunciations of a book: candidates with reasons, edits of a glossary, the guide. Groupings and joins on the
lower-cased spelling; the candidates' counters are one pass over the tokens, counted by spelling before anything else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a name's token looks like, spellings that are said otherwise, and what reasons weigh.
NAME_TOKEN = r"\p{L}[\p{L}\p{M}\d]*(?:['’.-][\p{L}\p{M}\d]+)*"
UNUSUAL = r"cest|chester|cestershire|eaux|ough|sch|tz|cz"
REASONS = {"capitalized": 3, "repeated-capitalized": 2, "name-pattern": 5, "uncommon": 1, "unusual-spelling": 4}
#: Words beside a name: a parameter; these are speech verbs and titles.
NAME_CONTEXT = ("said", "asked", "called", "named", "replied", "whispered", "mr", "mrs", "miss", "dr", "captain", "professor")


def canonical(raw: Column) -> Column:
    """A token's lower-cased form without a possessive ending."""
    return F.lower(F.regexp_replace(F.regexp_replace(raw, "(?i)['’]s$", ""), "[‐‑‒–—]", "-"))


def tokens(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, raw, word, capitalised, starts (a sentence), before, after: each name token with its neighbours in the sentence.

    Texts are cut where a sentence ends; what is left between two tokens of a piece is no sentence end."""
    pieces = docs.select(key, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), r"[.!?。！？:：—–\n]+(?=\s|$)|\n")).alias("p"))
    found = pieces.select(key, F.regexp_extract_all("p", F.lit(NAME_TOKEN), 0).alias("r")).where(F.size("r") > 0)
    none = F.lit(None).cast("string")
    beside = F.arrays_zip(F.col("r").alias("raw"), F.concat(F.array(none), F.slice("r", F.lit(1), F.size("r") - 1)).alias("b"), F.slice("r", F.lit(2), F.size("r")).alias("a"))
    rows = found.select(key, F.posexplode(beside).alias("at", "t")).select(key, "at", "t.raw", "t.b", "t.a")
    return rows.select(key, "raw", _word("raw"), _capitalised("raw"), (F.col("at") == 0).alias("starts"), _word("b").alias("before"), _word("a").alias("after"))


def _word(raw: str) -> Column:
    """canonical() of a name token, which has no other dashes; without a search in each."""
    c = F.col(raw)
    return F.lower(F.when(F.right(c, F.lit(2)).isin("'s", "'S", "’s", "’S"), F.left(c, F.length(c) - 2)).otherwise(c)).alias("word")


def _capitalised(raw: str) -> Column:
    return F.col(raw).rlike(r"^\p{Lu}").alias("capitalised")


def candidates(tokens: DataFrame, common: list[str], most: int = 80, context: tuple[str, ...] = NAME_CONTEXT) -> DataFrame:
    """spelling, word, frequency, reasons, score of the words that look like names or are spelt oddly, the most frequent first.

    tokens: as `tokens` gives them. The way it is mostly written is its spelling (of equals the capitalised, then the least)."""
    named = _capitalised("raw") & ~F.contains("word", F.lit("'")) & (F.coalesce(F.col("before").isin(*context), F.lit(False)) | F.coalesce(F.col("after").isin(*context), F.lit(False)))
    upper = (F.length("raw") > 1) & (F.col("raw") == F.upper("raw")) & (F.col("raw") != F.lower("raw"))
    count = lambda c: F.count_if(c)
    spelt = tokens.groupBy("raw").agg(F.count(F.lit(1)).alias("n"), count(~F.col("starts")).alias("inside"), count(named).alias("named"))
    spelt = spelt.select("*", _word("raw"), _capitalised("raw"), upper.alias("upper"))
    total = lambda c, on=None: F.sum(F.col(c) if on is None else F.when(on, F.col(c)).otherwise(0))
    cap = F.col("capitalised")
    words = spelt.groupBy("word").agg(
        total("n").alias("frequency"), total("n", cap).alias("capitals"), total("inside", cap).alias("inside"), total("named").alias("named"), total("n", F.col("upper")).alias("acronyms"),
        F.bool_or(F.col("raw").rlike(r"[^\x00-\x7f]")).alias("odd_letters"), F.min_by("raw", F.struct((-F.col("n")).alias("n"), (~cap).alias("small"), "raw")).alias("spelling"),
    )
    known = F.col("word").isin(*common) if common else F.lit(False)
    letters = F.regexp_replace("word", "[^a-z]", "")
    noise = (F.length(letters) >= 6) & letters.rlike("^[aeiouhywm]+$") & (F.size(F.array_distinct(F.split(letters, ""))) <= 3)
    unusual = F.col("word").rlike(UNUSUAL) | F.col("odd_letters")
    name = ~noise & ((F.col("named") > 0) | (~known & (F.col("capitals") > 0)))
    listed = words.where(name | (~known & ~noise & (unusual | (F.col("acronyms") > 0))))
    flags = {"capitalized": name & (F.col("inside") > 0), "repeated-capitalized": name & (F.col("capitals") >= 3), "name-pattern": F.col("named") > 0, "uncommon": ~known, "unusual-spelling": unusual}
    reasons = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in flags.items()]), lambda r: r.isNotNull())
    score = sum((F.when(c, F.lit(REASONS[r])).otherwise(0) for r, c in flags.items()), F.lit(0))
    return listed.select("spelling", "word", "frequency", F.array_join(reasons, ",").alias("reasons"), score.alias("score")).orderBy(F.desc("frequency"), F.desc("score"), "word").limit(most)


def slug(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(bare == "", "entry").otherwise(F.substring(bare, 1, 48))


def with_ids(found: DataFrame, order: list[str | Column]) -> DataFrame:
    """Candidates with an id of their spelling, numbered where spellings make the same."""
    n = F.row_number().over(Window.partitionBy("_slug").orderBy(*order))
    return found.withColumn("_slug", slug(F.col("spelling"))).withColumn("id", F.concat(F.lit("auto-"), F.col("_slug"), F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""))).drop("_slug")


def _keyed(df: DataFrame, p: str, *more: str) -> DataFrame:
    return df.select(F.lower(F.trim("spelling")).alias("word"), *[F.col(c).alias(f"{p}_{c}") for c in ("spelling", "frequency", *more)])


def replaced(existing: DataFrame, found: DataFrame) -> DataFrame:
    """word, spelling, frequency, source after a new scan: rows that a person made or worked on stay, with the new frequency if
    the word is found again; other old rows go, new words come. existing: spelling, frequency, source, respell, note."""
    human = (F.col("source") == "user") | (F.coalesce("respell", F.lit("")) != "") | (F.coalesce("note", F.lit("")) != "")
    both = _keyed(existing.where(human), "a", "source").join(_keyed(found, "b"), "word", "full_outer")
    return both.select("word", F.coalesce("a_spelling", "b_spelling").alias("spelling"), F.coalesce("b_frequency", "a_frequency").alias("frequency"), F.coalesce("a_source", F.lit("auto")).alias("source"))


def renamed(glossary: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries under their new spellings; entries that then are one word become one: frequencies add up, a person's entry gives
    the spelling and the source. changes: word, spelling."""
    new = glossary.withColumn("word", F.lower(F.trim("spelling"))).join(changes.select("word", F.col("spelling").alias("_to")), "word", "left")
    new = new.withColumns({"spelling": F.coalesce("_to", "spelling"), "source": F.when(F.col("_to").isNotNull(), "user").otherwise(F.col("source"))})
    user = F.col("source") != "user"
    return new.groupBy(F.lower(F.trim("spelling")).alias("word")).agg(
        F.min_by(F.trim("spelling"), F.struct(user.alias("u"), (-F.col("frequency")).alias("f"), "spelling")).alias("spelling"), F.sum("frequency").alias("frequency"), F.min(F.when(user, "auto").otherwise("user")).alias("_s"), F.max("source").alias("source")
    ).drop("_s")


def respelt(glossary: DataFrame, lexicon: DataFrame) -> DataFrame:
    """glossary with blank respellings filled from a lexicon (word, respell), and filled: yes, no, or unknown."""
    known = lexicon.groupBy("word").agg(F.min("respell").alias("_found"))
    blank = F.trim(F.coalesce("respell", F.lit(""))) == ""
    both = glossary.withColumn("word", F.lower(F.trim("spelling"))).join(known, "word", "left")
    state = F.when(~blank, "no").when(F.col("_found").isNull(), "unknown").otherwise("yes")
    return both.withColumns({"filled": state, "respell": F.when(blank, F.col("_found")).otherwise(F.col("respell"))}).drop("_found")


def guide_rows(glossary: DataFrame, tokens: DataFrame, chapter: str) -> DataFrame:
    """word, spelling, count, chapters: how often each name stands where. Joins on the word, not a search for each name; tokens that are
    no names are left out before anything is counted;
    names of one word (those of several are phrases, see phrase_places)."""
    names = glossary.select(F.lower(F.trim("spelling")).alias("word"), "spelling")
    counted = tokens.join(names.select("word"), "word", "left_semi").groupBy("word", chapter).agg(F.count(F.lit(1)).alias("n"))
    rows = names.join(counted, "word", "left").groupBy("word").agg(F.min("spelling").alias("spelling"), F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.count(F.col(chapter)).alias("chapters"))
    return rows


def spelled_syllables(word: Column) -> Column:
    """Groups of vowels, less an ending that is written and not said."""
    letters = F.regexp_replace(F.regexp_replace(F.lower(word), "[^a-z]", ""), "(?:es|e)$", "")
    return F.greatest(F.lit(1), F.regexp_count(letters, F.lit("[aeiouy]+")))


def said_unlike_spelling(word: Column, phones: Column) -> Column:
    """A dictionary gives another number of syllables (stress digits) than the spelling has."""
    spoken = F.regexp_count(phones, F.lit(r"\d"))
    return F.coalesce((spoken > 0) & ~word.rlike("[-']") & (spelled_syllables(word) != spoken), F.lit(False))


def pronunciation_states(readings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state of a name in a chapter, by what was heard: undecided (no respelling), unheard, inconsistent, matches,
    unverified. readings: keys, respell, heard (null: not checked)."""
    spoken = F.count_distinct(F.when(F.col("heard") != "", F.lower("heard")))
    agg = readings.groupBy(*keys).agg(F.max("respell").alias("r"), F.count("heard").alias("checked"), F.count_if(F.col("heard") != "").alias("said"), spoken.alias("ways"))
    state = F.when(F.coalesce("r", F.lit("")) == "", "undecided").when(F.col("checked") == 0, "unverified").when(F.col("said") == 0, "unheard").when(F.col("ways") > 1, "inconsistent").otherwise("matches")
    return agg.select(*keys, state.alias("state"))
