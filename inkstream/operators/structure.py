"""Structure of manuscripts: sentences, chapters, dialogue and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstream.functions.text import WORD, minutes, similar, word_count, words
from inkstream.functions.wordclass import PLURALS, UNIT_WORDS
from inkstream.operators.idioms import as_of

#: What a heading line looks like, and the longest narration that one chapter should have.
HEADING = r"(?i)^\s*(?:#{1,6}\s+\S.*|(?:chapter|part|book)\s+(?:\d+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\b.{0,80}|(?:prologue|epilogue|introduction|foreword|afterword|preface)\s*\.?)\s*$"
SENTENCE_END = r"(?<=[.!?。！？…])[\s\"”’)]+|\n+"
OVER_MINUTES = 120


def lines(text: Column) -> Column:
    """Lines of a text whatever ends them, without a byte order mark."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "^﻿", ""), r"\r\n|\r|\n")


def sentences(text: Column) -> Column:
    """Pieces that end with a full stop, question or exclamation mark, or a line; pieces without a word are left in."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: F.trim(s) != "")


def split_chapters(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chapter (from 0: what stands before the first heading), title, words, minutes, over_120, first_line, last_line.

    A heading of which no line of text follows before the next is a contents entry or a stacked heading: it makes no
    chapter of its own. A null or empty text is one chapter without words."""
    rows = docs.select(key, F.posexplode(lines(F.col(text))).alias("line", "t"))
    w = Window.partitionBy(key).orderBy("line")
    rows = rows.withColumns({"heading": F.col("t").rlike(HEADING), "blank": F.trim("t") == ""})
    body = F.first(F.when(~F.col("blank"), F.col("heading")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    starts = F.col("heading") & ~F.coalesce(body, F.lit(True))
    rows = rows.withColumn("starts", starts).withColumn("chapter", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    n = F.sum(F.when(F.col("starts"), 0).otherwise(word_count(F.col("t")))).cast("long")
    found = rows.groupBy(key, "chapter").agg(
        F.max(F.when(F.col("starts"), F.trim(F.regexp_replace("t", r"^\s*#+\s*", "")))).alias("title"), n.alias("words"), F.min("line").alias("first_line"), F.max("line").alias("last_line")
    )
    found = found.where((F.col("chapter") > 0) | (F.col("words") > 0) | (F.col("first_line") == 0) & F.col("title").isNull())
    return found.withColumn("minutes", F.round(minutes(F.col("words")), 6)).withColumn("over_120", F.col("minutes") > OVER_MINUTES)


def dialogue(text: Column) -> Column:
    """The quoted passages of a text: between straight quotes of one paragraph, or between curly ones."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r'"([^"\n]+)"|“([^”\n]+)”'), 0)


def name_candidates(docs: DataFrame, most: int, text: str = "text", least: int = 3, share: float = 0.75) -> DataFrame:
    """word, spelling, frequency, capitalised, variants of words that are nearly always capitalised, the most frequent first.

    Counted by spelling first, so the second grouping sees each spelling once."""
    tokens = docs.select(F.explode(words(F.col(text))).alias("t"))
    spelt = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("n")).withColumns({"word": F.lower("t"), "upper": F.col("t").rlike(r"^\p{Lu}")})
    found = spelt.groupBy("word").agg(
        F.min_by("t", F.struct((-F.col("n")).alias("n"), "t")).alias("spelling"),
        F.sum("n").alias("frequency"),
        F.sum(F.when(F.col("upper"), F.col("n")).otherwise(0)).alias("capitalised"),
        F.count(F.lit(1)).alias("variants"),
    )
    return found.where((F.col("frequency") >= least) & (F.col("capitalised") >= share * F.col("frequency"))).orderBy(F.desc("frequency"), "word").limit(most)


def merged_glossaries(mine: DataFrame, found: DataFrame) -> DataFrame:
    """word, spelling, frequency, source: frequencies add up; what a person has entered keeps its spelling."""
    key = lambda df, p: df.select(F.lower(F.trim("spelling")).alias("word"), F.col("spelling").alias(f"{p}_spelling"), F.col("frequency").alias(f"{p}_n"), F.col("source").alias(f"{p}_source"))
    both = key(mine, "a").join(key(found, "b"), "word", "full_outer")
    return both.select("word", F.coalesce("a_spelling", "b_spelling").alias("spelling"), (F.coalesce("a_n", F.lit(0)) + F.coalesce("b_n", F.lit(0))).alias("frequency"), F.coalesce("a_source", "b_source").alias("source"))


def pronunciations(lines_of_dictionary: DataFrame) -> DataFrame:
    """word, phones, variants of a pronouncing dictionary (`WORD(2)  P H O N E S`; lines that start with ;;; are remarks).

    lines_of_dictionary: value, as spark.read.text gives it, and line, its order; the first pronunciation leads."""
    parts = lines_of_dictionary.where(~F.col("value").startswith(";;;")).select(
        "line", F.lower(F.regexp_extract("value", r"^(\S+?)(?:\(\d+\))?\s", 1)).alias("word"), F.trim(F.regexp_extract("value", r"^\S+\s+(.*)$", 1)).alias("phones")
    )
    return parts.where("word <> '' and phones <> ''").groupBy("word").agg(F.min_by("phones", "line").alias("phones"), F.count_distinct("phones").alias("variants"))


def lookalike_pairs(names: DataFrame, word: str = "word") -> DataFrame:
    """word, other: all pairs of distinct words that are similar. Each word goes under itself and its forms with one letter
    left out, from six letters on also two (the shorter of two words that may be two edits apart has six at least)."""
    shorter = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    one = shorter(F.col(word))
    two = F.when(F.length(word) >= 6, F.flatten(F.transform(one, shorter))).otherwise(F.array().cast("array<string>"))
    keyed = names.select(F.col(word).alias("word")).distinct().select("word", F.explode(F.array_distinct(F.concat(F.array(F.col("word")), one, two))).alias("form"))
    a, b = keyed, keyed.withColumnRenamed("word", "other")
    return a.join(b, "form").where("word < other").select("word", "other").distinct().where(similar(F.col("word"), F.col("other")))


#: Words whose full stop ends no sentence, and the words of a block of a transcript.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "rev", "gen", "lt", "sgt", "capt", "col", "jr", "sr", "st", "vs", "etc", "inc", "ltd", "co", "no", "fig", "dept", "est", "ft")
BLOCK_WORDS = 90
#: Short words of a class, which readers put for each other.
SHORT_WORDS = [("the", "a", "an", "this", "that"), ("in", "on", "at", "by", "of", "to", "for", "from", "with"), ("he", "she", "it", "they", "we", "you", "i"), ("is", "was", "are", "were", "be", "has", "had", "have")]
TOKEN_AND_GAP = rf"({WORD})([^\p{{L}}\p{{N}}]*)"


def _sentences_of(docs: DataFrame, key: str, text: str, more: int = 0) -> DataFrame:
    """key, sentence, first, last (tokens, from 0), and from and to: where the sentence `more` before begins and the one `more` after
    ends. A text is gone through once, for its words with what follows each; no row leaves its text."""
    parts = docs.select(key, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN_AND_GAP), F.lit(0)).alias("p"))
    word = lambda p: F.lower(F.regexp_replace(p, r"[^\p{L}\p{N}]+$", ""))
    ends = lambda p, i: p.rlike("[\n!?。！？]") | (F.contains(p, F.lit(".")) & ~word(p).isin(*ABBREVIATIONS)) | (i == F.size("p") - 1)
    lasts = parts.select(key, F.array_compact(F.transform("p", lambda p, i: F.when(ends(p, i), i))).alias("e"))
    after = lambda i: F.when(i < 0, 0).otherwise(F.get("e", i) + 1)
    row = lambda z, i: F.struct(after(i - 1).alias("first"), z.alias("last"), after(i - 1 - more).alias("from"), F.get("e", F.least(i + more, F.size("e") - 1)).alias("to"))
    # outer: of an inner one Spark asks first whether there is a sentence, and goes through the text once more for it
    rows = lasts.select(key, F.posexplode_outer(F.transform("e", row)).alias("sentence", "r")).where("r is not null")
    return rows.select(key, "sentence", "r.first", "r.last", "r.from", "r.to")


def sentence_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sentence, first, last (tokens, from 0): a sentence ends at a line end, at ! or ?, and at a full stop that does not
    belong to an abbreviation."""
    return _sentences_of(docs, key, text).select(key, "sentence", "first", "last")


def token_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", more: int = 0) -> DataFrame:
    """key, token, first, last: what line_ranges gives for every token of the texts, made from the sentences, so nothing is looked up."""
    wide = _sentences_of(docs, key, text, more)
    return wide.select(key, F.explode_outer(F.sequence("first", "last")).alias("token"), F.col("from").alias("first"), F.col("to").alias("last"))


def line_ranges(ranges: DataFrame, tokens: DataFrame, key: str, more: int = 0) -> DataFrame:
    """tokens (key, token) with first and last of the sentence that holds it, widened by `more` sentences on either side: each
    sentence is widened once, and a token takes the last that begins at or before it."""
    order = Window.partitionBy(key).orderBy("sentence")
    wide = ranges.select(key, F.col("first").alias("token"), F.col("last").alias("_z"), F.min("first").over(order.rowsBetween(-more, 0)).alias("first"), F.max("last").over(order.rowsBetween(0, more)).alias("last"))
    return as_of(tokens.select(key, "token"), wide, [key], "token", ["_z", "first", "last"]).where("token <= _z").drop("_z")


def without_heading_marks(text: Column) -> Column:
    """A text whose heading marks are blanks, so that every place in it stays where it is."""
    marks = lambda line: F.regexp_extract(line, r"^(\s{0,3}#{1,6})(?:\s|$)", 1)
    blank = lambda line: F.concat(F.repeat(F.lit(" "), F.length(marks(line))), F.substring(line, F.length(marks(line)) + 1, F.length(line)))
    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), blank), "\n")


def transcript_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK_WORDS) -> DataFrame:
    """key, block, text: the words of a text in blocks of `size`."""
    w = docs.select(key, F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")), " ").alias("w")).where("w[0] <> ''")
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))
    return w.select(key, F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("w", i * size + 1, size), " "))).alias("block", "text"))


def phrase_places(docs: DataFrame, phrases: DataFrame, key: str, phrase: str, anchor: int = 3) -> DataFrame:
    """phrase, key, position, size of each place where all words of a phrase stand. docs: key, w (its words, lower-cased);
    phrases: phrase, w.

    Places of a phrase's first words are found by a join of small rows (no row carries its document's words); only documents
    with such a place are looked at again, for the rest of the phrase."""
    keyed = phrases.where(F.size("w") > 0).select(phrase, F.col("w").alias("_p"), F.least(F.size("w"), F.lit(anchor)).alias("_n"))
    sizes = range(1, anchor + 1)
    hits = reduce(DataFrame.union, [_starts(docs, keyed, key, phrase, n) for n in sizes])
    near = hits.join(keyed.select(phrase, "_p"), phrase).groupBy(key).agg(F.collect_list(F.struct(phrase, "position", "_p")).alias("_hits"))
    looked = docs.join(near, key)
    whole = F.filter("_hits", lambda h: F.slice("w", h["position"] + 1, F.size(h["_p"])) == h["_p"])
    rows = F.transform(whole, lambda h: F.struct(h[phrase].alias(phrase), h["position"].alias("position"), F.size(h["_p"]).alias("size"), F.array_join(F.slice("w", F.greatest(h["position"] - 4, F.lit(0)) + 1, h["position"] + F.size(h["_p"]) + 4 - F.greatest(h["position"] - 4, F.lit(0))), " ").alias("context")))
    return looked.select(key, F.explode(rows).alias("r")).select(F.col(f"r.{phrase}").alias(phrase), key, "r.position", "r.size", "r.context")


def _starts(docs: DataFrame, keyed: DataFrame, key: str, phrase: str, n: int) -> DataFrame:
    """phrase, key, position of the places of the first n words of those phrases that are known by so many. Where there are none such,
    the texts are not read for them."""
    names = [f"_{i}" for i in range(n)]
    grams = F.arrays_zip(*[F.slice("w", F.lit(i + 1), F.size("w")).alias(c) for i, c in enumerate(names)])
    rows = docs.select(key, F.posexplode(grams).alias("position", "g")).select(key, "position", *[F.col(f"g.{c}").alias(c) for c in names])
    firsts = keyed.where(F.col("_n") == n).select(phrase, *[F.get("_p", i).alias(c) for i, c in enumerate(names)])
    return rows.join(firsts, names).select(phrase, key, "position")


def slip_kind(written: Column, heard: Column) -> Column:
    """How a heard word differs from the written one (both lower-cased): same (equal numbers too), number (another one), short-swap
    (both are short words of one class), inflection (irregular plurals too), onset (clipped by up to two letters), piece, near (a
    letter or two) or other."""
    among = lambda names, w: F.when(w.isin(*{*names}), F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), w))
    number = lambda w: F.coalesce(among(UNIT_WORDS, w).cast("long"), F.when(F.substring(w, 1, 1).between("0", "9") & w.rlike("^[0-9]+$"), w.try_cast("long")))
    said, meant = number(heard), number(written)
    irregular = F.coalesce(among(PLURALS, written) == heard, F.lit(False)) | F.coalesce(among(PLURALS, heard) == written, F.lit(False))
    stem = lambda a, b: F.startswith(a, b) & F.substring(a, F.length(b) + 1, F.lit(4)).isin("s", "es", "ed", "d", "ing")
    cut = F.length(written) - F.length(heard)
    short = {w: i for i, g in enumerate(SHORT_WORDS) for w in g}
    swap = F.coalesce(among(short, written) == among(short, heard), F.lit(False))
    return (
        F.when((written == heard) | F.coalesce(said == meant, F.lit(False)), "same").when(F.coalesce(said != meant, F.lit(False)), "number")
        .when(swap, "short-swap").when(stem(written, heard) | stem(heard, written) | irregular, "inflection")
        .when((cut > 0) & (cut <= 2) & (F.length(heard) >= 3) & F.endswith(written, heard), "onset").when((F.length(heard) >= 3) & F.contains(written, heard), "piece")
        .when(similar(written, heard), "near").otherwise("other")
    )
