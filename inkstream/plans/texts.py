"""Queries over manuscripts, phrases, names and seats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstream.functions.text import COUNTED_WORD, WORD, normalized_word, word_count, words
from inkstream.functions.wordclass import PLURALS, UNIT_WORDS
from inkstream.operators import proof, structure
from inkstream.operators.books import chapter_runs
from inkstream.operators.idioms import islands
from inkstream.sources.tables import DROPPED, MODULUS, REPLACED, spread, table

_W = WORD.replace("'", "''")
_TOKENS = f"SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents"


def _places(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", words(F.lower("text")).alias("w"))
    return structure.phrase_places(docs, table(spark, folder, "benchmark").select("item_id", words(F.lower("text")).alias("w")), "doc_id", "item_id")


def phrase_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """How often each benchmark item stands in the documents as a whole, and in how many."""
    return _places(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("doc_id").alias("documents"))


def occurrence_context(spark: SparkSession, folder: str) -> DataFrame:
    """Each place of those items, with four words on either side."""
    return _places(spark, folder).select("item_id", "doc_id", "position", "context")


def occurrence_readings(spark: SparkSession, folder: str) -> DataFrame:
    """How each benchmark item was heard wherever all its words stand (every fifth document was not checked; what was heard follows
    the stand-in's slips), by digest, and whether in one way."""
    docs = table(spark, folder, "documents").select("doc_id", words(F.lower("text")).alias("w"))
    slip = F.pmod(F.col("doc_id") * 31 + F.col("token_index"), F.lit(MODULUS))
    places = _places(spark, folder).select("item_id", "doc_id", F.col("position").alias("token_index"), F.col("size").alias("n_tokens"))
    held = docs.join(places.select("doc_id").distinct(), "doc_id", "left_semi")  # only documents that hold an item are taken apart
    tokens = held.where("doc_id % 5 <> 0").select("doc_id", F.posexplode("w").alias("token_index", "written"))
    alignment = tokens.withColumn("heard", F.when(slip == DROPPED, "").when(slip == REPLACED, "slipped").otherwise(F.col("written")))
    found = proof.readings(places, alignment, ["item_id"])
    spoken = F.count_if(F.col("reading") != "#no-audio").over(Window.partitionBy("item_id"))
    return found.select("item_id", F.md5("reading").alias("reading"), F.length("reading").alias("length"), "count", (spoken <= 1).alias("consistent"))


def glossary_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The 80 most frequent words that are written with a capital three times of four."""
    return structure.name_candidates(table(spark, folder, "documents"), 80)


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and distinct spoken forms (no case, no marks) of each source; only distinct written forms are normalised."""
    docs = table(spark, folder, "documents").select("source", F.explode(words(F.col("text"))).alias("t"))
    forms = docs.groupBy("source", "t").agg(F.count(F.lit(1)).alias("n")).select("source", "n", normalized_word("t").alias("form"))
    return forms.groupBy("source", "form").agg(F.sum("n").alias("n")).groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("forms"))


def sentence_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences, their words and the longest, per language."""
    each = table(spark, folder, "documents").select("lang", F.explode(structure.sentences(F.col("text"))).alias("s")).select("lang", word_count(F.col("s")).cast("long").alias("n")).where("n > 0")
    return each.groupBy("lang").agg(F.count(F.lit(1)).alias("sentences"), F.sum("n").alias("words"), F.max("n").alias("longest"))


def seat_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of turns of the same seat in each conversation, with their words."""
    turns = table(spark, folder, "conversations").withColumn("n", F.size(words(F.col("text"))).cast("long"))
    runs = islands(turns, ["conv_id"], ["turn"], "role").groupBy("conv_id", "island", "role")
    return runs.agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum("n").alias("words"))


def turn_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The ranges of consecutive turns of each role in each conversation, as a guide prints them."""
    rows = table(spark, folder, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), "role").alias("name"), "turn")
    return chapter_runs(rows, "name", "turn")


def lookalikes(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of words of the benchmark that a listener may mix up: a letter apart, two from eight letters on. Words of any
    letters; those within a number of edits have a form in common with that many letters left out."""
    words_of = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{5,}"), 0)).alias("word")
    return structure.lookalike_pairs(table(spark, folder, "benchmark").select(words_of).distinct())


def sentence_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each sentence of every document."""
    return structure.sentence_ranges(spread(table(spark, folder, "documents").select("doc_id", "text")))


def line_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence of every token of a document, with one sentence on either side."""
    return structure.token_lines(spread(table(spark, folder, "documents").select("doc_id", "text")), more=1)


def plain_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of each text without heading marks, and its length, which is the same."""
    text = structure.without_heading_marks(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.md5(text).alias("digest"), F.length(text).alias("length"))


def transcript_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of 90 words: how many letters each has."""
    return structure.transcript_blocks(table(spark, folder, "documents")).select("doc_id", "block", F.length("text").alias("length"))


def slip_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of difference between neighbouring words of the documents, counted."""
    docs = table(spark, folder, "documents").select(words(F.lower("text")).alias("w")).where(F.size("w") > 1)
    n = F.size("w") - 1
    pairs = docs.select(F.inline(F.arrays_zip(F.slice("w", F.lit(1), n).alias("a"), F.slice("w", F.lit(2), n).alias("b"))))
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("kind", structure.slip_kind(F.col("a"), F.col("b"))).groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"))


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of every document by its headings."""
    return structure.split_chapters(table(spark, folder, "documents"))


def dialogue(spark: SparkSession, folder: str) -> DataFrame:
    """Quoted passages of conversations and their share of the text."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", structure.dialogue(F.col("text")).alias("d"))
    return rows.groupBy("conv_id").agg(F.sum(F.size("d")).alias("passages"))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a text, dealt over the cores: matching is work for Python, whatever the splits of the file."""
    return spread(table(spark, folder, "documents").where("text is not null").select("doc_id", "text"))


def align_pickups(spark: SparkSession, folder: str) -> DataFrame:
    """What the stand-in reading of every document got wrong."""
    return proof.with_ids(proof.align(proof.stand_in_transcript(_docs(spark, folder))), "doc_id")


def _read(spark: SparkSession, folder: str) -> DataFrame:
    """The stand-in readings, each third document with five seconds of silence before its tenth word."""
    docs = _docs(spark, folder)
    late = lambda w: F.when(w["start"] >= 4, 5.0).otherwise(0.0)
    moved = F.transform("heard", lambda w: F.struct(w["text"].alias("text"), (w["start"] + late(w)).alias("start"), (w["end"] + late(w)).alias("end"), w["confidence"].alias("confidence")))
    heard = F.when(F.col("doc_id") % 3 == 0, moved).otherwise(F.col("heard"))
    return proof.stand_in_transcript(docs, "doc_id", "text", True).withColumns({"heard": heard, "duration": F.lit(None).cast("double")})


def chapter_check(spark: SparkSession, folder: str) -> DataFrame:
    """The whole check of every document (recursive matching: no SQL)."""
    return proof.checked(_read(spark, folder), suppressed=["added"])


def token_states(spark: SparkSession, folder: str) -> DataFrame:
    """How many tokens of each document were matched, read otherwise or missed (recursive matching: no SQL)."""
    rows = proof.token_alignment(proof.stand_in_transcript(_docs(spark, folder)))
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return rows.groupBy("doc_id").agg(*map(count, ("matched", "different", "missing")))


def proof_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Pickups by kind after suppression and merging."""
    found = proof.unsuppressed(proof.align(proof.stand_in_transcript(_docs(spark, folder))), ["added"])
    return proof.merged(found, ["doc_id"], proof.MERGE_WINDOWS["normal"], ("i0",)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("t_end") - F.col("t_start")), 3).alias("seconds"))


def eval_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and recall of the found skips and substitutions against the slips that were made."""
    docs = _docs(spark, folder)
    made = docs.select("doc_id", F.posexplode(words(F.col("text")))).select("doc_id", F.col("pos").alias("token"), F.pmod(F.col("doc_id") * 31 + F.col("pos"), F.lit(97)).alias("slip")).where("slip < 2")
    runs = proof.align(proof.stand_in_transcript(docs)).where("i1 > i0")
    found = runs.select("doc_id", F.explode(F.sequence("i0", F.col("i1") - 1)).alias("token"))
    return proof.scores(found, made, ["doc_id", "token"])


def quality_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and recall of a plain length rule against the labels: the scorer on a table that SQL can read."""
    docs = table(spark, folder, "documents").where(F.size(words(F.col("text"))) >= 100).select("doc_id")
    return proof.scores(docs, table(spark, folder, "labels").where("quality = 1").select("doc_id"), ["doc_id"])


def folded_pickups(spark: SparkSession, folder: str) -> DataFrame:
    """The same check when numbers match however they are spoken (recursive matching: no SQL)."""
    return proof.align(proof.stand_in_transcript(_docs(spark, folder)), fold=True)


def retake_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn of a conversation against the turn before it, taken as its retake."""
    turns = table(spark, folder, "conversations")
    said = F.transform(words(F.col("text")), lambda w: F.struct(w.alias("text"), F.lit(None).cast("double").alias("confidence")))
    before = F.lag(said).over(Window.partitionBy("conv_id").orderBy("turn"))
    return proof.verified(turns.select("conv_id", "turn", "text", before.alias("heard"))).select("conv_id", "turn", "status", "expected_excerpt", "heard_excerpt")


QUERIES = {
    f.__name__: f
    for f in (
        phrase_occurrences, occurrence_context, occurrence_readings, glossary_candidates, vocabulary, sentence_stats, sentence_ranges, line_ranges, plain_texts, transcript_blocks, slip_kinds, seat_runs, turn_runs, lookalikes,
        chapters, dialogue, align_pickups, chapter_check, token_states, proof_summary, eval_scores, quality_agreement, folded_pickups, retake_checks,
    )
}

_PLACES = f"""t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_W}') AS w FROM documents),
    o AS (SELECT item_id, regexp_extract_all(lower(text), '{_W}') AS p FROM benchmark),
    g AS (SELECT doc_id, unnest(w) AS x, unnest(list_concat(w[2:], [NULL])) AS y, unnest(list_concat(w[3:], [NULL, NULL])) AS z, unnest(range(1, len(w) + 1)) AS i FROM t),
    c AS (SELECT item_id, doc_id, i FROM g JOIN o ON x = p[1] AND (len(p) < 2 OR y = p[2]) AND (len(p) < 3 OR z = p[3])),
    hit AS (SELECT item_id, doc_id, i, w, p FROM c JOIN t USING (doc_id) JOIN o USING (item_id) WHERE w[i:i + len(p) - 1] = p)"""
_GAP = structure.TOKEN_AND_GAP.replace("'", "''")
_COUNTED = COUNTED_WORD.replace("'", "''")
_SENTENCES = f"""tg AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{_GAP}', 1), lambda x: lower(x)) AS w, regexp_extract_all(coalesce(text, ''), '{_GAP}', 2) AS g FROM documents),
    en AS (SELECT doc_id, list_filter(range(len(w)), lambda i: regexp_matches(g[i + 1], '[\\n!?。！？]') OR (contains(g[i + 1], '.') AND NOT list_contains([{', '.join(f"'{x}'" for x in structure.ABBREVIATIONS)}], w[i + 1])) OR i = len(w) - 1) AS e FROM tg WHERE len(w) > 0),
    se AS (SELECT doc_id, unnest(range(len(e))) AS k, unnest(list_concat([-1], e)[:len(e)]) AS p, unnest(e) AS z FROM en),
    sr AS (SELECT doc_id, CAST(k AS INT) AS sentence, CAST(p + 1 AS INT) AS "first", CAST(z AS INT) AS "last" FROM se)"""
_HEAD = structure.HEADING.replace("'", "''")
_SWAP = " OR ".join("(a IN ({0}) AND b IN ({0}))".format(", ".join(f"'{x}'" for x in g)) for g in structure.SHORT_WORDS)
_NUMBER = "coalesce(CASE {0} " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in UNIT_WORDS.items()) + " END, CASE WHEN regexp_matches({0}, '^[0-9]+$') THEN TRY_CAST({0} AS BIGINT) END)"
_NUMBERS = f"coalesce({_NUMBER.format('a')} {{0}} {_NUMBER.format('b')}, false)"
_PLURAL = " OR ".join(f"(a = '{x}' AND b = '{y}') OR (a = '{y}' AND b = '{x}')" for x, y in PLURALS.items())
_STEM = " OR ".join(f"a = b || '{x}' OR b = a || '{x}'" for x in ("s", "es", "ed", "d", "ing"))
ORACLES = {
    "phrase_occurrences": f"WITH {_PLACES} SELECT item_id, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM hit GROUP BY ALL",
    "occurrence_context": f"WITH {_PLACES} SELECT item_id, doc_id, CAST(i - 1 AS INT) AS position, array_to_string(w[greatest(i - 4, 1):i + len(p) + 3], ' ') AS context FROM hit",
    "occurrence_readings": f"""WITH {_PLACES},
        l AS (SELECT item_id, doc_id, list_filter(list_transform(range(len(p)), lambda k: CASE (doc_id * 31 + i - 1 + k) % {MODULUS} WHEN {DROPPED} THEN '' WHEN {REPLACED} THEN 'slipped' ELSE p[k + 1] END), lambda x: x <> '') AS l FROM hit),
        o1 AS (SELECT item_id, doc_id, list_filter(l, lambda x, n: n = 1 OR l[n - 1] <> x) AS l FROM l),
        r AS (SELECT item_id, CASE WHEN doc_id % 5 = 0 THEN '#no-audio' WHEN len(l) = 0 THEN '#silent' ELSE
              array_to_string(list_filter(flatten(list_transform(l, lambda t: list_transform(regexp_split_to_array(replace(t, '’', ''''), '[\\s‐-―\\-]+'), lambda p: trim(regexp_replace(lower(strip_accents(p)), '[^\\p{{L}}\\p{{N}}'']', '', 'g'), '''')))), lambda p: p <> ''), ' ') END AS reading FROM o1),
        k AS (SELECT item_id, reading, count(*) AS "count" FROM r GROUP BY ALL)
        SELECT item_id, md5(reading) AS reading, CAST(length(reading) AS INT) AS length, "count", count(*) FILTER (WHERE reading <> '#no-audio') OVER (PARTITION BY item_id) <= 1 AS consistent FROM k""",
    "sentence_stats": f"""WITH s AS (SELECT lang, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?。！？…])[\\s"”’)]+|\\n+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents),
        n AS (SELECT lang, len(regexp_extract_all(s, '{_COUNTED}')) AS n FROM s) SELECT lang, count(*) AS sentences, CAST(sum(n) AS BIGINT) AS words, max(n) AS longest FROM n WHERE n > 0 GROUP BY lang""",
    "sentence_ranges": f"WITH {_SENTENCES} SELECT * FROM sr",
    "line_ranges": f"""WITH {_SENTENCES}, wd AS (SELECT *, min("first") OVER o AS a, max("last") OVER o AS z FROM sr WINDOW o AS (PARTITION BY doc_id ORDER BY sentence ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
        SELECT doc_id, CAST(unnest(range("first", "last" + 1)) AS INT) AS token, a AS "first", z AS "last" FROM wd""",
    "plain_texts": """WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: repeat(' ', length(regexp_extract(x, '^(\\s{0,3}#{1,6})(?:\\s|$)', 1))) || x[length(regexp_extract(x, '^(\\s{0,3}#{1,6})(?:\\s|$)', 1)) + 1:]) AS l FROM documents)
        SELECT doc_id, md5(array_to_string(l, chr(10))) AS digest, CAST(length(array_to_string(l, chr(10))) AS INT) AS length FROM l""",
    "transcript_blocks": """WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' ') AS w FROM documents), b AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w WHERE w[1] <> '')
        SELECT doc_id, CAST(i // 90 AS INT) AS block, CAST(sum(length(x)) + count(*) - 1 AS INT) AS length FROM b GROUP BY ALL""",
    "slip_kinds": f"""WITH t AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '{_W}') AS w FROM documents), x AS (SELECT unnest(w) AS a, unnest(list_concat(w[2:], [NULL])) AS b FROM t), p AS (SELECT a, b, count(*) AS n FROM x WHERE b IS NOT NULL GROUP BY ALL),
        k AS (SELECT n, CASE WHEN a = b OR {_NUMBERS.format('=')} THEN 'same' WHEN {_NUMBERS.format('<>')} THEN 'number' WHEN {_SWAP} THEN 'short-swap' WHEN {_STEM} OR {_PLURAL} THEN 'inflection' WHEN length(a) - length(b) BETWEEN 1 AND 2 AND length(b) >= 3 AND suffix(a, b) THEN 'onset' WHEN length(b) >= 3 AND contains(a, b) THEN 'piece'
              WHEN greatest(length(a), length(b)) >= 5 AND levenshtein(translate(a, 'àáâãäåæçèéêëìíîïñòóôöøùúûüýÿœß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#%&'), translate(b, 'àáâãäåæçèéêëìíîïñòóôöøùúûüýÿœß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#%&')) <= CASE WHEN greatest(length(a), length(b)) >= 8 THEN 2 ELSE 1 END THEN 'near' ELSE 'other' END AS kind FROM p) SELECT kind, CAST(sum(n) AS BIGINT) AS n, count(*) AS pairs FROM k GROUP BY kind""",
    "chapters": f"""WITH l AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n') AS l FROM documents), r AS (SELECT doc_id, unnest(l) AS t, unnest(range(len(l))) AS line FROM l),
        h AS (SELECT *, regexp_matches(t, '{_HEAD}') AS heading, trim(t) = '' AS blank FROM r),
        b AS (SELECT *, heading AND NOT coalesce(first_value(CASE WHEN NOT blank THEN heading END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), true) AS starts FROM h),
        c AS (SELECT *, CAST(sum(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS INT) AS chapter FROM b),
        g AS (SELECT doc_id, chapter, max(CASE WHEN starts THEN trim(regexp_replace(t, '^\\s*#+\\s*', '')) END) AS title, CAST(sum(CASE WHEN starts THEN 0 ELSE len(regexp_extract_all(t, '{_COUNTED}')) END) AS BIGINT) AS words, CAST(min(line) AS INT) AS first_line, CAST(max(line) AS INT) AS last_line FROM c GROUP BY doc_id, chapter)
        SELECT *, round(words / 9300 * 60, 6) AS minutes, round(words / 9300 * 60, 6) > 120 AS over_120 FROM g WHERE chapter > 0 OR words > 0 OR (first_line = 0 AND title IS NULL)""",
    "dialogue": """SELECT conv_id, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '"([^"\\n]+)"|“([^”\\n]+)”'))) AS BIGINT) AS passages FROM conversations GROUP BY conv_id""",
    "glossary_candidates": f"""WITH t AS (SELECT unnest(w) AS t FROM ({_TOKENS})),
        v AS (SELECT lower(t) AS word, t, count(*) AS n, regexp_matches(t, '^\\p{{Lu}}') AS upper FROM t GROUP BY ALL),
        k AS (SELECT word, CAST(sum(n) AS BIGINT) AS frequency, CAST(coalesce(sum(n) FILTER (WHERE upper), 0) AS BIGINT) AS capitalised, count(*) AS variants FROM v GROUP BY word),
        r AS (SELECT word, t, row_number() OVER (PARTITION BY word ORDER BY n DESC, t) AS k FROM v)
        SELECT word, r.t AS spelling, frequency, capitalised, variants FROM k JOIN r USING (word)
        WHERE k = 1 AND frequency >= 3 AND capitalised >= 0.75 * frequency ORDER BY frequency DESC, word LIMIT 80""",
    "vocabulary": f"""WITH t AS (SELECT source, unnest(w) AS t FROM ({_TOKENS}))
        SELECT source, count(*) AS tokens, count(DISTINCT regexp_replace(lower(strip_accents(replace(t, '’', ''''))), '[^\\p{{L}}\\p{{N}}'']', '', 'g')) AS forms FROM t GROUP BY source""",
    "seat_runs": f"""WITH t AS (SELECT conv_id, turn, role, len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS n FROM conversations),
        f AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS turned FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        i AS (SELECT *, CAST(sum(turned) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM f)
        SELECT conv_id, island, role, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(n) AS BIGINT) AS words FROM i GROUP BY conv_id, island, role""",
    "turn_runs": """WITH r AS (SELECT DISTINCT conv_id || ':' || role AS name, turn FROM conversations),
        i AS (SELECT *, turn - row_number() OVER (PARTITION BY name ORDER BY turn) AS run FROM r)
        SELECT name, min(turn) AS "first", max(turn) AS "last" FROM i GROUP BY name, run""",
    "lookalikes": """WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}{5,}')) AS word FROM benchmark)
        SELECT a.word, b.word AS other FROM n a JOIN n b ON a.word < b.word AND abs(length(a.word) - length(b.word)) <= 2
        WHERE levenshtein(translate(a.word, 'àáâãäåæçèéêëìíîïñòóôöøùúûüýÿœß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#%&'), translate(b.word, 'àáâãäåæçèéêëìíîïñòóôöøùúûüýÿœß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#%&')) <= CASE WHEN greatest(length(a.word), length(b.word)) >= 8 THEN 2 ELSE 1 END""",
    "quality_agreement": f"""WITH f AS (SELECT DISTINCT doc_id FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '{_W}')) >= 100),
        l AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
        j AS (SELECT f.doc_id AS f, l.doc_id AS l FROM f FULL JOIN l ON f.doc_id = l.doc_id),
        c AS (SELECT count(*) FILTER (WHERE f IS NOT NULL AND l IS NOT NULL) AS true_positives, count(*) FILTER (WHERE l IS NULL) AS false_positives, count(*) FILTER (WHERE f IS NULL) AS false_negatives FROM j)
        SELECT *, CASE WHEN true_positives + false_positives = 0 THEN 1.0 ELSE true_positives / (true_positives + false_positives) END AS precision,
               CASE WHEN true_positives + false_negatives = 0 THEN 1.0 ELSE true_positives / (true_positives + false_negatives) END AS recall FROM c""",
}
