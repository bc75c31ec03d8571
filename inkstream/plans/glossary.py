"""Queries of the glossary: documents are the manuscript, the supplier and part tables stand in for entries made by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import respell
from inkstream.operators import glossary as G
from inkstream.operators import links
from inkstream.sources.tables import table

COMMON = ("the", "and", "of", "to", "a", "in", "is", "it", "that", "was", "der", "die", "und", "le", "la", "de", "el", "que")


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return G.tokens(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def name_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The 80 most frequent name candidates of all documents, with their reasons and score."""
    return G.candidates(_tokens(spark, folder), list(COMMON))


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """A glossary: the first words of parts, as they were entered."""
    words = table(spark, folder, "part").select(F.regexp_extract("p_name", r"^(\S+)", 1).alias("spelling"), "p_partkey", "p_size")
    rows = words.groupBy("spelling").agg(F.min("p_partkey").alias("k"), F.count(F.lit(1)).alias("frequency"), F.min("p_size").alias("size"))
    return rows.select("spelling", "frequency", F.when(F.col("k") % 2 == 0, "user").otherwise("auto").alias("source"), F.when(F.col("k") % 3 == 0, F.lower("spelling")).alias("respell"), F.when(F.col("k") % 5 == 0, "soft").alias("note"))


def _found(spark: SparkSession, folder: str) -> DataFrame:
    """A new scan: last words of parts."""
    return table(spark, folder, "part").select(F.initcap(F.regexp_extract("p_name", r"(\S+)$", 1)).alias("spelling")).groupBy("spelling").agg(F.count(F.lit(1)).alias("frequency"))


def glossary_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """The glossary after a new scan."""
    return G.replaced(_entries(spark, folder), _found(spark, folder))


def glossary_rename(spark: SparkSession, folder: str) -> DataFrame:
    """The glossary after every entry was renamed to the first four letters of its spelling."""
    entries = _entries(spark, folder)
    changes = entries.select(F.lower(F.trim("spelling")).alias("word"), F.substring("spelling", 1, 2).alias("spelling")).where(F.length("word") % 2 == 0)
    return G.renamed(entries, changes)


def candidate_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of spellings; those that differ in punctuation and case alone are numbered."""
    words = table(spark, folder, "supplier").select(F.regexp_replace(F.substring("s_name", 1, 17), "0", "-").alias("spelling"), "s_suppkey")
    return G.with_ids(words, ["s_suppkey"]).select("s_suppkey", "spelling", "id")


def glossary_respells(spark: SparkSession, folder: str) -> DataFrame:
    lexicon = table(spark, folder, "part").select(F.lower(F.regexp_extract("p_name", r"(\S+)$", 1)).alias("word")).distinct().withColumn("respell", F.upper("word"))
    return G.respelt(_entries(spark, folder), lexicon).select("word", "respell", "filled")


def guide_rows(spark: SparkSession, folder: str) -> DataFrame:
    """How often the 80 candidates stand in the documents, and in how many."""
    names = name_reasons(spark, folder).select("spelling")
    return G.guide_rows(names.withColumn("spelling", G.canonical(F.col("spelling"))), _tokens(spark, folder), "doc_id")


def spelled_syllables(spark: SparkSession, folder: str) -> DataFrame:
    """Syllables that the spelling of each part's words has, and whether a made-up dictionary says otherwise."""
    words = table(spark, folder, "part").select(F.explode(F.split("p_name", r"\s+")).alias("word")).distinct()
    phones = F.regexp_replace("word", "[aeiou]", "V1 ")
    return words.select("word", G.spelled_syllables(F.col("word")).alias("syllables"), G.said_unlike_spelling(F.col("word"), phones).alias("unlike"))


def pronunciation_states(spark: SparkSession, folder: str) -> DataFrame:
    """States of names (parts) in chapters (orders), by what was heard of them (ship modes by flags)."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("chapter_id"), (F.col("l_partkey") % 4).alias("name"), F.when(F.col("l_partkey") % 4 < 3, "x").alias("respell"),
        F.when(F.col("l_returnflag") == "N", F.lit(None)).when(F.col("l_returnflag") == "A", F.lit("")).otherwise(F.when(F.col("l_linenumber") % 2 == 0, "LEE").otherwise("lee-o")).alias("heard"),
    )
    return G.pronunciation_states(rows, ["chapter_id", "name"])


def respellings(spark: SparkSession, folder: str) -> DataFrame:
    """How the words of parts' names are said, by a stand-in dictionary that says each letter and stresses the first vowel (cut by
    looking ahead: no SQL)."""
    names = table(spark, folder, "part").select(F.col("p_name").alias("spelling")).distinct()
    words = names.select(F.explode(F.split(F.lower("spelling"), r"\s+")).alias("word")).distinct()
    says = F.create_map(*[F.lit(x) for pair in zip("abcdefghijklmnopqrstuvwxyz", "AE B K D EH F G HH IH JH K L M N OW P K R S T AH V W K Y Z".split()) for x in pair])
    letters = F.filter(F.split("word", ""), lambda c: c.rlike("[a-z]"))
    first = F.array_position(F.transform(letters, lambda c: c.rlike("[aeiou]")), True)
    phone = lambda c, i: F.concat(F.try_element_at(says, c), F.when(c.rlike("[aeiou]"), F.when(i + 1 == first, "1").otherwise("0")).otherwise(""))
    lexicon = words.select("word", F.array_join(F.transform(letters, phone), " ").alias("phones")).where("phones <> ''")
    return respell.suggested(names, lexicon)


def _names_of_turns(spark: SparkSession, folder: str) -> DataFrame:
    """A stand-in glossary: the first word of every turn, and its first two words."""
    text = table(spark, folder, "conversations").select("text")
    one, two = (F.regexp_extract("text", p, 0) for p in (r"^[\p{L}\p{N}]+", r"^[\p{L}\p{N}]+ [\p{L}\p{N}]+"))
    found = text.select(F.explode(F.array(one, two)).alias("spelling")).where("spelling <> ''").distinct()
    return found.select(F.lower("spelling").alias("id"), "spelling", F.lit("auto").alias("source")).groupBy("id", "source").agg(F.min("spelling").alias("spelling"))


def glossary_links(spark: SparkSession, folder: str) -> DataFrame:
    """The turns of conversations parted at names: how many pieces and names, and where these begin."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    pieces = links.linked(turns, _names_of_turns(spark, folder), ["conv_id", "turn"])
    named = F.col("glossary_id").isNotNull()
    return pieces.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("pieces"), F.count_if(named).alias("names"), F.coalesce(F.sum(F.when(named, F.col("start") * F.length("glossary_id"))), F.lit(0)).alias("places"))


QUERIES = {f.__name__: f for f in (respellings, glossary_links, name_reasons, glossary_rebuild, glossary_rename, candidate_ids, glossary_respells, guide_rows, spelled_syllables, pronunciation_states)}

_N = G.NAME_TOKEN.replace("'", "''")
_COMMON = ", ".join(f"'{w}'" for w in COMMON)
_CONTEXT = ", ".join(f"'{w}'" for w in G.NAME_CONTEXT)
_CANON = "lower(regexp_replace(regexp_replace({0}, '(?i)[''’]s$', ''), '[‐‑‒–—]', '-', 'g'))"
_TOKENS = f"""d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[.!?。！？:：—–\\n]+(\\s|$)|\\n', chr(1) || '\\1', 'g') AS t FROM documents),
    pc AS (SELECT doc_id, unnest(string_split(t, chr(1))) AS p FROM d), rw AS (SELECT doc_id, regexp_extract_all(p, '{_N}') AS raws FROM pc),
    ix AS (SELECT doc_id, raws, unnest(range(1, len(raws) + 1)) AS i FROM rw),
    tk AS (SELECT doc_id, raws[i] AS raw, {_CANON.format('raws[i]')} AS word, regexp_matches(raws[i], '^\\p{{Lu}}') AS cap, i = 1 AS starts,
                  CASE WHEN i > 1 THEN {_CANON.format('raws[i - 1]')} END AS bef, {_CANON.format('raws[i + 1]')} AS aft FROM ix)"""
_CANDIDATES = f"""{_TOKENS}, sp AS (SELECT word, raw, cap, count(*) AS n, count(*) FILTER (WHERE NOT starts) AS inside,
        count(*) FILTER (WHERE cap AND NOT contains(word, '''') AND (coalesce(bef IN ({_CONTEXT}), false) OR coalesce(aft IN ({_CONTEXT}), false))) AS named,
        bool_or(length(raw) > 1 AND raw = upper(raw) AND raw <> lower(raw)) AS up FROM tk GROUP BY word, raw, cap),
    wd AS (SELECT word, sum(n) AS frequency, coalesce(sum(n) FILTER (WHERE cap), 0) AS capitals, coalesce(sum(inside) FILTER (WHERE cap), 0) AS inside, sum(named) AS named, coalesce(sum(n) FILTER (WHERE up), 0) AS acronyms,
                  bool_or(regexp_matches(raw, '[^\\x00-\\x7f]')) AS odd, arg_min(raw, (-n, NOT cap, raw)) AS spelling FROM sp GROUP BY word),
    fl AS (SELECT *, word IN ({_COMMON}) AS known, regexp_replace(word, '[^a-z]', '', 'g') AS l, regexp_matches(word, '{G.UNUSUAL}') OR odd AS unusual FROM wd),
    ns AS (SELECT *, length(l) >= 6 AND len(list_distinct(string_split(l, ''))) <= 3 AND regexp_matches(l, '^[aeiouhywm]+$') AS noise FROM fl),
    nm AS (SELECT *, NOT noise AND (named > 0 OR (NOT known AND capitals > 0)) AS name FROM ns),
    ls AS (SELECT *, [CASE WHEN name AND inside > 0 THEN 'capitalized' END, CASE WHEN name AND capitals >= 3 THEN 'repeated-capitalized' END, CASE WHEN named > 0 THEN 'name-pattern' END, CASE WHEN NOT known THEN 'uncommon' END, CASE WHEN unusual THEN 'unusual-spelling' END] AS r,
                  CAST((name AND inside > 0) AS INT) * 3 + CAST((name AND capitals >= 3) AS INT) * 2 + CAST(named > 0 AS INT) * 5 + CAST(NOT known AS INT) + CAST(unusual AS INT) * 4 AS score
           FROM nm WHERE name OR (NOT known AND NOT noise AND (unusual OR acronyms > 0))),
    ca AS (SELECT spelling, word, CAST(frequency AS BIGINT) AS frequency, array_to_string(list_filter(r, lambda x: x IS NOT NULL), ',') AS reasons, score FROM ls ORDER BY frequency DESC, score DESC, word LIMIT 80)"""
_ENTRIES = """e0 AS (SELECT regexp_extract(p_name, '^(\\S+)', 1) AS spelling, min(p_partkey) AS k, count(*) AS frequency FROM part GROUP BY 1),
    en AS (SELECT spelling, lower(trim(spelling)) AS word, frequency, CASE WHEN k % 2 = 0 THEN 'user' ELSE 'auto' END AS source, CASE WHEN k % 3 = 0 THEN lower(spelling) END AS respell, CASE WHEN k % 5 = 0 THEN 'soft' END AS note FROM e0)"""
ORACLES = {
    "glossary_links": """
        WITH RECURSIVE g AS (SELECT DISTINCT lower(w) AS word FROM (SELECT regexp_extract(text, '^[\\p{L}\\p{N}]+') AS w FROM conversations UNION ALL SELECT regexp_extract(text, '^[\\p{L}\\p{N}]+ [\\p{L}\\p{N}]+') FROM conversations) WHERE w <> ''),
        e AS (SELECT word, regexp_extract(word, '^[\\p{L}\\p{N}]+') AS first, length(word) AS n FROM g),
        t AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations),
        i AS (SELECT conv_id, turn, t, unnest(range(1, length(t) + 1)) AS i FROM t),
        s AS (SELECT *, regexp_extract(substr(t, i), '^[\\p{L}\\p{N}]+') AS first FROM i WHERE regexp_matches(substr(t, i, 1), '[\\p{L}\\p{N}]') AND (i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[\\p{L}\\p{N}]'))),
        m AS (SELECT conv_id, turn, i - 1 AS a, i - 1 + n AS z, n FROM s JOIN e USING (first) WHERE substr(t, i, n) = word AND NOT regexp_matches(substr(t, i + n, 1), '[\\p{L}\\p{N}]')),
        b AS (SELECT conv_id, turn, a, max(z) AS z, max(n) AS n FROM m GROUP BY ALL),
        k AS (SELECT p.*, (SELECT min(q.a) FROM b q WHERE q.conv_id = p.conv_id AND q.turn = p.turn AND q.a >= p.z) AS next FROM b p),
        c AS (SELECT conv_id, turn, a, z, n, next FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY a) AS r FROM k) WHERE r = 1
              UNION ALL SELECT k.conv_id, k.turn, k.a, k.z, k.n, k.next FROM c JOIN k ON k.conv_id = c.conv_id AND k.turn = c.turn AND k.a = c.next),
        o AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY conv_id, turn ORDER BY a), 0) AS before, next IS NULL AS last FROM c),
        p AS (SELECT conv_id, turn, count(*) AS names, sum(a * n) AS places, sum(CAST(a > before AS INT)) AS gaps, max(z) AS z FROM o GROUP BY ALL)
        SELECT t.conv_id, t.turn, CAST(coalesce(names + gaps + CAST(length(t) > z AS INT), 1) AS BIGINT) AS pieces, coalesce(names, 0) AS names, CAST(coalesce(places, 0) AS BIGINT) AS places FROM t LEFT JOIN p USING (conv_id, turn)""",
    "name_reasons": f"WITH {_CANDIDATES} SELECT * FROM ca",
    "guide_rows": f"""WITH {_CANDIDATES}, ch AS (SELECT word, doc_id, count(*) AS n FROM tk GROUP BY ALL), nn AS (SELECT {_CANON.format('spelling')} AS w FROM ca)
        SELECT w AS word, w AS spelling, CAST(coalesce(sum(n), 0) AS BIGINT) AS "count", count(doc_id) AS chapters FROM nn LEFT JOIN ch ON w = word GROUP BY w""",
    "glossary_rebuild": f"""WITH {_ENTRIES}, h AS (SELECT * FROM en WHERE source = 'user' OR respell IS NOT NULL OR note IS NOT NULL),
        f AS (SELECT regexp_extract(p_name, '(\\S+)$', 1) AS w, count(*) AS n FROM part GROUP BY 1), g AS (SELECT lower(w) AS word, upper(w[1]) || lower(w[2:]) AS spelling, n AS frequency FROM f)
        SELECT coalesce(h.word, g.word) AS word, coalesce(h.spelling, g.spelling) AS spelling, coalesce(g.frequency, h.frequency) AS frequency, coalesce(source, 'auto') AS source FROM h FULL JOIN g ON h.word = g.word""",
    "glossary_rename": f"""WITH {_ENTRIES}, r AS (SELECT CASE WHEN length(word) % 2 = 0 THEN spelling[1:2] ELSE spelling END AS spelling, frequency, CASE WHEN length(word) % 2 = 0 THEN 'user' ELSE source END AS source FROM en)
        SELECT lower(trim(spelling)) AS word, arg_min(trim(spelling), (source <> 'user', -frequency, spelling)) AS spelling, CAST(sum(frequency) AS BIGINT) AS frequency, max(source) AS source FROM r GROUP BY 1""",
    "candidate_ids": """WITH s AS (SELECT s_suppkey, replace(s_name[1:17], '0', '-') AS spelling FROM supplier), g AS (SELECT *, regexp_replace(regexp_replace(lower(spelling), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')[1:48] AS slug FROM s),
        n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY s_suppkey) AS n FROM g) SELECT s_suppkey, spelling, 'auto-' || slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id FROM n""",
    "glossary_respells": f"""WITH {_ENTRIES}, l AS (SELECT DISTINCT lower(regexp_extract(p_name, '(\\S+)$', 1)) AS w FROM part)
        SELECT word, coalesce(respell, upper(w)) AS respell, CASE WHEN respell IS NOT NULL THEN 'no' WHEN w IS NULL THEN 'unknown' ELSE 'yes' END AS filled FROM en LEFT JOIN l ON w = word""",
    "spelled_syllables": """WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(p_name, '\\s+')) AS word FROM part), s AS (SELECT word, CAST(greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(lower(word), '[^a-z]', '', 'g'), '(?:es|e)$', ''), '[aeiouy]+'))) AS INT) AS syllables,
        len(regexp_extract_all(word, '[aeiou]')) AS spoken FROM w) SELECT word, syllables, spoken > 0 AND NOT regexp_matches(word, '[-'']') AND syllables <> spoken AS unlike FROM s""",
    "pronunciation_states": """WITH r AS (SELECT l_orderkey AS chapter_id, l_partkey % 4 AS name, CASE WHEN l_partkey % 4 < 3 THEN 'x' END AS respell, CASE l_returnflag WHEN 'N' THEN NULL WHEN 'A' THEN '' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'LEE' ELSE 'lee-o' END END AS heard FROM lineitem)
        SELECT chapter_id, name, CASE WHEN max(respell) IS NULL THEN 'undecided' WHEN count(heard) = 0 THEN 'unverified' WHEN count(*) FILTER (WHERE heard <> '') = 0 THEN 'unheard'
               WHEN count(DISTINCT lower(heard)) FILTER (WHERE heard <> '') > 1 THEN 'inconsistent' ELSE 'matches' END AS state FROM r GROUP BY ALL""",
}
