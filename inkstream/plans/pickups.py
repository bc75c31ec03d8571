"""Queries over pickups, chapters and books (line items, orders and customers stand in for them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstream.functions.levels import traffic_light
from inkstream.operators import books, proof
from inkstream.operators.idioms import as_of
from inkstream.sources.tables import CHAPTERS_SQL, PICKUPS_SQL, TOLD_SQL, chapters, dealt, pickups, table, told_pickups


def pickup_summary(spark: SparkSession, folder: str) -> DataFrame:
    return books.pickup_summary(pickups(spark, folder), ["chapter_id"])


def repeated_words(spark: SparkSession, folder: str) -> DataFrame:
    return books.repeated(told_pickups(spark, folder), "chapter_id")


def worklist(spark: SparkSession, folder: str) -> DataFrame:
    """The open pickups of a book, in the order of chapters and times."""
    rows = books.worklist(told_pickups(spark, folder), chapters(spark, folder), "chapter_id", "book_id")
    return rows.select("book_id", "at", "chapter_id", "id", "expected")


def unchecked_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters with a recording of which no pickup is settled."""
    rows = chapters(spark, folder).withColumn("has_audio", F.col("status") != "O")
    return books.unchecked(rows, pickups(spark, folder).where("status = 'done'"), "chapter_id", "has_audio").select("book_id", "chapter_id")


def book_progress(spark: SparkSession, folder: str) -> DataFrame:
    opened = pickups(spark, folder).groupBy("chapter_id").agg(F.count_if(F.col("status") == "open").alias("open"))
    rows = chapters(spark, folder).join(opened, "chapter_id", "left").select("book_id", F.col("words"), (F.col("status") != "O").alias("has_audio"), F.coalesce("open", F.lit(0)).alias("open"))
    return books.book_progress(rows, "book_id")


def pickup_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Pickups of a chapter that follow each other within 14 days become one, but not across a pause."""
    return proof.merged(told_pickups(spark, folder), ["chapter_id"], 14.0, ("id",))


def packet_clips(spark: SparkSession, folder: str) -> DataFrame:
    """What a packet plays: padded pickups, joined up to 60 days."""
    return books.clips(told_pickups(spark, folder), ["chapter_id"], 2.0, 60.0, ties=("id",))


def merge_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of two copies of the catalogue: one lacks each 7th, the other each 5th, and every 3rd was edited."""
    rows = chapters(spark, folder)
    mine = rows.where("chapter_id % 7 <> 0")
    edited = F.when(F.col("chapter_id") % 3 == 0, F.lit("F")).otherwise(F.col("status"))
    later = F.when(F.col("chapter_id") % 2 == 0, F.col("updated_at") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("updated_at"))
    theirs = rows.where("chapter_id % 5 <> 0").withColumns({"status": edited, "updated_at": later})
    return books.merge_plan(mine, theirs, "chapter_id", "status", "updated_at").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def carry_over(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions of an earlier check (odd lines) given to a later one (even lines): by id, else the nearest of equal chapter and kind
    that is left."""
    rows = pickups(spark, folder).select("chapter_id", "line", "kind", "status", "word_id", F.col("t_start").cast("double").alias("t_start"))
    number = F.row_number().over(Window.partitionBy("chapter_id").orderBy("line", "word_id", "t_start"))
    first = F.row_number().over(Window.partitionBy("chapter_id", "line").orderBy("word_id", "t_start")) == 1
    old = dealt(rows.where("line % 2 = 1"), "chapter_id").withColumn("id", F.when(first, F.col("line")).otherwise(1000 + number)).select("chapter_id", "kind", "id", "t_start", "status")
    known = (F.col("word_id") % 3 == 0) & first
    fresh = dealt(rows.where("line % 2 = 0"), "chapter_id").withColumn("id", F.when(known, F.col("line") - 1).otherwise(100 + number)).select("chapter_id", "kind", "id", "t_start")
    return proof.preserved(fresh, old, ["chapter_id"], ["kind"], "t_start", ["status"], "id")


def asof_seat(spark: SparkSession, folder: str) -> DataFrame:
    """Who spoke last (a click) at each purchase of a user."""
    events = table(spark, folder, "events")
    asked = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    seats = events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("seat_value"))
    return as_of(asked, seats, ["user_id"], "ts", ["seat_value"])


def export_readiness(spark: SparkSession, folder: str) -> DataFrame:
    return books.export_readiness(chapters(spark, folder).withColumn("has_audio", F.col("status") == "F"), "book_id", "has_audio")


CHECKS = ("length", "count", "doubt")


def _report(rows: DataFrame, seconds: F.Column) -> DataFrame:
    """Checks of a chapter, from three figures of its line items, and the figures."""
    graded = lambda value, warn, fail: F.when(value > fail, "fail").when(value > warn, "warn").otherwise("pass")
    figures = rows.groupBy("chapter_id").agg(F.max(seconds).alias("length_value"), F.count(F.lit(1)).cast("double").alias("count_value"), F.max("confidence").cast("double").alias("doubt_value"))
    doubt = F.when(F.col("chapter_id") % 5 == 0, "unspecified").otherwise(graded(F.col("doubt_value"), 0.06, 0.09))
    return figures.select("chapter_id", graded(F.col("length_value"), 40, 47).alias("length"), graded(F.col("count_value"), 3, 5).alias("count"), doubt.alias("doubt"), *[f"{c}_value" for c in CHECKS])


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    rows, seconds = pickups(spark, folder), F.col("t_end") - F.col("t_start")
    return books.compared(_report(rows, seconds), _report(rows.where("status = 'open'"), seconds), "chapter_id", list(CHECKS))


def compare_reports(spark: SparkSession, folder: str) -> DataFrame:
    """How each check of a chapter came out once its done pickups are gone."""
    return _changes(spark, folder).select("chapter_id", "check", "before", "after", "outcome")


def fix_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Of each book and check: the worst outcome, how many chapters have it, and between which values."""
    changes = _changes(spark, folder).join(chapters(spark, folder).select("book_id", "chapter_id"), "chapter_id")
    return books.fix_summary(changes, ["book_id"]).select("book_id", "check", "outcome", "files", "of_files", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def spec_lights(spark: SparkSession, folder: str) -> DataFrame:
    rows = pickups(spark, folder)
    report = _report(rows, F.col("t_end") - F.col("t_start"))
    return report.select("chapter_id", traffic_light(F.array(*CHECKS)).alias("light"))


def shared_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that an open pickup refers to, and those of them that no done one does: semi and anti join."""
    rows = pickups(spark, folder)
    used = lambda s: rows.where(F.col("status") == s).select(F.col("word_id").alias("p_partkey"))
    wanted = table(spark, folder, "part").join(used("open"), "p_partkey", "left_semi").select("p_partkey", "p_name")
    alone = wanted.join(used("done"), "p_partkey", "left_anti").select("p_partkey", F.lit(True).alias("alone"))
    return wanted.join(alone, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("alone", F.lit(False)).alias("alone"))


def marker_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every pickup in five marker formats."""
    return books.marker_lines(told_pickups(spark, folder), ["chapter_id"])


def marker_files(spark: SparkSession, folder: str) -> DataFrame:
    """The five marker files of each chapter."""
    return books.marker_files(marker_lines(spark, folder), ["chapter_id"], F.concat(F.lit("Chapter #"), F.col("chapter_id").cast("string")))


def proof_report(spark: SparkSession, folder: str) -> DataFrame:
    return books.proof_report(told_pickups(spark, folder), ["chapter_id"])


def report_rows(spark: SparkSession, folder: str) -> DataFrame:
    return books.report_rows(told_pickups(spark, folder), ["chapter_id"])


def _audio(spark: SparkSession, folder: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_id"))
    path = F.when(F.col("status") != "O", F.concat(F.when(F.col("chapter_id") % 2 == 0, "raw/").otherwise("takes/"), F.col("chapter_id").cast("string"), F.lit(".wav")))
    return chapters(spark, folder).withColumns({"number": number, "audio": path})


def export_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What a delivery pack of each book holds."""
    return books.export_plan(_audio(spark, folder), "book_id", "number", "audio")


def reveal_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The file that is shown of each book's pack: the first sound file, here those of odd numbers, else the first one."""
    files = export_plan(spark, folder).withColumn("file", F.when(F.col("number") % 2 == 0, F.concat("file", F.lit(".txt"))).when(F.col("number").isNull(), F.lit("notes/x.mp3")).otherwise(F.col("file")))
    return books.reveal_target(files, "book_id", "file", "file")


def share_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of a light pack: takes and exports of all chapters, raw ones only if referred to."""
    rows = _audio(spark, folder).withColumn("n", F.col("chapter_id").cast("string"))
    every = rows.select(F.explode(F.array(F.concat(F.lit("./raw/"), "n", F.lit(".wav")), F.concat(F.lit("takes\\"), "n", F.lit(".wav")), F.concat(F.lit("export/"), "n", F.lit(".mp3")), F.concat(F.lit("takes/"), "n", F.lit(".tmp")), F.lit(".git/config"))).alias("path"))
    return books.share_paths(every, rows.where("audio is not null").select(F.col("audio").alias("path")), True)


def catalogue_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that rows of the catalogue break: intervals, domains, unique keys, parents."""
    rows, chap = pickups(spark, folder), chapters(spark, folder)
    rules = {"interval": F.col("t_end") >= F.col("t_start"), "confidence": F.col("confidence").between(0, 0.09), "kind": F.col("kind").isin("skip", "insert", "sub")}
    found = books.violations(rows, "pickups", "chapter_id", rules)
    rows, chap = dealt(rows.select("chapter_id", "line"), "chapter_id"), dealt(chap.select("chapter_id"), "chapter_id")
    found = found.union(books.repeated_keys(rows, "pickups", "chapter_id", "line"))
    found = found.union(books.repeated_keys(chap, "chapters", "chapter_id")).union(books.orphans(rows, "pickups", "chapter_id", chap, "chapter_id"))
    return found.groupBy("table", "rule").agg(F.count(F.lit(1)).alias("n"))


def punch_shift(spark: SparkSession, folder: str) -> DataFrame:
    """Places of each user's events (as seconds of a take) after its errors were cut out, ten seconds each."""
    at = F.unix_micros(F.to_timestamp("ts")) / 1e6 - F.lit(1704067200.0)
    rows = table(spark, folder, "events").select("user_id", "event_id", "event_type", F.round(at).alias("at"))
    edits = rows.where("event_type = 'error'").select("user_id", F.col("at").alias("t_start"), (F.col("at") + 10).alias("t_end")).distinct().withColumn("delta", F.lit(-10.0))
    words = rows.where("event_type <> 'error'").select("user_id", "event_id", "at")
    return books.shifted(words, edits, ["user_id"], "at")


def retake_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Open pickups of a chapter that lie on the same days, as one task each, in order."""
    return proof.retake_lines(pickups(spark, folder).select("chapter_id", "status", F.col("t_start").cast("double").alias("t_start"), F.col("t_end").cast("double").alias("t_end")), ["chapter_id"])


def voice_guide(spark: SparkSession, folder: str) -> DataFrame:
    """A guide of words to be said, and the lines they stand in: those of even number are decided."""
    rows = pickups(spark, folder).select((F.col("word_id") % 50).alias("n"), (F.col("line") * (1 + F.col("word_id") % 3)).alias("line"))
    names = rows.groupBy("n").agg(F.count(F.lit(1)).alias("count"), F.collect_set("line").alias("chapters"))
    spelling = F.concat(F.lit("Na|me "), F.col("n").cast("string"))
    return books.guide_lines(names.select(spelling.alias("spelling"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("NAY  "), F.col("n").cast("string"))).alias("respell"), "count", "chapters"))


def spec_reports(spark: SparkSession, folder: str) -> DataFrame:
    return books.spec_report(_changes(spark, folder), ["chapter_id"])


def book_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    opened = pickups(spark, folder).groupBy("chapter_id").agg(F.count_if(F.col("status") == "open").alias("open"))
    rows = chapters(spark, folder).join(opened, "chapter_id", "left")
    return books.dashboard(rows.select("book_id", "words", F.when(F.col("chapter_id") % 2 == 0, F.col("chapter_id") * 3.0).alias("seconds"), (F.col("status") != "O").alias("has_audio"), "open"), "book_id")


QUERIES = {
    f.__name__: f
    for f in (
        pickup_summary, repeated_words, worklist, unchecked_chapters, book_progress, pickup_merge, packet_clips, merge_plan, carry_over, asof_seat, export_readiness, compare_reports, fix_summary, spec_lights,
        shared_assets, marker_lines, marker_files, proof_report, report_rows, export_plan, reveal_targets, share_paths, catalogue_violations, punch_shift, retake_lines,
    )
}


def _clock(x: str) -> str:
    ms = f"CAST(floor(({x}) * 1000 + 0.5) AS BIGINT)"
    return f"printf('%02d:%02d:%02d.%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def _minutes(x: str) -> str:
    ms = f"CAST(floor(({x}) * 1000 + 0.5) AS BIGINT)"
    return f"CASE WHEN {ms} >= 3600000 THEN printf('%d:%02d:', {ms} // 3600000, {ms} // 60000 % 60) ELSE printf('%d:', {ms} // 60000) END || printf('%02d.%03d', {ms} // 1000 % 60, {ms} % 1000)"


def _csv(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, '[",]') THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END"""


_AUDIO_SQL = """au AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY chapter_id) AS INT) AS number, CASE WHEN status <> 'O' THEN CASE WHEN chapter_id % 2 = 0 THEN 'raw/' ELSE 'takes/' END || chapter_id || '.wav' END AS audio FROM c)"""
_GRADE = "CASE WHEN {0} > {2} THEN 'fail' WHEN {0} > {1} THEN 'warn' ELSE 'pass' END"


def _checks(name: str, where: str) -> str:
    return f"""{name} AS (SELECT chapter_id, {_GRADE.format('max(t_end - t_start)', 40, 47)} AS length, {_GRADE.format('count(*)', 3, 5)} AS "count",
        CASE WHEN chapter_id % 5 = 0 THEN 'unspecified' ELSE {_GRADE.format('max(confidence)', 0.06, 0.09)} END AS doubt,
        CAST(max(t_end - t_start) AS DOUBLE) AS lv, CAST(count(*) AS DOUBLE) AS cv, CAST(max(confidence) AS DOUBLE) AS dv FROM p WHERE {where} GROUP BY chapter_id)"""


def _changes_sql() -> str:
    long = lambda t: " UNION ALL ".join(f"""SELECT chapter_id, '{c}' AS "check", "{c}" AS s, {v} AS v FROM {t}""" for c, v in (("length", "lv"), ("count", "cv"), ("doubt", "dv")))
    return f"""{_checks('b', 'true')}, {_checks('a', "status = 'open'")}, lb AS ({long('b')}), la AS ({long('a')}),
        ch AS (SELECT la.chapter_id, la."check" AS "check", lb.s AS before, la.s AS after, la.v AS av, lb.v AS bv, CASE WHEN la.s IN ('fail', 'warn') THEN 'outstanding' WHEN la.s = 'unspecified' THEN 'unjudged' WHEN lb.s IN ('fail', 'warn') THEN 'fixed'
                   WHEN lb.v <> la.v THEN 'adjusted' ELSE 'held' END AS outcome FROM la LEFT JOIN lb ON la.chapter_id = lb.chapter_id AND la."check" = lb."check")"""


ORACLES = {
    "pickup_summary": f"""WITH {PICKUPS_SQL} SELECT chapter_id, count(*) AS total, count(*) FILTER (WHERE status = 'open') AS "open", count(*) FILTER (WHERE status <> 'open') AS resolved,
        {', '.join(f"count(*) FILTER (WHERE status = 'open' AND kind = '{k}') AS open_{k}" for k in books.KINDS)} FROM p GROUP BY chapter_id""",
    "book_progress": f"""WITH {PICKUPS_SQL}, {CHAPTERS_SQL}, n AS (SELECT chapter_id, count(*) FILTER (WHERE status = 'open') AS n FROM p GROUP BY chapter_id),
        b AS (SELECT book_id, words, status <> 'O' AS audio, coalesce(n, 0) AS n FROM c LEFT JOIN n USING (chapter_id))
        SELECT book_id, count(*) AS chapters, round(sum(words) / 9300, 6) AS hours, count(*) FILTER (WHERE audio) AS recorded, count(*) FILTER (WHERE audio AND n = 0) AS proofed,
        round(avg((CAST(audio AS INT) + CAST(audio AND n = 0 AS INT)) / 2), 6) AS done,
        CASE WHEN bool_or(audio AND n > 0) THEN 'yellow' WHEN bool_and(audio AND n = 0) THEN 'green' ELSE 'red' END AS light FROM b GROUP BY book_id""",
    "merge_plan": f"""WITH {CHAPTERS_SQL}, m AS (SELECT chapter_id AS k, status AS s, updated_at AS u FROM c WHERE chapter_id % 7 <> 0),
        t AS (SELECT chapter_id AS k, CASE WHEN chapter_id % 3 = 0 THEN 'F' ELSE status END AS s, CASE WHEN chapter_id % 2 = 0 THEN updated_at + INTERVAL 1 DAY ELSE updated_at END AS u FROM c WHERE chapter_id % 5 <> 0)
        SELECT CASE WHEN m.k IS NULL THEN 'add' WHEN t.k IS NULL OR m.s = t.s THEN 'keep' WHEN m.s = 'O' OR t.u > m.u THEN 'take' WHEN m.u > t.u THEN 'stay' ELSE 'conflict' END AS action, count(*) AS n
        FROM m FULL JOIN t ON m.k = t.k GROUP BY 1""",
    "asof_seat": """WITH s AS (SELECT user_id, ts, max(value) AS seat_value FROM events WHERE event_type = 'click' GROUP BY ALL)
        SELECT e.user_id, e.ts, e.event_id, s.seat_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts""",
    "export_readiness": f"""WITH {CHAPTERS_SQL} SELECT book_id, count(*) AS total, count(*) FILTER (WHERE status = 'F') AS attached, count(*) FILTER (WHERE status <> 'F') AS missing,
        count(*) = count(*) FILTER (WHERE status = 'F') AS ready FROM c GROUP BY book_id""",
    "catalogue_violations": f"""WITH {PICKUPS_SQL}, {CHAPTERS_SQL}, v AS (
        SELECT 'pickups' AS "table", 'interval' AS rule FROM p WHERE NOT coalesce(t_end >= t_start, false)
        UNION ALL SELECT 'pickups', 'confidence' FROM p WHERE NOT coalesce(confidence BETWEEN 0 AND 0.09, false)
        UNION ALL SELECT 'pickups', 'unique' FROM (SELECT chapter_id, line FROM p GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'chapters', 'unique' FROM (SELECT chapter_id FROM c GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'pickups', 'parent' FROM p WHERE chapter_id NOT IN (SELECT chapter_id FROM c))
        SELECT "table", rule, count(*) AS n FROM v GROUP BY ALL""",
    "retake_lines": f"""WITH {PICKUPS_SQL} SELECT chapter_id, round(CAST(t_start AS DOUBLE), 3) AS t_start, round(CAST(t_end AS DOUBLE), 3) AS t_end, count(*) AS flags,
        CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY t_start, t_end) AS INT) AS at FROM p WHERE status = 'open' GROUP BY chapter_id, t_start, t_end""",
    "punch_shift": """WITH e AS (SELECT user_id, event_id, event_type, round(epoch_us(ts) / 1e6 - 1704067200.0) AS x FROM events),
        c AS (SELECT DISTINCT user_id, x AS t_start, x + 10 AS t_end FROM e WHERE event_type = 'error')
        SELECT w.user_id, w.event_id, w.x - 10.0 * (SELECT count(*) FROM c WHERE c.user_id = w.user_id AND c.t_end <= w.x) AS "at"
        FROM e w WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = w.user_id AND c.t_start <= w.x AND w.x < c.t_end)""",
    "repeated_words": f"""WITH {TOLD_SQL}, s AS (SELECT chapter_id, CASE WHEN trim(expected) <> '' THEN trim(expected) ELSE trim(heard) END AS word FROM sp WHERE status = 'open'),
        k AS (SELECT chapter_id, word, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(word), '[ -]+'), lambda x: regexp_replace(x, '[^a-z0-9'']', '', 'g')), lambda x: x <> ''), ' ') AS pieces FROM s)
        SELECT min(word) AS word, count(*) AS "count", count(DISTINCT chapter_id) AS chapters FROM k GROUP BY pieces HAVING count(*) > 1""",
    "worklist": f"""WITH {TOLD_SQL}, {CHAPTERS_SQL} SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY t_start, id) AS INT) AS at, chapter_id, id, expected
        FROM sp JOIN (SELECT book_id, chapter_id FROM c) USING (chapter_id) WHERE status = 'open'""",
    "unchecked_chapters": f"""WITH {PICKUPS_SQL}, {CHAPTERS_SQL} SELECT book_id, chapter_id FROM c WHERE status <> 'O' AND chapter_id NOT IN (SELECT chapter_id FROM p WHERE status = 'done')""",
    "pickup_merge": f"""WITH {TOLD_SQL}, a AS (SELECT *, kind = 'pause' AS pause, sum(CAST(kind = 'pause' AS INT)) OVER (PARTITION BY chapter_id ORDER BY t_start, id ROWS UNBOUNDED PRECEDING) AS part FROM sp),
        r AS (SELECT *, max(t_end) OVER (PARTITION BY chapter_id, part, pause ORDER BY t_start, t_end, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR t_start > reach + 14 THEN 1 ELSE 0 END) OVER (PARTITION BY chapter_id, part, pause ORDER BY t_start, t_end, id ROWS UNBOUNDED PRECEDING) AS session FROM r),
        m AS (SELECT chapter_id, min(t_start) AS t_start, max(t_end) AS t_end, count(*) AS pickups, coalesce(string_agg(expected, ' ' ORDER BY t_start, id) FILTER (WHERE expected <> ''), '') AS expected,
              coalesce(string_agg(heard, ' ' ORDER BY t_start, id) FILTER (WHERE heard <> ''), '') AS heard, min(kind) AS k, min(confidence) AS confidence, min((t_start, id)) AS place, bool_or(pause) AS pause FROM g GROUP BY chapter_id, part, pause, session),
        n AS (SELECT *, CASE WHEN pause THEN 'pause' WHEN pickups = 1 THEN k WHEN heard = '' THEN 'skip' WHEN expected = '' THEN 'insert' ELSE 'sub' END AS kind, row_number() OVER (PARTITION BY chapter_id ORDER BY place) - 1 AS n FROM m),
        t AS (SELECT *, concat_ws('|', chapter_id, kind, expected, heard, printf('%.4f', t_start), printf('%.4f', t_end), n) AS s FROM n)
        SELECT chapter_id, 'pickup-' || printf('%08x', list_reduce(list_transform(string_split(s, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT))) AS pickup_id,
               t_start, t_end, kind, expected, heard, confidence, pickups FROM t""",
    "packet_clips": f"""WITH RECURSIVE {TOLD_SQL}, w AS (SELECT chapter_id, greatest(0, t_start - 2) AS a, greatest(t_start, t_end) + 2 AS z, row_number() OVER (PARTITION BY chapter_id ORDER BY t_start, t_end, id) AS n FROM sp),
        f AS (SELECT chapter_id, n, 1 AS number, a AS "start", z AS "end" FROM w WHERE n = 1
              UNION ALL SELECT w.chapter_id, w.n, CASE WHEN w.a <= f."end" AND w.z - f."start" <= 60 THEN f.number ELSE f.number + 1 END,
                               CASE WHEN w.a <= f."end" AND w.z - f."start" <= 60 THEN f."start" ELSE w.a END, CASE WHEN w.a <= f."end" AND w.z - f."start" <= 60 THEN greatest(f."end", w.z) ELSE w.z END
                        FROM f JOIN w ON w.chapter_id = f.chapter_id AND w.n = f.n + 1),
        c AS (SELECT chapter_id, CAST(number AS INT) AS number, min("start") AS clip_start, max("end") AS clip_end, CAST(count(*) AS INT) AS pickups FROM f GROUP BY chapter_id, number)
        SELECT chapter_id, number, printf('%03d_%02d-%02d-%02d', number, CAST(floor(clip_start) AS INT) // 3600, CAST(floor(clip_start) AS INT) // 60 % 60, CAST(floor(clip_start) AS INT) % 60) AS name,
               round(clip_start, 3) AS clip_start, round(clip_end, 3) AS clip_end, pickups FROM c""",
    "carry_over": f"""WITH RECURSIVE {PICKUPS_SQL}, o AS (SELECT chapter_id, kind, CASE WHEN row_number() OVER (PARTITION BY chapter_id, line ORDER BY word_id, t_start) = 1 THEN line ELSE 1000 + row_number() OVER (PARTITION BY chapter_id ORDER BY line, word_id, t_start) END AS id, t_start, status FROM p WHERE line % 2 = 1),
        f AS (SELECT chapter_id, kind, CASE WHEN word_id % 3 = 0 AND row_number() OVER (PARTITION BY chapter_id, line ORDER BY word_id, t_start) = 1 THEN line - 1 ELSE 100 + row_number() OVER (PARTITION BY chapter_id ORDER BY line, word_id, t_start) END AS id, t_start FROM p WHERE line % 2 = 0),
        m AS (SELECT f.*, o.status, abs(f.t_start - o.t_start) AS moved_by FROM f JOIN o USING (chapter_id, id)),
        l AS (SELECT *, row_number() OVER (PARTITION BY chapter_id, kind ORDER BY t_start, id) AS k FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.chapter_id = f.chapter_id AND o.id = f.id)),
        r AS (SELECT chapter_id, kind, list({{'t': t_start, 'i': id, 's': status}} ORDER BY t_start, id) AS free FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE o.chapter_id = f.chapter_id AND o.id = f.id) GROUP BY ALL),
        g AS (SELECT l.chapter_id, l.kind, CAST(0 AS BIGINT) AS k, coalesce(any_value(free), []) AS free, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS DOUBLE) AS moved_by FROM l LEFT JOIN r USING (chapter_id, kind) GROUP BY ALL
              UNION ALL
              SELECT chapter_id, kind, k, list_filter(free, lambda x: x.i <> b.i), b.s, b.d
              FROM (SELECT g.chapter_id, g.kind, l.k, g.free, list_min(list_transform(g.free, lambda x: {{'d': abs(x.t - l.t_start), 't': x.t, 'i': x.i, 's': x.s}})) AS b FROM g JOIN l ON l.chapter_id = g.chapter_id AND l.kind = g.kind AND l.k = g.k + 1))
        SELECT chapter_id, kind, id, t_start, status, moved_by FROM m
        UNION ALL SELECT l.chapter_id, l.kind, l.id, l.t_start, g.status, g.moved_by FROM l JOIN g USING (chapter_id, kind, k)""",
    "compare_reports": f"""WITH {PICKUPS_SQL}, {_changes_sql()} SELECT chapter_id, "check", before, after, outcome FROM ch""",
    "fix_summary": f"""WITH {PICKUPS_SQL}, {CHAPTERS_SQL}, {_changes_sql()}, w AS (SELECT book_id, ch.*, CASE outcome WHEN 'outstanding' THEN 4 WHEN 'fixed' THEN 3 WHEN 'adjusted' THEN 2 WHEN 'held' THEN 1 ELSE 0 END AS w FROM ch JOIN (SELECT book_id, chapter_id FROM c) USING (chapter_id)),
        t AS (SELECT *, max(w) OVER (PARTITION BY book_id, "check") AS top FROM w)
        SELECT book_id, "check", max_by(outcome, w) AS outcome, count(*) FILTER (WHERE w = top) AS files, count(*) FILTER (WHERE top = 4 OR before IS NOT NULL) AS of_files,
               round(min(av) FILTER (WHERE w = top), 6) AS low, round(max(av) FILTER (WHERE w = top), 6) AS high FROM t GROUP BY book_id, "check" """,
    "spec_lights": f"""WITH {PICKUPS_SQL}, {_checks('b', 'true')} SELECT chapter_id, CASE WHEN 'fail' IN (length, "count", doubt) THEN 'red' WHEN 'warn' IN (length, "count", doubt) THEN 'yellow' ELSE 'green' END AS light FROM b""",
    "shared_assets": f"""WITH {PICKUPS_SQL} SELECT p_partkey, p_name, p_partkey NOT IN (SELECT word_id FROM p WHERE status = 'done') AS alone FROM part WHERE p_partkey IN (SELECT word_id FROM p WHERE status = 'open')""",
    "marker_lines": f"""WITH {TOLD_SQL}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY t_start, id) AS INT) AS number, CASE WHEN expected = '' THEN '—' ELSE expected END || ' → ' || CASE WHEN heard = '' THEN '—' ELSE heard END || ' [' || kind || ']' AS label,
            t_end - t_start AS len, trim(regexp_replace(coalesce(note, ''), '\\s+', ' ', 'g')) AS flat, greatest(t_end, t_start + 0.5) AS cue FROM sp WHERE status <> 'ignored')
        SELECT chapter_id, number, printf('%.3f', t_start) || chr(9) || printf('%.3f', t_end) || chr(9) || label AS label_track,
            'R' || number || ',' || {_csv('label')} || ',' || printf('%.3f,%.3f,%.3f,', t_start, t_end, len) AS region_row,
            label || chr(9) || {_minutes('t_start')} || chr(9) || {_minutes('len')} || chr(9) || 'decimal' || chr(9) || 'Cue' || chr(9) || flat AS marker_row,
            number || chr(10) || replace({_clock('t_start')}, '.', ',') || ' --> ' || replace({_clock('cue')}, '.', ',') || chr(10) || label AS subtitle,
            number || printf(',%.3f,%.3f,', t_start, t_end) || {_clock('t_start')} || ',' || kind || ',' || seat || ',' || status || ',' || {_csv('expected')} || ',' || {_csv('heard')} || ',' || printf('%.2f', confidence) || ',' || {_csv('flat')} AS table_row FROM n""",
    "proof_report": f"""WITH {TOLD_SQL} SELECT chapter_id, count(*) FILTER (WHERE status = 'open') AS "open", count(*) FILTER (WHERE status = 'done') AS resolved, count(*) FILTER (WHERE status = 'ignored') AS ignored,
        count(*) FILTER (WHERE kind <> 'pause') AS word_changes, count(*) FILTER (WHERE kind = 'pause') AS long_pauses FROM sp GROUP BY chapter_id""",
    "report_rows": f"""WITH {TOLD_SQL}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY t_start, id) AS INT) AS number FROM sp)
        SELECT chapter_id, number, '| ' || number || ' | ' || {_minutes('t_start')} || ' | ' || kind || ' | ' || status || ' | ' || CASE WHEN expected = '' THEN '—' ELSE expected END || ' | ' || CASE WHEN heard = '' THEN '—' ELSE heard END
            || ' | ' || CAST(floor(confidence * 100 + 0.5) AS INT) || '% | ' || replace(coalesce(trim(regexp_replace(note, '\\s+', ' ', 'g')), '—'), '|', '\\|') || ' |' AS row FROM n""",
    "export_plan": f"""WITH {CHAPTERS_SQL}, {_AUDIO_SQL}, x AS (SELECT book_id, printf('%02d_chapter_%02d.mp3', number, number) AS file, 'chapter' AS kind, number, audio AS source FROM au),
        f AS (SELECT book_id, min(number) AS number, arg_min(coalesce(audio, ''), number) AS source FROM au GROUP BY book_id)
        SELECT * FROM x UNION ALL SELECT book_id, '00_opening_credits.mp3', 'opening_credits', NULL, NULL FROM f UNION ALL SELECT book_id, '98_closing_credits.mp3', 'closing_credits', NULL, NULL FROM f
        UNION ALL SELECT book_id, '99_retail_sample.mp3', 'retail_sample', number, nullif(source, '') FROM f""",
    "reveal_targets": f"""WITH {CHAPTERS_SQL}, {_AUDIO_SQL}, x AS (SELECT book_id, printf('%02d_chapter_%02d.mp3', number, number) || CASE WHEN number % 2 = 0 THEN '.txt' ELSE '' END AS file FROM au UNION ALL SELECT DISTINCT book_id, '99_retail_sample.mp3' FROM au)
        SELECT book_id, coalesce(min(file) FILTER (WHERE file LIKE '%.mp3'), min(file)) AS target FROM x GROUP BY book_id""",
    "share_paths": f"""WITH {CHAPTERS_SQL}, {_AUDIO_SQL} SELECT 'takes/' || chapter_id || '.wav' AS path FROM au UNION ALL SELECT audio FROM au WHERE audio LIKE 'raw/%'""",
}
_FILES = (("labels.txt", "label_track", "", "chr(10)"), ("regions.csv", "region_row", "#,Name,Start,End,Length,Color", "chr(10)"), ("markers.csv", "marker_row", "Name|Start|Duration|Time Format|Type|Description", "chr(10)"),
          ("subtitles.srt", "subtitle", "", "chr(10) || chr(10)"), ("pickups.csv", "table_row", books.MARKER_HEADERS["pickups"], "chr(10)"))
ORACLES["marker_files"] = f"WITH l AS ({ORACLES['marker_lines']}) " + " UNION ALL ".join(
    f"""SELECT chapter_id, 'Chapter_' || chapter_id || '_{name}' AS file, {f"replace('{head}', '|', chr(9)) || chr(10) || " if head else ""}string_agg({column}, {between} ORDER BY number) || chr(10) AS content FROM l GROUP BY chapter_id"""
    for name, column, head, between in _FILES
)
QUERIES |= {f.__name__: f for f in (voice_guide, spec_reports, book_dashboard)}
ORACLES |= {
    "voice_guide": f"""WITH {PICKUPS_SQL}, r AS (SELECT word_id % 50 AS n, line * (1 + word_id % 3) AS line FROM p), k AS (SELECT n, count(*) AS c FROM r GROUP BY n), d AS (SELECT DISTINCT n, line FROM r),
        i AS (SELECT n, line, line - row_number() OVER (PARTITION BY n ORDER BY line) AS g FROM d), s AS (SELECT n, min(line) AS a, max(line) AS z FROM i GROUP BY n, g),
        t AS (SELECT n, string_agg(CASE WHEN a = z THEN CAST(a AS VARCHAR) ELSE a || '–' || z END, ', ' ORDER BY a) AS t FROM s GROUP BY n)
        SELECT CASE WHEN n % 2 = 0 THEN 'decided' ELSE 'undecided' END AS section, CAST(row_number() OVER (PARTITION BY n % 2 ORDER BY c DESC, 'Na|me ' || n) AS INT) AS number,
               '| Na\\|me ' || n || ' | ' || CASE WHEN n % 2 = 0 THEN 'NAY ' || n ELSE '—' END || ' | ' || c || ' | ' || t || ' |' AS line FROM k JOIN t USING (n)""",
    "spec_reports": f"""WITH {PICKUPS_SQL}, {_changes_sql()} SELECT chapter_id, string_agg("check" || ': ' || coalesce(printf('%.2f', bv), '—') || ' → ' || coalesce(printf('%.2f', av), '—') || ' (' || outcome || ')', chr(10) ORDER BY "check") || chr(10)
        || coalesce('outstanding: ' || string_agg("check", ', ' ORDER BY "check") FILTER (WHERE outcome = 'outstanding'), 'nothing outstanding') AS report FROM ch GROUP BY chapter_id""",
    "book_dashboard": f"""WITH {PICKUPS_SQL}, {CHAPTERS_SQL}, n AS (SELECT chapter_id, count(*) FILTER (WHERE status = 'open') AS n FROM p GROUP BY chapter_id)
        SELECT book_id, count(*) AS chapters, round(sum(greatest(0, words)), 2) AS words, round(sum(CASE WHEN chapter_id % 2 = 0 AND chapter_id > 0 THEN chapter_id * 3.0 / 60 ELSE greatest(0, words) / 155 END), 1) AS minutes,
               count(*) FILTER (WHERE status <> 'O') AS recorded, count(*) FILTER (WHERE status <> 'O' AND n = 0) AS proofed, CAST(coalesce(sum(n), 0) AS BIGINT) AS "open" FROM c LEFT JOIN n USING (chapter_id) GROUP BY book_id""",
}
