"""Queries of the decision tables: line items stand in for pickups and punches, orders for chapters, turns for people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstream.operators import decisions as D
from inkstream.sources.tables import CHAPTERS_SQL, PICKUPS_SQL, chapters, pickups, table


def _timed(spark: SparkSession, folder: str) -> DataFrame:
    """Pickups with their chapter's recordings: every third has a line, kinds and notes go by number."""
    recorded = chapters(spark, folder).select("chapter_id", (F.col("status") != "O").alias("take"), (F.col("chapter_id") % 3 != 0).alias("tape"))
    lined = F.col("line") % 3 == 0
    kind = F.when(F.col("line") % 4 == 0, "live").when(F.col("line") % 4 == 1, "take")
    rows = pickups(spark, folder).withColumns({"line_start": F.when(lined, F.col("t_start") - 1), "line_end": F.when(lined, F.col("t_end") + 1), "source_kind": kind, "caught": F.col("word_id") % 5 == 0})
    return rows.join(recorded, "chapter_id")


def pickup_sources(spark: SparkSession, folder: str) -> DataFrame:
    """What each pickup is heard from, and why it cannot be heard or recorded over."""
    rows = _timed(spark, folder).withColumn("b", D.line_bounds(F.col("t_start"), F.col("t_end"), F.col("line_start"), F.col("line_end")))
    args = [F.col(c) for c in ("source_kind", "caught", "take", "tape")]
    same = F.col("word_id") % 2 == 0
    return rows.select("chapter_id", "line", "b.start", "b.end", "b.word_only", D.audio_source(*args).alias("source"), D.listen_block(*args).alias("listen"), D.punch_block(*args, same).alias("punch"))


def proof_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = chapters(spark, folder)
    wish = F.when(F.col("chapter_id") % 4 == 0, "live").when(F.col("chapter_id") % 4 == 1, "take")
    return rows.select("chapter_id", D.proof_source(wish, F.col("status") != "O", F.col("chapter_id") % 3 != 0).alias("source"))


def playback_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """What is played for a pickup: its words, the words alone, their surroundings, what leads up to them."""
    a, z = F.col("t_start") / 8, F.when(F.col("line") == 2, F.lit(float("nan"))).otherwise(F.col("t_end") / 8)
    ranges = {"exact": D.exact_range(a, z), "tight": D.tight_range(a, z), "context": D.context_range(a, z), "lead_in": D.lead_in_range(a, 3.0)}
    rows = pickups(spark, folder).select("chapter_id", "line", D.reached_end(a, z).alias("over"), *[r.alias(n) for n, r in ranges.items()])
    return rows.select("chapter_id", "line", "over", *[F.col(f"{n}.{e}").alias(f"{n}_{e}") for n in ranges for e in ("start", "end")])


def chapter_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Label and tone of each chapter; a chapter without pickups has not been checked."""
    opened = pickups(spark, folder).groupBy("chapter_id").agg(F.count_if(F.col("status") == "open").alias("open"))
    rows = chapters(spark, folder).join(opened, "chapter_id", "left").withColumn("s", D.chapter_status(F.col("status") != "O", F.col("open")))
    return rows.select("chapter_id", "s.label", "s.tone")


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    return chapters(spark, folder).withColumn("index", F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_id")))


def prompt_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters found by a prompt of one digit: in titles and numbers."""
    return D.matching_chapters(_numbered(spark, folder), " 1 ").select("book_id", "index", "chapter_id", "title")


def seat_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters as a second narrator's pack has them: without what is not packed."""
    rows = chapters(spark, folder).select("chapter_id", "title", F.concat(F.lit("a/"), F.col("chapter_id").cast("string")).alias("audio_path"), F.lit(1).alias("open_pickups"), F.lit("n").alias("notes_path"))
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in D.PACK_LACKS if c in rows.columns})


def normalized_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Settings of each book, brought into their ranges (account balances stand in for what was typed)."""
    typed = table(spark, folder, "customer").select(F.col("c_custkey").alias("book_id"), F.when(F.col("c_custkey") % 9 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).cast("double").alias("x"))
    return typed.select("book_id", D.setting(F.col("x") / 500, "pause_seconds").alias("pause_seconds"), D.setting(-F.abs("x") / 300, "target_rms").alias("target_rms"), D.setting(F.col("x") / 9000, "min_confidence").alias("min_confidence"))


def permissions(spark: SparkSession, folder: str) -> DataFrame:
    """What the speakers of each conversation may do, the assistant as author."""
    role = F.when(F.col("role") == "assistant", "author").otherwise(F.col("role"))
    people = table(spark, folder, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(role.alias("role"))).alias("people"))
    return people.select("conv_id", *[D.may(F.col("people"), a).alias(a) for a in ("note", "approve", "claim")])


def punch_comparisons(spark: SparkSession, folder: str) -> DataFrame:
    """The two sides of each usable punch."""
    rows = pickups(spark, folder)
    text = lambda p: F.concat(F.lit(p), F.col("chapter_id").cast("string"))
    punches = rows.select(
        "chapter_id", F.col("line").alias("id"), F.when(F.col("line") % 5 == 0, "").otherwise(text("punch/")).alias("path"), F.when(F.col("chapter_id") % 2 == 0, text("raw/")).alias("raw_path"),
        F.when(F.col("chapter_id") % 3 == 0, text("take/")).otherwise("").alias("audio_path"), F.col("t_start"), F.when(F.col("line") == 3, F.col("t_start")).otherwise(F.col("t_end")).alias("t_end"),
        F.when(F.col("status") == "done", "match").alias("verification"), F.lit(None).cast("string").alias("edit"), F.col("t_start").alias("created_at"),
    )
    return D.comparisons(punches).drop("created_at")


def session_advance(spark: SparkSession, folder: str) -> DataFrame:
    """Open tasks of a chapter after its first task was recorded a second longer than it was."""
    rows = pickups(spark, folder).where("status = 'open'").select("chapter_id", "line", F.col("t_start").alias("start"), F.col("t_end").alias("end"))
    first = rows.groupBy("chapter_id").agg(F.min(F.struct("start", "end", "line")).alias("f"))
    return D.advanced(rows.join(first, "chapter_id"), F.col("f.start"), F.col("f.end"), F.lit(1.0), F.col("line") == F.col("f.line")).select("chapter_id", "line", "start", "end", "state")


def kept_tapes(spark: SparkSession, folder: str) -> DataFrame:
    return pickups(spark, folder).select("chapter_id", "line", D.keeps_tape((F.col("t_end") - F.col("t_start")) * F.col("word_id"), F.col("line") * 20 - 20).alias("kept"))


QUERIES = {f.__name__: f for f in (pickup_sources, proof_sources, playback_ranges, chapter_statuses, prompt_chapters, seat_pack, normalized_settings, permissions, punch_comparisons, session_advance, kept_tapes)}

_T = f"""{PICKUPS_SQL}, {CHAPTERS_SQL}, t AS (SELECT p.*, c.status <> 'O' AS take, chapter_id % 3 <> 0 AS tape, CASE line % 4 WHEN 0 THEN 'live' WHEN 1 THEN 'take' END AS sk,
    word_id % 5 = 0 AS caught, line % 3 = 0 AS lined FROM p JOIN c USING (chapter_id))"""
_SOURCE = "CASE WHEN coalesce(sk = 'live', false) OR caught THEN CASE WHEN tape THEN 'live' END WHEN coalesce(sk = 'take', false) AND NOT take THEN NULL WHEN take THEN 'take' WHEN tape THEN 'live' END"
ORACLES = {
    "pickup_sources": f"""WITH {_T} SELECT chapter_id, line, greatest(0, CASE WHEN lined THEN t_start - 1 ELSE t_start END) AS "start", CASE WHEN lined THEN t_end + 1 ELSE greatest(0, t_end) END AS "end",
        NOT lined AS word_only, {_SOURCE} AS source, CASE WHEN ({_SOURCE}) IS NULL THEN CASE WHEN caught THEN 'no tape' ELSE 'no take' END END AS listen,
        CASE WHEN sk = 'live' THEN CASE WHEN NOT tape THEN 'no tape' WHEN take AND word_id % 2 <> 0 THEN 'take is another recording' END WHEN sk = 'take' AND NOT take THEN 'no take'
             WHEN caught THEN CASE WHEN take THEN 'check the take first' ELSE 'attach a take first' END WHEN NOT take AND NOT tape THEN 'no take' END AS punch FROM t""",
    "proof_sources": f"""WITH {CHAPTERS_SQL}, s AS (SELECT chapter_id, chapter_id % 4 AS w, status <> 'O' AS take, chapter_id % 3 <> 0 AS tape FROM c)
        SELECT chapter_id, CASE WHEN w = 0 AND tape THEN 'live' WHEN take THEN 'take' WHEN tape THEN 'live' END AS source FROM s""",
    "playback_ranges": f"""WITH {PICKUPS_SQL}, a AS (SELECT chapter_id, line, t_start / 8 AS a, CASE WHEN line = 2 THEN NULL ELSE t_end / 8 END AS z FROM p),
        e AS (SELECT *, round(greatest(0, a), 6) AS s, greatest(round(greatest(0, a), 6), round(greatest(0, coalesce(z, 0)), 6)) AS f FROM a)
        SELECT chapter_id, line, z IS NOT NULL AND coalesce(a >= z - 0.005, false) AS "over", s AS exact_start, f AS exact_end, round(s + least(0.04, (f - s) * 0.2), 6) AS tight_start, round(f - least(0.04, (f - s) * 0.2), 6) AS tight_end,
               round(greatest(0, s - 0.5), 6) AS context_start, round(f + 0.5, 6) AS context_end, round(greatest(0, s - 3), 6) AS lead_in_start, s AS lead_in_end FROM e""",
    "chapter_statuses": f"""WITH {PICKUPS_SQL}, {CHAPTERS_SQL}, n AS (SELECT chapter_id, count(*) FILTER (WHERE status = 'open') AS n FROM p GROUP BY chapter_id)
        SELECT chapter_id, CASE WHEN status = 'O' THEN 'to record' WHEN n > 0 THEN n || CASE WHEN n = 1 THEN ' pickup' ELSE ' pickups' END WHEN n = 0 THEN 'proofed' ELSE 'recorded' END AS label,
               CASE WHEN status = 'O' THEN 'idle' WHEN n > 0 THEN 'review' WHEN n = 0 THEN 'ready' ELSE 'recorded' END AS tone FROM c LEFT JOIN n USING (chapter_id)""",
    "prompt_chapters": f"""WITH {CHAPTERS_SQL}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY chapter_id) AS INT) AS index FROM c)
        SELECT book_id, index, chapter_id, title FROM n WHERE contains(lower(title), '1') OR contains(CAST(index AS VARCHAR), '1')""",
    "seat_pack": f"""WITH {CHAPTERS_SQL} SELECT chapter_id, title, CAST(NULL AS VARCHAR) AS audio_path, CAST(NULL AS INT) AS open_pickups, CAST(NULL AS VARCHAR) AS notes_path FROM c""",
    "normalized_settings": """WITH t AS (SELECT c_custkey AS book_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_acctbal AS DOUBLE) END AS x FROM customer)
        SELECT book_id, CASE WHEN x IS NULL THEN 4 ELSE greatest(2, least(12, x / 500)) END AS pause_seconds, CASE WHEN x IS NULL THEN -20 ELSE greatest(-23, least(-18, -abs(x) / 300)) END AS target_rms,
               CASE WHEN x IS NULL THEN 0 ELSE greatest(0, least(0.9, x / 9000)) END AS min_confidence FROM t""",
    "permissions": """WITH n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id)
        SELECT conv_id, a > 0 AS note, a > 0 AS approve, n = 0 OR a = 1 AS claim FROM n""",
    "punch_comparisons": f"""WITH {PICKUPS_SQL} SELECT chapter_id, line AS id, CASE WHEN chapter_id % 2 = 0 THEN 'raw/' ELSE 'take/' END || chapter_id AS original_path, 'punch/' || chapter_id AS replacement_path,
        t_start, t_end, CASE WHEN status = 'done' THEN 'match' ELSE 'needs_verification' END AS verification, 'applied' AS edit FROM p
        WHERE line % 5 <> 0 AND line <> 3 AND t_end > t_start AND t_start >= 0 AND (chapter_id % 2 = 0 OR chapter_id % 3 = 0)""",
    "session_advance": f"""WITH {PICKUPS_SQL}, o AS (SELECT chapter_id, line, t_start AS s, t_end AS e FROM p WHERE status = 'open'),
        f AS (SELECT chapter_id, s AS fs, e AS fe, line AS fl FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY s, e, line) AS k FROM o) WHERE k = 1),
        j AS (SELECT *, CASE WHEN line = fl THEN 'done' WHEN s < fe AND e > fs THEN 'superseded' ELSE 'left' END AS state FROM o JOIN f USING (chapter_id))
        SELECT chapter_id, line, CASE WHEN state = 'left' AND s >= fe THEN s + 1 ELSE s END AS "start", CASE WHEN state = 'left' AND s >= fe THEN e + 1 ELSE e END AS "end", state FROM j""",
    "kept_tapes": f"""WITH {PICKUPS_SQL} SELECT chapter_id, line, coalesce(line > 1 AND (t_end - t_start) * word_id > 0 AND ((t_end - t_start) * word_id) / nullif(line * 20 - 20, 0) BETWEEN 0.3 AND 7200, false) AS kept FROM p""",
}
