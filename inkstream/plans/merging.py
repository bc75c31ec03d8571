"""Queries of merging: two copies of the catalogue that were edited apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.operators import merge as M
from inkstream.sources.tables import CHAPTERS_SQL, TOLD_SQL, chapters, dealt, table, told_pickups


def _chapters(spark: SparkSession, folder: str, theirs: bool) -> DataFrame:
    k = F.col("chapter_id")
    own = 1 if theirs else 0
    audio = F.when((k + own) % 3 != 0, F.concat(F.lit("take/"), (k % (5 + own)).cast("string")))
    status = F.when(k % (4 + own) == 0, "approved").when(k % 2 == 0, "draft")
    rows = dealt(chapters(spark, folder), "chapter_id").where(k % (7 if theirs else 11) != 0)
    return rows.select("chapter_id", (k % (9 + own) == 0).cast("int").alias("script"), audio.alias("audio"), (k % (2 + own) == 0).alias("aligned"), status.alias("status"), F.when(k % 5 != 0, k % (3 + own)).alias("updated_at"))


def _pickups(spark: SparkSession, folder: str, theirs: bool) -> DataFrame:
    rows = dealt(told_pickups(spark, folder).select("id", "line", "status"), "id")
    if not theirs:
        return rows.where("line % 5 <> 0").select("id", "status", F.when(F.col("line") == 3, "kept").alias("note"))
    return rows.select("id", F.when(F.col("line") % 2 == 0, "done").otherwise(F.col("status")).alias("status"), F.when(F.col("line") == 4, "theirs").alias("note"))


def _names(spark: SparkSession, folder: str, theirs: bool) -> DataFrame:
    own = 1 if theirs else 0
    rows = table(spark, folder, "supplier").select((F.col("s_suppkey") + own * 3).alias("k"))
    return rows.select(F.concat(F.lit(" Name " if theirs else "NAME "), F.col("k").cast("string")).alias("spelling"), F.when(F.col("k") % (2 + own) == 0, "say it").otherwise(" ").alias("respell"), F.when(F.col("k") % (3 + own) == 0, "low").alias("note"))


def _notes(spark: SparkSession, folder: str, theirs: bool) -> DataFrame:
    rows = table(spark, folder, "customer")
    return (rows if theirs else rows.where("c_custkey % 3 = 0")).select(F.col("c_custkey").alias("note_id"), F.col("c_custkey").alias("chapter_id"))


def _plan(spark: SparkSession, folder: str) -> DataFrame:
    mine, theirs = (_chapters(spark, folder, t) for t in (False, True))
    plan = M.chapter_plan(mine, theirs).unionByName(M.pickup_plan(_pickups(spark, folder, False), _pickups(spark, folder, True)))
    plan = plan.unionByName(M.note_plan(_notes(spark, folder, False), _notes(spark, folder, True), mine))
    return plan.unionByName(M.glossary_plan(_names(spark, folder, False), _names(spark, folder, True)))


def project_merge(spark: SparkSession, folder: str) -> DataFrame:
    """All that merging the other copy does: chapters, pickups, notes and names."""
    return _plan(spark, folder)


def merge_sentence(spark: SparkSession, folder: str) -> DataFrame:
    return M.described(_plan(spark, folder))


def merged_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Pickups once the other copy's decisions have come in."""
    mine, theirs = (_pickups(spark, folder, t) for t in (False, True))
    return M.with_decisions(mine, theirs, M.pickup_plan(mine, theirs))


QUERIES = {f.__name__: f for f in (project_merge, merge_sentence, merged_decisions)}


def _side(name: str, own: int, skip: int) -> str:
    return f"""{name} AS (SELECT chapter_id AS k, CAST(chapter_id % {9 + own} = 0 AS INT) AS script, CASE WHEN (chapter_id + {own}) % 3 <> 0 THEN 'take/' || (chapter_id % {5 + own}) END AS audio, chapter_id % {2 + own} = 0 AS aligned,
        CASE WHEN chapter_id % {4 + own} = 0 THEN 'approved' WHEN chapter_id % 2 = 0 THEN 'draft' END AS status, CASE WHEN chapter_id % 5 <> 0 THEN chapter_id % {3 + own} END AS u FROM c WHERE chapter_id % {skip} <> 0)"""


def _name(name: str, own: int) -> str:
    return f"""{name} AS (SELECT 'name ' || k AS word, {"' Name '" if own else "'NAME '"} || k AS spelling, CASE WHEN k % {2 + own} = 0 THEN 'say it' ELSE ' ' END AS respell, CASE WHEN k % {3 + own} = 0 THEN 'low' END AS note FROM (SELECT s_suppkey + {own * 3} AS k FROM supplier))"""


_PICKED = """pm AS (SELECT id, status, CASE WHEN line = 3 THEN 'kept' END AS note FROM sp WHERE line % 5 <> 0), pt AS (SELECT id, CASE WHEN line % 2 = 0 THEN 'done' ELSE status END AS status, CASE WHEN line = 4 THEN 'theirs' END AS note FROM sp),
    pj AS (SELECT pt.id, pm.status AS ms, pt.status AS ts, pm.id IS NULL AS un, coalesce(pm.note, '') AS mn, coalesce(pt.note, '') AS tn FROM pt LEFT JOIN pm ON pm.id = pt.id),
    pa AS (SELECT *, CASE WHEN un THEN 'unknown' WHEN ms = ts AND mn = tn THEN NULL WHEN ms = 'open' AND mn = '' THEN 'decision' WHEN ms <> ts AND ts <> 'open' THEN 'conflict' END AS action FROM pj)"""
_PLAN = f"""{CHAPTERS_SQL}, {TOLD_SQL}, {_side('m', 0, 11)}, {_side('t', 1, 7)}, j AS (SELECT t.k, m.k IS NOT NULL AS here, m.script AS ms, t.script AS ts, m.audio AS ma, t.audio AS ta, m.aligned AS mal, t.aligned AS tal, m.status AS mst, t.status AS tst, m.u AS mu, t.u AS tu FROM t LEFT JOIN m ON m.k = t.k),
    {_PICKED}, {_name('gm', 0)}, {_name('gt', 1)}, gj AS (SELECT gt.word, gm.word IS NULL AS un, gm.spelling AS ms, gt.spelling AS ts, gm.respell AS mr, gt.respell AS tr, gm.note AS mn, gt.note AS tn FROM gt LEFT JOIN gm ON gm.word = gt.word),
    plan AS (SELECT 'chapter' AS kind, 'unknown' AS action, CAST(k AS VARCHAR) AS key, NULL AS mine, NULL AS theirs FROM j WHERE NOT here
    UNION ALL SELECT 'chapter', 'script', CAST(k AS VARCHAR), NULL, NULL FROM j WHERE here AND ms <> ts
    UNION ALL SELECT 'chapter', CASE WHEN ma IS NULL THEN CASE WHEN tal AND NOT mal THEN 'adopt-proof' ELSE 'adopt' END ELSE 'audio' END, CAST(k AS VARCHAR), ma, ta FROM j WHERE here AND ta IS NOT NULL AND (ma IS NULL OR ta <> ma)
    UNION ALL SELECT 'chapter', CASE WHEN coalesce(tu > mu, false) THEN 'status' ELSE 'status-conflict' END, CAST(k AS VARCHAR), mst, tst FROM j WHERE here AND tst IS NOT NULL AND tst IS DISTINCT FROM mst
    UNION ALL SELECT 'pickup', action, id, ms, ts FROM pa WHERE action IS NOT NULL
    UNION ALL SELECT 'note', CASE WHEN c_custkey IN (SELECT k FROM m) THEN 'add' ELSE 'orphan' END, CAST(c_custkey AS VARCHAR), NULL, CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT 'glossary', 'add', word, NULL, ts FROM gj WHERE un
    UNION ALL SELECT 'glossary', 'respell', word, mr, tr FROM gj WHERE NOT un AND trim(coalesce(tr, '')) <> '' AND trim(coalesce(mr, '')) = ''
    UNION ALL SELECT 'glossary', 'note', word, mn, tn FROM gj WHERE NOT un AND trim(coalesce(tn, '')) <> '' AND trim(coalesce(mn, '')) = '')"""
ORACLES = {
    "project_merge": f"WITH {_PLAN} SELECT * FROM plan",
    "merge_sentence": f"""WITH {_PLAN}, n AS (SELECT [count(*) FILTER (WHERE kind = 'note' AND action = 'add'), count(*) FILTER (WHERE kind = 'glossary' AND action = 'add'), count(*) FILTER (WHERE kind = 'pickup' AND action = 'decision'),
        count(*) FILTER (WHERE kind = 'chapter' AND action LIKE 'adopt%'), count(*) FILTER (WHERE kind = 'chapter' AND action = 'status'), count(*) FILTER (WHERE action LIKE '%conflict%' OR action IN ('script', 'audio'))] AS n, ['notes', 'names', 'decisions', 'recordings', 'states', 'conflicts'] AS w FROM plan)
        SELECT coalesce(nullif(array_to_string(list_filter(list_transform([1, 2, 3, 4, 5, 6], lambda i: CASE WHEN n[i] > 0 THEN n[i] || ' ' || w[i] END), lambda x: x IS NOT NULL), ', '), ''), 'nothing to merge') AS sentence FROM n""",
    "merged_decisions": f"""WITH {TOLD_SQL}, {_PICKED} SELECT pm.id, CASE WHEN action = 'decision' THEN ts ELSE pm.status END AS status, CASE WHEN action = 'decision' AND tn <> '' THEN tn ELSE pm.note END AS note FROM pm LEFT JOIN pa ON pa.id = pm.id""",
}
