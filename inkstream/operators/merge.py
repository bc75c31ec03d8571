"""Merging two independently edited copies of a project, entity by entity: one row for each thing that happens.

Plans are joins on ids (spellings for names); applying one is a join again. A person's decision is never overwritten: what
both sides have changed is a conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = ("kind", "action", "key", "mine", "theirs")


def _rows(df: DataFrame, kind: str, action: Column, key: str, mine: str, theirs: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    found = df.select(F.lit(kind).alias("kind"), action.alias("action"), text(key).alias("key"), text(mine).alias("mine"), text(theirs).alias("theirs"))
    return found.where(F.col("action").isNotNull())


def _sides(mine: DataFrame, theirs: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    side = lambda df, p: df.select(key, F.lit(True).alias(p), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return side(theirs, "t").join(side(mine, "m"), key, "left")


def chapter_plan(mine: DataFrame, theirs: DataFrame, key: str = "chapter_id") -> DataFrame:
    """What their chapters change: columns script, audio, aligned, status, updated_at.

    unknown: not here; script: texts differ; adopt / adopt-proof: their recording where there is none here, with their check
    where there is none here; audio: two recordings; status: theirs is newer; status-conflict: it is not, or no time is known."""
    both = _sides(mine, theirs, key, ("script", "audio", "aligned", "status", "updated_at")).withColumn("none", F.lit(None).cast("string"))
    here = F.col("m").isNotNull()
    taken = F.col("t_audio").isNotNull() & F.col("m_audio").isNull()
    newer = F.coalesce(F.col("t_updated_at") > F.col("m_updated_at"), F.lit(False))
    parts = [
        _rows(both, "chapter", F.when(~here, "unknown"), key, "none", "none"),
        _rows(both, "chapter", F.when(here & (F.col("m_script") != F.col("t_script")), "script"), key, "none", "none"),
        _rows(both, "chapter", F.when(here & taken, F.when(F.col("t_aligned") & ~F.col("m_aligned"), "adopt-proof").otherwise("adopt")).when(here & (F.col("t_audio") != F.col("m_audio")), "audio"), key, "m_audio", "t_audio"),
        _rows(both, "chapter", F.when(here & F.col("t_status").isNotNull() & ~F.col("t_status").eqNullSafe(F.col("m_status")), F.when(newer, "status").otherwise("status-conflict")), key, "m_status", "t_status"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pickup_plan(mine: DataFrame, theirs: DataFrame, key: str = "id") -> DataFrame:
    """What their decisions change: columns status, note. decision: mine is open and has no note; conflict: both decided otherwise."""
    both = _sides(mine, theirs, key, ("status", "note"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    same = (F.col("m_status") == F.col("t_status")) & (blank(F.col("m_note")) == blank(F.col("t_note")))
    untouched = (F.col("m_status") == "open") & (blank(F.col("m_note")) == "")
    action = F.when(F.col("m").isNull(), "unknown").when(same, F.lit(None)).when(untouched, "decision").when((F.col("m_status") != F.col("t_status")) & (F.col("t_status") != "open"), "conflict")
    return _rows(both, "pickup", action, key, "m_status", "t_status")


def note_plan(mine: DataFrame, theirs: DataFrame, chapters: DataFrame, key: str = "note_id", chapter: str = "chapter_id") -> DataFrame:
    """Their notes that are not here: add, or orphan if their chapter is not."""
    new = theirs.join(mine.select(key), key, "left_anti").join(chapters.select(chapter, F.lit(True).alias("_here")).distinct(), chapter, "left")
    return _rows(new.withColumn("none", F.lit(None).cast("string")), "note", F.when(F.col("_here"), "add").otherwise("orphan"), key, "none", chapter)


def glossary_plan(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Their names, by spelling: add, or fill a respelling or a voice note that is blank here. Columns spelling, respell, note."""
    keyed = lambda df: df.withColumn("word", F.lower(F.trim("spelling")))
    both = _sides(keyed(mine).dropDuplicates(["word"]), keyed(theirs), "word", ("spelling", "respell", "note"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    out = _rows(both, "glossary", F.when(F.col("m").isNull(), "add"), "word", "m_spelling", "t_spelling")
    for c in ("respell", "note"):
        out = out.unionByName(_rows(both, "glossary", F.when(F.col("m").isNotNull() & ~blank(f"t_{c}") & blank(f"m_{c}"), c), "word", f"m_{c}", f"t_{c}"))
    return out


def counted(plan: DataFrame) -> DataFrame:
    return plan.groupBy("kind", "action").agg(F.count(F.lit(1)).alias("n"))


def described(plan: DataFrame) -> DataFrame:
    """One sentence of a plan: what comes in, in order, and how many conflicts there are."""
    incoming = {("note", "add"): "notes", ("glossary", "add"): "names", ("pickup", "decision"): "decisions", ("chapter", "adopt"): "recordings", ("chapter", "status"): "states"}
    n = lambda on: F.count_if(on)
    is_ = lambda k, a: (F.col("kind") == k) & F.startswith("action", F.lit(a)) & ~F.contains("action", F.lit("conflict"))
    counts = plan.agg(*[n(is_(*k)).alias(name) for k, name in incoming.items()], n(F.contains("action", F.lit("conflict")) | F.col("action").isin("script", "audio")).alias("conflicts"))
    parts = F.filter(F.array(*[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {c}"))) for c in (*incoming.values(), "conflicts")]), lambda x: x.isNotNull())
    return counts.select(F.when(F.size(parts) == 0, "nothing to merge").otherwise(F.array_join(parts, ", ")).alias("sentence"))


def with_decisions(mine: DataFrame, theirs: DataFrame, plan: DataFrame, key: str = "id") -> DataFrame:
    """mine with the decisions of a plan: status and note of theirs where the plan says so."""
    wanted = plan.where("kind = 'pickup' and action = 'decision'").select(F.col("key").alias("_key"))
    new = theirs.select(F.col(key).cast("string").alias("_key"), F.col("status").alias("_status"), F.col("note").alias("_note")).join(wanted, "_key", "left_semi")
    met = mine.join(new, F.col(key).cast("string") == F.col("_key"), "left")
    return met.withColumns({"status": F.coalesce("_status", "status"), "note": F.coalesce("_note", "note")}).select(*mine.columns)
