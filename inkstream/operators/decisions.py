"""Decision tables over pickups, recordings and chapters: which recording a pickup is timed on, what to play, what is left to do.

All of them are column expressions, so they run wherever the rows are and join nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")
#: What a tight selection is drawn in by at most (seconds, share), least and most seconds of a kept tape.
INSET, INSET_SHARE, TAPE = 0.04, 0.2, (0.3, 7200.0)
#: The ranges and defaults of settings.
SETTINGS = {"pause_seconds": (2.0, 12.0, 4.0), "target_rms": (-23.0, -18.0, -20.0), "min_confidence": (0.0, 0.9, 0.0)}
#: What a seat pack leaves out of a chapter.
PACK_LACKS = ("audio_path", "raw_audio_path", "edited_audio_path", "overdub_audio_path", "duet_mix_path", "n1_stem_path", "n2_stem_path", "traffic_light", "open_pickups", "notes_path")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INFINITY)


def seconds(c: Column) -> Column:
    """A time that can be played: not negative, to a microsecond; 0 for what is no number."""
    return F.when(finite(c), F.round(F.greatest(c, F.lit(0.0)), 6)).otherwise(0.0)


def _range(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def exact_range(start: Column, end: Column) -> Column:
    return _range(seconds(start), F.greatest(seconds(start), seconds(end)))


def tight_range(start: Column, end: Column) -> Column:
    """Drawn in at both ends, as a neighbour's sound may reach over a word's edge."""
    r = exact_range(start, end)
    inset = F.least(F.lit(INSET), (r["end"] - r["start"]) * INSET_SHARE)
    return _range(F.round(r["start"] + inset, 6), F.round(r["end"] - inset, 6))


def context_range(start: Column, end: Column, pad: float = 0.5) -> Column:
    r = exact_range(start, end)
    return _range(F.round(F.greatest(F.lit(0.0), r["start"] - pad), 6), F.round(r["end"] + pad, 6))


def lead_in_range(start: Column, lead: float) -> Column:
    return _range(F.round(F.greatest(F.lit(0.0), seconds(start) - lead), 6), seconds(start))


def reached_end(now: Column, end: Column, tolerance: float = 0.005) -> Column:
    return finite(now) & finite(end) & (now >= end - tolerance)


def line_bounds(t_start: Column, t_end: Column, line_start: Column, line_end: Column) -> Column:
    """(start, end, word_only): the recorded line if it is one, else the words alone."""
    line = finite(line_start) & finite(line_end) & F.coalesce(line_end > line_start, F.lit(False))
    zero = F.lit(0.0)
    return F.struct(F.greatest(zero, F.when(line, line_start).otherwise(t_start)).alias("start"), F.when(line, line_end).otherwise(F.greatest(zero, t_end)).alias("end"), (~line).alias("word_only"))


def audio_source(kind: Column, caught_live: Column, take: Column, tape: Column) -> Column:
    """Whose clock a pickup is on: that of the tape or of the take; null where that recording is missing."""
    live = F.coalesce(kind == "live", F.lit(False)) | caught_live
    return F.when(live, F.when(tape, "live")).when(F.coalesce(kind == "take", F.lit(False)) & ~take, F.lit(None)).when(take, "take").when(tape, "live")


def listen_block(kind: Column, caught_live: Column, take: Column, tape: Column) -> Column:
    """Why a pickup cannot be heard; null if it can."""
    return F.when(audio_source(kind, caught_live, take, tape).isNull(), F.when(caught_live, "no tape").otherwise("no take"))


def punch_block(kind: Column, caught_live: Column, take: Column, tape: Column, same_file: Column) -> Column:
    """Why a pickup cannot be recorded over yet; null if it can."""
    return (
        F.when(kind == "live", F.when(~tape, "no tape").when(take & ~same_file, "take is another recording"))
        .when((kind == "take") & ~take, "no take")
        .when(caught_live, F.when(take, "check the take first").otherwise("attach a take first"))
        .when(~take & ~tape, "no take")
    )


def proof_source(preference: Column, take: Column, tape: Column) -> Column:
    """What a check listens to: the preferred recording if it is there, else the take, else the tape."""
    return F.when((preference == "live") & tape, "live").when((preference == "take") & take, "take").when(take, "take").when(tape, "live")


def keeps_tape(samples: Column, rate: Column) -> Column:
    return F.coalesce((rate > 0) & (samples > 0) & F.try_divide(samples, rate).between(*TAPE), F.lit(False))


def chapter_status(has_audio: Column, open_pickups: Column) -> Column:
    """(label, tone) of a chapter; open_pickups is null before a check."""
    label = F.when(~has_audio, "to record").when(open_pickups > 0, F.concat(open_pickups.cast("string"), F.when(open_pickups == 1, " pickup").otherwise(" pickups"))).when(open_pickups == 0, "proofed").otherwise("recorded")
    tone = F.when(~has_audio, "idle").when(open_pickups > 0, "review").when(open_pickups == 0, "ready").otherwise("recorded")
    return F.struct(label.alias("label"), tone.alias("tone"))


def matching_chapters(chapters: DataFrame, query: str, index: str = "index", title: str = "title") -> DataFrame:
    """Chapters whose title holds the query, whose number is it, or whose number of two digits holds it."""
    q = query.strip().lower()
    number = F.col(index).cast("string")
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return chapters if not q else chapters.where(F.contains(F.lower(title), F.lit(q)) | (number == q) | F.contains(padded, F.lit(q)))


def setting(c: Column, name: str) -> Column:
    """A setting within its range; its default where it is no number. Nothing is rejected."""
    low, high, default = SETTINGS[name]
    return F.when(finite(c), F.greatest(F.lit(low), F.least(F.lit(high), c))).otherwise(default)


def may(people: Column, action: str) -> Column:
    """Whether a project's people (array of role and name) may do something: notes and approval are the author's; an identity
    can be claimed while there are no people, or one author only."""
    author = F.exists(people, lambda p: p["role"] == "author")
    if action in ("note", "approve"):
        return F.coalesce(author, F.lit(False))
    return (F.size(people) == 0) | (F.size(F.filter(people, lambda p: p["role"] == "author")) == 1)


def comparisons(punches: DataFrame) -> DataFrame:
    """Sides of each usable punch: the untouched recording and its replacement. punches: id, chapter_id, path, raw_path,
    audio_path, t_start, t_end, verification, edit, created_at."""
    good = (F.col("path") != "") & finite(F.col("t_start")) & finite(F.col("t_end")) & (F.col("t_start") >= 0) & (F.col("t_end") > F.col("t_start"))
    original = F.coalesce(F.nullif("raw_path", F.lit("")), F.nullif("audio_path", F.lit("")))
    rows = punches.where(good).select(
        "chapter_id", "id", original.alias("original_path"), F.col("path").alias("replacement_path"), "t_start", "t_end",
        F.coalesce("verification", F.lit("needs_verification")).alias("verification"), F.coalesce("edit", F.lit("applied")).alias("edit"), "created_at",
    )
    return rows.where("original_path is not null")


def advanced(tasks: DataFrame, start: float | Column, end: float | Column, delta: float | Column, done: Column) -> DataFrame:
    """What one applied punch does to the tasks of a session (task columns and start, end): its own are done, those that it
    overlaps are superseded, later ones move by the change of length."""
    start, end, delta = (x if isinstance(x, Column) else F.lit(x) for x in (start, end, delta))
    later = F.col("start") >= end
    state = F.when(done, "done").when((F.col("start") < end) & (F.col("end") > start), "superseded").otherwise("left")
    moved = F.when((state == "left") & later, delta).otherwise(0.0)
    return tasks.withColumns({"state": state, "start": F.col("start") + moved, "end": F.col("end") + moved})


def recording_seconds(started: Column, now: Column, pauses: Column) -> Column:
    """Time from start to now without the pauses (array of start and end; an open pause has no end)."""
    held = F.aggregate(pauses, F.lit(0.0), lambda acc, p: acc + F.greatest(F.lit(0.0), F.least(F.coalesce(p["end"], now), now) - F.greatest(p["start"], started)))
    return F.greatest(F.lit(0.0), now - started - held)
