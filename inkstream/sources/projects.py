"""Project folders, alignments and recognisers' words: JSON files that Spark lists and reads, with explicit schemas. A file that
does not hold is a row with what is wrong, and a chapter without script or alignment is an empty one, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SCHEMA = "text string, start double, end double, confidence double"
PICKUP_SCHEMA = "id string, t_start double, t_end double, expected string, heard string, kind string, seat string, status string, confidence double, note string"
CHAPTER_SCHEMA = "id string, index int, title string, text_path string, audio_path string, alignment_path string, open_pickups int, word_count long, author_status string"
PROJECT_SCHEMA = f"schema int, id string, name string, mode string, people array<struct<id string, name string, role string>>, chapters array<struct<{CHAPTER_SCHEMA}>>, updated_at string"
ALIGNMENT_SCHEMA = f"transcript array<struct<{WORD_SCHEMA}>>, pickups array<struct<{PICKUP_SCHEMA}>>"
#: What may stand in a pickup.
KINDS, STATUSES = ("skip", "insert", "sub", "pause"), ("open", "done", "ignored")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, and the file's fields; broken is the file's text where it is no such JSON."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = rows.withColumn("j", F.from_json("value", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    return parsed.select("path", "j.*").withColumnRenamed("_broken", "broken")


def broken_rules(rules: dict[str, Column]) -> Column:
    """The names of the rules that do not hold; null does not hold."""
    return F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """path, transcript, pickups, errors of alignment files: words in order of time, pickups with ids of their own and known kinds."""
    rows = _json(spark, path, ALIGNMENT_SCHEMA)
    w, p = F.coalesce("transcript", F.array().cast(f"array<struct<{WORD_SCHEMA}>>")), F.coalesce("pickups", F.array().cast(f"array<struct<{PICKUP_SCHEMA}>>"))
    ordered = F.forall(F.sequence(F.lit(0), F.size(w)), lambda i: (i == 0) | (i >= F.size(w)) | (F.get(w, i)["start"] >= F.get(w, i - 1)["start"]))
    rules = {
        "json": F.col("broken").isNull(),
        "words": F.forall(w, lambda x: F.coalesce((x["text"] != "") & (x["start"] >= 0) & (x["end"] >= x["start"]), F.lit(False))),
        "order": ordered,
        "ids": F.size(F.array_distinct(F.transform(p, lambda x: x["id"]))) == F.size(p),
        "pickups": F.forall(p, lambda x: F.coalesce(x["kind"].isin(*KINDS) & x["status"].isin(*STATUSES) & (x["t_end"] >= x["t_start"]), F.lit(False))),
    }
    return rows.select("path", w.alias("transcript"), p.alias("pickups"), broken_rules(rules).alias("errors"))


def projects(spark: SparkSession, path: str) -> DataFrame:
    """path, the project's fields and errors of project files: version, chapters with ids, numbers and paths of their own, people's
    names once, safe paths."""
    rows = _json(spark, path, PROJECT_SCHEMA)
    c, people = F.coalesce("chapters", F.array().cast(f"array<struct<{CHAPTER_SCHEMA}>>")), F.coalesce("people", F.array().cast("array<struct<id string, name string, role string>>"))
    once = lambda xs, field: F.size(F.array_distinct(F.transform(xs, lambda x: F.lower(x[field].cast("string"))))) == F.size(xs)
    safe = lambda p: p.isNull() | ~p.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|\\")
    rules = {
        "json": F.col("broken").isNull(), "schema": F.col("schema") == 1, "id": F.col("id").rlike(r"^[A-Za-z0-9_-]+$"), "chapter ids": once(c, "id"), "chapter numbers": once(c, "index"), "names": once(people, "name"),
        "paths": F.forall(c, lambda x: safe(x["text_path"]) & safe(x["audio_path"]) & safe(x["alignment_path"])),
    }
    return rows.withColumns({"chapters": c, "people": people, "errors": broken_rules(rules)}).drop("broken")


def chapters_of(projects: DataFrame) -> DataFrame:
    return projects.select("path", F.col("id").alias("book_id"), F.explode("chapters").alias("c")).select("path", "book_id", F.col("c.id").alias("chapter_id"), *[f"c.{f.split()[0]}" for f in CHAPTER_SCHEMA.split(", ")[1:]])


def book_chapters(projects: DataFrame, scripts: DataFrame, alignments: DataFrame) -> DataFrame:
    """book_id, chapter_id, index, title, text, heard of a whole book, in any order: a chapter whose script is missing has an empty
    text, one whose alignment is missing or broken has no words. scripts: path, text; paths end with the chapter's own."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    rows = chapters_of(projects).withColumns({"_text": F.concat(folder, "text_path"), "_align": F.concat(folder, "alignment_path")})
    words = alignments.where(F.size("errors") == 0).select(F.col("path").alias("_align"), F.col("transcript").alias("heard"))
    met = rows.join(scripts.select(F.col("path").alias("_text"), "text"), "_text", "left").join(words, "_align", "left")
    return met.select("book_id", "chapter_id", "index", "title", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("heard", F.array().cast(f"array<struct<{WORD_SCHEMA}>>")).alias("heard"))


def project_json(chapters: DataFrame, book: str, order: str) -> DataFrame:
    """book, json: a project file of each book, chapters in order; what `projects` reads."""
    rows = chapters.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("int").alias("index"), "id", "title", "text_path", "audio_path"))).alias("chapters"))
    return rows.select(book, F.to_json(F.struct(F.lit(1).alias("schema"), F.col(book).cast("string").alias("id"), "chapters")).alias("json"))


def recognised_words(lines: DataFrame, line: str = "line") -> DataFrame:
    """The other columns, seq, text, start, end, confidence of recognisers' output lines: segments with words, or a list of words."""
    word = "array<struct<word string, text string, start double, end double, probability double, confidence double>>"
    parsed = lines.withColumn("_j", F.from_json(line, f"words {word}, segments array<struct<words {word}>>"))
    words = F.coalesce(F.flatten(F.transform("_j.segments", lambda s: F.coalesce(s["words"], F.array().cast(word)))), F.col("_j.words"), F.array().cast(word))
    each = parsed.select(*[c for c in lines.columns if c != line], F.posexplode(words).alias("seq", "w"))
    said = F.trim(F.coalesce("w.text", "w.word", F.lit("")))
    rows = each.select(*[c for c in each.columns if c != "w"], said.alias("text"), "w.start", "w.end", F.coalesce("w.confidence", "w.probability").alias("confidence"))
    return rows.where("text <> '' and start is not null and end >= start")
