"""Roll-ups of chapters and pickups, spans, merge plans and exports: joins and groupings that Catalyst plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstream.functions.text import WORDS_PER_HOUR, marker_label, spoken_pieces
from inkstream.functions.timecode import minutes_seconds, subtitle_time
from inkstream.operators.idioms import Scan, scan

KINDS = ("skip", "insert", "sub", "pause")


def pickup_summary(pickups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, open, resolved and the open ones of each kind."""
    is_open = F.col("status") == "open"
    return pickups.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_open).alias("open"),
        F.count_if(~is_open).alias("resolved"),
        *[F.count_if(is_open & (F.col("kind") == k)).alias(f"open_{k}") for k in KINDS],
    )


def repeated(pickups: DataFrame, chapter: str) -> DataFrame:
    """word, count, chapters: what more than one open pickup is about, by its spoken pieces; of what is written, else of what is
    heard. word is the least way it is written."""
    source = F.when(F.trim("expected") != "", F.trim("expected")).otherwise(F.trim("heard"))
    keyed = pickups.where("status = 'open'").select(F.array_join(spoken_pieces(source), " ").alias("pieces"), source.alias("word"), chapter).where("pieces <> ''")
    counted = keyed.groupBy("pieces").agg(F.min("word").alias("word"), F.count(F.lit(1)).alias("count"), F.count_distinct(chapter).alias("chapters"))
    return counted.where("count > 1").drop("pieces")


def worklist(pickups: DataFrame, chapters: DataFrame, key: str, number: str) -> DataFrame:
    """Open pickups of all chapters in the order they are worked off: at, key, and the pickup's columns."""
    rows = pickups.where("status = 'open'").join(chapters.select(key, number), key)
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(number).orderBy("t_start", "id")))


def unchecked(chapters: DataFrame, checked: DataFrame, key: str, has_audio: str) -> DataFrame:
    """Chapters that have a recording and no check."""
    return chapters.where(F.col(has_audio)).join(checked.select(key).distinct(), key, "left_anti")


def book_progress(chapters: DataFrame, book: str) -> DataFrame:
    """chapters, words, finished hours, proofed chapters, share done and the light of each book. chapters: words, has_audio, open."""
    proofed = F.col("has_audio") & (F.col("open") == 0)
    return chapters.groupBy(book).agg(
        F.count(F.lit(1)).alias("chapters"),
        F.round(F.sum("words") / WORDS_PER_HOUR, 6).alias("hours"),
        F.count_if(F.col("has_audio")).alias("recorded"),
        F.count_if(proofed).alias("proofed"),
        F.round(F.avg((F.col("has_audio").cast("int") + proofed.cast("int")) / 2), 6).alias("done"),
        F.when(F.bool_or(F.col("has_audio") & (F.col("open") > 0)), "yellow").when(F.bool_and(proofed), "green").otherwise("red").alias("light"),
    )


def merge_plan(mine: DataFrame, theirs: DataFrame, key: str, status: str, changed: str) -> DataFrame:
    """key, action: what merging two independently edited copies does to each row.

    add: only theirs; keep: only mine, or both alike; take: mine is open, or theirs is newer; stay: mine is newer;
    conflict: they differ and neither is newer (an unreadable time is never newer)."""
    side = lambda df, p: df.select(key, F.col(status).alias(f"{p}_status"), F.col(changed).alias(f"{p}_at"), F.lit(True).alias(p))
    both = side(mine, "mine").join(side(theirs, "theirs"), key, "full_outer")
    same = F.col("mine_status").eqNullSafe(F.col("theirs_status"))
    return both.withColumn(
        "action",
        F.when(F.col("mine").isNull(), "add")
        .when(F.col("theirs").isNull() | same, "keep")
        .when(F.col("mine_status") == "O", "take")
        .when(F.col("theirs_at") > F.col("mine_at"), "take")
        .when(F.col("mine_at") > F.col("theirs_at"), "stay")
        .otherwise("conflict"),
    )


def applied(plan: DataFrame, key: str, status: str, changed: str) -> DataFrame:
    """The merged rows of a plan; a conflict stays as mine."""
    taken = F.col("action").isin("add", "take")
    return plan.select(key, F.when(taken, F.col("theirs_status")).otherwise(F.col("mine_status")).alias(status), F.when(taken, F.col("theirs_at")).otherwise(F.col("mine_at")).alias(changed))


def violations(rows: DataFrame, table: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """(table, key, rule) of each row that breaks a rule; a rule that gives null is broken."""
    broken = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(name)) for name, rule in rules.items()])
    found = rows.select(F.col(key).cast("string").alias("key"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))
    return found.select(F.lit(table).alias("table"), "key", "rule")


def repeated_keys(rows: DataFrame, table: str, *keys: str) -> DataFrame:
    """(table, key, rule) of each key that more than one row has; of several columns the key is their values, joined by a colon."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.select(F.lit(table).alias("table"), (F.concat_ws(":", *[F.col(k).cast("string") for k in keys]) if len(keys) > 1 else F.col(keys[0]).cast("string")).alias("key"), F.lit("unique").alias("rule"))


def orphans(rows: DataFrame, table: str, key: str, parents: DataFrame, parent: str) -> DataFrame:
    lost = rows.join(parents.select(F.col(parent).alias(key)).distinct(), key, "left_anti")
    return lost.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("key"), F.lit("parent").alias("rule"))


def export_readiness(chapters: DataFrame, book: str, has_audio: str) -> DataFrame:
    counted = chapters.groupBy(book).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(has_audio)).alias("attached"))
    return counted.withColumns({"missing": F.col("total") - F.col("attached"), "ready": (F.col("total") > 0) & (F.col("total") == F.col("attached"))})


def compared(before: DataFrame, after: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """key, check, before, after, outcome: a row for each check of two reports of a file, each report a column `check` with
    its status and one `check`_value with what was measured.

    outstanding: it fails or warns now; unjudged: there is no limit; fixed: it failed or warned before; adjusted: its value
    moved; held: it did not."""
    def long(df: DataFrame, name: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias(name), F.col(f"{c}_value").alias(f"{name}_value")) for c in checks])
        return df.select(key, F.explode(rows).alias("r")).select(key, "r.*")

    both = long(after, "after").join(long(before, "before"), [key, "check"], "left")
    bad = lambda c: F.coalesce(F.col(c).isin("fail", "warn"), F.lit(False))
    moved = F.coalesce(F.col("before_value") != F.col("after_value"), F.lit(False))
    return both.withColumn("outcome", F.when(bad("after"), "outstanding").when(F.col("after") == "unspecified", "unjudged").when(bad("before"), "fixed").when(moved, "adjusted").otherwise("held"))


#: How much an outcome weighs where files of one check differ.
SEVERITY = {"outstanding": 4, "fixed": 3, "adjusted": 2, "held": 1, "unjudged": 0}


def fix_summary(changes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, check, outcome (the worst of all files), files (that have it), of_files (that can be compared), low, high (of the
    values after, of those files)."""
    weight = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])[F.col("outcome")]
    graded = changes.withColumn("_w", weight)
    top = F.max("_w").over(Window.partitionBy(*keys, "check"))
    comparable = F.when((F.col("_top") == SEVERITY["outstanding"]) | F.col("before").isNotNull(), 1)
    speaks = F.col("_w") == F.col("_top")
    return graded.withColumn("_top", top).groupBy(*keys, "check").agg(
        F.max_by("outcome", "_w").alias("outcome"), F.count_if(speaks).alias("files"), F.count(comparable).alias("of_files"),
        F.min(F.when(speaks, F.col("after_value"))).alias("low"), F.max(F.when(speaks, F.col("after_value"))).alias("high"),
    )


class _Joined(Scan):
    """Intervals in order; one that overlaps the clip before joins it, unless that grows too long."""

    def __init__(self, most: float):
        self.most, self.open, self.number = most, None, 0

    def feed(self, a: float, z: float) -> list[tuple]:
        if self.open and a <= self.open[0][1] and z - self.open[0][0] <= self.most:
            (first, last), n = self.open
            self.open = (first, max(last, z)), n + 1
            return []
        done, self.open = self.close(), ((a, z), 1)
        return done

    def close(self) -> list[tuple]:
        if not self.open:
            return []
        self.number += 1
        return [(self.number, *self.open[0], self.open[1])]


def clips(pickups: DataFrame, keys: list[str], pad: float = 2.0, most: float = 30.0, duration: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """keys, number, name, clip_start, clip_end, pickups: padded pickups as clips. One that overlaps the clip before joins it if
    the clip then still is at most `most` seconds; this depends on the order, so a chapter's intervals stream through a fold that
    holds one clip. Ends are held to the duration, if there is one."""
    span = [F.greatest(F.lit(0.0), F.col("t_start") - pad), F.greatest("t_start", "t_end") + pad]
    span[1] = span[1] if duration is None else F.least(span[1], duration)
    rows = pickups.where(span[1] > span[0]).withColumns({"_a": span[0].cast("double"), "_z": span[1].cast("double")})
    found = scan(rows, keys, ["t_start", "t_end", *ties], ["_a", "_z"], lambda: _Joined(most), "number int, a double, z double, pickups int")
    whole = F.floor("a").cast("int")
    name = F.format_string("%03d_%02d-%02d-%02d", F.col("number"), F.floor(whole / 3600).cast("int"), F.floor(whole / 60).cast("int") % 60, whole % 60)
    return found.select(*keys, "number", name.alias("name"), F.round("a", 3).alias("clip_start"), F.round("z", 3).alias("clip_end"), "pickups")


def chapter_runs(rows: DataFrame, key: str, number: str) -> DataFrame:
    """key, first, last of each run of consecutive numbers (1–3, 5)."""
    w = Window.partitionBy(key).orderBy(number)
    runs = rows.select(key, number).distinct().withColumn("_run", F.col(number) - F.row_number().over(w))
    return runs.groupBy(key, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_run")


def eligible(pickups: DataFrame, keys: list[str], ignored: bool = False) -> DataFrame:
    """Pickups that markers are made of, numbered in order of start, then id: none without a finite time, ignored ones if asked for."""
    finite = (F.abs("t_start") < F.lit(float("inf"))) & (F.abs("t_end") < F.lit(float("inf"))) & (F.lit(ignored) | (F.col("status") != "ignored"))
    return pickups.where(finite).withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("t_start", "id")))


def csv_field(c: Column) -> Column:
    """On one line, quoted if it holds a comma or a quote."""
    flat = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\r?\n", " ")
    return F.when(flat.rlike('[",]'), F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(flat)


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


#: Fixed values of the formats: what stands above the rows of each kind of file.
MARKER_HEADERS = {"labels": None, "regions": "#,Name,Start,End,Length,Color", "markers": "Name\tStart\tDuration\tTime Format\tType\tDescription", "subtitles": None, "pickups": "#,Start (s),End (s),Start (timecode),Kind,Seat,Status,Expected,Heard,Confidence,Note"}


def marker_lines(pickups: DataFrame, keys: list[str]) -> DataFrame:
    """Each eligible pickup in five formats: label track, region row, marker row, subtitle cue, table row.

    pickups: keys, id, t_start, t_end, kind, status, expected, heard, seat, confidence, note."""
    zero, start, end = F.lit(0.0), F.col("t_start"), F.col("t_end")
    length, three = F.greatest(zero, end - start), lambda c: F.format_string("%.3f", F.greatest(zero, c))
    rows = eligible(pickups, keys).withColumn("label", marker_label(F.col("expected"), F.col("heard"), F.col("kind")))
    number = F.col("number").cast("string")
    clock = F.regexp_replace(subtitle_time(F.greatest(zero, start)), ",", ".")
    return rows.select(
        *keys,
        "number",
        F.concat_ws("\t", three(start), three(end), F.col("label")).alias("label_track"),
        F.concat_ws(",", F.concat(F.lit("R"), number), csv_field(F.col("label")), three(start), three(end), three(length), F.lit("")).alias("region_row"),
        F.concat_ws("\t", F.col("label"), minutes_seconds(F.greatest(zero, start)), minutes_seconds(length), F.lit("decimal"), F.lit("Cue"), one_line(F.col("note"))).alias("marker_row"),
        F.concat_ws("\n", number, F.concat(subtitle_time(start), F.lit(" --> "), subtitle_time(F.greatest(end, start + 0.5))), F.col("label")).alias("subtitle"),
        F.concat_ws(",", number, three(start), three(end), clock, *[csv_field(F.col(c)) for c in ("kind", "seat", "status", "expected", "heard")], F.coalesce(F.format_string("%.2f", "confidence"), F.lit("")), csv_field(one_line(F.col("note")))).alias("table_row"),
    )


def marker_files(lines: DataFrame, keys: list[str], base: Column) -> DataFrame:
    """keys, file, content of the five files of each chapter. lines: as marker_lines gives them, no more than a chapter's pickups."""
    safe = F.regexp_replace(base, "(?i)[^a-z0-9_-]+", "_")
    kinds = {"labels": ("label_track", "txt"), "regions": ("region_row", "csv"), "markers": ("marker_row", "csv"), "subtitles": ("subtitle", "srt"), "pickups": ("table_row", "csv")}
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("number", c))), lambda r: r[c])
    whole = lines.groupBy(*keys).agg(*[ordered(c).alias(k) for k, (c, _) in kinds.items()])

    def content(kind: str) -> Column:
        head, between = MARKER_HEADERS[kind], "\n\n" if kind == "subtitles" else "\n"
        return F.concat(F.lit(f"{head}\n" if head else ""), F.array_join(kind, between), F.lit("\n"))

    files = F.array(*[F.struct(F.concat(safe, F.lit(f"_{k}.{end}")).alias("file"), content(k).alias("content")) for k, (_, end) in kinds.items()])
    return whole.select(*keys, F.explode(files).alias("f")).select(*keys, "f.*")


def proof_report(pickups: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the counts that head a chapter's report: open, resolved, ignored, word changes, long pauses."""
    n = lambda c: F.count_if(c)
    status, pause = F.col("status"), F.col("kind") == "pause"
    return pickups.groupBy(*keys).agg(n(status == "open").alias("open"), n(status == "done").alias("resolved"), n(status == "ignored").alias("ignored"), n(~pause).alias("word_changes"), n(pause).alias("long_pauses"))


def report_rows(pickups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, number, row: each pickup as a row of a report's table, in order."""
    cell = lambda c: F.replace(one_line(F.when((c.isNull()) | (c == ""), "—").otherwise(c)), F.lit("|"), F.lit("\\|"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("t_start", "id"))
    percent = F.concat(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))) * 100 + 0.5).cast("string"), F.lit("%"))
    rows = pickups.withColumn("number", number)
    cells = [F.col("number").cast("string"), minutes_seconds(F.col("t_start")), *[cell(F.col(c)) for c in ("kind", "status", "expected", "heard")], percent, cell(F.col("note"))]
    return rows.select(*keys, "number", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))


def export_plan(chapters: DataFrame, book: str, number: str, audio: str, extension: str = "mp3", opening: bool = True, closing: bool = True, sample: bool = True) -> DataFrame:
    """book, file, kind, number, source: what a delivery pack holds, in order of names. The sample is of the first chapter."""
    two = F.lpad(F.col(number).cast("string"), F.greatest(F.lit(2), F.length(F.col(number).cast("string"))), F.lit("0"))
    rows = chapters.select(book, F.concat(two, F.lit("_chapter_"), two, F.lit(f".{extension}")).alias("file"), F.lit("chapter").alias("kind"), F.col(number).alias("number"), F.col(audio).alias("source"))
    books = chapters.groupBy(book).agg(F.min_by(number, number).alias("number"), F.min_by(audio, number).alias("source"))
    for wanted, name, kind in ((opening, "00_opening_credits", "opening_credits"), (closing, "98_closing_credits", "closing_credits"), (sample, "99_retail_sample", "retail_sample")):
        if wanted:
            own = (F.col("number"), F.col("source")) if kind == "retail_sample" else (F.lit(None).cast("int"), F.lit(None).cast("string"))
            rows = rows.unionByName(books.select(book, F.lit(f"{name}.{extension}").alias("file"), F.lit(kind).alias("kind"), own[0].alias("number"), own[1].alias("source")))
    return rows


def reveal_target(files: DataFrame, book: str, name: str, order: str) -> DataFrame:
    """book, target: the first sound file of a pack, else its first file."""
    top = ~F.contains(F.col(name), F.lit("/")) & (F.col(name) != "")
    sound = F.col(name).rlike(r"(?i)\.(mp3|wav|flac|m4a|aiff?)$")
    return files.where(top).groupBy(book).agg(F.coalesce(F.min_by(F.when(sound, F.col(name)), F.when(sound, F.col(order))), F.min_by(name, order)).alias("target"))


def share_paths(paths: DataFrame, referenced: DataFrame, light: bool, path: str = "path") -> DataFrame:
    """The paths that go into a shared pack, once each: nothing local or half written; a light pack has no exports, and raw takes
    only where a chapter refers to them."""
    clean = paths.select(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "").alias(path)).where(~F.col(path).rlike(r"(^|/)\.|\.(tmp|part|lock)$")).distinct()
    if not light:
        return clean
    raw = F.col(path).startswith("raw/")
    used = referenced.select(F.col(path)).distinct()
    slim = clean.where(~F.col(path).startswith("export/"))
    return slim.where(~raw).union(slim.where(raw).join(used, path, "left_semi"))


def shifted(words: DataFrame, edits: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Words of a take after its punches: those inside a replaced range go, later ones move by the sum of the changes before.

    edits: keys, t_start, t_end (of the take as it was; disjoint), delta. One sorted union, no range join."""
    marks = edits.select(*keys, F.col("t_start").alias(at), F.col("t_end").alias("_until"), F.lit(0.0).alias("_delta"), F.lit(0).alias("_side"))
    ends = edits.select(*keys, F.col("t_end").alias(at), F.lit(None).cast("double").alias("_until"), F.col("delta").alias("_delta"), F.lit(1).alias("_side"))
    both = words.withColumns({"_until": F.lit(None).cast("double"), "_delta": F.lit(0.0), "_side": F.lit(2)})
    both = both.unionByName(marks, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    so_far = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    moved = both.withColumns({"_cut": F.max("_until").over(so_far), "_by": F.sum("_delta").over(so_far)}).where("_side = 2")
    return moved.where(F.col("_cut").isNull() | (F.col(at) >= F.col("_cut"))).withColumn(at, F.col(at) + F.col("_by")).select(*words.columns)


def runs_text(numbers: Column) -> Column:
    """Numbers as a guide prints them: 1–3, 5."""
    ordered = F.array_sort(F.array_distinct(numbers))
    starts = F.filter(ordered, lambda n, i: (i == 0) | (n != F.get(ordered, i - 1) + 1))
    ends = F.filter(ordered, lambda n, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1) != n + 1))
    one = lambda a, z: F.when(a == z, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("–"), z.cast("string")))
    return F.array_join(F.zip_with(starts, ends, one), ", ")


def guide_lines(rows: DataFrame) -> DataFrame:
    """section (decided or undecided), number, line of a pronunciation guide: names with a respelling first, the most frequent first
    in either section. rows: spelling, respell, count, chapters (array of numbers)."""
    cell = lambda c: F.replace(one_line(c), F.lit("|"), F.lit("\\|"))
    known = F.trim(F.coalesce("respell", F.lit(""))) != ""
    section = F.when(known, "decided").otherwise("undecided")
    number = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("count"), "spelling"))
    cells = [cell(F.col("spelling")), F.when(known, cell(F.col("respell"))).otherwise("—"), F.col("count").cast("string"), F.when(F.size("chapters") == 0, "—").otherwise(runs_text(F.col("chapters")))]
    return rows.withColumn("section", section).select("section", number.alias("number"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def spec_report(changes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, report: one line for each check of a file with its value before and after, in the order of their names, and the checks
    that still warn or fail. changes: as `compared` gives them."""
    shown = lambda c: F.coalesce(F.format_string("%.2f", c), F.lit("—"))
    line = F.concat(F.col("check"), F.lit(": "), shown(F.col("before_value")), F.lit(" → "), shown(F.col("after_value")), F.lit(" ("), F.col("outcome"), F.lit(")"))
    lines = changes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("check", line.alias("line")))).alias("l"), F.array_sort(F.collect_list(F.when(F.col("outcome") == "outstanding", F.col("check")))).alias("o"))
    rest = F.when(F.size("o") == 0, "nothing outstanding").otherwise(F.concat(F.lit("outstanding: "), F.array_join("o", ", ")))
    return lines.select(*keys, F.concat_ws("\n", F.array_join(F.transform("l", lambda x: x["line"]), "\n"), rest).alias("report"))


def dashboard(chapters: DataFrame, book: str) -> DataFrame:
    """book, chapters, words, minutes (of chapters without a measured length: 155 words each), recorded, proofed, open. chapters: words,
    seconds (may be null), has_audio, open (null before a check)."""
    minutes = F.when(F.col("seconds") > 0, F.col("seconds") / 60).otherwise(F.greatest(F.lit(0.0), F.col("words")) / 155)
    return chapters.groupBy(book).agg(
        F.count(F.lit(1)).alias("chapters"), F.round(F.sum(F.greatest(F.lit(0.0), F.col("words"))), 2).alias("words"), F.round(F.sum(minutes), 1).alias("minutes"),
        F.count_if(F.col("has_audio")).alias("recorded"), F.count_if(F.col("has_audio") & F.coalesce(F.col("open") == 0, F.lit(False))).alias("proofed"), F.coalesce(F.sum("open"), F.lit(0)).alias("open"),
    )
