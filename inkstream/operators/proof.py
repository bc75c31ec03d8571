"""Batch proof: what a narrator read against what is written.

A chapter is one row: its manuscript tokens and its transcript words, both as arrays. The difference of two word
sequences is inherently sequential, so it is the one Arrow UDF here and returns only the runs that differ; everything
after that (times, confidence, suppression, pauses, merging) is DataFrame work on those few rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from math import inf
from operator import and_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from inkstream.functions.text import WORD, _Normals, spoken_pieces, stable_id, words
from inkstream.functions.units import match_units, units
from inkstream.functions.vocabulary import Readings, Vocabulary
from inkstream.operators.idioms import Scan, gap_sessions, lists, scan
from inkstream.sources.tables import DROPPED, FOLLOWED, LENGTH, MODULUS, REPLACED, STEP

#: Seconds within which pickups become one, by setting; pause limits.
MERGE_WINDOWS = {"tight": 0.25, "normal": 0.4, "loose": 0.6}
LONG_PAUSE, TOKEN_GAP = 4.0, 3


def differing_runs(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """(from, to, heard from, heard to), ends exclusive, of each run in which a and b differ, by a shortest edit script.
    What both begin and end with is set aside first; memory is the square of the number of edits."""
    low, n, m = 0, len(a), len(b)
    while low < min(n, m) and a[low] == b[low]:
        low += 1
    while min(n, m) > low and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[low:n], b[low:m]
    n, m = len(a), len(b)
    reach, history, x, y = {1: 0}, [], 0, 0
    while not (x >= n and y >= m):
        d = len(history)
        history.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = _step(reach, k, d)[0]
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                break
    runs: list[list[int]] = []
    for d in range(len(history) - 1, 0, -1):
        x, inserted = _step(history[d], k, d)
        y = x - k
        x, y, k = (x, y - 1, k + 1) if inserted else (x - 1, y, k - 1)
        if runs and (x + (not inserted), y + inserted) == (runs[-1][0], runs[-1][2]):
            runs[-1][0], runs[-1][2] = x, y
        else:
            runs.append([x, x + (not inserted), y, y + inserted])
        x = history[d][k]
    return [tuple(low + v for v in r) for r in reversed(runs)]


def _step(reach: dict[int, int], k: int, d: int) -> tuple[int, bool]:
    """How far diagonal k gets with one more edit, and whether that edit is an insertion."""
    down = reach.get(k + 1, -1)
    right = reach[k - 1] + 1 if k > -d else -1
    inserted = k == -d or (k < d and down > right)
    return (down if inserted else right), inserted


RUN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("i0", "i1", "j0", "j1")])


# The matchers are marked as not deterministic, though they are: else a condition on what they find is worked out a second time
# below the shuffle that deals the chapters over the cores, in as few tasks as their file has row groups.


@F.arrow_udf(T.ArrayType(RUN))
def word_runs(written: pa.Array, heard: pa.Array) -> pa.Array:
    """The runs in which words differ, in normal form."""
    known = _Normals()
    of = lambda x: list(map(known.__getitem__, x))
    return pa.array([differing_runs(of(a), of(b)) for a, b in zip(lists(written), lists(heard))], to_arrow_type(T.ArrayType(RUN)))


word_runs = word_runs.asNondeterministic()


def _slip(key: str) -> Callable[[Column], Column]:
    return lambda i: F.coalesce(F.pmod(F.col(key) * 31 + i, F.lit(MODULUS)), F.lit(MODULUS))


def _moved_up(p: Column) -> Column:
    """The slips follow each other: where a token is dropped the next two move up by one, and what is added has the place of the latter."""
    return p < FOLLOWED


def stand_in_places(key: str, tokens: str) -> tuple[Column, Column]:
    """The first and the last place of a stand-in reading; there is none where the last is before the first."""
    slip, n = _slip(key), F.size(tokens)
    return F.when(_moved_up(slip(F.lit(-1))), -1).otherwise(0), F.when(_moved_up(slip(n - 1)), n - 2).otherwise(n - 1)


def stand_in_readings(key: str) -> Callable[[pa.RecordBatch, Vocabulary], Readings]:
    """`stand_in_transcript` of rows with key and _words, made where they are read, so that only the tokens travel."""

    def made(batch: pa.RecordBatch, known: Vocabulary) -> Readings:
        column = batch.column("_words")
        pages = column.offsets.to_numpy()
        distinct, (on_page,), ids = known.encoded(column.values.slice(pages[0], pages[-1] - pages[0]))
        pages, n = pages - pages[0], np.diff(pages)
        keys = batch.column(key)
        base, null = keys.fill_null(0).to_numpy(zero_copy_only=False) % MODULUS * 31 % MODULUS, keys.is_null().to_numpy(zero_copy_only=False)
        slip = lambda row, i: np.where(null[row], MODULUS, (base[row] + i) % MODULUS)
        each = np.arange(len(n))
        low, high = np.where(slip(each, -1) < FOLLOWED, -1, 0), np.where(slip(each, n - 1) < FOLLOWED, n - 2, n - 1)
        count = np.where(n > 0, np.maximum(high - low + 1, 0), 0)
        words = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(each, count)
        at = np.arange(words[-1]) - words[:-1][row] + low[row]
        p = slip(row, at)
        i = np.where(p < FOLLOWED, at + 1, at)
        starts = i * STEP + np.where(p == FOLLOWED, 0.05, 0.0)
        extra = len(distinct)
        source = np.append(on_page, 0)  # a place of no page, where nothing is heard
        written = np.select([p == DROPPED, p == FOLLOWED], [extra, extra + 1], source[pages[:-1][row] + i])
        ids = np.concatenate([ids, known.add(["slipped", "added"])])
        return Readings(ids[on_page], pages, ids[written], words, [*distinct, "slipped", "added"], written, starts, starts + LENGTH, np.full(len(at), 0.9))

    return made


def stand_in_transcript(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """key, tokens, heard: array of (text, start, end, confidence), read with deterministic slips; and the text, if asked for."""
    slip, up = _slip(key), _moved_up
    n = F.size("tokens")
    low, high = stand_in_places(key, "tokens")

    def spoken(at: Column) -> Column:
        p = slip(at)
        i, late = F.when(up(p), at + 1).otherwise(at), F.when(p == FOLLOWED, 0.05).otherwise(0.0)
        said = F.when(p == DROPPED, "slipped").when(p == FOLLOWED, "added").otherwise(F.get("tokens", i))
        word = lambda t, start: F.struct(t.alias("text"), start.alias("start"), (start + LENGTH).alias("end"), F.lit(0.9).alias("confidence"))
        return F.when(p > FOLLOWED, word(F.get("tokens", at), at * STEP)).otherwise(word(said, i * STEP + late))

    places = F.when((n > 0) & (high >= low), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return docs.select(key, *[text] * keep_text, words(F.col(text)).alias("tokens")).withColumn("heard", F.transform(places, spoken))


def valid_words(heard: Column, duration: Column | None = None) -> Column:
    """Words with text and sensible times, clamped to the duration; a missing confidence stays null."""
    fit = F.filter(heard, lambda w: w["text"].rlike(r"[\p{L}\p{N}]") & ~F.isnan(w["start"]) & ~F.isnan(w["end"]) & (w["start"] >= 0) & (w["end"] >= w["start"]))
    if duration is None:
        return fit
    inside = F.filter(fit, lambda w: w["start"] <= duration)
    return F.transform(inside, lambda w: w.withField("end", F.least(w["end"], duration)).withField("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), w["confidence"]))))


def _token_runs(chapters: DataFrame) -> DataFrame:
    return chapters.withColumn("runs", word_runs("tokens", F.transform("heard", lambda w: w["text"])))


PAUSE_PLACE = T.StructType([T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType()), T.StructField("between", T.StringType())])
MATCHED = T.StructType([T.StructField("runs", T.ArrayType(RUN)), T.StructField("places", T.ArrayType(PAUSE_PLACE))])


def matched_words(tokens: list[str], heard: list[str], classes: dict[str, str] | None = None) -> tuple[list, list, list[tuple[int, int, int, int]]]:
    """Units of both sides and the runs of units that differ."""
    a, b = units(tokens, classes), units(heard, classes)
    return a, b, differing_runs([k for k, _, _ in a], [k for k, _, _ in b])


def equal_units(a: list, b: list, runs: list[tuple[int, int, int, int]]) -> Iterator[tuple[tuple, tuple]]:
    i = j = 0
    for i0, i1, j0, j1 in [*runs, (len(a), len(a), len(b), len(b))]:
        yield from zip(a[i:i0], b[j:j0])
        i, j = i1, j1


def _in_words(units_: list, low: int, high: int, size: int) -> tuple[int, int]:
    """A run of units as a range of words; one that holds nothing stands before the next unit's first word."""
    first = units_[low][1] if low < len(units_) else size
    return first, units_[high - 1][2] + 1 if high > low else first


def _places(text: str, a: list, b: list, runs: list, at: list[int]) -> list[dict | None]:
    token = {w: (first, last) for (_, first, last), (_, low, high) in equal_units(a, b, runs) for w in range(low, high + 1)}
    known = sorted(token)
    sides: list[tuple[int, int] | None] = []
    for k in at:
        n = bisect_right(known, k)
        before, after = known[n - 1] if n else None, known[n] if n < len(known) else None
        gap = token[after][0] - token[before][1] if before is not None and after is not None else 0
        sides.append((before, after) if 0 < gap <= TOKEN_GAP else None)
    last = max((token[x[1]][0] for x in sides if x), default=-1)
    spans = [m.span() for m in islice(regex.finditer(WORD, text), last + 1)]
    between = lambda x: text[spans[token[x[0]][1]][1] : spans[token[x[1]][0]][0]]
    return [dict(zip(PAUSE_PLACE.names, (*x, between(x)))) if x else None for x in sides]


def matched(classes: dict[str, str] | None) -> Callable[..., Column]:
    """(tokens, heard words, text, the word that each silence follows) -> runs: where the units of both sides differ, as ranges of
    words; places: of each silence the aligned words beside it and what is written between their tokens, null where they are not
    in order or more than TOKEN_GAP tokens apart (a word pickup tells of that). Both from one edit script."""

    def of(tokens: list[str], heard: list[str], text: str, at: list[int]) -> dict:
        a, b, runs = matched_words(tokens, heard, classes)
        ranges = [(*_in_words(a, i0, i1, len(tokens)), *_in_words(b, j0, j1, len(heard))) for i0, i1, j0, j1 in runs]
        return {"runs": [dict(zip(RUN.names, r)) for r in ranges], "places": _places(text, a, b, runs, at) if len(at) else []}

    @F.arrow_udf(MATCHED)
    def each(tokens: pa.Array, heard: pa.Array, text: pa.Array, at: pa.Array) -> pa.Array:
        return pa.array([of(a, b, t.as_py() or "", k) for a, b, t, k in zip(lists(tokens), lists(heard), text, lists(at))], to_arrow_type(MATCHED))

    return each.asNondeterministic()


def _unit_runs(chapters: DataFrame, classes: dict[str, str] | None) -> DataFrame:
    none = F.array().cast("array<int>")
    return chapters.withColumn("runs", matched(classes)("tokens", F.transform("heard", lambda w: w["text"]), F.lit(""), none)["runs"])


def verified(takes: DataFrame, classes: dict[str, str] | None = None, least: float = 0.55, most: int = 6) -> DataFrame:
    """status, expected_excerpt, heard_excerpt of each retake (text: what is written, heard: its words) beside its columns.

    match: equal units. inconclusive: nothing written or heard (null too), or known confidences below `least` on average.
    mismatch: what is left between the common beginning and end, up to `most` words of either side."""
    said = F.filter(F.coalesce("heard", F.array().cast(takes.schema["heard"].dataType)), lambda w: F.trim(w["text"]) != "")
    keyed = takes.withColumn("_said", F.transform(said, lambda w: w["text"])).withColumn("_sure", F.filter(F.transform(said, lambda w: w["confidence"]), lambda c: c.isNotNull() & ~F.isnan(c)))
    keyed = keyed.withColumn("_page", words(F.col("text"))).withColumn("_a", match_units(F.col("_page"), classes)).withColumn("_b", match_units(F.col("_said"), classes))
    a, b, n, m = F.col("_a"), F.col("_b"), F.size("_a"), F.size("_b")
    both = F.least(n, m)

    def common(limit: Column, at_a: Column | None, at_b: Column | None) -> Column:
        at = F.when(limit > 0, F.sequence(F.lit(0), limit - 1)).otherwise(F.array().cast("array<int>"))
        key = lambda units, end, i: F.get(units, i if end is None else end - 1 - i)["key"]
        return F.coalesce(F.array_min(F.filter(at, lambda i: key(a, at_a, i) != key(b, at_b, i))), limit)

    keyed = keyed.withColumn("_head", common(both, None, None))
    keyed = keyed.withColumn("_tail", common(both - F.col("_head"), n, m))

    def excerpt(units: Column, source: str, size: Column) -> Column:
        left = size - F.col("_head") - F.col("_tail")
        first, last = F.get(units, F.col("_head"))["first"], F.get(units, size - F.col("_tail") - 1)["last"]
        return F.when(left > 0, F.array_join(F.slice(source, first + 1, F.least(last - first + 1, F.lit(most))), " ")).otherwise("")

    doubtful = (F.size("_page") == 0) | (F.size("_said") == 0)
    mean = F.aggregate("_sure", F.lit(0.0), lambda acc, c: acc + c) / F.size("_sure")
    equal = (n == m) & (F.col("_head") == n)
    status = F.when(doubtful, "inconclusive").when(equal, "match").when((F.size("_sure") > 0) & (mean < least), "inconclusive").otherwise("mismatch")
    differs = status == "mismatch"
    return keyed.select(*takes.columns, status.alias("status"), F.when(differs, excerpt(a, "_page", n)).alias("expected_excerpt"), F.when(differs, excerpt(b, "_said", m)).alias("heard_excerpt"))


def retake_lines(pickups: DataFrame, keys: list[str], start: str = "t_start", end: str = "t_end") -> DataFrame:
    """Open pickups of one recorded line (equal start and end to a millisecond) as one task: keys, start, end, flags, at."""
    line = [F.round(F.col(c), 3).alias(c) for c in (start, end)]
    tasks = pickups.where("status = 'open'").select(*keys, *line).groupBy(*keys, start, end).agg(F.count(F.lit(1)).alias("flags"))
    return tasks.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(start, end)))


def align(chapters: DataFrame, key: str = "doc_id", fold: bool = False, classes: dict[str, str] | None = None) -> DataFrame:
    """key, i0, i1, j0, j1, kind, expected, heard, t_start, t_end, confidence of each run that was read otherwise.

    chapters: key, tokens, heard. Times are those of the heard words, else the end of the word before to the start of
    the one after. An empty transcript makes one skip of the whole chapter; equal sequences make no row. Confidence is the mean
    over the words heard, one that is missing counted as 0; it is null where the engine gave none at all. fold: numbers match
    however they are spoken or written, and words of one class (see functions.units) match each other."""
    keyed = _unit_runs(chapters, classes) if fold else _token_runs(chapters)
    return keyed.select(key, F.explode(F.transform("runs", _shown)).alias("r")).select(key, "r.*")


def _shown(r: Column) -> Column:
    """A run with all that is said of it, so that only small rows leave the chapter's arrays."""
    part = lambda c, a, b: F.slice(c, a + 1, b - a)
    edge = lambda i, field: F.try_element_at("heard", i)[field]
    i0, i1, j0, j1 = (r[c] for c in ("i0", "i1", "j0", "j1"))
    said, some = part("heard", j0, j1), j1 > j0
    before = F.when(j0 > 0, edge(F.greatest(j0, F.lit(1)), "end")).otherwise(0.0)
    after = F.coalesce(edge(j0 + 1, "start"), F.try_element_at("heard", F.lit(-1))["end"], F.lit(0.0))
    sure = F.aggregate(said, F.lit(0.0), lambda acc, w: acc + F.coalesce(F.nanvl(w["confidence"], F.lit(0.0)), F.lit(0.0))) / (j1 - j0)
    known = F.exists(said, lambda w: w["confidence"].isNotNull() & ~F.isnan(w["confidence"]))
    return F.struct(
        i0.alias("i0"), i1.alias("i1"), j0.alias("j0"), j1.alias("j1"),
        F.when(i1 == i0, "insert").when(~some, "skip").otherwise("sub").alias("kind"),
        F.array_join(part("tokens", i0, i1), " ").alias("expected"),
        F.array_join(F.transform(said, lambda w: w["text"]), " ").alias("heard"),
        F.when(some, edge(j0 + 1, "start")).otherwise(before).alias("t_start"),
        F.when(some, edge(F.greatest(j1, F.lit(1)), "end")).otherwise(F.greatest(before, after)).alias("t_end"),
        F.when(some & known, sure).alias("confidence"),
    )


def same_letters(expected: Column, heard: Column) -> Column:
    """The run differs in spacing alone."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    return bare(expected) == bare(heard)


def unsuppressed(pickups: DataFrame, suppressed: list[str]) -> DataFrame:
    """Without the pickups all of whose words are on the list; a pause is never suppressed."""
    said = spoken_pieces(F.when(F.col("kind") == "insert", F.col("heard")).otherwise(F.col("expected")))
    listed = F.array(*map(F.lit, suppressed)) if suppressed else F.array().cast("array<string>")
    return pickups.where((F.col("kind") == "pause") | (F.size(said) == 0) | (F.size(F.array_except(said, listed)) > 0))


def confident(pickups: DataFrame, floor: float) -> DataFrame:
    """Runs whose engine reported no confidence are kept."""
    return pickups.where(F.col("confidence").isNull() | (F.col("confidence") >= floor))


def merged(pickups: DataFrame, keys: list[str], window: float, ties: tuple[str, ...] = ()) -> DataFrame:
    """Pickups that follow each other within the window become one: keys, pickup_id, t_start, t_end, kind, expected, heard,
    confidence, pickups (how many). Texts are joined in order and the kind is that of the texts; a pause stays as it is, and
    nothing is joined across one. pickup_id is the one of what came out (of its number among the chapter's)."""
    order = ["t_start", *ties]
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    is_pause = F.col("kind") == "pause"
    parted = pickups.withColumns({"_pause": is_pause, "_part": F.sum(is_pause.cast("int")).over(so_far)})
    grouped = gap_sessions(parted, [*keys, "_part", "_pause"], "t_start", "t_end", window, ties=ties)
    place = F.struct(*order)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct(*order, c)))), lambda x: x[c]), " ")
    whole = grouped.groupBy(*keys, "_part", "_pause", "session").agg(
        F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.count(F.lit(1)).alias("pickups"), joined("expected").alias("expected"), joined("heard").alias("heard"),
        F.min("kind").alias("_kind"), F.min("confidence").alias("confidence"), F.min(place).alias("_place"),
    )
    kind = F.when(F.col("_pause"), "pause").when((F.col("pickups") == 1) | (F.concat("expected", "heard") == ""), F.col("_kind")).when(F.col("heard") == "", "skip").when(F.col("expected") == "", "insert").otherwise("sub")
    numbered = whole.withColumns({"kind": kind, "_n": F.row_number().over(Window.partitionBy(*keys).orderBy("_place")) - 1})
    return with_ids(numbered, keys[-1], F.col("_n")).select(*keys, "pickup_id", "t_start", "t_end", "kind", "expected", "heard", "confidence", "pickups")


def _gaps(chapters: DataFrame, limit: float) -> Column:
    """(at, a, z) of each silence over the limit: after which word, from when to when."""
    n = F.size("heard")
    word = lambda i, f: F.get("heard", i)[f]
    every = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    place = lambda at, a, z: F.struct(at.alias("at"), a.alias("a"), z.alias("z"))
    gaps = F.transform(F.filter(every, lambda i: word(i + 1, "start") - word(i, "end") > limit), lambda i: place(i, word(i, "end"), word(i + 1, "start")))
    if "silences" not in chapters.columns:
        return gaps
    long = F.filter("silences", lambda s: (s["end"] - s["start"] > limit) & (s["end"] > word(F.lit(0), "start")) & (s["start"] < word(n - 1, "end")))
    after = lambda s: F.coalesce(F.array_max(F.filter(every, lambda i: word(i, "start") <= s["start"])), F.lit(-1))
    measured = F.filter(F.transform(long, lambda s: place(after(s), s["start"], s["end"])), lambda p: p["at"] >= 0)
    return F.when(F.size("silences") > 0, measured).otherwise(gaps)


def _pause_rows(places: Column) -> Column:
    """The gaps of a chapter that are pauses within a sentence: word_index, t_start, t_end, confidence."""
    sure = lambda p, side: F.coalesce(F.get("heard", p[side])["confidence"], F.lit(0.0))
    rows = F.zip_with(
        "_gaps", places, lambda g, p: F.struct(g["at"].alias("word_index"), F.greatest(F.lit(0.0), g["a"]).alias("t_start"), F.greatest(F.lit(0.0), g["a"], g["z"]).alias("t_end"), F.least(sure(p, "before"), sure(p, "after")).alias("confidence"), p["between"].alias("between"))
    )
    return F.filter(rows, lambda r: r["between"].isNotNull() & ~r["between"].rlike("[.!?。！？\n]"))


def _with_matches(chapters: DataFrame, limit: float, classes: dict[str, str] | None) -> DataFrame:
    """chapters with _gaps and _matched. No filter here: pushed below, it would take the words apart again for each gap."""
    few = chapters.withColumn("_gaps", _gaps(chapters, limit))
    return few.withColumn("_matched", matched(classes)("tokens", F.transform("heard", lambda w: w["text"]), F.coalesce("text", F.lit("")), F.transform("_gaps", lambda g: g["at"])))


def pauses(chapters: DataFrame, limit: float = LONG_PAUSE, key: str = "doc_id", classes: dict[str, str] | None = None) -> DataFrame:
    """key, word_index, t_start, t_end, confidence of each pause over the limit within a sentence.

    chapters: key, text, heard and, if it was measured, silences (array of start and end). Measured silences that lie between
    the first and the last word win over gaps between words, as a recogniser spreads words evenly. No end of a sentence or line
    may stand between the words beside a pause."""
    seen = _with_matches(chapters.withColumn("tokens", words(F.col("text"))), limit, classes)
    each = seen.select(key, F.explode(_pause_rows(F.col("_matched.places"))).alias("r")).select(key, "r.*")
    return each.select(key, "word_index", "t_start", "t_end", "confidence")


def checked(chapters: DataFrame, key: str = "doc_id", classes: dict[str, str] | None = None, floor: float = 0.0, suppressed: list[str] | None = None, limit: float = LONG_PAUSE, window: float = MERGE_WINDOWS["normal"]) -> DataFrame:
    """The whole check of a chapter: usable words, their times held to the duration, units matched once, runs that differ in
    spacing alone or that the engine was not sure of or that hold listed words alone left out, pauses, and near pickups as one.

    chapters: key, text, heard, duration (may be null) and, if measured, silences. Result as `merged` gives it."""
    fit = chapters.withColumn("tokens", words(F.col("text")))
    fit = fit.withColumn("heard", F.when(F.col("duration").isNull(), valid_words(F.col("heard"))).otherwise(valid_words(F.col("heard"), F.col("duration"))))
    seen = _with_matches(fit, limit, classes)
    columns = ("kind", "expected", "heard", "t_start", "t_end", "confidence", "j0")
    runs = F.transform(F.transform("_matched.runs", _shown), lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    pause = {"kind": lambda r: F.lit("pause"), "expected": lambda r: F.lit(f"Pause > {limit:g}s"), "heard": lambda r: F.lit(""), "j0": lambda r: r["word_index"]}
    long = F.transform(_pause_rows(F.col("_matched.places")), lambda r: F.struct(*[pause.get(c, lambda r, c=c: r[c])(r).alias(c) for c in columns]))
    each = seen.select(key, F.explode(F.concat(runs, long)).alias("r")).select(key, "r.*")
    is_pause = F.col("kind") == "pause"
    told = unsuppressed(each.where(~((F.col("kind") == "sub") & same_letters(F.col("expected"), F.col("heard")))), suppressed or [])
    return merged(told.where(is_pause | F.col("confidence").isNull() | (F.col("confidence") >= floor)), [key], window, ("j0", "kind"))


#: Fixed value: tokens of chapters that leave a worker together.
TOKENS_AT_ONCE = 50_000


def _token_spans(tokens: list[str], heard: list[str], classes: dict[str, str] | None) -> tuple[list[int], list[int]]:
    """For each token the heard words [low, high) that stand for it, empty where none do. Equal units stand for each other; where
    they differ, one for several, several for one, and as many for as many."""
    a, b, runs = matched_words(tokens, heard, classes)
    lows, highs = [0] * len(tokens), [0] * len(tokens)

    def give(unit: tuple, first: tuple, last: tuple) -> None:
        low, high = first[1], last[2] + 1
        for t in range(unit[1], unit[2] + 1):
            lows[t], highs[t] = (min(low, lows[t]), max(high, highs[t])) if highs[t] > lows[t] else (low, high)

    for unit, said in equal_units(a, b, runs):
        give(unit, said, said)
    for i0, i1, j0, j1 in runs:
        one_for_all = i1 - i0 == 1 or j1 - j0 == 1
        if j1 > j0 and (one_for_all or i1 - i0 == j1 - j0):
            for k in range(i1 - i0):
                give(a[i0 + k], *(b[j0], b[j1 - 1]) if one_for_all else (b[j0 + k], b[j0 + k]))
    return lows, highs


def _said(texts: pa.Array, lows: np.ndarray, highs: np.ndarray) -> pa.Array:
    """The texts [low, high) joined by a blank, empty where there are none."""
    one = texts.take(pa.array(lows, mask=highs <= lows)).to_numpy(zero_copy_only=False)
    one[[t is None for t in one]] = ""
    for k in np.flatnonzero(highs - lows > 1):
        one[k] = " ".join(t for t in texts.slice(lows[k], highs[k] - lows[k]).to_pylist() if t is not None)
    return pa.array(one, pa.string())


def token_alignment(chapters: DataFrame, key: str = "doc_id", classes: dict[str, str] | None = None) -> DataFrame:
    """key, token_index, written, heard, start, end, state (matched, different, missing) of every token of a chapter.
    chapters: key, tokens, heard. Tokens are exploded in the workers, some chapters at a time: a worker holds one chapter's words as
    Python objects, whatever the batch."""
    schema = T.StructType([chapters.schema[key], *T._parse_datatype_string("token_index int, written string, heard string, start double, end double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            keys, tokens, heard = (batch.column(c) for c in range(3))
            said, at, base = heard.values, tokens.offsets.to_numpy(), heard.offsets.to_numpy()
            texts, first, rows, lows, highs = said.field("text"), 0, [], [], []
            for i, (a, b) in enumerate(zip(lists(tokens), lists(pa.ListArray.from_arrays(heard.offsets, texts)))):
                spans = np.array(_token_spans(a, b, classes), np.int64).reshape(2, -1)
                lows.append(spans[0] + base[i])
                highs.append(spans[1] + base[i])
                rows.append(np.arange(len(a), dtype=np.int32))
                if i + 1 < len(batch) and at[i + 1] - at[first] < TOKENS_AT_ONCE:
                    continue
                low, high, sizes = np.concatenate(lows), np.concatenate(highs), np.diff(at[first : i + 2])
                none, of = high <= low, pa.array(np.repeat(np.arange(first, i + 1), sizes))
                written = tokens.values.slice(at[first], at[i + 1] - at[first])
                times = (said.field(c).take(pa.array(x, mask=none)) for c, x in (("start", low), ("end", high - 1)))
                yield pa.RecordBatch.from_arrays([keys.take(of), pa.array(np.concatenate(rows)), written, _said(texts, low, high), *times], schema=kinds)
                first, rows, lows, highs = i + 1, [], [], []

    each = chapters.select(key, "tokens", F.transform("heard", lambda w: F.struct(w["text"].alias("text"), w["start"].cast("double").alias("start"), w["end"].cast("double").alias("end"))).alias("heard")).mapInArrow(run, schema)
    alike = F.array_join(spoken_pieces(F.col("written")), "") == F.array_join(spoken_pieces(F.col("heard")), "")
    return each.withColumn("state", F.when(F.col("heard") == "", "missing").when(F.col("written") == F.col("heard"), "matched").when(alike, "matched").otherwise("different"))


def coverage(alignment: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, timed, tokens, covered: the share of a chapter's tokens that have a time."""
    timed = F.count_if(F.col("start").isNotNull())
    return alignment.groupBy(key).agg(timed.alias("timed"), F.count(F.lit(1)).alias("tokens"), F.round(timed / F.count(F.lit(1)), 6).alias("covered"))


def readings(places: DataFrame, alignment: DataFrame, keys: list[str], key: str = "doc_id") -> DataFrame:
    """keys (of a phrase), reading, count, first: how a phrase was heard where it stands, the most frequent first.

    places: keys, key, token_index, n_tokens. A place whose chapter was not checked has the reading #no-audio, one where nothing was
    heard #silent; case and punctuation make no other reading."""
    spread = places.withColumn("_at", F.explode(F.sequence(F.col("token_index"), F.col("token_index") + F.col("n_tokens") - 1)))
    met = spread.join(alignment.select(F.col(key).alias("_key"), F.col("token_index").alias("_t"), F.col("heard").alias("_h")), (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_t")), "left")
    place = met.groupBy(*keys, key, "token_index").agg(F.count("_t").alias("_n"), F.array_sort(F.collect_list(F.when(F.col("_h") != "", F.struct("_at", "_h")))).alias("_said"))
    said = F.transform("_said", lambda x: x["_h"])
    once = F.filter(F.transform(said, lambda x, i: F.when((i == 0) | (x != F.get(said, i - 1)), x)), lambda x: x.isNotNull())
    spoken = F.array_join(F.flatten(F.transform(once, spoken_pieces)), " ")
    reading = F.when(F.col("_n") == 0, "#no-audio").when(spoken == "", "#silent").otherwise(spoken)
    grouped = place.withColumn("reading", reading).groupBy(*keys, "reading").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(key, "token_index")).alias("first"))
    return grouped.select(*keys, "reading", "count", F.col(f"first.{key}").alias("first_key"), F.col("first.token_index").alias("first_token"))


def redo_ranges(alignment: DataFrame, picked: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each picked range of tokens (key, first, last) with its time: t_start, t_end, and timing, which is ready if both its ends are
    timed, partial if some token is, unavailable if none is."""
    rows = picked.join(alignment.select(F.col(key).alias("_key"), "token_index", "start", "end"), (F.col(key) == F.col("_key")) & F.col("token_index").between(F.col("first"), F.col("last")), "left")
    edge = lambda at: F.bool_or((F.col("token_index") == F.col(at)) & F.col("start").isNotNull())
    seen = rows.groupBy(key, "first", "last").agg(F.min("start").alias("t_start"), F.max("end").alias("t_end"), F.count("start").alias("_n"), edge("first").alias("_a"), edge("last").alias("_z"))
    return seen.select(key, "first", "last", "t_start", "t_end", F.when(F.col("_n") == 0, "unavailable").when(F.col("_a") & F.col("_z"), "ready").otherwise("partial").alias("timing"))


def with_ids(pickups: DataFrame, key: str, ordinal: Column | None = None) -> DataFrame:
    """A stable id of what a pickup says, when, and as which of its chapter, the same from run to run."""
    at = lambda c: F.format_string("%.4f", F.col(c))
    n = F.row_number().over(Window.partitionBy(key).orderBy("t_start", "i0")) - 1 if ordinal is None else ordinal
    numbered = pickups.withColumn("_ordinal", n)
    named = F.concat(F.lit("pickup-"), stable_id(F.col(key), F.col("kind"), F.col("expected"), F.col("heard"), at("t_start"), at("t_end"), F.col("_ordinal")))
    return numbered.withColumn("pickup_id", named).drop("_ordinal")


class _Nearest(Scan):
    """Takes times that are there to be used, in order, then gives each asked time the nearest that is left, the earlier of two. Which
    neighbours are left is known by two chains that skip what is used."""

    def __init__(self):
        self.times, self.values, self.left, self.right = [], [], None, None

    @staticmethod
    def _end(chain: list[int], i: int) -> int:
        root = i
        while chain[root] != root:
            root = chain[root]
        while chain[i] != root:
            chain[i], i = root, chain[i]
        return root

    def feed(self, old: bool, at: float, taken: dict | None, row: dict | None) -> list[tuple]:
        if old:
            self.times.append(at)
            self.values.append(taken)
            return []
        n = len(self.times)
        if self.left is None:  # left[i + 1] and right[i] lead from i to the nearest that is left; 0 and n are ends
            self.left, self.right = list(range(n + 1)), list(range(n + 1))
        place = bisect_left(self.times, at)
        before, after = self._end(self.left, place) - 1, self._end(self.right, place)
        if before >= 0:
            before = self._end(self.right, bisect_left(self.times, self.times[before]))  # of equal times the first
        gaps = [abs(self.times[i] - at) if 0 <= i < n else inf for i in (before, after)]
        pick = before if gaps[0] <= gaps[1] else after
        if min(gaps) == inf:
            return [(row, None, None)]
        self.left[pick + 1], self.right[pick] = pick, pick + 1
        return [(row, self.values[pick], min(gaps))]


def preserved(fresh: DataFrame, previous: DataFrame, keys: list[str], signature: list[str], at: str, values: list[str], id: str) -> DataFrame:
    """fresh with the values of the previous row of equal id, else of the nearest in time that is of equal signature and not
    yet used; rows choose in order of time, and moved_by says how far that row is. Ids are unique within the keys.

    No side is joined: rows of equal id meet in a window, what no id settles in the next one, of equal signature. Where one side has a
    single row there, that window tells who takes what; of other groups, the previous rows are held while the new ones stream by.
    Sides that are dealt by the keys into as many parts each are not dealt again."""
    on = [*keys, *signature]
    taken = [f"_{v}" for v in values]
    timed = fresh.withColumn(at, F.col(at).cast("double"))
    own = [c for c in fresh.columns if c not in on]
    offered = previous.select(*on, F.lit(True).alias("_old"), F.col(at).cast("double").alias("_at"), F.col(id).alias("_id"), F.struct(*[F.col(v).alias(t) for v, t in zip(values, taken)]).alias("_taken"))
    asked = timed.select(*on, F.lit(False).alias("_old"), F.col(at).alias("_at"), F.col(id).alias("_id"), F.struct(*own).alias("_row"))
    both = offered.unionByName(asked, allowMissingColumns=True)
    twins = Window.partitionBy(*keys, "_id")
    known = reduce(and_, [F.col(c).isNotNull() for c in (*keys, "_id")])
    same = known & F.bool_or("_old").over(twins) & ~F.bool_and("_old").over(twins)
    twin = F.first(F.when(F.col("_old"), F.struct("_at", "_taken")), ignorenulls=True).over(twins)
    rows = both.withColumns({"_same": same, "_twin": twin}).where("not (_old and _same)").withColumn("_new", F.when(F.col("_old"), 0).when(~F.col("_same"), 1).otherwise(2))
    turn = Window.partitionBy(*on).orderBy("_new", "_at", "_id")
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_old, is_asked = F.col("_new") == 0, F.col("_new") == 1
    rows = rows.withColumns({"_olds": F.count_if(is_old).over(whole), "_asked": F.count_if(is_asked).over(whole), "_n": F.row_number().over(turn), "_when": F.max(F.when(is_asked, F.col("_at"))).over(whole)})
    nearest = F.min_by(F.struct("_at", "_taken"), F.when(is_old, F.struct(F.abs(F.col("_at") - F.col("_when")).alias("gap"), "_at", "_id"))).over(whole)
    rows = rows.withColumns({"_nearest": nearest, "_settled": (F.col("_new") == 2) | (F.least("_olds", "_asked") <= 1)}).where("_new > 0 or not _settled")
    first = is_asked & (F.col("_n") == F.col("_olds") + 1)
    found = F.when(F.col("_same"), F.col("_twin")).when(F.col("_settled") & first, F.col("_nearest"))
    rows = rows.withColumn("_found", found).withColumns({"_gap": F.abs(F.col("_at") - F.col("_found._at")), "_taken": F.when(F.col("_old"), F.col("_taken")).otherwise(F.col("_found._taken"))})
    kind = lambda c: rows.schema[c].dataType.simpleString()
    met = scan(rows, on, ["_new", "_at", "_id"], ["_old", "_at", "_taken", "_row"], _Nearest, f"_row {kind('_row')}, _taken {kind('_taken')}, _gap double", "_settled", together=True)
    chosen = [F.col(c) if c in on else F.col(f"_row.{c}").alias(c) for c in fresh.columns]
    return met.select(*chosen, *[F.col(f"_taken.{t}").alias(v) for t, v in zip(taken, values)], F.col("_gap").alias("moved_by"))


def scores(found: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """true_positives, false_positives, false_negatives, precision, recall; 0 of 0 is 1."""
    both = found.select(*keys).distinct().withColumn("_f", F.lit(1)).join(labels.select(*keys).distinct().withColumn("_l", F.lit(1)), keys, "full_outer")
    counted = both.agg(
        F.count_if(F.col("_f").isNotNull() & F.col("_l").isNotNull()).alias("true_positives"),
        F.count_if(F.col("_l").isNull()).alias("false_positives"),
        F.count_if(F.col("_f").isNull()).alias("false_negatives"),
    )
    share = lambda other: F.coalesce(F.try_divide(F.col("true_positives"), F.col("true_positives") + F.col(other)), F.lit(1.0))
    return counted.withColumns({"precision": share("false_positives"), "recall": share("false_negatives")})
