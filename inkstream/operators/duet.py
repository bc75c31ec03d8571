"""Two readers on one page: who speaks when, and the mix of their recordings by that; better times for a live reading."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fade between readers in seconds, and the share of words that need a better time for a timeline to change.
FADE, COVERED = 0.02, 0.8
NARRATION = "narration"


def span_times(spans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The columns of spans, and start and end in seconds. spans: keys, order, tokens (how many words the span has), heard (array
    of start and end, the same in every span of a key) and duration. Words share out what was heard in proportion, or the
    duration where nothing was heard with a time; spans without words are left out."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n, upto = F.sum("tokens").over(Window.partitionBy(*keys)), F.sum("tokens").over(so_far)
    timed = F.filter("heard", lambda w: (w["start"] >= 0) & (w["end"] > w["start"]) & ~F.isnan(w["start"]) & ~F.isnan(w["end"]))
    rows = spans.withColumns({"_n": n, "_first": upto - F.col("tokens"), "_last": upto - 1, "_timed": F.coalesce(timed, F.array().cast(spans.schema["heard"].dataType))}).where("tokens > 0 and duration > 0")
    m = F.size("_timed")
    low = lambda i: F.least(m - 1, F.floor(i * m / F.col("_n"))).cast("int")
    high = F.least(m - 1, F.greatest(low(F.col("_last")), F.ceil((F.col("_last") + 1) * m / F.col("_n")).cast("int") - 1)).cast("int")
    inside = lambda t: F.least(F.greatest(t, F.lit(0.0)), F.col("duration"))
    at = lambda i, field: F.get("_timed", i)[field]
    start = F.when(m == 0, F.col("duration") * F.col("_first") / F.col("_n")).otherwise(inside(at(low(F.col("_first")), "start")))
    end = F.when(m == 0, F.col("duration") * (F.col("_last") + 1) / F.col("_n")).otherwise(inside(F.greatest(at(high, "end"), at(low(F.col("_last")), "start"))))
    return rows.withColumn("start", start).withColumn("end", F.greatest("start", end)).select(*spans.columns, "start", "end")


class Painter:
    """Who speaks at each sample of a stretch, and the fades at its seams."""

    def __init__(self, first: int, n: int, length: int, half: int):
        self.low, self.high = max(0, first - half - 1), min(length, first + n + half + 1)
        self.first, self.n, self.length, self.half = first, n, length, half
        self.second = np.zeros(self.high - self.low, bool)

    def paint(self, start: int, end: int, second: bool) -> None:
        self.second[max(0, start - self.low) : max(0, end - self.low)] = second

    def stems(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both readers' parts of the samples; later seams win where fades overlap."""
        at = self.first - self.low
        share = self.second[at : at + self.n].astype(float)
        if self.half:
            for seam in np.flatnonzero(np.diff(self.second)) + 1 + self.low:
                start, end = max(0, seam - self.half), min(self.length - 1, seam + self.half)
                rise = np.arange(start, end + 1) - start
                fade = rise / max(1, end - start)
                low, high = max(start, self.first), min(end + 1, self.first + self.n)
                if low < high:
                    part = fade[low - start : high - start]
                    share[low - self.first : high - self.first] = part if self.second[seam - self.low] else 1 - part
        return one * (1 - share), two * share


def mixed(tracks: DataFrame, segments: DataFrame, keys: list[str], rate: int, size: int, narrator: str = "N1", fade: float = FADE) -> DataFrame:
    """keys, chunk, mix, first and second (stems, whose sum is the mix). tracks: keys, chunk (of `size` samples), length (samples of
    the whole recording), n1 and n2 (arrays); segments: keys, start, end (seconds) and seat (N1, N2 or narration).

    The segment that begins last has a sample; where none is, the first reader's room is heard. A segment goes to the chunks
    that it touches (and those that its fades reach), so chunks are mixed by themselves."""
    half = max(1, round(fade * rate) // 2) if round(fade * rate) > 0 else 0
    low, high = F.greatest(F.floor(F.col("start") * rate), F.lit(0)), F.ceil(F.col("end") * rate)
    second = F.when(F.col("seat") == NARRATION, F.lit(narrator == "N2")).otherwise(F.col("seat") == "N2")
    sound = segments.where((F.col("start") >= 0) & (F.col("end") > F.col("start")) & F.col("seat").isin("N1", "N2", NARRATION))
    rows = sound.select(*keys, F.struct("start", low.alias("low"), high.alias("high"), second.alias("second")).alias("s"))
    touched = F.sequence(F.greatest(F.lit(0), F.floor((F.col("s.low") - half - 1) / size)), F.floor((F.col("s.high") + half + 1) / size))
    painted = rows.select(*keys, F.explode(touched).alias("chunk"), "s").groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list("s")).alias("segments"))
    met = tracks.select(*keys, "chunk", "length", "n1", "n2").join(painted, [*keys, "chunk"], "left")
    schema = T.StructType([*[tracks.schema[k] for k in keys], T.StructField("chunk", T.LongType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("mix", "first", "second")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, length, told = (batch.column(c)[i].as_py() for c in ("chunk", "length", "segments"))
                one, two = (np.asarray(batch.column(c)[i].values.to_numpy(zero_copy_only=False), float) for c in ("n1", "n2"))
                painter = Painter(chunk * size, len(one), length, half)
                for s in told or []:
                    painter.paint(s["low"], s["high"], s["second"])
                a, b = painter.stems(one, two)
                columns = [*(batch.column(k).slice(i, 1) for k in keys), pa.array([chunk], pa.int64()), *(pa.array([x], pa.list_(pa.float64())) for x in (a + b, a, b))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return met.select(*keys, "chunk", "length", "n1", "n2", "segments").mapInArrow(run, schema)


def _timed(start: Column, end: Column) -> Column:
    return start.isNotNull() & ~F.isnan(start) & (end >= start)


def refined(baseline: DataFrame, aligned: DataFrame, keys: list[str], least: float = COVERED) -> DataFrame:
    """keys, token_index, written, start, end, confidence, adopted, coverage: the words of a live timeline, with the times of a later
    alignment where it has the word. The new times are adopted for a whole chapter, if they cover enough of it and no word then
    begins before the one before it. Both sides: keys, token_index, start, end; baseline: written, confidence too. Words of both sides
    meet in one window over a chapter."""
    timed = lambda x: x.where(_timed(F.col("start"), F.col("end")))
    later = timed(aligned).select(*keys, "token_index", F.struct("token_index", "start", "end").alias("_later"))
    both = timed(baseline).unionByName(later, allowMissingColumns=True).withColumn("_live", F.col("_later").isNull())
    order = Window.partitionBy(*keys).orderBy("token_index", "_live")
    last = F.last("_later", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("_last", last).where("_live").withColumn("_new", F.when(F.col("_last.token_index") == F.col("token_index"), F.col("_last")))
    whole = Window.partitionBy(*keys)
    start = F.coalesce("_new.start", "start")
    back = start < F.lag(start).over(whole.orderBy("token_index"))
    marked = met.withColumn("_back", F.coalesce(back, F.lit(False))).withColumns({"coverage": F.avg(F.col("_new").isNotNull().cast("double")).over(whole), "_falls": F.bool_or("_back").over(whole)})
    return _chosen(marked, keys, least)


def refined_chapters(chapters: DataFrame, keys: list[str], least: float = COVERED) -> DataFrame:
    """The same of chapters that are a row each, which are neither dealt nor sorted. chapters: keys, and arrays with an entry for each
    word: written, start, end, confidence, later_start and later_end (null where the alignment does not have the word). What is made
    of them are arrays of numbers, words become rows at the end."""
    timed = lambda s, e: F.when(_timed(s, e), s)
    rows = chapters.withColumns({"_at": F.zip_with("start", "end", timed), "_new": F.zip_with("later_start", "later_end", timed)})
    rows = rows.withColumn("_new", F.zip_with("_at", "_new", lambda s, x: F.when(s.isNotNull(), x)))
    rows = rows.withColumn("_times", F.array_compact(F.zip_with("_new", "_at", lambda x, s: F.coalesce(x, s))))
    back = F.zip_with("_times", F.slice("_times", F.lit(2), F.size("_times")), lambda s, after: after < s)
    coverage = F.try_divide(F.size(F.array_compact("_new")), F.size("_times"))
    rows = rows.withColumns({"coverage": coverage, "_falls": F.coalesce(F.array_contains(back, True), F.lit(False))})
    # outer: of an inner one Spark asks first whether there is a word, and works all this out once more for it
    words = rows.select(*keys, "coverage", "_falls", F.posexplode_outer(F.arrays_zip("written", "_at", "end", "confidence", "_new", "later_end")).alias("token_index", "_w")).where("_w._at is not null")
    new = F.when(F.col("_w._new").isNotNull(), F.struct(F.col("_w._new").alias("start"), F.col("_w.later_end").alias("end")))
    return _chosen(words.select(*keys, "coverage", "_falls", "token_index", "_w.written", F.col("_w._at").alias("start"), "_w.end", "_w.confidence", new.alias("_new")), keys, least)


def _chosen(words: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Words with the times that their chapter adopts."""
    marked = words.withColumn("adopted", (F.col("coverage") >= least) & ~F.col("_falls"))
    new = F.col("adopted") & F.col("_new").isNotNull()
    return marked.select(
        *keys, "token_index", "written", F.when(new, F.col("_new.start")).otherwise(F.col("start")).alias("start"), F.when(new, F.col("_new.end")).otherwise(F.col("end")).alias("end"),
        F.when(~new, F.col("confidence")).alias("confidence"), "adopted", "coverage",
    )
