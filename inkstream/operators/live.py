"""What a live reading carries along, beside the follower: scalar states per session as folds over ordered arrays, words held
back at the edge of a window, upserts of pickups. A fold is one pass over a session's values and stays in the JVM; over a
stream the same step functions go into keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstream.operators.idioms import as_of

#: Seconds at a window's end that are not trusted yet, samples of the room that are kept, weights of the pace.
HOLD_BACK, AMBIENT, PACE, PACE_SHARE, CLIPPED = 0.32, 64, 0.3, 0.85, 0.99
#: False alarms from which on flags are dimmed.
ALARMS = 3


def rebased(words: DataFrame, offset: str) -> DataFrame:
    """Times of a window's words on the clock of the take."""
    return words.withColumns({c: F.col(c) + F.col(offset) for c in ("start", "end")})


def held_back(words: DataFrame, window_end: Column, hold: float = HOLD_BACK) -> DataFrame:
    """Words of a window but those that end in its last moments: the next window has them whole."""
    return words.where(F.col("end") <= window_end - hold)


def upserted(pickups: DataFrame, id: str, version: list[str]) -> DataFrame:
    """The last version of each pickup."""
    w = Window.partitionBy(id).orderBy(*[F.desc(v) for v in version])
    return pickups.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def paces(rows: DataFrame, keys: list[str], order: list[str], value: str, start: float = 0.4) -> DataFrame:
    """keys, pace: seconds a word, as an exponential mean of the times between confirmed words, in order. The mean is a sum of
    weights that fall from the last row back, so no history is put into one row, whatever its length."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])) - 1
    weighed = rows.select(*keys, F.col(value).alias("_x"), back.alias("_k"))
    return weighed.groupBy(*keys).agg((F.sum(F.col("_x") * PACE * F.pow(F.lit(1 - PACE), "_k")) + start * F.pow(F.lit(1 - PACE), F.count(F.lit(1)))).alias("pace"))


def lead(pace: Column, silent: Column) -> Column:
    """Words that a prompt may be ahead after so many silent seconds: one at most."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), silent / pace * PACE_SHARE))


def _label(peak: Column, ambient: Column) -> Column:
    return F.when(peak >= CLIPPED, "clipping").when(ambient > 0.05, "noisy").when(peak < 0.1, "low").when(peak > 0.9, "hot").otherwise("good")


def input_qualities(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, peak, ambient, label of a microphone's levels in order. ambient is the twenty-fifth percentile, by index, of the last 64,
    which alone meet in one row; of clipping, noisy, low, hot and good the first that holds."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    last = rows.select(*keys, F.col(value).alias("_x"), back.alias("_k"))
    found = last.groupBy(*keys).agg(F.max("_x").alias("peak"), F.array_sort(F.collect_list(F.when(F.col("_k") <= AMBIENT, F.col("_x")))).alias("_last"))
    return found.select(*keys, F.get("_last", F.floor((F.size("_last") - 1) * 0.25).cast("int")).alias("ambient"), "peak").withColumn("label", _label(F.col("peak"), F.col("ambient"))).select(*keys, "peak", "ambient", "label")


def dimmed(flags: DataFrame, keys: list[str], at: str, dismissed: str) -> DataFrame:
    """Flags in order with `dim`: whether ALARMS flags of the session or more had been dismissed before."""
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return flags.withColumn("dim", F.coalesce(F.sum(F.col(dismissed).cast("int")).over(before), F.lit(0)) >= ALARMS)


def restart_points(words: DataFrame, keys: list[str], sentence: str, at: str, cursors: DataFrame) -> DataFrame:
    """Where a tape is cut for a new start: of each cursor's sentence, the first confirmed word at or before it. cursors: keys, cursor."""
    met = words.join(cursors, keys).where(F.col(at) <= F.col("cursor"))
    top = F.max(sentence).over(Window.partitionBy(*keys))
    return met.withColumn("_s", top).where(F.col(sentence) == F.col("_s")).groupBy(*keys).agg(F.min(at).alias("restart"))


def segments(pieces: DataFrame, keys: list[str], seat: str, gap: float = 0.05) -> DataFrame:
    """keys, seat, start, end: what one seat speaks without another between and with gaps of 50 ms at most."""
    w = Window.partitionBy(*keys).orderBy("start", "end", seat)
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.lag(seat).over(w).isNull() | ~F.col(seat).eqNullSafe(F.lag(seat).over(w))
    runs = pieces.withColumn("_t", turn.cast("int")).withColumn("_run", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "_run").orderBy("start", "end")
    reach = F.max("end").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    cut = runs.withColumn("_c", (reach.isNull() | (F.col("start") > reach + gap)).cast("int")).withColumn("_part", F.sum("_c").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(*keys, "_run", "_part").agg(F.first(seat).alias(seat), F.min("start").alias("start"), F.max("end").alias("end")).drop("_run", "_part")


def seats_at(pickups: DataFrame, spoken: DataFrame, keys: list[str], at: str, seat: str) -> DataFrame:
    """pickups with the seat that speaks at their time: the segment that holds it (its end excluded, the last one's included), the
    first of those that do; else the one whose start is nearest, the earlier of two.

    Of overlapping segments only those can be the first that end later than all before them, and each of these from where the one
    before it ends: so as-of joins find the segment, and no time meets all segments of a chapter."""
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"), seat)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(before)
    rows = spoken.select(*keys, "start", "end", seat).withColumns({"_reach": reach, "_top": F.max("start").over(Window.partitionBy(*keys))})
    one = F.struct(F.col("start").alias("a"), F.col("end").alias("z"), F.col(seat).alias("seat"), (F.col("start") == F.col("_top")).alias("last"))
    longer = rows.where(F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).select(*keys, F.greatest("start", F.coalesce("_reach", "start")).alias(at), one.alias("_own"))
    firsts = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "start").orderBy(F.desc("end"), seat))).where("_n = 1")
    earlier = firsts.select(*keys, F.col("start").alias(at), one.alias("_before"))
    later = firsts.select(*keys, (-F.col("start")).alias("_at"), one.alias("_after"))
    met = as_of(as_of(pickups, longer, keys, at, ["_own"]), earlier, keys, at, ["_before"]).withColumn("_at", -F.col(at))
    met = as_of(met, later, keys, "_at", ["_after"])
    holds = F.coalesce(F.col(at) < F.col("_own.z"), F.lit(False))
    ends = F.coalesce(F.col("_before.last") & (F.col(at) <= F.col("_before.z")), F.lit(False))
    ahead = F.coalesce(F.col("_after.a") - F.col(at) < F.col(at) - F.col("_before.a"), F.col("_before").isNull())
    found = F.when(holds, F.col("_own.seat")).when(ends, F.col("_before.seat")).when(ahead, F.col("_after.seat")).otherwise(F.col("_before.seat"))
    return met.withColumn(seat, found).select(*pickups.columns, seat)
