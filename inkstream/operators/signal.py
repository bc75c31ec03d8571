"""Levels, silences and delivery checks over signals.

A long signal is many rows (file, position, sample), so every operator is a grouping or a window over frames and no task
needs a whole file; short clips may be arrays, measured by the expressions of functions.levels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.functions.levels import SILENCE, dbfs, rms
from inkstream.operators.idioms import index_percentile, islands

#: The loudest a silent frame may be, what it may be above the tenth percentile (dB), and its least length.
CEILING_DB, ABOVE_P10_DB, LEAST_THRESHOLD, LEAST_SILENCE = -45.0, 12.0, 1e-6, 0.4
#: Fixed values of loudness: block and hop in seconds, offset and gates in LUFS and LU.
BLOCK, HOP, OFFSET, ABSOLUTE_GATE, RELATIVE_GATE = 0.4, 0.1, -0.691, -70.0, -10.0


def frames(samples: DataFrame, keys: list[str], position: str, value: str, size: int, keep_partial: bool = False) -> DataFrame:
    """keys, frame, rms, peak, n of each `size` samples in a row; a last partial frame is dropped unless kept."""
    x = F.col(value).cast("double")
    out = samples.groupBy(*keys, F.floor(F.col(position) / size).cast("long").alias("frame")).agg(
        F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs(x)).alias("peak"), F.count(F.lit(1)).alias("n")
    )
    return out if keep_partial else out.where(F.col("n") == size)


def silence_thresholds(framed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, threshold: the tenth percentile of frame levels and a margin, under a ceiling."""
    low = index_percentile(framed, keys, "rms", 0.1, out="p10")
    return low.select(*keys, F.least(F.lit(10 ** (CEILING_DB / 20)), F.greatest(F.col("p10") * 10 ** (ABOVE_P10_DB / 20), F.lit(LEAST_THRESHOLD))).alias("threshold"))


def quiet_runs(framed: DataFrame, keys: list[str], thresholds: DataFrame, least: int) -> DataFrame:
    """keys, first, last, frames, level of each maximal run of frames at or below the threshold, of `least` frames or more."""
    flagged = framed.join(thresholds, keys).withColumn("quiet", F.col("rms") <= F.col("threshold"))
    runs = islands(flagged, keys, ["frame"], "quiet").where("quiet").groupBy(*keys, "island")
    found = runs.agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("frames"), F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("level"))
    return found.where(F.col("frames") >= least).drop("island")


def noise_floor(framed: DataFrame, keys: list[str], least: int = 10, window: int = 25) -> DataFrame:
    """keys, floor_db: the level of the quietest run (p10 + 3 dB, but 20 dB under the loudest), else of the quietest
    sliding window; minus infinity where all is digital silence."""
    level = dbfs(F.col("rms"))
    decibels = framed.withColumn("db", level)
    p10 = index_percentile(decibels, keys, "db", 0.1, last=True, out="p10")
    loudest = decibels.groupBy(*keys).agg(F.max("db").alias("loudest"))
    limit = p10.join(loudest, keys).select(*keys, F.pow(F.lit(10.0), F.least(F.col("p10") + 3, F.col("loudest") - 20) / 20).alias("threshold"))
    runs = quiet_runs(framed, keys, limit, least).groupBy(*keys).agg(F.min("level").alias("run_level"))
    sliding = Window.partitionBy(*keys).orderBy("frame").rowsBetween(0, window - 1)
    spans = framed.withColumns({"mean": F.avg(F.col("rms") * F.col("rms")).over(sliding), "frames": F.count(F.lit(1)).over(sliding)})
    quietest = spans.groupBy(*keys).agg(F.sqrt(F.coalesce(F.min(F.when(F.col("frames") == window, F.col("mean"))), F.avg(F.col("rms") * F.col("rms")))).alias("slid_level"))
    return quietest.join(runs, keys, "left").select(*keys, dbfs(F.coalesce("run_level", "slid_level")).alias("floor_db"))


def room_tone(framed: DataFrame, floors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, head_frames, tail_frames: frames before the first and after the last that speaks (10 dB over the floor)."""
    limit = F.when(F.col("floor_db") == SILENCE, F.lit(-60.0)).otherwise(F.greatest(F.col("floor_db"), F.lit(-90.0)) + 10)
    speaks = dbfs(F.col("rms")) > F.col("limit")
    known = framed.join(floors.select(*keys, limit.alias("limit")), keys)
    ends = known.groupBy(*keys).agg(F.min("frame").alias("a"), F.max("frame").alias("z"), F.min(F.when(speaks, F.col("frame"))).alias("first"), F.max(F.when(speaks, F.col("frame"))).alias("last"))
    return ends.select(*keys, F.coalesce(F.col("first") - F.col("a"), F.col("z") - F.col("a") + 1).alias("head_frames"), F.coalesce(F.col("z") - F.col("last"), F.col("z") - F.col("a") + 1).alias("tail_frames"))


def _biquad(x: np.ndarray, b: tuple, a: tuple) -> np.ndarray:
    out = np.empty_like(x)
    x1 = x2 = y1 = y2 = 0.0
    for i, v in enumerate(x.tolist()):
        y = b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
        x2, x1, y2, y1 = x1, v, y1, y
        out[i] = y
    return out


def k_weighted(x: np.ndarray, rate: int) -> np.ndarray:
    """The two filters of ITU-R BS.1770, derived for the sample rate."""
    k, g, q = math.tan(math.pi * 1681.974450955533 / rate), 10 ** (3.999843853973347 / 20), 0.7071752369554196
    gb, d = g**0.4996667741545416, 1 + k / q + k * k
    shelf = ((g + gb * k / q + k * k) / d, 2 * (k * k - g) / d, (g - gb * k / q + k * k) / d), (2 * (k * k - 1) / d, (1 - k / q + k * k) / d)
    k, q = math.tan(math.pi * 38.13547087602444 / rate), 0.5003270373238773
    d = 1 + k / q + k * k
    high = (1.0, -2.0, 1.0), (2 * (k * k - 1) / d, (1 - k / q + k * k) / d)
    return _biquad(_biquad(x, *shelf), *high)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def block_powers(samples: pd.Series, rates: pd.Series) -> pd.Series:
    """Mean squares of the K-weighted 400 ms blocks of a clip, every 100 ms, by prefix sums."""

    def of(x, rate: int) -> list[float]:
        total = np.concatenate([[0.0], np.cumsum(k_weighted(np.asarray(x, float), rate) ** 2)])
        size, hop = round(BLOCK * rate), round(HOP * rate)
        starts = np.arange(0, len(x) - size + 1, hop)
        return ((total[starts + size] - total[starts]) / size).tolist()

    return pd.Series([of(x, int(r)) for x, r in zip(samples, rates)])


def integrated_lufs(powers: Column) -> Column:
    """Gated loudness of block powers: blocks over -70 LUFS, then over their mean less 10 LU. Minus infinity if none is."""
    loud = lambda p: F.when(p > 0, F.lit(OFFSET) + 10 * F.log10(p)).otherwise(F.lit(SILENCE))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b) / F.greatest(F.size(xs), F.lit(1))
    first = F.filter(powers, lambda p: loud(p) > ABSOLUTE_GATE)
    second = F.filter(first, lambda p: loud(p) > loud(mean(first)) + RELATIVE_GATE)
    return F.when(F.size(second) == 0, F.lit(SILENCE)).otherwise(loud(mean(second)))


def resampled(samples: Column, source: int, target: int) -> Column:
    """Linear interpolation to round(n target / source) samples."""
    n = F.size(samples)
    length = F.floor(n * (target / source) + 0.5).cast("int")
    at = lambda i: F.least(i * (source / target), (n - 1).cast("double"))

    def one(i: Column) -> Column:
        low = F.floor(at(i)).cast("int")
        a, b = F.try_element_at(samples, low + 1), F.try_element_at(samples, F.least(low + 2, n))
        return (a + (b - a) * (at(i) - low)).cast("double")

    return F.when((n == 0) | (length <= 0), F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), length - 1), one))


def crossfaded(a: Column, b: Column, n: int) -> Column:
    """a then b, the last n samples of a fading into the first n of b; the fade is shortened to what both have."""
    k = F.least(F.lit(n), F.size(a), F.size(b))
    fade = F.transform(F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.try_element_at(a, F.size(a) - k + i + 1) * (1 - (i + 1) / (k + 1)) + F.try_element_at(b, i + 1) * ((i + 1) / (k + 1)))
    return F.concat(F.slice(a, 1, F.size(a) - k), fade, F.slice(b, k + 1, F.size(b) - k))


def between_samples(x: np.ndarray, factor: int = 4, radius: int = 16) -> np.ndarray:
    """Largest amplitude between each sample and the next: each phase is one convolution with a windowed sinc, over its own
    weights, so that the ends of a clip need no case of their own."""
    top, offsets = np.zeros(max(0, len(x) - 1)), np.arange(radius, -radius, -1)
    for phase in range(1, factor if len(x) > 1 else 1):
        distance = phase / factor - offsets
        taps = np.where(np.abs(distance) < radius, np.sinc(distance) * (0.5 + 0.5 * np.cos(np.pi * distance / radius)), 0.0)
        inside = slice(radius, radius + len(x) - 1)
        value, weight = np.convolve(x, taps)[inside], np.convolve(np.ones(len(x)), taps)[inside]
        top = np.maximum(top, np.abs(np.where(np.abs(weight) > 1e-12, value / np.where(weight == 0, 1, weight), value)))
    return top


def true_peak(x: np.ndarray) -> float:
    """Largest amplitude, between the samples too. No samples: 0."""
    return float(max(np.abs(x).max(initial=0.0), between_samples(x).max(initial=0.0)))


@F.pandas_udf(T.DoubleType())
def true_peaks(samples: pd.Series) -> pd.Series:
    """The true peak of each clip (one channel); null: none."""
    return samples.map(lambda x: None if x is None else true_peak(np.asarray(x, float)))


def repair_check(before: Column, after: Column, most: float = 0.02, shift: float = 0.1) -> Column:
    """(accepted, changed, level_shift): a repair may alter few samples and hardly the level; lengths must agree and all be sound."""
    sound = (F.size(before) == F.size(after)) & (F.size(before) > 0)
    sound &= ~F.exists(before, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & ~F.exists(after, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > 1.0001))
    moved = F.filter(F.zip_with(before, after, lambda a, b: F.abs(a - b)), lambda d: d > 1 / 65536)
    changed = F.when(sound, F.size(moved) / F.size(before)).otherwise(0.0)
    a, b = dbfs(rms(before)), dbfs(rms(after))
    level = F.when(sound, F.when(a == b, 0.0).otherwise(F.abs(b - a))).otherwise(float("inf"))
    return F.struct(F.coalesce(sound & (changed <= most) & (level <= shift), F.lit(False)).alias("accepted"), changed.alias("changed"), level.alias("level_shift"))


#: What speech is over the floor, what speech is if none is, and the least quiet segment, in dB and frames.
SPEECH_OVER_FLOOR, LOUDEST_BAND, LEAST_QUIET = 10.0, 6.0, 10


def speech(framed: DataFrame, floors: DataFrame, keys: list[str], least: int = LEAST_QUIET) -> DataFrame:
    """keys, frames, speech_frames, quiet_segments: frames over the floor (or, without one, over the tenth percentile) by 10 dB
    speak; if none does, those within 6 dB of the loudest. A quiet segment is a run of `least` frames or more that do not."""
    decibels = framed.withColumn("db", dbfs(F.col("rms")))
    p10 = index_percentile(decibels, keys, "db", 0.1, last=True, out="p10")
    limit = floors.join(p10, keys).select(*keys, (F.when(F.col("floor_db") > SILENCE, F.col("floor_db")).otherwise(F.col("p10")) + SPEECH_OVER_FLOOR).alias("limit"))
    w = Window.partitionBy(*keys)
    marked = decibels.join(limit, keys).withColumns({"_over": F.col("db") > F.col("limit"), "_top": F.max("db").over(w)})
    marked = marked.withColumn("speaks", F.when(F.bool_or("_over").over(w), F.col("_over")).otherwise(F.col("db") >= F.col("_top") - LOUDEST_BAND))
    runs = islands(marked, keys, ["frame"], "speaks").groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n"), F.first("speaks").alias("speaks"))
    return runs.groupBy(*keys).agg(F.sum("n").alias("frames"), F.sum(F.when(F.col("speaks"), F.col("n")).otherwise(0)).alias("speech_frames"), F.count_if(~F.col("speaks") & (F.col("n") >= least)).alias("quiet_segments"))


def uneven_quiet(framed: DataFrame, floors: DataFrame, keys: list[str], limit: float, least: int = LEAST_QUIET) -> DataFrame:
    """keys, uneven: whether somewhere inside the speech a run of frames is neither speech (15 dB under the ninetieth percentile) nor
    near the floor (12 dB over it, and over the limit)."""
    decibels = framed.withColumn("db", dbfs(F.col("rms")))
    p90 = index_percentile(decibels.where(F.col("db") > SILENCE), keys, "db", 0.9, out="p90")
    known = decibels.join(p90, keys, "left").join(floors, keys).withColumn("ceiling", F.coalesce(F.col("p90") - 15, F.lit(SILENCE)))
    w, loud = Window.partitionBy(*keys), F.col("db") > F.col("ceiling")
    known = known.withColumns({"_a": F.min(F.when(loud, F.col("frame"))).over(w), "_z": F.max(F.when(loud, F.col("frame"))).over(w)})
    odd = (F.col("frame") > F.col("_a")) & (F.col("frame") < F.col("_z")) & (F.col("db") > limit) & (F.col("db") > F.col("floor_db") + 12) & ~loud
    runs = islands(known.withColumn("odd", F.coalesce(odd, F.lit(False))), keys, ["frame"], "odd").groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n"), F.first("odd").alias("odd"), F.max("floor_db").alias("floor_db"))
    return runs.groupBy(*keys).agg(F.bool_or(F.col("odd") & (F.col("n") >= least) & (F.col("floor_db") > SILENCE)).alias("uneven"))


def room_floor(samples: DataFrame, keys: list[str], position: str, value: str, size: int) -> DataFrame:
    """keys, floor_db of a recorded silence: the twentieth percentile of the levels of its frames about their own means, of those
    that are not digital silence; of all samples, if none is."""
    x = F.col(value).cast("double")
    framed = samples.groupBy(*keys, F.floor(F.col(position) / size).alias("frame")).agg(F.stddev_pop(x).alias("level"), F.count(F.lit(1)).alias("n"))
    audible = index_percentile(framed.where((F.col("n") == size) & (F.col("level") > 1e-9)), keys, "level", 0.2, last=True, out="level")
    whole = samples.groupBy(*keys).agg(F.sqrt(F.avg(x * x)).alias("all"))
    return whole.join(audible, keys, "left").select(*keys, dbfs(F.coalesce("level", "all")).alias("floor_db"))


def room_test(floor: Column, seconds: Column, speech_db: Column, target: float = -20.0, most: float = -60.0) -> Column:
    """(predicted, status): where a room's noise lies once the voice is raised to its level, from 10 to 20 seconds of silence."""
    boost = F.greatest(F.lit(0.0), F.lit(target) - F.coalesce(speech_db, F.lit(target)))
    predicted = F.when(floor > SILENCE, floor + boost).otherwise(SILENCE)
    status = F.when((seconds < 10) | (seconds > 20) | (floor == SILENCE), "warn").when(predicted > most, "fail").when(most - predicted <= 0.5, "warn").otherwise("pass")
    return F.struct(predicted.alias("predicted"), status.alias("status"))


def varies(packets: Column) -> Column:
    """Whether packets' sizes say that a bit rate varies: three or more of which the ninetieth and the tenth percentile (by index)
    are more than one apart; null of fewer."""
    ordered, n = F.array_sort(packets), F.size(packets)
    at = lambda p: F.get(ordered, F.least(F.floor(n * p).cast("int"), n - 1))
    return F.when(n >= 3, at(0.9) - at(0.1) > 1)


def mono(samples: Column, channels: int) -> Column:
    """The mean of the channels of interleaved samples; a last incomplete frame is left out."""
    frames_of = F.floor(F.size(samples) / channels).cast("int")
    mean = lambda i: sum((F.get(samples, i * channels + c).cast("double") for c in range(channels)), F.lit(0.0)) / channels
    return F.when(frames_of > 0, F.transform(F.sequence(F.lit(0), frames_of - 1), mean)).otherwise(F.array().cast("array<double>"))


def spliced(take: Column, punch: Column, start: int, end: int, fade: int) -> Column:
    """A take with the samples from start to end replaced, both seams faded over `fade` samples (less, where there are fewer)."""
    return crossfaded(crossfaded(F.slice(take, 1, start), punch, fade), F.slice(take, end + 1, F.size(take)), fade)


def gain(samples: Column, db: Column | float) -> Column:
    factor = F.pow(F.lit(10.0), (db if isinstance(db, Column) else F.lit(db)) / 20)
    return F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") * factor)))


PRESET_FIELDS = (
    "preset string, rms_low double, rms_high double, lufs_low double, lufs_high double, peak_most double, floor_most double, rate int, seconds_most double, "
    "kbps_least int, vbr_allowed boolean, head_low double, head_high double, tail_low double, tail_high double"
)
#: Presets that are judged at a time, at most: they go to every task.
MAX_PRESETS = 10_000
#: Containers that can be delivered.
FORMATS = ("wav", "mp3", "flac", "m4a", "aiff")


def judged(reports: DataFrame, presets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, preset, the ten checks (pass, warn, fail or unspecified) and light of each report under each preset; a limit that is
    null sets none.

    reports: keys, rms_db, lufs, peak_db, floor_db, uneven (quiet passages vary), sample_rate, channels, samples (of all channels),
    seconds, format, kbps, vbr, head_s, tail_s, head_silent, tail_silent (digital silence). presets: as PRESET_FIELDS."""
    from inkstream.functions.levels import FAIL, LU_EDGE, PASS, UNSPECIFIED, WARN, range_status, traffic_light, upper_status

    if (n := presets.limit(MAX_PRESETS + 1).count()) > MAX_PRESETS:
        raise ValueError(f"{n} presets or more; up to {MAX_PRESETS} are taken")
    both = reports.join(F.broadcast(presets))
    quiet = upper_status(F.col("floor_db"), F.col("floor_most"))
    quiet = F.when(F.col("floor_most").isNotNull() & (F.col("floor_db") == SILENCE), WARN).otherwise(quiet)
    exact = lambda value, limit, holds: F.when(F.col(limit).isNull(), UNSPECIFIED).when(holds, PASS).otherwise(FAIL)
    room = lambda end: F.when(F.col(f"{end}_low").isNull() | F.col(f"{end}_high").isNull(), UNSPECIFIED).when(F.col(f"{end}_s").between(F.col(f"{end}_low"), F.col(f"{end}_high")) & ~F.col(f"{end}_silent"), PASS).otherwise(FAIL)
    packed, slow = F.col("format") == "mp3", F.coalesce(F.col("kbps") < F.col("kbps_least"), F.lit(False))
    uneven_rate = F.coalesce(F.col("vbr") & ~F.coalesce("vbr_allowed", F.lit(False)), F.lit(False))
    checks = {
        "rms": range_status(F.col("rms_db"), F.col("rms_low"), F.col("rms_high")),
        "loudness": range_status(F.col("lufs"), F.col("lufs_low"), F.col("lufs_high"), LU_EDGE),
        "peak": upper_status(F.col("peak_db"), F.col("peak_most")),
        "floor": F.when((quiet == PASS) & F.col("uneven"), WARN).otherwise(quiet),
        "rate": exact("sample_rate", "rate", F.col("sample_rate") == F.col("rate")),
        "channels": F.when(F.coalesce(F.col("channels").isin(1, 2) & (F.pmod("samples", F.when(F.col("channels") > 0, F.col("channels"))) == 0), F.lit(False)), PASS).otherwise(FAIL),
        "length": exact("seconds", "seconds_most", F.col("seconds") <= F.col("seconds_most")),
        "format": F.when(F.coalesce("format", F.lit("unknown")) == "unknown", WARN).when(~F.col("format").isin(*FORMATS), FAIL).when(F.col("kbps_least").isNull() | ~packed, PASS)
        .when(uneven_rate | slow, FAIL).when(F.col("kbps").isNull() | F.col("vbr").isNull(), WARN).otherwise(PASS),
        "head": room("head"),
        "tail": room("tail"),
    }
    named = both.select(*keys, "preset", *[c.alias(n) for n, c in checks.items()])
    return named.withColumn("light", traffic_light(F.array(*checks)))


#: Fixed values of noise cleaning: the least and the most reduction (dB) and what is added to what is needed; frames over the floor
#: that count, and that count as strong; what they may lose or gain (dB), how alike they must stay, how many may be altered in a
#: row and in all.
CLEAN_LEAST, CLEAN_MOST, CLEAN_MARGIN, COUNTS, STRONG = 4, 12, 2, 10.0, 18.0
LOST, LOST_STRONG, GAINED, ALIKE, ALIKE_STRONG, IN_A_ROW, ALTERED = -6.0, -3.0, 0.5, 0.9, 0.98, 5, 0.02


def cleaning_attempts(predicted: Column, most: float) -> Column:
    """The reductions (dB) to try, in order, for a floor that is predicted to lie too high."""
    needed = F.when(predicted > SILENCE, predicted - most + CLEAN_MARGIN).otherwise(F.lit(float(CLEAN_MOST)))
    first = F.greatest(F.lit(CLEAN_LEAST), F.least(F.lit(CLEAN_MOST), F.ceil(needed).cast("int")))
    return F.when(first < CLEAN_MOST, F.array(first, F.lit(CLEAN_MOST))).otherwise(F.array(F.lit(CLEAN_MOST)))


def cleaned_frames(pairs: DataFrame, keys: list[str], position: str, before: str, after: str, size: int) -> DataFrame:
    """keys, frame, n, sound, energies before and after and their product, of the samples of two versions of a recording."""
    a, b = F.col(before).cast("double"), F.col(after).cast("double")
    sound = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (F.abs(b) <= 1.0001)
    return pairs.groupBy(*keys, F.floor(F.col(position) / size).alias("frame")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(sound).alias("sound"), F.sum(a * a).alias("before"), F.sum(b * b).alias("after"), F.sum(a * b).alias("product")
    )


def cleaning_check(framed: DataFrame, floors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, safe, active, altered: whether noise cleaning left alone what sounds like a voice. Frames well over the floor must keep
    their energy and their shape; few of them may be altered, and never several in a row."""
    level = 10 * F.log10(F.greatest(F.col("before") / F.col("n"), F.lit(1e-20)))
    change = 10 * F.log10(F.greatest(F.col("after"), F.lit(1e-20)) / F.greatest(F.col("before"), F.lit(1e-20)))
    likeness = F.col("product") / F.sqrt(F.greatest(F.col("before") * F.col("after"), F.lit(1e-30)))
    known = framed.join(floors.select(*keys, "floor_db"), keys)
    active, strong = level >= F.col("floor_db") + COUNTS, level >= F.col("floor_db") + STRONG
    bad = active & ((change < F.when(strong, LOST_STRONG).otherwise(LOST)) | (change > GAINED) | (likeness < F.when(strong, ALIKE_STRONG).otherwise(ALIKE)))
    runs = islands(known.withColumns({"active": active, "bad": bad}), keys, ["frame"], "bad").groupBy(*keys, "island").agg(
        F.count(F.lit(1)).alias("n"), F.first("bad").alias("bad"), F.count_if(F.col("active")).alias("active"), F.bool_and("sound").alias("sound")
    )
    altered = F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0))
    found = runs.groupBy(*keys).agg(F.sum("active").alias("active"), altered.alias("altered"), F.max(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("_longest"), F.bool_and("sound").alias("_sound"))
    safe = F.col("_sound") & (F.col("active") > 0) & (F.col("_longest") < IN_A_ROW) & (F.col("altered") <= ALTERED * F.col("active"))
    return found.select(*keys, F.coalesce(safe, F.lit(False)).alias("safe"), "active", "altered")
