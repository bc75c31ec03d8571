"""Mastering of recordings of any length: a gate between words, light compression, gain to a level, a true-peak limiter and room
tone at both ends.

A signal is a table of chunks: keys, chunk (from 0) and samples (mono, an array), each chunk but the last of a whole number of
20 ms frames. What is recursive runs over a file's chunks in order, in one task that holds a chunk at a time and carries a
state of a few numbers; what is global (floors, levels, peaks) is grouped over small rows of measures and joined back. So a
file is never one row, and files are spread over the cluster. Inside a chunk the recursions are closed forms and cumulative
maxima over numpy arrays.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.functions.levels import SILENCE, dbfs
from inkstream.operators import signal as S
from inkstream.operators.idioms import index_percentile, islands

#: Fixed values of the gate: attack and release in seconds, the level that it aims at, the reduction beyond that and its bounds
#: (dB), and the reduction where there is no floor.
GATE_ATTACK, GATE_RELEASE, GATE_LEVEL, GATE_BEYOND, GATE_LEAST, GATE_MOST, GATE_BLIND = 0.005, 0.5, -70.0, 3.0, 6.0, 30.0, 18.0
#: Fixed values of the compressor: detector, attack and release in seconds, threshold (dBFS) and ratio.
DETECTOR, ATTACK, RELEASE, THRESHOLD, RATIO = 0.05, 0.01, 0.15, -28.0, 2.0
#: Fixed values of the limiter: seconds of attack, hold and release.
LIMIT_ATTACK, LIMIT_HOLD, LIMIT_RELEASE = 0.005, 0.01, 0.08
#: Fixed values of room tone: spread of frame levels (dB), softest level that can be told from silence, sound from here on; and
#: the seed and factors of the noise that stands in for it.
SPREAD, SOFTEST, SOUND, SEED, FACTOR, ADDEND = 6.0, -90.0, 1e-9, 0x6D2B79F5, 1_664_525, 1_013_904_223
FRAME, QUIET_FRAMES, SPEECH_OVER, LOUDEST_BAND, CROWDED, ROUNDS = 0.02, 10, 10.0, 6.0, 0.9, 2


class Delivery(NamedTuple):
    """What a delivered file must be; levels in dB, lengths in seconds."""

    rate: int = 44_100
    low: float = -23.0
    high: float = -18.0
    target: float = -20.0
    ceiling: float = -3.2
    peak_most: float = -3.0
    floor_most: float = -60.0
    head: float = 1.5
    tail: float = 1.5
    room_least: float = 0.5
    room_most: float = 5.0
    seconds_most: float = 7200.0

    @property
    def frame(self) -> int:
        return max(1, round(self.rate * FRAME))

    @property
    def chunk(self) -> int:
        """A second, about: longer than any look ahead."""
        return self.frame * 50


def amplitude(db: float) -> float:
    return 10 ** (db / 20)


def level(x: np.ndarray) -> float:
    power = float(np.mean(x * x)) if len(x) else 0.0
    return 10 * np.log10(power) if power > 0 else SILENCE


def chunked(samples: DataFrame, keys: list[str], position: str, value: str, size: int) -> DataFrame:
    """Chunks of single samples whose positions run from 0 without a gap."""
    pair = F.struct(F.col(position).alias("p"), F.col(value).cast("double").alias("v"))
    rows = samples.groupBy(*keys, F.floor(F.col(position) / size).alias("chunk")).agg(F.array_sort(F.collect_list(pair)).alias("_x"))
    return rows.select(*keys, "chunk", F.transform("_x", lambda x: x["v"]).alias("samples"))


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so that no later step computes it again."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint()


# Stages: `feed` takes the samples of a chunk and returns what is known of it, or of the one before; `close` returns the last.


class Stage:
    def feed(self, x: np.ndarray) -> dict | None:
        raise NotImplementedError

    def close(self) -> dict | None:
        return None


class Gate(Stage):
    """Follows 1 in frames that speak and the reduction in others, by one factor a sample: quickly up, slowly down. Within a frame
    the target stands still and is never passed, so the envelope is a geometric series."""

    def __init__(self, rate: int, limit: float, strict: bool, floor: float):
        needed = max(0.0, floor - GATE_LEVEL) if floor > SILENCE else GATE_BLIND
        self.low = amplitude(-min(GATE_MOST, max(GATE_LEAST, needed + GATE_BEYOND))) if needed else 1.0
        self.frame, self.limit, self.strict, self.envelope = max(1, round(rate * FRAME)), limit, strict, self.low
        up, down = (1 - 1 / max(1, round(rate * s)) for s in (GATE_ATTACK, GATE_RELEASE))
        steps = np.arange(1, self.frame + 1)
        self.up, self.down = up**steps, down**steps

    def feed(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        for at in range(0, len(x), self.frame):
            part = x[at : at + self.frame]
            loud = level(part)
            target = 1.0 if (loud > self.limit if self.strict else loud >= self.limit) else self.low
            powers = self.up if target > self.envelope else self.down
            envelope = target + (self.envelope - target) * powers[: len(part)]
            out[at : at + self.frame] = part * envelope
            self.envelope = float(envelope[-1])
        return out


def followed(x: np.ndarray, start: float, keep: np.ndarray) -> np.ndarray:
    """y[i] = keep[i] y[i-1] + (1 - keep[i]) x[i], for a short run."""
    fade = np.cumprod(keep)
    return fade * (start + np.cumsum((1 - keep) * x / fade))


class Compressor(Stage):
    """Lowers what is over the threshold, by a gain in dB that follows programme energy. Which of the two speeds holds depends on
    the gain itself: the answer is guessed for a block, solved, and corrected until it agrees with itself."""

    def __init__(self, rate: int, threshold: float = THRESHOLD, ratio: float = RATIO):
        self.detector, self.attack, self.release = (float(np.exp(-1 / (rate * s))) for s in (DETECTOR, ATTACK, RELEASE))
        self.block = max(1, min(512, round(rate * ATTACK)))
        self.threshold, self.slope, self.power, self.gain = threshold, 1 - 1 / ratio, 0.0, 0.0

    def feed(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        for at in range(0, len(x), self.block):
            part = x[at : at + self.block]
            power = followed(part * part, self.power, np.full(len(part), self.detector))
            self.power = float(power[-1])
            target = -np.maximum(0.0, 10 * np.log10(np.maximum(power, 1e-20)) - self.threshold) * self.slope
            gain = self._gains(target)
            self.gain = float(gain[-1])
            out[at : at + self.block] = part * 10 ** (gain / 20)
        return out

    def _gains(self, target: np.ndarray) -> np.ndarray:
        if self.gain == 0.0 and not target.any():
            return np.zeros_like(target)
        down = target < self.gain
        while True:  # the longest prefix that agrees grows by one at least
            gain = followed(target, self.gain, np.where(down, self.attack, self.release))
            now = target < np.concatenate([[self.gain], gain[:-1]])
            if (now == down).all():
                return gain
            down = now


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    """The largest of each value and the width - 1 before it: two running maxima within blocks of that width."""
    padded = np.concatenate([np.zeros(width - 1), x, np.zeros(-(len(x) + width - 1) % width)]).reshape(-1, width)
    ahead, behind = np.maximum.accumulate(padded, 1).ravel(), np.maximum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.maximum(behind[: len(x)], ahead[width - 1 : width - 1 + len(x)])


def decayed_max(x: np.ndarray, start: float, keep: float, block: int) -> np.ndarray:
    """y[i] = max(x[i], keep y[i-1])."""
    out = np.empty_like(x)
    for at in range(0, len(x), block):
        part = x[at : at + block]
        fade = keep ** np.arange(1, len(part) + 1)
        out[at : at + block] = np.maximum(np.maximum.accumulate(part / fade), start) * fade
        start = out[min(at + block, len(x)) - 1]
    return out


class Limiter(Stage):
    """Holds the gain that the largest sample of the last 10 ms needs, lets it go slowly, and comes down to it ahead of time by a
    ramp. The ramp reaches back an attack's length at most, so a chunk is done once the next is known."""

    def __init__(self, rate: int, ceiling: float, gain_db: float):
        self.ceiling, self.factor = amplitude(ceiling), amplitude(gain_db)
        self.attack, self.hold = (max(1, round(rate * s)) for s in (LIMIT_ATTACK, LIMIT_HOLD))
        self.keep, self.block = float(np.exp(-1 / (rate * LIMIT_RELEASE))), max(1, min(4096, int(rate * LIMIT_RELEASE * 50)))
        self.recent, self.lowered, self.open = np.empty(0), 0.0, None

    def _done(self, ahead: np.ndarray) -> np.ndarray:
        x, gains = self.open
        all_ = np.concatenate([gains, ahead[: self.attack]])
        rise = np.arange(len(all_)) / self.attack
        ramp = np.minimum.accumulate((all_ + rise)[::-1])[::-1] - rise
        return x * np.minimum(gains, ramp[: len(x)])

    def feed(self, x: np.ndarray) -> np.ndarray | None:
        x = x * self.factor
        sizes = np.concatenate([self.recent, np.abs(x)])
        largest = sliding_max(sizes, self.hold)[len(self.recent) :]
        self.recent = sizes[-(self.hold - 1) :] if self.hold > 1 else np.empty(0)
        lowered = decayed_max(1 - np.minimum(1.0, self.ceiling / np.maximum(largest, 1e-20)), self.lowered, self.keep, self.block)
        self.lowered = float(lowered[-1])
        done = self._done(1 - lowered) if self.open is not None else None
        self.open = x, 1 - lowered
        return done

    def close(self) -> np.ndarray | None:
        return self._done(np.empty(0)) if self.open is not None else None


class Chain(Stage):
    """Stages without delay, one after the other."""

    def __init__(self, *stages: Stage):
        self.stages = stages

    def feed(self, x: np.ndarray) -> np.ndarray:
        for stage in self.stages:
            x = stage.feed(x)
        return x


CONTEXT = 32


class Measure(Stage):
    """Of a chunk: n, energy, true peak (with the samples around it), the first and last sample that is no digital silence, and
    the level of each frame."""

    def __init__(self, frame: int, factor: float = 1.0):
        self.frame, self.factor, self.before, self.open = frame, factor, np.empty(0), None

    def _done(self, after: np.ndarray) -> dict:
        x = self.open
        whole = np.concatenate([self.before, x, after[:CONTEXT]])
        at = len(self.before)
        top = S.between_samples(whole)[max(0, at - 1) : at + len(x)] if len(whole) > 1 else np.empty(0)
        heard = np.flatnonzero(np.abs(x) > SOUND)
        pad = -len(x) % self.frame
        squares = np.concatenate([x * x, np.zeros(pad)]).reshape(-1, self.frame).sum(1)
        sizes = np.full(len(squares), self.frame)
        sizes[-1] -= pad
        self.before = whole[: at + len(x)][-CONTEXT:]
        ends = (int(heard[0]), int(heard[-1])) if len(heard) else (None, None)
        return {"n": len(x), "energy": float(squares.sum()), "peak": float(max(np.abs(x).max(initial=0.0), top.max(initial=0.0))), "first": ends[0], "last": ends[1], "levels": np.sqrt(squares / sizes).tolist()}

    def feed(self, x: np.ndarray) -> dict | None:
        x = x * self.factor
        done = self._done(x) if self.open is not None else None
        self.open = x
        return done

    def close(self) -> dict | None:
        return self._done(np.empty(0)) if self.open is not None else None


SAMPLES = "samples array<double>"
MEASURES = "n long, energy double, peak double, first long, last long, levels array<double>"


def streamed(signal: DataFrame, keys: list[str], make: Callable[[dict], Stage], params: DataFrame | None = None, fields: str = SAMPLES) -> DataFrame:
    """keys, chunk and the fields that a stage returns for each chunk. params: a row a file, handed to `make`; files without one
    are left out. A file's chunks are read in order by one task, one at a time."""
    given = [c for c in params.columns if c not in keys] if params is not None else []
    rows = (signal if params is None else signal.join(params, keys)).select(*keys, *given, "chunk", "samples").repartition(*keys).sortWithinPartitions(*keys, "chunk")
    schema = T.StructType([*[signal.schema[k] for k in keys], T.StructField("chunk", T.LongType()), *T._parse_datatype_string(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stage, open_, kinds = None, None, [], None

        def out(found) -> pa.RecordBatch:
            at = open_.pop(0)
            values = [*key, at, *([found] if isinstance(found, np.ndarray) else found.values())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=schema.names)

        for batch in batches:
            if kinds is None:
                kinds = [*(batch.column(k).type for k in keys), pa.int64(), *(pa.list_(pa.float64()) if isinstance(f.dataType, T.ArrayType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() for f in schema.fields[len(keys) + 1 :])]
            for i in range(batch.num_rows):
                of = tuple(batch.column(k)[i].as_py() for k in keys)
                if stage is None or of != key:
                    if stage is not None and (last := stage.close()) is not None:
                        yield out(last)
                    key, open_, stage = of, [], make({c: batch.column(c)[i].as_py() for c in given})
                x = batch.column("samples")[i].values.to_numpy(zero_copy_only=False).astype(float)
                open_.append(batch.column("chunk")[i].as_py())
                if (found := stage.feed(x)) is not None:
                    yield out(found)
        if stage is not None and (last := stage.close()) is not None:
            yield out(last)

    return rows.mapInArrow(run, schema)


def frames_of(measures: DataFrame, keys: list[str], delivery: Delivery) -> DataFrame:
    """keys, frame, rms, peak (0), n of measured chunks, a last partial frame too."""
    size, per = delivery.frame, delivery.chunk // delivery.frame
    rows = measures.select(*keys, "chunk", F.col("n").alias("_n"), F.posexplode("levels").alias("_at", "rms"))
    return rows.select(*keys, (F.col("chunk") * per + F.col("_at")).alias("frame"), "rms", F.lit(0.0).alias("peak"), F.least(F.lit(size), F.col("_n") - F.col("_at") * size).alias("n"))


def speech_limits(framed: DataFrame, floors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, floor_db, limit, strict: a frame speaks if it is over the limit (strict), or at it or over."""
    decibels = framed.withColumn("db", dbfs(F.col("rms")))
    p10 = index_percentile(decibels, keys, "db", 0.1, last=True, out="p10")
    loudest = decibels.groupBy(*keys).agg(F.max("db").alias("loudest"))
    known = floors.join(p10, keys).join(loudest, keys).withColumn("limit", F.when(F.col("floor_db") > SILENCE, F.col("floor_db")).otherwise(F.col("p10")) + SPEECH_OVER)
    strict = F.col("loudest") > F.col("limit")
    return known.select(*keys, "floor_db", F.when(strict, F.col("limit")).otherwise(F.col("loudest") - LOUDEST_BAND).alias("limit"), strict.alias("strict"))


def speaks() -> Column:
    return F.when(F.col("strict"), dbfs(F.col("rms")) > F.col("limit")).otherwise(dbfs(F.col("rms")) >= F.col("limit"))


def noise(length: int, db: float = GATE_LEVEL) -> np.ndarray:
    """The same noise each time: a linear congruential generator, its peak for the level that is asked for."""
    state, out = SEED, np.empty(length)
    for i in range(length):
        state = (state * FACTOR + ADDEND) & 0xFFFFFFFF
        out[i] = state
    return (out / 2**32 * 2 - 1) * amplitude(db) * np.sqrt(3)


def steady(room: np.ndarray, frame: int, whole_db: float | None = None) -> np.ndarray:
    """Recorded room tone if its frames are alike, none is softer than can be told and, lowered if need be, none louder than the
    gate's aim; else noise of its level, within bounds."""
    levels = [level(room[i : i + frame]) for i in range(0, len(room), frame)]
    soft, loud = min(levels), max(levels)
    if soft < SOFTEST or loud - soft > SPREAD:
        return noise(max(32, frame * 10), min(GATE_LEVEL, max(SOFTEST, level(room) if whole_db is None else whole_db)))
    return room * amplitude(GATE_LEVEL - loud) if loud > GATE_LEVEL else room


def rooms(signal: DataFrame, measures: DataFrame, quiet: DataFrame, keys: list[str], delivery: Delivery) -> DataFrame:
    """keys, head, tail: the samples that are put before and after each file. quiet: keys, frame, start, end: the frames of quiet
    segments and where these lie; that of the lowest level which is not silence is repeated, from its beginning. Of a segment no more is read than a
    pad needs; whether it is steady is known by its frames."""
    size, rate = delivery.frame, delivery.rate
    framed = frames_of(measures, keys, delivery).select(*keys, "frame", "rms", "n")
    power, db = F.sum(F.col("rms") * F.col("rms") * F.col("n")) / F.sum("n"), dbfs(F.col("rms"))
    segments = quiet.join(framed, [*keys, "frame"]).groupBy(*keys, "start", "end").agg(power.alias("power"), F.min(db).alias("soft"), F.max(db).alias("loud")).where("power > 0")
    best = segments.groupBy(*keys).agg(F.min_by(F.struct("start", "end", "soft", "loud", dbfs(F.sqrt("power")).alias("db")), F.struct("power", "start")).alias("room"))
    longest = max(round(delivery.head * rate), round(delivery.tail * rate), 1)
    first, until = F.col("room.start") * size, F.least(F.col("room.end") * size, F.col("room.start") * size + longest)
    at = F.col("chunk") * delivery.chunk
    read = signal.join(best, keys).where((at < until) & (at + F.size("samples") > first))
    part = F.slice("samples", F.greatest(first - at, F.lit(0)).cast("int") + 1, F.greatest(until - F.greatest(first, at), F.lit(0)).cast("int"))
    pieces = read.select(*keys, F.struct("chunk", part.alias("samples")).alias("piece"), "room").groupBy(*keys).agg(F.array_sort(F.collect_list("piece")).alias("pieces"), F.first("room").alias("room"))
    found = signal.select(*keys).distinct().join(pieces.select(*keys, F.flatten(F.transform("pieces", lambda p: p["samples"])).alias("samples"), "room.*"), keys, "left")

    @F.pandas_udf("head array<double>, tail array<double>")
    def pads(samples: pd.Series, soft: pd.Series, loud: pd.Series, whole: pd.Series) -> pd.DataFrame:
        out = []
        for x, s, l, db in zip(samples, soft, loud, whole):
            if x is None:
                room = steady(noise(max(32, size * 10)), size)
            elif s < SOFTEST or l - s > SPREAD:
                room = noise(max(32, size * 10), min(GATE_LEVEL, max(SOFTEST, db)))
            else:
                room = np.asarray(x, float) * (amplitude(GATE_LEVEL - l) if l > GATE_LEVEL else 1.0)
            out.append([np.resize(room, round(seconds * rate)) for seconds in (delivery.head, delivery.tail)])
        return pd.DataFrame(out, columns=["head", "tail"])

    return found.withColumn("pads", pads("samples", "soft", "loud", "db")).select(*keys, "pads.head", "pads.tail")


def bounds(measures: DataFrame, keys: list[str], delivery: Delivery) -> DataFrame:
    """keys, begin, stop: the samples between the first and the last that are no digital silence, stop exclusive."""
    at = F.col("chunk") * delivery.chunk
    return measures.groupBy(*keys).agg(F.coalesce(F.min(at + F.col("first")), F.lit(0)).alias("begin"), F.coalesce(F.max(at + F.col("last")) + 1, F.lit(0)).alias("stop"))


def joined(pieces: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Chunks of `size` of pieces that lie end to end. pieces: keys, start (of the first sample) and samples."""
    n, last = F.size("samples"), F.col("start") + F.size("samples") - 1
    rows = pieces.where(n > 0).select(*keys, "start", "samples", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(last / size))).alias("chunk"))
    skip = F.greatest(F.col("chunk") * size - F.col("start"), F.lit(0))
    room = (F.col("chunk") + 1) * size - F.greatest(F.col("start"), F.col("chunk") * size)
    part = F.struct((F.col("start") + skip).alias("at"), F.slice("samples", skip.cast("int") + 1, room.cast("int")).alias("x"))
    return rows.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(part)).alias("parts")).select(*keys, "chunk", F.flatten(F.transform("parts", lambda p: p["x"])).alias("samples"))


def padded(signal: DataFrame, pads: DataFrame, edges: DataFrame, keys: list[str], delivery: Delivery) -> DataFrame:
    """Chunks of each file between its pads, without the digital silence at its ends."""
    known = pads.join(edges, keys).withColumns({"before": F.size("head").cast("long"), "length": F.col("stop") - F.col("begin")})
    at = F.col("chunk") * delivery.chunk
    low, high = F.greatest(F.col("begin") - at, F.lit(0)), F.least(F.col("stop") - at, F.size("samples").cast("long"))
    body = signal.join(known.select(*keys, "begin", "stop", "before"), keys).where(low < high)
    body = body.select(*keys, (F.col("before") + at + low - F.col("begin")).alias("start"), F.slice("samples", low.cast("int") + 1, (high - low).cast("int")).alias("samples"))
    ends = known.select(*keys, F.explode(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("head").alias("samples")), F.struct((F.col("before") + F.col("length")).alias("start"), F.col("tail").alias("samples")))).alias("x"))
    return joined(body.unionByName(ends.select(*keys, "x.start", "x.samples")), keys, delivery.chunk)


def levels_with(measures: DataFrame, pads: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, level_db of each file between its pads: what is cut off at its ends has no energy."""
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    own = measures.groupBy(*keys).agg(F.sum("energy").alias("energy"))
    whole = own.join(pads, keys).join(edges, keys)
    n = F.size("head") + F.size("tail") + F.col("stop") - F.col("begin")
    return whole.select(*keys, dbfs(F.sqrt((F.col("energy") + square("head") + square("tail")) / n)).alias("level_db"))


REPORT = ("status", "abort_code", "floor_db", "speech_db", "predicted_floor_db", "gain_db", "level_db", "peak_db", "floor_after_db", "seconds", "head_s", "tail_s")


def mastered(signal: DataFrame, keys: list[str], delivery: Delivery = Delivery()) -> tuple[DataFrame, DataFrame]:
    """(chunks of the files that could be mastered, a report of every file: keys and REPORT). A file is given up with no_speech,
    noise_floor, level, true_peak or structure, the first that holds."""
    d = delivery
    measure = lambda x, params=None: settled(streamed(x, keys, lambda p: Measure(d.frame, p.get("factor", 1.0)), params, MEASURES))
    before = measure(signal)
    framed = frames_of(before, keys, d)
    floors = S.noise_floor(framed.where(F.col("n") == d.frame), keys)
    floors = framed.select(*keys).distinct().join(floors, keys, "left").select(*keys, F.coalesce("floor_db", F.lit(SILENCE)).alias("floor_db"))
    limits = settled(speech_limits(framed, floors, keys))
    spoken = framed.join(limits, keys).withColumn("speaks", speaks())
    in_run = Window.partitionBy(*keys, "island")
    runs = islands(spoken, keys, ["frame"], "speaks").withColumns({"start": F.min("frame").over(in_run), "end": F.max("frame").over(in_run) + 1})
    quiet = settled(runs.where(~F.col("speaks") & (F.col("end") - F.col("start") >= QUIET_FRAMES)).select(*keys, "frame", "start", "end"))
    own = F.col("rms") * F.col("rms") * F.col("n")
    said = spoken.groupBy(*keys).agg(
        dbfs(F.sqrt(F.sum(F.when(F.col("speaks"), own)) / F.sum(F.when(F.col("speaks"), F.col("n"))))).alias("speech_db"), F.avg(F.col("speaks").cast("double")).alias("share"), F.max("floor_db").alias("floor_db")
    )
    said = said.join(quiet.groupBy(*keys).agg(F.countDistinct("start").alias("quiet")), keys, "left").withColumn("predicted_floor_db", F.col("floor_db") + d.target - F.col("speech_db"))
    noisy = (F.col("floor_db") > SILENCE) & (F.col("predicted_floor_db") > d.floor_most) & (F.col("quiet").isNull() | (F.col("share") > CROWDED))
    first = F.when(F.coalesce(F.col("speech_db"), F.lit(SILENCE)) == SILENCE, "no_speech").when(noisy, "noise_floor")
    facts = settled(said.select(*keys, "floor_db", "speech_db", "predicted_floor_db", first.alias("early")))

    going = limits.join(facts.where("early is null").select(*keys), keys)
    shaped = settled(streamed(signal, keys, lambda p: Chain(Gate(d.rate, p["limit"], p["strict"], p["floor_db"]), Compressor(d.rate)), going))
    heard = measure(shaped)
    edges = settled(bounds(heard, keys, d))
    plain = levels_with(heard, rooms(shaped, heard, quiet, keys, d), edges, keys)
    gains = settled(plain.select(*keys, F.when(F.col("level_db") > SILENCE, F.lit(d.target) - F.col("level_db")).otherwise(0.0).alias("gain_db")))

    def limited(x: DataFrame, by: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(chunks, measures, pads, levels) after gain and limiting; what still reaches over the ceiling between samples lowers all."""
        made = settled(streamed(x, keys, lambda p: Limiter(d.rate, d.ceiling, p["gain_db"]), by))
        top = measure(made).groupBy(*keys).agg(F.max("peak").alias("top"))
        factor = top.select(*keys, F.least(F.lit(1.0), F.lit(amplitude(d.ceiling)) / F.greatest(F.col("top"), F.lit(1e-20))).alias("factor"))
        made = settled(made.join(factor, keys).select(*keys, "chunk", F.transform("samples", lambda v: v * F.col("factor")).alias("samples")))
        measures = measure(made)
        pads = settled(rooms(made, measures, quiet, keys, d))
        return made, measures, pads, settled(levels_with(measures, pads, edges, keys))

    done: list[tuple[DataFrame, ...]] = []
    made, by = shaped, gains
    for round_ in range(ROUNDS + 1):
        now = limited(made, by)
        outside = ~F.col("level_db").between(d.low, d.high)
        again = now[3].where(outside) if round_ < ROUNDS else now[3].where(F.lit(False))
        done.append(tuple(x.join(again.select(*keys), keys, "left_anti") for x in now))
        if again.isEmpty():
            break
        made, by = now[0].join(again.select(*keys), keys, "left_semi"), again.select(*keys, (F.lit(d.target) - F.col("level_db")).alias("gain_db"))
    made, measures, pads, levels = (settled(_all(parts)) for parts in zip(*done))

    out = settled(padded(made, pads, edges, keys, d))
    final = measure(out)
    whole = frames_of(final, keys, d)
    room = S.room_tone(whole, S.noise_floor(whole.where(F.col("n") == d.frame), keys), keys)
    after = S.noise_floor(frames_of(measures, keys, d).where(F.col("n") == d.frame), keys).withColumnRenamed("floor_db", "floor_after_db")
    sizes = final.groupBy(*keys).agg((F.sum("n") / d.rate).alias("seconds"), dbfs(F.max("peak")).alias("peak_db"))
    report = facts.join(gains, keys, "left").join(levels, keys, "left").join(after, keys, "left").join(sizes, keys, "left").join(room, keys, "left")
    report = report.withColumns({"head_s": F.least(F.col("head_frames") * FRAME, F.col("seconds")), "tail_s": F.least(F.col("tail_frames") * FRAME, F.col("seconds"))})
    roomy = lambda c, pad: F.col(c).between(d.room_least, d.room_most) & F.lit(pad > 0)
    code = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(~F.col("level_db").between(d.low, d.high), "level")
        .when(F.col("floor_after_db") > d.floor_most, "noise_floor")
        .when(F.col("peak_db") > d.peak_most, "true_peak")
        .when((F.col("seconds") > d.seconds_most) | ~roomy("head_s", d.head) | ~roomy("tail_s", d.tail), "structure")
    )
    report = settled(report.withColumn("abort_code", code).withColumn("status", F.when(F.col("abort_code").isNull(), "ok").otherwise("aborted")).select(*keys, *REPORT))
    return out.join(report.where("status = 'ok'").select(*keys), keys), report


def _all(parts: tuple[DataFrame, ...]) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first
