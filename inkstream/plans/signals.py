"""Queries over signals: event values of a user stand in for samples, embeddings for short clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstream.functions.levels import dbfs, peak, range_status, rms, traffic_light, upper_status
from inkstream.operators import duet, mastering, signal
from inkstream.sources.tables import table

FRAME, SCALE = 5, 10_000.0


def samples(spark: SparkSession, folder: str) -> DataFrame:
    position = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, folder, "events").select("user_id", position.alias("position"), (F.col("value") / SCALE).alias("v"))


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    return signal.frames(samples(spark, folder), ["user_id"], "position", "v", FRAME)


def clip_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Level, peak and light of every clip."""
    clips = table(spark, folder, "embeddings").select("vec_id", dbfs(rms(F.col("embedding"))).alias("level"), dbfs(peak(F.col("embedding"))).alias("top"))
    checks = F.array(range_status(F.col("level"), F.lit(-19.0), F.lit(-17.0)), upper_status(F.col("top"), F.lit(-6.0)))
    return clips.select("vec_id", F.round("level", 6).alias("rms_dbfs"), F.round("top", 6).alias("peak_dbfs"), traffic_light(checks).alias("light"))


def frame_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _frames(spark, folder).select("user_id", "frame", F.round(dbfs(F.col("rms")), 6).alias("rms_dbfs"), F.round("peak", 9).alias("peak"))


def silence_islands(spark: SparkSession, folder: str) -> DataFrame:
    framed = _frames(spark, folder)
    found = signal.quiet_runs(framed, ["user_id"], signal.silence_thresholds(framed, ["user_id"]), 2)
    return found.select("user_id", "first", "last", "frames", F.round(dbfs(F.col("level")), 6).alias("level_db"))


def noise_floor(spark: SparkSession, folder: str) -> DataFrame:
    return signal.noise_floor(_frames(spark, folder), ["user_id"], 2, 4).select("user_id", F.round("floor_db", 6).alias("floor_db"))


def room_tone(spark: SparkSession, folder: str) -> DataFrame:
    framed = _frames(spark, folder)
    return signal.room_tone(framed, signal.noise_floor(framed, ["user_id"], 2, 4), ["user_id"])


def cleaning_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a change to each clip left its voice alone: softer by its id, some with frames that are gone."""
    clips = table(spark, folder, "embeddings").where("embedding is not null").select("vec_id", F.posexplode("embedding").alias("i", "a"))
    gone = (F.col("vec_id") % 3 == 0) & (F.col("i") < 8 * (F.col("vec_id") % 7))
    pairs = clips.withColumn("b", F.when(gone, 0.0).otherwise(F.col("a").cast("double") * (1 - (F.col("vec_id") % 4) * 0.05)))
    floors = table(spark, folder, "embeddings").select("vec_id", F.lit(-40.0).alias("floor_db"))
    return signal.cleaning_check(signal.cleaned_frames(pairs, ["vec_id"], "i", "a", "b", 8), floors, ["vec_id"])


def duet_mixes(spark: SparkSession, folder: str) -> DataFrame:
    """Each clip and the one after it as two readers of three passages: energies of the mix and of both parts of it."""
    clips = table(spark, folder, "embeddings").where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("n1"))
    tracks = clips.join(clips.select((F.col("vec_id") - 1).alias("vec_id"), F.col("n1").alias("n2")), "vec_id").where(F.size("n1") == F.size("n2"))
    size = 16
    part = lambda c: F.slice(c, F.col("chunk").cast("int") * size + 1, size).alias(c)
    cut = tracks.select("vec_id", F.size("n1").cast("long").alias("length"), "n1", "n2", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.size("n1") / size) - 1)).alias("chunk"))
    passages = tracks.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).withColumn("start", F.pmod(F.col("vec_id") * 7 + F.col("j") * 13, F.lit(50)) / 100)
    seat = F.element_at(F.array(*map(F.lit, ("N1", "N2", "narration"))), (F.pmod(F.col("vec_id") + F.col("j"), F.lit(3)) + 1).cast("int"))
    mixed = duet.mixed(cut.select("vec_id", "chunk", "length", part("n1"), part("n2")), passages.select("vec_id", "start", (F.col("start") + 0.15).alias("end"), seat.alias("seat")), ["vec_id"], 100, size)
    energy = lambda c: F.round(F.sum(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)), 6).alias(c)
    return mixed.groupBy("vec_id").agg(*map(energy, ("mix", "first", "second")))


TAKE = mastering.Delivery(rate=1000)


def _takes(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in recordings: the embeddings of a label end to end at 1 kHz, five of sixteen as faint as a room."""
    order = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    clips = table(spark, folder, "embeddings").where("embedding is not null").select("label", order.alias("at"), "embedding")
    samples = clips.select("label", "at", F.posexplode("embedding").alias("i", "v"))
    return samples.select("label", (F.col("at") * 64 + F.col("i")).alias("position"), (F.col("v") * F.when(F.col("at") % 16 < 5, 0.0002).otherwise(0.4)).alias("value"))


def mastered_takes(spark: SparkSession, folder: str) -> DataFrame:
    """What mastering makes of each take, or why it gives it up."""
    signal_ = mastering.chunked(_takes(spark, folder), ["label"], "position", "value", TAKE.chunk)
    report = mastering.mastered(signal_, ["label"], TAKE)[1]
    return report.select("label", "status", "abort_code", *[F.round(c, 4).alias(c) for c in mastering.REPORT[2:]])


def clip_loudness(spark: SparkSession, folder: str) -> DataFrame:
    """Gated loudness of every embedding taken as a clip of 64 samples at 100 Hz (K-weighting is recursive: no SQL for it)."""
    clips = table(spark, folder, "embeddings").where("embedding is not null")
    powers = clips.withColumn("powers", signal.block_powers(F.col("embedding").cast("array<double>"), F.lit(100)))
    return powers.select("vec_id", F.round(signal.integrated_lufs(F.col("powers")), 6).alias("lufs"))


def clip_true_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """Peak of every clip between its samples (no SQL: tests compare it with the definition)."""
    clips = table(spark, folder, "embeddings").where("embedding is not null")
    return clips.select("vec_id", F.round(dbfs(signal.true_peaks(F.col("embedding").cast("array<double>"))), 6).alias("true_peak_dbfs"))


def repair_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a clip whose loudest samples were cut off at 0.25 still counts as a local repair."""
    clips = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("before"))
    cut = F.transform("before", lambda v: F.least(v, F.lit(0.25)))
    checked = clips.withColumn("r", signal.repair_check(F.col("before"), cut))
    return checked.select("vec_id", "r.accepted", F.round("r.changed", 6).alias("changed"))


def _floors(spark: SparkSession, folder: str) -> DataFrame:
    return signal.noise_floor(_frames(spark, folder), ["user_id"], 2, 4)


def speech_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of each signal that speak, and its quiet segments of two frames or more."""
    return signal.speech(_frames(spark, folder), _floors(spark, folder), ["user_id"], 2)


def uneven_quiets(spark: SparkSession, folder: str) -> DataFrame:
    return signal.uneven_quiet(_frames(spark, folder), _floors(spark, folder), ["user_id"], -40.0, 1)


def room_tests(spark: SparkSession, folder: str) -> DataFrame:
    """What each signal would do as a silence that was recorded before a session."""
    floors = signal.room_floor(samples(spark, folder), ["user_id"], "position", "v", FRAME)
    lengths = samples(spark, folder).groupBy("user_id").agg((F.count(F.lit(1)) / 4).alias("seconds"))
    voice = -20.0 - F.col("user_id") % 7
    return floors.join(lengths, "user_id").withColumn("r", signal.room_test(F.col("floor_db"), F.col("seconds"), voice.cast("double"))).select("user_id", F.round("floor_db", 6).alias("floor_db"), F.round("r.predicted", 6).alias("predicted"), "r.status")


def packet_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the quantities of an order, as packet sizes, vary."""
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("sizes"))
    return rows.select("l_orderkey", signal.varies(F.col("sizes")).alias("varies"))


def _clip(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def edited_clips(spark: SparkSession, folder: str) -> DataFrame:
    """Levels of every clip mixed to one channel, resampled, spliced with its reverse, and raised by 6 dB."""
    x = F.col("x")
    made = {"mono": signal.mono(x, 2), "resampled": signal.resampled(x, 64, 40), "spliced": signal.spliced(x, F.reverse(x), 20, 40, 4), "raised": signal.gain(x, 6.0)}
    rows = _clip(spark, folder).select("vec_id", *[c.alias(n) for n, c in made.items()])
    return rows.select("vec_id", *[F.size(n).alias(f"{n}_n") for n in made], *[F.round(rms(F.col(n)), 9).alias(f"{n}_rms") for n in made])


PRESETS = [
    ("strict", -19.0, -17.0, -20.0, -17.5, -6.0, -30.0, 100, 0.5, 192, False, 0.01, 0.05, 0.01, 0.05),
    ("loose", -30.0, None, None, -12.0, -1.0, None, None, 2.0, 64, True, None, None, 0.0, 0.2),
    ("empty", *[None] * 14),
]
KINDS = ("mp3", "wav", "ogg", "unknown", None, "flac", "mp3")


def delivery_lights(spark: SparkSession, folder: str) -> DataFrame:
    """The ten checks of every clip under three presets; what a file says of itself goes by its id."""
    x, d = F.col("x"), F.col("vec_id")
    level = lambda i: rms(F.slice(x, i * 8 + 1, 8))
    levels = F.transform(F.sequence(F.lit(0), F.lit(7)), level)
    report = {
        "rms_db": dbfs(rms(x)), "lufs": dbfs(rms(x)) - F.lit(0.691), "peak_db": dbfs(peak(x)), "floor_db": dbfs(F.array_min(levels)), "uneven": F.array_max(levels) > 1.4 * F.array_min(levels),
        "sample_rate": F.when(d % 2 == 0, 100).otherwise(50), "channels": (d % 4).cast("int"), "samples": F.size(x) - (d % 5 == 0).cast("int"), "seconds": F.size(x) / 100,
        "format": F.element_at(F.array(*map(F.lit, KINDS)), (d % 7 + 1).cast("int")), "kbps": F.when(d % 3 > 0, F.when(d % 6 == 1, 256).otherwise(128)), "vbr": F.when(d % 8 > 0, d % 8 == 1),
        "head_s": (d % 6) / 100, "tail_s": (d % 30) / 100, "head_silent": d % 9 == 0, "tail_silent": d % 10 == 0,
    }
    reports = _clip(spark, folder).select("vec_id", *[c.alias(n) for n, c in report.items()])
    return signal.judged(reports, spark.createDataFrame(PRESETS, signal.PRESET_FIELDS), ["vec_id"])


QUERIES = {f.__name__: f for f in (clip_levels, frame_levels, silence_islands, noise_floor, room_tone, clip_loudness, clip_true_peaks, repair_gate)}

_DB = "CASE WHEN {0} <= 0 THEN CAST('-inf' AS DOUBLE) ELSE 20 * log10({0}) END"
_F = f"""s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value / {SCALE} AS v FROM events),
    f AS (SELECT user_id, pos // {FRAME} AS frame, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak FROM s GROUP BY ALL HAVING count(*) = {FRAME})"""


def _percentile(p: float, last: bool) -> str:
    return f"(SELECT user_id, rms FROM (SELECT user_id, rms, row_number() OVER (PARTITION BY user_id ORDER BY rms) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM f) WHERE i = least(floor((n - {int(last)}) * {p}), n - 1))"


def _runs(threshold: str) -> str:
    return f"""th AS ({threshold}), fl AS (SELECT f.user_id, frame, rms, rms <= t AS quiet FROM f JOIN th USING (user_id)),
    tu AS (SELECT *, CASE WHEN quiet = lag(quiet) OVER (PARTITION BY user_id ORDER BY frame) THEN 0 ELSE 1 END AS turned FROM fl),
    il AS (SELECT *, sum(turned) OVER (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS island FROM tu),
    runs AS (SELECT user_id, min(frame) AS a, max(frame) AS z, count(*) AS frames, sqrt(avg(rms * rms)) AS level FROM il WHERE quiet GROUP BY user_id, island HAVING count(*) >= 2)"""


_FLOOR = f"""WITH {_F}, lo AS (SELECT user_id, max(rms) AS top FROM f GROUP BY user_id),
    {_runs(f"SELECT user_id, pow(10.0, least(20 * log10(x.rms) + 3, 20 * log10(top) - 20) / 20) AS t FROM {_percentile(0.1, True)} x JOIN lo USING (user_id)")},
    sl AS (SELECT user_id, frame, rms, avg(rms * rms) OVER w AS m, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
    q AS (SELECT user_id, sqrt(coalesce(min(m) FILTER (WHERE n = 4), avg(rms * rms))) AS slid FROM sl GROUP BY user_id),
    b AS (SELECT user_id, min(level) AS level FROM runs GROUP BY user_id),
    fb AS (SELECT user_id, {_DB.format('coalesce(level, slid)')} AS floor_db FROM q LEFT JOIN b USING (user_id))"""

ORACLES = {
    "clip_levels": f"""WITH c AS (SELECT vec_id, sqrt(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 'avg')) AS r,
            list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS p FROM embeddings), d AS (SELECT vec_id, {_DB.format('r')} AS l, {_DB.format('p')} AS t FROM c)
        SELECT vec_id, round(l, 6) AS rms_dbfs, round(t, 6) AS peak_dbfs, CASE WHEN l < -19 OR l > -17 OR t > -6 THEN 'red' WHEN l + 19 <= 0.5 OR -17 - l <= 0.5 OR -6 - t <= 0.5 THEN 'yellow' ELSE 'green' END AS light FROM d""",
    "repair_gate": """WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings),
        s AS (SELECT vec_id, b, list_transform(b, lambda x: least(x, 0.25)) AS a FROM m),
        r AS (SELECT vec_id, len(b) AS n, len(list_filter(b, lambda x: x - 0.25 > 1.0 / 65536)) / len(b) AS changed,
                     list_sum(list_transform(b, lambda x: x * x)) AS sb, list_sum(list_transform(a, lambda x: x * x)) AS sa, list_max(list_transform(a, lambda x: abs(x))) AS top FROM s)
        SELECT vec_id, coalesce(n > 0 AND top <= 1.0001 AND changed <= 0.02 AND abs(10 * log10(sa / sb)) <= 0.1, false) AS accepted,
               CASE WHEN n > 0 AND top <= 1.0001 THEN round(changed, 6) ELSE 0 END AS changed FROM r""",
    "frame_levels": f"WITH {_F} SELECT user_id, frame, round({_DB.format('rms')}, 6) AS rms_dbfs, round(peak, 9) AS peak FROM f",
    "silence_islands": f"""WITH {_F}, {_runs(f"SELECT user_id, least(pow(10.0, -45.0 / 20), greatest(rms * pow(10.0, 12.0 / 20), 1e-6)) AS t FROM {_percentile(0.1, False)}")}
        SELECT user_id, a AS "first", z AS "last", frames, round({_DB.format('level')}, 6) AS level_db FROM runs""",
    "noise_floor": f"{_FLOOR} SELECT user_id, round(floor_db, 6) AS floor_db FROM fb",
    "room_tone": f"""{_FLOOR}, k AS (SELECT f.user_id, frame, {_DB.format('rms')} > CASE WHEN floor_db = CAST('-inf' AS DOUBLE) THEN -60 ELSE greatest(floor_db, -90) + 10 END AS speaks FROM f JOIN fb USING (user_id)),
        e AS (SELECT user_id, min(frame) AS a, max(frame) AS z, min(frame) FILTER (WHERE speaks) AS x, max(frame) FILTER (WHERE speaks) AS y FROM k GROUP BY user_id)
        SELECT user_id, coalesce(x - a, z - a + 1) AS head_frames, coalesce(z - y, z - a + 1) AS tail_frames FROM e""",
}
_TIMED = f"""db AS (SELECT user_id, frame, {_DB.format('rms')} AS db FROM f)"""
_PRESET_SQL = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in p) + ")" for p in PRESETS)
ORACLES |= {
    "speech_shares": f"""{_FLOOR}, {_TIMED}, q10 AS (SELECT user_id, {_DB.format('rms')} AS p10 FROM {_percentile(0.1, True)}), li AS (SELECT user_id, CASE WHEN floor_db > CAST('-inf' AS DOUBLE) THEN floor_db ELSE p10 END + 10 AS l FROM fb JOIN q10 USING (user_id)),
        ov AS (SELECT *, db > l AS o, max(db) OVER (PARTITION BY user_id) AS top FROM db JOIN li USING (user_id)), spk AS (SELECT user_id, frame, CASE WHEN bool_or(o) OVER (PARTITION BY user_id) THEN o ELSE db >= top - 6 END AS s FROM ov),
        tn AS (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY user_id ORDER BY frame) THEN 0 ELSE 1 END AS t FROM spk), isl AS (SELECT *, sum(t) OVER (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS k FROM tn),
        rn AS (SELECT user_id, count(*) AS n, any_value(s) AS s FROM isl GROUP BY user_id, k) SELECT user_id, CAST(sum(n) AS BIGINT) AS frames, CAST(sum(CASE WHEN s THEN n ELSE 0 END) AS BIGINT) AS speech_frames, count(*) FILTER (WHERE NOT s AND n >= 2) AS quiet_segments FROM rn GROUP BY user_id""",
    "uneven_quiets": f"""{_FLOOR}, {_TIMED}, rk AS (SELECT user_id, db, row_number() OVER (PARTITION BY user_id ORDER BY db) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM db WHERE db > CAST('-inf' AS DOUBLE)),
        p90 AS (SELECT user_id, db - 15 AS ceiling FROM rk WHERE i = least(floor(n * 0.9), n - 1)), kn AS (SELECT db.*, floor_db, coalesce(ceiling, CAST('-inf' AS DOUBLE)) AS ceiling FROM db LEFT JOIN p90 USING (user_id) JOIN fb USING (user_id)),
        ed AS (SELECT *, min(frame) FILTER (WHERE db > ceiling) OVER (PARTITION BY user_id) AS a, max(frame) FILTER (WHERE db > ceiling) OVER (PARTITION BY user_id) AS z FROM kn)
        SELECT user_id, bool_or(coalesce(frame > a AND frame < z AND db > -40 AND db > floor_db + 12 AND db <= ceiling, false) AND floor_db > CAST('-inf' AS DOUBLE)) AS uneven FROM ed GROUP BY user_id""",
    "room_tests": f"""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value / {SCALE} AS v FROM events), fr AS (SELECT user_id, stddev_pop(v) AS l FROM s GROUP BY user_id, pos // {FRAME} HAVING count(*) = {FRAME}),
        rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY l) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM fr WHERE l > 1e-9), pk AS (SELECT user_id, l FROM rk WHERE i = least(floor((n - 1) * 0.2), n - 1)),
        al AS (SELECT user_id, sqrt(avg(v * v)) AS a, count(*) / 4 AS seconds FROM s GROUP BY user_id), fl AS (SELECT user_id, seconds, {_DB.format('coalesce(l, a)')} AS floor_db FROM al LEFT JOIN pk USING (user_id)),
        pr AS (SELECT *, CASE WHEN floor_db > CAST('-inf' AS DOUBLE) THEN floor_db + user_id % 7 ELSE floor_db END AS predicted FROM fl)
        SELECT user_id, round(floor_db, 6) AS floor_db, round(predicted, 6) AS predicted, CASE WHEN seconds < 10 OR seconds > 20 OR floor_db = CAST('-inf' AS DOUBLE) THEN 'warn' WHEN predicted > -60 THEN 'fail' WHEN -60 - predicted <= 0.5 THEN 'warn' ELSE 'pass' END AS status FROM pr""",
    "packet_rates": """WITH s AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS s FROM lineitem GROUP BY l_orderkey)
        SELECT l_orderkey, CASE WHEN len(s) >= 3 THEN s[least(CAST(floor(len(s) * 0.9) AS INT), len(s) - 1) + 1] - s[least(CAST(floor(len(s) * 0.1) AS INT), len(s) - 1) + 1] > 1 END AS varies FROM s""",
    "edited_clips": """WITH c AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL),
        m AS (SELECT vec_id, list_transform(range(len(x) // 2), lambda i: (x[2 * i + 1] + x[2 * i + 2]) / 2) AS mono,
            list_transform(range(40), lambda i: x[CAST(floor(i * 1.6) AS INT) + 1] + (x[least(CAST(floor(i * 1.6) AS INT) + 2, 64)] - x[CAST(floor(i * 1.6) AS INT) + 1]) * (i * 1.6 - floor(i * 1.6))) AS resampled,
            list_concat(x[1:16], list_transform(range(4), lambda i: x[16 + i + 1] * (1 - (i + 1) / 5) + list_reverse(x)[i + 1] * ((i + 1) / 5)), list_reverse(x)[5:60],
                        list_transform(range(4), lambda i: list_reverse(x)[60 + i + 1] * (1 - (i + 1) / 5) + x[40 + i + 1] * ((i + 1) / 5)), x[45:64]) AS spliced,
            list_transform(x, lambda v: greatest(-1, least(1, v * pow(10, 6.0 / 20)))) AS raised FROM c)
        SELECT vec_id, """ + ", ".join(f"CAST(len({n}) AS INT) AS {n}_n, round(sqrt(list_avg(list_transform({n}, lambda v: v * v))), 9) AS {n}_rms" for n in ("mono", "resampled", "spliced", "raised")) + " FROM m",
    "delivery_lights": f"""WITH c AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL),
        r AS (SELECT vec_id, x, sqrt(list_avg(list_transform(x, lambda v: v * v))) AS a, list_max(list_transform(x, lambda v: abs(v))) AS b, list_transform(range(8), lambda i: sqrt(list_avg(list_transform(x[i * 8 + 1:i * 8 + 8], lambda v: v * v)))) AS l FROM c),
        g AS (SELECT vec_id AS d, {_DB.format('a')} AS rms_db, {_DB.format('a')} - 0.691::DOUBLE AS lufs, {_DB.format('b')} AS peak_db, {_DB.format('list_min(l)')} AS floor_db, list_max(l) > 1.4::DOUBLE * list_min(l) AS uneven,
                     CASE WHEN vec_id % 2 = 0 THEN 100 ELSE 50 END AS sr, vec_id % 4 AS ch, len(x) - CAST(vec_id % 5 = 0 AS INT) AS n, len(x) / 100 AS seconds, ['mp3', 'wav', 'ogg', 'unknown', 'unknown', 'flac', 'mp3'][vec_id % 7 + 1] AS kind,
                     CASE WHEN vec_id % 3 > 0 THEN CASE WHEN vec_id % 6 = 1 THEN 256 ELSE 128 END END AS kbps, CASE WHEN vec_id % 8 > 0 THEN vec_id % 8 = 1 END AS vbr, (vec_id % 6)::DOUBLE / 100 AS hs, (vec_id % 30)::DOUBLE / 100 AS ts FROM r),
        p(preset, lo, hi, ll, lh, pk, fl, rt, sec, kb, va, hl, hh, tl, th) AS (VALUES {_PRESET_SQL}),
        f AS (SELECT *, CASE WHEN fl IS NULL THEN 'unspecified' WHEN floor_db = CAST('-inf' AS DOUBLE) THEN 'warn' WHEN floor_db > fl THEN 'fail' WHEN fl - floor_db <= 0.5 THEN 'warn' ELSE 'pass' END AS q FROM g, p),
        k AS (SELECT d AS vec_id, preset, CASE WHEN lo IS NULL AND hi IS NULL THEN 'unspecified' WHEN coalesce(rms_db < lo, false) OR coalesce(rms_db > hi, false) THEN 'fail' WHEN coalesce(rms_db - lo <= 0.5, false) OR coalesce(hi - rms_db <= 0.5, false) THEN 'warn' ELSE 'pass' END AS rms,
            CASE WHEN ll IS NULL AND lh IS NULL THEN 'unspecified' WHEN coalesce(lufs < ll, false) OR coalesce(lufs > lh, false) THEN 'fail' WHEN coalesce(lufs - ll <= 0.2, false) OR coalesce(lh - lufs <= 0.2, false) THEN 'warn' ELSE 'pass' END AS loudness,
            CASE WHEN pk IS NULL THEN 'unspecified' WHEN peak_db > pk THEN 'fail' WHEN pk - peak_db <= 0.5 THEN 'warn' ELSE 'pass' END AS peak,
            CASE WHEN q = 'pass' AND uneven THEN 'warn' ELSE q END AS floor,
            CASE WHEN rt IS NULL THEN 'unspecified' WHEN sr = rt THEN 'pass' ELSE 'fail' END AS rate, CASE WHEN ch IN (1, 2) AND n % ch = 0 THEN 'pass' ELSE 'fail' END AS channels,
            CASE WHEN sec IS NULL THEN 'unspecified' WHEN seconds <= sec THEN 'pass' ELSE 'fail' END AS length,
            CASE WHEN kind = 'unknown' THEN 'warn' WHEN kind = 'ogg' THEN 'fail' WHEN kb IS NULL OR kind <> 'mp3' THEN 'pass' WHEN coalesce(vbr AND NOT va, false) OR coalesce(kbps < kb, false) THEN 'fail' WHEN kbps IS NULL OR vbr IS NULL THEN 'warn' ELSE 'pass' END AS format,
            CASE WHEN hl IS NULL THEN 'unspecified' WHEN hs BETWEEN hl AND hh AND d % 9 <> 0 THEN 'pass' ELSE 'fail' END AS head, CASE WHEN tl IS NULL THEN 'unspecified' WHEN ts BETWEEN tl AND th AND d % 10 <> 0 THEN 'pass' ELSE 'fail' END AS tail FROM f)
        SELECT *, CASE WHEN 'fail' IN (rms, loudness, peak, floor, rate, channels, length, format, head, tail) THEN 'red' WHEN 'warn' IN (rms, loudness, peak, floor, rate, channels, length, format, head, tail) THEN 'yellow' ELSE 'green' END AS light FROM k""",
}
QUERIES |= {f.__name__: f for f in (speech_shares, uneven_quiets, room_tests, packet_rates, edited_clips, delivery_lights, mastered_takes, cleaning_checks, duet_mixes)}
ORACLES |= {
    "cleaning_checks": """
        WITH s AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS a FROM embeddings),
        p AS (SELECT vec_id, i // 8 AS f, a, CASE WHEN vec_id % 3 = 0 AND i < 8 * (vec_id % 7) THEN 0 ELSE a * (1 - (vec_id % 4) * 0.05::DOUBLE) END AS b FROM s),
        f AS (SELECT vec_id, f, count(*) AS n, sum(a * a) AS x, sum(b * b) AS y, sum(a * b) AS d, bool_and(abs(b) <= 1.0001) AS ok FROM p GROUP BY ALL),
        m AS (SELECT *, 10 * log10(greatest(x / n, 1e-20)) AS lv, 10 * log10(greatest(y, 1e-20) / greatest(x, 1e-20)) AS ch, d / sqrt(greatest(x * y, 1e-30)) AS co FROM f),
        k AS (SELECT *, lv >= -30 AND (ch < CASE WHEN lv >= -22 THEN -3 ELSE -6 END OR ch > 0.5 OR co < CASE WHEN lv >= -22 THEN 0.98 ELSE 0.9 END) AS bad FROM m),
        r AS (SELECT *, f - row_number() OVER (PARTITION BY vec_id, bad ORDER BY f) AS g FROM k),
        l AS (SELECT vec_id, max(c) AS longest FROM (SELECT vec_id, g, count(*) AS c FROM r WHERE bad GROUP BY ALL) GROUP BY ALL),
        t AS (SELECT vec_id, CAST(count(*) FILTER (WHERE lv >= -30) AS BIGINT) AS active, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS altered, bool_and(ok) AS ok FROM k GROUP BY ALL)
        SELECT vec_id, ok AND active > 0 AND coalesce(longest, 0) < 5 AND altered <= 0.02 * active AS safe, active, altered FROM t LEFT JOIN l USING (vec_id)""",
    "duet_mixes": """
        WITH e AS (SELECT vec_id, embedding AS x FROM embeddings WHERE embedding IS NOT NULL),
        c AS (SELECT a.vec_id, a.x AS n1, b.x AS n2, len(a.x) AS n FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE len(a.x) = len(b.x)),
        g AS (SELECT vec_id, j, ((vec_id * 7 + j * 13) % 50)::DOUBLE / 100 AS s, (vec_id + j) % 3 = 1 AS two FROM c, range(3) t(j)),
        i AS (SELECT c.vec_id, n, t.i, CAST(n1[t.i + 1] AS DOUBLE) AS a, CAST(n2[t.i + 1] AS DOUBLE) AS b FROM c, range(64) t(i) WHERE t.i < n),
        m AS (SELECT i.vec_id, i.n, i.i, any_value(a) AS a, any_value(b) AS b, coalesce(arg_max(two, s) FILTER (WHERE i.i >= floor(s * 100) AND i.i < ceil((s + 0.15::DOUBLE) * 100)), false) AS two
              FROM i JOIN g USING (vec_id) GROUP BY ALL),
        w AS (SELECT *, lag(two) OVER o AS before, lead(two) OVER o AS after, lag(two, 2) OVER o AS earlier FROM m WINDOW o AS (PARTITION BY vec_id ORDER BY i)),
        h AS (SELECT *, CASE WHEN after <> two THEN CASE WHEN after THEN 0.0 ELSE 1.0 END
                             WHEN before <> two THEN CASE WHEN i = n - 1 THEN CASE WHEN two THEN 1.0 ELSE 0.0 END ELSE 0.5 END
                             WHEN earlier <> before THEN CASE WHEN before THEN 1.0 ELSE 0.0 END
                             WHEN two THEN 1.0 ELSE 0.0 END::DOUBLE AS share FROM w)
        SELECT vec_id, round(sum((a * (1 - share) + b * share) * (a * (1 - share) + b * share)), 6) AS mix, round(sum(a * (1 - share) * a * (1 - share)), 6) AS first, round(sum(b * share * b * share), 6) AS second
        FROM h GROUP BY ALL""",
}
