"""Mastering: each stage against a plain loop, signals in chunks against whole ones, and the outcomes of whole files."""

import math

import numpy as np
import pytest

from inkstream.operators import mastering as M
from inkstream.operators import signal as S

RATE = 1000
SHORT = M.Delivery(rate=RATE, head=0.7, tail=0.9)


def db(x):
    return 10 * math.log10(np.mean(np.square(x))) if len(x) and np.any(x) else -math.inf


def plain_gate(x, rate, limit, strict, floor):
    needed = max(0.0, floor + 70) if floor > -math.inf else 18.0
    low = 1.0 if needed == 0 else 10 ** (-min(30, max(6, needed + 3)) / 20)
    frame, envelope, out = round(rate * 0.02), low, []
    for i, v in enumerate(x):
        loud = db(x[i // frame * frame : (i // frame + 1) * frame])
        target = 1.0 if (loud > limit if strict else loud >= limit) else low
        envelope += (target - envelope) / max(1, round(rate * (0.005 if target > envelope else 0.5)))
        out.append(v * envelope)
    return np.array(out)


def plain_compressor(x, rate):
    detector, attack, release = (math.exp(-1 / (rate * s)) for s in (0.05, 0.01, 0.15))
    power, gain, out = 0.0, 0.0, []
    for v in x:
        power = detector * power + (1 - detector) * v * v
        target = -max(0.0, 10 * math.log10(max(power, 1e-20)) + 28) * 0.5
        keep = attack if target < gain else release
        gain = keep * gain + (1 - keep) * target
        out.append(v * 10 ** (gain / 20))
    return np.array(out)


def plain_limiter(x, rate, ceiling, gain_db):
    x, top = x * 10 ** (gain_db / 20), 10 ** (ceiling / 20)
    attack, hold, keep = round(rate * 0.005), round(rate * 0.01), math.exp(-1 / (rate * 0.08))
    gains, gain = [], 1.0
    for i in range(len(x)):
        gain = min(min(1.0, top / max(np.abs(x[max(0, i - hold + 1) : i + 1]).max(), 1e-20)), 1 - (1 - gain) * keep)
        gains.append(gain)
    for i in range(len(x) - 2, -1, -1):
        gains[i] = min(gains[i], gains[i + 1] + 1 / attack)
    return x * gains


def in_chunks(stage, x, size):
    parts = [y for i in range(0, len(x), size) if (y := stage.feed(x[i : i + size])) is not None]
    return parts + ([y] if (y := stage.close()) is not None else [])


def voice(seconds, seed=0, loud=0.1, soft=0.0003, rate=RATE, talk=0.75):
    """Bursts of a tone over a noise floor."""
    r, n = np.random.default_rng(seed), int(seconds * rate)
    t = np.arange(n) / rate
    speaks = (t % 1.0 < talk) & (t > 0.5) & (t < seconds - 0.5)
    return np.where(speaks, loud * np.sin(2 * np.pi * 97 * t) * (1 + 0.5 * np.sin(t * 3)), 0.0) + r.normal(0, soft, n)


@pytest.mark.parametrize("rate", (1000, 8000))
@pytest.mark.parametrize("seed", range(3))
def test_stages_are_plain_loops(rate, seed):
    x = voice(4.3, seed, 0.3, 0.002, rate) + np.where(np.random.default_rng(seed).random(int(4.3 * rate)) < 0.002, 0.9, 0.0)
    frame, chunk = round(rate * 0.02), round(rate * 0.02) * 7
    for limit, strict, floor in ((-40.0, True, -55.0), (-20.0, False, -math.inf), (-40.0, True, -80.0)):
        assert np.allclose(np.concatenate(in_chunks(M.Gate(rate, limit, strict, floor), x, chunk)), plain_gate(x, rate, limit, strict, floor), atol=1e-12)
    assert np.allclose(np.concatenate(in_chunks(M.Compressor(rate), x, chunk)), plain_compressor(x, rate), atol=1e-12)
    for gain in (-6.0, 0.0, 14.0):
        assert np.allclose(np.concatenate(in_chunks(M.Limiter(rate, -3.2, gain), x, chunk)), plain_limiter(x, rate, -3.2, gain), atol=1e-12)
    found = in_chunks(M.Measure(frame, 0.5), x, chunk)
    y = x * 0.5
    assert sum(m["n"] for m in found) == len(x) and max(m["peak"] for m in found) == pytest.approx(S.true_peak(y), abs=1e-12)
    assert np.allclose([v for m in found for v in m["levels"]], [math.sqrt(np.mean(y[i : i + frame] ** 2)) for i in range(0, len(y), frame)])


def test_sliding_and_decayed_maxima():
    r = np.random.default_rng(4)
    for n, width in ((1, 1), (5, 9), (40, 7), (64, 8)):
        x = r.random(n)
        assert M.sliding_max(x, width).tolist() == [x[max(0, i - width + 1) : i + 1].max() for i in range(n)]
        y, last = [], 0.3
        for v in x:
            last = max(v, 0.9 * last)
            y.append(last)
        assert np.allclose(M.decayed_max(x, 0.3, 0.9, 6), y)


def test_room_tone_is_kept_if_steady_or_made_the_same_each_time():
    room = 10 ** (-75 / 20) * np.sin(np.arange(400) * 2 * np.pi / 5)
    assert (M.steady(room, 20) == room).all()
    loud = M.steady(room * 10, 20)
    assert max(db(loud[i : i + 20]) for i in range(0, 400, 20)) == pytest.approx(-70)
    fading = room * np.linspace(1, 0.01, 400)
    assert (M.steady(fading, 20) == M.noise(200, max(-90.0, db(fading)))).all()
    state, first = 0x6D2B79F5, []
    for _ in range(3):
        state = (state * 1664525 + 1013904223) % 2**32
        first.append((state / 2**32 * 2 - 1) * 10 ** (-70 / 20) * math.sqrt(3))
    assert M.noise(3).tolist() == first and db(M.noise(4000)) == pytest.approx(-70, abs=0.2)


def test_pieces_end_to_end_become_chunks(spark):
    rows = [("a", 0, [1.0, 2.0]), ("a", 2, [3.0] * 7), ("a", 9, [4.0]), ("b", 0, [5.0] * 3), ("b", 3, [])]
    found = M.joined(spark.createDataFrame(rows, "f string, start long, samples array<double>"), ["f"], 4).collect()
    assert sorted((r.f, r.chunk, r.samples) for r in found) == [("a", 0, [1, 2, 3, 3]), ("a", 1, [3] * 4), ("a", 2, [3, 4]), ("b", 0, [5] * 3)]


FILES = {
    "good": voice(6.0),
    "loud": voice(6.0, 1, 0.6, 0.0002),
    "edges": np.concatenate([np.zeros(130), voice(4.0, 2), np.zeros(77)]),
    "silent": np.zeros(3000),
    "hum": voice(5.0, 3, 0.05, 0.01, talk=1.0),
    "peaks": np.where((np.arange(6000) % 150 == 0) & (np.abs(np.arange(6000) - 3000) < 2400), 0.9, 0.0) + voice(6.0, 4, 0.0, 0.00001),
    "long": voice(9.0, 5),
    "short": voice(0.03),
}


@pytest.fixture(scope="module")
def outcome(spark):
    rows = [(name, i, float(v)) for name, x in FILES.items() for i, v in enumerate(x)]
    samples = spark.createDataFrame(rows, "file string, at int, value double").repartition(5)
    delivery = SHORT._replace(seconds_most=8.0)
    out, report = M.mastered(M.chunked(samples, ["file"], "at", "value", delivery.chunk), ["file"], delivery)
    parts = {}
    for r in sorted(out.collect(), key=lambda r: r.chunk):
        parts.setdefault(r.file, []).extend(r.samples)
    return {k: np.array(v) for k, v in parts.items()}, {r.file: r for r in report.collect()}


def test_files_that_are_delivered_fit(outcome):
    out, report = outcome
    assert {"good", "loud", "edges"} <= set(out) and set(report) == set(FILES)
    for name, x in out.items():
        r = report[name]
        assert r.status == "ok" and -23 <= db(x) <= -18 and r.level_db == pytest.approx(db(x), abs=1e-6)
        assert 20 * math.log10(S.true_peak(x)) <= -3.0 and r.peak_db == pytest.approx(20 * math.log10(S.true_peak(x)), abs=1e-6)
        body = FILES[name][np.flatnonzero(np.abs(FILES[name]) > 1e-9)[0] : np.flatnonzero(np.abs(FILES[name]) > 1e-9)[-1] + 1]
        assert len(x) == len(body) + 700 + 900 and r.floor_after_db <= -60


def test_a_file_is_what_plain_loops_make_of_it(outcome):
    out, report = outcome
    x, r = FILES["good"], report["good"]
    speech = [db(x[i : i + 20]) > r.floor_db + 10 for i in range(0, len(x), 20)]
    shaped = plain_compressor(plain_gate(x, RATE, r.floor_db + 10, True, r.floor_db), RATE)
    quiet, at = [], 0
    while at < len(speech):
        end = at
        while end < len(speech) and speech[end] == speech[at]:
            end += 1
        if not speech[at] and end - at >= 10:
            quiet.append((at, end))
        at = end

    def pads(y):
        a, b = min(quiet, key=lambda q: db(y[q[0] * 20 : q[1] * 20]))
        room = M.steady(y[a * 20 : b * 20], 20)
        return np.resize(room, 700), np.resize(room, 900)

    framed = lambda y: np.concatenate([pads(y)[0], y, pads(y)[1]])
    gain = -20 - db(framed(shaped))
    assert r.gain_db == pytest.approx(gain, abs=1e-9)
    y = plain_limiter(shaped, RATE, -3.2, gain)
    y = y * min(1.0, 10 ** (-3.2 / 20) / S.true_peak(y))
    assert -23 <= db(framed(y)) <= -18 and np.allclose(out["good"], framed(y), atol=1e-9)


def test_files_that_are_given_up_say_why(outcome):
    _, report = outcome
    codes = {name: r.abort_code for name, r in report.items()}
    assert codes["silent"] == "no_speech" and codes["hum"] == "noise_floor" and codes["peaks"] == "level" and codes["long"] == "structure"


def test_a_peak_over_the_limit_and_no_files(spark):
    samples = spark.createDataFrame([("f", i, float(v)) for i, v in enumerate(voice(4.0))], "file string, at int, value double")
    signal = M.chunked(samples, ["file"], "at", "value", SHORT.chunk)
    assert M.mastered(signal, ["file"], SHORT._replace(peak_most=-30.0))[1].first().abort_code == "true_peak"
    out, report = M.mastered(signal.limit(0), ["file"], SHORT)
    assert out.count() == report.count() == 0
