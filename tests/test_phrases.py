"""Windows that are due for a second look, told cases and a stream against the batch."""

import random

from inkstream.streaming import phrases as P

HOPS = "session string, seq long, seconds double, speech double, cursor int, covered int, start double, gold int, last boolean"


def reading(n, words_a_hop=1, seconds=0.5, speech=0.4, last=False, stall=()):
    rows, page = [], 0
    for i in range(n):
        after = page if i in stall else page + words_a_hop
        rows.append((i, seconds, speech, page, after, i * seconds, after, last and i == n - 1))
        page = after
    return rows


def run(rows):
    buffer, out = P.Buffer(), []
    for seq, seconds, speech, cursor, covered, start, gold, last in rows:
        buffer, window = P.drained(buffer.added(P.Hop(seq, seconds, speech, cursor, covered, start)), gold, last)
        assert P.Buffer.load(buffer.dump()) == buffer
        out += [window] if window else []
    return buffer, out


def test_a_phrase_is_drained_once_it_is_read():
    buffer, found = run(reading(20))
    assert [w.taken for w in found] == [tuple(range(8)), tuple(range(8, 16))]
    assert found[0].cursor == 0 and found[0].read == 8 and found[0].start == 0.0
    assert found[1].hops[:3] == (5, 6, 7) and found[1].cursor == 5 and found[1].start == 2.5  # 0.85 s of speech before it
    assert [h.seq for h in buffer.hops] == [16, 17, 18, 19] and buffer.cursor == 16


def test_a_reading_that_stands_still_is_drained_with_what_follows():
    _, found = run(reading(9, stall=(4, 5, 6, 7, 8)))
    assert found[0].taken == (0, 1, 2, 3, 4) and found[0].read == 8
    _, found = run(reading(3, stall=(1, 2), seconds=0.2))
    assert found == []  # not long enough


def test_silence_is_carried_but_does_not_count_as_run_up():
    rows = [(i, 0.4, 0.0 if 5 <= i < 8 else 0.4, i, i + 1, i * 0.4, i + 1, False) for i in range(16)]
    _, found = run(rows)
    assert found[1].hops[0] == 4 and sum(0.4 for i in found[1].hops if i < 8) <= P.RUN_UP_MOST + 1e-9


def test_the_end_drains_everything_and_empty_hops_do_not_count():
    _, found = run(reading(3, last=True))
    assert [w.taken for w in found] == [(0, 1, 2)] and found[0].read == 3
    assert run([(0, 0.0, 0.0, 0, 0, 0.0, 0, True)]) == (P.Buffer(), [])


def table(seed):
    r, rows = random.Random(seed), []
    for s in ("a", "b", "c"):
        page = 0
        for i in range(80):
            after = page + r.choice([0, 0, 1, 1, 1, 2, 9])
            seconds = r.choice([0.16, 0.5])
            rows.append((s, i, seconds, round(seconds * r.random(), 3), page, after, i * 0.5, max(page, after - r.choice([0, 0, 1])), i == 79))
            page = after
    return rows


def test_every_hop_is_taken_once():
    for seed in range(6):
        for s in ("a", "b", "c"):
            _, found = run([x[1:] for x in table(seed) if x[0] == s])
            assert sorted(i for w in found for i in w.taken) == list(range(80))


def test_a_stream_is_the_batch_whatever_the_micro_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = table(1)
    whole = sorted(map(str, (tuple(r) for r in P.windows(spark.createDataFrame(rows, HOPS)).collect())))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 7), (7, 8), (8, 80)):
        spark.createDataFrame([r for r in rows if low <= r[1] < high], HOPS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(HOPS).option("maxFilesPerTrigger", 1).parquet(folder)
        query = P.window_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(180)
    names = [c.split()[0] for c in P.WINDOWS.split(", ")]
    assert sorted(map(str, (tuple(r) for r in spark.read.parquet(out).select(names).collect()))) == whole and len(whole) > 6


def test_the_sound_of_a_window(spark):
    hops = spark.createDataFrame([("a", i, [float(i)] * 2, 100.0) for i in range(12)], "session string, seq long, samples array<double>, rate double")
    found = P.windows(spark.createDataFrame([("a", *x) for x in reading(12)], HOPS))
    assert [r.samples for r in P.sound_of(found, hops, "taken").collect()] == [[float(i) for i in range(8) for _ in range(2)]]
    loud = spark.createDataFrame([([0.5] * 5 + [0.001] * 5, 100.0), (None, 100.0), ([0.5], 100.0)], "x array<double>, r double")
    assert [r[0] for r in loud.select(P.speech_seconds("x", "r")).collect()] == [0.06, 0.0, 0.0]
