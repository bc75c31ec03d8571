"""Windows of a live recording that are due for a second look: a keyed, stateful operator over hops of sound.

A hop is a row: where the page stood before and after it, how long it is and how much of it is speech. Hops pile up until the
page has passed a phrase, or stands still on a word long enough; then those of the phrase are drained into a window, with a
run-up of speech that was already looked at and a little of what follows. State and windows hold the numbers of hops and not
their samples, which stay in their own table and are joined by number, so a session's state is some dozen small rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: Words of a phrase; seconds of sound on one word that count as standing still, of speech in a run-up and of a run-up
#: in all, and of what follows; level from which a frame of 20 ms is speech.
PHRASE, STILL, RUN_UP, RUN_UP_MOST, AFTER, SPEECH_RMS, FRAME = 8, 0.9, 0.85, 1.6, 0.8, 0.01, 0.02


class Hop(NamedTuple):
    seq: int
    seconds: float
    speech: float  # seconds
    cursor: int  # of the page, before it
    covered: int  # and after
    start: float


class Window(NamedTuple):
    hops: tuple[int, ...]  # run-up, phrase and what follows
    taken: tuple[int, ...]  # of the phrase alone
    cursor: int
    read: int
    start: float


class Buffer(NamedTuple):
    hops: tuple[Hop, ...] = ()
    run_up: tuple[Hop, ...] = ()
    cursor: int = 0

    def dump(self) -> str:
        return json.dumps(self)

    @classmethod
    def load(cls, text: str) -> Buffer:
        hops, run_up, cursor = json.loads(text)
        return cls(tuple(Hop(*h) for h in hops), tuple(Hop(*h) for h in run_up), cursor)

    def added(self, hop: Hop) -> Buffer:
        if hop.seconds <= 0:
            return self
        hop = hop._replace(cursor=max(0, hop.cursor), covered=max(0, hop.cursor, hop.covered), start=max(0.0, hop.start))
        return Buffer((*self.hops, hop), self.run_up, self.cursor if self.hops else hop.cursor)


def _last_speech(hops: tuple[Hop, ...]) -> tuple[Hop, ...]:
    """The last hops with enough speech, silence between them included, within a most; one hop at least."""
    kept, total, speech = [], 0.0, 0.0
    for hop in reversed(hops):
        if kept and total + hop.seconds > RUN_UP_MOST + 1e-9:
            break
        kept.append(hop)
        total, speech = total + hop.seconds, speech + hop.speech
        if speech >= RUN_UP - 1e-9:
            break
    return tuple(reversed(kept))


def _first_seconds(hops: list[Hop], seconds: float) -> list[Hop]:
    total = np.cumsum([0.0, *(h.seconds for h in hops)])
    return [h for h, before in zip(hops, total) if before < seconds - 1e-9]


def drained(buffer: Buffer, gold: int, force: bool = False) -> tuple[Buffer, Window | None]:
    """The window that is due, if one is. gold: how far the page has been read; force: take all there is, at the end."""
    if not buffer.hops:
        return buffer, None
    hops, end = buffer.hops, buffer.cursor + PHRASE
    covered = max(buffer.cursor, *(h.covered for h in hops))
    lasting = sum(h.seconds for h in hops if h.covered == covered) >= STILL - 1e-9
    stands = lasting and gold >= covered
    if not force and gold < end and not stands:
        return buffer, None
    near = stands and gold < end + PHRASE
    taken = [h for h in hops if force or (h.cursor <= min(gold, covered) if near else h.cursor < end)]
    left = [h for h in hops if h not in taken]
    if not taken:
        return buffer, None
    follows = [] if force else _first_seconds(left, AFTER)
    read = gold if force else max(end, *(max(h.cursor + 1, h.covered) for h in (*taken, *follows)))
    head = (*buffer.run_up, *taken)[0]
    window = Window(tuple(h.seq for h in (*buffer.run_up, *taken, *follows)), tuple(h.seq for h in taken), head.cursor, read, head.start)
    return Buffer(tuple(left), _last_speech((*buffer.run_up, *taken)), left[0].cursor if left else end), window


@F.pandas_udf(T.DoubleType())
def speech_seconds(samples: pd.Series, rates: pd.Series) -> pd.Series:
    """Seconds of the whole 20 ms frames of a hop that are loud enough to be speech."""

    def of(x, rate: float) -> float:
        frame = max(1, int(rate * FRAME))
        whole = np.asarray([] if x is None else x, float)
        whole = whole[: len(whole) // frame * frame].reshape(-1, frame)
        return float((np.sqrt((whole * whole).mean(1)) >= SPEECH_RMS).sum()) * frame / rate if len(whole) else 0.0

    return pd.Series([of(x, r) for x, r in zip(samples, rates)])


WINDOWS = "session string, window long, hops array<long>, taken array<long>, cursor int, read int, start double"


def _step(buffer: Buffer, count: int, rows: pd.DataFrame) -> tuple[Buffer, int, list[tuple]]:
    out = []
    for r in rows.sort_values("seq").itertuples(index=False):
        buffer, window = drained(buffer.added(Hop(int(r.seq), float(r.seconds), float(r.speech), int(r.cursor), int(r.covered), float(r.start))), int(r.gold), bool(r.last))
        if window:
            out.append((count, list(window.hops), list(window.taken), window.cursor, window.read, window.start))
            count += 1
    return buffer, count, out


def _rows(session: str, found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(session, *x) for x in found], columns=[c.split()[0] for c in WINDOWS.split(", ")])


def windows(hops: DataFrame) -> DataFrame:
    """The windows of whole sessions. hops: session, seq, seconds, speech, cursor, covered, start, gold (as far as the page is read
    after the hop) and last (true drains all that is left)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _rows(key[0], _step(Buffer(), 0, rows)[2])

    return hops.groupBy("session").applyInPandas(run, WINDOWS)


class Drain(StatefulProcessor):
    def init(self, handle) -> None:
        self.state = handle.getValueState("buffer", "buffer string, windows long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buffer, count = self.state.get() if self.state.exists() else (Buffer().dump(), 0)
        buffer, count, found = _step(Buffer.load(buffer), count, pd.concat(list(rows)))
        self.state.update((buffer.dump(), count))
        yield _rows(key[0], found)

    def close(self) -> None:
        pass


def window_stream(hops: DataFrame) -> DataFrame:
    """`windows` over a stream; needs the RocksDB provider of state stores."""
    return hops.groupBy("session").transformWithStateInPandas(Drain(), WINDOWS, "append", "None")


def sound_of(found: DataFrame, hops: DataFrame, which: str = "hops") -> DataFrame:
    """session, window, samples of each window, joined by the numbers of its hops. hops: session, seq, samples."""
    each = found.select("session", "window", F.posexplode(which).alias("_at", "seq"))
    met = each.join(hops.select("session", "seq", "samples"), ["session", "seq"])
    order: Column = F.array_sort(F.collect_list(F.struct("_at", "samples")))
    return met.groupBy("session", "window").agg(F.flatten(F.transform(order, lambda x: x["samples"])).alias("samples"))
