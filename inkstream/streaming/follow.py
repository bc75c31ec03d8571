"""Following a live reading: a keyed, stateful operator over the windows of words that a recogniser hears.

`Reading.read` is one transition: (state, window) -> (state, places). It is a pure function of a session's script, so the batch
form (a session's windows in order) and the streaming form (state kept between micro-batches) share it. A word that is not
the next on the page is offered to a list of recoveries, in order; the first that knows a place for it decides. Some of them
only work forward, and those are stopped where they would pass over a line that was not read. State is a cursor, the end of
the last word, a dozen heard words, one word that waits to be confirmed and one run of misses: under two kilobytes a session.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from inkstream.functions.text import _Normals
from inkstream.functions.vocabulary import EIGHT, TOGETHER, Made, Vocabulary, readings, sent
from inkstream.functions.wordclass import dialect_key, is_content, is_swap, near, number_value
from inkstream.streaming.recheck import MADE_UP, Heard, usable

#: Seconds within which an equal word is an echo, heard words that are remembered; words looked ahead by each
#: recovery, and back; seconds between the words of a restart; letters of a telling word.
ECHO, REMEMBERED, NEAR, AHEAD, FAR, BACK, RESTART_GAP, TELLING = 0.65, 12, 3, 8, 64, 48, 1.25, 5
#: What a narrator says between a false start and its repair.
CUES = frozenset("again oops restart sorry start".split())


class Bars(NamedTuple):
    """How sure a word must be: to be passed over or to tell a jump, and to count in a run of misses; the run that halts."""

    sure: float = 0.9
    telling: float = 0.8
    missed: float = 0.6
    small: float = 0.95
    run: int = 3


class Run(NamedTuple):
    """Misses in a row: how many, and where the first was on the page and in time."""

    count: int
    index: int
    heard: str
    start: float


class State(NamedTuple):
    cursor: int = 0
    last_end: float = 0.0
    heard: tuple[tuple[str, float], ...] = ()
    waiting: tuple[str, int] | None = None  # a word, and the place that it would have
    run: Run | None = None
    halted: bool = False
    excused: int = -1  # where the narrator chose to carry on

    def dump(self) -> str:
        return json.dumps(self)

    @classmethod
    def load(cls, text: str) -> State:
        cursor, end, heard, waiting, run, halted, excused = json.loads(text)
        return cls(cursor, end, tuple((w, e) for w, e in heard), tuple(waiting) if waiting else None, Run(*run) if run else None, halted, excused)

    def resumed(self) -> State:
        """After a halt: the page moves again, and does not halt at the same word."""
        return self._replace(halted=False, excused=self.cursor)


class Place(NamedTuple):
    seq: int  # of the word among all of the session
    index: int  # of the expected word, or -1
    cursor: int  # after it
    event: str  # match, restart, cue, skip, swap, wait, passed, miss, late, echo, flag, jump or lost (both halt) or halted


class _Fits(dict):
    """word of a page -> whether a heard word is that word (`wordclass.alike`), remembered while there are few enough."""

    def __init__(self, heard: str):
        self.heard, self.key, self.value = heard, dialect_key(heard), number_value(heard)

    def __missing__(self, w: str) -> bool:
        if len(self) > 1000:
            self.clear()
        same = w == self.heard or dialect_key(w) == self.key or self.value is not None and self.value == number_value(w)
        self[w] = found = w != "" and (same or -2 <= len(w) - len(self.heard) <= 2 and near(self.heard, w))
        return found


@lru_cache(1000)
def _fits(heard: str) -> _Fits:
    return _Fits(heard)


def _plain(word: str) -> bool:
    """Whether a word is neither a sound nor may be made up."""
    return word != "" and word not in MADE_UP and "blank" not in word


class Places:
    """The words of a page as places of a vocabulary: where one word may stand is asked of many places at once."""

    def __init__(self, known: Vocabulary, page: np.ndarray):
        self.known, self.page, self.sketch = known, page, known.sketch[page]
        self.sketches, self.spellings, self.numbers = (x.tolist() for x in (self.sketch, known.spelling[page], known.number[page]))

    def fits(self, at: int, word: str, written: str) -> bool:
        """`_fits` of a heard word and the written one of a place."""
        if written == word:
            return True
        own, n = self.known.ids[word], self.numbers[at]
        if written and (self.spellings[at] == self.known.spelling[own] or n >= 0 and n == self.known.number[own]):
            return True
        return (self.sketches[at] ^ int(self.known.sketch[own])).bit_count() <= 4 and near(word, written)

    def maybe(self, word: str, low: int, high: int) -> list[int]:
        """The places from low up to high where `_fits` may hold: no other one has it, and few of these have not."""
        known, size = self.known, len(word)
        own = known.ids[word]
        # an edit changes two bits of a sketch at most; two edits only count where one of the words has eight letters
        part = self.sketch[low:high]
        apart = np.bitwise_count(part ^ known.sketch[own])
        found = apart <= (4 if size >= 8 else 2 if size >= 4 else 0)
        if 6 <= size < 8:
            found |= (apart <= 4) & (part & EIGHT != 0)
        if known.is_spelled_otherwise(own):
            found |= known.spelling[self.page[low:high]] == known.spelling[own]
        if known.number[own] >= 0:
            found |= known.number[self.page[low:high]] == known.number[own]
        return (found.nonzero()[0] + low).tolist()


class Reading:
    """A session's script: expected words in normal form, and the line (or shown row) of each. proofing: slips are looked for, so
    the page is held to, with the two strictest recoveries; the first sure slip of a window that has an anchor is a flag. places:
    the same words in a vocabulary that also has all that is heard."""

    def __init__(self, words: list[str], lines: list[int] | None = None, bars: Bars = Bars(), halting: bool = True, proofing: bool = False, places: Places | None = None):
        self.words, self.lines, self.bars, self.halting, self.proofing, self.places = words, lines or [0] * len(words), bars, halting, proofing, places
        self._around: tuple[tuple[str, int] | None, list[int]] = (None, [])
        self.recoveries = (Reading.together, Reading.alone) if proofing else self.RECOVERIES

    def fits(self, at: int, word: str) -> bool:
        if not 0 <= at < len(self.words) or word == "":
            return False
        return self.places.fits(at, word, self.words[at]) if self.places else _fits(word)[self.words[at]]

    def fitting(self, s: State, word: str, low: int, high: int) -> Iterator[int]:
        """The places from low up to high that a word fits; of all that the recoveries look at, if the page has places."""
        words, places = self.words, self.places
        if places is None:
            fit = _fits(word)
            return (k for k in range(low, min(high, len(words))) if fit[words[k]])
        if self._around[0] != (word, s.cursor):
            maybe = places.maybe(word, max(0, s.cursor - BACK), s.cursor + 1 + FAR)
            self._around = (word, s.cursor), [k for k in maybe if places.fits(k, word, words[k])]
        return (k for k in self._around[1] if low <= k < high)

    def _only(self, places: Iterator[int]) -> int:
        """The one place there is, or -1."""
        first = next(places, -1)
        return first if next(places, -1) < 0 else -1

    # Recoveries: (state, word, the next word of the window, confidence) -> (places of this word and perhaps the next, event)

    def restart(self, s: State, word: str, then: str, sure: float) -> tuple[list[int], str] | None:
        """The last three or two words stand together at just one place a little behind, and say enough to be no chance."""
        low = max(0, s.cursor - BACK)
        behind = list(self.fitting(s, word, low + 1, s.cursor - 1))
        for n in (3, 2) if behind else ():
            tail = s.heard[-n:]
            said = [w for w, _ in tail]
            if len(tail) < n or tail[-1][1] - tail[0][1] > RESTART_GAP or CUES.intersection(said):
                continue
            begun = (k - n + 1 for k in behind if k >= low + n - 1)
            at = self._only(at for at in begun if all(self.fits(at + k, w) for k, w in enumerate(said[:-1])))
            begins = at == 0 or at > 0 and self.lines[at - 1] != self.lines[at]
            if at >= 0 and (n == 3 or begins or any(len(w) >= TELLING and is_content(w) for w in said)):
                return [at + n - 1], "restart"
        return None

    def cue(self, s: State, word: str, then: str, sure: float) -> tuple[list[int], str] | None:
        return ([], "cue") if word in CUES else None

    def near(self, s: State, word: str, then: str, sure: float) -> tuple[list[int], str] | None:
        """Up to three words were lost; a small word must be the very next."""
        at = self._only(self.fitting(s, word, s.cursor + 1, s.cursor + 1 + NEAR))
        return ([at], "skip") if at >= 0 and (at == s.cursor + 1 or is_content(word) or len(word) >= TELLING) else None

    def swap(self, s: State, word: str, then: str, sure: float) -> tuple[list[int], str] | None:
        return ([s.cursor], "swap") if is_swap(self.words[s.cursor], word) else None

    def far(self, s: State, word: str, then: str, sure: float) -> tuple[list[int], str] | None:
        """This word and the next stand together at one place of the next 64; at a window's end, a telling word alone."""
        if not then and not (is_content(word) and len(word) >= TELLING and self.bars.sure >= 0.55):
            return None
        low = s.cursor + 1
        at = self._only(k for k in self.fitting(s, word, low, low + FAR) if not then or self.fits(k + 1, then))
        return ([at, at + 1] if then else [at], "skip") if at >= 0 else None

    def together(self, s: State, word: str, then: str, sure: float) -> tuple[list[int], str] | None:
        """This word and the next, letter by letter, at the first such place a little ahead."""
        ahead = self.words[s.cursor + 1 : s.cursor + 1 + AHEAD]
        at = next((k for k, pair in enumerate(zip(ahead, ahead[1:])) if pair == (word, then)), -1) if then else -1
        return ([s.cursor + 1 + at, s.cursor + 2 + at], "skip") if at >= 0 else None

    def alone(self, s: State, word: str, then: str, sure: float) -> tuple[list[int], str] | None:
        """This word a little ahead: if it says enough, or confirms the one that waits; else it waits itself."""
        ahead = self.words[s.cursor + 1 : s.cursor + 1 + AHEAD]
        if word not in ahead:
            return None
        at = s.cursor + 1 + ahead.index(word)
        telling = not self.proofing and sure >= max(self.bars.sure, self.bars.telling) and len(word) >= TELLING and is_content(word) and ahead.count(word) == 1
        confirms = s.waiting and (at == s.waiting[1] + 1 or s.waiting == (word, at))
        return ([at], "skip") if telling or confirms else ([at], "wait")

    RECOVERIES = (restart, cue, near, swap, far, together, alone)
    FORWARD = (near, far, together, alone)

    def leaps(self, start: int, target: int) -> bool:
        """Whether a step forward leaves more than the last word of a line unread, or a whole line."""
        line, crossed = self.lines[start], sum(a != b for a, b in zip(self.lines[start:target], self.lines[start + 1 : target + 1]))
        if self.lines[target] == line:
            return False
        left = next((k for k in range(start, len(self.lines)) if self.lines[k] != line), len(self.lines)) - start
        return crossed > 1 or left > 1

    @staticmethod
    def _echoes(s: State, h: Heard) -> bool:
        for word, end in reversed(s.heard):
            if h.end - end > ECHO:
                return False
            if word == h.word:
                return not (s.waiting and s.waiting[0] == h.word)
        return False

    def _recovered(self, s: State, word: str, then: str, sure: float) -> tuple[list[int], str, Callable | None]:
        for recovery in self.recoveries:
            if found := recovery(self, s, word, then, sure):
                return *found, recovery
        return [], "miss", None

    def _missed(self, s: State, h: Heard) -> tuple[State, str]:
        """A word that no recovery could place: it may end a run that halts, or be passed over as a slip if it is sure."""
        expected, small = self.words[s.cursor], h.confidence >= self.bars.small and is_swap(self.words[s.cursor], h.word)
        content = is_content(h.word) and is_content(expected)
        if self.halting and h.confidence >= self.bars.missed and (small or content):
            run = s.run._replace(count=s.run.count + 1) if s.run else Run(1, s.cursor, h.text, h.start)
            if run.count >= self.bars.run and run.index != s.excused:
                return s._replace(cursor=run.index, run=None, halted=True), "lost"
            s = s._replace(run=run)
        if h.confidence >= self.bars.sure and (content or self.proofing and small):
            return s._replace(cursor=s.cursor + 1), "passed"
        return s, "miss"

    def straight(self, s: State, words: list[str], starts: list[float], ends: list[float]) -> State | None:
        """The state after a window that is read word for word, as `read` gives it; null where a word needs a closer look."""
        low, high, last, begun, heard = s.cursor, s.cursor + len(words), s.last_end, float("-inf"), list(s.heard)
        if s.halted or self.words[low:high] != words or not all(map(_plain, words)):
            return None
        for word, start, end in zip(words, starts, ends):
            if not begun <= start <= end or end <= last:
                return None
            for before, at in reversed(heard):
                if end - at > ECHO:
                    break
                if before == word:
                    return None
            heard.append((word, end))
            last, begun = end, start
        return State(high, last, tuple(heard[-REMEMBERED:]), None, None, False, s.excused)

    def read(self, s: State, window: list[Heard], seq: int = 0) -> tuple[State, list[Place]]:
        """One window of heard words, in normal form and in order of time, the first numbered seq. What comes after a halt is not
        read."""
        places, i, n, words = [], 0, len(window), self.words
        while i < n:
            h, at = window[i], seq + i
            i += 1
            if s.halted:
                places.append(Place(at, -1, s.cursor, "halted"))
                continue
            if h.end <= s.last_end:
                places.append(Place(at, -1, s.cursor, "late"))
                continue
            if self._echoes(s, h):
                s = State(s.cursor, h.end, s.heard, s.waiting, s.run, False, s.excused)
                places.append(Place(at, -1, s.cursor, "echo"))
                continue
            cursor, heard = s.cursor, (*s.heard[-REMEMBERED + 1 :], (h.word, h.end))
            if cursor < len(words) and words[cursor] == h.word or self.fits(cursor, h.word):
                s = State(cursor + 1, h.end, heard, None, None, False, s.excused)
                places.append(Place(at, cursor, cursor + 1, "match"))
                continue
            s = State(cursor, h.end, heard, s.waiting, s.run, False, s.excused)
            if cursor >= len(words) or not words[cursor]:
                places.append(Place(at, -1, cursor, "miss"))
                continue
            then = window[i].word if i < n else ""
            where, event, recovery = self._recovered(s, h.word, then, h.confidence)
            if event == "wait":
                s = s._replace(waiting=(h.word, where[0]))
                places.append(Place(at, -1, cursor, event))
            elif event == "cue":
                s = s._replace(waiting=None, run=None)
                places.append(Place(at, -1, cursor, event))
            elif event == "miss":
                s, event = self._missed(State(cursor, h.end, heard, None, s.run, False, s.excused), h)
                if event == "passed" and self.proofing and not any(p.event == "flag" for p in places):
                    anchored = any(p.index >= 0 for p in places) or i + 1 < n and all(self.fits(cursor + 1 + k, window[i + k].word) for k in (0, 1))
                    event = "flag" if anchored else event
                places.append(Place(at, cursor if event in ("passed", "flag") else -1, s.cursor, event))
            else:
                origin = s.run.index if s.run else cursor
                if self.halting and recovery in self.FORWARD and self.leaps(origin, where[0]):
                    s = s._replace(cursor=origin, waiting=None, run=None, halted=True)
                    places.append(Place(at, -1, origin, "jump"))
                    continue
                for k, index in enumerate(where):
                    if k:  # the next word was taken with this one
                        h, i = window[i], i + 1
                        s = s._replace(last_end=max(s.last_end, h.end), heard=(*s.heard[-REMEMBERED + 1 :], (h.word, h.end)))
                    places.append(Place(seq + i - 1, index, index + 1, event))
                s = State(where[-1] + 1, s.last_end, s.heard, None, None, False, s.excused)
        return s, places


#: Windows that are compared with the page at once.
STRETCH = 64
PLACES = "session string, seq long, index int, cursor int, event string"


def _words(texts: list, starts: list, ends: list, sure: list, normal: _Normals) -> list[Heard]:
    return [Heard(t, normal[t or ""], a, b, min(1.0, max(0.0, c or 0.0))) for t, a, b, c in zip(texts, starts, ends, sure) if a is not None and b is not None and a == a and b == b]


class Session(NamedTuple):
    """A whole reading. page, heard: numbers of a vocabulary; clean: whether a heard word may be read word for word; odd: how many
    words before a place are not plain, or not in order of time."""

    page: np.ndarray
    heard: np.ndarray
    written: list[str]  # as the recogniser wrote it
    starts: np.ndarray
    ends: np.ndarray
    sure: np.ndarray
    clean: np.ndarray
    odd: list[int]


def _clean(heard: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Heard words that are plain and in order, end after all before them, and do not echo any of them. That is more than a reading asks
    for, as it only knows some of the words before."""
    if not len(heard):
        return np.empty(0, bool)
    latest = np.maximum.accumulate(np.concatenate([[0.0], ends]))[:-1]
    clean = plain & (ends > latest)
    # an echo ends within so many seconds of an equal word before it: of the last one, or of any, where times fall back
    order = np.argsort(heard, kind="stable")
    again = order[1:][(heard[order[1:]] == heard[order[:-1]]) & ~(ends[order[1:]] - ends[order[:-1]] > ECHO)]
    clean[again] = False
    if not (ends[1:] >= ends[:-1]).all():
        last: dict[int, float] = {}
        for i, (word, end) in enumerate(zip(heard.tolist(), ends.tolist())):
            before = last.get(word, float("-inf"))
            clean[i] &= end - before > ECHO
            last[word] = max(before, end)
    return clean


def _sessions(batch: pa.RecordBatch, known: Vocabulary, made: Made = readings) -> Iterator[Session]:
    """The readings of a batch, their words encoded together. A word without times does not count."""
    r = made(batch, known)
    plain = np.zeros(len(known.words), bool)
    used = np.unique(r.heard)
    plain[used] = [_plain(known.words[i]) for i in used.tolist()]
    timed = np.flatnonzero((r.starts == r.starts) & (r.ends == r.ends))
    bounds = np.searchsorted(timed, r.words).tolist()
    for a, z, low, high in zip(r.pages[:-1].tolist(), r.pages[1:].tolist(), bounds, bounds[1:]):
        at = timed[low:high]
        heard, starts, ends = r.heard[at], r.starts[at], r.ends[at]
        odd = ~(plain[heard] & (starts <= ends))
        odd[1:] |= starts[1:] < starts[:-1]
        yield Session(r.page[a:z], heard, [r.distinct[k] for k in r.written[at].tolist()], starts, ends, r.sure[at], _clean(heard, starts, ends, ~odd), [0, *np.cumsum(odd).tolist()])


def _followed_alone(session: Session, known: Vocabulary, window: int, bars: Bars, halting: bool) -> tuple[int, ...]:
    """The cursor at the end of a reading, and how often each event came. Windows that are read word for word are taken together, up to
    the first that needs a closer look."""
    page, heard, n, words = session.page, np.where(session.clean, session.heard, -1), len(session.heard), known.words
    next_heard, next_page = heard.tolist(), page.tolist()
    reading, s, count, i = Reading([words[k] for k in next_page], None, bars, halting, places=Places(known, page)), State(), dict.fromkeys(EVENTS, 0), 0
    said = [words[k] for k in session.heard.tolist()]
    starts, ends, sure = (x.tolist() for x in (session.starts, session.ends, session.sure))
    while i < n:
        s = s.resumed() if s.halted else s
        m = min(n - i, len(page) - s.cursor, window * STRETCH)
        straight = 0
        if m > 0 and next_heard[i] == next_page[s.cursor]:
            wrong = heard[i : i + m] != page[s.cursor : s.cursor + m]
            straight = int(wrong.argmax())
            straight = straight or (0 if wrong[0] else m)
        if i + straight < n:
            straight -= straight % window
        if straight:
            z = i + straight
            last = range(max(i, z - REMEMBERED), z)
            s = State(s.cursor + straight, ends[z - 1], (*s.heard, *((said[k], ends[k]) for k in last))[-REMEMBERED:], None, None, False, s.excused)
            count["match"], i = count["match"] + straight, z
            continue
        z = i + window
        few = list(map(Heard, session.written[i:z], said[i:z], starts[i:z], ends[i:z], sure[i:z]))
        if session.odd[min(z, n)] > session.odd[i] or "blankaudio" in "".join(said[i:z]):
            few = usable(few)
        s, places = reading.read(s, few, i)
        for p in places:
            count[p.event] += 1
        i = z
    return s.cursor, *count.values()


def counted(rows: DataFrame, words: str, heard: str | Made, window: int = 3, bars: Bars = Bars(), halting: bool = True) -> DataFrame:
    """rows without words and heard, and: cursor at the end, and how often each event came. A row is a whole session: its expected
    words, and what was heard (array of text, start, end, confidence; or how it is made of the words), read in windows of so many words. A reader who is halted
    carries on at the next window. No shuffle, and only counts leave the workers."""
    kept = [c for c in rows.columns if c not in (words, heard)]
    columns, made = sent(words, heard)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept] + ["cursor long"] + [f"{e} long" for e in EVENTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary()
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, TOGETHER):
                known.start()
                found += [_followed_alone(session, known, window, bars, halting) for session in _sessions(batch.slice(at, TOGETHER), known, made)]
            counts = [pa.array(c, pa.int64()) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *counts], names=[*kept, "cursor", *EVENTS])

    return rows.select(*kept, *columns).mapInArrow(run, schema)


EVENTS = ("match", "restart", "cue", "skip", "swap", "wait", "passed", "miss", "late", "echo", "flag", "jump", "lost", "halted")


def _read_windows(reading: Reading, s: State, rows: pd.DataFrame, normal: _Normals) -> tuple[State, list[Place]]:
    """The windows of a session in order; a window whose `resume` is true first lets a halted page move."""
    out: list[Place] = []
    for _, said in rows.sort_values(["window", "seq"]).groupby("window", sort=True):
        if s.halted and said["resume"].fillna(False).astype(bool).any():
            s = s.resumed()
        known = usable(_words(*(said[c].tolist() for c in ("text", "start", "end", "confidence")), normal))
        s, places = reading.read(s, known, int(said["seq"].iloc[0]))
        out += places
    return s, out


def _rows(session: str, places: list[Place]) -> pd.DataFrame:
    return pd.DataFrame([(session, *p) for p in places], columns=["session", *Place._fields])


def followed(heard: DataFrame, expected: DataFrame, bars: Bars = Bars(), halting: bool = True) -> DataFrame:
    """session, seq, index, cursor, event of every word that counts. heard: session, window, seq, text, start, end, confidence,
    resume; expected: session, words, lines (arrays). A session's words are one reader's; no session grows with the input."""

    def run(key: tuple, said: pd.DataFrame, script: pd.DataFrame) -> pd.DataFrame:
        normal = _Normals()
        words, lines = (list(script[c].iloc[0]) if len(script) and script[c].iloc[0] is not None else [] for c in ("words", "lines"))
        reading = Reading([normal[w or ""] for w in words], [int(x) for x in lines], bars, halting)
        return _rows(key[0], _read_windows(reading, State(), said, normal)[1])

    return heard.groupBy("session").cogroup(expected.select("session", "words", "lines").groupBy("session")).applyInPandas(run, PLACES)


class Follower(StatefulProcessor):
    """The same over a stream. A session's script is put into its state once, at the start of the query, and does not travel
    with the words."""

    def __init__(self, bars: Bars, halting: bool):
        self.bars, self.halting = bars, halting

    def init(self, handle) -> None:
        self.script = handle.getValueState("script", "words array<string>, lines array<int>")
        self.state = handle.getValueState("reading", "value string")
        self.normal = _Normals()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        words, lines = initialState["words"].iloc[0], initialState["lines"].iloc[0]
        self.script.update(([self.normal[w or ""] for w in words], [int(x) for x in lines] if lines is not None else []))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        words, lines = self.script.get() if self.script.exists() else ([], [])
        state = State.load(self.state.get()[0]) if self.state.exists() else State()
        state, places = _read_windows(Reading(list(words), [int(x) for x in lines], self.bars, self.halting), state, pd.concat(list(rows)), self.normal)
        self.state.update((state.dump(),))
        yield _rows(key[0], places)

    def close(self) -> None:
        pass


def follow_stream(heard: DataFrame, expected: DataFrame, bars: Bars = Bars(), halting: bool = True) -> DataFrame:
    """`followed` over a stream of windows; a window arrives whole, in one micro-batch. The session needs the RocksDB provider of
    state stores."""
    scripts = expected.select("session", "words", "lines").groupBy("session")
    return heard.groupBy("session").transformWithStateInPandas(Follower(bars, halting), PLACES, "append", "None", scripts)
