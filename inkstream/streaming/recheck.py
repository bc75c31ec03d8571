"""Second looks at a live reading: a window of recognised words is laid over the page, and one slip of it at most is flagged.

A window is a row: the words of the page around it (from the follower's cursor to a phrase beyond the last word read) and the
words that the recogniser heard. Both are cut out of longer arrays in the JVM, so a row is some dozen words whatever the
length of the chapter, and windows need no shuffle. The alignment is global in the window and free at the start and end of
the page: it may begin and end at any word of the page, but has to account for all that was heard.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.vocabulary import TOGETHER, Made, Readings, Vocabulary, sent
from inkstream.functions.wordclass import CLOSED, dialect_key, distance, is_content, is_function, is_piece, is_plausible, is_swap, likeness, number_value, same_word, slip

#: Scores of a pair of words, of a word that is not read and of one that is not written; likeness from which words
#: are similar.
EXACT, SIMILAR, SWAP, MISMATCH, CROSS_CLASS, UNREAD, UNWRITTEN, ENOUGH = 4.0, 2.6, -1.8, -3.0, -3.6, -1.25, -2.25, 0.45
#: Confidence from which a slip between two exact words is believed, by kind; of any bounded kind if pinned by its
#: neighbours; of any other between exact words; without any.
BELIEVED, PINNED, ANCHORED, ALONE = {"number": 0.55, "inflection": 0.62, "onset": 0.7, "swap": 0.5}, 0.35, 0.6, 0.9
#: Words of a phrase, and of a spoken number.
PHRASE, NUMBER_WORDS = 8, 6
#: What recognisers write for sounds, and what they make up where nothing is said.
SOUNDS = frozenset("blank audio blankaudio subtitle subtitles sub foreign applause subscribe laughter laughs inaudible silence credits caption captions".split())
MADE_UP = SOUNDS | frozenset("music thank thanks bye goodbye please".split())


class Heard(NamedTuple):
    text: str  # as the recogniser wrote it
    word: str  # in normal form
    start: float
    end: float
    confidence: float


class Pair(NamedTuple):
    heard: int
    expected: int
    kind: str  # exact, similar or mismatch


class Flag(NamedTuple):
    expected_index: int
    expected: str
    heard: str
    start: float
    end: float
    confidence: float
    kind: str  # number, inflection, onset, swap, similar, mismatch or lone


def usable(words: list[Heard]) -> list[Heard]:
    """In order of time, without sounds; nothing if all of it may be made up."""
    kept = sorted((w for w in words if w.start <= w.end and w.word and w.word not in SOUNDS), key=lambda w: w.start)
    made_up = "blankaudio" in "".join(w.word for w in kept) or all(w.word in MADE_UP for w in kept)
    return [] if made_up else kept


@lru_cache(200_000)
def pair_score(expected: str, heard: str) -> float:
    if same_word(heard, expected):
        return EXACT
    if likeness(heard, expected, ENOUGH) >= ENOUGH:
        return SIMILAR
    if is_swap(expected, heard):
        return SWAP
    return MISMATCH if is_function(heard) == is_function(expected) else CROSS_CLASS


def aligned(heard: list[str], page: list[str]) -> list[Pair]:
    """The pairs of the best alignment; of equal ones, that which pairs words, then that which leaves heard words out."""
    width = len(page) + 1
    best, steps = [0.0] * width, []
    for h in heard:
        row, step = [best[0] + UNWRITTEN], ["up"]
        for j, e in enumerate(page):
            options = ((best[j] + pair_score(e, h), 2, "pair"), (best[j + 1] + UNWRITTEN, 1, "up"), (row[j] + UNREAD, 0, "left"))
            score, _, name = max(options)
            row.append(score)
            step.append(name)
        best = row
        steps.append(step)
    j, pairs = max(range(width), key=lambda k: (best[k], -k)), []
    i = len(heard)
    while i:
        name = steps[i - 1][j]
        if name == "pair":
            h, e = heard[i - 1], page[j - 1]
            pairs.append(Pair(i - 1, j - 1, "exact" if same_word(h, e) else "similar" if likeness(h, e) >= ENOUGH else "mismatch"))
        i, j = i - (name != "left"), j - (name != "up")
    return pairs[::-1]


#: Fixed value: letters of the longest words whose distances are taken together.
LONGEST = 32


def distances(known: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`distance` of pairs of words of a vocabulary, all at once: a column of the table of edits is two numbers of bits, where it rises
    and where it falls (Myers)."""
    used, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    words = [known.words[k] for k in used.tolist()]
    short = np.flatnonzero(known.size[used] <= LONGEST)
    letters = np.zeros((len(used), LONGEST), np.uint32)
    text = np.frombuffer("".join(words[k] for k in short.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters[short] = np.where(np.arange(LONGEST) < known.size[used][short][:, None], 1, 0)
    letters[letters > 0] = text + 1
    x, y = letters[places[: len(a)]], letters[places[len(a) :]]
    m, n, one = known.size[a], known.size[b], np.uint64(1)
    last = one << np.maximum(m - 1, 0).astype(np.uint64)
    rises, falls, found = np.full(len(a), 2**LONGEST - 1, np.uint64), np.zeros(len(a), np.uint64), m.copy()
    for j in range(min(LONGEST, n.max(initial=0))):
        same = np.packbits(x == np.where(y[:, j] > 0, y[:, j], 2**32 - 1)[:, None], 1, "little").view(np.uint32).ravel().astype(np.uint64)
        diagonal = (((same & rises) + rises) ^ rises) | same | falls
        up, down = falls | ~(diagonal | rises), rises & diagonal
        inside = j < n
        found += inside & (up & last != 0)
        found -= inside & (down & last != 0)
        up, down = (up << one) | one, down << one
        falls, rises = up & diagonal, down | ~(up | diagonal)
    found[m == 0] = n[m == 0]
    for k in np.flatnonzero((m > LONGEST) | (n > LONGEST)).tolist():
        found[k] = distance(known.words[a[k]], known.words[b[k]])
    return found


def pair_scores(known: Vocabulary, expected: np.ndarray, heard: np.ndarray) -> np.ndarray:
    """`pair_score` of pairs of words of a vocabulary. Edits are only counted where the sketches leave the words alike enough."""
    e, h = expected, heard
    size, number, both = np.maximum(np.maximum(known.size[e], known.size[h]), 1), known.number[e] >= 0, (known.size[e] > 0) & (known.size[h] > 0)
    number &= known.number[h] >= 0
    equal = known.number[e] == known.number[h]
    same = both & ((e == h) | number & equal | (known.spelling[e] == known.spelling[h]))
    alike = ~same & both & (1 - (np.bitwise_count(known.sketch[e] ^ known.sketch[h]) + 1) // 2 / size >= ENOUGH)
    at = np.flatnonzero(alike)
    alike[at] = 1 - distances(known, h[at], e[at]) / size[at] >= ENOUGH
    swap = (e != h) & ((known.classes[e] & known.classes[h] > 0) | number & ~equal)
    other = np.where(known.function[e] == known.function[h], MISMATCH, CROSS_CLASS)
    return np.where(same, EXACT, np.where(alike, SIMILAR, np.where(swap, SWAP, other)))


def aligned_together(known: Vocabulary, looks: list[tuple[list[str], list[str]]]) -> list[list[Pair]]:
    """`aligned` of many windows (what is heard, and the page), the longest first through the same steps."""
    if not looks:
        return []
    order = sorted(range(len(looks)), key=lambda k: -len(looks[k][0]))
    high, wide = len(looks[order[0]][0]), max(len(page) for _, page in looks)
    heard, page = np.zeros((len(looks), high), np.int64), np.zeros((len(looks), wide), np.int64)
    many, width = (np.array([len(looks[k][side]) for k in order]) for side in (0, 1))
    ids = known.add([w for k in order for side in looks[k] for w in side])
    at = 0
    for row, (m, n) in enumerate(zip(many.tolist(), width.tolist())):
        heard[row, :m], page[row, :n], at = ids[at : at + m], ids[at + m : at + m + n], at + m + n
    rows, i, j = np.nonzero((np.arange(high) < many[:, None])[:, :, None] & (np.arange(wide) < width[:, None])[:, None, :])
    score = np.zeros((len(looks), high, wide))
    score[rows, i, j] = pair_scores(known, page[rows, j], heard[rows, i])
    best, steps = np.zeros((len(looks), wide + 1)), np.zeros((len(looks), high, wide + 1), np.int8)  # a step: 2 pairs, 1 goes up, 0 left
    steps[:, :, 0] = 1
    for i in range(high):
        live = int(np.searchsorted(-many, -i))  # windows with more words than i
        old, row = best[:live].copy(), best[:live]
        row[:, 0] = old[:, 0] + UNWRITTEN
        for j in range(wide):
            pair, up, left = old[:, j] + score[:live, i, j], old[:, j + 1] + UNWRITTEN, row[:, j] + UNREAD
            beside = np.maximum(up, left)
            steps[:live, i, j + 1] = np.where(pair >= beside, 2, up >= left)
            np.maximum(pair, beside, out=row[:, j + 1])
    best[np.arange(wide + 1) > width[:, None]] = -np.inf
    found: list[list[Pair]] = [[]] * len(looks)
    for row, end in enumerate(best.argmax(1).tolist()):
        i, j, pairs, step = int(many[row]), end, [], steps[row].tolist()
        while i:
            name = step[i - 1][j]
            if name == 2:
                value = score[row, i - 1, j - 1]
                pairs.append(Pair(i - 1, j - 1, "exact" if value == EXACT else "similar" if value == SIMILAR else "mismatch"))
            i, j = i - (name > 0), j - (name != 1)
        found[order[row]] = pairs[::-1]
    return found


def unglued(words: list[Heard], page: list[str]) -> list[Heard]:
    """Words that were written together are parted where both halves are words of the page side by side, one of them perhaps
    with a slip."""
    beside, out = list(zip(page, page[1:])), []
    spellings, numbers = {dialect_key(e) for e in page if e}, {number_value(e) for e in page} - {None}
    written = lambda x: dialect_key(x) in spellings or number_value(x) in numbers
    for w in words:
        cuts = range(2, len(w.word) - 1) if len(w.word) >= 6 and not written(w.word) else ()
        for cut in cuts:
            left, right = w.word[:cut], w.word[cut:]
            if not written(left) and not written(right):
                continue
            fits = ((same_word(left, a), same_word(right, b), a, b) for a, b in beside)
            if any(x and y or x and is_plausible(b, right) or y and is_plausible(a, left) for x, y, a, b in fits):
                at = w.start + (w.end - w.start) * cut / len(w.word)
                out += [Heard(left, left, w.start, at, w.confidence), Heard(right, right, at, w.end, w.confidence)]
                break
        else:
            out.append(w)
    return out


def _rendered(digits: str, run: list[str]) -> bool:
    """Whether figures are a run of number words read in groups: six forty-six is 646."""
    reached = {(0, 0)}
    for at in range(len(run)):
        for i, k in [x for x in reached if x[1] == at]:
            for end in range(at + 1, len(run) + 1):
                value = number_value("".join(run[at:end]))
                if value is None:
                    break
                if digits.startswith(str(value), i):
                    reached.add((i + len(str(value)), end))
    return (len(digits), len(run)) in reached


def spelled(words: list[Heard], page: list[str]) -> list[Heard]:
    """Figures become the number words of the page that they stand for. Figures that are another number than the only one of
    the page stay at its first word."""
    spoken = [number_value(e) is not None for e in page]
    runs, at = [], 0
    while at < len(page):
        end = at
        while end < len(page) and (spoken[end] or page[end] == "and"):
            end += 1
        last = max((k for k in range(at, end) if spoken[k]), default=at - 1) + 1
        if last - at >= 2:
            runs.append((at, last))
        at = max(end, at + 1)
    out = []
    for w in words:
        value, found = number_value(w.word), None
        if value is not None:
            for start in range(len(page)):
                for end in range(start + 2, min(start + NUMBER_WORDS, len(page)) + 1):
                    run = page[start:end]
                    if not all(spoken[k] or page[k] == "and" for k in range(start, end)):
                        break
                    plain = [x for x in run if x != "and"]
                    if run[-1] != "and" and (number_value("".join(plain)) == value or w.word.isdecimal() and _rendered(w.word, plain)):
                        found = run
                        break
                if found:
                    break
            if not found and sum(c.isdecimal() for c in w.word) >= 3 and len(runs) == 1:
                found = [None, *page[runs[0][0] + 1 : runs[0][1]]]
        if not found:
            out.append(w)
            continue
        step = (w.end - w.start) / len(found)
        out += [Heard(x or w.text, x or w.word, w.start + k * step, w.start + (k + 1) * step, w.confidence) for k, x in enumerate(found)]
    return out


def _needed(kind: str | None, pairs: list[Pair], at: int, least: float) -> float:
    """The confidence that a slip needs, by what stands around it."""
    exact = [p.kind == "exact" for p in pairs]
    before, after = exact[:at], exact[at + 1 :]
    if not (any(before) and any(after) or not any(before) and sum(after) >= 2):
        return least
    pinned = at and exact[at - 1] and after[:1] == [True] or not at and after[:2] == [True, True]
    return min(least, PINNED if pinned and kind else BELIEVED.get(kind, ANCHORED))


def flagged(page: list[str], heard: list[Heard], cursor: int, read: int, offset: int = 0, dismissed: frozenset[str] = frozenset(), least: float = ALONE, anchored: bool = True) -> Flag | None:
    """The slip of a window, if there is one. page: words in normal form, the first at `offset` of the chapter; cursor: where the
    window began, read: up to where the page has been read, both in the chapter; dismissed: `index-heard` of slips set aside.

    A slip of a bounded kind, or a word that is quite another, comes first; one that only sounds alike is told if the window has
    no other, not even a dismissed one."""
    looked = _looked(page, heard, cursor, read, offset)
    return looked and _judged(aligned([w.word for w in looked.heard], looked.part), looked, dismissed, least, anchored)


class Look(NamedTuple):
    """A window that needs an alignment. part: what of the page may have been read, from `low` of it on."""

    page: list[str]
    heard: list[Heard]
    part: list[str]
    low: int
    cursor: int
    read: int
    offset: int


def _looked(page: list[str], heard: list[Heard], cursor: int, read: int, offset: int) -> Look | None:
    heard = usable(heard)
    if not heard or not page:
        return None
    high = max(0, min(len(page), read + PHRASE - offset))
    low = max(0, min(cursor - offset, max(0, high - PHRASE)))
    part = page[low:high]
    if len([e for e in part if e]) >= 2 and not {w.word for w in heard} <= set(part):
        heard = spelled(unglued(heard, part), part)
    said = [w.word for w in heard]
    if any(said == part[k : k + len(said)] for k in range(len(part) - len(said) + 1)):
        return None  # read as it is written: no alignment is better
    return Look(page, heard, part, low, cursor, read, offset)


def _judged(pairs: list[Pair], look: Look, dismissed: frozenset[str], least: float, anchored: bool = True) -> Flag | None:
    page, heard, part, low, cursor, read, offset = look
    anchor, similar, seen = any(p.kind == "exact" for p in pairs), None, False
    for at, p in enumerate(pairs):
        w, e, index = heard[p.heard], part[p.expected], offset + low + p.expected
        kind = slip(e, w.word)
        due = read - PHRASE <= index < read
        if p.kind == "exact" or not e or not due or is_piece(w.word, e) or w.confidence < _needed(kind, pairs, at, least):
            continue
        if w.word in CLOSED and not is_swap(e, w.word) and not (e.startswith(w.word) or e.endswith(w.word)):
            continue
        if is_function(e) and not is_function(w.word) and not is_plausible(e, w.word):
            continue  # a stray word that found a small one to stand by
        if f"{index}-{w.word}" in dismissed:
            seen = seen or p.kind != "similar" or is_plausible(e, w.word)
            continue
        if anchored and not anchor:
            continue
        flag = Flag(index, e, w.text, max(0.0, w.start), max(0.0, w.start, w.end), w.confidence, kind or p.kind)
        if p.kind != "similar" or kind:
            return flag
        similar = similar or flag
    if similar and not seen:
        return similar
    if anchor or len(heard) != 1 or not 0 < cursor or not 0 <= cursor - offset < len(page):
        return None
    w, e = heard[0], page[cursor - offset]
    fits = w.confidence >= least and is_content(w.word) and is_content(e) and not is_piece(w.word, e) and not same_word(w.word, e)
    if fits and read - PHRASE <= cursor < read and f"{cursor}-{w.word}" not in dismissed:
        return Flag(cursor, e, w.text, max(0.0, w.start), max(0.0, w.start, w.end), w.confidence, "lone")
    return None


def windows(sessions: DataFrame, tokens: str, heard: str, step: float, hop: int = PHRASE) -> DataFrame:
    """sessions without tokens and heard, and a row for each window of `hop` words of the page: window, cursor, read, offset, page
    and heard. step: seconds a word, by which the heard words of a window are found near their place."""
    kept = [c for c in sessions.columns if c not in (tokens, heard)]

    def window(k: Column) -> Column:
        first, until = k * hop * step, (k + 1) * hop * step
        near_by = F.slice(heard, F.greatest(F.lit(1), k * hop - 2 * hop), 5 * hop)
        return F.struct(
            k.alias("window"),
            (k * hop).alias("cursor"),
            F.least((k + 1) * hop, F.size(tokens)).alias("read"),
            (k * hop).alias("offset"),
            F.slice(tokens, k * hop + 1, hop + PHRASE).alias("page"),
            F.filter(near_by, lambda w: (w["start"] >= first) & (w["start"] < until)).alias("heard"),
        )

    # cut in one expression: rows exploded beside the arrays would copy them for each window
    each = F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / hop).cast("int")), window))
    return sessions.select(*kept, F.explode(each).alias("_w")).select(*kept, "_w.*")


FLAGS = "expected_index long, expected string, heard string, start double, end double, confidence double, kind string"


def flags(rows: DataFrame, least: float = ALONE, dismissed: Column | None = None) -> DataFrame:
    """A row for each window that has a flag: the columns of `rows` but those of `windows`, then those of a flag. dismissed: an
    array of `index-heard`."""
    kept = [c for c in rows.columns if c not in ("cursor", "read", "offset", "page", "heard")]
    part = lambda name: F.transform("heard", lambda w: w[name]).alias(f"_{name}")
    given = F.array().cast("array<string>") if dismissed is None else F.coalesce(dismissed, F.array())
    shown = rows.select(*kept, "cursor", "read", "offset", "page", given.alias("_dismissed"), *map(part, ("text", "start", "end", "confidence")))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept] + [FLAGS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary()
        for batch in batches:
            known.start()
            normal, at, looks, gone = known.normal, [], [], []
            columns = (batch.column(c).to_pylist() for c in ("cursor", "read", "offset", "page", "_dismissed", "_text", "_start", "_end", "_confidence"))
            for i, (cursor, read, offset, page, out, *said) in enumerate(zip(*columns)):
                words = [Heard(t, normal[t or ""], s, e, min(1.0, max(0.0, c or 0.0))) for t, s, e, c in zip(*(x or [] for x in said)) if s is not None and e is not None]
                if look := _looked([normal[x or ""] for x in page or []], words, cursor, read, offset):
                    at.append(i)
                    looks.append(look)
                    gone.append(frozenset(out))
            found = _judged_together(known, looks, gone, least)
            yield _flag_rows(batch.select(kept), [(at[k], flag) for k, flag in found])

    return shown.mapInArrow(run, schema)


def _judged_together(known: Vocabulary, looks: list[Look], dismissed: list[frozenset[str]] | None, least: float) -> list[tuple[int, Flag]]:
    """The looks that tell a slip, by their numbers, and the slips."""
    pairs = aligned_together(known, [([w.word for w in x.heard], x.part) for x in looks])
    flags = (_judged(p, x, dismissed[k] if dismissed else frozenset(), least) for k, (p, x) in enumerate(zip(pairs, looks)))
    return [(k, flag) for k, flag in enumerate(flags) if flag]


def _flag_rows(rows: pa.RecordBatch, found: list[tuple[int, Flag]]) -> pa.RecordBatch:
    names, kinds = [x.split()[0] for x in FLAGS.split(", ")], [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
    rest, values = rows.take(pa.array([i for i, _ in found], pa.int64())), list(zip(*(flag for _, flag in found))) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([*rest.columns, *map(pa.array, values, kinds)], names=[*rows.schema.names, *names])


def session_flags(sessions: DataFrame, tokens: str, heard: str | Made, step: float, hop: int = PHRASE, least: float = ALONE) -> DataFrame:
    """`flags` of the `windows` of sessions, without a row for each window: they are cut out of a session's arrays where these are
    read, and those that are read as written are left out at once. heard: a column, or how it is made of the tokens."""
    kept = [c for c in sessions.columns if c not in (tokens, heard)]
    columns, made = sent(tokens, heard)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in sessions.schema.fields if f.name in kept] + ["window int", FLAGS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary()
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                known.start()
                some = batch.slice(at, TOGETHER)
                rows, numbers, looks = _looks(made(some, known), known, step, hop)
                found = _judged_together(known, looks, None, least)
                windows = pa.array([numbers[k] for k, _ in found], pa.int32())
                each = some.select(kept).take(pa.array([rows[k] for k, _ in found], pa.int64()))
                yield _flag_rows(pa.RecordBatch.from_arrays([*each.columns, windows], names=[*kept, "window"]), [(k, flag) for k, (_, flag) in enumerate(found)])

    return sessions.select(*kept, *columns).mapInArrow(run, schema)


def _looks(r: Readings, known: Vocabulary, step: float, hop: int) -> tuple[list[int], list[int], list[Look]]:
    """The windows of readings that need an alignment: whose they are, their numbers, and they."""
    size = np.diff(r.pages)
    each = -(-size // hop)
    row = np.repeat(np.arange(len(size)), each)
    window = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    page = r.pages[row] + window * hop
    wide = np.minimum(hop + PHRASE, r.pages[row + 1] - page)
    near_by = (r.words[row] + np.maximum(1, window * hop - 2 * hop) - 1)[:, None] + np.arange(5 * hop)
    inside = near_by < r.words[row + 1][:, None]
    near_by[~inside] = 0
    start = r.starts[near_by] if len(r.starts) else np.zeros(near_by.shape)
    inside &= (start >= (window * hop * step)[:, None]) & (start < ((window + 1) * hop * step)[:, None])
    many, first = inside.sum(1), near_by[np.arange(len(row)), inside.argmax(1)]
    # what is read as written: words side by side, in order, that count, and the same as at some place of the page
    counts = np.zeros(len(known.words), bool)
    used = np.unique(r.heard)
    counts[used] = [known.words[k] != "" and known.words[k] not in SOUNDS for k in used.tolist()]
    odd = ~(counts[r.heard] & (r.starts <= r.ends))
    fall = np.concatenate([[False], r.starts[1:] < r.starts[:-1]])[: len(odd)]
    odds, falls = (np.concatenate([[0], np.cumsum(x)]) for x in (odd, fall))
    last = first + many
    last_in = near_by[np.arange(len(row)), inside.shape[1] - 1 - inside[:, ::-1].argmax(1)]
    asked = many > 0
    at = np.flatnonzero(asked)
    at = at[(last_in[at] + 1 == last[at]) & (odds[last[at]] == odds[first[at]]) & (falls[last[at]] == falls[first[at] + 1])]
    for shift in range(hop + PHRASE):
        at = at[many[at] + shift <= wide[at]]
        if not len(at):
            break
        k = np.arange(int(many[at].max()))
        within = k < many[at][:, None]
        same = ~within | (r.heard[np.where(within, first[at][:, None] + k, 0)] == r.page[np.where(within, page[at][:, None] + shift + k, 0)])
        straight = same.all(1)
        asked[at[straight]] = False
        at = at[~straight]
    rows, numbers, looks = [], [], []
    for w in np.flatnonzero(asked).tolist():
        said = near_by[w][inside[w]].tolist()
        words = [Heard(r.text(k), known.words[r.heard[k]], *x) for k, x in zip(said, zip(r.starts[said].tolist(), r.ends[said].tolist(), r.sure[said].tolist()))]
        cursor, a = int(window[w]) * hop, int(page[w])
        part = [known.words[k] for k in r.page[a : a + int(wide[w])].tolist()]
        if look := _looked(part, words, cursor, min(cursor + hop, int(size[row[w]])), cursor):
            rows.append(int(row[w]))
            numbers.append(int(window[w]))
            looks.append(look)
    return rows, numbers, looks
