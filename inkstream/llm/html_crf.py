"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page.

Each leaf block is a node with two labels, article or not. Its features are the tags and the class, id and role words of
its ancestors, simple facts about its text, and the lengths and links of its neighbours; weights of features and of label transitions are learnt by maximum
conditional likelihood (forward-backward, Adam) on labelled pages, and a page is decoded by Viterbi. The labelled pages
are made up (labelled_pages), their number is a parameter, and the model is fitted on the driver in a few seconds.

Every page is extracted by itself, without a shuffle. Null and empty pages, and pages without article blocks, have the
empty text. Broken markup never fails: unclosed elements are closed by what follows them. Rows that repeat an id are
extracted each, an empty table gives no rows, and a column of the result's name gives way to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.llm._common import strings, table, whole_text
from inkstream.llm.dom import Element, Leaf, leaves
from inkstream.llm.labelled_pages import PageMaker

TRAINING_PAGES = 800
SCALE = 2**40
WORD = re.compile(r"[a-z]+")
STOP = re.compile(r"[.!?…](?=\s|$)")
BUCKETS = (1, 2, 4, 8, 16, 32, 64)


PARTS = ("aside", "nav", "footer", "form", "header")


#: The name of all class, id and role words that hardly any training page has.
RARE, LEAST_PAGES = "is:?", 3


def element_features(e: Element, known: Container[str]) -> list[str]:
    """Features of one ancestor; `bare` is a container without any name. Words that are not known are one feature."""
    tag = e.tag if e.names or e.tag not in ("div", "section", "table") else "bare " + e.tag
    return ["in:" + tag] * (e.tag not in ("html", "body")) + [f if (f := "is:" + w) in known else RARE for w in WORD.findall(e.names)]


def place_features(e: Element | None, is_open: Callable[[str], bool]) -> list[str]:
    """Features of where a leaf stands: its block, and parts of a page inside the article."""
    inside = is_open("article") or is_open("main")
    return ["leaf:" + (e.block if e else "")] + ["article+" + part for part in PARTS if inside and is_open(part)]


def path_features(e: Element | None, known: Container[str]) -> set[str]:
    path = e.path() if e else []
    tags = {x.tag for x in path}
    return {f for x in path for f in element_features(x, known)} | set(place_features(e, tags.__contains__))


def shape(leaf: Leaf) -> tuple[int, int]:
    """Length and share of linked text, in steps."""
    words = leaf.text.count(" ") + 1
    return sum(words >= b for b in BUCKETS), round(4 * leaf.linked / len(leaf.text))


def text_features(blocks: list[Leaf], i: int) -> list[str]:
    """Features of a leaf's own text, and of the lengths and links of its neighbours."""
    text = blocks[i].text
    words, linked = shape(blocks[i])
    stops = len(STOP.findall(text))
    out = [f"words:{words}", f"linked:{linked}", f"stops:{sum(stops >= b for b in BUCKETS)}", "bias"]
    for side, k in (("before", i - 1), ("after", i + 1)):
        if 0 <= k < len(blocks):
            near = shape(blocks[k])
            out += [f"{side} words:{near[0]}", f"{side} linked:{near[1]}"]
    if text[-1] in ".!?…\"”":
        out.append("ends")
        if not linked and words > 3:
            out.append("prose")
    if "©" in text or "copyright" in text.lower():
        out.append("copyright")
        if i == len(blocks) - 1 and i:
            out.append("last copyright")
    if " | " in text or " · " in text or " » " in text:
        out.append("separators")
    if len(blocks) == 1:
        return [*out, "only prose" if out[-1] == "prose" else "only"]
    if i == 0:
        out.append("first")
    if i == len(blocks) - 1:
        out.append("last")
    return out


class Crf:
    """Two labels, so one weight for each feature (of label 1 against label 0), and four for transitions."""

    def __init__(self, pages: list[tuple[list[set[str]], list[int]]], steps: int = 300, rate: float = 0.1, ridge: float = 1e-5):
        names = sorted({f for page, _ in pages for block in page for f in block})
        index = {f: i for i, f in enumerate(names)}
        longest, count = max(len(y) for _, y in pages), len(pages)
        where = [(p, t, index[f]) for p, (page, _) in enumerate(pages) for t, block in enumerate(page) for f in block]
        p, t, f = np.array(where).T
        at = p * longest + t
        y = np.full((count, longest), -1)
        for i, (_, labels) in enumerate(pages):
            y[i, : len(labels)] = labels
        there = y >= 0
        w, a = np.zeros(len(names)), np.zeros((2, 2))
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, a)]
        total = there.sum()
        seen = np.zeros((2, 2))
        both = there[:, 1:]
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
        for step in range(1, steps + 1):
            emit = np.zeros((count, longest, 2))
            emit[:, :, 1] = np.bincount(at, w[f], count * longest).reshape(count, longest)
            forward, backward = np.zeros_like(emit), np.zeros_like(emit)
            forward[:, 0] = emit[:, 0]
            for k in range(1, longest):
                forward[:, k] = emit[:, k] + np.logaddexp(forward[:, k - 1, :1] + a[0], forward[:, k - 1, 1:] + a[1])
                forward[:, k] = np.where(there[:, k, None], forward[:, k], forward[:, k - 1])
            log_z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
            for k in range(longest - 2, -1, -1):
                ahead = emit[:, k + 1] + backward[:, k + 1]
                back = np.logaddexp(ahead[:, :1] + a[:, 0], ahead[:, 1:] + a[:, 1])
                backward[:, k] = np.where(there[:, k + 1, None], back, 0)
            one = np.exp(forward[:, :, 1] + backward[:, :, 1] - log_z[:, None])
            grad_w = np.bincount(f, (np.where(there, (y == 1) - one, 0))[p, t], len(names)) / total - ridge * w
            pair = forward[:, :-1, :, None] + a + (emit + backward)[:, 1:, None, :] - log_z[:, None, None, None]
            grad_a = (seen - np.exp(pair[both]).sum(0)) / total - ridge * a
            for x, g, (m, v) in zip((w, a), (grad_w, grad_a), moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights = dict(zip(names, w.tolist()))
        self.moves = a.tolist()

    def viterbi(self, gains: list[float]) -> list[int]:
        if not gains:
            return []
        (a, b), (c, d) = self.moves
        zero, one, back = 0.0, gains[0], []
        for g in gains[1:]:
            from_zero, from_one = zero + a >= one + c, zero + b >= one + d
            back.append((0 if from_zero else 1, 0 if from_one else 1))
            zero, one = (zero + a if from_zero else one + c), g + (zero + b if from_one else one + d)
        labels = [int(one > zero)]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]


class PathScores:
    """Sums of the weights of path_features for leaves in page order: the features of open elements are counted as these open
    and close, so a page costs its elements and not their depths. Sums are of whole numbers, and so exact."""

    def __init__(self, weights: dict[str, int]):
        self.weights, self.open, self.total = weights, [], 0
        self.counts: Counter[str] = Counter()
        self.tags: Counter[str] = Counter()

    def _count(self, e: Element, step: int) -> None:
        self.tags[e.tag] += step
        for f in element_features(e, self.weights):
            before = self.counts[f]
            self.counts[f] = before + step
            if before == 0 or before + step == 0:
                self.total += step * self.weights.get(f, 0)

    def of(self, e: Element | None) -> int:
        new, known = [], e
        while known is not None and not (known.depth < len(self.open) and self.open[known.depth] is known):
            new.append(known)
            known = known.parent
        while len(self.open) > (known.depth + 1 if known else 0):
            self._count(self.open.pop(), -1)
        for x in reversed(new):
            self.open.append(x)
            self._count(x, 1)
        return self.total + sum(self.weights.get(f, 0) for f in place_features(e, lambda tag: self.tags[tag] > 0))


class Extractor:
    def __init__(self, crf: Crf):
        self.crf = crf
        self.weights = {f: round(w * SCALE) for f, w in crf.weights.items()}

    def labels(self, blocks: list[Leaf]) -> list[int]:
        scores, weight = PathScores(self.weights), self.weights.get
        return self.crf.viterbi([(scores.of(b.inside) + sum(weight(f, 0) for f in text_features(blocks, i))) / SCALE for i, b in enumerate(blocks)])

    def text(self, page: str) -> str:
        blocks = leaves(page)
        return "\n".join(b.text for b, y in zip(blocks, self.labels(blocks)) if y)


def labelled(seed: int) -> tuple[str, list[Leaf], list[int]]:
    """A page, its leaf blocks and their labels: a block belongs to the piece in whose mark-up it was made."""
    pieces = PageMaker(seed).page()
    counts = [len(leaves("".join(h for h, _ in pieces[: i + 1]))) for i in range(len(pieces))]
    page = "".join(h for h, _ in pieces)
    blocks, labels = leaves(page), []
    for (_, y), n in zip(pieces, counts):
        labels += [y] * (n - len(labels))
    return page, blocks, labels[: len(blocks)]


def trained(pages: int = TRAINING_PAGES, seed: int = 0) -> Crf:
    made = [(blocks, labels) for i in range(pages) for _, blocks, labels in [labelled(seed + i)] if blocks]
    seen = Counter("is:" + w for blocks, _ in made for w in {w for b in blocks for e in (b.inside.path() if b.inside else ()) for w in WORD.findall(e.names)})
    known = {w for w, n in seen.items() if n >= LEAST_PAGES}
    data = [([path_features(b.inside, known) | set(text_features(blocks, k)) for k, b in enumerate(blocks)], labels) for blocks, labels in made]
    return Crf(data)


def extract(df: DataFrame, crf: Crf, html: str = "html", out: str = "text") -> DataFrame:
    """df without its html, and with the main text of each whole page."""
    kept = [c for c in df.columns if c not in (html, out)]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(crf)
        for batch in batches:
            texts = pa.array([extractor.text(x) for x in strings(batch.column(html))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, texts], names=[*kept, out])

    return df.select(*kept, whole_text(F.col(html)).alias(html)).mapInArrow(run, schema)


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), trained()).withColumn("n_chars", F.length("text").cast("long"))
