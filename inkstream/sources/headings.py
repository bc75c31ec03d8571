"""Scripts of word-processor files and e-books with what their format says of structure: runs of text with styles, headings by
outline level or navigation, title and author. Each file is one row; chapters are cut from the rows in the JVM."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstream.functions.text import minutes, word_count
from inkstream.sources.files import BLOCKS, MUTED, WORD_NS, _checked, _entry, _named

#: Marks of a run by their element, and values that take a mark away; kinds of sections that are chapters.
STYLES = {"b": "bold", "i": "italic", "u": "underline", "highlight": "highlight"}
NOT_SET = re.compile(r"(?i)0|false|off|none")
SECTIONS = re.compile(r"(?:doc-)?(?:chapter|part|preface|dedication|foreword|introduction|appendix|afterword|epilogue|prologue)")
GONE = ("del", "moveFrom")

SCRIPT = "path string, title string, author string, text string, spans array<struct<text: string, style: array<string>>>, headings array<struct<title: string, start: int, content_start: int>>, error string"


def _word(name: str) -> str:
    return WORD_NS + name


def _value(node: ElementTree.Element | None) -> str | None:
    return None if node is None else node.get(_word("val"))


def _level(properties: ElementTree.Element | None, styles: dict[str, ElementTree.Element], seen: tuple[str, ...] = ()) -> int | None:
    """The outline level of a paragraph: its own, or that of its style or of one that this is based on."""
    if properties is None:
        return None
    own = next(properties.iter(_word("outlineLvl")), None)
    if own is not None:
        level = int(_value(own) or 9)
        return level if level < 9 else None
    name = _value(next((x for tag in ("pStyle", "basedOn") for x in properties.iter(_word(tag))), None))
    if not name or name in seen:
        return None
    standard = re.fullmatch(r"(?i)heading([1-6])", name)
    return int(standard[1]) - 1 if standard else _level(styles.get(name), styles, (*seen, name))


def docx_script(content: bytes) -> dict:
    """Paragraphs in order, each a line, as runs with their styles; paragraphs of the highest outline level are headings. Deleted and
    moved text is left out, text boxes stand after the paragraph that holds them."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        _checked(archive)
        names = archive.namelist()
        body = ElementTree.fromstring(archive.read("word/document.xml"))
        sheet = ElementTree.fromstring(archive.read("word/styles.xml")) if "word/styles.xml" in names else ElementTree.Element("none")
        about = ElementTree.fromstring(archive.read("docProps/core.xml")) if "docProps/core.xml" in names else ElementTree.Element("none")
    styles = {x.get(_word("styleId")): x for x in sheet.iter(_word("style"))}
    paragraphs: list[tuple[ElementTree.Element, list[tuple[str, list[str]]]]] = []

    def walk(node: ElementTree.Element, runs: list | None) -> None:
        for child in node:
            kind = child.tag.removeprefix(WORD_NS)
            if kind in GONE:
                continue
            if kind == "p":
                paragraphs.append((child, own := []))
                walk(child, own)
                continue
            if kind == "r" and runs is not None:
                text = "".join((x.text or "") if x.tag == _word("t") else {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "‑"}.get(x.tag.removeprefix(WORD_NS), "") for x in child)
                marks = child.find(_word("rPr"))
                style = [name for tag, name in STYLES.items() if marks is not None and (x := marks.find(_word(tag))) is not None and not NOT_SET.fullmatch(_value(x) or "")]
                if text:
                    runs.append((text, style))
            walk(child, runs)

    walk(body, None)
    spans, headings, at = [], [], 0
    for i, (paragraph, runs) in enumerate(paragraphs):
        runs = [("\n", [])] * (i > 0) + runs
        spans += runs
        text = "".join(t for t, _ in runs)
        level = _level(paragraph.find(_word("pPr")), styles)
        start, at = at + (i > 0), at + len(text)
        if level is not None and text.strip():
            headings.append((level, text.strip(), start, at))
    text = "".join(t for t, _ in spans)
    if not text.strip():
        raise ValueError("no readable paragraphs")
    top = min((h[0] for h in headings), default=0)
    return {"text": text, "spans": spans, "headings": [h[1:] for h in headings if h[0] == top], **_about(about)}


def _about(node: ElementTree.Element) -> dict:
    """Title and author of a package's or document's metadata."""
    found = lambda name: next((" ".join("".join(x.itertext()).split()) for x in _named(node, name)), "") or None
    return {"title": found("title"), "author": found("creator")}


class _Page(HTMLParser):
    """The text of a section, where each element with an id and each heading begins and ends in it, and links of its navigation."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.title, self.open = "", "", []
        self.muted, self.body, self.linking = 0, False, False
        self.ids: dict[str, int] = {}
        self.headings: list[dict] = []
        self.links: list[list[str]] = []

    def _line(self) -> None:
        self.text = self.text.rstrip()
        if self.text:
            self.text += "\n"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        kinds = (given.get("epub:type", "") + " " + given.get("role", "")).split()
        if tag == "body":
            self.body = True
        self.muted += tag in MUTED
        if tag in BLOCKS and not self.muted:
            self._line()
        if tag not in ("br", "hr", "img", "meta", "link", "input"):
            self.open.append((tag, kinds))
        if self.body and not self.muted:
            if "id" in given:
                self.ids.setdefault(given["id"], len(self.text))
            if re.fullmatch("h[1-6]", tag):
                holders = [kinds for name, kinds in self.open[:-1] if name != "hgroup"]
                around = holders[-1] if holders else []
                self.headings.append({"level": int(tag[1]), "start": len(self.text), "end": None, "section": any(SECTIONS.fullmatch(k) for k in around)})
        if tag == "a":
            self.linking = any(k in ("toc", "doc-toc") for t, ks in self.open if t == "nav" for k in ks)
            if self.linking:
                self.links.append([given.get("href", ""), ""])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in BLOCKS and not self.muted:
            self._line()
        if self.body and not self.muted and given.get("id"):
            self.ids.setdefault(given["id"], len(self.text))

    def handle_endtag(self, tag: str) -> None:
        self.muted -= tag in MUTED and self.muted > 0
        self.linking &= tag != "a"
        if re.fullmatch("h[1-6]", tag) and self.headings and self.headings[-1]["end"] is None:
            self.headings[-1]["end"] = len(self.text.rstrip())
        if tag in BLOCKS and not self.muted:
            self._line()
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if any(t == "title" for t, _ in self.open) and not self.body:
            self.title += data
        if self.linking:
            self.links[-1][1] += data
        if self.body and not self.muted:
            plain = re.sub(r"[\t\r\n ]+", " ", data)
            self.text += plain.lstrip(" ") if not self.text or self.text[-1] in "\n " else plain


def _page(archive: zipfile.ZipFile, name: str) -> _Page:
    page = _Page()
    page.feed(archive.read(name).decode("utf-8-sig", "replace"))
    page.close()
    page.text = page.text.rstrip()
    return page


def _section_headings(page: _Page, targets: list[tuple[str, str]], default: str) -> list[tuple[str, int, int]]:
    """(title, start, content_start) of a section. targets: (fragment, label) of the navigation. Where that does not reach inside, or
    not everywhere, headings of chapters count, else the highest level that comes more than once, and all above."""
    title_of = lambda h: " ".join(page.text[h["start"] : h["end"]].split())
    heads = [h | {"end": h["end"] if h["end"] is not None else len(page.text)} for h in page.headings]
    found: dict[int, tuple[str, int, int]] = {}

    def add(start: int, label: str) -> None:
        head = next((h for h in heads if h["start"] <= start <= h["end"] and h["start"] < h["end"]), None)
        start = head["start"] if head else start
        title = title_of(head) if head else label
        if title:
            found[start] = (title, start, head["end"] if head else start)

    for fragment, label in targets:
        if not fragment:
            add(0, label)
        elif fragment in page.ids:
            add(page.ids[fragment], label)
    inside = [f for f, _ in targets if f]
    if not found or not inside or any(f not in page.ids for f in inside):
        levels = [h["level"] for h in heads]
        chapters = [h["level"] for h in heads if h["section"]]
        most = min((x for x in set(levels) if levels.count(x) > 1), default=9)
        for h in heads:
            if (h["section"] or h["level"] < min(chapters)) if chapters else h["level"] <= most:
                add(h["start"], title_of(h))
    if 0 not in found and page.text.strip():
        first = next((h for h in heads if h["start"] == 0), None)
        found[0] = (title_of(first), 0, first["end"]) if first else (default, 0, 0)
    return [found[k] for k in sorted(found)]


def epub_script(content: bytes) -> dict:
    """Sections in the order of the spine, a line between them, and their headings as offsets into the whole text."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        _checked(archive)
        names = archive.namelist()
        roots = [x.get("full-path") for x in _named(ElementTree.fromstring(archive.read("META-INF/container.xml")), "rootfile")] if "META-INF/container.xml" in names else []
        package = next((n for n in [*roots, *(n for n in names if n.endswith(".opf"))] if n in names), None)
        if package is None:
            raise ValueError("no package document")
        book = ElementTree.fromstring(archive.read(package))
        items = {x.get("id"): (_entry(package, x.get("href") or ""), x.get("media-type") or "", "nav" in (x.get("properties") or "").split()) for x in _named(book, "item")}
        targets: dict[str, list[tuple[str, str]]] = {}

        def target(base: str, href: str, label: str) -> None:
            path, _, fragment = href.partition("#")
            label = " ".join(label.split())
            if href and label:
                targets.setdefault(_entry(base, path) if path else base, []).append((unquote(fragment), label))

        for name, kind, nav in items.values():
            if name not in names:
                continue
            if nav:
                for href, label in _page(archive, name).links:
                    target(name, href, label)
            elif kind == "application/x-dtbncx+xml":
                for point in _named(ElementTree.fromstring(archive.read(name)), "navPoint"):
                    direct = {x.tag.rsplit("}")[-1]: x for x in point}
                    if "content" in direct and "navLabel" in direct:
                        target(name, direct["content"].get("src") or "", "".join(direct["navLabel"].itertext()))
        text, headings, n = "", [], 0
        for ref in _named(book, "itemref"):
            name, _, nav = items.get(ref.get("idref"), (None, "", False))
            if name is None or nav or name not in names:
                continue
            page = _page(archive, name)
            if not page.text.strip():
                continue
            n += 1
            text += "\n" if text else ""
            own = _section_headings(page, targets.get(name, []), " ".join(page.title.split()) or f"Section {n}")
            headings += [(title, start + len(text), end + len(text)) for title, start, end in own]
            text += page.text
    if not text:
        raise ValueError("no readable text")
    return {"text": text, "spans": [(text, [])], "headings": headings, **_about(book)}


def _scripts(spark: SparkSession, path: str, parse: Callable[[bytes], dict]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "title", "author", "text", "spans", "headings", "error"]
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    x = parse(bytes(content))
                    spans = [{"text": t, "style": s} for t, s in x["spans"]]
                    rows.append((name, x["title"], x["author"], x["text"], spans, [dict(zip(("title", "start", "content_start"), h)) for h in x["headings"]], None))
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    rows.append((name, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCRIPT)


def docx_scripts(spark: SparkSession, path: str) -> DataFrame:
    """path, title, author, text, spans, headings, error of word-processor files."""
    return _scripts(spark, path, docx_script)


def epub_scripts(spark: SparkSession, path: str) -> DataFrame:
    """The same of e-books; their text is one span."""
    return _scripts(spark, path, epub_script)


def chapters_of(scripts: DataFrame, key: str = "path") -> DataFrame:
    """key, chapter (from 1), title, heading_text (stacked headings, a line each; null for one), text, start, content_start, words,
    minutes of scripts by their headings. A heading without text is part of the next one's; what stands before the first is
    `Front matter`; a script without headings is one chapter."""
    blank = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    first = F.coalesce(F.get("headings", F.lit(0))["start"], F.length("text"))
    lead = F.array(F.struct(F.when(F.size(F.coalesce("headings", F.array())) == 0, "Chapter 1").otherwise("Front matter").alias("title"), F.lit(0).alias("start"), F.lit(0).alias("content_start")))
    heads = F.concat(F.when(blank(F.substring(F.col("text"), F.lit(1), first)) != "", lead).otherwise(F.array().cast("array<struct<title string, start int, content_start int>>")), F.coalesce("headings", F.array()))
    rows = scripts.where(F.col("text").isNotNull()).select(key, "text", heads.alias("_heads"))
    end = lambda i: F.coalesce(F.get("_heads", i + 1)["start"], F.length("text"))
    cut: Callable[[Column, Column], Column] = lambda h, i: F.struct(h["title"].alias("title"), h["start"].alias("start"), h["content_start"].alias("content_start"), blank(F.substring(F.col("text"), h["content_start"] + 1, F.greatest(end(i) - h["content_start"], F.lit(0)))).alias("body"))
    each = rows.select(key, F.posexplode(F.transform("_heads", cut)).alias("_i", "h")).select(key, "_i", "h.*")
    w = Window.partitionBy(key).orderBy("_i")
    told = each.withColumn("_n", F.coalesce(F.sum((F.col("body") != "").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    stack = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "title"))), lambda x: x["title"]), "\n")
    found = told.groupBy(key, "_n").agg(
        F.max_by("title", "_i").alias("title"), F.when(F.count(F.lit(1)) > 1, stack).alias("heading_text"), F.max_by("body", "_i").alias("text"), F.min("start").alias("start"), F.max("content_start").alias("content_start")
    )
    return found.select(key, (F.col("_n") + 1).alias("chapter"), "title", "heading_text", "text", "start", "content_start", word_count(F.col("text")).alias("words"), F.round(minutes(word_count(F.col("text"))), 6).alias("minutes"))
