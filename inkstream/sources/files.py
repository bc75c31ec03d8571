"""Manuscript and sound files as rows. Files are listed and read by Spark, so any store it reads will do; each file is one
row, and a file that cannot be read is a row with an error, never a failed job."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an archive may hold before it is unpacked.
MAX_BYTES, MAX_ENTRIES = 200 << 20, 1000
#: Elements that begin a line, and those that are not read aloud.
BLOCKS = set("address article aside blockquote br dd div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header footer hr li main ol p pre section table tr ul".split())
MUTED = set("script style nav svg template noscript".split())
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decoded(content: Column) -> Column:
    """Text of bytes by their byte order mark, UTF-8 without one; line ends become one line feed."""
    head = F.substring(F.hex(content), 1, 4)
    text = F.when(head == "FFFE", F.decode(content, "UTF-16LE")).when(head == "FEFF", F.decode(content, "UTF-16BE")).otherwise(F.decode(content, "UTF-8"))
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of plain text and markdown files."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def _checked(archive: zipfile.ZipFile) -> None:
    entries = archive.infolist()
    if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_BYTES:
        raise ValueError("the archive is too large")


def docx_text(content: bytes) -> str:
    """Paragraphs of a word-processor file without deleted text, joined by line feeds."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        _checked(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml"))

    def runs(node: ElementTree.Element) -> Iterator[str]:
        for child in node:
            kind = child.tag.removeprefix(WORD_NS)
            if kind in ("del", "moveFrom"):
                continue
            yield {"t": child.text or "", "tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}.get(kind, "") if kind != "p" else ""
            yield from runs(child)

    return "\n".join("".join(runs(p)) for p in body.iter(f"{WORD_NS}p"))


class _Blocks(HTMLParser):
    """The text of a page body: white space as one blank, a line feed around blocks, nothing of what is not read aloud."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.muted, self.inside = 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.inside |= tag == "body"
        self.muted += tag in MUTED
        self.parts.append("\n" if tag in BLOCKS else " " if tag in ("td", "th") else "")

    def handle_endtag(self, tag: str) -> None:
        self.muted -= tag in MUTED and self.muted > 0
        self.parts.append("\n" if tag in BLOCKS else "")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.parts.append("\n" if tag in BLOCKS else "")

    def handle_data(self, data: str) -> None:
        if self.inside and not self.muted:
            self.parts.append(re.sub(r"\s+", " ", data))

    def text(self) -> str:
        lines = (re.sub(r" +", " ", line).strip() for line in "".join(self.parts).split("\n"))
        return "\n".join(line for line in lines if line)


def _entry(base: str, href: str) -> str:
    """The archive entry that a link of `base` names; links out of the archive are refused."""
    link = urlsplit(href)
    found = posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(link.path)))
    if link.scheme or link.netloc or link.path.startswith("/") or found.startswith(".."):
        raise ValueError(f"not a link inside the archive: {href}")
    return found


def _named(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if isinstance(x.tag, str) and x.tag.rsplit("}")[-1] == name)


def epub_text(content: bytes) -> str:
    """Sections of an e-book in the order of its spine, joined by an empty line."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        _checked(archive)
        names = archive.namelist()
        roots = [x.get("full-path") for x in _named(ElementTree.fromstring(archive.read("META-INF/container.xml")), "rootfile")] if "META-INF/container.xml" in names else []
        package = next((n for n in [*roots, *(n for n in names if n.endswith(".opf"))] if n in names), None)
        if package is None:
            raise ValueError("no package document")
        book = ElementTree.fromstring(archive.read(package))
        items = {x.get("id"): x.get("href") for x in _named(book, "item")}
        sections = []
        for ref in _named(book, "itemref"):
            href = items.get(ref.get("idref"))
            if href and (name := _entry(package, href)) in names:
                page = _Blocks()
                page.feed(archive.read(name).decode("utf-8-sig", "replace"))
                page.close()
                sections.append(page.text())
    return "\n\n".join(s for s in sections if s)


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error of word-processor files."""
    return _parsed(spark, path, docx_text)


def epub_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error of e-books."""
    return _parsed(spark, path, epub_text)


def _parsed(spark: SparkSession, path: str, parse: Callable[[bytes], str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    rows.append((name, parse(bytes(content)), None))
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    rows.append((name, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, error string")


def wav_samples(content: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, channels, samples from -1 to 1, interleaved) of a 16-bit PCM file."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(content):
        kind, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", content, at + 8)
        elif kind == b"data":
            if form is None or form[0] != 1 or form[5] != 16:
                raise ValueError("only 16-bit PCM is read")
            raw = content[at + 8 : at + 8 + size]
            return form[2], form[1], np.frombuffer(raw[: len(raw) // 2 * 2], "<i2") / 32768.0
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def wav_frames(spark: SparkSession, path: str, seconds: float = 1.0) -> DataFrame:
    """path, rate, channels, frame, samples, error: each file in pieces, so no row grows with a file's length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    rate, channels, samples = wav_samples(bytes(content))
                except (ValueError, struct.error) as e:
                    yield pd.DataFrame([(name, None, None, None, None, str(e))], columns=["path", "rate", "channels", "frame", "samples", "error"])
                    continue
                step = max(1, int(rate * seconds)) * channels
                for k in range(0, len(samples), step):
                    yield pd.DataFrame([(name, rate, channels, k // step, samples[k : k + step].tolist(), None)], columns=["path", "rate", "channels", "frame", "samples", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, rate int, channels int, frame long, samples array<double>, error string")


def wav_bytes(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A 16-bit PCM file of samples from -1 to 1; what is not finite becomes silence."""
    x = np.clip(np.nan_to_num(np.asarray(samples, float), nan=0.0, posinf=0.0, neginf=0.0), -1, 1)
    data = np.where(x < 0, x * 32768, x * 32767).round().astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + b"data" + struct.pack("<I", len(data)) + data
