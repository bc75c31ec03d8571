"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration syntax.

The lexer turns a text into (name, value) pairs: assignments and key-value lines of code, JSON, YAML (block scalars too), INI
and shell, several names at once, default values of shell parameters, elements and key/value attributes of XML, and calls
that set something (`setPassword("...")`, `put("token", "...")`). A value is a chain of literals and names; a name stands
for what it was last assigned in its function or around it, so a literal is followed to wherever it is used. A value that
reaches a name which sounds like a secret is scored by that name and by its own shape. Spans are code points, end
exclusive; `value` is where the secret itself starts inside its span.

Values refer to the values they are made of and carry sums over their characters, so a text of any number of parts is
lexed in about linear time and none is left out. Every row is scanned by itself: no shuffle, whole texts. Null and empty
texts have no spans; rows that repeat an id are scanned each; an empty table gives no rows; columns of the input are carried
along but for one of the result's name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.llm._common import strings, table, whole_text

#: Fixed values of the result's contract: kinds in their order, patterns and least lengths.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so as [0-9a-f]+ of 24 and more
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: How much the words of a name say that its value is a secret, from 0 to 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.7, "bearer": 0.8, "private": 0.5, "key": 0.5,
    "access": 0.3, "api": 0.4, "client": 0.2, "signing": 0.4, "encryption": 0.4, "salt": 0.6, "dsn": 0.6, "pass": 0.8,
}
#: Words of a name that say it holds no secret itself: its place, size, kind or time.
HARMLESS = {"path", "file", "url", "uri", "length", "len", "size", "count", "type", "name", "id", "field", "label", "public", "expiry", "ttl", "timeout", "hint", "policy", "column"}
PLACEHOLDER = re.compile(r"(?i)\A(.)\1*\Z|changeme|change_me|example|placeholder|your[_-]|dummy|redacted|<[^<>]*>|\$\{|\{\{|xxx|\*\*\*|\A(none|null|true|false|undefined)\Z", re.S)
#: Least score of a literal.
SCORE = 1.4
#: First words of calls that set what they name, and of those whose first argument is the name.
SETTERS = {"set", "with", "use", "add", "put", "init", "configure", "define", "assign", "update"}
NAMERS = SETTERS | {"setenv", "putenv", "header", "property", "option", "param", "env", "environ", "setitem", "export"}

_NAME = r"[A-Za-z_$][\w$]*(?:[.\-][\w$]+)*"
EVENT = re.compile(
    rf"""^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+\w+
    |\b(?:function|func|fun|fn|sub)\b[^\n{{}};=]{{0,200}}(?P<body>\{{)
    |\$\{{(?P<default>\w+):?[-=](?P<otherwise>[^{{}}\n]*)\}}
    |(?P<brace>[{{}}])
    |<(?P<element>[\w.:\-]+)(?:\s[^<>]*)?>(?P<content>[^<>\n]+)</(?P=element)\s*>
    |\b(?i:key|name)\s*=\s*(?P<kq>["'])(?P<kv_name>[^"'\n]{{1,80}})(?P=kq)\s+(?i:value)\s*=\s*(?P<vq>["'])(?P<kv_value>[^"'\n]*)(?P=vq)
    |(?<![\w$.])(?P<names>[A-Za-z_]\w*(?:[ \t]*,[ \t]*[A-Za-z_]\w*){{1,30}})[ \t]*=(?![=>])[ \t]*
    |(?<![\w$])(?<![\w$][.\-])(?P<q>["']?)(?P<name>{_NAME}(?:\[["'][^"'\]\n]{{1,80}}["']\])?)(?P=q)[ \t]*
        (?:(?P<op>=>|:=|\+=|=(?!=)|:(?![/:]))[ \t]*|(?P<call>\()(?=\s*["'`]))""",
    re.A | re.M | re.X,
)
QUOTED = re.compile(r"""[rbuf]{0,2}(?:(?P<three>\"{3}|'{3})(?P<long>(?:\\.|(?!(?P=three))[^\\])*)(?P=three)|(?P<one>["'`])(?P<short>(?:\\.|(?!(?P=one))[^\\\n])*)(?P=one))""", re.A | re.S)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
#: The same inside a bare word that has been read before: from one sign of assignment to the next.
INNER = re.compile(r"""[^\s"'`,;(){}\[\]<>=:]+(?:=+(?![^\s"'`,;(){}\[\]<>]))?""")
DEFAULT = re.compile(r"\$\{\w+:?[-=]([^{}\n]*)\}")
BLOCK = re.compile(r"[|>][+\-0-9]*[ \t]*\n")
LINE = re.compile(r"([ \t]*)([^\n]*)(?:\n|\Z)")
JOIN = re.compile(r"[ \t]*(?:\+|\.\.|~)[ \t]*(?:\\?\n[ \t]*)?")
IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_$][\w$]*)*\Z", re.A)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value: int


class Value:
    """A literal, or a chain of values; with what scoring needs to know of all its characters. Lengths and counts are of the
    chain as it would be joined, brought down together where they get beyond any use."""

    __slots__ = ("span", "parts", "length", "counts", "spaced", "quoted", "dull", "shown")

    def __init__(self, span: tuple[int, int] | None = None, text: str = "", quoted: bool = False, parts: tuple[Value, ...] = ()):
        self.span, self.parts, self.shown = span, parts, False
        self.length, self.counts = len(text) + sum(p.length for p in parts), Counter(text)
        for p in parts:
            self.counts.update(p.counts)
        if self.length > 2**40:
            self.counts = Counter({c: max(1, n >> 20) for c, n in self.counts.items()})
            self.length = sum(self.counts.values())
        self.quoted = quoted or any(p.quoted for p in parts)
        self.spaced = any(map(str.isspace, text)) or any(p.spaced for p in parts)
        self.dull = bool(PLACEHOLDER.search(text)) if span else all(p.dull for p in parts)  # one part that stands for nothing does not make the rest dull

    def literals(self) -> Iterator[tuple[int, int]]:
        """Spans of the literals it is made of that have not been given yet."""
        open_ = [self]
        while open_:
            v = open_.pop()
            if not v.shown:
                v.shown = True
                if v.span:
                    yield v.span
                open_ += v.parts


def base_spans(text: str) -> list[Span]:
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [Span("assign", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [Span("access", *m.span(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [Span("hex", *m.span(), m.start()) for m in HEX.finditer(text)]
    return found


def name_score(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    return min(1.0, sum(SENSITIVE.get(w, 0.0) for w in set(words)))


def value_score(value: Value) -> float:
    """From 0 (a word, a placeholder) to 1 (long and mixed)."""
    if value.length < LEAST["assign"] or value.dull or value.spaced or len(value.counts) < 2:
        return 0.0
    bits = -sum(n / value.length * math.log2(n / value.length) for n in value.counts.values())
    classes = sum(any(test(c) for c in value.counts) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    if not value.quoted and classes < 2:
        return 0.0
    return min(1.0, bits / 4) * (0.6 + 0.2 * min(classes - 1, 2)) + 0.1 * value.quoted


class Scopes:
    """What names stand for: the text itself, and in it functions, which end with their indentation or their brace."""

    def __init__(self):
        self.open: list[tuple[dict[str, Value], int, int]] = [({}, -1, -1)]  # names, indentation, depth of braces; -1: neither
        self.depth = 0
        self.bare_end = 0  # of the last bare word

    def find(self, name: str) -> Value | None:
        return next((names[name] for names, _, _ in reversed(self.open) if name in names), None)

    def put(self, name: str, value: Value) -> None:
        self.open[-1][0][name] = value

    def line(self, indent: int) -> None:
        while self.open[-1][1] >= indent:
            self.open.pop()

    def braces(self, brace: str, is_body: bool = False) -> None:
        if brace == "{":
            self.depth += 1
            if is_body:
                self.open.append(({}, -1, self.depth))
        else:
            if self.open[-1][2] == self.depth:
                self.open.pop()
            self.depth = max(0, self.depth - 1)


def parsed_value(text: str, at: int, scopes: Scopes, block: bool = False) -> tuple[Value | None, int]:
    """The value that begins there, and where it ends. block: a YAML block scalar may begin here."""
    parts: list[Value] = []
    if block and (m := BLOCK.match(text, at)):
        at, least = m.end(), None
        while at < len(text):
            m = LINE.match(text, at)
            if m[2] and (least is None and not m[1] or least is not None and len(m[1]) < least):
                break
            if m[2]:
                least = len(m[1]) if least is None else least
                parts.append(Value(m.span(2), m[2], True))
            at = m.end()
        return (Value(parts=tuple(parts)) if parts else None), at
    inside = 0
    while at < len(text):
        if text[at] == "(" and not parts:
            at, inside = at + 1, inside + 1
            continue
        if inside:
            while at < len(text) and text[at].isspace():
                at += 1
        quoted = QUOTED.match(text, at)
        if quoted:
            which = "long" if quoted["three"] else "short"
            parts.append(Value(quoted.span(which), quoted[which], True))
            at = quoted.end()
        elif d := DEFAULT.match(text, at):
            parts.append(Value(d.span(1), d[1]))
            break  # its own name is an event too
        elif b := (INNER if at < scopes.bare_end else BARE).match(text, at):
            word = b.group().rstrip(".:")
            scopes.bare_end = max(scopes.bare_end, b.end())
            if (known := scopes.find(word)) is not None:
                parts.append(known)
            elif not IDENTIFIER.match(word) or any(c.isdigit() for c in word):
                parts.append(Value((at, at + len(word)), word))
            if "=" in word[1:-1] or ":" in word[1:-1]:  # an assignment may stand inside: --set=key=value
                break
            at = b.end()
        else:
            break
        if j := JOIN.match(text, at):
            at = j.end()
        elif not (quoted and QUOTED.match(text, at + len(text[at : at + 200]) - len(text[at : at + 200].lstrip(" \t\n" if inside else " \t")))):
            break
        else:
            at += len(text[at : at + 200]) - len(text[at : at + 200].lstrip(" \t\n" if inside else " \t"))
    if not parts:
        return None, at
    return (parts[0] if len(parts) == 1 else Value(parts=tuple(parts))), at


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """(name, the value that it gets), in the order of the text."""
    scopes, at, seen = Scopes(), 0, 0
    while m := EVENT.search(text, at):
        start, at = m.start(), m.end()
        line = text.rfind("\n", seen, start) + 1
        if line:
            indent = len(text[line : line + 200]) - len(text[line : line + 200].lstrip(" \t"))
            scopes.line(indent)
        seen = start
        found: list[tuple[str, Value | None]] = []
        if m["indent"] is not None:
            scopes.open.append(({}, len(m["indent"]), -1))
        elif m["body"] or m["brace"]:
            scopes.braces(m["body"] or m["brace"], bool(m["body"]))
        elif m["default"]:
            found.append((m["default"], Value(m.span("otherwise"), m["otherwise"])))
        elif m["element"]:
            raw = m["content"]
            low = m.start("content") + len(raw) - len(raw.lstrip())
            found.append((m["element"], Value((low, low + len(raw.strip())), raw.strip(), True)))
        elif m["kv_name"]:
            found.append((m["kv_name"], Value(m.span("kv_value"), m["kv_value"], True)))
        elif m["names"]:
            for name in m["names"].split(","):
                value, end = parsed_value(text, at, scopes)
                found.append((name.strip(), value))
                if value is None:
                    break
                at = end
                if comma := re.compile(r"[ \t]*,[ \t]*").match(text, at):
                    at = comma.end()
        elif m["call"]:
            words = [w.lower() for w in WORDS.findall(m["name"].rsplit(".")[-1])]
            first, end = parsed_value(text, _past_space(text, at), scopes)
            comma = re.compile(r"\s*,\s*(?=[\"'`])").match(text, end)
            if first is not None and words:
                if comma and words[0] in NAMERS and first.span:
                    second, end = parsed_value(text, comma.end(), scopes)
                    found.append((text[slice(*first.span)], second))
                elif not comma and (words[0] in SETTERS or words[0] in SENSITIVE):
                    found.append((m["name"].rsplit(".")[-1], first))
                else:
                    end = at
            at = max(at, end) if found else at
        else:
            value, end = parsed_value(text, at, scopes, m["op"] == ":")
            if value is not None and value.span and not value.quoted and "=" in text[slice(*value.span)][1:-1]:
                end = at
            if m["op"] == "+=" and value is not None and (before := scopes.find(m["name"])) is not None:
                value = Value(parts=(before, value))
            found.append((m["name"], value))
            at = max(at, end)
        for name, value in found:
            if value is None:
                value = Value(parts=())
            scopes.put(name, value)
            yield name, value


def _past_space(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def literal_spans(text: str) -> list[Span]:
    if not any(c in text for c in "=:<("):
        return []
    found = []
    for name, value in pairs(text):
        weight = name_score(name) if value.length else 0.0
        if weight >= 0.5 and weight + value_score(value) >= SCORE:
            found += [Span("literal", a, z, a) for a, z in value.literals() if z > a]
    return list(dict.fromkeys(found))


def spans(text: str) -> list[Span]:
    return sorted(base_spans(text) + literal_spans(text), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.IntegerType())])
ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int32())])


def redacted(text: str, found: list[Span], mark: str) -> str:
    parts, at = [], 0
    for start, end in sorted((s.value, s.end) for s in found):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scan(df: DataFrame, text: str = "text", out: str = "spans", mark: str | None = None) -> DataFrame:
    """df with the spans of each whole text; with a mark, the text has the mark in place of each secret."""
    kept = [c for c in df.columns if c not in (out, text)]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(text, T.StringType()), T.StructField(out, T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(text))
            found = [spans(x) for x in texts]
            column = pa.array([[s._asdict() for s in x] for x in found], pa.list_(ARROW_SPAN))
            shown = batch.column(text) if mark is None else pa.array([redacted(x, s, mark) if s else x for x, s in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, shown, column], names=[*kept, text, out])

    return df.select(*kept, whole_text(F.col(text)).alias(text)).mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "literal")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(spark, docs: DataFrame, sf_dir: str, mark: str = "[SECRET]") -> DataFrame:
    """Pipeline stage: every document, with a mark in place of each secret; n_chars is that of the new text, and a null
    text is empty."""
    return scan(docs, out="__secret_spans", mark=mark).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
