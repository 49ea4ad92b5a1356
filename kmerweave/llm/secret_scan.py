"""Secret scan by assignment-aware lexing.

Three fixed patterns give the base spans.  On top, a lexer reads the assignment
forms of source and configuration texts (``name = "literal"``, ``name: literal``,
``"name": "literal"``, ``<name>literal</name>``, ``--name literal``) as pairs of a
name and a literal or reference, propagates constants through references, and
scores every literal by the most sensitive name that it reaches and by its own
shape.  Literals over the threshold become spans of kind ``literal`` unless a
base span already covers them.

A document is scanned whole and on its own, so the scan is a map without a
shuffle, in time that grows with the text's length alone.  Defined cases: a null
text is an empty one; an empty text has no spans; repeated rows give repeated
results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import table

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.7

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    """The fixed patterns; runs that are too short are dropped after matching, so they still consume text."""
    out = []
    if ":" in text or "=" in text:
        out += [Span(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:  # a run of upper-case letters and digits is consumed whole, so its length decides
        out += [Span(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [Span(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


# ---------------------------------------------------------------- the lexer


class Pair(NamedTuple):
    """name = literal text[start:end], or name = the constant ``ref``; ``parts`` are the pieces of a joined literal."""

    name: str
    start: int
    end: int
    ref: str = ""
    parts: tuple[tuple[int, int], ...] | None = None

    def value(self, text: str) -> str:
        return text[self.start : self.end] if self.parts is None else "".join([text[a:b] for a, b in self.parts])


_OPERATOR = re.compile(r"(?<![=!<>:])(?::=|=>|=(?!=)|:(?![:/=]))")
_QUOTED = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\.)*){q}") for q in "\"'`"}
_BARE = re.compile(r"[^\s\"'`,;<>(){}\[\]#&|]+")
_REFERENCE = re.compile(r"\$\{([A-Za-z_][\w.-]*)\}|\$([A-Za-z_]\w*)|\{\{\s*([A-Za-z_][\w.]*)\s*\}\}|%\(([A-Za-z_]\w*)\)s")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z_0-9.]*")
_JOIN = re.compile(r"[ \t]*(?:\+[ \t]*\n?[ \t]*|\\\n[ \t]*)(?=[\"'`])")
_ELEMENT = re.compile(r"<([A-Za-z][\w.-]*)>\s*([^<>\s]+)\s*</")
_FLAG = re.compile(r"(?<![\w-])--([A-Za-z][A-Za-z0-9-]*)[ \t]+([^\s\"'-][^\s\"']*)")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.$-")


def _name_before(text: str, at: int) -> tuple[str, int]:
    """The name that ends before ``at`` (spaces, quotes and a closing bracket apart), and its start."""
    i = at
    while i and text[i - 1] in " \t":
        i -= 1
    while i and text[i - 1] in "\"'`]":
        i -= 1
    end = i
    while i and text[i - 1] in _NAME_CHARS:
        i -= 1
    return text[i:end], i


def pairs(text: str) -> list[Pair]:
    """All assignments of a text: by operators in order, then elements, then flags.

    A bare value ends with its run of characters or at the next assignment within
    it; a colon in the value of an equals sign is no such assignment, and neither
    is an equals sign that nothing follows (padding).  So values of one kind of
    operator don't overlap, and nothing is copied before it is scored.
    """
    out, n = [], len(text)
    ops = [(m.start(), m.end()) for m in _OPERATOR.finditer(text)]
    run_end = 0
    for k, (op, i) in enumerate(ops):
        name, at = _name_before(text, op)
        if not name:
            continue
        colon = text[op] == ":" and i == op + 1
        if text[op] == "=" and i == op + 1:  # name: type = value
            j = at
            while j and text[j - 1] in " \t":
                j -= 1
            if j and text[j - 1] == ":":
                name = _name_before(text, j - 1)[0] or name
        while i < n and text[i] in " \t(":
            i += 1
        if i < n and text[i] in "rbfuRBFU" and i + 1 < n and text[i + 1] in "\"'":
            i += 1
        if i < n and text[i] in _QUOTED and (q := _QUOTED[text[i]].match(text, i)):
            start, parts = q.start(1), [q.span(1)]
            while (j := _JOIN.match(text, q.end())) and (more := _QUOTED[text[j.end()]].match(text, j.end())):
                q = more
                parts.append(q.span(1))
            ref = _REFERENCE.fullmatch(text, *parts[0]) if len(parts) == 1 else None
            out.append(Pair(name, start, q.end(1), next(filter(None, ref.groups())) if ref else "", tuple(parts) if len(parts) > 1 else None))
        elif i < n and (ref := _REFERENCE.match(text, i)):
            out.append(Pair(name, ref.start(), ref.end(), next(filter(None, ref.groups())), ()))
        elif i < n and (i < run_end or (b := _BARE.match(text, i))):
            if i >= run_end:
                run_end = b.end()
            end, m = run_end, k + 1
            while m < len(ops) and ops[m][0] < run_end:
                s, e = ops[m]
                stops = colon or not (text[s] == ":" and e == s + 1)
                if s >= i and stops and (e < run_end or text[e : e + 1] in ('"', "'", "`")):
                    end = s
                    break
                m += 1
            while end > i and text[end - 1] == ".":
                end -= 1
            if end > i:
                out.append(Pair(name, i, end, text[i:end] if _IDENTIFIER.fullmatch(text, i, end) else ""))
    if "</" in text:
        out += [Pair(m[1], m.start(2), m.end(2)) for m in _ELEMENT.finditer(text)]
    if "--" in text:
        out += [Pair(m[1], m.start(2), m.end(2)) for m in _FLAG.finditer(text)]
    return out


# Sensitive parts of names and how much they tell; a fixed list.
_SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "apikey": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.7, "signature": 0.5}
_KEY_OF = {"api", "access", "private", "secret", "encryption", "signing", "master", "account", "storage", "ssh", "client"}
_HARMLESS = {"name", "url", "uri", "path", "file", "count", "limit", "type", "length", "max", "min", "ttl", "expiry", "expires", "header", "field", "hint", "label", "policy", "public", "endpoint", "dir"}
_PLACEHOLDER = re.compile(r"(?i)change.?me|example|placeholder|your[_-]?|dummy|redacted|insert|todo|none|null|true|false|x{4,}|\*{3,}|\.{3,}")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_score(name: str) -> float:
    """How sensitive a name is: 0 to 1."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    best = max((_SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if any(a in _KEY_OF and b in ("key", "keys") for a, b in zip(parts, parts[1:], strict=False)):
        best = 1.0
    return best - 0.5 * any(p in _HARMLESS for p in parts)


def literal_score(value: str) -> float:
    """How much a literal looks like a key or password: 0 to 1."""
    n = len(value)
    if n < 8 or any(c.isspace() for c in value) or _PLACEHOLDER.search(value) or ("<" in value and value.rfind(">") > value.find("<")):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, entropy / 4) * 0.6 + min(1.0, (classes - 1) / 2) * 0.4


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Literals over the threshold, constants propagated: a literal gets the score of every name that refers to it."""
    if not any(c in text for c in ":=<-"):
        return []
    found = pairs(text)
    if not found:
        return []
    score = {name: name_score(name) for name in {p.name for p in found}}
    refers: dict[str, set[str]] = {}
    for p in found:
        if p.ref and p.ref in score:
            refers.setdefault(p.name, set()).add(p.ref)
    # names pass their score to what they refer to, the highest first, so each name is settled once
    settled: set[str] = set()
    for s in sorted({s for s in score.values() if s > 0}, reverse=True):
        todo = [name for name, own in score.items() if own == s and name in refers and name not in settled] if refers else []
        while todo:
            name = todo.pop()
            if name in settled:
                continue
            settled.add(name)
            for other in refers.get(name, ()):
                if score[other] < s:
                    score[other] = s
                    todo.append(other)
    out = set()
    for p in found:
        s = score[p.name]
        if s > 0 and p.parts != () and not (p.ref and p.ref in score) and 0.6 * s + 0.4 * (shape := literal_score(p.value(text))) >= threshold and shape > 0.4:
            out.add(Span(p.start, 3, p.end))
    return sorted(out)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base = base_spans(text or "")
    starts, reach = [b.start for b in base], list(accumulate((b.end for b in base), max))
    covered = lambda s: (i := bisect_right(starts, s.start)) > 0 and s.end <= reach[i - 1]
    more = [s for s in literal_spans(text or "") if not covered(s)]
    return base, sorted(base + more)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id and its spans (start, end, kind, text; base marks those of the fixed patterns)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches):
            out = []
            for text in b.column("text").to_pylist():
                base, spans = scan(text)
                own = set(base)
                out.append([{"start": s.start, "end": s.end, "kind": KINDS[s.kind], "base": s in own, "text": text[s.start : s.end]} for s in spans])
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.list_(span))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<start: long, end: long, kind: string, base: boolean, text: string>>")


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    number = lambda kind, base=True: F.size(F.filter("spans", lambda s: (s.kind == kind) & (s.base == base))).cast("long")
    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k in KINDS[:3]),
        number("literal", False).alias("n_literal"),
        F.sha2(joined(F.filter("spans", lambda s: s.base)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
