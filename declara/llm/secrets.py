"""Secret scans: Aho-Corasick keywords, anchored expressions near hits, checksums.

One automaton pass over each text (A-Z lower-cased, so offsets stay) finds the
keywords of all rules. Only there are a rule's expression, anchored at a fixed
place before the keyword, and its check run. Runs of hexadecimal digits have no
keyword; a stride of half the shortest run finds the only places where one can
be, and the run is read from there.

Base rules (``assign``, ``access``, ``hex``) take leftmost non-overlapping
matches per kind, and drop those that are too short after matching. Further
rules have stricter forms: issuer tokens whose last six characters are the
base-62 CRC-32 of what precedes them, JSON web tokens whose header decodes to an
object, and private key blocks.

Defined results: null text is empty, and an empty text has no spans; offsets are
code points, ends exclusive; spans of several kinds may overlap; each row, equal
ones too, gives one row; ids may be null or of any type; other columns are not
read; the time for a text grows with its length, whatever it holds.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import quoted, small_batches
from .kept import held

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_token(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the part after the prefix, in base 62."""
    body, check, value = m[1][:-6], m[1][-6:], 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def web_token(m: re.Match) -> bool:
    head = m[1]
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
    except (binascii.Error, ValueError):
        return False


@dataclass(frozen=True)
class Rule:
    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]
    #: Where the expression fails at the start of this run, it fails at any later keyword in it too, so the run is read once.
    run: re.Pattern | None = None


#: In the order in which kinds are listed.
RULES = (
    Rule(
        "assign",
        ("password", "passwd", "secret", "token", "api_key", "apikey"),
        re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
        lambda m: len(m[2]) >= 6,
    ),
    Rule("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    Rule("hex", (), re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    Rule("issued", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), crc_token),
    Rule("web", ("eyj",), re.compile(r"(eyJ[\w-]++)\.[\w-]++\.[\w-]++", re.A), web_token, re.compile(r"eyJ[\w-]*", re.A)),
    Rule("key", ("-----begin ",), re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s\\]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", re.A), lambda m: True),
)
ORDER = {rule.kind: i for i, rule in enumerate(RULES)}
HEX, HEX_LEAST = RULES[2], 24
HEX_DIGIT = frozenset("0123456789abcdef")
_automaton = []


def automaton():
    if not _automaton:
        import ahocorasick

        built = ahocorasick.Automaton()
        for i, rule in enumerate(RULES):
            for word in rule.keywords:
                built.add_word(word, (i, len(word)))
        built.make_automaton()
        _automaton.append(built)
    return _automaton[0]


def folded(text: str) -> str:
    """A-Z lower-cased; every other character keeps its place."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def hex_runs(text: str) -> Iterator[re.Match]:
    """Whole runs of at least HEX_LEAST digits: each covers two neighbouring places of the stride."""
    step, end = HEX_LEAST // 2, 0
    marks = [c in HEX_DIGIT for c in text[::step]]
    for i in range(len(marks) - 1):
        if marks[i] and marks[i + 1] and i * step >= end:
            start = i * step
            while start > end and text[start - 1] in HEX_DIGIT:
                start -= 1
            m = HEX.pattern.match(text, start)
            end = m.end()
            if HEX.valid(m):
                yield m


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    text = text or ""
    hits = sorted((at - size + 1, i) for at, (i, size) in automaton().iter(folded(text)))
    found, ends = [("hex", m.start(), m.end()) for m in hex_runs(text)], [0] * len(RULES)
    for start, i in hits:
        if start < ends[i]:
            continue
        rule = RULES[i]
        if m := rule.pattern.match(text, start):
            ends[i] = m.end()
            if rule.valid(m):
                found.append((rule.kind, start, m.end()))
        elif rule.run:
            ends[i] = m.end() if (m := rule.run.match(text, start)) else start
    return sorted(found, key=lambda f: (f[1], ORDER[f[0]], f[2]))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every row."""
    kind = docs.select(quoted(id_col)).schema[0].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("secrets", dict)
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), f)) for f in scan(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, struct)], names=["id", "spans"])

    found = small_batches(docs).select(quoted(id_col), quoted(text_col)).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
    return found.withColumnRenamed("id", id_col)
