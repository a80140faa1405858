"""Secrets in texts: fixed patterns, and literals that reach a sensitive name.

A lexer reads source code and configuration (of most languages' common syntax: assignments, declarations with
types, mappings, keyword arguments, environment and ini files, elements, header lines, pairs in calls) into
pairs of a name and a value.  A value is made of literals and other names; such names stand for the values
they were last given, so a constant's literal counts for every name it reaches.  A literal is scored by the
most sensitive of these names and by its own looks, and is a span if the sum reaches a bar.

Every step is linear in the text.  A text in which no sensitive name occurs has no such literal and isn't lexed.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

#: Kinds found by form alone: pattern, and whether a match counts.  Fixed values.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")  # runs begin behind another character: the rest are too short
KINDS = ("assign", "access", "hex", "literal")

#: Parts of names, fixed values: of secrets, of secrets when `key` follows, of what may be secret, of what isn't.
STRONG = frozenset(("password", "passwd", "passphrase", "passcode", "pwd", "secret", "secrets", "token", "apikey", "credential", "credentials", "authorization"))
BEFORE_KEY = frozenset(("api", "access", "private", "secret", "signing", "encryption", "auth", "account", "storage", "master", "shared", "service"))
WEAK = frozenset(("auth", "pass", "pin", "salt", "key", "bearer", "signature", "cookie", "session"))
NOT = frozenset(("public", "length", "len", "size", "count", "max", "min", "type", "name", "file", "path", "url", "uri", "field", "hint", "label", "expires", "expiry", "ttl", "id", "ids", "policy", "regex", "pattern", "format", "placeholder", "prompt", "error", "message", "limit"))
#: Values that stand for a secret to be filled in.
EMPTY = re.compile(r"(?:x+|\*+|\.+|<.*>|\{\{.*\}\}|%.*%|change[-_ ]?(?:me|it|this)|example.*|placeholder|dummy|redacted|todo|your[-_ ].*|none|null|nil|true|false|undefined|test|password|secret|string)", re.I | re.S)
BAR = 0.7

_STEM = re.compile("|".join(sorted(STRONG | WEAK, key=lambda w: (-len(w), w))), re.I | re.A)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = r"(?<!\w)[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z0-9_$]+)*"
_TOKEN = re.compile(rf"(?P<quote>[\"'`])|(?P<name>{_NAME})|(?P<op>:=|=>|==|!=|<=|>=|->|::|[=:,>\]])|(?P<open>[(<])|(?P<gap>[ \t]+)|(?P<other>[^\w \t]|[0-9])")
_BODY = {'"': re.compile(r'(?:[^"\\\n]|\\[^\n])*+'), "'": re.compile(r"(?:[^'\\\n]|\\[^\n])*+"), "`": re.compile(r"[^`\n]*+")}
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>=:]+(?:={1,2}(?=[\s\"'`,;(){}\[\]<>]|\Z))?")
_CHAIN = re.compile(rf"[&*]*(?:{_NAME})[ \t]*(?::=|=>|=(?!=)|:)[ \t]*(?=[\"'`(])")
_WHOLE_NAME = re.compile(_NAME)
_SCHEME = re.compile(r"(?:Bearer|Basic|Token)[ \t]+(?=\S)", re.I)
_STANDS = re.compile(r"\$\{?([A-Za-z_][A-Za-z0-9_.]*)\}?")
_PREFIX = re.compile(r"(?i)(?:[bfru]|br|rb|fr|rf)(?=[\"'])")


@dataclass
class Pair:
    """A name and what it is given: places of literals, with whether they are quoted, and other names.
    chained: the next pair's value is this one's as well."""

    name: str
    literals: list[tuple[int, int, bool]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    chained: bool = False


class Lexer:
    def __init__(self, text: str):
        self.text = text
        #: Of each quote, where it is known that no string can begin: to the end of a line without another.
        self.dead = dict.fromkeys(_BODY, range(0))

    def string(self, at: int) -> int:
        """The end of the content of a string that begins at the quote `at`; -1 if it isn't closed in its line."""
        quote = self.text[at]
        if at in self.dead[quote] or quote == "'" and at and self.text[at - 1].isalnum():
            return -1
        end = _BODY[quote].match(self.text, at + 1).end()
        if end < len(self.text) and self.text[end] == quote:
            return end
        self.dead[quote] = range(at, end)
        return -1

    def pairs(self) -> list[Pair]:
        text, out = self.text, []
        at, last = 0, None  # last: (name, string?, behind a bracket or <?), if an operator may follow
        opened = ""
        while m := _TOKEN.search(text, at):
            if m.start() > at:
                last, opened = None, ""  # letters of other scripts lie between
            at, kind = m.end(), m.lastgroup
            if kind == "gap":
                continue
            if kind == "name":
                last, opened = (m[0], False, opened), ""
            elif kind == "quote":
                end = self.string(m.start())
                if end < 0:
                    last = None
                else:
                    last, at = (text[m.end() : end], True, opened), end + 1
                opened = ""
            elif kind == "op" and last and (m[0] in ("=", ":", ":=", "=>") or m[0] == "," and last[1] and last[2] == "(" or m[0] == ">" and last[2] == "<"):
                pair = Pair(last[0])
                self.value(at, m[0], pair)
                if pair.literals or pair.names or pair.chained:
                    out.append(pair)
                last, opened = None, ""
            elif m[0] == "]" and last and last[1]:
                pass  # the string is a subscript
            else:
                last, opened = None, m[0] if kind == "open" else ""
        return out

    def value(self, at: int, op: str, pair: Pair) -> None:
        """Reads terms joined by + from `at`.  Behind = and + they may go on in the next line."""
        text = self.text
        lines = op in ("=", ":=", "=>", ",")
        strings = True
        while True:
            while at < len(text) and (text[at] in " \t(" or lines and text[at] in "\r\n\\"):
                at += 1
            if not (m := _SCHEME.match(text, at)) and (c := _CHAIN.match(text, at)) and not _PREFIX.fullmatch(c[0]):
                pair.chained = not pair.literals and not pair.names
                return
            at = m.end() if m else at
            if p := _PREFIX.match(text, at):
                at = p.end()
            if at >= len(text):
                return
            if text[at] in _BODY:
                end = self.string(at)
                if end < 0:
                    return
                self.literal(at + 1, end, True, pair)
                at, strings = end + 1, True
            elif m := _STANDS.match(text, at):
                pair.names.append(m[1])
                at, strings = m.end(), False
            elif m := _BARE.match(text, at):
                self.literal(at, m.end(), False, pair)
                at, strings = m.end(), False
            else:
                return
            while at < len(text) and text[at] in " \t":
                at += 1
            lines = text[at : at + 1] == "+"
            if lines:
                at += 1
            elif not (strings and at < len(text) and text[at] in _BODY):  # strings side by side are one
                return

    def literal(self, start: int, end: int, quoted: bool, pair: Pair) -> None:
        whole = _STANDS.fullmatch(self.text, start, end)
        if whole:
            pair.names.append(whole[1])
            return
        if not quoted and _WHOLE_NAME.fullmatch(self.text, start, end):
            pair.names.append(self.text[start:end])
        if end > start:
            pair.literals.append((start, end, quoted))


@functools.lru_cache(4096)
def name_score(name: str) -> float:
    """0.6 of a secret's name, 0.3 of one that may be, otherwise nothing."""
    words = [w.lower() for w in _PARTS.findall(name)]
    if any(w in NOT for w in words):
        return 0.0
    if any(w in STRONG for w in words) or any(a in BEFORE_KEY and b == "key" for a, b in zip(words, words[1:], strict=False)):
        return 0.6
    return 0.3 if any(w in WEAK for w in words) else 0.0


def literal_score(value: str, quoted: bool, strong: bool) -> float:
    """What the looks of a literal add to its name's score: length, kinds of characters, entropy.  Fillers,
    places, sentences and plain words take from it; of names that may be secret it must be long and mixed."""
    n = len(value)
    if n < 6 or EMPTY.fullmatch(value) or len(set(value)) < 3:
        return -1.0
    kinds = [any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() for c in value)]
    if not strong and (n < 16 or not (kinds[2] and (kinds[0] or kinds[1]))):
        return -1.0
    out = 0.2 if n >= 16 else 0.1 if n >= 8 else 0.0
    out += (0.0, 0.0, 0.1, 0.2, 0.2)[sum(kinds)]
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    out += 0.1 if entropy >= 3 else 0.0
    if any(c.isspace() for c in value) or "://" in value or value[0] in "/.~":
        out -= 0.4
    if not (kinds[2] or kinds[3]):
        out -= 0.1 if quoted else 0.4
    return out


def sensitivity(pairs: list[Pair]) -> list[float]:
    """Of each pair, the highest score of a name that its value reaches.  A name stands for what it was given
    last before, or first behind if nothing was before."""
    given: dict[str, list[int]] = {}
    for k, p in enumerate(pairs):
        given.setdefault(p.name.lstrip("$").rpartition(".")[2], []).append(k)
    latest: dict[str, int] = {}
    to: list[list[int]] = []
    for k, p in enumerate(pairs):
        own = []
        for name in p.names:
            name = name.lstrip("$").rpartition(".")[2]
            j = latest.get(name, -1)
            if j < 0 and name in given:
                j = next((i for i in given[name][:2] if i != k), -1)
            if j >= 0:
                own.append(j)
        if p.chained and k + 1 < len(pairs):
            own.append(k + 1)
        to.append(own)
        latest[p.name.lstrip("$").rpartition(".")[2]] = k
    out = [0.0] * len(pairs)
    # the highest first, so each pair is reached by its highest name at once
    for k in sorted(range(len(pairs)), key=lambda k: -name_score(pairs[k].name)):
        score, todo = name_score(pairs[k].name), [k]
        while todo and score:
            i = todo.pop()
            if not out[i]:
                out[i] = score
                todo += to[i]
    return out


def literals(text: str) -> set[tuple[int, int]]:
    """Places of literals that are secrets by the names they reach."""
    if not _STEM.search(text):
        return set()
    pairs = Lexer(text).pairs()
    found = set()
    for p, score in zip(pairs, sensitivity(pairs), strict=True):
        if score:
            found.update((a, b) for a, b, quoted in p.literals if round(score + literal_score(text[a:b], quoted, score > 0.5), 6) >= BAR)
    return found


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, ascending.  The first three kinds are found by form: matches that are
    too short are dropped and not tried again."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out += [(a, 3, b) for a, b in literals(text)]
    return sorted(out)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _mapped(docs: DataFrame, id_col: str, text_col: str, names: list[str], schema: str, kinds: list[pa.DataType], row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            rows = [row(spans(t or "")) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["id", *names])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, {schema}")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, secrets array<struct<kind, start, end>>) of every whole text, in code points, by start, then kind.

    Spans of different kinds may overlap; a literal's is what its quotes hold.  Null and empty texts have none;
    rows that repeat come out repeatedly, other columns are ignored, no rows give none."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    row = lambda found: ([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found],)
    return _mapped(docs, id_col, text_col, ["secrets"], "secrets array<struct<kind:string,start:int,end:int>>", [kind], row)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) as of find_secrets: the base kinds counted and
    digested, all spans written out."""

    def row(found: list[tuple[int, int, int]]) -> tuple:
        base = [s for s in found if s[1] < 3]
        return (*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(found))

    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return _mapped(docs, id_col, text_col, names, schema, [pa.int64()] * 3 + [pa.string()] * 2, row)


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
