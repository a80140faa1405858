"""Fill-in-middle transformation by overlapping chunks.

A unit of a text is a run of ASCII letters or any other single character, so whether a unit starts at a
byte depends on that byte and the one before it alone.  Texts are cut into chunks, each read with the last
byte of the chunk before it; chunks are counted side by side, by one vectorised pass over many.  Prefix
sums over a text's counts tell which chunk holds the start of the unit of a given rank, and only that chunk
is scanned again for its place.  Two ranks drawn from a hash of the document's id cut the text in three.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_LETTER = np.isin(np.arange(256), [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)])
_FIRST = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point


@dataclass(frozen=True)
class Law:
    """plain_from: texts whose third draw modulo 100 is as high stay as they are; spm_under: others whose
    fourth draw is lower put the suffix first.  chunk and window: bytes of a chunk and of one pass."""

    seed: int = 1
    plain_from: int = 90
    spm_under: int = 20
    chunk: int = 4096
    window: int = 1 << 20


def draws(seed: int, doc_id: object) -> tuple[int, int, int, int]:
    """Four numbers under 2**32 of a document; a null id counts as an empty string."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def _starts(data: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """For data[lo:hi]: where a unit starts and where a code point does, by each byte and the one before it."""
    letter = _LETTER[data[max(0, lo - 1) : hi]]
    before, own = (letter[:-1], letter[1:]) if lo else (np.concatenate([[False], letter[:-1]]), letter)
    first = _FIRST[data[lo:hi]]
    return first & ~(own & before), first


class Units:
    """The units of the texts data[ends[k - 1] : ends[k]], counted by chunk."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, chunk: int, window: int):
        self.data = data
        self.begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        sizes = ends - self.begins
        n_chunks = -(-sizes // chunk)
        #: Of each text, its first chunk; of each chunk, where it begins and ends.
        self.first = np.concatenate([[0], np.cumsum(n_chunks)]).astype(np.int64)
        within = np.arange(self.first[-1]) - np.repeat(self.first[:-1], n_chunks)
        self.lo = np.repeat(self.begins, n_chunks) + within * chunk
        self.hi = np.minimum(self.lo + chunk, np.repeat(ends, n_chunks))
        heads = within == 0
        counts = np.zeros((2, len(self.lo)), dtype=np.int64)
        k = 0
        while k < len(self.lo):  # chunks lie one behind another: a window takes as many as fit
            j = max(k + 1, int(np.searchsorted(self.hi, self.lo[k] + window, side="right")))
            base = self.lo[k]
            units, points = _starts(data, base, self.hi[j - 1])
            units[self.lo[k:j][heads[k:j]] - base] = True  # a text's first unit, whatever is before it
            for row, found in enumerate((units, points)):
                counts[row, k:j] = np.add.reduceat(found, self.lo[k:j] - base, dtype=np.int64)
            k = j
        #: Units and code points before each chunk, of all texts.
        self.units, self.points = (np.concatenate([[0], np.cumsum(c)]) for c in counts)

    def n(self, text: int) -> int:
        return int(self.units[self.first[text + 1]] - self.units[self.first[text]])

    def place(self, text: int, rank: int) -> tuple[int, int]:
        """Bytes and code points of a text before the unit of this rank, or all of them if it has no more."""
        a, b = self.first[text], self.first[text + 1]
        if a == b:
            return 0, 0
        want = self.units[a] + rank
        k = int(np.searchsorted(self.units[a + 1 : b + 1], want, side="right")) + a
        if k == b:
            return int(self.hi[b - 1] - self.begins[text]), int(self.points[b] - self.points[a])
        units, points = _starts(self.data, self.lo[k], self.hi[k])
        if k == a:
            units[0] = True
        at = int(np.flatnonzero(units)[want - self.units[k]])
        return int(self.lo[k] + at - self.begins[text]), int(self.points[k] - self.points[a] + np.count_nonzero(points[:at]))


@dataclass(frozen=True)
class Cut:
    n: int
    form: str
    output: bytes
    prefix_chars: int | None = None
    middle_chars: int | None = None


def _cut(units: Units, k: int, text: bytes, doc_id: object, law: Law) -> Cut:
    h1, h2, h3, h4 = draws(law.seed, doc_id)
    n = units.n(k)
    if not text or h3 % 100 >= law.plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return Cut(n, "plain", text)
    (i, left), (j, right) = (units.place(k, rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < law.spm_under:
        return Cut(n, "spm", b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), left, right - left)
    return Cut(n, "psm", b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), left, right - left)


def restore(output: bytes, form: str) -> bytes:
    """The text of an output: no mark is in the text, and none can overlap itself, so each is found once."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    a, b, c = (output.index(mark) for mark in (first, second, MIDDLE))
    one, two, middle = output[a + 3 : b], output[b + 3 : c], output[c + 3 :]
    return two + middle + one if form == "spm" else one + middle + two


def _cuts(part: pa.RecordBatch, law: Law) -> Iterator[Cut]:
    texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    units = Units(np.frombuffer(b"".join(texts), dtype=np.uint8), ends, law.chunk, law.window)
    for k, (doc_id, text) in enumerate(zip(part.column(0).to_pylist(), texts, strict=True)):
        yield _cut(units, k, text, doc_id, law)


def _mapped(docs: DataFrame, id_col: str, text_col: str, law: Law, fields: dict[str, tuple[str, pa.DataType]], row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            rows = [row(cut) for cut in _cuts(part, law)]
            columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields.values())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", *fields])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = ", ".join(f"{name} {kind}" for name, (kind, _) in fields.items())
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, {schema}")


_COUNTS = {"n": ("long", pa.int64()), "form": ("string", pa.string()), "prefix_chars": ("long", pa.int64()), "middle_chars": ("long", pa.int64())}


def fill_in_middle(docs: DataFrame, law: Law = Law(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every whole text.

    A null text counts as empty; an empty one, one that holds a mark and one whose draw says so stay plain,
    with null lengths.  The draws hang on the id alone, so rows that repeat an id and a text come out alike;
    a null id draws as an empty string does.  Other columns are ignored; no rows give none.  Beside the texts
    of a part of about 2 MB, or one text, a task holds a window and two numbers a chunk."""
    fields = _COUNTS | {"output": ("string", pa.string())}
    return _mapped(docs, id_col, text_col, law, fields, lambda c: (c.n, c.form, c.prefix_chars, c.middle_chars, c.output.decode()))


def digests(docs: DataFrame, law: Law = Law(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As fill_in_middle, with output_sha256 and, of the text made from output and form again, restored_sha256."""
    sha = lambda data: hashlib.sha256(data).hexdigest()
    fields = _COUNTS | {"output_sha256": ("string", pa.string()), "restored_sha256": ("string", pa.string())}
    return _mapped(docs, id_col, text_col, law, fields, lambda c: (c.n, c.form, c.prefix_chars, c.middle_chars, sha(c.output), sha(restore(c.output, c.form))))


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    """Every document cut in three and put together anew, as digests."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


OP11_SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || doc_id) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as w,
    ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, len(w) as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as i, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as j,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
        when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select doc_id, t, n, form, array_to_string(w[1:i], '') as pre, array_to_string(w[i + 1:j], '') as mid, array_to_string(w[j + 1:n], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
    sha256(case form when 'plain' then t else pre || mid || suf end) as restored_sha256
from p
"""
