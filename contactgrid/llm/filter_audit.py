"""Interaction of filters: what each of five removes under all of their orders.

Which filters a document fails is a number under 32.  A table of 32 rows and 120 columns, one for each order
of the filters, holds the step at which such a document goes.  Tasks look their documents up in it and count
removals by part, order, step and label; the partial counts are summed, and everything else, what stays,
what was removed before, what only one filter removes and the shares over all orders, follows from them.

Four filters are decided by a text alone.  The fifth, whether a smaller id has the same text, needs the least
id of each text: texts are told apart by 128 bits of SHA-256, counted by text, part and label before they
are dealt by text, so many copies of a text are few rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
_COPY = 1 << 4
#: Removal at the step of each order, or 5 for what stays, by the filters failed.
FIRST_FAILURE = np.array([[next((k for k, f in enumerate(o) if mask >> FILTERS.index(f) & 1), 5) for o in ORDERS] for mask in range(32)], dtype=np.int64)
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a code point behind its first
_SYMBOLS = b"#$%&*|"


def failed(text: bytes, few: int = 100, distinct: int = 80, upper: int = 10) -> int:
    """The filters A to D that a UTF-8 text fails, as bits: under `few` words, under `distinct` per cent
    distinct words, over `upper` per cent capitals, any symbol."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _FOLLOWING))
    return (n < few) | (100 * len(set(words)) < distinct * n) << 1 | (100 * capitals > upper * points) << 2 | (len(text.translate(None, _SYMBOLS)) < len(text)) << 3


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, digest, mask) of every row: a null text counts as empty, a null part as the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 2):
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            digests = pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), digests, pa.array([failed(t) for t in texts], pa.int32())], names=["id", "part", "digest", "mask"])

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, part string, digest binary, mask int")


def with_copies(rows: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, n) of (id, part, digest, mask, good, toxic): adds filter E to the mask, and counts.

    A row fails E if an id smaller than its own has its digest; a null id is smaller than none and no
    other is smaller than it."""
    same = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("id", *same).agg(F.count("*").alias("n"))  # the labels' join dealt them by id
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    of_text = by_id.groupBy(*same).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"), least.alias("least"))
    smallest = F.min("least.id").over(Window.partitionBy("digest"))
    own = F.col("no_id") + F.when(F.col("least.id") == F.col("smallest"), F.col("least.n")).otherwise(F.lit(0))
    counted = of_text.withColumn("smallest", smallest).withColumn("first", own)
    each = F.array(F.struct("mask", F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(_COPY)).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    return counted.select("part", "good", "toxic", F.inline(each)).where("n > 0").select("part", "good", "toxic", "mask", "n")


def removals(rows: DataFrame, most_parts: int = 64, most_rows: int = 4096) -> DataFrame:
    """(part, filter_order, step, removed, good, toxic) of with_copies: step 6 counts what stays.

    A task keeps counts of `most_parts` parts at a time and looks up `most_rows` rows at once."""
    cells = len(ORDERS) * 6
    names = pa.array(np.repeat(ORDERS, 6))
    steps = pa.array(np.tile(np.arange(1, 7, dtype=np.int32), len(ORDERS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def counts() -> Iterator[pa.RecordBatch]:
            for part, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([part] * cells, pa.string()), names, steps, *map(pa.array, c)], names=["part", "filter_order", "step", "removed", "good", "toxic"])
            held.clear()

        for b in batches:
            for lo in range(0, b.num_rows, most_rows):
                some = b.slice(lo, most_rows)
                of_part = some.column(0).dictionary_encode()
                part = of_part.indices.to_numpy(zero_copy_only=False)
                good, toxic, mask, n = (some.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3, 4))
                for k, name in enumerate(of_part.dictionary.to_pylist()):
                    own = np.flatnonzero(part == k)
                    at = (FIRST_FAILURE[mask[own]] + np.arange(len(ORDERS)) * 6).ravel()
                    if name not in held and len(held) >= most_parts:
                        yield from counts()
                    sums = held.setdefault(name, np.zeros((3, cells), dtype=np.int64))
                    for row, weight in enumerate((n[own], n[own] * good[own], n[own] * toxic[own])):
                        # a batch's weights are whole numbers far below 2**53
                        sums[row] += np.bincount(at, weights=np.repeat(weight, len(ORDERS)), minlength=cells).astype(np.int64)
        yield from counts()

    found = rows.mapInArrow(run, "part string, filter_order string, step int, removed long, good long, toxic long")
    return found.groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in ("removed", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row
    for each part, order and step, zeros included.

    Null and empty texts fail A and may be copies of each other.  A document is good, or toxic, if any label
    of its id says so; null labels and ids say nothing.  Rows that repeat an id count each; they are no copies of
    each other.  No documents give no rows.  Other columns are ignored."""
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(says(good_col).alias("good"), says(toxic_col).alias("toxic"))
    rows = judged(docs, id_col, text_col, part_col).join(known, F.col("id") == F.col("label_id"), "left").drop("label_id")
    found = removals(with_copies(rows.fillna(0, ["good", "toxic"])))
    # what fails a filter goes at its first step when it comes first, what fails it alone still goes when it comes last
    name = F.when(F.col("step") < 6, F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    of_filter = Window.partitionBy("part", "filter")
    behind = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    out = found.withColumn("filter", name).withColumns(
        {
            "kept": F.sum("removed").over(behind),
            "fails": F.max(F.when(F.col("step") == 1, F.col("removed"))).over(of_filter),
            "unique_fails": F.max(F.when(F.col("step") == 5, F.col("removed"))).over(of_filter),
            "shapley": F.sum("removed").over(of_filter),
        }
    )
    return out.where("step < 6").select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The five filters over all documents, by language."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return audit(read("documents"), read("labels"))


OP12_SQL = r"""
with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id),
f as (select part, coalesce(quality, 0) as good, coalesce(toxic, 0) as toxic, {'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': w.doc_id > min(w.doc_id) over (partition by t)} as fails
    from w left join l on w.doc_id = l.doc_id),
m as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select part, n, good, toxic, filter_order, list_transform(string_split(filter_order, ''), lambda x: case x when 'A' then fails['A'] when 'B' then fails['B'] when 'C' then fails['C'] when 'D' then fails['D'] else fails['E'] end) as hits from m, o),
g as (select part, n, good, toxic, filter_order, hits, coalesce(list_position(hits, true), 6) as first, len(list_filter(hits, lambda x: x)) as n_hits, unnest([1, 2, 3, 4, 5]) as step from s),
r as (select part, filter_order, step, substr(filter_order, step, 1) as filter, sum(case when first > step then n else 0 end) as kept, sum(case when first = step then n else 0 end) as removed,
    sum(case when hits[step] and first < step then n else 0 end) as redundant, sum(case when hits[step] and n_hits = 1 then n else 0 end) as unique_fails,
    sum(case when first = step then good else 0 end) as good_lost, sum(case when first = step then toxic else 0 end) as toxic_lost from g group by part, filter_order, step)
select part, filter_order, step::integer as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
    good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, filter))::bigint as shapley from r
"""
