"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by the generalised pigeonhole
principle.

Fingerprints are compared only once each (copies share one).  The 64 bits are dealt to partitions so
that correlated bits lie together.  For a fingerprint q and partitions i with thresholds T_i,
sum(T_i + 1) = radius + 1, every fingerprint within `radius` differs from q in at most T_i bits of
some partition i.  The thresholds may be unequal and are chosen for each q by dynamic programming
over the partitions: the cost of a threshold is the number of probes it takes plus the number of
candidates expected from a bounded sample of fingerprints.  Each q then probes the ball of radius
T_i around its bits of partition i, in an equi-join; the full distance is verified inside the join,
so only true links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, parts

BITS = 64
#: For each value of a byte, its bits as eight 8-bit lanes of one integer; sums of up to 255 don't overflow.
_LANES = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], dtype=np.uint64)


def fingerprints(texts: list[bytes | None], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text.  A bit is set if it is set in over half the
    XXH64 hashes of the text's word shingles, repeats included.  A text of fewer words than a
    shingle hashes its whole sequence; none, empty or blank: zero."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = text.lower().split() if text else ()  # bytes: ASCII letters and ASCII white space only
        n = len(words) - shingle + 1
        if n > 1:
            hashes = np.array([digest(s, seed) for s in map(b" ".join, zip(*(words[j:] for j in range(shingle)), strict=False))], dtype=np.uint64)
            lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
            sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)  # little-endian bytes, then lanes
            ones = sums.view(np.uint8).reshape(len(sums), BITS).sum(axis=0, dtype=np.int64)
            out[k] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
        elif words:
            out[k] = digest(b" ".join(words), seed)
    return out


def add_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of every whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(texts, shingle, seed).view(np.int64))], names=["id", "fp"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def correlated_partitions(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Deals the bits to `parts` groups of near equal size: each group starts at the bit with the
    strongest ties and takes the bits most correlated with it."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    if len(bits) > 1:
        dev = bits - bits.mean(axis=0)
        sd = np.sqrt((dev**2).sum(axis=0))
        ties = np.abs(dev.T @ dev) / np.where(sd > 0, sd, 1)[:, None] / np.where(sd > 0, sd, 1)[None, :]
    else:
        ties = np.zeros((BITS, BITS))
    np.fill_diagonal(ties, 0)
    left, out = list(range(BITS)), []
    for i in range(parts):
        size = BITS // parts + (i < BITS % parts)
        group = [max(left, key=lambda x: (ties[x, left].sum(), -x))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda x: (ties[x, group].sum(), -x))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def gather_bits(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for to, k in enumerate(bits):
        out |= ((fps >> np.uint64(k)) & np.uint64(1)) << np.uint64(to)
    return out


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of `width` bits with at most `radius` set; none for radius -1."""
    return np.array([sum(1 << k for k in c) for r in range(radius + 1) for c in combinations(range(width), r)], dtype=np.uint64)


def allocate(cost: np.ndarray, radius: int) -> np.ndarray:
    """cost[q, i, t + 1]: of threshold t (from -1) in partition i.  The thresholds [q, i] of least
    total cost whose sum(t + 1) is radius + 1, by dynamic programming over the partitions."""
    n, m, _ = cost.shape
    need = radius + 1
    best = np.full((n, need + 1), np.inf)
    best[:, 0] = 0
    took = np.zeros((m, n, need + 1), dtype=np.int8)
    for i in range(m):
        new = np.full((n, need + 1), np.inf)
        for total in range(need + 1):
            for t in range(total + 1):
                c = best[:, total - t] + cost[:, i, t]
                better = c < new[:, total]
                new[better, total] = c[better]
                took[i, better, total] = t
        best = new
    out = np.zeros((n, m), dtype=np.int8)
    at = np.full(n, need)
    for i in reversed(range(m)):
        t = took[i, np.arange(n), at]
        out[:, i] = t - 1
        at = at - t
    return out


def thresholds(fps: np.ndarray, sample: np.ndarray, parts: list[list[int]], radius: int, total: int) -> np.ndarray:
    """The thresholds of each fingerprint, by the candidates expected from the sample."""
    cost = np.zeros((len(fps), len(parts), radius + 2))
    scale = total / max(1, len(sample))
    for i, bits in enumerate(parts):
        near = np.zeros((len(fps), radius + 1))
        base = gather_bits(sample, bits)
        for lo in range(0, len(fps), 2048):
            d = np.bitwise_count(gather_bits(fps[lo : lo + 2048], bits)[:, None] ^ base[None, :])
            near[lo : lo + 2048] = np.stack([(d <= t).sum(axis=1) for t in range(radius + 1)], axis=1)
        for t in range(radius + 1):
            cost[:, i, t + 1] = len(ball(len(bits), t)) + scale * near[:, t]
    return allocate(cost, radius)


def hamming_links(distinct: DataFrame, radius: int = 3, parts: int = 2, sample_rows: int = 2048) -> DataFrame:
    """(a, b), a < b as signed longs: all pairs of `distinct` (one column fp, no repeats) at `radius` or
    fewer differing bits.  `sample_rows` bounds the sample that the partitions and thresholds are
    fitted on; they change the cost only, never the result."""
    total = distinct.count()
    rows = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()
    sample = np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64)
    groups = correlated_partitions(sample, parts)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for lo in range(0, len(fps), 2048):
                some = fps[lo : lo + 2048]
                limit = thresholds(some, sample, groups, radius, total)
                for i, bits in enumerate(groups):
                    own = gather_bits(some, bits)
                    for t in range(radius + 1):
                        at = np.flatnonzero(limit[:, i] == t)
                        if len(at):
                            masks = ball(len(bits), t)
                            keys = (own[at][:, None] ^ masks[None, :]).ravel() | np.uint64(i << 58)
                            who = np.repeat(some[at], len(masks))
                            for s in range(0, len(keys), 1 << 17):
                                yield pa.RecordBatch.from_arrays([pa.array(keys[s : s + (1 << 17)].view(np.int64)), pa.array(who[s : s + (1 << 17)].view(np.int64))], names=["key", "a"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i, bits in enumerate(groups):
                yield pa.RecordBatch.from_arrays([pa.array((gather_bits(fps, bits) | np.uint64(i << 58)).view(np.int64)), pa.array(fps.view(np.int64))], names=["key", "b"])

    if any(len(g) > 56 for g in groups):
        raise ValueError("at least two partitions")
    probes, entries = distinct.mapInArrow(probe, "key long, a long"), distinct.mapInArrow(index, "key long, b long")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return probes.join(entries, (probes.key == entries.key) & (F.col("a") < F.col("b")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42, parts: int = 2) -> DataFrame:
    """(id, fp, component_id) for every row of `docs`: its fingerprint and the smallest id reachable
    over links of `radius` or fewer differing bits.

    Null, empty and blank texts have fingerprint zero and link like any other.  Rows with a null id
    get a component like others; it is null only if no linked row has an id.  Repeated rows come out
    repeatedly.  An empty table gives an empty table.  Other columns of `docs` are ignored."""
    marks = materialize(add_fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    least = materialize(marks.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    groups = connected_components(hamming_links(least.select("fp"), radius, parts))
    groups = materialize(groups, "simhash-components")
    named = least.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = named.join(roots, "root").select("fp", "component_id")
    return marks.join(of_fp, "fp").select("id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group.  A document without an id can't be referred to and
    stays; rows that repeat one id stand or fall together.  Columns of any names stay as they are."""
    gone = near_duplicates(docs).where("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
