"""Quality rules: countable rules, then a hashed n-gram logistic regression.

The classifier sees hashed single words, word pairs and character 4-grams (of code points) of the whole
text.  It is fitted on a bounded sample of labelled rows, calibrated on rows held out from the fit, and applied in Arrow
batches; a text goes when its calibrated probability of low quality reaches a fixed threshold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, parts

_SYMBOLS = b"#*$%&|<>"
_NO_POINT = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])  # white space and continuation bytes
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
#: Odd factors of the four characters of a gram.
_GRAM = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    words = text.split()
    n = len(words)
    dup, seen = 0, set()
    for line in text.split(b"\n"):
        if line.strip():
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n > 5:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(grams)) < len(grams):
            often = Counter(grams)
            covered = 0
            for k, g in enumerate(grams):
                if often[g] > 1:
                    repeat += k + 5 - max(k, covered)
                    covered = k + 5
    return n, len(text.translate(None, _NO_POINT)), len(text) - len(text.translate(None, _SYMBOLS)), dup, repeat


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def features(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): the share of each hashed word, word pair and character 4-gram among its kind, in
    three tables of 2**bits places side by side, by the square root."""
    b = np.frombuffer(text, dtype=np.uint8)
    out = []
    space = _SPACE[b]
    if len(b):
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        if len(starts):
            # a polynomial hash modulo 2**64; differences of prefix sums, shifted to a common power
            words = np.add.reduceat(_powered(b, space, starts, ends), starts)
            words ^= words >> np.uint64(29)
            words *= _ODD
            out.append((words >> np.uint64(64 - bits)).astype(np.int64))
            pairs = (words[:-1] * _PAIR ^ words[1:]) * _ODD
            out.append((pairs >> np.uint64(64 - bits)).astype(np.int64) + (1 << bits))
        c = _code_points(text)
        if len(c) >= 4:
            grams = c[:-3] * _GRAM[0]
            for k in (1, 2, 3):
                grams += c[k : len(c) - 3 + k] * _GRAM[k]
            grams ^= grams >> np.uint32(15)
            grams *= _GRAM[0]
            out.append((grams >> np.uint32(32 - bits)).astype(np.int64) + (2 << bits))
    idx, val = [], []
    for kind in out:
        if len(kind):
            places, n = np.unique(kind, return_counts=True)
            idx.append(places)
            val.append(np.sqrt(n / len(kind)))
    if not idx:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(idx), np.concatenate(val)


def _code_points(text: bytes) -> np.ndarray:
    """Of a UTF-8 text; bytes that are none count as U+FFFD."""
    if text.isascii():
        return np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    return np.frombuffer(text.decode(errors="replace").encode("utf-32-le"), dtype=np.uint32)


_POWERS = np.cumprod(np.full(4096, _ODD | np.uint64(1), dtype=np.uint64))


def _powered(b: np.ndarray, space: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each word's bytes times the power of their place in the word; white space is zero."""
    place = np.arange(len(b)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(b)]])))
    x = (b.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095]
    x[space] = 0
    return x


@dataclass(frozen=True)
class Model:
    """p(low quality) = sigmoid(a * (w . x + bias) + b)."""

    weights: np.ndarray
    bias: float
    a: float
    b: float
    bits: int

    def margin(self, text: bytes) -> float:
        idx, val = features(text, self.bits)
        return float(self.weights[idx] @ val + self.bias)

    def probability(self, text: bytes) -> float:
        return _sigmoid(self.a * self.margin(text) + self.b)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Sample:
    """The features of labelled rows one behind another: of row k those from ends[k - 1] to ends[k].  at points into
    `used`, the places that any row has.  low: whether a row is of low quality."""

    ends: np.ndarray
    at: np.ndarray
    val: np.ndarray
    used: np.ndarray
    low: np.ndarray
    size: int

    def blocks(self, rows: int = 128) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Of `rows` rows each: these rows, their features, and each feature's row among them.  What a round of
        the fit makes anew is as large as a block."""
        begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        for lo in range(0, len(self.ends), rows):
            of = slice(lo, min(lo + rows, len(self.ends)))
            yield of, slice(begins[lo], self.ends[of][-1]), np.repeat(np.arange(of.stop - lo), self.ends[of] - begins[of])


def gathered(texts: Iterable[tuple[bytes, int]], bits: int) -> Sample:
    """The features of (text, low), made as the texts come, which are let go one by one."""
    idx, val, ends, low, n = [], [], [], [], 0
    for text, flag in texts:
        places, shares = features(text, bits)
        idx.append(places.astype(np.int32))
        val.append(shares.astype(np.float32))
        n += len(places)
        ends.append(n)
        low.append(flag)
    whole = np.concatenate(idx) if idx else np.zeros(0, np.int32)
    used = np.flatnonzero(np.bincount(whole, minlength=3 << bits))
    number = np.zeros(3 << bits, dtype=np.int32)
    number[used] = np.arange(len(used))
    return Sample(np.array(ends, dtype=np.int64), number[whole], np.concatenate(val) if val else np.zeros(0, np.float32), used, np.array(low, dtype=np.float64), 3 << bits)


def _margins(s: Sample, w: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(s.low), bias)
    for of, own, who in s.blocks():
        out[of] += np.bincount(who, weights=w[s.at[own]] * s.val[own], minlength=of.stop - of.start)
    return out


def _descend(s: Sample, part: np.ndarray, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression on the rows of `part` by full gradients with Nesterov momentum; classes weigh alike."""
    share = np.zeros(len(s.low))
    for flag in (0, 1):
        own = part & (s.low == flag)
        share[own] = 0.5 / max(1, own.sum())
    w = v = np.zeros(len(s.used))
    bias = vb = 0.0
    step = 1.0 / (0.25 * 4.0 + l2)  # |x|**2 is at most 3, and 1 for the bias
    for k in range(1, rounds + 1):
        m = (k - 1) / (k + 2)
        u, ub = w + m * v, bias + m * vb
        slope, total = l2 * u, 0.0
        for of, own, who in s.blocks():
            z = np.bincount(who, weights=u[s.at[own]] * s.val[own], minlength=of.stop - of.start)
            error = share[of] * (_sigmoid(z + ub) - s.low[of])
            slope += np.bincount(s.at[own], weights=error[who] * s.val[own], minlength=len(u))
            total += error.sum()
        new, newb = u - step * slope, ub - step * total
        v, vb, w, bias = new - w, newb - bias, new, newb
    return w, bias


def fit(s: Sample, bits: int = 16, l2: float = 3e-4, rounds: int = 100, folds: int = 4) -> Model | None:
    """None if the rows don't hold both classes.  Every `folds`-th row is held out from a first fit; a line through
    its margins there (Platt's) calibrates the fit to all rows."""
    held = np.arange(len(s.low)) % folds == folds - 1
    if any(len(set(s.low[part])) < 2 for part in (held, ~held)):
        return None
    z = _margins(s, *_descend(s, ~held, l2, rounds))[held]
    t = s.low[held]
    pos, neg = t.sum(), len(t) - t.sum()
    goal = np.where(t == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton, with a little damping
        p = _sigmoid(a * z + b)
        g = np.array([((p - goal) * z).sum(), (p - goal).sum()])
        curve = p * (1 - p) + 1e-9
        h = np.array([[(curve * z * z).sum() + 1e-6, (curve * z).sum()], [(curve * z).sum(), curve.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        d *= min(1, 5 / max(1e-12, np.abs(d).max()))
        a, b = a - d[0], b - d[1]
    w, bias = _descend(s, np.ones(len(s.low), bool), l2, rounds)
    weights = np.zeros(s.size, dtype=np.float32)
    weights[s.used] = w
    return Model(weights, bias, float(a), float(b), bits)


def training_texts(docs: DataFrame, labels: DataFrame, rows: int, most_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(k, text, low): labelled documents in an order drawn by a hash of the id, and their low-quality flags: at most
    `rows`, and as many of these as have `most_bytes` of text together; texts of over a 64th of that are left out."""
    known = labels.select(F.col(id_col).alias("id"), (1 - F.col(label_col)).cast("int").alias("low")).where("id is not null and low in (0, 1)")
    known = known.groupBy("id").agg(F.min("low").alias("low"), F.max("low").alias("high")).where("low = high").drop("high")
    drawn = F.xxhash64("id", F.lit(11))
    picked = known.orderBy(drawn, "id").limit(rows)  # ids and flags: small enough for one task and a broadcast
    picked = picked.withColumn("k", F.row_number().over(Window.orderBy(drawn, "id")))
    joined = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    once = joined.groupBy("k").agg(F.min("text").alias("text"), F.min("low").alias("low"))  # repeated ids count once
    sample = materialize(once.withColumn("bytes", F.octet_length("text")).where(F.col("bytes") <= most_bytes // 64), "quality-sample")
    last, total = 0, 0
    for r in sample.select("k", "bytes").orderBy("k").collect():
        total += r.bytes
        if total > most_bytes:
            break
        last = r.k
    return sample.where(F.col("k") <= last).select("k", "text", "low")


def training_rows(texts: DataFrame, bits: int = 16) -> Sample:
    """The features and flags of training_texts, in their order.  The texts come to the driver a partition at a time,
    and their bytes are bounded; features take some ten times as many."""
    return gathered(((r.text.encode(), r.low) for r in texts.orderBy("k").toLocalIterator()), bits)


def score(docs: DataFrame, model: Model | None, threshold: float, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """The rules' counts and verdicts for every row.  keep: docs' own rows, only those kept."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, low_probability double, kept boolean"

    def judge(texts: list[bytes | None]) -> dict[str, list]:
        m = shared.value
        got = [counts(t or b"") for t in texts]
        failed = [base_failed(c[0], c[4]) for c in got]
        low = [None if m is None else m.probability(t or b"") for t in texts]
        kept = [not f and (p is None or p < threshold) for f, p in zip(failed, low, strict=True)]
        return dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), map(list, zip(*got, strict=True)) if got else [[]] * 5, strict=True)) | {"base_failed": failed, "low_probability": low, "kept": kept}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            j = judge(b.column(1).cast(pa.binary()).to_pylist())
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip(j.values(), kinds, strict=True))], names=["id", *j])

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, at):
            j = judge(b.column(at).cast(pa.binary()).to_pylist())
            yield b.filter(pa.array(j["kept"], pa.bool_()))

    if keep:
        at = docs.columns.index(text_col)
        return docs.mapInArrow(filtered, docs.schema)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(rows, f"id {src.schema['id'].dataType.simpleString()}, {fields}")


def quality_rules(docs: DataFrame, labels: DataFrame, rows: int = 2400, threshold: float = 0.7, keep: bool = False, most_bytes: int = 8 << 20) -> DataFrame:
    """Counts, classifier probability and verdict for every row of `docs`, or with `keep` the rows
    that stay, as they are.

    `rows` and `most_bytes` (of text) bound the labelled sample that the classifier is fitted on.  Null texts count as empty
    and fail for want of words.  Labels that are null, contradict each other or lack a document are
    passed over, repeated ones count once, and of an id's documents the least text counts; if the labelled rows don't hold both classes there is no classifier (low_probability is
    null) and the countable rules decide alone.  Repeated rows and extra columns stay as they are."""
    model = fit(training_rows(training_texts(docs, labels, rows, most_bytes)))
    return score(docs, model, threshold, keep=keep)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return quality_rules(read("documents"), read("labels")).withColumnRenamed("id", "doc_id")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=True)
