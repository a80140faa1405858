"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors of a label lexicographically by concatenated random hashes (the signs
of its own random projections, less the mean of all vectors) and compares each vector with a bounded
window of neighbours in that order.  That is done first with the hashes alone, some 40 bytes a vector
and pass; only vectors with a neighbour that may link are ordered as such.  Pairs verified in double
precision are united across all passes.  Within a range of a pass only the edges of a spanning forest
are handed on, never all pairs.

The windows bound the comparisons of a pass, so an exact step handles the rest: every two vectors of
one united component are compared in blocks, and only each vector's number of links leaves a block.
Exact copies are folded first and count by their number.  A link can be missed only if no pass, for
no chain of links between the two, puts neighbours within a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

#: Of the random projections.
_SEED = 20_011


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, of any finite rows but zero: powers of two bring the largest component near 1 first, so
    that no square vanishes or overflows and nothing is rounded twice."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column: pd.Series) -> np.ndarray:
    return _units(np.array(column.to_list(), dtype=np.float64))


class _Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def prepared(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, vec, node): vec in its own precision and node, its hash, are null where a row can
    link with nothing: null, empty and zero vectors, null or non-finite components, a null label."""
    v = F.col("vec")
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    good = F.col("label").isNotNull() & F.coalesce(finite & some, F.lit(False))
    rows = rows.withColumn("vec", F.when(good, F.transform(v, lambda x: x + F.lit(0.0).cast(kind))))  # -0.0 becomes 0.0
    return rows.withColumn("node", F.when(v.isNotNull(), F.xxhash64("label", "vec")))


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of a batch by the length of vec, with the unit vectors in double precision."""
    dims = np.diff(b.column("vec").offsets.to_numpy())
    for dim in np.unique(dims).tolist():
        part = b.filter(pa.array(dims == dim))
        x = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        yield dim, part, _units(x)


def middles(distinct: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the unit vectors by their length, over all rows: one row a task and length, then as
    many numbers as a vector has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for b in batches:
            for dim, part, x in _by_dim(b):
                sums[dim] = sums.get(dim, 0) + x.sum(axis=0)
                n[dim] = n.get(dim, 0) + part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([sums[d].tolist() for d in n], pa.list_(pa.float64()))], names=["dim", "n", "total"])

    part = distinct.select("vec").mapInArrow(run, "dim int, n long, total array<double>")
    mean = part.select("dim", "n", F.posexplode("total").alias("k", "x")).groupBy("dim", "k").agg((F.sum("x") / F.sum("n")).alias("x"))
    return {r.dim: np.array([c.x for c in sorted(r.x)]) for r in mean.groupBy("dim").agg(F.collect_list(F.struct("k", "x")).alias("x")).collect()}


def _keys(x: np.ndarray, middle: np.ndarray, dim: int, p: int, hash_bits: int) -> np.ndarray:
    """The signs of pass p's random projections of vectors, less what all have in common."""
    planes = np.random.default_rng([_SEED, dim, p]).standard_normal((dim, hash_bits))
    return np.packbits((x - middle) @ planes > 0, axis=1)


def with_passes(distinct: DataFrame, passes: int, rows: int) -> DataFrame:
    """Adds `most_passes` of a label and length: `passes` up to `rows` vectors, and beyond in proportion to the cube
    root of their number, as neighbours in a pass grow further apart the more lie between them; 62 at most."""
    size = F.size("vec")
    n = distinct.groupBy("label", size.alias("_dim")).agg(F.count("*").alias("_n"))
    more = F.least(F.lit(62), F.greatest(F.lit(passes), F.ceil(passes * F.pow(F.col("_n") / rows, F.lit(1 / 3))))).cast("int")
    n = n.select(F.col("label").alias("_label"), "_dim", more.alias("most_passes"))
    return distinct.join(n, (F.col("label") == F.col("_label")) & (size == F.col("_dim"))).drop("_label", "_dim")


def near_passes(distinct: DataFrame, middle: dict[int, np.ndarray], threshold: float, window: int, hash_bits: int) -> DataFrame:
    """(node, passes): the passes, as bits, in which a vector has a neighbour in its window that may link.

    Only hashes are sorted, not vectors: of two vectors that link, as many bits differ as their angle
    seen from the middle tells, which the distance of the nearer one from it bounds; four deviations
    more may do so.  hash_bits is a multiple of 64."""
    reach = 2 * (1 - threshold)  # the square of the distance of two unit vectors at the threshold

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part, x in _by_dim(b):
                far = ((x - middle[dim]) ** 2).sum(axis=1)
                share = np.arccos(np.clip(1 - reach / (2 * np.maximum(far, 1e-30)), -1, 1)) / np.pi
                most = np.minimum(hash_bits, hash_bits * share + 4 * np.sqrt(hash_bits * share * (1 - share))).astype(np.int16)
                passes = part.column("most_passes").to_numpy()
                for p in range(passes.max()):
                    at = np.flatnonzero(passes > p)
                    own = part.take(pa.array(at)) if len(at) < len(x) else part
                    keys = pa.array([k.tobytes() for k in _keys(x[at], middle[dim], dim, p, hash_bits)], type=pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, dtype=np.int8)), own.column("label"), pa.array(np.full(len(at), dim, dtype=np.int32)), keys, own.column("node"), pa.array(most[at])], names=["pass", "label", "dim", "key", "node", "most"])

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None  # the last rows of the batch before, so that a window runs on over batches
        for f in frames:
            f = f if tail is None else pd.concat([tail, f], ignore_index=True)
            tail = f.iloc[-window:]
            if len(f) < 2:
                continue
            group = f.groupby(["pass", "label", "dim"], sort=False).ngroup().to_numpy()
            key = np.frombuffer(b"".join(f["key"]), dtype=np.uint64).reshape(len(f), -1).T.copy()
            most, node, some = f["most"].to_numpy(), f["node"].to_numpy(), np.zeros(len(f), dtype=bool)
            for s in range(1, min(window, len(f) - 1) + 1):
                differ = sum(np.bitwise_count(k[:-s] ^ k[s:]) for k in key)
                at = np.flatnonzero(differ <= np.maximum(most[:-s], most[s:]))
                at = at[(group[at] == group[at + s]) & (node[at] != node[at + s])]
                some[at] = some[at + s] = True
            got = f[some]
            yield pd.DataFrame({"node": got["node"].astype("int64"), "passes": np.left_shift(1, got["pass"].astype("int64"))})

    label = distinct.schema["label"].dataType.simpleString()
    keys = distinct.select("label", "node", "vec", "most_passes").mapInArrow(keyed, f"pass byte, label {label}, dim int, key binary, node long, most short")
    ordered = keys.repartitionByRange("pass", "label", "dim", "key").sortWithinPartitions("pass", "label", "dim", "key", "node")
    return ordered.mapInPandas(windows, "node long, passes long").groupBy("node").agg(F.bit_or("passes").alias("passes"))


def pass_edges(distinct: DataFrame, threshold: float, passes: int, window: int, hash_bits: int, rows: int = 50_000) -> DataFrame:
    """(a, b) of node ids: spanning forests of the pairs that the windows of all passes verify.  A pass
    orders and compares the vectors that near_passes leaves in it."""
    middle = middles(distinct)
    near = near_passes(with_passes(distinct, passes, rows), middle, threshold, window, hash_bits)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part, x in _by_dim(b):
                which = part.column("passes").to_numpy()
                for p in range(int(which.max()).bit_length()):
                    at = np.flatnonzero(which >> p & 1)
                    if len(at):
                        keys = pa.array([k.tobytes() for k in _keys(x[at], middle[dim], dim, p, hash_bits)], type=pa.binary())
                        own = part.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, dtype=np.int8)), own.column("label"), keys, own.column("node"), own.column("vec")], names=["pass", "label", "key", "node", "vec"])

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for f in frames:
            if tail is not None:
                f = pd.concat([tail, f], ignore_index=True)
            new = 0 if tail is None else len(tail)
            a, b = [], []
            group = list(zip(f["pass"], f["label"], f["vec"].map(len), strict=True))
            edges = [0, *(k for k in range(1, len(group)) if group[k] != group[k - 1]), len(group)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi - lo < 2:
                    continue
                x, node, forest = _matrix(f["vec"].iloc[lo:hi]), f["node"].to_numpy()[lo:hi], _Forest(hi - lo)
                for s in range(1, min(window, hi - lo - 1) + 1):
                    cos = np.einsum("ij,ij->i", x[:-s], x[s:])
                    for k in np.flatnonzero(cos >= threshold):
                        if lo + k + s >= new and node[k] != node[k + s] and forest.join(int(k), int(k + s)):
                            a.append(node[k])
                            b.append(node[k + s])
            tail = f.iloc[-window:]
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64")

    label, vec = (distinct.schema[c].dataType.simpleString() for c in ("label", "vec"))
    keys = distinct.join(near, "node").select("label", "node", "vec", "passes").mapInArrow(keyed, f"pass byte, label {label}, key binary, node long, vec {vec}")
    ordered = keys.repartitionByRange("pass", "label", F.size("vec"), "key").sortWithinPartitions("pass", "label", F.size("vec"), "key", "node")
    return ordered.mapInPandas(windows, "a long, b long").distinct()


def count_links(members: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """(node, links): of members(component, node, vec, copies) how many other vectors each links with,
    by all pairs of blocks of a component; copies are counted, pairs never leave a block."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = members.join(sizes.select("component", blocks.alias("k")), "component")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "vec", "copies")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, g in f.groupby(f["vec"].map(len)):
            left = g["own"].to_numpy() == g["i"].to_numpy()
            right = g["own"].to_numpy() == g["j"].to_numpy()
            x, node, copies = _matrix(g["vec"]), g["node"].to_numpy(), g["copies"].to_numpy(dtype=np.float64)
            same = g["i"].iloc[0] == g["j"].iloc[0]
            near = x[left] @ x[right].T >= threshold
            out.append((node[left], near @ copies[right]))
            if not same:
                out.append((node[right], near.T @ copies[left]))
        return pd.DataFrame({"node": np.concatenate([o[0] for o in out]), "links": np.concatenate([o[1] for o in out]).astype(np.int64)})

    # by blocks, lest the join's partitioning by component serve for the groups and a large one be one task
    rows = rows.repartition("component", "i", "j")
    return rows.groupBy("component", "i", "j").applyInPandas(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, passes: int = 16, window: int = 64, hash_bits: int = 128, pass_rows: int = 50_000) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of `vectors`.

    Vectors with equal, non-null labels link at a cosine of `threshold` or more, computed in double
    precision, of components of any size.  Labels of over `pass_rows` vectors take more passes than `passes`.
    component_id is the smallest id reachable, the row's own included; kept says that it
    is the row's own.  Null, empty and zero vectors, null or non-finite components and null labels
    link with nothing: n_links 0, a component of their own.  Vectors of different lengths never link.
    Rows that repeat a vector (and label) link with each other.  A null id counts as a vector, has a
    null component_id if nothing in its group has an id, and kept is then null.  Empty in, empty out."""
    rows = materialize(prepared(vectors, id_col, vec_col, label_col), "vectors")
    folded = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec"))
    folded = materialize(folded, "vectors-distinct")
    comp = materialize(connected_components(pass_edges(folded, threshold, passes, window, hash_bits)), "vector-components")
    links = count_links(folded.join(comp, "node").select("component", "node", "vec", "copies"), threshold)
    grouped = folded.drop("vec", "label").join(comp, "node", "left").join(links, "node", "left")
    grouped = grouped.select("node", "first", F.coalesce("component", "node").alias("root"), F.coalesce("links", "copies").alias("near"))
    roots = grouped.groupBy("root").agg(F.min("first").alias("group_id"))
    named = grouped.join(roots, "root").select("node", "group_id", "near")
    alone = rows.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    found = rows.where("node is not null").join(named, "node").select("id", (F.col("near") - 1).alias("n_links"), F.col("group_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("id") == F.col("component_id"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All vectors of `embeddings` at a cosine of 0.98."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumnRenamed("id", "vec_id")


#: All pairs of a label, and the smallest id over paths of links.
OP8_SQL = """
with recursive good as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from good a join good b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  and list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.98),
walk as (select a, b from links union select w.a, l.b from walk w join links l on w.b = l.a),
least_id as (select a, min(b) as m from walk group by a),
deg as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, least(e.vec_id, coalesce(m.m, e.vec_id))::bigint as component_id,
  e.vec_id = least(e.vec_id, coalesce(m.m, e.vec_id)) as kept
from embeddings e left join deg d on d.a = e.vec_id left join least_id m on m.a = e.vec_id"""
