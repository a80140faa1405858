"""Token files compressed by Re-Pair grammars.

Documents are encoded in ascending order of their ids and written as shards.  A shard's ids are
shortened by repeatedly replacing frequent pairs of neighbouring symbols by new ones (Re-Pair, many
pairs a round); no new symbol reaches beyond a document.  A shard stores its rules, the length of
every rule's expansion and the first symbol of every document, so any document, and any id of it, is
decoded without the others.

File format, little-endian: magic "RPG1"; u32 documents, rules, symbols, first rule symbol; rules as
u16 pairs (in order, each of earlier symbols only); u32 expansion lengths of the rules; u32 first
symbol of each document and the end; u32 ids of each document; u16 symbols.  A file is the `data`
column of one row of a Parquet table, since executors reach the shared store through Spark alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch
from .tokens import library_encoder

MAGIC = b"RPG1"
_HASH = np.uint32(0x9E3779B1)
_BUCKETS = 18
#: So many symbols are looked up at a time: what is made of them stays in the processor's cache.
_STEP = 1 << 15
#: Stands for any two symbols of different documents.
_CROSS = np.uint32(0xFFFFFFFF)
#: Documents are expanded together in runs of about so many symbols.
_RUN = 1 << 16


def grammar(ids: np.ndarray, ends: np.ndarray, first: int, rounds: int = 6, least: int = 8, top: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, symbol_ends) of u16 ids below `first`; ends: of each document in ids.  A pair is
    replaced if it stands `least` times, two or more; symbols stay below `top`."""
    s, ends = ids.astype(np.uint16), ends.astype(np.int64)
    rules: list[np.ndarray] = []
    made = 0
    for turn in range(rounds):
        room = top - first - made
        if len(s) < 2 * least or room <= 0:
            break
        pair = s[:-1].astype(np.uint32)
        pair <<= np.uint32(16)
        pair |= s[1:]
        # what crosses the end of a document counts as one pair, which is never replaced
        cross = ends[(ends > 0) & (ends < len(s))] - 1
        pair[cross] = _CROSS
        # sorted, a pair's places lie side by side: where a pair is the same `least` - 1 places on, it stands often enough
        runs = np.sort(pair)
        same = np.zeros(len(runs) - least + 3, dtype=bool)
        same[1:-1] = runs[least - 1 :] == runs[: len(runs) - least + 1]
        edges = np.flatnonzero(same[1:] != same[:-1])
        often, n = runs[edges[::2]], edges[1::2] - edges[::2] + least - 1
        often, n = often[often != _CROSS], n[often != _CROSS]
        # a round takes the most frequent part of its pairs: their uses change the counts of the others
        chosen = np.sort(often[np.argsort(-n, kind="stable")[: min(room, max(64, len(often) // 2))]])
        if not len(chosen):
            break
        # pairs are looked up in buckets; of two pairs of a bucket one waits for the next round, which has another multiplier
        multiplier = _HASH + np.uint32(2 * turn)
        bucket = (chosen * multiplier) >> np.uint32(32 - _BUCKETS)
        rule = np.zeros(1 << _BUCKETS, dtype=np.uint16)
        rule[bucket] = np.arange(len(chosen))
        alone = rule[bucket] == np.arange(len(chosen))
        chosen, bucket = chosen[alone], bucket[alone]
        rule[:] = 0
        rule[bucket] = np.arange(1, len(chosen) + 1)
        keep, gone = np.ones(len(s), dtype=bool), []
        for lo in range(0, len(pair), _STEP):
            own = pair[lo : lo + _STEP]
            found = rule[(own * multiplier) >> np.uint32(32 - _BUCKETS)]
            at = np.flatnonzero(found)
            which = found[at] - np.uint16(1)
            hit = chosen[which] == own[at]
            hit[: int(len(at) > 0 and at[0] == 0 and not keep[lo])] = False  # its first symbol is used already
            at, which = at[hit], which[hit]
            # in a run of overlapping pairs every other one is taken, from the left
            near = np.flatnonzero(at[1:] - at[:-1] == 1) + 1
            count = np.arange(len(near))
            step = count - np.maximum.accumulate(np.where(np.diff(near, prepend=-1) > 1, count, 0))
            take = np.ones(len(at), dtype=bool)
            take[near[step % 2 == 0]] = False
            at = at[take] + lo
            s[at] = which[take] + np.uint16(first + made)
            gone.append(at + 1)
            keep[gone[-1]] = False
        s = s[keep]
        ends = ends - np.searchsorted(np.concatenate(gone), ends)
        rules.append(np.stack([chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)], axis=1).astype(np.uint16))
        made += len(chosen)
        if len(keep) - len(s) < len(s) // 200:
            break
    return s, np.concatenate([np.zeros((0, 2), np.uint16), *rules]), ends


def pack(docs: list[np.ndarray], first: int) -> bytes:
    """A file of the documents' ids, each below `first`."""
    counts = np.array([len(d) for d in docs], dtype=np.uint32)
    ids = np.concatenate([np.zeros(0, np.uint16), *docs])
    symbols, rules, ends = grammar(ids, np.cumsum(counts, dtype=np.int64), first)
    lengths = [1] * first
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    head = np.array([len(docs), len(rules), len(symbols), first], dtype="<u4")
    starts = np.concatenate([[0], ends]).astype("<u4")
    return b"".join([MAGIC, head.tobytes(), rules.astype("<u2").tobytes(), np.array(lengths[first:], dtype="<u4").tobytes(), starts.tobytes(), counts.astype("<u4").tobytes(), symbols.astype("<u2").tobytes()])


class Shard:
    """A file, opened."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        docs, rules, symbols, self.first = (int(x) for x in np.frombuffer(data, "<u4", 4, 4))
        at = 20
        self.rules = np.frombuffer(data, "<u2", 2 * rules, at).reshape(-1, 2)
        at += 4 * rules
        self.lengths = np.concatenate([np.ones(self.first, np.int64), np.frombuffer(data, "<u4", rules, at)])
        at += 4 * rules
        self.starts = np.frombuffer(data, "<u4", docs + 1, at).astype(np.int64)
        at += 4 * (docs + 1)
        self.counts = np.frombuffer(data, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        self.symbols = np.frombuffer(data, "<u2", symbols, at)
        self._flat = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules' expansions behind the plain ids, and where each symbol's starts."""
        if self._flat is None:
            offsets = np.concatenate([[0], np.cumsum(self.lengths)])
            flat = np.zeros(offsets[-1], dtype=np.uint16)
            flat[: self.first] = np.arange(self.first)
            self._flat = flat, offsets[:-1]
            # rules that only use symbols from before the first of them are expanded at once
            top, at = self.rules.max(axis=1, initial=0), 0
            while at < len(top):
                late = top[at:] >= self.first + at
                to = at + int(np.argmax(late)) if late.any() else len(top)
                flat[offsets[self.first + at] : offsets[self.first + to]] = self.expand(self.rules[at:to].ravel())
                at = to
        return self._flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, offsets = self._expansions()
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        return flat[np.repeat(offsets[symbols] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.starts[k] : self.starts[k + 1]])

    def token(self, k: int, j: int) -> int:
        """Id j of document k, by the expansion lengths alone."""
        own = self.symbols[self.starts[k] : self.starts[k + 1]]
        ends = np.cumsum(self.lengths[own])
        at = int(np.searchsorted(ends, j, side="right"))
        symbol, j = int(own[at]), j - int(ends[at] - self.lengths[own[at]])
        while symbol >= self.first:
            a, b = (int(x) for x in self.rules[symbol - self.first])
            if j < self.lengths[a]:
                symbol = a
            else:
                symbol, j = b, j - int(self.lengths[a])
        return symbol

    def all(self) -> list[np.ndarray]:
        docs, lo = [], 0
        while lo < len(self.counts):
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + _RUN, side="right")) - 1)
            ids = self.expand(self.symbols[self.starts[lo] : self.starts[hi]])
            docs += np.split(ids, np.cumsum(self.counts[lo:hi])[:-1])
            lo = hi
        return docs


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 20, added: bool = False) -> None:
    """Encodes the documents in ascending order of their ids (null first), each followed by `end_id`,
    and writes files of about `shard_ids` ids: a Parquet table (part, seq, ids of documents, n_ids,
    data), in the order of part and seq.

    Rows that repeat an id follow each other by a hash of their text, then by the text, so the files
    don't depend on how the rows came; a group of one id may go to several tasks, cut between hashes.
    A null text counts as an empty one; no rows give no files; other columns, whatever their names, are
    ignored.  added: as for library_encoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer, added)
        first = encode.size
        part, seq = TaskContext.get().partitionId(), 0
        ids, held, n = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, n
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(kind)), pa.array([n], pa.int64()), pa.array([pack(held, first)], pa.binary())]
            seq, n = seq + 1, 0
            ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "ids", "n_ids", "data"])

        end = np.array([end_id], dtype=np.uint16)
        for b in batches:
            kind = b.column(0).type
            for own, text_ids in zip(b.column(0).to_pylist(), encode.batch(b.column(1)), strict=True):
                ids.append(own)
                held.append(np.concatenate([text_ids, end]))
                n += len(held[-1])
                if n >= shard_ids:
                    yield flush()
        if ids:
            yield flush()

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    ordered = src.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, f"part int, seq int, ids array<{kind}>, n_ids long, data binary").write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document of a table of files, in no set order: the ids
    of all documents before it, its own ids, and the CRC-32 of those as little-endian u32."""
    files = spark.read.parquet(path)
    kind = files.schema["ids"].dataType.elementType.simpleString()
    # starts of files: a running sum in each part, and one over the parts, of which there is one a task
    heads = files.select("part", "seq", "n_ids")
    sums, at = [], 0
    for r in heads.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        sums.append((r.part, at))
        at += r.n
    parts = spark.createDataFrame(sums, "part int, base long")
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = heads.withColumn("before", before).join(F.broadcast(parts), "part").select("part", "seq", (F.col("before") + F.col("base")).alias("file_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                docs = Shard(b.column(3)[k].as_py()).all()
                n = np.array([len(d) for d in docs], dtype=np.int64)
                crc = [zlib.crc32(d.astype("<u4")) for d in docs]
                same = lambda c: pa.array([b.column(c)[k].as_py()] * len(docs), pa.int32())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(0), same(1), b.column(2)[k].values, pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], names=["part", "seq", "id", "offset", "n_tokens", "ids_crc32"])

    rows = files.select("part", "seq", "ids", "data").mapInArrow(run, f"part int, seq int, id {kind}, offset long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("id", (F.col("file_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document written to token files and read back; added tokens in a text are those tokens."""
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), added=True)
    return read_tokens(spark, path).withColumnRenamed("id", "doc_id")
