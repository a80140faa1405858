"""Byte-level BPE by prefix dynamic programming.

Of every byte prefix of a string the encoding ends in one unique token.  A token t ends the encoding
of prefix p if t's bytes end p, and t may follow the last token of the prefix before t.  Two tokens
may follow each other if BPE leaves them apart, which their own bytes decide.  So the table of last
tokens is filled from left to right; the encoding is read from it backwards; bytes are appended by
filling on; and after an edit the table is filled anew only until it falls in with the old one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts
from .tokens import UnitEncoder


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PrefixBPE:
    """Encoder over a rank table that holds all 256 bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.follows: dict[int, bool] = {}
        usable = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            made = self._halves(token, rank)
            if made:
                self.parts[rank] = made
                usable[token] = rank
        self.usable = usable
        tails: dict[bytes, set[int]] = {}
        for token in usable:
            tails.setdefault(token[-3:], set()).add(len(token))
        #: By the last three bytes, the lengths of the tokens that may end there, longest first.
        self.lengths = {t: (*sorted(n, reverse=True), *(k for k in (2, 1) if t[-k:] in usable)) for t, n in tails.items() if len(t) == 3}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that merge to this one; twice itself for a byte; None if merges of lower
        rank never leave just two, so that the token only stands for a whole string."""
        if len(token) == 1:
            return rank, rank
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            rest = [(self.ranks.get(parts[k] + parts[k + 1], rank), k) for k in range(len(parts) - 1)]
            low, k = min(rest)
            if low >= rank:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of a and b gives just a and b."""
        key = a << 32 | b
        got = self.follows.get(key)
        if got is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            got = self.follows[key] = self._apart(a, b)
        return got

    def _apart(self, a: int, b: int) -> bool:
        """Takes a and b apart along their seam, the younger merge first: had their facing parts
        merged with each other before, a and b wouldn't have come about."""
        bound, ranks, text, parts = 1 << 62, self.ranks, self.bytes_of, self.parts
        while True:
            if ranks.get(text[a] + text[b], bound) < bound:
                return False
            split_a = a > b and parts[a][0] != a or parts[b][0] == b
            if split_a:
                if parts[a][0] == a:
                    return True
                bound, a = a, parts[a][1]
            else:
                bound, b = b + 1, parts[b][0]

    def fill(self, data: bytes, last: list[int]) -> list[int]:
        """Fills the table on: last[p - 1] ends the encoding of data[:p]."""
        usable, follows, lengths = self.usable, self.follows, self.lengths
        for p in range(len(last) + 1, len(data) + 1):
            for k in lengths.get(data[p - 3 : p] if p > 2 else b"", (2, 1)):
                s = p - k
                if s < 0:
                    continue
                t = usable.get(data[s:p])
                if t is not None:
                    if s:
                        ok = follows.get(last[s - 1] << 32 | t)
                        if ok is None:
                            ok = self.may_follow(last[s - 1], t)
                        if not ok:
                            continue
                    last.append(t)
                    break
        return last

    def read(self, last: list[int]) -> list[int]:
        out, p = [], len(last)
        while p:
            out.append(last[p - 1])
            p -= len(self.bytes_of[last[p - 1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match of the pre-tokenising pattern."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read(self.fill(data, []))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """The table of one string, for appends and edits."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data = bpe, data
        self.last = bpe.fill(data, [])

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.fill(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts `new` in the place of data[start:end]; how many bytes were filled anew.  Behind the
        edit the table holds again once as many entries as the longest token has bytes are as before."""
        old, tail, bpe = self.last, self.last[end:], self.bpe
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        shift, same, p = start + len(new), 0, start
        while p < len(self.data):
            bpe.fill(self.data[: p + 1] if len(self.data) - p > 1 else self.data, self.last)
            p += 1
            if p > shift:
                same = same + 1 if self.last[p - 1] == tail[p - 1 - shift] else 0
                if same >= bpe.longest:
                    self.last += tail[p - shift :]
                    break
        return p - start

    def ids(self) -> list[int]:
        whole = self.bpe.ranks.get(self.data)
        return [whole] if whole is not None else self.bpe.read(self.last)


_loaded: dict[tuple[str, str], tuple[PrefixBPE, UnitEncoder]] = {}


def loaded(path: str, pattern: str) -> tuple[PrefixBPE, UnitEncoder]:
    """A worker's encoder; its caches of pieces are bounded."""
    if (path, pattern) not in _loaded:
        bpe = PrefixBPE(read_ranks(path))
        if max(bpe.bytes_of) >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        _loaded[path, pattern] = bpe, UnitEncoder(lambda piece: bpe.encode(piece.encode()), pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text; null and empty texts have no ids.  The vocabulary must
    have at most 65,536 ids, in which they are kept; a larger one is refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encode = loaded(path, pattern)
        for part in parts(batches, 1):
            ids = [x.astype(np.int32) for x in encode.batch(part.column(1))]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))], names=["id", "ids"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(id, data binary) of (id, ids).  Null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {r: t for t, r in read_ranks(path).items()}
        for b in batches:
            data = [b"".join(map(bytes_of.__getitem__, ids or ())) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["id", "data"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, data binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text: the ids as decimals joined by
    commas, and the bytes the ids decode to.  Null and empty texts: no ids, the digest of nothing.
    Ids, repeated rows and other columns of any kind are carried or left as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encode = loaded(path, pattern)
        size = max(bpe.bytes_of) + 1
        decimal = [str(k) for k in range(size)]
        text = [bpe.bytes_of.get(k, b"") for k in range(size)]
        for b in parts(batches, 1):
            n, written, decoded = [], [], []
            for found in encode.batch(b.column(1)):
                ids = found.tolist()
                n.append(len(ids))
                written.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(text.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(written), pa.array(decoded)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _digest_rows(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's ids and their decoding, as digests."""
    return _digest_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of a pipeline: the digests of its documents."""
    return _digest_rows(docs)
