"""Token counts of unindexed token files by a separator scan.

A file is a flat run of ids, documents ending in an end-of-document id, held in blocks that are cut
anywhere.  Each block is searched on its own, all separators at once; documents inside a block are
done there.  What a block leaves is three numbers: its length, and its first and last separator.  A
prefix scan over those gives, for the first document that ends in a block, where it began.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, scratch
from .tokens import library_encoder

#: Blocks of a file that one step of the two-level scan takes together.
_STRIDE = 4096
#: A reader takes a row group's blocks at a time, so groups are kept small whatever the size of a file.
_GROUP_BYTES = 4 << 20


def write_flat(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 15) -> None:
    """Writes a flat file of u16 ids for each partition of `docs`, in blocks of exactly `block_ids` ids
    but the last; and beside the ids, for those who want to name the documents, their ids in the
    file's order.  Table: file, block, data | file, named (first document's number), ids.

    A null or empty text is a document of its end id alone; repeated rows and ids (null ones too) are
    documents of their own; other columns, whatever their names, are ignored; no rows give no files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer)
        file, block, named, held, n = TaskContext.get().partitionId(), 0, 0, [], 0
        end = np.array([end_id], dtype=np.uint16)

        def row(data=None, ids=None) -> pa.RecordBatch:
            columns = [pa.array([file], pa.int32()), pa.array([None if data is None else block], pa.int64()), pa.array([data], pa.binary()), pa.array([None if ids is None else named], pa.int64()), pa.array([ids], pa.list_(kind))]
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "data", "named", "ids"])

        for b in batches:
            kind = b.column(0).type
            yield row(ids=b.column(0).to_pylist())
            named += b.num_rows
            for text_ids in encode.batch(b.column(1)):
                held += [text_ids, end]
                n += len(text_ids) + 1
                if n >= block_ids:
                    flat = np.concatenate(held)
                    for lo in range(0, n - block_ids + 1, block_ids):
                        yield row(flat[lo : lo + block_ids].tobytes())
                        block += 1
                    held = [flat[n - n % block_ids :]]
                    n %= block_ids
        if n:
            yield row(np.concatenate(held).tobytes())

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    flat = src.mapInArrow(run, f"file int, block long, data binary, named long, ids array<{kind}>")
    flat.write.option("parquet.block.size", _GROUP_BYTES).option("parquet.enable.dictionary", "false").parquet(path)


def count_documents(blocks: DataFrame, end_id: int, item_bytes: int = 2) -> DataFrame:
    """(file, doc_no, n_tokens, complete) of every document of blocks(file, block, data).

    doc_no counts a file's documents from 0; n_tokens leaves out the separator.  Ids behind a file's
    last separator are one more document that is not complete.  Null and empty blocks hold nothing;
    blocks may differ in length; a file without a separator is one incomplete document; no blocks
    give no rows.  Repeated block numbers are an error of the input and give no defined result."""
    kind = {2: "<u2", 4: "<u4"}[item_bytes]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = np.frombuffer(b.column(2)[k].as_py() or b"", dtype=kind)
                at = np.flatnonzero(ids == end_id)
                names = ["file", "block", "size", "ends", "first_end", "last_end", "inner"]
                some = len(at) > 0
                values = [len(ids), len(at), int(at[0]) if some else None, int(at[-1]) if some else None]
                inner = pa.array([(np.diff(at) - 1).tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(1).slice(k, 1), *(pa.array([v], pa.int64()) for v in values), inner], names=names)

    file_kind = blocks.schema["file"].dataType.simpleString()
    marks = blocks.select("file", F.col("block").cast("long").alias("block"), "data").mapInArrow(scan, f"file {file_kind}, block long, size long, ends long, first_end long, last_end long, inner array<long>")
    marks = materialize(marks, "separators")
    # the scan, in two levels: over the strides of a file, then over the blocks of a stride
    heads = marks.select("file", "block", "size", "ends", "first_end", "last_end").withColumn("stride", F.floor(F.col("block") / _STRIDE))
    by_stride = Window.partitionBy("file", "stride").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = heads.withColumns({"size0": F.coalesce(F.sum("size").over(by_stride), F.lit(0)), "ends0": F.coalesce(F.sum("ends").over(by_stride), F.lit(0))})
    local = local.withColumn("end0", F.max(F.col("size0") + F.col("last_end")).over(by_stride))
    strides = local.groupBy("file", "stride").agg(F.sum("size").alias("size"), F.sum("ends").alias("ends"), F.max(F.col("size0") + F.col("last_end")).alias("last_end"))
    over = Window.partitionBy("file").orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)
    strides = strides.withColumns({"size1": F.coalesce(F.sum("size").over(over), F.lit(0)), "ends1": F.coalesce(F.sum("ends").over(over), F.lit(0))})
    strides = strides.withColumn("end1", F.max(F.col("size1") + F.col("last_end")).over(over))
    scanned = local.join(strides.select("file", "stride", "size1", "ends1", "end1"), ["file", "stride"])
    begin = F.col("size0") + F.col("size1")
    before = F.coalesce(F.col("size1") + F.col("end0"), F.col("end1"), F.lit(-1))  # the last separator before the block
    scanned = scanned.select("file", "block", (F.col("ends0") + F.col("ends1")).alias("doc_no"), (begin + F.col("first_end") - before - 1).alias("n_tokens"), (begin + F.col("size")).alias("total"), F.coalesce(begin + F.col("last_end"), before).alias("last_end"), "ends")
    stitched = scanned.where("ends > 0").select("file", "doc_no", "n_tokens", F.lit(True).alias("complete"))
    # documents inside a block follow its stitched one
    inner = marks.where("ends > 1").select("file", "block", F.posexplode("inner").alias("k", "n_tokens"))
    inner = inner.join(scanned.select("file", "block", "doc_no"), ["file", "block"])
    inner = inner.select("file", (F.col("doc_no") + F.col("k") + 1).alias("doc_no"), "n_tokens", F.lit(True).alias("complete"))
    rest = scanned.groupBy("file").agg(F.max("total").alias("total"), F.max("last_end").alias("last_end"), F.max(F.col("doc_no") + F.col("ends")).alias("doc_no"))
    rest = rest.where("total > last_end + 1").select("file", "doc_no", (F.col("total") - F.col("last_end") - 1).alias("n_tokens"), F.lit(False).alias("complete"))
    return stitched.unionByName(inner).unionByName(rest)


def named_counts(spark, path: str, end_id: int) -> DataFrame:
    """(id, file, doc_no, n_tokens, complete) of every document of a table of write_flat."""
    table = spark.read.parquet(path)
    counts = count_documents(table.where("block is not null").select("file", "block", "data"), end_id)
    names = table.where("named is not null").select("file", "named", F.posexplode("ids").alias("k", "id"))
    names = names.select("file", (F.col("named") + F.col("k")).alias("doc_no"), "id")
    return names.join(counts, ["file", "doc_no"]).select("id", "file", "doc_no", "n_tokens", "complete")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Writes every document to flat token files, counts them by their separators, and names them."""
    import public_tokenizers

    end_id = 50256
    path = scratch(spark, "flat")
    write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id)
    return named_counts(spark, path, end_id).select(F.col("id").alias("doc_id"), "n_tokens", "complete", F.col("file").alias("file_no"), "doc_no")
