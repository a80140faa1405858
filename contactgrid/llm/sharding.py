"""Shards by sampled splitters, in DataFrame operations only.

Records are ordered by a 64-bit hash of their text, so equal texts lie side by side.  Keys are
sampled in proportion to their records' sizes; quantiles of the sample are the boundaries of a fixed
number of ranges.  What makes a range overfull is a text with very many copies: such a text leaves its
range and is subdivided by record, all others stay whole.  Ranges and pieces then go to the shards by
exact sizes, the largest first to the shard that is emptiest.

Within a range slots are counted in parts, to which records are dealt by a hash of id and text; only copies that
share their id as well stay in one part.

The driver sees the sample and the ranges, whose numbers are parameters whatever the input.  Slots are
counted in parts of bounded bytes and rows, of which a large input has more, so no task holds a range.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

_CELL_BITS = 12


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, text_crc32, key, salt), without the texts.  A null text has the key and checksum of
    an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), record_size(F.col(text_col)).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(17), F.col(id_col), text).alias("salt"))


def sampled_keys(records: DataFrame, draws: int, total: int, rows: int) -> list[tuple[int, float, float]]:
    """(key, bytes, rows), ascending, as estimated from a sample of at most about 2 * draws records.

    A record is drawn with the probability draws * max(size / total, 1 / rows), or surely, so a text
    with many bytes or many copies is never missed."""
    chance = F.least(F.lit(1.0), F.greatest(F.col("size") / max(1, total), F.lit(1 / max(1, rows))) * draws)
    drawn = F.pmod(F.xxhash64("salt", F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    sample = records.where(drawn < chance).select("key", (F.col("size") / chance).alias("bytes"), (1 / chance).alias("n"))
    return sorted(map(tuple, sample.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()))


def splitters(sample: list[tuple[int, float]], ranges: int) -> list[int]:
    """At most ranges - 1 ascending keys that cut the sampled (key, bytes) into ranges of near equal size."""
    whole, seen, out = sum(w for _, w in sample), 0.0, []
    for key, weight in sample:
        if len(out) < ranges - 1 and seen >= whole * (len(out) + 1) / ranges and seen:
            out.append(key)
        seen += weight
    return out


def in_ranges(records: DataFrame, splitters: list[int]) -> DataFrame:
    """Adds range_id by a broadcast table of the splitters, at most a row for each range and cell of
    the key space; each record meets only the ranges of its cell."""
    spark = records.sparkSession
    cells, lo, top = [], -(1 << 63), (1 << 63) - 1
    for k, hi in enumerate([*(s - 1 for s in splitters), top]):
        cells += [(c, k, lo, hi) for c in range(lo >> (64 - _CELL_BITS), (hi >> (64 - _CELL_BITS)) + 1)]
        lo = hi + 1
    bounds = spark.createDataFrame(cells, "cell int, range_id int, low long, high long")
    cell = F.shiftright(F.col("key"), 64 - _CELL_BITS).cast("int")
    near = (F.col("own_cell") == F.col("cell")) & F.col("key").between(F.col("low"), F.col("high"))
    return records.withColumn("own_cell", cell).join(F.broadcast(bounds), near).drop("own_cell", "cell", "low", "high")


def dealt(loads: list[tuple[tuple, int]], shards: int) -> dict[tuple, int]:
    """The shard of each range: largest range first, to the shard with the fewest bytes."""
    heap, out = [(0, s) for s in range(shards)], {}
    for name, load in sorted(loads, key=lambda x: (-x[1], x[0])):
        used, s = heapq.heappop(heap)
        out[name] = s
        heapq.heappush(heap, (used + load, s))
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 64, draws_per_range: int = 24, split_share: float = 1 / 8, part_bytes: int = 64 << 20, part_rows: int = 1 << 20) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of `docs`: shards of near
    equal bytes, slots gapless from 0 in each shard.

    There are shards * ranges_per_shard ranges.  Equal texts share a shard, unless they hold over
    `split_share` of a shard's share of the bytes or the rows; then they alone are dealt by id.  Slots are
    counted in parts of about `part_bytes` and `part_rows`.  Null texts count as empty ones of size 1;
    rows that repeat an id and a text are told apart by their slot; an empty table gives an empty table.
    Other columns are ignored here; `with_texts` joins them."""
    spark = docs.sparkSession
    records = materialize(keyed(docs, id_col, text_col), "shard-keys")
    total, rows = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = shards * ranges_per_shard
    most = [split_share * x / shards for x in (total, rows)]
    sample = sampled_keys(records, draws_per_range * ranges, total, rows)
    # texts that may be too many copies, at most 4 * shards / split_share of them; their exact sums decide
    hot = {key for key, *of in sample if any(2 * x > top for x, top in zip(of, most, strict=True))}
    placed = in_ranges(records, splitters([(key, size) for key, size, _ in sample if key not in hot], ranges))
    placed = placed.withColumn("hot", F.when(F.col("key").isin(*hot), F.col("key")) if hot else F.lit(None).cast("long"))
    units = placed.groupBy("range_id", "hot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    plan = []
    for u in units:
        split = u.hot is not None and (u.bytes > most[0] or u.n > most[1])
        pieces = math.ceil(max(u.bytes / total, u.n / rows) * ranges) if split else 1
        plan.append((u.range_id, u.hot, split, pieces, math.ceil(max(u.bytes / part_bytes, u.n / part_rows) / pieces)))
    own = ["range_id", "hot", "piece"]
    same = lambda a, b: (a["range_id"] == b["range_id"]) & a["hot"].eqNullSafe(b["hot"])
    plans = F.broadcast(spark.createDataFrame(plan, "range_id int, hot long, split boolean, pieces int, parts int"))
    cut = placed.join(plans, same(placed, plans)).drop(plans["range_id"]).drop(plans["hot"])
    # parts go by the record, so that a text that is no hot one is cut as well where it has many copies
    cut = cut.withColumns({"piece": F.pmod("salt", F.col("pieces")).cast("int"), "part": F.pmod(F.xxhash64("salt", F.lit(5)), F.col("parts")).cast("int")}).drop("split", "pieces", "parts")
    sums = cut.groupBy(*own).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    name = lambda r: (r.range_id, r.hot is not None, r.hot or 0, r.piece)
    shard_of = dealt([(name(r), r.bytes) for r in sums], shards)
    filled, found = [0] * shards, []
    for r in sorted(sums, key=name):
        s = shard_of[name(r)]
        found.append((r.range_id, r.hot, r.piece, s, filled[s]))
        filled[s] += r.n
    places = F.broadcast(spark.createDataFrame(found, "range_id int, hot long, piece int, shard int, base long"))
    placed = cut.join(places, same(cut, places) & (cut["piece"] == places["piece"])).select(*(cut[c] for c in cut.columns), "shard", "base")
    # slots: parts before one's own, then the place in it; both by the same exchange
    group = ["shard", "base", "part"]
    parts = placed.groupBy(*group).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard", "base").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("key", "id", "text_crc32", "size"))
    slotted = placed.withColumn("rank", rank).join(parts.withColumn("before", before).drop("n"), group)
    slot = F.col("base") + F.col("before") + F.col("rank") - 1
    return slotted.select("id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def with_texts(docs: DataFrame, shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` with shard and slot, for unique ids."""
    return docs.join(shards.select(F.col("id").alias(id_col), "shard", "slot"), id_col)


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 100_000) -> None:
    """Writes one folder a shard, its files in the order of the slots."""
    out = with_texts(docs, shard_by_bytes(docs, shards, id_col, text_col), id_col)
    out = out.withColumn("file", F.floor(F.col("slot") / rows_per_file))
    out.repartitionByRange("shard", "file").sortWithinPartitions("shard", "slot").drop("file").write.partitionBy("shard").parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
