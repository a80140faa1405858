"""Text lines of callers' results, as DataFrames with an order column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tad_lines(domains: DataFrame) -> DataFrame:
    """start, end, level, mean and score of nested domains."""
    return domains.select("chrom_id", "start_bin", F.format_string("%d\t%d\t%d\t%.3f\t%.3f", F.col("start_bin"), F.col("end_bin"), F.col("level"), F.col("mean"), F.col("score")).alias("value"))


def bed_lines(domains: DataFrame, chroms: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """chrom, start, end and more fields of intervals by chromosome."""
    named = domains.join(F.broadcast(chroms.select("chrom_id", F.col("name").alias("chrom"))), "chrom_id")
    return named.select("chrom", "start", F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), *(F.col(f).cast("string") for f in fields)).alias("value"))


def score_bedgraph(scores: DataFrame) -> DataFrame:
    """scores(chrom_id, start, end, score): spans from the middle of the row before to the row's own
    middle, with the row's score; spans that don't grow are left out."""
    mid = F.floor((F.col("start") + F.col("end")) / 2).cast("long")
    w = Window.partitionBy("chrom_id").orderBy("start")
    rows = scores.withColumn("to", mid).withColumn("from", F.coalesce(F.lag("to").over(w), F.lit(0).cast("long")))
    return rows.where(F.col("to") > F.col("from")).select("chrom_id", "from", "to", "score")


def score_table(scores: DataFrame, chroms: DataFrame) -> DataFrame:
    """(chrom_id, bin, value): lines of the mean z of every window, for each scored bin."""
    named = scores.join(F.broadcast(chroms.select("chrom_id", "name")), "chrom_id")
    values = F.array_join(F.transform("values", lambda v: F.format_string("%.6f", v)), "\t")
    return named.select("chrom_id", "bin", F.concat_ws("\t", "name", F.col("start").cast("string"), F.col("end").cast("string"), values).alias("value"))


def score_header(bin_size: int, min_depth: int, max_depth: int, step: int) -> str:
    """The line that comes before a score table's."""
    return f'#{{"step":{step},"minDepth":{min_depth},"maxDepth":{max_depth},"binsize":{bin_size}}}'


def boundary_lines(scores: DataFrame, boundaries: DataFrame, chroms: DataFrame) -> DataFrame:
    """(row, bed, gff): two kinds of lines of boundaries, to be written in the order of their rows.  A boundary
    reaches from the middle of the scored bin before to that of its own."""
    w = Window.partitionBy("chrom_id").orderBy("bin")
    middle = F.floor((F.col("start") + F.col("end")) / 2).cast("long")
    places = scores.select("chrom_id", "start", middle.alias("right"), F.lag(middle).over(w).alias("left")).where("left is not null")
    found = boundaries.join(places, ["chrom_id", "start"]).join(F.broadcast(chroms.select("chrom_id", "name")), "chrom_id")
    number = lambda c: F.format_string("%.12f", F.coalesce(F.col(c), F.lit(float("nan"))))
    ends = (F.col("left").cast("string"), F.col("right").cast("string"))
    name = F.format_string("B%05d", "row")
    notes = F.concat_ws(";", F.concat(F.lit("ID="), name), F.concat(F.lit("delta="), number("delta")), F.concat(F.lit("pvalue="), number("p")), F.concat(F.lit("tad_sep="), number("score")))
    bed = F.concat_ws("\t", "name", *ends, name, number("score"), F.lit("."))
    gff = F.concat_ws("\t", "name", F.lit("contactgrid"), F.lit("boundary"), *ends, number("score"), F.lit("."), F.lit("."), notes)
    return found.select("row", bed.alias("bed"), gff.alias("gff"))


def multiscale_lines(ensemble: DataFrame, chroms: DataFrame, bin_size: int) -> DataFrame:
    """(chrom, gamma, rank, start_bin, value): lines of each way to cut a chromosome, by gamma and rank: a file each."""
    named = ensemble.join(F.broadcast(chroms.select("chrom_id", F.col("name").alias("chrom"))), "chrom_id")
    ends = (F.col("start_bin") * bin_size, (F.col("end_bin") + 1) * bin_size - 1)
    return named.select("chrom", "gamma", "rank", "start_bin", F.concat_ws("\t", "chrom", *(e.cast("string") for e in ends)).alias("value"))


def bedpe_lines(blocks: DataFrame, chroms: DataFrame) -> DataFrame:
    """Sixteen columns: both sides of a block, then colour, score and signs."""
    named = blocks.join(F.broadcast(chroms.select("chrom_id", F.col("name").alias("chrom"))), "chrom_id")
    side = ["chrom", "start", "end"]
    text = [F.col(c).cast("string") for c in (*side, *side)]
    more = [F.col(c).cast("string") for c in ("score", "up_var", "low_var", "up_sign", "low_sign")]
    return named.select("chrom", "start", F.concat_ws("\t", *text, F.lit("."), F.lit("."), F.lit("."), F.lit("."), F.lit("255,255,0"), *more).alias("value"))
