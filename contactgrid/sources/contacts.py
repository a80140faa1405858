"""Contacts from the star-schema tables, toy matrices, dense text and BED files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import ContactMatrix, chrom_offsets, fixed_bins
from ..schema import MatrixError, floor_div


def table_chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chromosome for each region; lengths aren't multiples of common bin sizes."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    return r.select(F.col("r_regionkey").cast("int").alias("chrom_id"), F.col("r_name").alias("name"), (20000 + 3700 * F.col("r_regionkey")).cast("int").alias("length"))


def table_contacts(spark: SparkSession, sf_dir: str, chroms: DataFrame) -> DataFrame:
    """(chrom1, pos1, chrom2, pos2, flag) for each line item: near the diagonal, but line 7 of an order
    reaches the next chromosome."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lengths = chroms.select("chrom_id", "length")
    n = 5
    c1 = (F.col("l_partkey") % n).cast("int")
    trans = F.col("l_linenumber") == 7
    rows = li.select(c1.alias("chrom1"), F.when(trans, (c1 + 1) % n).otherwise(c1).cast("int").alias("chrom2"), trans.alias("trans"), (F.col("l_partkey") * 7919 + F.col("l_orderkey")).alias("a"), (F.col("l_suppkey") * 31).alias("b"), (F.col("l_quantity").cast("long") * F.col("l_linenumber") * 10).alias("step"), F.col("l_returnflag").alias("flag"))
    for k in (1, 2):
        rows = rows.join(F.broadcast(lengths.select(F.col("chrom_id").alias(f"chrom{k}"), F.col("length").cast("long").alias(f"len{k}"))), f"chrom{k}")
    pos1 = F.col("a") % F.col("len1")
    pos2 = F.when(F.col("trans"), F.col("b") % F.col("len2")).otherwise((pos1 + F.col("step")) % F.col("len1"))
    return rows.select("chrom1", pos1.alias("pos1"), "chrom2", pos2.alias("pos2"), "flag")


def bin_contacts(contacts: DataFrame, chroms: DataFrame, bin_size: int) -> DataFrame:
    """Pixels of contacts: one partial aggregate on the map side and one shuffle of distinct pairs.
    The table of chromosomes is bounded by the genome."""
    off = chrom_offsets(chroms, bin_size).select("chrom_id", "first_bin")
    for k in (1, 2):
        contacts = contacts.join(F.broadcast(off.select(F.col("chrom_id").alias(f"chrom{k}"), F.col("first_bin").alias(f"off{k}"))), f"chrom{k}")
    b1, b2 = (F.col(f"off{k}") + floor_div(F.col(f"pos{k}"), bin_size) for k in (1, 2))
    pairs = contacts.select(F.least(b1, b2).alias("bin1_id"), F.greatest(b1, b2).alias("bin2_id"))
    return pairs.groupBy("bin1_id", "bin2_id").agg(F.count("*").cast("double").alias("count"))


def table_matrix(spark: SparkSession, sf_dir: str, bin_size: int = 100, flag: str | None = None) -> ContactMatrix:
    """The matrix of all line items; flag "R" takes those returned, "-" the others."""
    chroms = table_chroms(spark, sf_dir)
    contacts = table_contacts(spark, sf_dir, chroms)
    if flag is not None:
        contacts = contacts.where(F.col("flag") == "R" if flag == "R" else F.col("flag") != "R")
    return ContactMatrix(chroms, fixed_bins(chroms, bin_size), bin_contacts(contacts, chroms, bin_size), bin_size)


#: Of domain_matrix: domains a chromosome, and bins a domain of the first chromosome and more for each next one.
DOMAINS, DOMAIN_BINS, MORE_BINS = 8, 20, 2


def domain_matrix(spark: SparkSession, sf_dir: str, bin_size: int = 20_000, flag: str | None = None) -> ContactMatrix:
    """A contact of each line item, on chromosomes with domains: a chromosome for each region, eight domains of one
    size side by side, each halved.  Of ten contacts four lie in a half, four in a domain, two anywhere.

    bin_size divides 20,000; flag as for table_matrix."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    width = ((DOMAIN_BINS + MORE_BINS * F.col("r_regionkey")) * 20_000).cast("int")
    chroms = r.select(F.col("r_regionkey").cast("int").alias("chrom_id"), F.col("r_name").alias("name"), (width * DOMAINS).alias("length"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if flag is not None:
        li = li.where(F.col("l_returnflag") == "R" if flag == "R" else F.col("l_returnflag") != "R")
    key = F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104_729 + F.col("l_linenumber") * 15_485_863
    rows = li.select((F.col("l_partkey") % 5).cast("int").alias("chrom_id"), key.alias("a"), (F.col("l_suppkey") * 32_452_843 + F.col("l_orderkey") * 49_979_687 + F.col("l_linenumber") * 611_953).alias("b"))
    rows = rows.join(F.broadcast(chroms.select("chrom_id", (F.col("length") / DOMAINS).cast("long").alias("w"))), "chrom_id")
    mode, domain = F.col("b") % 10, F.col("a") % DOMAINS
    half = F.floor(F.col("w") / 2).cast("long")
    side = F.floor(F.col("a") / DOMAINS).cast("long") % 2
    one, two = F.floor(F.col("a") / 16).cast("long"), F.floor(F.col("b") / 10).cast("long")
    start = lambda n: F.when(mode < 4, domain * F.col("w") + side * half + n % half).when(mode < 8, domain * F.col("w") + n % F.col("w")).otherwise(n % (F.col("w") * DOMAINS))
    contacts = rows.select(F.col("chrom_id").alias("chrom1"), start(one).alias("pos1"), F.col("chrom_id").alias("chrom2"), start(two).alias("pos2"))
    return ContactMatrix(chroms, fixed_bins(chroms, bin_size), bin_contacts(contacts, chroms, bin_size), bin_size)


def toy_matrix(spark: SparkSession, domains: int = 10, width: int = 10, bin_size: int = 100, inside: float = 50.0, outside: float = 2.0, n_chroms: int = 2) -> ContactMatrix:
    """Chromosomes of block domains: `inside` within a block, `outside` elsewhere, nothing on the
    diagonal or between chromosomes."""
    n = domains * width
    chroms = spark.createDataFrame([(k, f"toy{k + 1}", n * bin_size) for k in range(n_chroms)], "chrom_id int, name string, length int")
    a = fixed_bins(chroms, bin_size).select(F.col("bin_id").alias("bin1_id"), "chrom_id")
    far = F.explode(F.sequence(F.col("bin1_id") + 1, (F.col("chrom_id") + 1).cast("long") * n - 1))
    cells = a.where(F.col("bin1_id") + 1 < (F.col("chrom_id") + 1) * n).select("bin1_id", far.alias("bin2_id"))
    same = floor_div(F.col("bin1_id"), width) == floor_div(F.col("bin2_id"), width)
    pixels = cells.withColumn("count", F.when(same, inside).otherwise(outside))
    return ContactMatrix(chroms, fixed_bins(chroms, bin_size), pixels, bin_size)


def dense_text_pixels(lines: DataFrame, line_no: str = "line_no", text: str = "value") -> DataFrame:
    """Positive cells of the upper triangle of a matrix in text, one numbered line a row.

    Blank lines don't count.  Raises on lines of different widths, on other things than numbers and on
    an empty matrix; the width alone sets the number of bins."""
    from pyspark.sql.window import Window

    full = lines.where(F.trim(F.col(text)) != "")
    cells = F.split(F.trim(F.col(text)), r"\s+")
    rows = full.select(F.col(line_no).alias("n"), cells.alias("cells"))
    widths = rows.agg(F.min(F.size("cells")), F.max(F.size("cells")), F.count("*")).first()
    if not widths[2]:
        raise MatrixError("an empty matrix")
    if widths[0] != widths[1]:
        raise MatrixError(f"rows of {widths[0]} and of {widths[1]} values")
    rows = rows.withColumn("i", (F.row_number().over(Window.orderBy("n")) - 1).cast("long"))
    flat = rows.select("i", F.posexplode("cells").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").try_cast("double").alias("v"))
    bad = flat.where("v is null").first()
    if bad is not None:
        raise MatrixError(f"not a number in row {bad.i}, column {bad.j}")
    return flat.where("j >= i and v > 0").select(F.col("i").alias("bin1_id"), F.col("j").alias("bin2_id"), F.col("v").alias("count"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end) of a BED file; headers and lines of fewer than three fields are passed over."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 3)
    rows = rows.select(F.col("p")[0].alias("chrom"), F.col("p")[1].try_cast("long").alias("start"), F.col("p")[2].try_cast("long").alias("end"))
    return rows.where("start is not null and end is not null")


def parse_datasets(text: str) -> list[tuple[int, str, str]]:
    """(resolution, label, path) of lines "res:N", each followed by lines "label:path"."""
    out, resolution = [], None
    for line in filter(None, map(str.strip, text.splitlines())):
        key, _, value = line.partition(":")
        if key == "res":
            resolution = int(value)
        elif resolution is None or not value:
            raise MatrixError(f"no dataset: {line!r}")
        else:
            out.append((resolution, key.strip(), value.strip()))
    if not out:
        raise MatrixError("no datasets")
    return out
