"""Queries over the matrix of the star-schema tables, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import matrix as M
from ..operators import balance as B
from ..operators import bands, coarsen, compare, intervals, marginals, validate
from ..schema import Region, weight_type
from ..sources import contacts, layout
from .oracle import CIS, KEPT, PAIR, RETURNED, ice, pixels, rho, with_base, with_domains
from .scratch import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _m(spark: SparkSession, sf_dir: str) -> M.ContactMatrix:
    return contacts.table_matrix(spark, sf_dir)


def _pair(spark: SparkSession, sf_dir: str) -> tuple[M.ContactMatrix, M.ContactMatrix]:
    return contacts.table_matrix(spark, sf_dir, flag="R"), contacts.table_matrix(spark, sf_dir, flag="-")


def _cis(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = _m(spark, sf_dir)
    return bands.cis_cells(m.pixels, m.bins), m.bins


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# ---- tables, indexes, regions ----

_BG2 = with_base("""
select c.name as chrom1, b1.start as start1, b1."end" as end1, c.name as chrom2, b2.start as start2, b2."end" as end2, p.count
from pixels p join bins b1 on b1.bin_id = p.bin1_id join bins b2 on b2.bin_id = p.bin2_id join chroms c on c.chrom_id = b1.chrom_id
where c.name = 'ASIA' and b2.chrom_id = b1.chrom_id and b1."end" > 5000 and b1.start < 12000 and b2."end" > 5000 and b2.start < 12000 order by p.bin1_id, p.bin2_id""")


@query(_BG2)
def bg2_region_dump(spark, sf_dir):
    """Pixels of a region with the coordinates of both bins, in order."""
    m = _m(spark, sf_dir)
    out = M.annotate(m, m.block(Region.parse("ASIA:5000-12000"))).orderBy("bin1_id", "bin2_id")
    return out.select("chrom1", "start1", "end1", "chrom2", "start2", "end2", "count")


@query(with_base("select chrom_id, name, length from chroms"))
def chroms_table(spark, sf_dir):
    return contacts.table_chroms(spark, sf_dir)


@query(with_base("select * from bins"))
def bins_table(spark, sf_dir):
    return _m(spark, sf_dir).bins


@query(with_base("select * from pixels"))
def pixels_table(spark, sf_dir):
    return _m(spark, sf_dir).pixels


@query(with_base("select chrom_id, n_bins, first_bin from offs"))
def chrom_offset(spark, sf_dir):
    return M.chrom_offsets(contacts.table_chroms(spark, sf_dir), 100).select("chrom_id", "n_bins", "first_bin")


@query(with_base("""select bin_id, (select count(*) from pixels where bin1_id < bin_id)::bigint as first_row
from (select bin_id from bins union all select max(bin_id) + 1 from bins)"""))
def bin1_offset(spark, sf_dir):
    m = _m(spark, sf_dir)
    return M.bin1_offset(m.bins, m.pixels, stride=256)


@query(with_base("select * from pixels where bin1_id >= 300 and bin1_id < 420"))
def row_band_scan(spark, sf_dir):
    return M.row_band(_m(spark, sf_dir).pixels, 300, 420)


@query(with_base("select * from pixels where bin1_id between 437 and 710 and bin2_id between 437 and 710"))
def cis_block_scan(spark, sf_dir):
    return _m(spark, sf_dir).block(Region.parse("ASIA"))


@query(with_base("""select * from pixels where bin1_id >= (select first_bin + 20 from offs where name = 'EUROPE') and bin1_id < (select first_bin + 91 from offs where name = 'EUROPE')"""))
def region_rows(spark, sf_dir):
    return _m(spark, sf_dir).rows_in(Region.parse("EUROPE:2000-9050"))


@query(with_base("""select p.* from pixels p join bins b on b.bin_id = bin2_id join chroms using (chrom_id)
where name = 'EUROPE' and bin1_id >= (select first_bin + 20 from offs where name = 'EUROPE') and bin1_id < (select first_bin + 91 from offs where name = 'EUROPE')"""))
def region_on_chromosome(spark, sf_dir):
    """Pixels of a region's rows within its chromosome."""
    return _m(spark, sf_dir).rows_on_chromosome(Region.parse("EUROPE:2000-9050"))


@query(with_base("""select bins.* from bins join chroms using (chrom_id) where name = 'EUROPE' and start < 9050 and "end" > 2000"""))
def bins_in_region(spark, sf_dir):
    return _m(spark, sf_dir).bins_in(Region.parse("EUROPE:2000-9050"))


_SUB = """
select i, j, max(count) as count from (select bin1_id as i, bin2_id as j, count from pixels union all select bin2_id, bin1_id, count from pixels where bin1_id <> bin2_id)
where i between 100 and 159 and j between 120 and 199 group by 1, 2"""


@query(with_base(_SUB))
def submatrix_coo(spark, sf_dir):
    return M.submatrix(_m(spark, sf_dir).pixels, (100, 160), (120, 200))


@query(with_base(f""", sub as ({_SUB}) select g.i, sum(coalesce(count, 0)) as total, count(count)::bigint as filled, count(*)::bigint as cells
from (select a.i, b.j from unnest(generate_series(100::bigint, 159)) a(i), unnest(generate_series(120::bigint, 199)) b(j)) g left join sub using (i, j) group by 1"""))
def submatrix_dense(spark, sf_dir):
    """Rows of a dense block, summed up."""
    rows = M.dense(M.submatrix(_m(spark, sf_dir).pixels, (100, 160), (120, 200)), (100, 160), (120, 200))
    v = F.col("values")
    return rows.select("i", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(F.filter(v, lambda x: x != 0)).cast("long").alias("filled"), F.size(v).cast("long").alias("cells"))


@query(with_base("select chrom_id, case name when 'ASIA' then 'chrA' when 'EUROPE' then 'chrE' else name end as name, length from chroms"))
def rename_chroms(spark, sf_dir):
    return _m(spark, sf_dir).rename_chroms({"ASIA": "chrA", "EUROPE": "chrE"}).chroms


@query(with_base("""select b.*, m.marg as coverage from bins b left join (select bin_id, sum(v) as marg from (select bin1_id as bin_id, count as v from pixels union all select bin2_id, count from pixels) group by 1) m using (bin_id)"""))
def bin_column(spark, sf_dir):
    m = _m(spark, sf_dir)
    m = m.set_bin_column("coverage", marginals.marginal(m.pixels).withColumnRenamed("marg", "value")).set_bin_column("spare", m.bins.select("bin_id", F.lit(1.0).alias("value")))
    return m.drop_bin_column("spare").bins


def _domains(spark: SparkSession, sf_dir: str, bin_size: int = 20_000, flag: str | None = None) -> M.ContactMatrix:
    return contacts.domain_matrix(spark, sf_dir, bin_size, flag)


@query(with_domains(""" select first_bin + k as bin_id, chrom_id, (k * 20000)::int as start, (k * 20000 + 20000)::int as "end" from doffs, unnest(generate_series(0::bigint, n_bins - 1)) t(k)"""))
def tiled_bins(spark, sf_dir):
    """Bins of the matrix of the tables that has domains."""
    return _domains(spark, sf_dir).bins


@query(with_domains(" select * from dpixels"))
def toy_blocks(spark, sf_dir):
    """The pixels of the matrix of the tables that has domains along its diagonal."""
    return _domains(spark, sf_dir).pixels


@query(with_base("select bin1_id, bin2_id, count from pixels where bin1_id < 200 and bin2_id < 200"))
def dense_text(spark, sf_dir):
    """The matrix of the first chromosome, written as dense text and read from it."""
    lines = layout.dense_text(_m(spark, sf_dir), 0)
    return contacts.dense_text_pixels(lines, "i")


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """The tables' matrix written to the shared folder, with its indexes."""
    path = f"{shared_dir(spark)}/matrix-{uuid.uuid4().hex}"
    layout.write_matrix(_m(spark, sf_dir), path)
    return path


@query(with_base("select row, bin1_id, bin2_id, count from (select *, row_number() over (order by bin1_id, bin2_id) - 1 as row from pixels) where row >= 1000 and row < 2500"))
def stored_rows_slice(spark, sf_dir):
    """A slice by stored row, from the files that hold it."""
    return layout.stored_rows(spark, _stored(spark, sf_dir), 1000, 2500)


@query(with_base("select * from pixels where bin1_id >= 300 and bin1_id < 420"))
def stored_index_rows(spark, sf_dir):
    """Rows of the matrix by the stored row index."""
    return layout.indexed_rows(spark, _stored(spark, sf_dir), 300, 420)


@query(with_base("select 'x' as \"check\", 'y' as detail from bins where false"))
def stored_index_clean(spark, sf_dir):
    return layout.index_issues(spark, _stored(spark, sf_dir))


@query(with_base("select 'bin1_offset' as \"check\", bin_id::varchar as detail from (select bin_id from bins union all select max(bin_id) + 1 from bins) where bin_id % 97 = 5 or bin_id % 101 = 7 or bin_id = 50 union all select 'bin1_offset', '-3'"))
def stored_index_corrupt(spark, sf_dir):
    """An index with wrong, missing and repeated entries, and one of no bin."""
    m = _m(spark, sf_dir)
    path = _stored(spark, sf_dir)
    held = spark.read.parquet(f"{path}/indexes/bin1_offset").where("bin_id % 101 <> 7")
    held = held.withColumn("first_row", F.when(F.col("bin_id") % 97 == 5, F.col("first_row") + 1).otherwise(F.col("first_row")))
    held = held.unionByName(held.where("bin_id = 50")).unionByName(held.where("bin_id = 51").withColumn("bin_id", F.lit(-3).cast("long")))
    return validate.index_issues(held, m.bins, spark.read.parquet(f"{path}/pixels"))


# ---- filters and joins ----


@query(with_base("""select least(x, y) as bin1_id, greatest(x, y) as bin2_id, sum(count) as count from (
  select bin1_id as x, bin2_id as y, count from pixels union all select bin2_id, bin1_id, count from pixels where count > 1) group by 1, 2"""))
def canonicalise_pixels(spark, sf_dir):
    px = _m(spark, sf_dir).pixels
    return M.canonical(px.unionByName(px.where("count > 1").select(F.col("bin2_id").alias("bin1_id"), F.col("bin1_id").alias("bin2_id"), "count")))


@query(with_base("select b1.chrom_id = b2.chrom_id as cis, count(*)::bigint as n, sum(count) as total from pixels join bins b1 on b1.bin_id = bin1_id join bins b2 on b2.bin_id = bin2_id group by 1"))
def cis_trans_split(spark, sf_dir):
    m = _m(spark, sf_dir)
    px = M.with_chroms(m.pixels, m.bins).groupBy((F.col("chrom_id1") == F.col("chrom_id2")).alias("cis"))
    return px.agg(F.count("*").alias("n"), F.sum("count").alias("total"))


@query(with_base("select * from pixels where bin2_id - bin1_id >= 3"))
def ignore_diags(spark, sf_dir):
    return marginals.select_pixels(_m(spark, sf_dir), 3)


@query(with_base("select bin_id, sum(v)::double as marg from (select bin1_id as bin_id, 1 as v, bin2_id - bin1_id as d from pixels union all select bin2_id, 1, bin2_id - bin1_id from pixels) where d >= 2 group by 1"))
def binarised_nnz(spark, sf_dir):
    return marginals.marginal(marginals.select_pixels(_m(spark, sf_dir), 2, binarize=True))


def _iv(spark, sf_dir):
    """An interval for each order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    r = contacts.table_chroms(spark, sf_dir).select("chrom_id", F.col("name").alias("chrom"))
    start = (F.col("o_custkey") * 131 + F.col("o_orderkey")) % 19000
    iv = o.select((F.col("o_orderkey") % 5).cast("int").alias("chrom_id"), start.alias("start"), (start + 1 + F.col("o_orderkey") % 700).alias("end"))
    return iv.join(F.broadcast(r), "chrom_id").select("chrom", "start", "end").distinct()


_IV = """, iv as materialized (select distinct name as chrom, s as start, s + 1 + k % 700 as "end" from (select o_orderkey as k, (o_custkey * 131 + o_orderkey) % 19000 as s from orders) join chroms on chrom_id = k % 5)"""
_TILES = """, tiles as materialized (select name as chrom, k * 1000 as start, least(k * 1000 + 1000, length)::bigint as "end" from chroms, unnest(generate_series(0::bigint, (length - 1) // 1000)) t(k))"""


def blacklist_overlap(spark, sf_dir):
    return intervals.overlapping_bins(_m(spark, sf_dir), _iv(spark, sf_dir))


def included_bins(spark, sf_dir):
    return intervals.local_bins(_iv(spark, sf_dir), 100)


def nesting_level(spark, sf_dir):
    return intervals.nesting_levels(_iv(spark, sf_dir))


def low_minus_high(spark, sf_dir):
    iv = _iv(spark, sf_dir)
    return iv.where("start < 12000").join(iv.where("start > 6000"), ["chrom", "start", "end"], "left_anti")


_INTERVALS = {
    blacklist_overlap: """ select distinct bin_id from (select distinct chrom, k from iv, unnest(generate_series(start // 100, ("end" + 99) // 100 - 1)) t(k)) x
join chroms c on c.name = x.chrom join bins b on b.chrom_id = c.chrom_id and b.start = k * 100""",
    included_bins: """ select distinct chrom, k from iv, unnest(generate_series(start // 100, ("end" + 99) // 100 - 1)) t(k)""",
    nesting_level: """ select a.chrom, a.start, a."end", count(b.chrom)::bigint as level from iv a left join iv b on a.chrom = b.chrom and b.start <= a.start and b."end" >= a."end" and (b.start < a.start or b."end" > a."end") group by 1, 2, 3""",
    low_minus_high: """ select * from iv where start < 12000 except select * from iv where start > 6000""",
}
for _f, _sql in _INTERVALS.items():
    query(with_base(_IV + _sql))(_f)


@query(with_base(_IV + _TILES + """ select a.chrom, a.start as s1, a."end" as e1, b.start as s2, round((least(a."end", b."end") - greatest(a.start, b.start))::double / (greatest(a."end", b."end") - least(a.start, b.start)), 6) as ratio
from iv a join tiles b on a.chrom = b.chrom and a.start < b."end" and b.start < a."end\""""))
def interval_overlap_ratio(spark, sf_dir):
    """Every interval with the stretches of 1000 positions that it overlaps."""
    chroms = contacts.table_chroms(spark, sf_dir)
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length").cast("long") - 1, F.lit(1000).cast("long")))
    tiles = chroms.select(F.col("name").alias("chrom"), "length", start.alias("start")).withColumn("end", F.least(F.col("start") + 1000, F.col("length").cast("long")))
    r = intervals.overlap_ratio(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))
    return intervals.overlapping_pairs(_iv(spark, sf_dir), tiles).select("chrom", "s1", "e1", "s2", F.round(r, 6).alias("ratio"))


@query(with_base(_IV + """ select a.chrom, a.start, a."end", count(b.chrom)::bigint as n from iv a left join iv b on a.chrom = b.chrom and a.start < b."end" and b.start < a."end" and (a.start, a."end") <> (b.start, b."end") group by 1, 2, 3"""))
def interval_overlap_counts(spark, sf_dir):
    """How many other intervals each overlaps."""
    return intervals.overlap_counts(_iv(spark, sf_dir))


@query(with_base(""", e as (select distinct bin1_id % 50 as a, bin2_id % 50 as b from pixels where count > 2) select a, b from e intersect select b, a from e"""))
def reciprocal_edges(spark, sf_dir):
    px = _m(spark, sf_dir).pixels.where("count > 2")
    return intervals.reciprocal(px.select((F.col("bin1_id") % 50).alias("a"), (F.col("bin2_id") % 50).alias("b")))


@query(with_base(""", w as (select bin_id, sum(v) as m from (select bin1_id as bin_id, count as v from pixels union all select bin2_id, count from pixels) group by 1)
select b.bin_id, b.chrom_id, row_number() over (partition by chrom_id order by b.bin_id) - 1 as pos from bins b join w using (bin_id) where m > 30"""))
def masked_renumbered_bins(spark, sf_dir):
    m = _m(spark, sf_dir)
    w = marginals.marginal(m.pixels).select("bin_id", F.when(F.col("marg") > 30, F.col("marg")).otherwise(float("nan")).alias("value"))
    return M.masked_positions(m.set_bin_column("w", w).bins, "w").select("bin_id", "chrom_id", F.col("pos").cast("long").alias("pos"))


@query(with_base(""", ok as (select *, lag("end") over w as before, lead(start) over w as next from bins where bin_id % 37 <> 5 window w as (partition by chrom_id order by bin_id))
select bin_id, chrom_id, (case when before is not null then start - (start - before) // 2 when next is not null then 0 else start end)::bigint as start,
  (case when next is not null then next - (next - "end") // 2 else "end" end)::bigint as "end" from ok"""))
def enlarged_bins(spark, sf_dir):
    """The bins that have a weight, moved together over the gaps."""
    return M.enlarged(M.masked_positions(_weighted(spark, sf_dir).bins, "w")).select("bin_id", "chrom_id", "start", "end")


@query(with_base("select median(start - before)::bigint as bin_size from (select start, lag(start) over (partition by chrom_id order by bin_id) as before from bins)"))
def median_bin_size(spark, sf_dir):
    return M.median_bin_size(_m(spark, sf_dir).bins)


@query(with_base("select bin1_id, bin2_id, round(log2(count + 1), 6) as log2p, round(case when count > 0 then ln(count) else count end, 6) as ln from pixels"))
def log_transforms(spark, sf_dir):
    c = F.col("count")
    return _m(spark, sf_dir).pixels.select("bin1_id", "bin2_id", F.round(F.log2(c + 1), 6).alias("log2p"), F.round(F.when(c > 0, F.log(c)).otherwise(c), 6).alias("ln"))


_NAMES = ("KR", "VC_SQRT", "weight", "ICE", "SCALE", "mine")


@query("""select name, case when name in ('KR', 'VC_SQRT', 'SCALE') then 'divisive' when name in ('weight', 'ICE') then 'multiplicative' end as kind, count(*)::bigint as n
from (select ['KR', 'VC_SQRT', 'weight', 'ICE', 'SCALE', 'mine'][(l_partkey + l_linenumber) % 6 + 1] as name from lineitem) group by 1, 2""")
def weight_types(spark, sf_dir):
    """How columns apply that line items are given a name for."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = F.get(F.array(*map(F.lit, _NAMES)), ((F.col("l_partkey") + F.col("l_linenumber")) % 6).cast("int"))
    return li.select(name.alias("name")).select("name", weight_type(F.col("name")).alias("kind")).groupBy("name", "kind").agg(F.count("*").alias("n"))


# ---- sums, coarser levels ----

_LEGS = "(select bin1_id as bin_id, count as v from pixels union all select bin2_id, count from pixels)"


@query(with_base(f"select bin_id, sum(v) as marg from {_LEGS} group by 1"))
def marginal_double_diag(spark, sf_dir):
    return marginals.marginal(_m(spark, sf_dir).pixels)


@query(with_base("select bin_id, sum(v) as marg from (select bin1_id as bin_id, count as v from pixels union all select bin2_id, count from pixels where bin1_id <> bin2_id) group by 1"))
def marginal_single_diag(spark, sf_dir):
    return marginals.marginal(_m(spark, sf_dir).pixels, diagonal_twice=False)


@query(with_base(f"select round(avg(marg), 6) as mean, round(var_pop(marg), 6) as var from (select sum(v) as marg from {_LEGS} group by bin_id) where marg <> 0"))
def nonzero_mean_var(spark, sf_dir):
    return marginals.nonzero_mean_var(marginals.marginal(_m(spark, sf_dir).pixels)).select(_r("mean"), _r("var"))


@query(with_base(f", g as (select sum(v) as marg from {_LEGS} group by bin_id) select any_value(m) as median, median(abs(marg - m)) as mad, from (select marg, (select median(marg) from g) as m from g)"))
def median_mad(spark, sf_dir):
    return marginals.median_and_mad(marginals.marginal(_m(spark, sf_dir).pixels), "marg")


@query(with_base("select chrom_id, round(quantile_cont(count, 0.01), 6) as p1, round(quantile_cont(count, 0.99), 6) as p99, sum(count) as total, count(*)::bigint as nnz from pixels join bins on bin_id = bin1_id group by 1"))
def count_percentiles(spark, sf_dir):
    m = _m(spark, sf_dir)
    px = m.pixels.join(m.bins.select(F.col("bin_id").alias("bin1_id"), "chrom_id"), "bin1_id")
    return px.groupBy("chrom_id").agg(F.round(F.percentile("count", 0.01), 6).alias("p1"), F.round(F.percentile("count", 0.99), 6).alias("p99"), F.sum("count").alias("total"), F.count("*").alias("nnz"))


@query(with_base("select bin1_id, bin2_id, rank() over (order by count) + (count(*) over (partition by count) - 1) / 2.0::double as rank from pixels"))
def average_rank(spark, sf_dir):
    return marginals.average_rank(_m(spark, sf_dir).pixels, "count").select("bin1_id", "bin2_id", "rank")


def _coarse(f: int) -> str:
    s = f * 100
    return with_base(f""", co as (select *, (sum(n) over (order by chrom_id) - n)::bigint as c0 from (select chrom_id, ((length + {s - 1}) // {s})::bigint as n from chroms))
select c1.c0 + b1.start // {s} as bin1_id, c2.c0 + b2.start // {s} as bin2_id, sum(count) as count from pixels join bins b1 on b1.bin_id = bin1_id join bins b2 on b2.bin_id = bin2_id
join co c1 on c1.chrom_id = b1.chrom_id join co c2 on c2.chrom_id = b2.chrom_id group by 1, 2""")


@query(_coarse(2))
def coarsen_x2(spark, sf_dir):
    return coarsen.coarsen(_m(spark, sf_dir), 2).pixels


@query(_coarse(5))
def coarsen_x5(spark, sf_dir):
    return coarsen.coarsen(_m(spark, sf_dir), 5).pixels


@query(with_base("""
select r.resolution, count(*)::bigint as nnz, sum(t)::double as total from (
  select resolution, co1, co2, sum(count) as t from (
    select r as resolution, b1.chrom_id * 1000000 + b1.start // r as co1, b2.chrom_id * 1000000 + b2.start // r as co2, count
    from pixels join bins b1 on b1.bin_id = bin1_id join bins b2 on b2.bin_id = bin2_id, (values (100), (200), (500), (1000)) v(r)) group by 1, 2, 3) r group by 1"""))
def zoom_levels(spark, sf_dir):
    out = None
    for r, level in coarsen.zoom(_m(spark, sf_dir), (200, 500, 1000)).items():
        one = level.pixels.agg(F.lit(r).alias("resolution"), F.count("*").alias("nnz"), F.sum("count").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


def _progressions(spark, sf_dir, made):
    """For each chromosome the resolutions from 100 up to its length."""
    rows = contacts.table_chroms(spark, sf_dir).select("chrom_id", "length").collect()
    found = [(r.chrom_id, x) for r in rows for x in made(100, r.length)]
    return spark.createDataFrame(found, "chrom_id int, resolution int")


@query(with_base(" select chrom_id, (100 * s * d)::int as resolution from chroms, unnest([1, 2, 5]) a(s), unnest([1, 10, 100, 1000]) b(d) where 100 * s * d <= length"))
def nice_resolutions(spark, sf_dir):
    return _progressions(spark, sf_dir, coarsen.nice_resolutions)


@query(with_base(" select chrom_id, (100 * 2 ** k)::int as resolution from chroms, unnest(generate_series(0, 20)) t(k) where 100 * 2 ** k <= length"))
def pow2_resolutions(spark, sf_dir):
    return _progressions(spark, sf_dir, coarsen.pow2_resolutions)


@query(with_base(""", g as (select *, sum(length) over (order by chrom_id) - length as bp0, (select sum(length) from chroms) as genome from chroms),
k as (select bin_id, ((bp0 + start) // (greatest(1, genome // 1000 // 500) * 1000))::bigint as cell from bins join g using (chrom_id))
select a.cell as bin1, b.cell as bin2, sum(count) as count from pixels join k a on a.bin_id = bin1_id join k b on b.bin_id = bin2_id group by 1, 2"""))
def all_matrix(spark, sf_dir):
    return coarsen.overview(_m(spark, sf_dir))


# ---- balancing ----


@query(with_base(f"select bin_id, round(case when marg > 0 then sqrt(marg) end, 6) as weight from (select bin_id, coalesce(sum(v), 0) as marg from bins left join {_LEGS} using (bin_id) group by 1)"))
def vc_weights(spark, sf_dir):
    return B.vc_weights(_m(spark, sf_dir)).select("bin_id", _r("weight"))


@query(with_base(f"select bin_id, round(case when marg > 0 then sqrt(sqrt(marg)) end, 6) as weight from (select bin_id, coalesce(sum(v), 0) as marg from bins left join {_LEGS} using (bin_id) group by 1)"))
def vc_sqrt_weights(spark, sf_dir):
    return B.vc_sqrt_weights(_m(spark, sf_dir)).select("bin_id", _r("weight"))


def _ice(name: str, sql: str, **params):
    def run(spark, sf_dir):
        out, _ = B.balance(_m(spark, sf_dir), B.BalanceParams(**{"tol": 0.0, "max_iters": 3, "mad_max": 0, "min_nnz": 0} | params))
        return out.select("bin_id", _r("weight"))

    query(with_base(", " + sql), name)(run)


_ice("ice_k3_genomewide", ice(3))
_ice("ice_k3_cis", ice(3, "cis"), cis_only=True)
_ice("ice_k3_trans", ice(3, "trans"), trans_only=True)
_ice("ice_k3_filtered", ice(3, filters=True), min_nnz=10, mad_max=5)
_ice("kr_k3", ice(3, diags=0), ignore_diags=0)


_MARG = f"(select bin_id, chrom_id, coalesce(sum(v), 0) as marg from bins left join {_LEGS} using (bin_id) group by 1, 2)"


@query(with_base(f""", raw as materialized {_MARG}, med as (select chrom_id, median(marg) as m from raw where marg > 0 group by 1),
lg as materialized (select ln(marg / m) as l from raw join med using (chrom_id) where marg > 0),
cut as (select exp(any_value(mm) - 1 * median(abs(l - mm))) as c from (select l, (select median(l) from lg) as mm from lg))
select bin_id, marg / m < c as low from raw join med using (chrom_id), cut"""))
def mad_max_mask(spark, sf_dir):
    m = _m(spark, sf_dir)
    return B.mad_mask(marginals.full_marginal(m.bins, marginals.marginal(m.pixels)), 1, on_normalized=True)


def _weighted(spark, sf_dir):
    m = _m(spark, sf_dir)
    return m.set_bin_column("w", m.bins.select("bin_id", F.when(F.col("bin_id") % 37 == 5, None).otherwise(1.0 / (1 + F.col("bin_id") % 7)).alias("value")))


_W = ", w as materialized (select bin_id, case when bin_id % 37 = 5 then null else 1::double / (1 + bin_id % 7) end as w from bins), px as (select p.*, a.w as w1, b.w as w2 from pixels p join w a on a.bin_id = bin1_id join w b on b.bin_id = bin2_id)"


@query(with_base(_W + " select bin1_id, bin2_id, count, round(count * (w1 * w2), 6) as balanced from px"))
def apply_weights_mul(spark, sf_dir):
    return B.apply_weights(_weighted(spark, sf_dir), "w", False).select("bin1_id", "bin2_id", "count", _r("balanced"))


@query(with_base(_W + " select bin1_id, bin2_id, count, round(count / (w1 * w2), 6) as balanced from px"))
def apply_weights_div(spark, sf_dir):
    return B.apply_weights(_weighted(spark, sf_dir), "w", True).select("bin1_id", "bin2_id", "count", _r("balanced"))


@query(with_base(_W + " select bin1_id, bin2_id, count, round((count / (w1 * w2))::float::double, 3) as balanced from px where w1 is not null and w2 is not null"))
def weights_single_ratio(spark, sf_dir):
    return B.apply_weights(_weighted(spark, sf_dir), "w", True, "ratio").select("bin1_id", "bin2_id", "count", _r("balanced", 3))


@query(with_base(_W + " select bin1_id, bin2_id, count, round((count::float::double / (w1 * w2)::float::double)::float::double, 3) as balanced from px"))
def weights_single_parts(spark, sf_dir):
    return B.apply_weights(_weighted(spark, sf_dir), "w", True, "parts").select("bin1_id", "bin2_id", "count", _r("balanced", 3))


@query(with_base(_W + " select bin_id, round(w * 1000 / (select sum(w) from w), 6) as weight from w"))
def rescaled_weights(spark, sf_dir):
    return B.rescaled(_weighted(spark, sf_dir).bins.select("bin_id", F.col("w").alias("weight")), 1000.0).select("bin_id", _r("weight"))


# ---- distance, scores ----


@query(with_base(f", {CIS} select chrom_id, d, sum(v) as total, any_value(n_bins) - d as pairs, round(sum(v) / (any_value(n_bins) - d), 6) as expected from cis join offs using (chrom_id) group by 1, 2"))
def expected_by_distance(spark, sf_dir):
    return bands.expected_by_distance(*_cis(spark, sf_dir)).select("chrom_id", "d", "total", "pairs", _r("expected"))


@query(with_base(f""", {CIS}, ok as materialized (select distinct chrom_id, pos from (select chrom_id, i as pos from cis union all select chrom_id, j from cis) where pos % 11 <> 3),
tot as (select d, sum(v) as t from cis join ok a on a.chrom_id = cis.chrom_id and a.pos = i join ok b on b.chrom_id = cis.chrom_id and b.pos = j group by 1),
top as (select max(d) as top from tot),
prs as (select b.pos - a.pos as d, count(*) as p from ok a join ok b on a.chrom_id = b.chrom_id and b.pos >= a.pos group by 1),
dist as materialized (select k as d, coalesce(t, 0) as t, coalesce(p, 0) as p from top, unnest(generate_series(0::bigint, top)) x(k) left join tot on tot.d = k left join prs on prs.d = k),
win as (select a.d, w, (select sum(t) from dist b where b.d between a.d - w and a.d + w) as t, (select sum(p) from dist b where b.d between a.d - w and a.d + w) as p from dist a, unnest(generate_series(0, 10)) y(w))
select d.d, round(arg_min(t / p, w) filter (where t > 400), 6) as expected from win d group by 1"""))
def dynamic_expected(spark, sf_dir):
    cells, _ = _cis(spark, sf_dir)
    pos = cells.select("chrom_id", F.explode(F.array("i", "j")).alias("pos")).distinct().where("pos % 11 <> 3")
    return bands.dynamic_expected(cells, pos).select("d", _r("expected"))


@query(with_base(f""", {CIS}, st as materialized (select chrom_id, d, sum(v) as s, sum(v * v) as ss, any_value(n_bins) - d as n from cis join offs using (chrom_id) where d < 40 and d < n_bins - 1 group by 1, 2)
select cis.chrom_id, i, j, round((v - s / n) / sqrt(greatest(1e-6, ss / n - (s / n) * (s / n))) + 1, 6) as z from cis join st on st.chrom_id = cis.chrom_id and st.d = cis.d"""))
def distance_standardized(spark, sf_dir):
    return bands.distance_standardized(*_cis(spark, sf_dir), 40).select("chrom_id", "i", "j", _r("z"))


_Z = """, z as materialized (select chrom_id, i, j, case when d > depth then 0 when sd > 0 then (v - mean) / sd end as z, d from (
  select cis.*, 40 as depth, s / dl as mean, sqrt(greatest(0, ss / dl - (s / dl) * (s / dl))) as sd from cis join (
    select chrom_id, d, sum(v) as s, sum(v * v) as ss, greatest(any_value(n_bins) - d, count(*))::double as dl from cis join offs using (chrom_id) where d > 0 group by 1, 2) using (chrom_id, d)))"""


@query(with_base(f", {CIS}{_Z} select chrom_id, i, j, round(z, 6) as z from z".replace("d > depth", "d + 1 > depth + 1")))
def pooled_zscore(spark, sf_dir):
    cells, b = _cis(spark, sf_dir)
    return bands.pooled_zscore(cells, b, 100, 40).select("chrom_id", "i", "j", _r("z"))


@query(with_base(f""", {CIS} select o.chrom_id, k as cut, coalesce(sum(v), 0)::double as total, round(coalesce(sum(v), 0) / 25, 6) as mean
from offs o, unnest(generate_series(5::bigint, n_bins - 5)) t(k) left join cis on cis.chrom_id = o.chrom_id and i >= k - 5 and i < k and j >= k and j < k + 5 group by 1, 2"""))
def diamond_insulation(spark, sf_dir):
    return bands.diamond_sums(*_cis(spark, sf_dir), 5).select("chrom_id", "cut", "total", _r("mean"))


_SCORE = """, cuts as (select chrom_id, n_bins as n, k as cut, w, greatest(0, k - w) as l, least(k + w, n_bins - 1) as r from offs, unnest(generate_series(0::bigint, n_bins - 1)) t(k), (values (3), (5), (8)) v(w)),
score as materialized (select chrom_id, cut, avg(m) as score from (select c.chrom_id, cut, w, coalesce(sum(z), 0) / greatest(1, (cut - l) * (r - cut)) as m
  from cuts c left join z on z.chrom_id = c.chrom_id and i >= l and i < cut and j >= cut and j < r group by c.chrom_id, cut, w, l, r) group by 1, 2)"""


@query(with_base(f", {CIS}{_Z}{_SCORE} select chrom_id, cut, round(score, 6) as score from score"))
def separation_score(spark, sf_dir):
    cells, b = _cis(spark, sf_dir)
    return bands.separation_score(bands.pooled_zscore(cells, b, 100, 40), b, [3, 5, 8]).select("chrom_id", "cut", _r("score"))


@query(with_base(f""", {CIS}{_Z}{_SCORE} select chrom_id, cut, round(case when cut >= 10 and cut + 10 < n - (case when chrom_id = 4 then 1 else 0 end) then (t - skipped) / 19 - score end, 6) as delta from (
  select s.*, n_bins as n, sum(score) over w as t, lead(score, 3) over (partition by s.chrom_id order by cut) as skipped from score s join offs using (chrom_id) window w as (partition by s.chrom_id order by cut rows between 10 preceding and 9 following))"""))
def delta_around(spark, sf_dir):
    cells, b = _cis(spark, sf_dir)
    scores = bands.separation_score(bands.pooled_zscore(cells, b, 100, 40), b, [3, 5, 8])
    return bands.local_delta(scores).select("chrom_id", "cut", _r("delta"))


@query(with_base(f""", {CIS}, near as (select * from cis where d between 1 and 15),
pr as (select chrom_id, b, d, sum(u) as u, sum(w) as w from (select chrom_id, j as b, d, v as u, 0 as w from near union all select chrom_id, i, d, 0, v from near) group by 1, 2, 3),
g as (select chrom_id, b, count(*) filter (where u <> 0 and w <> 0) as k, sum(u) as su, sum(w) as sw, sum(u * u) as uu, sum(w * w) as ww,
  sum(u) filter (where u <> 0 and w <> 0) as bu, sum(w) filter (where u <> 0 and w <> 0) as bw, sum(u * u) filter (where u <> 0 and w <> 0) as buu, sum(w * w) filter (where u <> 0 and w <> 0) as bww from pr group by 1, 2),
h as (select chrom_id, b, case when k >= 5 then k else 15 end::double as m, case when k >= 5 then bu else su end as su, case when k >= 5 then bw else sw end as sw, case when k >= 5 then buu else uu end as uu, case when k >= 5 then bww else ww end as ww from g),
q as (select *, ((uu - su * su / m) + (ww - sw * sw / m)) / (m * (m - 1)) as var from h)
select q.chrom_id, b as i, round(case when var > 1e-12 then (su - sw) / m / sqrt(var) else 0 end, 6) as di from q join offs using (chrom_id) where b >= 15 and b < n_bins - 15"""))
def fixed_directionality(spark, sf_dir):
    return bands.fixed_directionality(*_cis(spark, sf_dir), 15).select("chrom_id", "i", _r("di"))


@query(with_base(f""", {CIS}, s as materialized (select chrom_id, b, d, sum(l) as l, sum(r) as r from (
  select chrom_id, j as b, d, v as l, 0 as r from cis where d >= 2 union all select chrom_id, i, d, 0, v from cis where d >= 2) group by 1, 2, 3)
select chrom_id, b as i, b + d as j, round((l - r) / (l + r), 6) as di from s where b >= d"""))
def upstream_directionality(spark, sf_dir):
    cells, _ = _cis(spark, sf_dir)
    return bands.upstream_directionality(cells, 2).select("chrom_id", "i", "j", _r("di"))


@query(with_base(f""", {CIS}, p as (select distinct chrom_id, i as pos from cis where v >= 3), g as (select *, case when pos - lag(pos) over (partition by chrom_id order by pos) > 4 then 1 else 0 end as n from p),
r as (select *, sum(n) over (partition by chrom_id order by pos) as run from g) select chrom_id, min(pos) as lo, max(pos) + 1 as hi, count(*)::bigint as n from r group by chrom_id, run"""))
def gap_islands(spark, sf_dir):
    cells, _ = _cis(spark, sf_dir)
    return bands.islands(cells.where("v >= 3").select("chrom_id", F.col("i").alias("pos")).distinct(), 4)


_PV = "(select bin1_id, bin2_id, 1::double / (1 + count * count * 50 + bin1_id % 3) as p from pixels where bin2_id - bin1_id > 3)"


def _pvalues(spark, sf_dir):
    c = F.col("count")
    return _m(spark, sf_dir).pixels.where("bin2_id - bin1_id > 3").select("bin1_id", "bin2_id", (1.0 / (1 + c * c * 50 + F.col("bin1_id") % 3)).alias("p"))


@query(with_base(f" select max(p) filter (where p <= 0.05 * r / n) as cutoff from (select p, max(k) over (partition by p) as r, n from (select p, row_number() over (order by p) as k, count(*) over () as n from {_PV}))"))
def fdr_cutoff(spark, sf_dir):
    return bands.rejection_cutoff(_pvalues(spark, sf_dir), 0.05)


@query(with_base(f" select bin1_id, bin2_id, round(least(p * count(*) over (), 1), 6) as adjusted from {_PV}"))
def bonferroni(spark, sf_dir):
    return bands.bonferroni(_pvalues(spark, sf_dir)).select("bin1_id", "bin2_id", _r("adjusted"))


@query(with_base(""", dm as (select k as domain_id, k * 40 as lo, k * 40 + 55 as hi from unnest(generate_series(0::bigint, 30)) t(k))
select domain_id, round(1 - count(bin1_id) / 1431::double, 6) as noise from dm left join pixels on bin1_id >= lo and bin2_id < hi and bin2_id - bin1_id >= 2 group by 1"""))
def noise_ratio(spark, sf_dir):
    d = spark.range(31).select(F.col("id").alias("domain_id"), (F.col("id") * 40).alias("lo"), (F.col("id") * 40 + 55).alias("hi"))
    return intervals.noise_ratio(_m(spark, sf_dir).pixels, d, 2).select("domain_id", _r("noise"))


# ---- comparison ----


def _two(rest: str) -> str:
    return with_base(f", {pixels(RETURNED, 'pa')}, {pixels(KEPT, 'pb')}, {PAIR}{rest}")


@query(_two(f" select chrom_id, round({rho()}, 6) as value from cells where d > 0 group by 1"))
def pearson(spark, sf_dir):
    return compare.compare(*_pair(spark, sf_dir), "pearson").select("chrom_id", _r("value"))


@query(_two(f""", rk as (select chrom_id, rank() over (partition by chrom_id order by x) + (count(*) over (partition by chrom_id, x) - 1) / 2.0::double as x, rank() over (partition by chrom_id order by y) + (count(*) over (partition by chrom_id, y) - 1) / 2.0::double as y from cells where d > 0)
select chrom_id, round({rho()}, 6) as value from rk group by 1"""))
def spearman(spark, sf_dir):
    return compare.compare(*_pair(spark, sf_dir), "spearman").select("chrom_id", _r("value"))


def _scc(source: str) -> str:
    return f""", dg as (select c.chrom_id, d, count(*) filter (where x <> 0 or y <> 0) as n, {rho()} as r from {source} c join offs using (chrom_id) where d > 0 and d < least(61, n_bins) group by 1, 2)
select chrom_id, round(sum(coalesce(r, 0) * (n + 1) / 12.0::double) / sum((n + 1) / 12.0::double), 6) as value from dg where n >= 2 group by 1"""


@query(_two(_scc("cells")))
def scc_h0(spark, sf_dir):
    return compare.compare(*_pair(spark, sf_dir), "scc", max_dist=6000).select("chrom_id", _r("value"))


@query(_two(f""", sp as materialized (select c.chrom_id, i + a.k as i, j + b.k as j, sum(x) as x, sum(y) as y, any_value(first_bin) as lo, any_value(first_bin + n_bins - 1) as hi
  from cells c join offs using (chrom_id), unnest(generate_series(-1::bigint, 1)) a(k), unnest(generate_series(-1::bigint, 1)) b(k)
  where d > 0 and d < least(61, n_bins) and i + a.k >= first_bin and j + b.k < first_bin + n_bins and j + b.k >= i + a.k group by 1, 2, 3),
sm as materialized (select chrom_id, i, j, j - i as d, x / a as x, y / a as y from (select *, (least(i + 1, hi) - greatest(i - 1, lo) + 1) * (least(j + 1, hi) - greatest(j - 1, lo) + 1) as a from sp))""" + _scc("sm")))
def scc_h1(spark, sf_dir):
    return compare.compare(*_pair(spark, sf_dir), "scc", h=1, max_dist=6000).select("chrom_id", _r("value"))


@query(_two(f""", v as (select avg(r) as r from (select {rho()} as r from cells where d > 0 group by chrom_id))
select 'R' as label_i, 'R' as label_j, 1.0::double as value union all select 'N', 'N', 1.0 union all select 'R', 'N', round(r, 6) from v union all select 'N', 'R', round(r, 6) from v"""))
def compare_nxn(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return compare.compare_all({"R": a, "N": b}, "pearson").select("label_i", "label_j", _r("value"))


_U = lambda x: f"('0x' || substr(md5('1:' || bin1_id || ':' || bin2_id || ':' || {x}), 1, 13))::bigint / 4503599627370496.0::double"


@query(with_base(f""", {pixels(RETURNED, 'whole')}, pa as materialized (
  select bin1_id, bin2_id, count(*)::double as count from (select * from whole where count <= 64) w, unnest(generate_series(1::bigint, count::bigint)) t(i) where {_U("i")} < 0.5 group by 1, 2
  union all select bin1_id, bin2_id, greatest(0, least(count, round(count * 0.5 + sqrt(-2 * ln(greatest({_U("'n1'")}, 1e-12))) * cos(6.283185307179586 * {_U("'n2'")}) * sqrt(count * 0.25))))::double from whole where count > 64),
{pixels(KEPT, 'pb')}, {PAIR}{_scc("cells")}"""))
def scc_downsample(spark, sf_dir):
    """One matrix thinned to half of its contacts; a hash of the seed and the cell draws."""
    a, b = _pair(spark, sf_dir)
    return compare.compare(a.with_pixels(compare.downsample(a.pixels, 0.5, 1)), b, "scc", max_dist=6000).select("chrom_id", _r("value"))


# ---- validation ----


@query(with_base("select 'x' as \"check\", 'y' as detail from bins where false"))
def validate_clean(spark, sf_dir):
    m = _m(spark, sf_dir)
    return validate.issues(m.chroms, m.bins, m.pixels, {"nchroms": 5, "nbins": 1370})


@query(with_base("""select 'pixel_lower' as "check", bin2_id || ',' || bin1_id as detail from pixels where bin1_id % 211 = 7 and bin1_id <> bin2_id
union all select 'pixel_range', (bin1_id || ',' || (bin2_id + 5000)) from pixels where bin1_id % 307 = 3
union all select 'bin_beyond', bin_id::varchar from bins where bin_id % 400 = 10
union all select 'bin_interval', bin_id::varchar from bins where bin_id % 400 = 20
union all select 'chrom_length', name from chroms where chrom_id = 2
union all select 'bin_beyond', bin_id::varchar from bins where chrom_id = 2 and bin_id % 400 <> 10
union all select 'nbins', count(*)::varchar from bins"""))
def validate_corrupt(spark, sf_dir):
    m = _m(spark, sf_dir)
    chroms = m.chroms.withColumn("length", F.when(F.col("chrom_id") == 2, -1).otherwise(F.col("length")))
    k = F.col("bin_id") % 400
    bins = m.bins.withColumn("end", F.when(k == 10, 1_000_000).when(k == 20, F.col("start")).otherwise(F.col("end")))
    px = m.pixels
    low = px.where("bin1_id % 211 = 7 and bin1_id <> bin2_id").select(F.col("bin2_id").alias("bin1_id"), F.col("bin1_id").alias("bin2_id"), "count")
    far = px.where("bin1_id % 307 = 3").select("bin1_id", (F.col("bin2_id") + 5000).alias("bin2_id"), "count")
    return validate.issues(chroms, bins, px.unionByName(low).unionByName(far), {"nbins": 7})



# ---- callers, on the matrix of the tables that has domains ----


@query()
def tads_separation(spark, sf_dir):
    from ..operators.tads import separation

    _, found = separation.call_boundaries(_domains(spark, sf_dir))
    return found.select("chrom_id", "start", "end", "score", "delta", "p")


@query()
def tads_hierarchy(spark, sf_dir):
    from ..operators.tads import hierarchy

    return hierarchy.call_hierarchy(_domains(spark, sf_dir))


@query()
def tads_multires(spark, sf_dir):
    from ..operators.tads import multires

    return multires.call_multires(_domains(spark, sf_dir))[1]


@query()
def tads_blocks(spark, sf_dir):
    from ..operators.tads import blocks

    # a domain has 20 bins or more, the default asks for blocks of 60
    return blocks.call_blocks(_domains(spark, sf_dir), blocks.BlockParams(min_block=10))


@query()
def tads_directionality(spark, sf_dir):
    from ..operators.tads import directionality

    return directionality.call_domains(_domains(spark, sf_dir))[0]


@query()
def objective_weights(spark, sf_dir):
    from ..operators import objective

    return objective.normalize(_m(spark, sf_dir))


@query()
def tads_nested(spark, sf_dir):
    from ..operators.tads import nested

    return nested.call_nested({20_000: _domains(spark, sf_dir)})


@query()
def tads_aligned(spark, sf_dir):
    """Domains of the items returned against those of the others."""
    from ..operators.tads import alignment, nested

    a, b = (nested.call_nested({20_000: _domains(spark, sf_dir, flag=f)}) for f in ("R", "-"))
    return alignment.align(a, b, 20_000)


@query()
def tads_aligned_levels(spark, sf_dir):
    """The same, matches by level within pairs of top domains."""
    from ..operators.tads import alignment, nested

    a, b = (nested.call_nested({20_000: _domains(spark, sf_dir, flag=f)}) for f in ("R", "-"))
    return alignment.align_levels(a, b, 20_000)


# ---- text outputs and smaller functions ----


@query(with_base(f""", {CIS}{_Z}{_SCORE}, rows as (select s.chrom_id, b.start, b."end", score, ((b.start + b."end") // 2)::bigint as "to" from score s join offs o using (chrom_id) join bins b on b.bin_id = o.first_bin + s.cut),
spans as (select chrom_id, coalesce(lag("to") over (partition by chrom_id order by start), 0)::bigint as "from", "to", score from rows)
select chrom_id, "from", "to", round(score, 6) as score from spans where "to" > "from\""""))
def score_bedgraph(spark, sf_dir):
    from ..operators.tads import outputs

    cells, b = _cis(spark, sf_dir)
    s = bands.separation_score(bands.pooled_zscore(cells, b, 100, 40), b, [3, 5, 8])
    first = b.groupBy("chrom_id").agg(F.min("bin_id").alias("first"))
    rows = s.join(first, "chrom_id").join(b.select("bin_id", "start", "end"), F.col("bin_id") == F.col("first") + F.col("cut"))
    return outputs.score_bedgraph(rows).select("chrom_id", "from", "to", _r("score"))


@query(with_base("""select "check", detail from (select 'pixel_lower' as "check", bin2_id || ',' || bin1_id as detail, row_number() over (order by bin2_id || ',' || bin1_id) as k from pixels where bin1_id % 3 = 1 and bin1_id <> bin2_id) where k <= 20"""))
def validate_limit(spark, sf_dir):
    m = _m(spark, sf_dir)
    low = m.pixels.where("bin1_id % 3 = 1 and bin1_id <> bin2_id").select(F.col("bin2_id").alias("bin1_id"), F.col("bin1_id").alias("bin2_id"), "count")
    return validate.at_most(validate.issues(m.chroms, m.bins, low), 20)


@query(with_base("""select c1.name || chr(9) || b1.start || chr(9) || b1."end" || chr(9) || c2.name || chr(9) || b2.start || chr(9) || b2."end" || chr(9) || count::bigint as value
from pixels join bins b1 on b1.bin_id = bin1_id join bins b2 on b2.bin_id = bin2_id join chroms c1 on c1.chrom_id = b1.chrom_id join chroms c2 on c2.chrom_id = b2.chrom_id"""))
def pixel_lines(spark, sf_dir):
    return layout.pixel_text(_m(spark, sf_dir), coordinates=True).select("value")


@query(with_base("""select i, string_agg(v::bigint::varchar, chr(9) order by j) as value from (select a.i, b.j, coalesce(count, 0) as v
from unnest(generate_series(0::bigint, 199)) a(i), unnest(generate_series(0::bigint, 199)) b(j) left join pixels on bin1_id = least(i, j) and bin2_id = greatest(i, j)) group by 1"""))
def dense_lines(spark, sf_dir):
    return layout.dense_text(_m(spark, sf_dir), 0)


@query(with_base(""", o as (select *, max(n_bins) over () as most from offs), x as (select (b1.chrom_id + 1)::int as a, (b2.chrom_id + 1)::int as b, bin1_id - o1.first_bin as x, bin2_id - o2.first_bin as y, greatest(o1.n_bins, o2.n_bins) // 50 + 1 as cols
  from pixels join bins b1 on b1.bin_id = bin1_id join bins b2 on b2.bin_id = bin2_id join o o1 on o1.chrom_id = b1.chrom_id join o o2 on o2.chrom_id = b2.chrom_id)
select a, b, block, count(*)::bigint as n from (select a, b, case when a = b then floor(log2(1 + abs(x - y) / sqrt(2) / 50))::bigint * cols + (x + y) // 100 else (y // 50) * cols + x // 50 end as block from x) group by 1, 2, 3"""))
def hic_block_number(spark, sf_dir):
    from ..sources import hic

    m = _m(spark, sf_dir)
    off = M.chrom_offsets(m.chroms, 100).select("chrom_id", "first_bin", "n_bins")
    px = M.with_chroms(m.pixels, m.bins)
    for k in (1, 2):
        px = px.join(F.broadcast(off.select(F.col("chrom_id").alias(f"chrom_id{k}"), F.col("first_bin").alias(f"o{k}"), F.col("n_bins").alias(f"n{k}"))), f"chrom_id{k}")
    x, y = F.col("bin1_id") - F.col("o1"), F.col("bin2_id") - F.col("o2")
    cols = F.floor(F.greatest("n1", "n2") / 50).cast("long") + 1
    block = hic.block_number(x, y, F.col("chrom_id1") == F.col("chrom_id2"), cols, 50)
    return px.groupBy((F.col("chrom_id1") + 1).alias("a"), (F.col("chrom_id2") + 1).alias("b"), block.alias("block")).agg(F.count("*").alias("n"))


@query(with_base(f", {CIS} select chrom_id, arg_min(i, i % 3 * 1000000 + i) as pos from cis where d = 0 group by 1"))
def finest_resolution(spark, sf_dir):
    """The row of the finest resolution in each chromosome, the first of equals."""
    cells, _ = _cis(spark, sf_dir)
    rows = cells.where("d = 0").select("chrom_id", F.struct((100 + F.col("i") % 3 * 100).alias("res"), F.col("i").alias("pos")).alias("x"))
    return rows.groupBy("chrom_id").agg(F.min("x").alias("x")).select("chrom_id", "x.pos")

