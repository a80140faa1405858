"""DuckDB SQL over the star-schema tables: common table expressions the query pairs share."""

from __future__ import annotations


def base(where: str = "true", name: str = "pixels") -> str:
    """chroms, offs, bins and a table of pixels, in integer arithmetic."""
    return f"""chroms as materialized (select r_regionkey::int as chrom_id, r_name as name, (20000 + 3700 * r_regionkey)::int as length from region),
offs as materialized (select *, (sum(n_bins) over (order by chrom_id) - n_bins)::bigint as first_bin from (select *, ((length + 99) // 100)::bigint as n_bins from chroms)),
bins as materialized (select first_bin + k as bin_id, chrom_id, (k * 100)::int as start, least(k * 100 + 100, length)::int as "end" from offs, unnest(generate_series(0::bigint, n_bins - 1)) t(k)),
""" + pixels(where, name)


def pixels(where: str = "true", name: str = "pixels") -> str:
    return f"""{name} as materialized (
  select least(b1, b2) as bin1_id, greatest(b1, b2) as bin2_id, count(*)::double as count from (
    select o1.first_bin + pos1 // 100 as b1, o2.first_bin + case when trans then b % o2.length else (pos1 + step) % o1.length end // 100 as b2
    from (select *, (a % length) as pos1 from (
      select (l_partkey % 5)::int as c1, case when l_linenumber = 7 then ((l_partkey % 5)::int + 1) % 5 else (l_partkey % 5)::int end as c2, l_linenumber = 7 as trans,
        l_partkey * 7919 + l_orderkey as a, l_suppkey * 31 as b, l_quantity::bigint * l_linenumber * 10 as step
      from lineitem where {where}) x join chroms on chrom_id = c1) y
    join offs o1 on o1.chrom_id = c1 join offs o2 on o2.chrom_id = c2)
  group by 1, 2)"""


CIS = """cis as materialized (select b1.chrom_id, bin1_id - o.first_bin as i, bin2_id - o.first_bin as j, bin2_id - bin1_id as d, count as v
  from pixels join bins b1 on b1.bin_id = bin1_id join bins b2 on b2.bin_id = bin2_id and b2.chrom_id = b1.chrom_id join offs o on o.chrom_id = b1.chrom_id)"""

PAIR = """pair as materialized (select coalesce(a.bin1_id, b.bin1_id) as bin1_id, coalesce(a.bin2_id, b.bin2_id) as bin2_id, coalesce(a.count, 0) as x, coalesce(b.count, 0) as y
  from pa a full join pb b using (bin1_id, bin2_id)),
cells as materialized (select b1.chrom_id, bin1_id as i, bin2_id as j, bin2_id - bin1_id as d, x, y from pair join bins b1 on b1.bin_id = bin1_id join bins b2 on b2.bin_id = bin2_id and b1.chrom_id = b2.chrom_id)"""

RETURNED, KEPT = "l_returnflag = 'R'", "l_returnflag <> 'R'"


def with_base(rest: str, where: str = "true") -> str:
    return f"with recursive {base(where)}{rest}"


def rho(x: str = "x", y: str = "y") -> str:
    """Pearson's r from six sums over rows where not both are zero."""
    f = f"filter (where {x} <> 0 or {y} <> 0)"
    n, sx, sy = f"nullif(count(*) {f}, 0)", f"sum({x}) {f}", f"sum({y}) {f}"
    vx, vy = f"(sum({x} * {x}) {f} - {sx} * {sx} / {n})", f"(sum({y} * {y}) {f} - {sy} * {sy} / {n})"
    return f"case when count(*) {f} >= 2 and {vx} > 0 and {vy} > 0 then greatest(-1, least(1, (sum({x} * {y}) {f} - {sx} * {sy} / {n}) / nullif(sqrt({vx} * {vy}), 0))) end"


def ice(rounds: int, mode: str = "all", diags: int = 2, filters: bool = False) -> str:
    """Unrolled balancing without convergence test; mode all, cis or trans."""
    where = {"all": "true", "cis": "b1.chrom_id = b2.chrom_id", "trans": "b1.chrom_id <> b2.chrom_id"}[mode]
    share = "1.0::double" if mode != "trans" else "1.0::double / (1.0::double - n_bins::double / (select count(*) from bins))"
    by = "chrom_id" if mode == "cis" else "1"
    parts = [f"""px as materialized (select p.* from pixels p join bins b1 on b1.bin_id = bin1_id join bins b2 on b2.bin_id = bin2_id where bin2_id - bin1_id >= {diags} and {where})"""]
    mask = "1.0::double"
    if filters:
        keep = "where b1.chrom_id = b2.chrom_id" if mode == "cis" else ""
        parts.append(f"""fx as materialized (select p.* from pixels p join bins b1 on b1.bin_id = bin1_id join bins b2 on b2.bin_id = bin2_id {keep}),
raw as materialized (select b.bin_id, b.chrom_id, coalesce(sum(v), 0) as marg, count(v) as nnz from bins b left join (
  select bin1_id as bin_id, count as v from fx where bin2_id - bin1_id >= {diags} union all select bin2_id, count from fx where bin2_id - bin1_id >= {diags}) m using (bin_id) group by 1, 2),
med as materialized (select chrom_id, median(marg) as m from raw where marg > 0 group by 1),
lg as materialized (select ln(marg / m) as l from raw join med using (chrom_id) where marg > 0),
cut as materialized (select exp(any_value(mm) - 5 * median(abs(l - mm))) as c from (select l, (select median(l) from lg) as mm from lg)),
mask as materialized (select bin_id, case when nnz < 10 or marg < c then 0.0 else 1.0 end::double as m0 from raw, cut)""")
        mask = "(select m0 from mask where mask.bin_id = bins.bin_id)"
    parts.append(f"bias0 as materialized (select bin_id, bins.chrom_id, {share} as share, {mask} as bias from bins join offs using (chrom_id))")
    for k in range(rounds):
        parts.append(f"""m{k} as materialized (select b.bin_id, b.chrom_id, b.share, b.bias, coalesce(sum(v), 0) as marg from bias{k} b left join (
  select unnest([bin1_id, bin2_id]) as bin_id, count * x.bias * x.share * y.bias * y.share as v from px join bias{k} x on x.bin_id = bin1_id join bias{k} y on y.bin_id = bin2_id where x.bias <> 0 and y.bias <> 0) e using (bin_id) group by 1, 2, 3, 4),
s{k} as materialized (select *, avg(marg) filter (where marg <> 0) over (partition by {by}) as mean from m{k}),
bias{k + 1} as materialized (select bin_id, chrom_id, share, bias / case when marg = 0 then 1 else marg / mean end as bias from s{k})""")
    return ",\n".join(parts) + f"\nselect b.bin_id, round(nullif(b.bias, 0) / sqrt(s.mean), 6) as weight from bias{rounds} b join s{rounds - 1} s using (bin_id)"


def with_domains(rest: str, where: str = "true", bin_size: int = 20_000) -> str:
    """The matrix of the tables that has domains: dchroms, doffs and dpixels; a domain has w bases."""
    at = lambda n: f"(case when mode < 4 then dom * w + side * (w // 2) + {n} % (w // 2) when mode < 8 then dom * w + {n} % w else {n} % (w * 8) end)"
    return f"""with dchroms as materialized (select r_regionkey::int as chrom_id, r_name as name, ((20 + 2 * r_regionkey) * 20000)::bigint as w, ((20 + 2 * r_regionkey) * 160000)::int as length from region),
doffs as materialized (select *, (sum(n_bins) over (order by chrom_id) - n_bins)::bigint as first_bin from (select *, (length // {bin_size})::bigint as n_bins from dchroms)),
dpixels as materialized (select first_bin + least(x, y) as bin1_id, first_bin + greatest(x, y) as bin2_id, count(*)::double as count from (
  select first_bin, {at("n1")} // {bin_size} as x, {at("n2")} // {bin_size} as y from (
    select *, b % 10 as mode, a % 8 as dom, a // 8 % 2 as side, a // 16 as n1, b // 10 as n2 from (
      select (l_partkey % 5)::int as chrom_id, l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 15485863 as a, l_suppkey * 32452843 + l_orderkey * 49979687 + l_linenumber * 611953 as b from lineitem where {where})
    join doffs using (chrom_id))) group by 1, 2){rest}"""
