"""Mixing sources to target weights by iterative proportional fitting.

The tokens of every cell (source, language, topic) are summed once; raking fits the cells' weights to
the target share of each margin in turn until all hold; the ratio of fitted to own weight, scaled to
the tokens wanted, is the probability by which a document is drawn.  Categories without a target are
folded to one per margin that keeps its own share, so the number of cells is bounded by the targets
given, whatever the data.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

OTHER = "(other)"
#: Production parameters of the query: shares of the tokens.  Each source has its own; src0 is the largest.
TARGETS = {
    "source": {"src0": 0.24} | {f"src{k}": 0.04 for k in range(1, 20)},
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2},
    "topic": {"short": 0.2, "medium": 0.3, "long": 0.5},
}
SHARE = 0.7
_UNIT = 1 << 52


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_topic(n: Column) -> Column:
    """The tables carry no topic; a text's length band stands in for it."""
    return F.when(n < 200, "short").when(n < 1000, "medium").otherwise("long")


def drawn(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) that the seed and the id decide."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(_UNIT)


def rake(mass: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], rounds: int = 200, within: float = 1e-13) -> np.ndarray:
    """Cell weights of the total 1 whose sums over each margin (category of each cell, target share of
    each category) are the targets.  Categories without mass lose their target to the others."""
    w = mass / mass.sum()
    fixed = []
    for category, share in margins:
        own = np.bincount(category, weights=w, minlength=len(share))
        share = np.where(own > 0, share, 0.0)
        fixed.append((category, share / share.sum()))
    for _ in range(rounds):
        off = 0.0
        for category, share in fixed:
            sums = np.bincount(category, weights=w, minlength=len(share))
            off = max(off, np.abs(sums - share).max())
            w = w * np.divide(share, sums, out=np.zeros_like(share), where=sums > 0)[category]
        if off < within:
            break
    return w


def probabilities(mass: np.ndarray, weight: np.ndarray, share: float) -> np.ndarray:
    """min(1, s * weight / mass) with s such that `share` of all tokens is expected."""
    ratio = np.divide(weight, mass, out=np.zeros_like(weight), where=mass > 0)
    order = np.argsort(-ratio, kind="stable")
    m, w, r = mass[order], weight[order], ratio[order]
    before, rest = np.cumsum(m) - m, np.cumsum(w[::-1])[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (share * mass.sum() - before) / rest
        fits = np.flatnonzero((s * r <= 1) & (rest > 0))
    return np.minimum(1.0, (s[fits[0]] if len(fits) else np.inf) * np.where(ratio > 0, ratio, 0.0)) if len(fits) else np.where(ratio > 0, 1.0, 0.0)


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", seed: str = "mix") -> DataFrame:
    """`docs` with mix_tokens, mix_topic, mix_probability, mix_weight and mix_kept.

    targets: column of `docs`, or "topic", to the shares of its categories.  "topic" is always the length
    band, as mix_topic has it; a column of that name is not read, so give it another to mix by it.  Categories it doesn't name
    (null ones too) keep their share of the tokens together, and the named ones share the rest in
    proportion.  mix_weight is what a drawn document still weighs where its probability is held at 1.
    Null and empty texts have no tokens and are drawn with their cell's probability; a cell without
    tokens has the probability `share`.  Rows with one id are drawn alike.  An empty table gives an
    empty table.  Columns named mix_... are replaced, all others stay as they are."""
    spark = docs.sparkSession
    rows = docs.withColumn("mix_tokens", token_count(F.col(text_col))).withColumn("mix_topic", length_topic(F.col("mix_tokens")))
    names, cells = list(targets), []
    for k, name in enumerate(names):
        value = F.col("mix_topic") if name == "topic" else F.col(name).cast("string")
        cells.append(F.when(value.isin(*targets[name]), value).otherwise(OTHER).alias(f"mix_c{k}"))
    keys = [f"mix_c{k}" for k in range(len(names))]
    rows = rows.select("*", *cells)
    found = sorted(rows.groupBy(*keys).agg(F.sum("mix_tokens").alias("mass")).collect())  # at most the product of the targets' sizes
    mass = np.array([r.mass for r in found], dtype=np.float64)
    p, left = np.full(len(found), share), np.ones(len(found))
    if mass.sum() > 0:
        margins = []
        for k, name in enumerate(names):
            labels = [*targets[name], OTHER]
            category = np.array([labels.index(r[k]) for r in found])
            own = mass[category == len(labels) - 1].sum() / mass.sum()
            named = np.array([*targets[name].values()], dtype=np.float64)
            present = np.bincount(category, weights=mass, minlength=len(labels))[:-1] > 0
            named = np.where(present, named, 0.0)
            # a partial list leaves its remainder to the others; a full one is scaled to what they leave
            whole = sum(targets[name].values())
            rest = max(0.0, 1 - whole) if whole < 1 - 1e-9 else own
            if not own:
                rest = 0.0
            named = named / named.sum() * (1 - rest) if named.sum() else named
            margins.append((category, np.array([*named, rest])))
        weight = rake(mass, margins)
        p = np.where(mass > 0, probabilities(mass, weight, share), share)
        ratio = np.divide(weight * mass.sum(), mass, out=np.ones_like(mass), where=mass > 0)
        scale = max((pp / rr for pp, rr in zip(p, ratio, strict=True) if rr > 0 and pp < 1), default=1.0)
        left = np.where(p > 0, np.maximum(1.0, ratio * scale / np.where(p > 0, p, 1)), 0.0)
    table = spark.createDataFrame([(*r[: len(keys)], float(a), float(b)) for r, a, b in zip(found, p, left, strict=True)], ", ".join([*(f"{k} string" for k in keys), "mix_probability double", "mix_weight double"]))
    out = rows.join(F.broadcast(table), keys).drop(*keys)
    return out.withColumn("mix_kept", drawn(F.col(id_col), seed) < F.col("mix_probability"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's probability and whether it is drawn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = mixed(docs)
    return out.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_probability", 6).alias("probability"), F.round("mix_weight", 6).alias("weight"), F.col("mix_kept").alias("kept"))


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn."""
    return mixed(docs).where("mix_kept").select(*docs.columns)


def _sql(rounds: int = 40) -> str:
    source = ", ".join(f"('{k}', {v}::double)" for k, v in TARGETS["source"].items())
    lang = ", ".join(f"('{k}', {v}::double)" for k, v in TARGETS["lang"].items())
    topic = ", ".join(f"('{k}', {v}::double)" for k, v in TARGETS["topic"].items())
    parts = [f"""t0(k, s) as (values {source}), docs as materialized (
  select doc_id, source, lang, n_tokens, case when n_tokens < 200 then 'short' when n_tokens < 1000 then 'medium' else 'long' end as topic
  from (select doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens from documents)),
keyed as materialized (
  select *, case when source in (select k from t0) then source else '{OTHER}' end as c0,
    case when lang in ('en', 'de', 'fr', 'es') then lang else '{OTHER}' end as c1, topic as c2 from docs),
cells as materialized (select c0, c1, c2, sum(n_tokens)::double as mass from keyed group by 1, 2, 3),
t1(k, s) as (values {lang}), t2(k, s) as (values {topic}),
o0 as (select coalesce(sum(mass) filter (c0 = '{OTHER}'), 0) / sum(mass) as own from cells),
f0 as (select k, s / sum(s) over () * (1 - own) as s from t0, o0 where k in (select c0 from cells where mass > 0)
  union all select '{OTHER}', own from o0 where own > 0),
o1 as (select coalesce(sum(mass) filter (c1 = '{OTHER}'), 0) / sum(mass) as own from cells),
f1 as (select k, s / sum(s) over () * (1 - own) as s from t1, o1 where k in (select c1 from cells where mass > 0)
  union all select '{OTHER}', own from o1 where own > 0),
f2 as (select k, s / sum(s) over () as s from t2 where k in (select c2 from cells where mass > 0)),
w0 as materialized (select *, mass / sum(mass) over () as w from cells)"""]
    n = 0
    for _ in range(rounds):
        for m in range(3):
            parts.append(f"w{n + 1} as materialized (select w.c0, w.c1, w.c2, w.mass, w.w * f.s / sum(w.w) over (partition by w.c{m}) as w from w{n} w join f{m} f on f.k = w.c{m})")
            n += 1
    parts.append(f"""ranked as materialized (
  select *, w / mass as r, sum(mass) over (order by w / mass desc, c0, c1, c2 rows unbounded preceding) - mass as before,
    sum(w) over (order by w / mass desc, c0, c1, c2 rows between current row and unbounded following) as rest,
    sum(mass) over () as total from w{n} where mass > 0),
scale as (select max(s) as s from (select ({SHARE}::double * total - before) / rest as s, r from ranked) where s * r <= 1),
chance as materialized (select c0, c1, c2, least(1, s * r) as p, greatest(1, s * r) as left_over from ranked, scale)""")
    return "with " + ",\n".join(parts) + f"""
select doc_id, source, lang, topic, n_tokens, round(coalesce(p, {SHARE}), 6) as probability, round(coalesce(left_over, 1), 6) as weight,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / {_UNIT}::double < coalesce(p, {SHARE}) as kept
from keyed left join chance using (c0, c1, c2)"""


OP3_SQL = _sql()
