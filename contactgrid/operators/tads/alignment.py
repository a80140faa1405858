"""Domains of two matrices side by side: best matches, reciprocal groups, what changed, and matches by level.

Bottom domains pick each other over the bounds of the other set, and what they pick is lifted to their top
domains; top domains that pick each other are a pair of groups.  Within a pair the domains of one side at a
level are set against the outermost domains of the other that lie where they match best, from both sides; what
both sides find holds.  A chromosome's domains are one task: thousands of rows at most.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int]
#: Domains under so many bins are passed over; bounds are sought as far around a position.
LEAST_BINS = 5


def overlap(a: Span, b: Span) -> float:
    """Common stretch over joint span."""
    inner = min(a[1], b[1]) - max(a[0], b[0])
    return inner / (max(a[1], b[1]) - min(a[0], b[0])) if inner > 0 else 0.0


def near_bounds(bounds: list[int], at: int, reach: int) -> range:
    """Places of the bounds around a position: that at it, or those on both sides of it, and to either side
    more of them up to the first at `reach` or beyond, one at least."""
    k = bisect_left(bounds, at)
    exact = k < len(bounds) and bounds[k] == at
    lo, hi = (k, k) if exact else (max(0, k - 1), min(k, len(bounds) - 1))
    far = lambda j: abs(at - bounds[j]) >= reach
    first, last = lo, hi
    while lo > 0 and (lo == first or not far(lo)):
        lo -= 1
    while hi < len(bounds) - 1 and (hi == last or not far(hi)):
        hi += 1
    return range(lo, hi + 1)


def best_match(span: Span, bounds: list[int], reach: int) -> Span | None:
    """The stretch between two bounds of the other set that overlaps best; of equals the later one."""
    if len(bounds) < 2:
        return None
    left, right = near_bounds(bounds, span[0], reach), near_bounds(bounds, span[1], reach)
    pairs = [(bounds[i], bounds[j]) for i in range(left[0], right[-1]) for j in range(i + 1, right[-1] + 1)]
    best = max(pairs, key=lambda p: (overlap(span, p), p), default=None)
    return best if best and overlap(span, best) > 0 else None


def holds(outer: Span, inner: Span) -> bool:
    return outer[0] <= inner[0] and inner[1] <= outer[1]


def bounds_of(spans: Iterable[Span]) -> list[int]:
    return sorted({x for s in spans for x in s})


@dataclass
class Nest:
    """Domains of a chromosome with their levels, a domain's children being those of the next level inside it."""

    level: dict[Span, int]

    @classmethod
    def of(cls, rows: Iterable[tuple[int, int, int]], least: int) -> Nest:
        return cls({(a, b): level for a, b, level in rows if b - a >= least})

    @cached_property
    def spans(self) -> list[Span]:
        return sorted(self.level)

    def inside(self, region: Span) -> list[Span]:
        k = bisect_left(self.spans, (region[0],))
        out = []
        while k < len(self.spans) and self.spans[k][0] < region[1]:
            if self.spans[k][1] <= region[1]:
                out.append(self.spans[k])
            k += 1
        return out

    @cached_property
    def children(self) -> dict[Span, list[Span]]:
        return {s: [c for c in self.inside(s) if self.level[c] == self.level[s] + 1] for s in self.spans}

    @cached_property
    def tops(self) -> list[Span]:
        return [s for s in self.spans if not self.level[s]]

    @cached_property
    def top_of(self) -> dict[Span, Span]:
        """The top domain of each bottom one."""
        return {s: top for top in self.tops for s in self.inside(top) if not self.children[s]}

    def within(self, region: Span) -> Nest:
        return Nest({s: self.level[s] for s in self.inside(region)})

    def at_level(self, level: int) -> list[Span]:
        """A cut through the nest: of each bottom domain what holds it at a level, or itself if it is less deep."""
        out = set()
        for leaf in self.spans:
            if not self.children[leaf]:
                around = [s for s in self.spans if holds(s, leaf)]
                deepest = max(self.level[s] for s in around)
                out |= {s for s in around if self.level[s] == (level if deepest >= level else deepest)}
        return sorted(out)

    def outermost(self, region: Span) -> set[Span]:
        """From the top down, the first domains that lie in a region, of those that reach into it."""
        out, todo = set(), list(self.tops)
        while todo:
            s = todo.pop()
            if holds(region, s):
                out.add(s)
            elif s[0] < region[1] and region[0] < s[1]:
                todo += self.children[s]
        return out


def hierarchy(spans: Iterable[Span]) -> dict[Span, int]:
    """Levels by how many others hold a span."""
    some = sorted(set(spans))
    return {s: sum(holds(o, s) for o in some) - 1 for s in some}


def groups(a: list[Span], b: list[Span], reach: int, up_a: Callable[[Span], Span] = lambda s: s, up_b: Callable[[Span], Span] = lambda s: s) -> list[tuple[list[Span], list[Span]]]:
    """Groups of domains that pick each other: d picks the domains within its best match.  up_a and up_b: what a
    domain stands for."""
    picks: list[set[tuple[Span, Span]]] = []
    for own, other, up, over in ((a, b, up_a, up_b), (b, a, up_b, up_a)):
        bounds, there = bounds_of(other), Nest(dict.fromkeys(other, 0))
        matched = ((d, best_match(d, bounds, reach)) for d in own)
        picks.append({(up(d), over(o)) for d, m in matched if m for o in there.inside(m)})
    together: dict[tuple[int, Span], set[tuple[int, Span]]] = {}
    for x, y in picks[0]:
        if (y, x) in picks[1]:
            left, right = (together.setdefault(v, {v}) for v in ((0, x), (1, y)))
            if left is not right:
                left |= right
                together.update(dict.fromkeys(right, left))
    whole = {id(g): g for g in together.values()}.values()
    return sorted(tuple(sorted(s for side, s in g if side == which) for which in (0, 1)) for g in whole)


def region_of(spans: list[Span]) -> Span:
    return spans[0][0], spans[-1][1]


@dataclass
class Pair:
    """Top domains set against each other.  levels: by the region on both sides, the domains that match there."""

    first: list[Span]
    second: list[Span]
    levels: dict[tuple[Span, Span], tuple[list[Span], list[Span]]] = field(default_factory=dict)

    def key(self) -> tuple[Span, Span]:
        return region_of(self.first), region_of(self.second)


def _opposite(own: list[Span], other: Nest, reach: int) -> list[Span]:
    """The outermost domains of the other side where those of one side match best."""
    bounds = bounds_of(other.spans)
    found = {o for d in own if (m := best_match(d, bounds, reach)) for o in other.outermost(m)}
    levels = hierarchy(found)
    return [s for s in sorted(found) if not levels[s]]


def one_way(a: Nest, b: Nest, reach: int, deep: bool = False) -> dict[tuple[Span, Span], Pair]:
    """Pairs of top domains, with matches by level as seen from a.

    The level search looks at what lies outermost only: of one top domain alone none of its inner domains is
    set against any.  deep: the cut at every level is looked at as if it lay outermost."""
    bottoms = [[s for s, level in hierarchy(x.top_of).items() if not level] for x in (a, b)]
    out = {}
    for x, y in groups(*bottoms, reach, lambda s: a.top_of[s], lambda s: b.top_of[s]):
        # whatever top domains lie between those that pick each other belong to the pair
        pair = Pair(*([t for t in n.tops if holds(region_of(g), t)] for n, g in ((a, x), (b, y))))
        own, other = (n.within(r) for n, r in zip((a, b), pair.key(), strict=True))
        for level in range(int(len(pair.first) == 1), max(own.level.values()) + 1):
            cut = own.at_level(level)
            some = cut if deep else [s for s in cut if not own.level[s]]
            against = _opposite(some, other, reach)
            for p, q in groups(some, against, reach):
                p, q = ([s for s in g if holds(region_of(m), s)] for g, m in ((cut, p), (against, q)))
                pair.levels[region_of(p), region_of(q)] = (p, q)
        out[pair.key()] = pair
    return out


def both_ways(a: Nest, b: Nest, reach: int, deep: bool = False) -> dict[tuple[Span, Span], Pair]:
    """The pairs that are found from both sides, with the matches by level that are."""
    there, back = one_way(a, b, reach, deep), one_way(b, a, reach, deep)
    out = {}
    for (x, y), pair in there.items():
        if (y, x) in back:
            seen = back[y, x].levels
            out[x, y] = Pair(pair.first, pair.second, {(p, q): m for (p, q), m in pair.levels.items() if (q, p) in seen})
    return out


def lower_changed(pair: Pair, own: Nest, other: Nest) -> bool:
    """Whether of one top domain against one any domain inside it is without a match of its own level."""
    if len(pair.first) > 1 or len(pair.second) > 1:
        return False
    same = {p[0] for p, q in pair.levels.values() if len(p) == len(q) == 1 and own.level[p[0]] == other.level[q[0]]}
    return any(own.level[s] and s not in same for s in own.inside(pair.first[0]))


def kinds(a: Nest, b: Nest, reach: int, deep: bool = False) -> Iterator[tuple[Pair, str]]:
    """conserved (one against one and nothing inside changed, seen from either side), inner (one against one
    otherwise), merged or split (many against one, one against many) or mixed."""
    back = both_ways(b, a, reach, deep)
    for (x, y), pair in both_ways(a, b, reach, deep).items():
        if len(pair.first) == len(pair.second) == 1:
            changed = lower_changed(pair, a, b) or (y, x) in back and lower_changed(back[y, x], b, a)
            yield pair, "inner" if changed else "conserved"
        else:
            yield pair, "mixed" if 1 not in (len(pair.first), len(pair.second)) else "split" if len(pair.first) == 1 else "merged"


def _by_chromosome(first: DataFrame, second: DataFrame, resolution: int, rows: Callable[[Nest, Nest], Iterable[tuple]], fields: str) -> DataFrame:
    reach = LEAST_BINS * resolution
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)), allowMissingColumns=True)
    both = both.select("chrom_id", "side", "start", "end", "level").where(F.col("end") - F.col("start") >= reach)
    names = ["chrom_id", *(f.split()[0] for f in fields.split(", "))]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        chrom = int(f["chrom_id"].iloc[0])
        sides = [Nest.of(((int(r.start), int(r.end), int(r.level)) for r in f[f["side"] == s].itertuples()), reach) for s in (0, 1)]
        return pd.DataFrame([(chrom, *r) for r in rows(*sides)], columns=names)

    return both.groupBy("chrom_id").applyInPandas(run, f"chrom_id int, {fields}")


def align(first: DataFrame, second: DataFrame, resolution: int, deep: bool = False) -> DataFrame:
    """(chrom_id, start1, end1, n1, start2, end2, n2, kind) of domains(chrom_id, start, end, level): groups of top
    domains with the numbers of these, and how they changed.  Domains under five bins are passed over; chromosomes
    that one side lacks give no row."""
    reach = LEAST_BINS * resolution

    def rows(a: Nest, b: Nest) -> Iterator[tuple]:
        for pair, kind in kinds(a, b, reach, deep):
            (s1, e1), (s2, e2) = pair.key()
            yield s1, e1, len(pair.first), s2, e2, len(pair.second), kind

    return _by_chromosome(first, second, resolution, rows, "start1 long, end1 long, n1 int, start2 long, end2 long, n2 int, kind string")


def align_levels(first: DataFrame, second: DataFrame, resolution: int, deep: bool = True) -> DataFrame:
    """(chrom_id, top_start, top_end, level, start1, end1, n1, start2, end2, n2): within each pair of groups of align,
    matches of domains that both sides find; level is the least of the first side's."""
    reach = LEAST_BINS * resolution

    def rows(a: Nest, b: Nest) -> Iterator[tuple]:
        for (top, _), pair in both_ways(a, b, reach, deep).items():
            for ((s1, e1), (s2, e2)), (p, q) in pair.levels.items():
                yield *top, min(a.level[s] for s in p), s1, e1, len(p), s2, e2, len(q)

    return _by_chromosome(first, second, resolution, rows, "top_start long, top_end long, level int, start1 long, end1 long, n1 int, start2 long, end2 long, n2 int")
