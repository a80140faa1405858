"""Alignment of domain sets, against the definitions tried out one by one."""

import random

import pytest

from contactgrid.operators.tads import alignment as A

REACH = 50


def tree(rng):
    """Top domains side by side with gaps, split at random down to three levels."""
    rows, at = [], 0

    def split(lo, hi, level):
        rows.append((lo, hi, level))
        if level < 2 and hi - lo >= 4 * REACH and rng.random() < 0.6:
            cuts = sorted(rng.sample(range(lo + REACH, hi - REACH, 10), rng.choice([1, 1, 2])))
            for a, b in zip([lo, *cuts], [*cuts, hi], strict=True):
                if rng.random() < 0.85:
                    split(a, b, level + 1)

    while at < 4000:
        size = rng.choice([60, 120, 300, 500, 900])
        split(at, at + size, 0)
        at += size + rng.choice([0, 0, 0, 40, 200])
    return rows


def shaken(rng, rows):
    out = {}
    for a, b, level in rows:
        if rng.random() < 0.85:
            move = lambda: rng.choice([0, 0, 0, 10, -10, 30])
            a, b = max(0, a + move()), b + move()
            out[a, b] = level
    spans = sorted(out)
    # levels by holders, so that the set is a nest again
    return [(a, b, sum(s <= a and b <= e and (s, e) != (a, b) for s, e in spans)) for a, b in spans]


def within(x, region):
    return region[0] <= x[0] and x[1] <= region[1]


def match(span, bounds):
    """Of all stretches between bounds that lie near enough to the span's ends, the best one, the later of equals."""
    def near(at):
        k = [j for j, b in enumerate(bounds) if b == at]
        if k:
            core = {k[0]}
        else:
            below, above = [j for j, b in enumerate(bounds) if b < at], [j for j, b in enumerate(bounds) if b > at]
            core = {below[-1]} if below else set()
            core |= {above[0]} if above else set()
        lo, hi = min(core), max(core)
        some = set(core)
        for side in (range(lo - 1, -1, -1), range(hi + 1, len(bounds))):
            for j in side:
                some.add(j)
                if abs(bounds[j] - at) >= REACH:
                    break
        return some

    if len(bounds) < 2:
        return None
    lo, hi = min(near(span[0])), max(near(span[1]))
    best, found = 0.0, None
    for i in range(lo, hi):
        for j in range(i + 1, hi + 1):
            inner = min(span[1], bounds[j]) - max(span[0], bounds[i])
            score = inner / (max(span[1], bounds[j]) - min(span[0], bounds[i])) if inner > 0 else 0.0
            if score > 0 and (score, (bounds[i], bounds[j])) > (best, found or (-1, -1)):
                best, found = score, (bounds[i], bounds[j])
    return found


def components(a, b, up_a, up_b):
    def picks(own, other):
        bounds = sorted({x for s in other for x in s})
        return {(d, o) for d in own if (m := match(d, bounds)) for o in other if within(o, m)}

    there = {(up_a(x), up_b(y)) for x, y in picks(a, b)}
    back = {(up_a(x), up_b(y)) for y, x in picks(b, a)}
    links, out = there & back, []
    while links:
        x, y = next(iter(links))
        left, right = {x}, {y}
        while True:
            more = {k for k in links if k[0] in left or k[1] in right}
            if {k[0] for k in more} == left and {k[1] for k in more} == right:
                break
            left, right = {k[0] for k in more}, {k[1] for k in more}
        links -= more
        out.append((sorted(left), sorted(right)))
    return sorted(out)


class Brute:
    def __init__(self, rows):
        self.level = {(a, b): level for a, b, level in rows if b - a >= REACH}
        self.spans = sorted(self.level)

    def kids(self, s, of=None):
        return [c for c in (of or self.spans) if within(c, s) and self.level[c] == self.level[s] + 1]

    def bottoms(self):
        leaf = {s: t for t in self.spans if self.level[t] == 0 for s in self.spans if within(s, t) and not self.kids(s)}
        return {s: t for s, t in leaf.items() if not any(within(s, o) and o != s for o in leaf)}, leaf


def pairs(a, b, deep):
    (own, up_a), (other, up_b) = a.bottoms(), b.bottoms()
    out = {}
    for x, y in components(list(own), list(other), up_a.get, up_b.get):
        regions = [(g[0][0], g[-1][1]) for g in (x, y)]
        first, second = ([s for s in n.spans if n.level[s] == 0 and within(s, r)] for n, r in zip((a, b), regions, strict=True))
        r1, r2 = ((g[0][0], g[-1][1]) for g in (first, second))
        here, there = [s for s in a.spans if within(s, r1)], [s for s in b.spans if within(s, r2)]
        levels = {}
        for level in range(1 if len(first) == 1 else 0, max(a.level[s] for s in here) + 1):
            cut = set()
            for leaf in here:
                if not a.kids(leaf, here):
                    line = [s for s in here if within(leaf, s)]
                    deepest = max(a.level[s] for s in line)
                    cut |= {s for s in line if a.level[s] == min(level, deepest)}
            some = sorted(s for s in cut if deep or a.level[s] == 0)
            bounds = sorted({x for s in there for x in s})
            hit = set()
            for d in some:
                m = match(d, bounds)
                if m:
                    stack = [s for s in there if b.level[s] == 0]
                    while stack:
                        s = stack.pop()
                        if within(s, m):
                            hit.add(s)
                        elif s[0] < m[1] and m[0] < s[1]:
                            stack += b.kids(s, there)
            hit = sorted(s for s in hit if not any(within(s, o) and o != s for o in hit))
            for p, q in components(some, hit, lambda s: s, lambda s: s):
                p, q = (sorted(s for s in g if within(s, (m[0][0], m[-1][1]))) for g, m in ((cut, p), (hit, q)))
                levels[(p[0][0], p[-1][1]), (q[0][0], q[-1][1])] = (p, q)
        out[r1, r2] = (first, second, levels)
    return out


@pytest.mark.parametrize("deep", [False, True])
def test_as_definitions(deep):
    rng = random.Random(8)
    seen = {k: 0 for k in ("conserved", "inner", "merged", "split", "mixed")}
    matched = 0
    for _ in range(60):
        rows = tree(rng)
        other = shaken(rng, rows) if rng.random() < 0.8 else tree(rng)
        a, b, x, y = A.Nest.of(rows, REACH), A.Nest.of(other, REACH), Brute(rows), Brute(other)
        got = A.one_way(a, b, REACH, deep)
        want, back = pairs(x, y, deep), pairs(y, x, deep)
        assert {k: (p.first, p.second, p.levels) for k, p in got.items()} == want
        both = {k: (p.first, p.second, p.levels) for k, p in A.both_ways(a, b, REACH, deep).items()}
        kept = {k: (f, s, {m: v for m, v in levels.items() if m[::-1] in back[k[::-1]][2]}) for k, (f, s, levels) in want.items() if k[::-1] in back}
        assert both == kept
        kinds = {p.key(): kind for p, kind in A.kinds(a, b, REACH, deep)}
        for key, (f, s, _) in kept.items():
            if len(f) == len(s) == 1:
                changed = False
                for n, o, of, levels in ((x, y, f[0], kept[key][2]), (y, x, s[0], {m[::-1]: v[::-1] for m, v in kept[key][2].items()} if deep else {})):
                    inner = {d for d in n.spans if within(d, of) and n.level[d] > 0}
                    fine = {p[0] for p, q in levels.values() if len(p) == len(q) == 1 and n.level[p[0]] == o.level[q[0]]}
                    changed |= not inner <= fine
                assert kinds[key] == ("inner" if changed else "conserved")
            else:
                assert kinds[key] == ("split" if len(f) == 1 else "merged" if len(s) == 1 else "mixed")
            seen[kinds[key]] += 1
            matched += len(kept[key][2])
    assert all(seen.values()) and (matched > 50 or not deep)


def test_levels_of_a_merged_domain(spark):
    frame = lambda rows: spark.createDataFrame(rows, "chrom_id int, start long, end long, level int")
    a = frame([(0, 0, 100, 0), (0, 100, 200, 0), (1, 0, 90, 0)])
    b = frame([(0, 0, 200, 0), (0, 0, 100, 1), (0, 100, 200, 1), (2, 0, 90, 0)])
    assert [tuple(r) for r in A.align(a, b, 10).collect()] == [(0, 0, 200, 2, 0, 200, 1, "merged")]
    assert A.align_levels(a, b, 10, deep=False).collect() == []
    got = sorted(tuple(r) for r in A.align_levels(a, b, 10).collect())
    assert got == [(0, 0, 200, 0, 0, 100, 1, 0, 100, 1), (0, 0, 200, 0, 100, 200, 1, 100, 200, 1)]
    assert {r.kind for r in A.align(b, b, 10, deep=True).collect()} == {"conserved"}
    assert {(r.chrom_id, r.kind) for r in A.align(b, b, 10).collect()} == {(0, "inner"), (2, "conserved")}
    assert A.align(a.limit(0), b, 10).collect() == []
