import numpy as np
import pytest

from contactgrid.functions.models import HMM, Discrete, Mixture, Normal
from contactgrid.operators.tads import alignment, blocks, directionality, hierarchy, multires, nested, outputs, separation
from contactgrid.schema import MatrixError
from contactgrid.sources.contacts import toy_matrix


@pytest.fixture(scope="module")
def toy(spark):
    return toy_matrix(spark, domains=6, width=20, bin_size=20_000, n_chroms=1)


def test_separation(toy):
    scores, found = separation.call_boundaries(toy)
    assert [r.start for r in found.orderBy("row").collect()] == [k * 400_000 for k in range(1, 6)]
    spans = separation.domains_between(found).orderBy("start").collect()
    assert [(r.start, r.end) for r in spans] == [(k * 400_000, (k + 1) * 400_000) for k in range(1, 5)] and len({r.rgb for r in spans}) == 2
    assert [r.name for r in spans] == [f"ID_0.01_{k}" for k in range(1, 5)]
    lines = outputs.boundary_lines(scores, found, toy.chroms).orderBy("row").collect()
    for k, r in enumerate(lines, 1):
        bed, gff = r.bed.split("\t"), r.gff.split("\t")
        assert bed[:4] == ["toy1", str(k * 400_000 - 10_000), str(k * 400_000 + 10_000), f"B{20 * k:05d}"] and gff[3:5] == bed[1:3]
        assert gff[8].startswith(f"ID=B{20 * k:05d};delta=") and gff[8].endswith(f"tad_sep={bed[4]}")
    table = outputs.score_table(scores, toy.chroms).orderBy("bin").collect()
    d = separation.depths(20_000)
    assert len(table) == 120 and all(len(r.value.split("\t")) == 3 + len(d.windows) for r in table)
    assert table[20].value.split("\t")[:3] == ["toy1", "400000", "420000"]
    assert outputs.score_header(20_000, d.min_depth, d.max_depth, d.step) == '#{"step":40000,"minDepth":100000,"maxDepth":200000,"binsize":20000}'


def test_zscore_matrix(toy):
    """Each cell by the cells of its distance; the band that windows read."""
    d = separation.depths(20_000)
    z = separation.zscore_matrix(toy, d)
    got = {(r.bin1_id, r.bin2_id): r["count"] for r in z.pixels.collect()}
    assert z.bins.count() == 120 and max(b - a for a, b in got) < d.band
    v = lambda a, b: 50.0 if a // 20 == b // 20 else 2.0
    for k in (1, 7, 15):
        pool = np.array([v(a, a + k) for a in range(120 - k)])
        for a in range(120 - k):
            want = (pool[a] - pool.mean()) / pool.std()
            assert got[a, a + k] == pytest.approx(want, abs=1e-9)


def test_multiscale_lines(toy):
    ensemble, _ = multires.call_multires(toy, multires.MultiresParams(gamma_max=0.5, step=0.5, top_k=2, min_mean_samples=1))
    rows = outputs.multiscale_lines(ensemble, toy.chroms, 20_000).collect()
    assert {(r.gamma, r["rank"]) for r in rows} == {(0.0, 0), (0.0, 1), (0.5, 0), (0.5, 1)}
    best = sorted((r.start_bin, r.value) for r in rows if (r.gamma, r["rank"]) == (0.5, 0))
    assert best == [(20 * k, f"toy1\t{400_000 * k}\t{400_000 * (k + 1) - 1}") for k in range(6)]


def settled(y, lookahead, chrom):
    """Turning points by the definition: from each settled place on, every later place is tried in turn."""
    out, starts = [], [k for k in range(len(y)) if k == 0 or chrom[k] != chrom[k - 1]] + [len(y)]
    for a, b in zip(starts, starts[1:], strict=False):
        at, sides = a, (-1, 1)
        while True:
            hit = None
            for t in range(at + 1, min(b, len(y) - lookahead)):
                for side in sides:  # peaks first
                    past, ahead = [side * y[k] for k in range(at, t)], [side * y[k] for k in range(t, t + lookahead)]
                    if hit is None and min(past) < min(ahead):
                        hit = (t, side, at + past.index(min(past)))
                if hit:
                    break
            if not hit:
                break
            at, sides = hit[0], (-hit[1],)
            out.append((hit[1] == 1, hit[2]))
    return [k for valley, k in out[1:] if valley]


def test_minima_by_definition(spark):
    rng = np.random.default_rng(4)
    for lookahead in (1, 3, 5):
        sizes = [0, 40, 2, 1, 90, 4, 30, 3]
        chrom = [c for c, n in enumerate(sizes) for _ in range(n)]
        y = np.round(np.cumsum(rng.normal(size=len(chrom))), 1)
        where = [k - chrom.index(c) for k, c in enumerate(chrom)]
        rows = [(c, int(k), int(k) * 10, int(k) * 10 + 10, float(v), None) for c, k, v in zip(chrom, where, y, strict=True)]
        scores = spark.createDataFrame(rows, "chrom_id int, bin long, start long, end long, score double, p double")
        got = separation.minima(scores, lookahead).orderBy("row").collect()
        assert [r.row for r in got] == settled(y.tolist(), lookahead, chrom) and len(got) > 5
        for r in got:
            own, k = [v for c, v in zip(chrom, y, strict=True) if c == r.chrom_id], where[r.row]
            last = len(own) - (r.chrom_id == 7)
            want = np.mean(own[k - 10 : k + 3] + own[k + 4 : k + 10]) - own[k] if 10 <= k and k + 10 < last else None
            assert (r.delta is None) == (want is None) and (want is None or abs(r.delta - want) < 1e-9)
    long = np.tile([0.0, 5.0], 20_000)
    assert len(separation.turns(long, np.zeros(0), 1)) > 39_000


def test_separation_leaves_masked_bins_out(spark, toy):
    """Bins without a finite weight are skipped, the others numbered anew and moved together; scores are
    those of the matrix without them, and gaps at block edges leave the boundaries half way over them."""
    masked = {7, 40, 41, 79}
    weights = spark.createDataFrame([(k, None if k == 7 else float("nan") if k in masked else 0.5) for k in range(120)], "bin_id long, value double")
    m = toy.set_bin_column("w", weights)
    d = separation.depths(20_000)
    rows = {r.bin: r for r in separation.score_chromosomes(m, d, "w").collect()}
    assert len(rows) == 116 and sorted(rows) == list(range(116))
    assert rows[6].end == rows[7].start == 150_000 and rows[38].end == rows[39].start == 820_000
    left = [k for k in range(120) if k not in masked]
    x = np.zeros((116, 116))
    for a in range(116):
        for b in range(a + 1, 116):
            x[a, b] = 0.25 * (50.0 if left[a] // 20 == left[b] // 20 else 2.0)
    keys = np.array([[(left[b] - left[a]) + 1 for b in range(116)] for a in range(116)])
    z = np.zeros((116, 116))
    upper = np.triu_indices(116, 1)
    for k in np.unique(keys[upper]):
        at = (keys == k) & np.triu(np.ones((116, 116), bool), 1)
        size = max(116 - (k - 1), at.sum())
        mean, sd = x[at].sum() / size, 0.0
        sd = np.sqrt(((x[at] - mean) ** 2).sum() / size + (size - at.sum()) * mean**2 / size)
        z[at] = 0.0 if k > d.zscore_depth + 1 else (x[at] - mean) / sd if sd > 0 else np.nan
    start, end = np.array([rows[k].start for k in range(116)]), np.array([rows[k].end for k in range(116)])
    for cut in (12, 37, 60):
        for w, got in zip(d.windows, rows[cut]["values"], strict=True):
            lo, hi = separation.window_edges(start, end, cut, w)
            assert got == pytest.approx(z[lo:cut, cut:hi].mean(), abs=1e-9)
    found = [r.start for r in separation.call_boundaries(m, weight="w")[1].orderBy("row").collect()]
    near = [k * 400_000 for k in range(1, 6)]
    assert len(found) == 5 and all(abs(a - b) <= 40_000 for a, b in zip(found, near, strict=True))


def test_depths():
    d = separation.depths(5000)
    assert (d.min_depth, d.max_depth, d.step) == (50_000, 200_000, 10_000)
    assert d.windows == (50_000, 60_000, 78_284, 101_961, 130_000, 161_803, 196_969)
    for bad in ({"min_depth": 5000}, {"max_depth": 5000}, {"step": 1000}, {"min_depth": 300_000}):
        with pytest.raises(MatrixError):
            separation.depths(5000, **bad)


def test_multires(toy):
    _, domains = multires.call_multires(toy, multires.MultiresParams(gamma_max=0.5, step=0.5, top_k=2, min_mean_samples=1))
    assert sorted((r.start_bin, r.end_bin) for r in domains.collect()) == [(k * 20, k * 20 + 19) for k in range(6)]


def test_best_cuts_are_the_best():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = 7
        q = np.where(np.triu(np.ones((n, n)), 1) > 0, rng.uniform(-1, 1, (n, n)), -np.inf)
        q = np.where(q > 0, q, -np.inf)

        def best(first, gap_ok):
            """Of domains from bin `first` on; stretches without one are two bins at least, but for the first."""
            out = 0.0 if n - first != 1 or gap_ok else -np.inf
            for a in range(first, n - 1):
                if a - first != 1 or gap_ok:
                    out = max(out, *(q[a, b] + best(b + 1, False) for b in range(a + 1, n)))
            return out

        band = np.full((n, n), -np.inf)
        for d in range(n):
            band[d, : n - d] = np.diagonal(q, d)
        for top_k in (1, 3):
            score, domains = multires.best_cuts(band, top_k)[0]
            assert abs(score - best(0, True)) < 1e-9 and abs(sum(q[a, b] for a, b in domains) - score) < 1e-9


def test_bands_are_the_square():
    """Sums and qualities of bands against those of a whole square, and cuts where longer domains don't count."""
    rng = np.random.default_rng(2)
    n = 40
    x = np.triu(rng.integers(0, 9, (n, n))).astype(float)
    band = np.zeros((n, n))
    for d in range(n):
        band[d, : n - d] = np.diagonal(x, d)
    sums = multires.block_sums(band)
    for a, b in ((0, 0), (0, 39), (3, 9), (20, 39), (7, 8)):
        assert sums[b - a, a] == x[a : b + 1, a : b + 1].sum()
    for gamma, least in ((0.0, 1), (0.7, 1), (1.0, 12)):
        q = multires.qualities(sums, gamma, least)
        for d in range(1, n):
            s = np.array([x[a : a + d + 1, a : a + d + 1].sum() for a in range(n - d)]) / (d + 1) ** gamma
            want = s - s.mean() if n - d >= least else np.full(n - d, -1.0)
            assert np.allclose(q[d, : n - d], np.where(want > 0, want, -np.inf))
        short = multires.qualities(multires.block_sums(band[:8]), gamma, least)
        assert np.allclose(short, q[:8])
        cut = q.copy()
        cut[8:] = -np.inf
        for top_k in (1, 2, 4):
            assert multires.best_cuts(short, top_k) == multires.best_cuts(cut, top_k)
            found = multires.best_cuts(q, top_k)
            assert [v for v, _ in found] == sorted((v for v, _ in found), reverse=True)


def test_consensus():
    assert multires.consensus({(0, 4): 2.0, (3, 6): 3.0, (5, 9): 2.0, (7, 9): 0.5}) == [(0, 4), (5, 9)]


def test_hierarchy(toy):
    found = {(r.start_bin, r.end_bin) for r in hierarchy.call_hierarchy(toy, hierarchy.HierarchyParams(max_size=40)).collect()}
    assert found and all(a < b for a, b in found)


def test_blocks(toy):
    found = sorted((r.start // 400_000, (r.end + 20_000) // 400_000) for r in blocks.call_blocks(toy, blocks.BlockParams(width=80, gap=3, min_block=5)).collect())
    assert {(k, k + 1) for k in range(1, 5)} <= set(found)
    m = np.zeros((8, 8))
    m[4, 2] = m[2, 4] = 10
    m[4, 6] = m[6, 4] = 30
    assert blocks.direction(m, 2)[4, 6] == -0.5
    assert sorted(map(len, blocks.components(np.array([[1, 0, 0], [0, 0, 1], [0, 1, 0]]) > 0))) == [1, 2]


def test_directionality(toy):
    domains, track = directionality.call_domains(toy)
    got = [(r.start, r.end) for r in domains.orderBy("start").collect()]
    assert got[:5] == [(k * 400_000, (k + 1) * 400_000) for k in range(5)]
    assert track.count() == 120


def test_nested(toy):
    for share in (False, True):
        got = nested.call_nested({20_000: toy}, share_scores=share).orderBy("start", "end").collect()
        near = {((r.start + 20_000) // 400_000, (r.end + 20_000) // 400_000) for r in got}  # ends may move by a bin
        assert near >= {(k, k + 1) for k in range(1, 4)}
    with pytest.raises(MatrixError):
        nested.call_nested({})
    assert nested.levels([(0, 10), (2, 5), (6, 10), (2, 3)]) == [(0, 10, 0), (2, 3, 2), (2, 5, 1), (6, 10, 1)]
    assert nested.snapped([(0, 20, 0), (1, 9, 1), (12, 16, 1)]) == [(0, 9), (0, 20), (12, 16)]


def test_best_path_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(20):
        parts = [(3 * k, 3 * k + 3) for k in range(6)]
        scores = {(a, b): float(rng.uniform(-1, 1)) for a in range(0, 18, 3) for b in range(a + 3, 19, 3)}

        def best(k):
            return 0.0 if k == 6 else max(3 * (j - k) * scores[3 * k, 3 * j] + best(j) for j in range(k + 1, 7))

        path = nested.best_path(parts, scores, 99)
        assert abs(sum(3 * (j - i + 1) * scores[parts[i][0], parts[j][1]] for i, j in path) - best(0)) < 1e-9


def test_alignment(spark):
    frame = lambda rows: spark.createDataFrame(rows, "chrom_id int, start long, end long, level int")
    a = frame([(0, 0, 400, 0), (0, 400, 800, 0), (0, 400, 600, 1), (1, 0, 900, 0)])
    b = frame([(0, 0, 400, 0), (0, 400, 800, 0), (1, 0, 450, 0), (1, 450, 900, 0)])
    got = {(r.chrom_id, r.start1, r.kind) for r in alignment.align(a, b, 10).collect()}
    assert got == {(0, 0, "conserved"), (0, 400, "inner"), (1, 0, "split")}
    assert alignment.overlap((0, 10), (5, 20)) == 0.25 and alignment.overlap((0, 1), (1, 2)) == 0


def test_model_sums_over_paths():
    rng = np.random.default_rng(1)
    model = HMM([Discrete({"a": 0.7, "b": 0.3}), Discrete({"a": 0.2, "b": 0.8})], [[0.6, 0.3], [0.2, 0.5]], [0.5, 0.5], [0.1, 0.3])
    x = list("abbab")
    from itertools import product

    logs = []
    for path in product(range(2), repeat=len(x)):
        p = model.start[path[0]] * model.end[path[-1]]
        for k, s in enumerate(path):
            p *= np.exp(model.emissions[s].log_probability(x[k])[0]) * (model.transitions[path[k - 1], s] if k else 1)
        logs.append((p, path))
    assert abs(model.log_probability(x) - np.log(sum(p for p, _ in logs))) < 1e-9
    score, path = model.viterbi(x)
    assert tuple(path) == max(logs)[1] and abs(score - np.log(max(logs)[0])) < 1e-9
    assert np.allclose(model.predict_proba(x).sum(axis=1), 1)
    totals, moves, first, last, share = model.expectations([list("a"), x, list("abc"), x])
    weight = np.array([p for p, _ in logs]) / sum(p for p, _ in logs)
    assert np.allclose(totals, [model.log_probability(list("a")), model.log_probability(x), -np.inf, model.log_probability(x)])
    assert np.allclose(share[1:6], model.predict_proba(x)) and np.allclose(share[9:], share[1:6]) and not share[6:9].any()
    for a in range(2):
        for b in range(2):
            assert abs(moves[a, b] - 2 * sum(w * sum(u == a and v == b for u, v in zip(path, path[1:], strict=False)) for w, (_, path) in zip(weight, logs, strict=True))) < 1e-12
    assert np.allclose(first, share[0] + 2 * share[1]) and np.allclose(last, share[0] + 2 * share[5])
    before = model.log_probability(x)
    model.fit([x, x], stop=1e-6, rounds=20)
    assert model.log_probability(x) >= before
    mix = Mixture([Normal(-1.0, 1.0), Normal(1.0, 1.0)])
    mix.fit_until(np.concatenate([rng.normal(-3, 0.5, 300), rng.normal(4, 1, 300)]))
    assert sorted(round(p.mean) for p in mix.parts) == [-3, 4]


def test_fit_by_rounds_of_tasks(spark):
    """A fit whose rounds sum up in tasks has the parameters of the fit at the driver."""
    from contactgrid.functions.baum_welch import fit_frame

    rng = np.random.default_rng(6)
    rows = [(k, rng.normal([-4, -1, 2, 5][k % 4], 1.5, rng.integers(5, 60)).tolist()) for k in range(30)] + [(99, [])]
    frame = spark.createDataFrame(rows, "k int, x array<double>").repartition(5)
    models, scores = [directionality.start_model() for _ in range(3)], []
    scores.append(models[0].fit([np.array(x) for _, x in rows if x], stop=1e-3, rounds=12))
    scores += [fit_frame(m, frame, stop=1e-3, rounds=12, local_values=n) for m, n in zip(models[1:], (10**6, 10), strict=True)]
    for m, score in zip(models[1:], scores[1:], strict=True):
        assert abs(score - scores[0]) < 1e-6
        assert np.allclose(m.transitions, models[0].transitions, atol=1e-9) and np.allclose(m.end, models[0].end, atol=1e-9)
        for e, f in zip(m.emissions, models[0].emissions, strict=True):
            assert np.allclose(e.weights, f.weights, atol=1e-9)
            assert np.allclose([(p.mean, p.std) for p in e.parts], [(p.mean, p.std) for p in f.parts], atol=1e-9)
    assert fit_frame(directionality.start_model(), frame.limit(0)) == 0.0
