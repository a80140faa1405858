import random

import numpy as np
import pytest
import xxhash

from contactgrid.llm import embed_dedup, simhash
from contactgrid.llm.common import connected_components


def closure(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in linked[a]:
                low = min(label[a], label[b])
                if label[a] != low or label[b] != low:
                    label[a] = label[b] = low
                    changed = True
    return label


def brute_fp(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h)) if h else 0


def test_fingerprints_as_brute_force():
    rng = random.Random(0)
    texts = ["", " \n", "A b", "Ä B c", "one two three", "w " * 700] + [" ".join(rng.choice("abcdEFG") for _ in range(rng.randint(1, 900))) for _ in range(60)]
    assert simhash.fingerprints([t.encode() for t in texts]).tolist() == [brute_fp(t) for t in texts]
    assert simhash.fingerprints([None]).tolist() == [0]


def test_ball_and_allocation():
    assert len(simhash.ball(32, 2)) == 1 + 32 + 496 and len(simhash.ball(8, -1)) == 0
    cost = np.random.default_rng(0).uniform(0, 9, (50, 3, 5))
    got = simhash.allocate(cost, 3)
    assert (got.sum(axis=1) == 3 - 3 + 1).all() and got.min() >= -1
    for q in range(50):
        best = min(cost[q, 0, a] + cost[q, 1, b] + cost[q, 2, 4 - a - b] for a in range(5) for b in range(5 - a))
        assert abs(sum(cost[q, i, got[q, i] + 1] for i in range(3)) - best) < 1e-9


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_links_as_brute_force(spark, parts):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {0, (1 << 64) - 1} | {int(x) for x in base}
    for b in base.tolist():
        for _ in range(6):
            x = b
            for k in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                x ^= 1 << k
            fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    want = {(min(a, b), max(a, b)) for k, a in enumerate(fps) for b in fps[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {(r.a, r.b) for r in simhash.hamming_links(frame, parts=parts).collect()}
    assert got == want


def test_documents(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["on", "re", "th", "er", "an", "st", "ti"]) + str(rng.randint(0, 30)) for _ in range(200)) for _ in range(12)]
    texts = [None, "", "  ", *base, *(b + " tail" for b in base), *base[:3], "x" * 20_000]
    docs = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)], "doc_id long, text string, fp int")
    out = {r.id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fp(t or "") for t in texts]
    linked = [[b for b in range(len(texts)) if (fps[a] ^ fps[b]).bit_count() <= 3] for a in range(len(texts))]
    assert [out[k].component_id for k in range(len(texts))] == closure(len(texts), linked)
    kept = {r.doc_id for r in simhash.dedup_stage(spark, docs.drop("fp"), "").collect()}
    assert kept == {k for k in range(len(texts)) if out[k].component_id == k}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_stage_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 5), (2, "a b c", "y", 6), (None, "a b c", "z", 7)], "doc_id long, text string, gone string, fp int")
    out = simhash.dedup_stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.gone for r in out.collect()) == ["x", "z"]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(0, 70)] + [(200, k) for k in range(201, 400)] + [(500, 500), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(71)} | {k: 200 for k in range(200, 400)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_as_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(25):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((base + rng.normal(0, 0.05, 16) * rng.integers(0, 2)).astype(np.float32).tolist())
    rows += rows[:6] + [rows[0][:8], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, None, []]
    labels = [k % 2 if k % 17 else None for k in range(len(rows))]
    frame = spark.createDataFrame([(k, r, lab, 1) for k, (r, lab) in enumerate(zip(rows, labels, strict=True))], "vec_id long, embedding array<float>, label int, node int")
    out = {r.id: r for r in embed_dedup.near_duplicates(frame).collect()}
    good = [r is not None and len(r) > 0 and None not in r and bool(np.isfinite(np.array(r, float)).all()) and any(r) and lab is not None for r, lab in zip(rows, labels, strict=True)]

    def near(a, b):
        if a == b or not (good[a] and good[b]) or labels[a] != labels[b] or len(rows[a]) != len(rows[b]):
            return False
        x, y = np.array(rows[a], float), np.array(rows[b], float)
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    linked = [[b for b in range(len(rows)) if near(a, b)] for a in range(len(rows))]
    label = closure(len(rows), linked)
    assert {k: out[k].n_links for k in out} == {k: len(linked[k]) for k in range(len(rows))}
    assert [out[k].component_id for k in range(len(rows))] == label
    assert all(out[k].kept == (label[k] == k) for k in out)
    assert embed_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_large_components_are_counted_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = (np.ones((90, 8)) + rng.normal(0, 0.08, (90, 8)))
    rows = [(1, k, v.tolist(), 1 + k % 3) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "component long, node long, vec array<double>, copies long")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((u @ u.T >= 0.98) * np.array([r[3] for r in rows])).sum(axis=1)
    got = {r.node: r.links for r in embed_dedup.count_links(frame, 0.98, block=16).collect()}
    assert [got[k] for k in range(90)] == want.tolist()


@pytest.mark.parametrize("common", [0.0, 3.0])
def test_recall_of_planted_pairs(spark, common):
    """12,000 vectors of one label, 1,000 of them beside another at a cosine of 0.98 to 0.99; with a strong
    common direction all others have cosines of about 0.9.  Links against brute force."""
    rng = np.random.default_rng(7)
    lean = np.zeros(64)
    lean[0] = common * 8
    x = rng.standard_normal((11_000, 64)) + lean
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.standard_normal((1000, 64))
    away -= (away * x[:1000]).sum(axis=1)[:, None] * x[:1000]
    away /= np.linalg.norm(away, axis=1)[:, None]
    cos = rng.uniform(0.9801, 0.99, 1000)[:, None]
    x = np.concatenate([x, cos * x[:1000] + np.sqrt(1 - cos**2) * away]).astype(np.float32)
    frame = spark.createDataFrame([(k, v, 1) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    out = {r.id: r.n_links for r in embed_dedup.near_duplicates(frame).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = np.concatenate([(u[k : k + 2000] @ u.T >= 0.98).sum(axis=1) - 1 for k in range(0, 12_000, 2000)])
    got = np.array([out[k] for k in range(12_000)])
    assert (got <= want).all() and want.sum() >= 2000
    print("recall", got.sum() / want.sum())
    assert got.sum() >= 0.995 * want.sum()


def test_tiny_and_huge_vectors(spark):
    """Components whose squares vanish or overflow are vectors like others, and disturb none."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    near = base + rng.normal(0, 0.02, base.shape)
    rows = [v * s for k in range(60) for v, s in ((base[k], 1.0), (near[k], (1.0, 1e-170, 1e170, 1e-300)[k % 4]))]
    rows += [np.full(16, 5e-324), np.full(16, 1e308)]
    frame = spark.createDataFrame([(k, r.tolist(), 1) for k, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    out = {r.id: r for r in embed_dedup.near_duplicates(frame).collect()}
    u = np.array([np.array(r) / np.abs(r).max() for r in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = (u @ u.T >= 0.98).sum(axis=1) - 1
    assert want[:120].min() >= 1 and want[120:].tolist() == [1, 1]
    assert [out[k].n_links for k in range(len(rows))] == want.tolist()
    assert all(out[k].component_id == k - k % 2 for k in range(len(rows)))


def test_passes_grow_with_a_label(spark):
    frame = spark.createDataFrame([(k, [1.0, float(k)], "big" if k < 900 else "small") for k in range(1000)], "node long, vec array<float>, label string")
    got = {(r.label, r.most_passes) for r in embed_dedup.with_passes(frame, 16, 100).select("label", "most_passes").distinct().collect()}
    assert got == {("big", 34), ("small", 16)}
    assert {r.most_passes for r in embed_dedup.with_passes(frame, 16, 1).collect()} == {62}
