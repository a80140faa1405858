import random
import re

import numpy as np

from contactgrid.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    hit = set()
    for k, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(k, k + 5))
    dup, seen = 0, []
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.append(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_as_brute_force():
    rng = random.Random(0)
    parts = ["a", "b", "é", "🙂x", "#", "|", " ", " ", "\n", "\n", "\t", " ", "\x85"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert quality.counts(text.encode()) == brute(text), text


def sample(rng, low):
    words = [rng.choice(["onre", "tion", "ther", "and", "the", "of", "st"]) for _ in range(60)]
    return " ".join(w + rng.choice(["$$$", "%%%"]) if low else w for w in words)


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(k, sample(rng, k % 4 == 0)) for k in range(600)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(400)] + [(None, 1), (9999, 0)], "doc_id long, quality int")
    out = {r.id: r.kept for r in quality.quality_rules(docs, labels, rows=300).collect()}
    wrong = sum(out[k] != (k % 4 != 0) for k in range(400, 600) if not quality.base_failed(*(lambda c: (c[0], c[4]))(quality.counts(rows[k][1].encode()))))
    assert wrong <= 2
    kept = quality.quality_rules(docs, labels, rows=300, keep=True)
    assert kept.columns == docs.columns and kept.count() == sum(out.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x y"), (4, "w " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.quality_rules(docs, labels).collect()
    assert [r.kept for r in out] == [False] * 4 and all(r.low_probability is None for r in out)
    assert quality.quality_rules(docs.limit(0), labels).count() == 0


def test_labels_that_contradict_or_repeat(spark):
    """The training rows don't depend on the labels' order."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(6)] + [(2, "a text")], "doc_id long, text string")
    rows = [(0, 1), (1, 0), (1, 1), (2, 0), (2, 0), (3, None), (4, 1), (4, 1)]
    made = []
    want = [("a text", 1), ("text 0", 0), ("text 4", 0)]
    for order in (rows, rows[::-1]):
        labels = spark.createDataFrame(order, "doc_id long, quality int").coalesce(1)
        texts = quality.training_texts(docs, labels, 99)
        assert sorted((r.text, r.low) for r in texts.collect()) == want
        made.append(quality.training_rows(texts))
    for name in ("ends", "at", "val", "used", "low"):
        assert getattr(made[0], name).tolist() == getattr(made[1], name).tolist()


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * (100 + k)) for k in range(50)] + [(50, "y" * 4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(51)], "doc_id long, quality int")
    whole = [len(r.text) for r in quality.training_texts(docs, labels, 99, 64 * 200).orderBy("k").collect()]
    assert len(whole) == 50
    some = [len(r.text) for r in quality.training_texts(docs, labels, 99, 64 * 149).orderBy("k").collect()]
    assert some == whole
    few = [len(r.text) for r in quality.training_texts(docs, labels, 7, 64 * 200).orderBy("k").collect()]
    assert few == whole[: len(few)] and 6 <= len(few) <= 7
    cut = [len(r.text) for r in quality.training_texts(docs, labels, 99, 64 * 90).orderBy("k").collect()]
    assert cut == []  # every text is over a 64th
    many = spark.createDataFrame([(k, "x" * 10) for k in range(500)], "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(500)], "doc_id long, quality int")
    assert quality.training_texts(many, known, 999, 1000).count() == 100


def test_blocks_are_the_whole_fit():
    """The fit in blocks is plain gradient descent over a dense matrix."""
    rng = random.Random(7)
    s = quality.gathered([(sample(rng, k % 3 == 0).encode(), int(k % 3 == 0)) for k in range(300)], 8)
    x = np.zeros((300, len(s.used)))
    begins = [0, *s.ends[:-1]]
    for k, (a, b) in enumerate(zip(begins, s.ends, strict=True)):
        x[k, s.at[a:b]] = s.val[a:b]
    part = np.arange(300) % 4 != 3
    w, bias = quality._descend(s, part, 3e-4, 30)
    share = np.where(s.low == 1, 0.5 / (part & (s.low == 1)).sum(), 0.5 / (part & (s.low == 0)).sum()) * part
    u = v = np.zeros(len(s.used))
    c = d = 0.0
    for k in range(1, 31):
        m = (k - 1) / (k + 2)
        a, e = u + m * v, c + m * d
        g = share * (1 / (1 + np.exp(-(x @ a + e))) - s.low)
        new, last = a - (x.T @ g + 3e-4 * a) / 1.0003, e - g.sum() / 1.0003
        v, d, u, c = new - u, last - c, new, last
    assert np.allclose(w, u, atol=1e-6) and abs(bias - c) < 1e-6
    assert np.allclose(quality._margins(s, w, bias), x @ w + bias, atol=1e-6)


def test_grams_are_of_characters():
    """Four characters of any length of bytes are one gram; three are none."""
    grams = lambda t: int((quality.features(t.encode(), 16)[0] >= 2 << 16).sum())
    for unit in ("abcd", "éàüö", "漢字仮名", "🙂🙃😀😁"):
        assert grams(unit[:3]) == 0 and grams(unit) == 1 and grams(unit + unit[0]) == 2
