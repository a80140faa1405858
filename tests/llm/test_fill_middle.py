import hashlib
import random
import re

import numpy as np
import pytest

from contactgrid.llm import fill_middle as fim


def brute(doc_id, text):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n = len(units)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


PIECES = ["a", "Z", "word", "x" * 30, " ", "\n", "é", "🙂", "1", "<", ">", "<P", "S>", "<M>", "_", "\x00"]


@pytest.mark.parametrize("chunk, window", [(1, 1), (3, 7), (4096, 1 << 20)])
def test_cuts_as_brute_force(spark, chunk, window):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += [None, "", "a" * 50_000, "é" * 50_000, "a b" * 20_000, "<S>", "same", "same"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n int")
    law = fim.Law(chunk=chunk, window=window)
    whole = {r.id: r for r in fim.fill_in_middle(docs, law).collect()}
    short = {r.id: r for r in fim.digests(docs, law).collect()}
    assert len(whole) == len(short) == len(texts)
    assert {r.form for r in whole.values()} == {"plain", "psm", "spm"}
    for k, t in enumerate(texts):
        want = brute(k, t)
        for r in (whole[k], short[k]):
            assert (r.n, r.form, r.prefix_chars, r.middle_chars) == want[:4], (k, t)
        assert whole[k].output == want[4]
        assert short[k].output_sha256 == hashlib.sha256(want[4].encode()).hexdigest()
        assert short[k].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_only_owning_chunks_are_scanned_again(monkeypatch):
    text = ("ab, " * 5000).encode()
    units = fim.Units(np.frombuffer(text, dtype=np.uint8), np.array([len(text)]), 100, 1000)
    seen = []
    scan = fim._starts
    monkeypatch.setattr(fim, "_starts", lambda data, lo, hi: seen.append(hi - lo) or scan(data, lo, hi))
    assert units.n(0) == 15_000
    assert units.place(0, 7501) == (10_002, 10_002) and units.place(0, 15_000) == (20_000, 20_000)
    assert seen == [100]


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, id string")
    assert fim.fill_in_middle(none).collect() == [] and fim.digests(none).collect() == []
    nulls = spark.createDataFrame([(None, "a b", "x"), (None, None, None)], "doc_id long, text string, id string")
    out = fim.digests(nulls).collect()
    assert len(out) == 2 and all(r.id is None for r in out)
    assert {r.n for r in out} == {3, 0}


def test_query_covers_the_table(spark, sf):
    out = {r.doc_id: r for r in fim.op11_fill_middle(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    for d in docs:
        n, form, p, m, text = brute(d.doc_id, d.text)
        r = out[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(text.encode()).hexdigest()
