import itertools
import random
import re

from contactgrid.llm import filter_audit as audit


def brute(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    seen = []
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        caps = sum("A" <= c <= "Z" for c in t)
        e = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * caps > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": e}
        seen.append((i, part or "", {k for k, v in fails.items() if v}))
    out = {}
    for part in {p for _, p, _ in seen}:
        own = [(i, f) for i, p, f in seen if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                earlier = [x for x in own if x not in left]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                n_fail = sum(f in x[1] for x in own)
                assert n_fail - len(gone) >= 0 and len(earlier) >= 0
                out[part, "".join(order), k + 1] = [len(left), len(gone), n_fail - len(gone), sum(x[1] == {f} for x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as part", "2 as mask", "3 as good", "4 as id")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_as_brute_force(spark):
    rng = random.Random(11)
    many = [" ".join(f"w{rng.randint(0, k)}" for _ in range(n)) for n, k in ((0, 1), (120, 9999), (120, 40), (99, 9999), (100, 9999), (3, 3))]
    texts = [*many, None, "", many[1].upper(), many[1] + " #", many[2] + "|", "ABC é", "Ab\x0bcd"]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(400)]
    docs += [(None, many[1], "en"), (None, many[1], "en"), (7, docs[7][1], docs[7][2]), (7, many[4], "de"), (-5, many[1], "only")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 500, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    d, lab = frames(spark, docs, labels)
    got = audit.audit(d, lab).collect()
    want = brute(docs, labels)
    assert len(got) == len(want) == 4 * 600 and {r.part for r in got} == {"en", "de", "", "only"}
    for r in got:
        assert [r[f] for f in FIELDS] == want[r.part, r.filter_order, r.step], r


def test_hot_text_and_many_parts(spark):
    docs = [(k, "the same", "en") for k in range(3000)] + [(5000 + k, f"own {k}", f"p{k}") for k in range(150)]
    d, lab = frames(spark, docs, [(k, 1, 0) for k in range(0, 3000, 3)])
    out = {(r.part, r.filter_order, r.step): r for r in audit.audit(d, lab).collect()}
    assert len(out) == 151 * 600
    r = out["en", "EABCD", 1]
    assert (r.removed, r.kept, r.good_lost, r.unique_fails) == (2999, 1, 999, 0)
    assert out["p3", "ABCDE", 1].removed == 1
    # parts beyond what a task holds at once are summed all the same
    rows = spark.createDataFrame([(f"p{k % 5}", 0, 0, k % 32, 2) for k in range(640)], "part string, good int, toxic int, mask int, n long").coalesce(1)
    small = {(r.part, r.filter_order, r.step): r.removed for r in audit.removals(rows, 2, 7).collect()}
    assert small == {(r.part, r.filter_order, r.step): r.removed for r in audit.removals(rows).collect()}
    assert sum(n for (_, o, _), n in small.items() if o == "ABCDE") == 1280


def test_empty_tables(spark):
    d, lab = frames(spark, [], [])
    assert audit.audit(d, lab).collect() == []
    d, lab = frames(spark, [(1, None, None)], [])
    assert {(r.part, r.kept) for r in audit.audit(d, lab).collect() if r.step == 5} == {("", 0)}


def test_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want = brute(docs, labels)
    got = audit.op12_filter_audit(spark, sf).collect()
    assert {(r.part, r.filter_order, r.step): [r[f] for f in FIELDS] for r in got} == want
