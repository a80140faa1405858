import numpy as np

from contactgrid.llm import mixing


def test_rake_meets_margins():
    rng = np.random.default_rng(0)
    a, b, c = (x.ravel() for x in np.meshgrid(range(3), range(4), range(2), indexing="ij"))
    mass = rng.uniform(1, 100, len(a))
    shares = [np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.7, 0.3])]
    w = mixing.rake(mass, list(zip((a, b, c), shares, strict=True)))
    for k, s in zip((a, b, c), shares, strict=True):
        assert np.allclose(np.bincount(k, weights=w), s)


def test_expected_share():
    mass, weight = np.array([900.0, 50.0, 50.0]), np.array([0.2, 0.4, 0.4])
    for share in (0.05, 0.3, 0.9):
        p = mixing.probabilities(mass, weight, share)
        assert abs((p * mass).sum() - share * 1000) < 1e-6 and p.max() <= 1


def test_documents(spark):
    rows = [(k, "word " * (1 + k % 300), ("src0", "src1")[k % 2], ("en", "de", None)[k % 3], 7) for k in range(3000)] + [(None, None, None, None, 7), (5, "", "src0", "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, mix_kept int")
    out = mixing.mixed(docs)
    assert out.count() == len(rows)
    got = out.where("mix_kept").agg({"mix_tokens": "sum"}).first()[0] / out.agg({"mix_tokens": "sum"}).first()[0]
    assert abs(got - mixing.SHARE) < 0.04
    assert mixing.mix_stage(spark, docs.drop("mix_kept"), "").columns == ["doc_id", "text", "source", "lang"]
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.where("text is null or text = ''")).count() == 2
