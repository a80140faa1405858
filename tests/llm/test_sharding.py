import zlib

from contactgrid.llm import sharding


def rows(spark, texts):
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, shard string")
    return sharding.shard_by_bytes(docs).collect()


def check(out, texts):
    assert len(out) == len(texts)
    for r in out:
        t = texts[r.id] or ""
        assert r["size"] == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and r.grown_shard is None
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_even_bytes_and_whole_groups(spark):
    texts = [f"text {k // 2} " * (1 + k // 2 % 40) for k in range(4000)]
    out = rows(spark, texts)
    check(out, texts)
    loads = [sum(r["size"] for r in out if r.shard == s) for s in range(8)]
    assert max(loads) <= 1.02 * min(loads)
    shards = {}
    for r in out:
        shards.setdefault(texts[r.id], set()).add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_hot_group_is_split(spark):
    texts = ["the same"] * 3000 + [f"other {k} words" for k in range(3000)]
    out = rows(spark, texts)
    check(out, texts)
    loads = [sum(r["size"] for r in out if r.shard == s) for s in range(8)]
    assert max(loads) <= 1.1 * min(loads)


def test_only_the_hot_text_is_split(spark):
    """A hot text among groups of copies: theirs stay whole, also in many parts."""
    texts = ["the same"] * 3000 + [f"group {k // 3} words" for k in range(3000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for options in ({}, {"part_rows": 5, "part_bytes": 1 << 30}, {"part_bytes": 100}):
        out = sharding.shard_by_bytes(docs, **options).collect()
        check(out, texts)
        shards = {}
        for r in out:
            shards.setdefault(texts[r.id], set()).add(r.shard)
        assert shards.pop("the same") == set(range(8)) and all(len(s) == 1 for s in shards.values())
        loads = [sum(r["size"] for r in out if r.shard == s) for s in range(8)]
        assert max(loads) <= 1.05 * min(loads)


def test_hot_by_rows_alone(spark):
    """A third of all rows are empty, and hold next to no bytes."""
    texts = [None, ""] * 1000 + [f"{k} " * 100 for k in range(4000)]
    out = rows(spark, texts)
    check(out, texts)
    empty = [sum(r.shard == s and r["size"] == 1 for r in out) for s in range(8)]
    assert max(empty) <= 500


def test_odd_rows(spark):
    texts = [None, "", "", "é" * 9, "x" * 100_000, None]
    check(rows(spark, texts), texts)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_by_bytes(empty).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sharding.shard_by_bytes(twice).count() == 3


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 8
