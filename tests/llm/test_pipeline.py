import corpus_pipeline as cp
from contactgrid.llm import bpe, mixing, pii, quality, simhash


def test_run_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = quality.quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").select("id")
    by_hand = docs.join(kept, docs.doc_id == kept.id, "left_semi")
    found = simhash.near_duplicates(by_hand)
    by_hand = by_hand.join(found.where("id = component_id"), by_hand.doc_id == found.id, "left_semi")
    by_hand = mixing.mixed(pii.redact_stage(spark, by_hand, sf)).where("mix_kept").select(*columns)
    want = bpe.encode_stage(spark, by_hand, sf)
    got = cp.run(spark, sf)
    assert sorted(got.collect()) == sorted(want.collect())


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs.limit(40), sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        stage(spark, docs.limit(0), sf).count()


def test_run_on_an_empty_and_an_odd_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = "plain words of a text that is long enough to stay here with us"
    odd = spark.createDataFrame([(None, text, None, None, None), (9, None, "en", "s", 3), (9, "", "en", "s", 0), (9, f"{text} {text[::-1]}", "en", "s", 9)], docs.schema)
    for name, table in (("empty", docs.limit(0)), ("odd", odd)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(str(tmp_path / name / "labels.parquet"))
        got = cp.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in got} <= ({None, 9} if name == "odd" else set())
