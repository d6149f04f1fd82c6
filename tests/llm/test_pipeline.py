import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_copies", "mixing", "pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("not lossless").count() == 0
    assert {"doc_id", "ids", "n_pieces"} <= set(out.columns)
