import corpus_pipeline
from lithic.llm.shared import materialize


def test_stages_on_small_tables(spark, sf):
    docs, counts = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[3] and counts[1] == counts[2]
    packed = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in packed) <= 2048


def test_run_gives_what_the_stages_give(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
