import corpus_pipeline
from lonja.llm import decontam, simhash

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixture", "token_output"]
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name != "token_output":
            assert docs.columns == columns
        if name == "decontamination":
            rows = docs.collect()
            items = [decontam.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(item in decontam.normalise(r.text) for r in rows for item in items)
            assert len({simhash.fingerprint(r.text) for r in rows}) == len(rows)
    assert before >= counts[0] > counts[1] > counts[2] and counts[3] == counts[4]
    again = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert again == sorted(tuple(r) for r in docs.collect())
