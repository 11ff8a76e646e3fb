"""The pipeline over the smallest table: each stage keeps whole rows, and its decisions take effect."""

import corpus_pipeline
from strandforge.llm import exact_dedup, mixing, simhash, toxicity
from strandforge.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    n = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        n.append(docs.count())
        if name == "exact dedup":
            assert exact_dedup.exact_groups(docs).where("not kept").count() == 0
        if name == "near dedup":
            assert simhash.near_groups(docs).where("doc_id <> component_id").count() == 0
    assert n[0] >= n[1] >= n[2] > 0 and n[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.where("piece = 0").count() == n[3]
    assert corpus_pipeline.run(spark, SF).count() == out.count()


def test_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names go through all stages; against what each operator says of its input."""
    rows = [(i, f"words of {i} and more of it {i * i}", "en", "a", 3) for i in range(40)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (50, "", "en", None, 0), (51, "same Text here", "en", "b", 1), (52, "SAME text here", None, "b", 1), (52, "SAME text here", None, "b", 1), (53, "long " * 50000, "de", "b", 9), (54, "you idiot", "en", "b", 2)]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars int, _id string, score int, size string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i == 54)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, before, sf), "test")
        assert docs.columns == before.columns
        if name == "toxicity":
            scores = toxicity.toxicity(before, spark.read.parquet(f"{sf}/labels.parquet"))
            assert docs.count() == scores.where("predicted = 0").count()
        if name == "exact dedup":
            assert sorted(map(str, docs.select("doc_id").collect())) == sorted(map(str, exact_dedup.exact_groups(before).where("kept").select("doc_id").collect()))
        if name == "near dedup":
            assert docs.count() == simhash.near_groups(before).select("component_id").distinct().count()
        if name == "source mix":
            assert docs.count() == sum(min(r.copies, 1) if r.size == 0 else r.copies for r in mixing.mix(before).collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).where("piece = 0").count() == docs.count()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
