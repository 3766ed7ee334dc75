"""The corpus pipeline on the smallest tables, stage by stage against what each must keep."""

from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import queries


def test_stages_filter_and_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = [n for n, _ in corpus_pipeline.STAGES], docs
    assert names == ["toxicity", "language", "near_duplicates", "mixing", "packing"]
    toxic = {r["doc_id"] for r in queries.op5_toxicity(spark, sf).where("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in seen.select("doc_id").collect()}
        seen = corpus_pipeline.written(stage(spark, seen, sf), name)
        after = {r["doc_id"] for r in seen.select("doc_id").collect()}
        assert seen.columns == docs.columns and after <= before
        if name == "toxicity":
            assert before - after == toxic
        if name == "language":
            assert after == before - {r["doc_id"] for r in docs.where("text IS NULL OR NOT text RLIKE '\\\\p{L}'").collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, seen, sf)
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == {r["doc_id"] for r in seen.select("doc_id").collect()}


def test_near_duplicates_and_mixing_against_brute_force(spark, sf, texts):
    """One document of each brute-force class stays; mixing takes each as often as its rate and draw ask."""
    from test_operators import brute_classes

    from larder.llm import mixing

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = corpus_pipeline.written(stages["near_duplicates"](spark, docs, sf), "kept")
    classes = brute_classes(texts)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(classes.values()))
    taken = {r["doc_id"]: r["count"] for r in stages["mixing"](spark, kept, sf).groupBy("doc_id").count().collect()}
    want = {r["doc_id"]: r["n"] for r in mixing.mix(kept).select("doc_id", mixing.copies(F.col("rate"), mixing.draw(F.col("doc_id"))).alias("n")).collect()}
    assert taken == {i: n for i, n in want.items() if n}


def test_odd_rows_and_empty_tables(spark, sf, odd_documents, tmp_path):
    """Nulls in every column, empty and wordless texts, repeated rows, a long text, clashing names; then no row at all."""
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    seen, left = odd_documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = corpus_pipeline.written(stage(spark, seen, str(tmp_path)), "odd")
        assert seen.columns == odd_documents.columns
        left.append(sorted((r["doc_id"] for r in seen.select("doc_id").collect()), key=str))
    assert left[0] == [1, 2, 3, 4, 5, 5, 6, None] and left[1] == [4, 5, 5, 6, None] and left[2] == [4, 5, None]
    assert set(left[3]) <= set(left[2])
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == set(left[3])
    empty = tmp_path / "empty"
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
