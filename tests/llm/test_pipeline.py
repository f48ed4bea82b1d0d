from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_copies, brute_groups, brute_hits

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark, tmp_path):
    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = now.columns, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r["doc_id"], r["text"]) for r in now.collect()]
        stage(spark, now, SF).write.parquet(path := f"file://{tmp_path}/{n}")
        now = spark.read.parquet(path)
        kept = {r["doc_id"] for r in now.select("doc_id").collect()}
        if n < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns
        if n == 0:
            assert kept == {i for i, t in rows if any(c.isalpha() for c in t or "")}
        elif n == 1:
            assert {str(i) for i in kept} == {k for _, k, _ in brute_copies(rows)}
        elif n == 2:
            assert kept == set(brute_groups(rows, 5, 80).values())
        elif n == 3:
            assert {str(i) for i in kept} == {i for i, _, hit, _ in brute_hits(rows, items, 10) if not hit}
        else:
            assert kept == {i for i, _ in rows} and now.where("not round_trip or n_tokens <> size(token_ids)").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_texts_in_no_known_language_go(spark):
    learnt = spark.read.parquet(f"{SF}/documents.parquet")
    odd = ["xqzvk wjjfq pplkt zzrtq vbnmx qwrtp lkjhg fdszx", "Это простой текст на русском языке о погоде", "今日は天気がいいですね", "ÃƒÂ©tÃ© Ã¢â‚¬â„¢ Ã…â€œuvre Ã‚Â«", "Dit is een eenvoudige Nederlandse zin over het weer van vandaag", "1234 5678"]
    rows = spark.createDataFrame([(10**9 + i, t, None, "odd", len(t)) for i, t in enumerate(odd)], learnt.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, learnt.unionByName(rows), SF).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in learnt.select("doc_id").collect()}
    unlabelled = learnt.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.known_language(spark, unlabelled, SF).count() == learnt.count()
