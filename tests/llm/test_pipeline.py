import corpus_pipeline as C
from lodestream.llm.packing import n_words
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    before, after = seen["quality"]
    assert 0 < after.count() < before.count() and after.exceptAll(before).isEmpty()
    before, after = seen["line_dedup"]
    lost = before.join(after.select("doc_id"), "doc_id", "left_anti").select("text").collect()
    known = {x for r in after.select("text").collect() for x in r.text.split("\n")}
    assert all(set(r.text.split("\n")) - {""} <= known for r in lost)
    assert after.filter("trim(text) = ''").isEmpty() and after.agg(F.sum("n_chars")).first()[0] <= before.agg(F.sum("n_chars")).first()[0]
    assert after.filter("n_chars <> length(text)").isEmpty()
    before, after = seen["near_dedup"]
    assert after.count() < before.count() and after.exceptAll(before).isEmpty()
    before, after = seen["mixing"]
    full = before.filter(n_words(F.col("text")) > 0)
    assert after.select("doc_id").distinct().count() >= full.count() and after.count() >= full.count()
    before, after = seen["packing"]
    assert after.count() == before.count()
    assert after.groupBy("batch_id").agg((F.count("*") * F.max("bucket_len")).alias("b"), F.count("*").alias("n")).filter("b > 65536 and n > 1").isEmpty()


def test_run_is_the_stages(spark):
    assert C.run(spark, SF).count() > 0 and [n for n, _ in C.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]


def test_odd_documents_pass_all_stages(spark, tmp_path):
    cols = "doc_id long, text string, lang string, source string, n_chars long, row string, k long, uid long, p double"
    texts = [None, "", " \n", "one two three four five six seven eight nine ten", *[f"some calm words of text number {i} and {i * 7} more words of it" for i in range(8)]]
    rows = [(i if i % 4 else None, t, "en" if i % 3 else None, None if i % 5 == 0 else "s", len(t or ""), "r", i, i, 0.5) for i, t in enumerate(texts)]
    spark.createDataFrame(rows + rows[3:6], cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality":
            assert docs.filter("text is null or trim(text) = ''").isEmpty() and docs.count() == len(texts) - 3 + 3
    assert docs.count() > 0
