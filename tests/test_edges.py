import datetime as dt

from pyspark.sql import functions as F

from lodestream.sources import ingest
from lodestream.streaming import news

SF = "/root/testdata/sf0.001"


def test_sentence_files_and_lists(spark, tmp_path):
    folder = tmp_path / "02800" / "csv"
    folder.mkdir(parents=True)
    (folder / "fund_kfs.csv").write_bytes("﻿sentence_id,text\n1,\"a, \"\"b\"\"\nline\"\n2,c\n".encode())
    rows = ingest.sentence_files(spark, f"{tmp_path}/*/csv/*.csv").orderBy("sentence_id").collect()
    assert [(r.ticker, r.sentence_id, r.text, r.weight) for r in rows] == [("02800", 1, 'a, "b"\nline', 5), ("02800", 2, "c", 5)]
    src = spark.createDataFrame([("2800", "HKD"), ("9999", "HKD"), ("3", "USD"), (None, "HKD")], "`Stock code*` string, `Base currency*` string")
    assert [r[0] for r in ingest.instrument_list(src).collect()] == [2800]


def test_metadata_holdings_and_footer(spark):
    raw = spark.createDataFrame([("1,000", "x", "2024-05-01"), ("-", "y", "bad")], "`AUM ` string, Name string, Listed string")
    m = ingest.metadata(raw, {"aum": ["aum"], "name": ["name"], "listed": ["listed"], "gone": ["nothing"]}, ["aum"], ["listed"]).collect()
    assert [(r.aum, r.listed, r.gone) for r in m] == [(1000.0, dt.date(2024, 5, 1), None), (None, None, None)]
    h = ingest.holdings(spark.createDataFrame([("e", "s", "n", "0.2"), ("e", "", "", "0.3")], "etf_ticker string, symbol string, name string, `Holding Percent` string")).collect()
    assert len(h) == 1 and abs(h[0].weight - 20) < 1e-9
    assert ingest.drop_footer(spark.range(10), "id").count() == 8


def test_layouts_cache_and_jsonl(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, ingest.first_layout([a, b], ["k"]).collect())) == [(1, "a"), (2, "b")]
    made = []
    build = lambda: made.append(1) or b
    key = ingest.cache_key(b, "fast", "v1")
    assert len(key) == 16 and key != ingest.cache_key(a, "fast", "v1")
    for _ in range(2):
        assert ingest.cached(spark, str(tmp_path / "cache"), key, build).count() == 2
    assert len(made) == 1
    (tmp_path / "x.jsonl").write_text('{"id":"1","messages":[{"role":"user","content":"q"}]}\n\n{"id":"2"}\n')
    assert ingest.jsonl_messages(spark, str(tmp_path / "x.jsonl")).count() == 1
    ingest.write_summary(b.agg(F.count("*").alias("n")), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first()[0] == '{"n":2}'


def test_streams_match_batch(spark, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props").repartition(2).write.parquet(str(src))
    q = news.daily_scores(news.event_stream(spark, str(src))).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(str(src)).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).collect()
    assert {r.day: r.events for r in spark.table("daily").collect()} == {r.day: r.n for r in batch}
    seen = []
    spark.createDataFrame([(1, [1.0])], "query_id long, q array<double>").write.parquet(str(tmp_path / "q"))
    queries = spark.readStream.schema("query_id long, q array<double>").parquet(str(tmp_path / "q"))
    corpus = spark.createDataFrame([(1, [0.5]), (2, [0.9])], "item long, v array<double>")
    news.retrieve_batches(queries, corpus, 1, lambda df, i: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert [r["item"] for r in seen] == [2]
