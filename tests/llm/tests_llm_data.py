"""Small tables that the tests of the training-data operators share."""

DOCS = "/root/testdata/sf0.001"


def as_table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def odd_documents(spark):
    """Empty table; nulls in any column; ties, repeated rows and a very long text; extra columns with clashing names."""
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    yield spark.createDataFrame([], cols)
    yield spark.createDataFrame([(None, None, None, None, None), (1, None, None, "s", 0), (2, "", "en", None, 0), (None, "one two three four five six", "en", "s", 27)], cols)
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    yield spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13)] * 3 + [(1, "another text of the same id here", "de", "s", 20), (2, long, "en", "s", len(long)), (3, "x\n" * 4000, "en", "s", 8000)], cols)
    extra = "doc_id long, text string, lang string, source string, n_chars long, row string, k long, h long, pos long, label long, p double, tokens long, at long, id long, blob string, spans string, hash string, bucket long, rate double"
    yield spark.createDataFrame([(i, f"some words of text number {i} and more words of it", "en", "s", 40, "r", 1, 2, 3, 4, 0.5, 6, 7, 8, "b", "s", "h", 9, 1.0) for i in range(6)], extra)
