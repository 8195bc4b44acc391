"""Readers and writers at the engine's edge: every scan has a schema, bad values become null, order becomes a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestream.frames import keep_first, resolve
from lodestream.functions import columns as C

BARS = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])
HOLDINGS = T.StructType([T.StructField(c, T.StringType()) for c in ("etf_ticker", "yahoo_ticker", "symbol", "name")] + [T.StructField("weight", T.DoubleType())])
SENTENCES = T.StructType([T.StructField("sentence_id", T.IntegerType()), T.StructField("text", T.StringType())])


def csv(spark: SparkSession, path: str, schema: T.StructType | str, skip_unreadable: bool = False) -> DataFrame:
    """Header, quotes and line breaks inside fields, a byte-order mark before the first name. A file that cannot be read is an
    error, unless it is to be skipped; ``unread_files`` names those."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").option("enforceSchema", True).option("ignoreCorruptFiles", skip_unreadable).csv(path)


def unread_files(read: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """(file): the files under ``path`` of which ``read`` has no row."""
    name = lambda c: F.regexp_replace(c, r"^\w+:/+", "/")
    there = spark.read.format("binaryFile").load(path).select(name(F.col("path")).alias("file"))
    return there.join(read.select(name(F.input_file_name()).alias("file")).distinct(), "file", "left_anti")


def merge_replies(cache: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """A keyed cache of replies after new ones: a new reply replaces the old one of its key."""
    return cache.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def sentence_files(spark: SparkSession, path: str) -> DataFrame:
    """Many sentence files, the ticker from the folder over ``csv`` and the file name, with the weight of its kind."""
    f = F.input_file_name()
    d = csv(spark, path, SENTENCES).select("*", F.regexp_extract(f, r"/([^/]+)/csv/[^/]+$", 1).alias("ticker"), F.regexp_extract(f, r"([^/]+)$", 1).alias("source_file"))
    return d.withColumn("weight", C.document_weight(F.col("source_file")))


def jsonl_messages(spark: SparkSession, path: str) -> DataFrame:
    """ChatML lines; blank lines and rows without messages are skipped; none at all is an error."""
    d = spark.read.schema("id string, messages array<struct<role:string,content:string>>, metadata map<string,string>").json(path).filter(F.size("messages") > 0)
    if d.isEmpty():
        raise ValueError(f"no rows with messages in {path}")
    return d


def drop_footer(df: DataFrame, order: str, rows: int = 2) -> DataFrame:
    """All but the last ``rows`` by ``order``; the bound is found by a top-k, not by a global sort."""
    last = [r[0] for r in df.select(order).orderBy(F.col(order).desc()).limit(rows).collect()]
    return df if not last else df.filter(F.col(order) < min(last))


def metadata(df: DataFrame, names: dict[str, list[str]], numeric: list[str], dates: list[str] = ()) -> DataFrame:
    """Rename by the first known name of each column, clean numbers and dates, normalise the code; missing ones are null."""
    cols = []
    for to, known in names.items():
        got = resolve(df, known)
        c = F.col(f"`{got}`") if got else F.lit(None).cast("string")
        c = C.clean_numeric(c) if to in numeric else F.to_date(F.try_to_timestamp(c.cast("string"))) if to in dates else c
        cols.append(c.alias(to))
    return df.select(*cols)


def holdings(df: DataFrame) -> DataFrame:
    """(etf_ticker, symbol, name, weight, row_idx) from drifting column names; weights over 1 on average are percentages."""
    pick = lambda names, parts=(): (lambda g: F.col(f"`{g}`") if g else F.lit(None).cast("string"))(resolve(df, names, parts))
    d = df.select(
        pick(["etf_ticker", "ticker"]).alias("etf_ticker"), pick(["symbol", "code"]).alias("symbol"), pick(["name", "holding name"], ["holding"]).alias("name"),
        C.clean_numeric(pick(["weight", "holding percent", "% assets"], ["percent", "weight", "holding"])).alias("weight"), F.monotonically_increasing_id().alias("row_idx"),
    )
    d = d.filter(~((F.coalesce(F.trim("symbol"), F.lit("")) == "") & (F.coalesce(F.trim("name"), F.lit("")) == "")))
    mean = d.groupBy("etf_ticker").agg(F.avg("weight").alias("m"))
    return d.join(mean, "etf_ticker", "left").withColumn("weight", F.when(F.col("m") <= 1, F.col("weight") * 100).otherwise(F.col("weight"))).drop("m")


def first_layout(candidates: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of several layouts; for a key the first layout that has it wins."""
    out = None
    for i, c in enumerate(candidates):
        c = c.withColumn("_layout", F.lit(i))
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    best = out.groupBy(*keys).agg(F.min("_layout").alias("_layout"))
    return out.join(best, [*keys, "_layout"], "left_semi").drop("_layout")


def latest_run(df: DataFrame, column: str = "run_ts") -> DataFrame:
    from lodestream.frames import latest_snapshot

    return latest_snapshot(df, column)


def instrument_list(df: DataFrame) -> DataFrame:
    """Distinct codes from the first known code column; home currency and code limit apply only if both columns exist."""
    code = resolve(df, ["Stock code*", "Stock code", "stock_code", "ticker", "code", "instruments"])
    if code is None:
        raise ValueError("no code column")
    number = C.clean_numeric(F.col(f"`{code}`")).cast("bigint")
    currency = resolve(df, ["Base currency*", "Base currency"])
    if currency:
        df = df.filter((number < 8000) & (F.col(f"`{currency}`") == "HKD"))
    return df.select(number.alias("instruments")).filter("instruments is not null").distinct()


def write_lists(lists: DataFrame, path: str) -> None:
    """One folder a list."""
    lists.write.mode("overwrite").partitionBy("list").parquet(path)


def write_by(df: DataFrame, path: str, *columns: str) -> None:
    """One folder a value of the columns (perspective, say), each written by few tasks; a later read prunes by them."""
    df.repartition(*columns, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy(*columns).parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """One JSON record a line, as ``jsonl_messages`` reads them; from (record) or from the columns as they stand."""
    line = F.col("record") if "record" in records.columns else F.to_json(F.struct("*"))
    records.select(line.alias("value")).write.mode("overwrite").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def cache_key(df: DataFrame, *parts: str) -> str:
    """Sixteen hex digits that name a cached result by its inputs: row count, character sum and the given parts."""
    text = [c for c, t in df.dtypes if t == "string"]
    total = sum((F.coalesce(F.length(c), F.lit(0)) for c in text), F.lit(0))
    r = df.agg(F.count("*").alias("n"), F.sum(total).alias("chars"))
    return r.select(F.substring(F.sha1(F.to_json(F.struct(*[F.lit(p).alias(f"p{i}") for i, p in enumerate(parts)], "n", "chars"))), 1, 16).alias("k")).first()["k"]


def cached(spark: SparkSession, folder: str, key: str, build) -> DataFrame:
    """The Parquet cache under ``folder/key``, built on first use; any path that Spark reads will do."""
    path = f"{folder}/{key}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
