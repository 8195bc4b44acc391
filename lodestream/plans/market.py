"""Queries over price bars, features, pairs and screens, with their SQL.

Roles of the tables: an instrument is a nation whose close is the day's mean unit price; benchmarks are the same by
order priority; parts and suppliers are metadata; embeddings are feature vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream import frames
from lodestream.frames import read
from lodestream.functions import columns as C
from lodestream.operators import clustering, pairs, series

Q: dict = {}
SQL: dict[str, str] = {}
NEAR = 1.2  # of unit vectors in 64 dimensions about one pair in a hundred is as near


def query(f):
    Q[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def bars(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
    su, na = read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), read(spark, d, "nation").select("n_nationkey", "n_name")
    by = li.groupBy("l_suppkey", "date").agg(F.sum(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.count("*").alias("c"), F.sum("l_quantity").alias("v"))
    j = by.join(su, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(na), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("ticker"), "date").agg((F.sum("p") / F.sum("c")).alias("close"), F.sum("v").alias("volume"))


def benchmark_bars(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("ticker"), "date").agg(F.avg("p").alias("close"))


BARS = """
bars AS (SELECT n_name AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
r AS (SELECT ticker, date, close, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS ret,
  count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM bars)"""


@query
def return_risk_features(spark, d):
    return rounded(series.risk_features(bars(spark, d)))


def _risk_sql(tail: str) -> str:
    return f"""WITH {BARS},
a AS (SELECT ticker, count(ret) AS obs_count, avg(ret) AS mean_daily_log_return,
  max(close) FILTER (WHERE age = 1) / max(close) FILTER (WHERE age = 253) - 1 AS return_1y,
  max(close) FILTER (WHERE age = 1) / max(close) FILTER (WHERE age = 757) - 1 AS return_3y,
  max(close) FILTER (WHERE age = 1) / max(close) FILTER (WHERE age = 1261) - 1 AS return_5y,
  CASE WHEN count(ret) FILTER (WHERE age <= 30) >= 30 THEN stddev_samp(ret) FILTER (WHERE age <= 30) * sqrt(252) END AS volatility_30d,
  stddev_samp(ret) * sqrt(252) AS annualized_volatility,
  avg(ret) FILTER (WHERE age <= 756) / stddev_samp(ret) FILTER (WHERE age <= 756) * sqrt(252) AS sharpe_ratio
  FROM r WHERE n >= 200 GROUP BY ticker),
f AS (SELECT *, (coalesce(return_1y, 0) + coalesce(return_3y / 3, 0) + coalesce(return_5y / 5, 0)) /
  nullif((return_1y IS NOT NULL)::INT + (return_3y IS NOT NULL)::INT + (return_5y IS NOT NULL)::INT, 0) AS average_yearly_return,
  return_1y / annualized_volatility AS return_to_risk_1y FROM a)
{tail}"""


SQL["return_risk_features"] = _risk_sql("""SELECT ticker, obs_count, round(mean_daily_log_return, 6) AS mean_daily_log_return, round(return_1y, 6) AS return_1y, round(return_3y, 6) AS return_3y,
  round(return_5y, 6) AS return_5y, round(volatility_30d, 6) AS volatility_30d, round(annualized_volatility, 6) AS annualized_volatility, round(sharpe_ratio, 6) AS sharpe_ratio,
  round(average_yearly_return, 6) AS average_yearly_return, round(return_to_risk_1y, 6) AS return_to_risk_1y FROM f""")


@query
def monthly_volatility(spark, d):
    return rounded(series.monthly_volatility(bars(spark, d)))


SQL["monthly_volatility"] = f"""WITH {BARS},
e AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(close, date) AS close FROM bars GROUP BY 1, 2),
s AS (SELECT ticker, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM e GROUP BY ticker),
g AS (SELECT s.ticker, s.month, last_value(e.close IGNORE NULLS) OVER (PARTITION BY s.ticker ORDER BY s.month) AS close FROM s LEFT JOIN e ON e.ticker = s.ticker AND e.month = s.month),
m AS (SELECT ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY month) - 1 AS x FROM g)
SELECT ticker, round(stddev_samp(x), 6) AS monthly_volatility, count(*) AS months FROM m GROUP BY ticker"""


@query
def macro_corr_beta(spark, d):
    return rounded(series.correlation_and_beta(bars(spark, d), benchmark_bars(spark, d)))


SQL["macro_corr_beta"] = f"""WITH {BARS},
b0 AS (SELECT o_orderpriority AS benchmark, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
b AS (SELECT benchmark, date, ln(close / lag(close) OVER (PARTITION BY benchmark ORDER BY date)) AS y FROM b0),
j AS (SELECT r.ticker, b.benchmark, r.ret AS x, b.y, row_number() OVER (PARTITION BY r.ticker, b.benchmark ORDER BY r.date DESC) AS age
  FROM r JOIN b ON r.date = b.date WHERE r.ret IS NOT NULL AND b.y IS NOT NULL)
SELECT ticker, benchmark, count(*) AS overlap, round(covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)), 6) AS corr, round(regr_slope(x, y), 6) AS beta
FROM j WHERE age <= 756 GROUP BY 1, 2 HAVING count(*) >= 252"""


@query
def feature_table_imputed(spark, d):
    """Universe semi-join, date cutoff that nulls pass, medians by brand, guarded ratio, mean fill."""
    part = read(spark, d, "part").select("p_partkey", "p_brand", F.nullif(F.col("p_size") % 7, F.lit(0)).cast("double").alias("aum"), F.nullif(F.col("p_size") % 3, F.lit(0)).cast("double").alias("charges"), "p_retailprice")
    li = read(spark, d, "lineitem").filter(F.col("l_shipdate").isNull() | (F.col("l_shipdate") <= F.lit("1999-12-31").cast("timestamp")))
    agg = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg(F.when(F.col("l_discount") > 0.05, F.col("l_discount"))).alias("discount"), F.max("l_quantity").alias("top"))
    universe = read(spark, d, "lineitem").filter("l_quantity >= 30").select(F.col("l_partkey").alias("p_partkey")).distinct()
    j = part.join(universe, "p_partkey", "left_semi").join(agg, "p_partkey", "left")
    j = frames.impute(j, "aum", "p_brand").withColumn("yield_to_cost", F.try_divide("discount", "charges"))
    return rounded(frames.mean_fill(j.fillna({"discount": 0.0}), ["yield_to_cost", "charges", "top"]), 8)


SQL["feature_table_imputed"] = """WITH p AS (SELECT p_partkey, p_brand, CAST(nullif(p_size % 7, 0) AS DOUBLE) AS aum, CAST(nullif(p_size % 3, 0) AS DOUBLE) AS charges, p_retailprice FROM part
  WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 30)),
a AS (SELECT l_partkey AS p_partkey, avg(l_discount) FILTER (WHERE l_discount > 0.05) AS discount, max(l_quantity) AS top FROM lineitem WHERE l_shipdate IS NULL OR l_shipdate <= '1999-12-31' GROUP BY 1),
j AS (SELECT p.*, a.discount, a.top, a.discount / p.charges AS yc FROM p LEFT JOIN a USING (p_partkey)),
m AS (SELECT p_brand, median(aum) AS m FROM j GROUP BY 1)
SELECT p_partkey, p_brand, round(coalesce(aum, m.m, (SELECT avg(aum) FROM j)), 8) AS aum, round(coalesce(charges, (SELECT avg(charges) FROM j)), 8) AS charges, round(p_retailprice, 8) AS p_retailprice,
  round(coalesce(discount, 0), 8) AS discount, round(coalesce(top, (SELECT avg(top) FROM j)), 8) AS top, round(coalesce(yc, (SELECT avg(yc) FROM j)), 8) AS yield_to_cost
FROM j LEFT JOIN m USING (p_brand)"""


@query
def winsorised_features(spark, d):
    return rounded(frames.winsorise(read(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_acctbal") * F.col("c_acctbal")).alias("c_square")), ["c_acctbal", "c_square"]), 4)


SQL["winsorised_features"] = """WITH c AS (SELECT c_custkey, c_acctbal AS a, c_acctbal * c_acctbal AS b FROM customer),
q AS (SELECT quantile_cont(a, 0.02) AS al, quantile_cont(a, 0.98) AS ah, quantile_cont(b, 0.02) AS bl, quantile_cont(b, 0.98) AS bh FROM c)
SELECT c_custkey, round(least(greatest(a, al), ah), 4) AS c_acctbal, round(least(greatest(b, bl), bh), 4) AS c_square FROM c, q"""


@query
def concentration_top10(spark, d):
    """Sum of the first ten weights in file order; over 1.5 it is a percentage; clipped to 0..1; 0.9 where unknown."""
    w = read(spark, d, "lineitem").filter("l_quantity > 2").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").alias("w"))
    s = frames.top_n(w, ["o_orderkey"], 10, F.col("l_linenumber")).groupBy("o_orderkey").agg(F.sum("w").alias("s"))
    c = F.least(F.greatest(F.when(F.col("s") > 1.5, F.col("s") / 100).otherwise(F.col("s")), F.lit(0.0)), F.lit(1.0))
    return rounded(read(spark, d, "orders").select("o_orderkey").join(s, "o_orderkey", "left").select("o_orderkey", F.coalesce(c, F.lit(0.9)).alias("concentration")))


SQL["concentration_top10"] = """WITH w AS (SELECT l_orderkey, l_quantity AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem WHERE l_quantity > 2),
s AS (SELECT l_orderkey AS o_orderkey, sum(w) AS s FROM w WHERE i <= 10 GROUP BY 1)
SELECT o_orderkey, round(coalesce(least(greatest(CASE WHEN s > 1.5 THEN s / 100 ELSE s END, 0), 1), 0.9), 6) AS concentration FROM orders LEFT JOIN s USING (o_orderkey)"""


@query
def clean_numeric(spark, d):
    raw = F.concat(F.lit("("), F.format_string("%.2f", "s_acctbal"), F.lit(")%"))
    s = read(spark, d, "supplier")
    return s.select("s_suppkey", C.clean_numeric(raw).alias("number"), C.clean_numeric(F.col("s_name")).alias("from_name"), C.clean_numeric(F.concat(F.lit("1,234.5 "), F.col("s_name"))).alias("from_text"))


SQL["clean_numeric"] = r"""SELECT s_suppkey, TRY_CAST(regexp_replace(format('({:.2f})%', s_acctbal), '[^0-9.\-]', '', 'g') AS DOUBLE) AS number,
  TRY_CAST(regexp_replace(s_name, '[^0-9.\-]', '', 'g') AS DOUBLE) AS from_name, TRY_CAST(regexp_replace('1,234.5 ' || s_name, '[^0-9.\-]', '', 'g') AS DOUBLE) AS from_text FROM supplier"""


@query
def normalise_code(spark, d):
    p = read(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    return p.select(
        "p_partkey", C.digits_code(key).alias("code4"), C.digits_code(F.concat(F.lit("0"), key, F.lit(".HK")), 5).alias("code5"), C.raw_code(F.concat(F.lit("0"), key)).alias("raw"),
        C.exchange_symbol(key).alias("symbol"), C.file_token(F.concat(F.lit("^"), F.col("p_brand"))).alias("token"), C.digits_code(F.lit("abc")).alias("no_digits"),
    )


SQL["normalise_code"] = r"""SELECT p_partkey, CASE WHEN p_partkey < 10000 THEN lpad(p_partkey::VARCHAR, 4, '0') ELSE p_partkey::VARCHAR END AS code4,
  CASE WHEN p_partkey < 100000 THEN lpad(p_partkey::VARCHAR, 5, '0') ELSE p_partkey::VARCHAR END AS code5,
  CASE WHEN length('0' || p_partkey) < 4 THEN lpad('0' || p_partkey, 4, '0') ELSE '0' || p_partkey END AS raw,
  CASE WHEN p_partkey < 10000 THEN lpad(p_partkey::VARCHAR, 4, '0') ELSE p_partkey::VARCHAR END || '.HK' AS symbol,
  regexp_replace(upper('^' || p_brand), '[^A-Za-z0-9]', '', 'g') AS token, 'ABC' AS no_digits FROM part"""


def vectors(spark, d) -> DataFrame:
    """Embeddings as instruments: their dimensions as features, the label as cluster, part columns as labels."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("ticker"), F.transform("embedding", lambda x: x.cast("double")).alias("pcs"), F.col("label").alias("cluster_id"))
    p = read(spark, d, "part").select((F.col("p_partkey") - 1).alias("ticker"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("geo"), F.col("p_type").alias("kind"), F.col("p_size").cast("string").alias("focus"))
    # Merged: the planner takes the few columns that are asked of a large part table for small, and its keys would pass the driver.
    return e.join(p.hint("merge"), "ticker", "left").withColumn("perspective", F.lit("macro"))


_VEC = """v AS (SELECT e.vec_id AS ticker, [CAST(x AS DOUBLE) FOR x IN embedding] AS pcs, e.label AS cluster_id,
  CASE WHEN p_size % 5 <> 0 THEN p_brand END AS geo, p_type AS kind, CAST(p_size AS VARCHAR) AS focus FROM embeddings e LEFT JOIN part ON p_partkey - 1 = e.vec_id)"""


@query
def standardised_matrix(spark, d):
    z = clustering.standardise(read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x")))
    return rounded(z.select("vec_id", F.get("x", F.lit(0)).alias("z_first"), F.try_element_at("x", F.lit(-1)).alias("z_last"), C.norm(F.col("x")).alias("z_norm")))


SQL["standardised_matrix"] = """WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
z AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i) AS z FROM u)
SELECT vec_id, round(max(z) FILTER (WHERE i = 0), 6) AS z_first, round(arg_max(z, i), 6) AS z_last, round(sqrt(sum(z * z)), 6) AS z_norm FROM z GROUP BY vec_id"""


@query
def pca_components(spark, d):
    z = clustering.standardise(vectors(spark, d).select("ticker", F.col("pcs").alias("x")))
    return clustering.principal_components(z).select("ticker", F.size("pcs").alias("n_components"), F.round(C.norm(F.col("pcs")), 6).alias("length"))


@query
def kmeans_clusters(spark, d):
    z = clustering.standardise(vectors(spark, d).select("ticker", F.col("pcs").alias("x")))
    return clustering.best_kmeans(z, 4).select("ticker", "cluster_id")


@query
def auto_clusters(spark, d):
    """The number of clusters of the best mean silhouette, and the cluster of every instrument."""
    z = clustering.standardise(vectors(spark, d).select("ticker", F.col("pcs").alias("x")))
    return clustering.auto_kmeans(z, "ticker").select("ticker", "cluster_id", "selected_k")


@query
def silhouette_by_label(spark, d):
    return rounded(clustering.silhouettes(vectors(spark, d).select("ticker", "cluster_id", "pcs"), "ticker", "cluster_id", "pcs"))


SQL["silhouette_by_label"] = f"""WITH {_VEC},
m AS (SELECT a.ticker, a.cluster_id, b.cluster_id AS o, avg(list_distance(a.pcs, b.pcs)) AS d FROM v a JOIN v b ON a.ticker <> b.ticker GROUP BY 1, 2, 3),
g AS (SELECT ticker, cluster_id, min(d) FILTER (WHERE o = cluster_id) AS a, min(d) FILTER (WHERE o <> cluster_id) AS b FROM m GROUP BY 1, 2)
SELECT ticker, cluster_id, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM g"""


@query
def cluster_sizes(spark, d):
    return vectors(spark, d).groupBy("perspective", "cluster_id").agg(F.count("*").alias("instruments"))


SQL["cluster_sizes"] = "SELECT 'macro' AS perspective, label AS cluster_id, count(*) AS instruments FROM embeddings GROUP BY label"


@query
def cluster_centroids(spark, d):
    return rounded(vectors(spark, d).groupBy("perspective", "cluster_id").agg(F.avg(F.get("pcs", F.lit(0))).alias("pc1"), F.avg(F.get("pcs", F.lit(1))).alias("pc2")))


SQL["cluster_centroids"] = "SELECT 'macro' AS perspective, label AS cluster_id, round(avg(embedding[1]::DOUBLE), 6) AS pc1, round(avg(embedding[2]::DOUBLE), 6) AS pc2 FROM embeddings GROUP BY label"


@query
def home_bias_pairs(spark, d):
    return rounded(pairs.home_bias(vectors(spark, d), NEAR))


SQL["home_bias_pairs"] = f"""WITH {_VEC}
SELECT 'macro' AS perspective, a.cluster_id, a.ticker AS source_ticker, a.geo AS source_geo, b.ticker AS alternative_ticker, b.geo AS alternative_geo, round(list_distance(a.pcs, b.pcs), 6) AS pc_distance
FROM v a JOIN v b ON a.cluster_id = b.cluster_id AND a.ticker <> b.ticker WHERE b.geo IS NOT NULL AND coalesce(a.geo, '') <> b.geo AND list_distance(a.pcs, b.pcs) <= {NEAR}"""


@query
def hidden_twin_pairs(spark, d):
    return rounded(pairs.hidden_twins(vectors(spark, d), ["geo", "kind", "focus"], NEAR))


SQL["hidden_twin_pairs"] = f"""WITH {_VEC}, w AS (SELECT ticker, pcs, cluster_id, coalesce(geo, '') AS geo, coalesce(kind, '') AS kind, coalesce(focus, '') AS focus FROM v),
j AS (SELECT a.cluster_id, a.ticker AS ticker_a, b.ticker AS ticker_b, list_distance(a.pcs, b.pcs) AS dist,
  [CASE WHEN a.geo <> '' AND b.geo <> '' AND a.geo <> b.geo THEN 'geo:' || a.geo || '!=' || b.geo END, CASE WHEN a.kind <> '' AND b.kind <> '' AND a.kind <> b.kind THEN 'kind:' || a.kind || '!=' || b.kind END,
   CASE WHEN a.focus <> '' AND b.focus <> '' AND a.focus <> b.focus THEN 'focus:' || a.focus || '!=' || b.focus END] AS m
  FROM w a JOIN w b ON a.cluster_id = b.cluster_id AND a.ticker < b.ticker),
k AS (SELECT *, [x FOR x IN m IF x IS NOT NULL] AS f FROM j)
SELECT 'macro' AS perspective, cluster_id, ticker_a, ticker_b, array_to_string(f, '|') AS label_mismatch, CAST(len(f) AS INTEGER) AS mismatch_count, round(dist, 6) AS pc_distance FROM k WHERE len(f) >= 2 AND dist <= {NEAR}"""


@query
def pairs_degree_capped(spark, d):
    return rounded(pairs.home_bias_capped(vectors(spark, d), NEAR, 3))


@query
def dna_context(spark, d):
    """Per instrument: its clusters by perspective, the dominant one, and the nearest three alternatives of both pair tables."""
    v = vectors(spark, d)
    others = [v.select("ticker", F.lit(f"by_{n}").alias("perspective"), (F.col("ticker") % n).alias("cluster_id")) for n in (3, 4)]
    views = v.select("ticker", "perspective", F.col("cluster_id").cast("long").alias("cluster_id")).unionByName(others[0]).unionByName(others[1])
    c = pairs.context(views, pairs.home_bias(v, NEAR), pairs.hidden_twins(v, ["geo", "kind", "focus"], NEAR))
    told = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in names])), ",")
    return c.select("ticker", "dominant_cluster", told(F.col("clusters"), "perspective", "cluster_id").alias("clusters"), told(F.col("alternatives"), "ticker", "signal").alias("alternatives"))


SQL["dna_context"] = f"""WITH {_VEC}, w AS (SELECT ticker, pcs, cluster_id, coalesce(geo, '') AS geo, coalesce(kind, '') AS kind, coalesce(focus, '') AS focus FROM v),
j AS (SELECT a.ticker, b.ticker AS other, list_distance(a.pcs, b.pcs) AS dist, b.geo <> '' AND a.geo <> b.geo AS home,
  (a.geo <> '' AND b.geo <> '' AND a.geo <> b.geo)::INT + (a.kind <> '' AND b.kind <> '' AND a.kind <> b.kind)::INT + (a.focus <> '' AND b.focus <> '' AND a.focus <> b.focus)::INT >= 2 AS twin
  FROM w a JOIN w b ON a.cluster_id = b.cluster_id AND a.ticker <> b.ticker WHERE list_distance(a.pcs, b.pcs) <= {NEAR}),
k AS (SELECT ticker, other, CASE WHEN home THEN 'home_bias_candidate' ELSE 'hidden_twin_candidate' END AS signal, row_number() OVER (PARTITION BY ticker ORDER BY dist, other) AS i FROM j WHERE home OR twin),
n AS (SELECT ticker, string_agg(other || ':' || signal, ',' ORDER BY i) AS alternatives FROM k WHERE i <= 3 GROUP BY 1),
p AS (SELECT ticker, 'macro' AS p, cluster_id::BIGINT AS c FROM v UNION ALL SELECT ticker, 'by_3', ticker % 3 FROM v UNION ALL SELECT ticker, 'by_4', ticker % 4 FROM v),
o AS (SELECT ticker, c, row_number() OVER (PARTITION BY ticker ORDER BY count(*) DESC, c) AS i FROM p WHERE c IS NOT NULL GROUP BY ticker, c),
t AS (SELECT ticker, string_agg(p || ':' || c, ',' ORDER BY p) AS clusters FROM p WHERE c IS NOT NULL GROUP BY 1)
SELECT t.ticker, o.c AS dominant_cluster, clusters, coalesce(alternatives, '') AS alternatives FROM t JOIN o ON o.ticker = t.ticker AND o.i = 1 LEFT JOIN n ON n.ticker = t.ticker"""


@query
def weekly_winners_losers(spark, d):
    w = series.week_return(bars(spark, d))
    up = frames.top_n(w.withColumn("side", F.lit("winner")), ["side"], 5, F.col("week_return").desc_nulls_last(), F.col("ticker"))
    down = frames.top_n(w.withColumn("side", F.lit("loser")), ["side"], 5, F.col("week_return").asc_nulls_first(), F.col("ticker"))
    total = w.agg(F.avg((F.col("week_return") > 0).cast("int")).alias("share_positive"), F.max("week_return").alias("best"), F.min("week_return").alias("worst"))
    return rounded(up.unionByName(down).crossJoin(F.broadcast(total)).select("side", "rank", "ticker", "week_return", "share_positive", "best", "worst"))


_WEEK = "w AS (SELECT ticker, (max(close) FILTER (WHERE age = 1) / max(close) FILTER (WHERE age = 6) - 1) * 100 AS x FROM r WHERE n >= 6 GROUP BY ticker)"
SQL["weekly_winners_losers"] = f"""WITH {BARS}, {_WEEK},
s AS (SELECT avg((x > 0)::INT) AS share_positive, max(x) AS best, min(x) AS worst FROM w),
u AS (SELECT 'winner' AS side, row_number() OVER (ORDER BY x DESC NULLS LAST, ticker) AS rank, ticker, x FROM w UNION ALL SELECT 'loser', row_number() OVER (ORDER BY x NULLS FIRST, ticker), ticker, x FROM w)
SELECT side, CAST(rank AS INTEGER) AS rank, ticker, round(x, 6) AS week_return, round(share_positive, 6) AS share_positive, round(best, 6) AS best, round(worst, 6) AS worst FROM u, s WHERE rank <= 5"""


@query
def category_top5(spark, d):
    """Best and worst week per region."""
    geo = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("ticker"), F.col("r_name").alias("bucket"))
    w = series.week_return(bars(spark, d)).join(F.broadcast(geo), "ticker").select("bucket", "ticker", "week_return")
    up = frames.top_n(w, ["bucket"], 5, F.col("week_return").desc_nulls_last(), F.col("ticker"), rank="best")
    down = frames.top_n(w, ["bucket"], 5, F.col("week_return").asc_nulls_last(), F.col("ticker"), rank="worst")
    return rounded(up.join(down.select("ticker", "worst"), "ticker", "full").join(w.select("ticker", F.col("week_return").alias("r"), F.col("bucket").alias("b")), "ticker").select("ticker", F.col("b").alias("bucket"), F.col("r").alias("week_return"), F.coalesce("best", F.lit(0)).alias("best"), F.coalesce("worst", F.lit(0)).alias("worst")))


SQL["category_top5"] = f"""WITH {BARS}, {_WEEK},
k AS (SELECT w.ticker, r_name AS bucket, x, row_number() OVER (PARTITION BY r_name ORDER BY x DESC, w.ticker) AS best, row_number() OVER (PARTITION BY r_name ORDER BY x, w.ticker) AS worst
  FROM w JOIN nation ON n_name = w.ticker JOIN region ON n_regionkey = r_regionkey)
SELECT ticker, bucket, round(x, 6) AS week_return, CASE WHEN best <= 5 THEN CAST(best AS INTEGER) ELSE 0 END AS best, CASE WHEN worst <= 5 THEN CAST(worst AS INTEGER) ELSE 0 END AS worst FROM k WHERE best <= 5 OR worst <= 5"""


@query
def last_252_closes(spark, d):
    return rounded(series.with_returns(bars(spark, d)).filter("age <= 252").select("ticker", F.col("date").cast("string").alias("date"), "close"))


SQL["last_252_closes"] = f"WITH {BARS} SELECT ticker, strftime(date, '%Y-%m-%d') AS date, round(close, 6) AS close FROM r WHERE age <= 252"


def screen(df: DataFrame, search: str = "", search_in: list[str] = (), choices: dict[str, list] | None = None, ranges: dict[str, tuple] | None = None) -> DataFrame:
    """Literal search in any column, choices, inclusive ranges (nulls drop once a range applies); all pushed to the scan."""
    for c, values in (choices or {}).items():
        df = df.filter(F.col(c).isin(values))
    for c, (lo, hi) in (ranges or {}).items():
        df = df.filter(F.col(c).between(lo, hi))
    if search:
        df = df.filter(C.contains_any(F.concat_ws("\x00", *search_in), [search.lower()]))
    return df


@query
def screener(spark, d):
    p = screen(read(spark, d, "part"), "a", ["p_name", "p_type"], {"p_brand": [f"Brand#{i}{j}" for i in range(1, 4) for j in range(1, 6)]}, {"p_size": (5, 40), "p_retailprice": (900.0, 1800.0)})
    return frames.top_n(p.withColumn("one", F.lit(1)), ["one"], 200, F.col("p_retailprice").desc(), F.col("p_partkey")).select("rank", "p_partkey", "p_brand", "p_size", "p_retailprice", C.asset_bucket(F.col("p_type")).alias("bucket"), C.percent(F.col("p_size") * 1.0, 1).alias("shown"))


SQL["screener"] = """WITH s AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part
  WHERE p_brand IN ('Brand#11','Brand#12','Brand#13','Brand#14','Brand#15','Brand#21','Brand#22','Brand#23','Brand#24','Brand#25','Brand#31','Brand#32','Brand#33','Brand#34','Brand#35')
  AND p_size BETWEEN 5 AND 40 AND p_retailprice BETWEEN 900 AND 1800 AND (contains(lower(p_name), 'a') OR contains(lower(p_type), 'a')))
SELECT CAST(rank AS INTEGER) AS rank, p_partkey, p_brand, p_size, p_retailprice, CASE WHEN contains(lower(p_type), 'equity') THEN 'Equity' ELSE 'Other' END AS bucket, format('{:.1f}%', p_size * 1.0::DOUBLE) AS shown FROM s WHERE rank <= 200"""


@query
def screener_bounds(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("options"))


SQL["screener_bounds"] = "SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi, (SELECT string_agg(t, '|' ORDER BY t) FROM (SELECT DISTINCT p_type AS t FROM part q WHERE q.p_brand = p.p_brand)) AS options FROM part p GROUP BY p_brand"


@query
def instrument_lists(spark, d):
    """Three lists from one scan: all, those in the home currency under a code limit, the rest."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("instrument"), (F.coalesce((F.col("s_suppkey") < 80) & (F.col("s_acctbal") > 0), F.lit(False))).alias("home")).distinct()
    return s.select("instrument", F.explode(F.array(F.lit("all"), F.when(F.col("home"), "home").otherwise("other"))).alias("list"))


SQL["instrument_lists"] = "SELECT s_suppkey AS instrument, 'all' AS list FROM supplier UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey < 80 AND s_acctbal > 0 THEN 'home' ELSE 'other' END FROM supplier"


@query
def universe_sets(spark, d):
    """Intersection and union of two key sets, and rows of unequal columns put together."""
    a, b = read(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("k")), read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    both = a.intersect(b.select("k")).withColumn("set", F.lit("both"))
    return both.unionByName(a.union(b.select("k")).distinct().withColumn("set", F.lit("any"))).unionByName(b.withColumn("set", F.lit("customer")), allowMissingColumns=True)


SQL["universe_sets"] = """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 100000), b AS (SELECT c_custkey AS k, c_mktsegment FROM customer WHERE c_acctbal > 0)
SELECT k, 'both' AS set, NULL AS c_mktsegment FROM a WHERE k IN (SELECT k FROM b) UNION ALL SELECT k, 'any', NULL FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT k, 'customer', c_mktsegment FROM b"""


@query
def point_labels(spark, d):
    """Name with geography in brackets; blanks are NA."""
    s = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.select("s_suppkey", C.point_label(F.col("s_name"), F.when(F.col("s_acctbal") > 0, F.col("n_name"))).alias("label"))


SQL["point_labels"] = "SELECT s_suppkey, coalesce(nullif(trim(s_name), ''), 'NA') || ' (' || CASE WHEN s_acctbal > 0 THEN coalesce(nullif(trim(n_name), ''), 'NA') ELSE 'NA' END || ')' AS label FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"


@query
def mappable_universe(spark, d):
    """Codes that both corpora know, or those of the one that is not empty; each with its last name."""
    a, b = read(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("code")), read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("code"))
    names = frames.last_of(read(spark, d, "orders"), "o_custkey", "o_orderpriority", F.col("o_orderkey"))
    got = frames.mappable(a, b, "code").withColumn("universe", F.lit("both")).unionByName(frames.mappable(a.filter("code < 0"), b, "code").withColumn("universe", F.lit("second")))
    return got.join(names.toDF("code", "last_name"), "code", "left")


SQL["mappable_universe"] = """WITH a AS (SELECT DISTINCT o_custkey AS code FROM orders WHERE o_totalprice > 100000), b AS (SELECT DISTINCT c_custkey AS code FROM customer WHERE c_acctbal > 0),
g AS (SELECT code, 'both' AS universe FROM a WHERE code IN (SELECT code FROM b) UNION ALL SELECT code, 'second' FROM b),
n AS (SELECT o_custkey AS code, arg_max(o_orderpriority, o_orderkey) AS last_name FROM orders GROUP BY 1)
SELECT g.code, universe, last_name FROM g LEFT JOIN n USING (code)"""


@query
def code_names(spark, d):
    """File names and titles of instruments, their codes' stems, the code in a path, and what a category says."""
    p = read(spark, d, "part")
    folder = F.concat(F.lit("docs/"), F.when(F.col("p_partkey") % 3 == 0, F.lpad(F.col("p_partkey").cast("string"), 4, "0")).otherwise(F.col("p_partkey").cast("string")), F.when(F.col("p_partkey") % 2 == 0, "/csv/csv").otherwise("/csv"))
    return p.select(
        "p_partkey", C.safe_file_name(F.concat("p_name", F.lit(": "), "p_brand", F.lit("?"))).alias("file"), C.safe_title(F.concat("p_name", F.lit(" (!) "), "p_type")).alias("title"),
        F.array_join(C.file_stems(F.concat(F.lit("0"), F.col("p_partkey").cast("string"))), ",").alias("stems"), C.code_of_path(folder).alias("code"),
        C.is_fund_category(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Equity ETF "), "p_type"))).alias("is_fund"), C.asset_bucket(F.get(F.array(*[F.lit(x) for x in ("Equity fund", "Commodity", "Bond", "Money Market", "Mixed")]), (F.col("p_partkey") % 5).cast("int"))).alias("bucket"),
    )


SQL["code_names"] = r"""WITH p AS (SELECT *, p_partkey::VARCHAR AS k FROM part)
SELECT p_partkey, trim(regexp_replace(p_name || ': ' || p_brand || '?', '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS file,
  left(regexp_replace(trim(regexp_replace(p_name || ' (!) ' || p_type, '[^A-Za-z0-9\s_-]', '', 'g')), '\s+', '_', 'g'), 60) AS title,
  array_to_string(list_distinct_in_order, ',') AS stems, CASE WHEN regexp_full_match(f, '\d{4,5}') THEN lpad(f, 5, '0') ELSE 'UNKNOWN' END AS code,
  p_size % 2 = 0 AS is_fund, CASE p_partkey % 5 WHEN 0 THEN 'Equity' WHEN 1 THEN 'Commodity' WHEN 4 THEN 'Other' ELSE 'Fixed Income' END AS bucket
FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 AND p_partkey < 10000 THEN lpad(k, 4, '0') WHEN p_partkey % 3 = 0 THEN left(k, 4) ELSE k END AS f,
  list_filter(['0' || k, CASE WHEN length(k) < 4 AND lpad(k, 4, '0') <> '0' || k THEN lpad(k, 4, '0') WHEN length(k) >= 4 THEN k END, CASE WHEN length(k) < 4 THEN lpad(k, 5, '0') WHEN length(k) = 4 AND '0' || k <> lpad(k, 5, '0') THEN lpad(k, 5, '0') END], lambda x: x IS NOT NULL) AS list_distinct_in_order FROM p)"""
