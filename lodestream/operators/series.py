"""Price-series operators over one long table (ticker, date, close)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

YEAR = 252


def with_returns(bars: DataFrame) -> DataFrame:
    """Adds ``ret`` (log return over valid closes), ``n`` (closes of the ticker) and ``age`` (1 for the latest).

    One window order serves all three, so the bars are shuffled and sorted once.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    good = bars.filter(F.col("close").isNotNull())
    ordered = good.select("ticker", "date", "close", F.lag("close").over(w).alias("before"), F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy("ticker")).alias("n"))
    ratio = F.when((F.col("close") > 0) & (F.col("before") > 0), F.col("close") / F.col("before"))
    return ordered.select("ticker", "date", "close", F.ln(ratio).alias("ret"), "n", (F.col("n") - F.col("rn") + 1).alias("age"))


def _lookback(periods: int) -> Column:
    """Return over ``periods`` rows back; null without enough rows or with a start that is not positive."""
    end, start = F.max(F.when(F.col("age") == 1, F.col("close"))), F.max(F.when(F.col("age") == periods + 1, F.col("close")))
    return F.when(start > 0, end / start - 1)


def risk_features(bars: DataFrame, least: int = 200, rolling: int = 30, window: int = 3 * YEAR) -> DataFrame:
    """Per ticker: returns over 1, 3 and 5 years, volatilities, Sharpe ratio, return to risk. One aggregate over the
    ordered rows; tickers of fewer than ``least`` closes drop out."""
    r = with_returns(bars).filter(F.col("n") >= max(31, least))
    late, trail = F.when(F.col("age") <= rolling, F.col("ret")), F.when(F.col("age") <= window, F.col("ret"))
    root = F.sqrt(F.lit(float(YEAR)))
    a = r.groupBy("ticker").agg(
        F.count("ret").alias("obs_count"),
        F.avg("ret").alias("mean_daily_log_return"),
        _lookback(YEAR).alias("return_1y"), _lookback(3 * YEAR).alias("return_3y"), _lookback(5 * YEAR).alias("return_5y"),
        F.when(F.count(late) >= rolling, F.stddev_samp(late) * root).alias("volatility_30d"),
        (F.stddev_samp("ret") * root).alias("annualized_volatility"),
        F.when(F.stddev_samp(trail) > 0, F.avg(trail) / F.stddev_samp(trail) * root).alias("sharpe_ratio"),
    )
    yearly = F.array_compact(F.array("return_1y", F.col("return_3y") / 3, F.col("return_5y") / 5))
    mean = F.when(F.size(yearly) > 0, F.aggregate(yearly, F.lit(0.0), lambda s, x: s + x) / F.size(yearly))
    risk = F.when(F.col("annualized_volatility") > 0, F.col("return_1y") / F.col("annualized_volatility"))
    return a.select("*", mean.alias("average_yearly_return"), risk.alias("return_to_risk_1y"))


def monthly_volatility(bars: DataFrame) -> DataFrame:
    """Deviation of month-end returns; months without bars carry the last close, hence a return of 0."""
    ends = bars.filter(F.col("close").isNotNull()).groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("close"))
    spine = ends.groupBy("ticker").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("ticker", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    w = Window.partitionBy("ticker").orderBy("month")
    filled = spine.join(ends, ["ticker", "month"], "left").withColumn("close", F.last("close", ignorenulls=True).over(w))
    moved = filled.withColumn("r", F.try_divide("close", F.lag("close").over(w)) - 1)
    return moved.groupBy("ticker").agg(F.stddev_samp("r").alias("monthly_volatility"), F.count("*").alias("months"))


def correlation_and_beta(bars: DataFrame, benchmarks: DataFrame, window: int = 3 * YEAR, overlap: int = YEAR) -> DataFrame:
    """Per ticker and benchmark over the last ``window`` common dates; fewer than ``overlap`` give none.

    Correlation is guarded: a constant side gives null instead of an error.
    """
    own = with_returns(bars).filter("ret is not null").select("ticker", "date", F.col("ret").alias("x"))
    ref = with_returns(benchmarks).filter("ret is not null").select(F.col("ticker").alias("benchmark"), "date", F.col("ret").alias("y"))
    j = own.join(ref, "date").withColumn("age", F.row_number().over(Window.partitionBy("ticker", "benchmark").orderBy(F.col("date").desc())))
    a = j.filter(F.col("age") <= window).groupBy("ticker", "benchmark").agg(
        F.count("*").alias("overlap"), F.covar_samp("x", "y").alias("c"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"), F.regr_slope("x", "y").alias("beta")
    )
    return a.filter(F.col("overlap") >= overlap).select("ticker", "benchmark", "overlap", F.try_divide("c", F.col("sx") * F.col("sy")).alias("corr"), "beta")


def week_return(bars: DataFrame) -> DataFrame:
    """Percent from the sixth last close to the last; tickers with fewer than six drop out."""
    r = with_returns(bars).filter("n >= 6 and age in (1, 6)").groupBy("ticker").agg(
        F.max(F.when(F.col("age") == 1, F.col("close"))).alias("last_close"), F.max(F.when(F.col("age") == 6, F.col("close"))).alias("start_close")
    )
    return r.withColumn("week_return", F.when(F.col("start_close") > 0, (F.col("last_close") / F.col("start_close") - 1) * 100))
