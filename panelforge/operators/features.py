"""Per-symbol technical features over daily bars on a gap-free session spine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.semantics import lag, ratio, rolling

KEYS = ["symbol", "date"]


def ret(k: int):
    return ratio(F.col("close"), lag(F.col("close"), k)) - 1


def returns(bars: DataFrame, spans=(1, 5, 10, 20, 60, 120)) -> DataFrame:
    """k-session returns and the 5-session reversal."""
    return bars.select(*KEYS, *[ret(k).alias(f"return_{k}d") for k in spans], (-ret(5)).alias("reversal_5d"))


def skip_momentum(bars: DataFrame, pairs=((126, 10), (252, 20))) -> DataFrame:
    """Return from `long` to `skip` sessions ago."""
    return bars.select(*KEYS, *[(ratio(lag(F.col("close"), s), lag(F.col("close"), n)) - 1).alias(f"momentum_{n}_{s}") for n, s in pairs])


def _daily(bars: DataFrame) -> DataFrame:
    return bars.withColumn("r1", ret(1))


def volatility(bars: DataFrame, spans=(20, 60)) -> DataFrame:
    """Sample deviation of one-session returns, and of their losses alone."""
    r, down = F.col("r1"), F.least(F.col("r1"), F.lit(0.0))
    cols = [rolling(F.stddev_samp, r, n).alias(f"volatility_{n}d") for n in spans]
    return _daily(bars).select(*KEYS, *cols, *[rolling(F.stddev_samp, F.when(r.isNotNull(), down), n).alias(f"downside_{n}d") for n in spans])


def max_return(bars: DataFrame, n: int = 20) -> DataFrame:
    return _daily(bars).select(*KEYS, rolling(F.max, F.col("r1"), n).alias(f"max_return_{n}d"))


def moving_averages(bars: DataFrame, spans=(20, 50, 100, 200)) -> DataFrame:
    """Simple averages, price against each, and ratios of neighbours."""
    sma = {n: rolling(F.avg, F.col("close"), n) for n in spans}
    df = bars.select(*KEYS, "close", *[x.alias(f"sma_{n}") for n, x in sma.items()])
    gaps = [(ratio(F.col("close"), F.col(f"sma_{n}")) - 1).alias(f"price_vs_sma_{n}") for n in spans]
    pairs = [(ratio(F.col(f"sma_{a}"), F.col(f"sma_{b}")) - 1).alias(f"sma_{a}_vs_{b}") for a, b in zip(spans, spans[1:], strict=False)]
    return df.select(*KEYS, *[f"sma_{n}" for n in spans], *gaps, *pairs)


def rsi(bars: DataFrame, n: int = 14, fill: bool = False) -> DataFrame:
    """Relative strength over simple averages: 100 when all moves gain, 50 when flat, null in warm-up.

    With `fill`, the older rule: 50 in warm-up and wherever there is no loss.
    """
    d = F.col("close") - lag(F.col("close"), 1)
    df = bars.withColumn("d", d)
    gain = rolling(F.avg, F.when(F.col("d").isNotNull(), F.greatest(F.col("d"), F.lit(0.0))), n)
    loss = rolling(F.avg, F.when(F.col("d").isNotNull(), -F.least(F.col("d"), F.lit(0.0))), n)
    df = df.select(*KEYS, gain.alias("g"), loss.alias("l"))
    g, l_ = F.col("g"), F.col("l")
    value = F.when(l_ > 0, 100 - 100 / (1 + g / l_))
    out = F.coalesce(value, F.lit(50.0)) if fill else F.when(l_.isNull(), None).when((l_ == 0) & (g > 0), 100.0).when(l_ == 0, 50.0).otherwise(value)
    return df.select(*KEYS, out.alias(f"rsi_{n}"))


def volume_features(bars: DataFrame, spans=(20, 60)) -> DataFrame:
    """Volume against its averages, dollar volume and its logarithm."""
    dollars = F.col("close") * F.col("volume")
    cols = [ratio(F.col("volume"), rolling(F.avg, F.col("volume"), n)).alias(f"volume_ratio_{n}d") for n in spans]
    return bars.select(*KEYS, *cols, dollars.alias("dollar_volume"), F.log1p(dollars).alias("log_dollar_volume"))


def illiquidity(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean absolute return per dollar traded."""
    df = _daily(bars).withColumn("x", ratio(F.abs("r1"), F.col("close") * F.col("volume")))
    return df.select(*KEYS, rolling(F.avg, F.col("x"), n).alias(f"illiquidity_{n}d"))


def vol_adjusted(bars: DataFrame, spans=(20, 60), n: int = 20) -> DataFrame:
    df = _daily(bars).withColumn("v", rolling(F.stddev_samp, F.col("r1"), n))
    return df.select(*KEYS, *[ratio(ret(k), F.col("v")).alias(f"vol_adjusted_{k}d") for k in spans])


def range_distance(bars: DataFrame, n: int = 252) -> DataFrame:
    """Distance of the close from the highest and lowest close of n sessions."""
    return bars.select(*KEYS, (ratio(F.col("close"), rolling(F.max, F.col("close"), n)) - 1).alias(f"from_high_{n}d"), (ratio(F.col("close"), rolling(F.min, F.col("close"), n)) - 1).alias(f"from_low_{n}d"))


def with_benchmark(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Bars with the benchmark's close of the day (a row a day, so a small side)."""
    return bars.join(bench.select("date", "bench_close"), "date", "left")


def beta(bars: DataFrame, bench: DataFrame, n: int = 60) -> DataFrame:
    """Rolling beta (n complete pairs; the variance of the benchmark alone) and the return it leaves unexplained."""
    r = bench.select("date", "bench_close").withColumn("b1", F.col("bench_close") / F.lag("bench_close").over(Window.orderBy("date")) - 1)
    df = _daily(bars).join(r, "date", "left")
    pair = F.when(F.col("r1").isNotNull() & F.col("b1").isNotNull(), 1)
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1 - n, 0)
    cov = F.when(F.count(pair).over(w) == n, F.covar_samp("r1", "b1").over(w))
    df = df.withColumn(f"beta_{n}d", ratio(cov, rolling(F.var_samp, F.col("b1"), n)))
    return df.select(*KEYS, f"beta_{n}d", (F.col("r1") - F.col(f"beta_{n}d") * F.col("b1")).alias("idiosyncratic_1d"))


def true_range(bars: DataFrame, n: int = 14) -> DataFrame:
    """True range (greatest of high-low and the gaps to the last close) and its average."""
    pc = lag(F.col("close"), 1)
    df = bars.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))
    return df.select(*KEYS, "true_range", rolling(F.avg, F.col("true_range"), n).alias(f"atr_{n}"))


def stop_level(bars: DataFrame, n: int = 14, look: int = 22, trend: int = 50, support: int = 20) -> DataFrame:
    """Stop below the close: the highest of chandelier, trend and support stops, 1.5 to 4 ATR away; after `trend` bars."""
    atr = true_range(bars, n).select(*KEYS, F.col(f"atr_{n}").alias("atr"))
    df = bars.join(atr, KEYS).select(
        *KEYS, "close", "atr", (rolling(F.max, F.col("high"), look) - 3 * F.col("atr")).alias("chandelier"), (rolling(F.avg, F.col("close"), trend) - F.col("atr")).alias("trend"),
        (rolling(F.min, F.col("low"), support) - F.lit(0.5) * F.col("atr")).alias("support"),
    )
    raw = F.greatest("chandelier", "trend", "support")
    level = F.least(F.greatest(raw, F.col("close") - 4 * F.col("atr")), F.col("close") - F.lit(1.5) * F.col("atr"))
    return df.select(*KEYS, F.when(F.col("trend").isNotNull(), level).alias("stop_level"))


def calendar_returns(bars: DataFrame, as_of, days=(7, 14, 30, 60, 90)) -> DataFrame:
    """Per symbol, return to the last close from the last one at least d days older than it."""
    seen = bars.where(F.col("close").isNotNull() & (F.col("date") <= as_of))
    last = seen.groupBy("symbol").agg(F.max("date").alias("last_date"))
    dated = seen.join(last, "symbol")
    then = [F.max_by("close", F.when(F.col("date") <= F.date_sub("last_date", d), F.col("date"))).alias(f"c{d}") for d in days]
    out = dated.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"), *then)
    return out.select("symbol", "date", *[(ratio(F.col("close"), F.col(f"c{d}")) - 1).alias(f"return_{d}c") for d in days])


def year_to_date(bars: DataFrame) -> DataFrame:
    """Return since the last close before 1 January, by row."""
    year = F.year("date")
    ends = bars.where(F.col("close").isNotNull()).groupBy("symbol", (year + 1).alias("y")).agg(F.max_by("close", "date").alias("base"))
    return bars.withColumn("y", year).join(ends, ["symbol", "y"], "left").select(*KEYS, (ratio(F.col("close"), F.col("base")) - 1).alias("return_ytd"))


def latest_beta(bars: DataFrame, bench: DataFrame, n: int = 60, least: int = 40) -> DataFrame:
    """Beta over the last n pairs of each symbol, if there are `least`."""
    r = bench.select("date", "bench_close").withColumn("b1", F.col("bench_close") / F.lag("bench_close").over(Window.orderBy("date")) - 1)
    pairs = _daily(bars).join(r, "date").where("r1 is not null and b1 is not null")
    last = pairs.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("k") <= n)
    out = last.groupBy("symbol").agg(F.count(F.lit(1)).alias("pairs"), F.covar_samp("r1", "b1").alias("c"), F.var_samp("b1").alias("v"))
    return out.select("symbol", "pairs", F.when(F.col("pairs") >= least, ratio(F.col("c"), F.col("v"))).alias("beta"))


def latest_metrics(bars: DataFrame, history: int = 36) -> DataFrame:
    """Of each symbol's last bar: change, volume ratio, place against averages, and the last closes in order."""
    df = bars.select(*KEYS, "close", ret(1).alias("change"), ratio(F.col("volume"), rolling(F.avg, F.col("volume"), 20)).alias("volume_ratio"),
                     (F.col("close") > rolling(F.avg, F.col("close"), 20)).alias("above_20"), (F.col("close") > rolling(F.avg, F.col("close"), 50)).alias("above_50")).where("close is not null")
    df = df.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("k") <= history)
    closes = F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda x: x["close"])
    now = lambda c: F.max(F.when(F.col("k") == 1, F.col(c))).alias(c)
    return df.groupBy("symbol").agg(*[now(c) for c in ("date", "close", "change", "volume_ratio", "above_20", "above_50")], closes.alias("closes"))


def prior_high(bars: DataFrame, spans=(5, 10, 20)) -> DataFrame:
    return bars.select(*KEYS, *[F.max("close").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(1 - k, 0)).alias(f"prior_high_{k}") for k in spans])


def macro_features(series: DataFrame, ids: list[str]) -> DataFrame:
    """Long (series_id, date, value) to one row a date: level, change by 1 and 5 observations, filled forward."""
    w = Window.partitionBy("series_id").orderBy("date")
    v = F.col("value")
    long = series.where(v.isNotNull()).select("series_id", "date", v.alias("level"), (v - F.lag(v, 1).over(w)).alias("chg_1"), (v - F.lag(v, 5).over(w)).alias("chg_5"))
    wide = long.groupBy("date").pivot("series_id", ids).agg(F.first("level").alias("level"), F.first("chg_1").alias("chg_1"), F.first("chg_5").alias("chg_5"))
    fill = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return wide.select("date", *[F.last(c, True).over(fill).alias(c) for c in wide.columns if c != "date"])


def all_features(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """The short-window features in one row a bar; one shuffle by symbol serves them all."""
    parts = [returns(bars, (1, 5, 10, 20)), volatility(bars, (20,)), max_return(bars), moving_averages(bars, (20, 50)), rsi(bars), volume_features(bars, (20,)), beta(bars, bench)]
    return reduce(lambda a, b: a.join(b, KEYS), parts)
