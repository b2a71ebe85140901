"""The whole feature matrix: price features, benchmark and sector context, ranks, spreads, composite, baseline scores.

Ranks and medians go over the long form (symbol, date, sector, feature, value): one exchange by (date, feature) and
one sort for each kind of rank serve all columns, and one aggregation by (symbol, date) lays them side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.semantics import lag, pct_rank, ratio, rolling
from panelforge.operators.cross_section import mean_of_known

#: Columns that are ranked by date and by (date, sector).
RANKED = [
    "reversal_5d", "return_20d", "return_60d", "return_120d", "momentum_126_10", "momentum_252_20", "vol_adjusted_20d", "vol_adjusted_60d", "rsi_14",
    "volatility_20d", "volatility_60d", "downside_20d", "downside_60d", "max_return_20d", "price_vs_sma_50", "price_vs_sma_200", "from_high_252d", "from_low_252d",
    "volume_ratio_20d", "volume_ratio_60d", "log_dollar_volume_20d", "illiquidity_20d", "beta_60d", "return_20d_vs_bench", "return_60d_vs_bench", "return_120d_vs_bench",
    "rsi_vs_bench", "volatility_20d_vs_bench", "volatility_60d_vs_bench", "idiosyncratic_20d", "idiosyncratic_60d",
]
#: Columns that are held against their sector's median.
CENTRED = [
    "return_20d", "return_60d", "return_120d", "momentum_126_10", "momentum_252_20", "vol_adjusted_20d", "vol_adjusted_60d", "rsi_14", "volatility_20d", "volatility_60d",
    "downside_20d", "downside_60d", "max_return_20d", "volume_ratio_20d", "volume_ratio_60d", "from_high_252d", "from_low_252d", "beta_60d", "idiosyncratic_20d", "idiosyncratic_60d",
]
#: Ranks whose mean is the technical composite.
COMPOSITE = [
    "return_60d_sector_rank", "return_120d_sector_rank", "momentum_126_10_sector_rank", "vol_adjusted_60d_sector_rank", "price_vs_sma_200_sector_rank", "from_high_252d_sector_rank",
    "return_60d_vs_bench_rank", "idiosyncratic_60d_sector_rank",
]
#: Columns of a series that its context is compared with.
SERIES = ["return_20d", "return_60d", "return_120d", "momentum_126_10", "momentum_252_20", "volatility_20d", "volatility_60d", "price_vs_sma_50", "price_vs_sma_200", "rsi_14"]


def _series(by: str) -> dict[str, Column]:
    """Features of (by, date, close, r1, d1)."""
    x, r = F.col("close"), F.col("r1")
    roll = lambda f, c, n: rolling(f, c, n, by)
    ret = lambda k: ratio(x, lag(x, k, by)) - 1
    g, loss = (roll(F.avg, F.when(F.col("d1").isNotNull(), c), 14) for c in (F.greatest(F.col("d1"), F.lit(0.0)), -F.least(F.col("d1"), F.lit(0.0))))
    rsi = F.when(loss.isNull(), None).when((loss == 0) & (g > 0), 100.0).when(loss == 0, 50.0).otherwise(100 - 100 / (1 + g / loss))
    out = {f"return_{k}d": ret(k) for k in (20, 60, 120)}
    out |= {f"momentum_{n}_{s}": ratio(lag(x, s, by), lag(x, n, by)) - 1 for n, s in ((126, 10), (252, 20))}
    out |= {f"volatility_{n}d": roll(F.stddev_samp, r, n) for n in (20, 60)}
    out |= {f"price_vs_sma_{n}": ratio(x, roll(F.avg, x, n)) - 1 for n in (50, 200)}
    return out | {"rsi_14": rsi}


def _moves(df: DataFrame, by: str) -> DataFrame:
    x = F.col("close")
    return df.withColumns({"r1": ratio(x, lag(x, 1, by)) - 1, "d1": x - lag(x, 1, by)})


def series_matrix(df: DataFrame, by: str, prefix: str) -> DataFrame:
    """(by, date, prefixed features) of series (by, date, close)."""
    return _moves(df.select(by, "date", "close"), by).select(by, "date", *[c.alias(prefix + n) for n, c in _series(by).items()])


def price_matrix(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """All ranked price features of a panel, those against the benchmark among them; one shuffle by symbol.

    The benchmark (date, bench_close) has a row a day and is broadcast.
    """
    b = bench.select(F.lit("bench").alias("series"), "date", F.col("bench_close").alias("close"))
    context = series_matrix(b, "series", "bench_").join(_moves(b, "series").select("date", F.col("r1").alias("b1")), "date").drop("series")
    x, r, v = F.col("close"), F.col("r1"), F.col("volume")
    df = _moves(panel, "symbol").join(F.broadcast(context), "date", "left").withColumns({"dollars": x * v, "down": F.when(r.isNotNull(), F.least(r, F.lit(0.0)))})
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-59, 0)
    pairs = F.count(F.when(r.isNotNull() & F.col("b1").isNotNull(), 1)).over(w)
    cov = F.when(pairs == 60, F.covar_samp("r1", "b1").over(w))
    out = _series("symbol") | {
        "reversal_5d": -(ratio(x, lag(x, 5)) - 1), "downside_20d": rolling(F.stddev_samp, F.col("down"), 20), "downside_60d": rolling(F.stddev_samp, F.col("down"), 60),
        "max_return_20d": rolling(F.max, r, 20), "from_high_252d": ratio(x, rolling(F.max, x, 252)) - 1, "from_low_252d": ratio(x, rolling(F.min, x, 252)) - 1,
        "volume_ratio_20d": ratio(v, rolling(F.avg, v, 20)), "volume_ratio_60d": ratio(v, rolling(F.avg, v, 60)), "log_dollar_volume_20d": F.log1p(x * rolling(F.avg, v, 20)),
        "illiquidity_20d": rolling(F.avg, ratio(F.abs(r), F.col("dollars")), 20), "beta_60d": ratio(cov, rolling(F.var_samp, F.col("b1"), 60)),
    }
    df = df.select("symbol", "sector", "date", "session_ix", "close", *[c.alias(n) for n, c in out.items()], *[f"bench_{n}" for n in SERIES])
    col = F.col
    return df.withColumns(
        {f"vol_adjusted_{k}d": ratio(col(f"return_{k}d"), col(f"volatility_{k}d")) for k in (20, 60)}
        | {f"return_{k}d_vs_bench": col(f"return_{k}d") - col(f"bench_return_{k}d") for k in (20, 60, 120)}
        | {"rsi_vs_bench": col("rsi_14") - col("bench_rsi_14")}
        | {f"volatility_{k}d_vs_bench": col(f"volatility_{k}d") - col(f"bench_volatility_{k}d") for k in (20, 60)}
        | {f"idiosyncratic_{k}d": col(f"return_{k}d") - col("beta_60d") * col(f"bench_return_{k}d") for k in (20, 60)}
    )


def ranks(matrix: DataFrame, ranked: list[str] = RANKED, centred: list[str] = CENTRED) -> DataFrame:
    """(symbol, date, *_rank, *_sector_rank, *_minus_sector_median): average percentile ranks by date and by (date, sector), nulls out of the count."""
    names = list(dict.fromkeys([*ranked, *centred]))
    long = matrix.select("symbol", "date", "sector", *names).unpivot(["symbol", "date", "sector"], names, "feature", "value")

    def rank(*keys):
        w = Window.partitionBy(*keys)
        order = w.orderBy(F.col("value").asc_nulls_last())
        ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
        return F.when(F.col("value").isNotNull(), (F.rank().over(order) + (ties - 1) / F.lit(2.0)) / F.count("value").over(w))

    by_sector = Window.partitionBy("date", "feature", "sector")
    known = F.col("sector").isNotNull()
    long = long.withColumns({"all": rank("date", "feature"), "own": F.when(known, rank("date", "feature", "sector")), "off": F.when(known, F.col("value") - F.median("value").over(by_sector))})
    cell = lambda n, c, name: F.max(F.when(F.col("feature") == n, F.col(c))).alias(name)
    cells = [cell(n, "all", f"{n}_rank") for n in ranked] + [cell(n, "own", f"{n}_sector_rank") for n in ranked] + [cell(n, "off", f"{n}_minus_sector_median") for n in centred]
    return long.groupBy("symbol", "date").agg(*cells)


def sector_spreads(matrix: DataFrame, sector_bars: DataFrame) -> DataFrame:
    """Adds ten `*_vs_sector` spreads against the sector's own series (sector, date, etf_close), and its 252-session momentum."""
    context = series_matrix(sector_bars.select("sector", "date", F.col("etf_close").alias("close")), "sector", "sector_")
    df = matrix.join(context, ["sector", "date"], "left")
    return df.withColumns({f"{n}_vs_sector": F.col(n) - F.col(f"sector_{n}") for n in SERIES}).drop(*[f"sector_{n}" for n in SERIES if n != "momentum_252_20"])


def full_matrix(panel: DataFrame, bench: DataFrame, sector_bars: DataFrame) -> DataFrame:
    """Price features, spreads, ranks and the technical composite of a panel, a row a symbol and session."""
    m = price_matrix(panel, bench)
    df = sector_spreads(m, sector_bars).join(ranks(m), ["symbol", "date"])
    return df.withColumn("composite", mean_of_known(COMPOSITE))


def baseline_scores(matrix: DataFrame) -> DataFrame:
    """Seven baseline scores of a full matrix and their percentile ranks by date."""
    c = F.col
    by = {"_relative": "momentum_252_20_vs_sector", "_centred": "momentum_252_20_minus_sector_median", "_sector": "sector_momentum_252_20", "_composite": "composite"}
    df = matrix.withColumns({n: pct_rank(c(x), "date") for n, x in by.items()})
    calm = 1 - c("volatility_60d_rank")
    scores = {
        "low_volatility": calm, "liquidity_quality": (c("log_dollar_volume_20d_rank") + (1 - c("illiquidity_20d_rank")) + calm + (1 - c("volatility_60d_vs_bench_rank"))) / 4,
        "twelve_one_momentum": c("momentum_252_20_rank"), "sector_relative_momentum": (c("momentum_252_20_sector_rank") + c("_relative") + c("_centred")) / 3,
        "risk_adjusted_momentum": (c("momentum_252_20_rank") + c("vol_adjusted_60d_rank") + calm) / 3, "technical_composite": c("_composite"), "sector_momentum": c("_sector"),
    }
    df = df.select("symbol", "date", *[x.alias(n) for n, x in scores.items()])
    return df.select("*", *[pct_rank(c(n), "date").alias(f"{n}_percentile") for n in scores])


def candidate(matrix: DataFrame) -> Column:
    """The eight conditions of a momentum setup over a full matrix; an unknown one fails."""
    # fixed values
    tests = ["composite >= 0.75", "return_60d_minus_sector_median > 0", "return_60d_sector_rank >= 0.70", "momentum_126_10_sector_rank >= 0.65", "price_vs_sma_50 > 0", "price_vs_sma_200 > 0", "rsi_14 <= 78", "volume_ratio_20d >= 0.70"]
    return F.coalesce(F.expr(" AND ".join(tests)), F.lit(False))
