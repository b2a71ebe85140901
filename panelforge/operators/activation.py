"""Activation backtest: buying only once a price has confirmed, over a grid of triggers and waiting windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Multiples of volatility, waiting windows, and the comparison rules with their windows.
MULTIPLES, WINDOWS = (0.25, 0.50, 0.75, 1.00, 1.25, 1.50, 2.00), (3, 5, 10)
COMPARISONS = (("prior_close_high_5", 5), ("prior_close_high_10", 5), ("sma20", 10))


def with_path(frame: DataFrame, ahead: int) -> DataFrame:
    """Adds `path`, the next `ahead` traded sessions as an array of (c, e, on), and the highest close of the last 5 and 10.

    `frame`: symbol, date, close, sector_close, sector_date, a row a traded session. One window by symbol; every rule
    then reads its entry and exit from the array, so no session meets a rule in a join.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    step = F.struct(F.col("close").alias("c"), F.col("sector_close").alias("e"), F.col("sector_date").alias("on"))
    return frame.withColumns({"path": F.collect_list(step).over(w.rowsBetween(1, ahead)), "high_5": F.max("close").over(w.rowsBetween(-4, 0)), "high_10": F.max("close").over(w.rowsBetween(-9, 0))})


def _neutral(entry: Column, entry_sector: Column, entry_on: Column, exit_: Column, cost: float) -> Column:
    """Return from entry to exit less the sector's where it has a later quote, and costs; null without an exit."""
    sector = F.when(exit_["on"] > entry_on, exit_["e"] / entry_sector - 1)
    return exit_["c"] / entry - 1 - F.coalesce(sector, F.lit(0.0)) - cost


def activation_report(frame: DataFrame, candidates: DataFrame, hold: int = 14, cost: float = 0.0015, multiples=MULTIPLES, windows=WINDOWS) -> DataFrame:
    """By setup, rule and window: n, mean, median, hit, p25, p75, coverage and the average distance of the trigger.

    `candidates`: setup, symbol, date, vol20, vs_sma20. A rule buys at the first close at or above its trigger within its
    window and sells `hold` sessions later: a multiple of the volatility above the signal's close, the highest close of
    the last 5 or 10 sessions, or the 20-session average; `buy_immediately` buys at the signal's close. Coverage is the
    share of all candidates with an outcome. Unknown or non-positive volatilities and averages give no trigger.
    """
    df = candidates.join(with_path(frame, max(max(windows), 10) + hold), ["symbol", "date"])
    close, vol = F.col("close"), F.col("vol20")
    average = F.when(F.col("vs_sma20") > -1, close / (1 + F.col("vs_sma20")))
    rule = lambda name, window, multiple, trigger: F.struct(F.lit(name).alias("rule"), F.lit(window).alias("window"), F.lit(multiple).cast("double").alias("multiple"), trigger.cast("double").alias("trigger"))
    rules = [rule("buy_immediately", 0, None, close)]
    rules += [rule(f"vol_{m:g}", n, m, F.when(vol > 0, close * (1 + m * vol))) for n in windows for m in multiples]
    rules += [rule(name, n, None, average if name == "sma20" else F.col(f"high_{name.rsplit('_', 1)[-1]}")) for name, n in COMPARISONS]
    size = candidates.groupBy("setup").agg(F.count(F.lit(1)).alias("candidates"))
    long = df.select("setup", "close", "path", F.col("sector_close").alias("e0"), F.col("sector_date").alias("on0"), F.inline(F.array(*rules)))
    place = F.array_position(F.transform(F.slice("path", 1, F.col("window")), lambda x: x["c"] >= F.col("trigger")), F.lit(True)).cast("int")
    long = long.withColumn("place", F.when(F.col("window") > 0, place))
    entry = F.when(F.col("place") > 0, F.try_element_at("path", F.col("place")))
    waited = _neutral(entry["c"], entry["e"], entry["on"], F.try_element_at("path", F.when(F.col("place") > 0, F.col("place") + hold)), cost)
    at_once = _neutral(F.col("close"), F.col("e0"), F.col("on0"), F.try_element_at("path", F.lit(hold)), cost)
    long = long.select("setup", "rule", "window", "multiple", (F.col("trigger") / close - 1).alias("distance"), F.when(F.col("window") == 0, at_once).otherwise(waited).alias("outcome"))
    q = F.percentile("outcome", F.array(F.lit(0.25), F.lit(0.75)))
    out = long.groupBy("setup", "rule", "window", "multiple").agg(F.count("outcome").alias("n"), F.avg("outcome").alias("mean"), F.median("outcome").alias("median"), F.avg((F.col("outcome") > 0).cast("int")).alias("hit"), q.alias("q"), F.avg("distance").alias("average_trigger"))
    covered = F.when(F.col("window") == 0, F.lit(1.0)).otherwise(F.col("n") / F.col("candidates"))
    return out.join(F.broadcast(size), "setup").select("setup", "rule", "window", "multiple", "n", "mean", "median", "hit", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p75"), covered.alias("coverage"), "average_trigger")
