"""Cross-sectional features of a day and forward labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.semantics import lead, pct_rank, ratio, rolling, share_true
from panelforge.operators.features import ret


def base_features(panel: DataFrame) -> DataFrame:
    """The columns that ranks, labels and setups read; one shuffle by symbol."""
    df = panel.withColumn("r1", ret(1))
    return df.select(
        "symbol", "sector", "date", "session_ix", "close", "volume", "r1", *[ret(k).alias(f"r{k}") for k in (5, 20, 60)],
        rolling(F.stddev_samp, F.col("r1"), 20).alias("vol20"), (F.col("close") / rolling(F.avg, F.col("close"), 20) - 1).alias("vs_sma20"),
        (F.col("close") / rolling(F.avg, F.col("close"), 50) - 1).alias("vs_sma50"), (F.col("volume") / rolling(F.avg, F.col("volume"), 20)).alias("volume_ratio"),
    )


def rank_columns(df: DataFrame, columns: list[str], by: list[str], suffix: str) -> DataFrame:
    """Adds percentile ranks of columns within `by`; rows with a null key get none."""
    keyed = None
    for k in by:
        keyed = F.col(k).isNotNull() if keyed is None else keyed & F.col(k).isNotNull()
    return df.select("*", *[F.when(keyed, pct_rank(F.col(c), *by)).alias(f"{c}_{suffix}") for c in columns])


def minus_sector_median(df: DataFrame, columns: list[str]) -> DataFrame:
    w = Window.partitionBy("date", "sector")
    return df.select("*", *[F.when(F.col("sector").isNotNull(), F.col(c) - F.median(c).over(w)).alias(f"{c}_minus_sector_median") for c in columns])


def mean_of_known(columns: list[str]) -> Column:
    """Mean across columns, nulls skipped; null if all are."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def sector_context(etf: DataFrame) -> DataFrame:
    """(sector, date, sector_r20, sector_vol20) of each sector's own series."""
    w = Window.partitionBy("sector").orderBy("date")
    r1 = F.col("etf_close") / F.lag("etf_close").over(w) - 1
    df = etf.withColumn("r1", r1)
    last = w.rowsBetween(-19, 0)
    vol = F.when(F.count("r1").over(last) == 20, F.stddev_samp("r1").over(last))
    return df.select("sector", "date", (F.col("etf_close") / F.lag("etf_close", 20).over(w) - 1).alias("sector_r20"), vol.alias("sector_vol20"),
                     (F.lead("etf_close", 15).over(w) / F.lead("etf_close", 1).over(w) - 1).alias("sector_forward"))


def breadth(df: DataFrame) -> DataFrame:
    """By date: share of names above their averages, and medians of returns and volatility."""
    return df.groupBy("date").agg(
        share_true(F.col("vs_sma20") > 0).alias("above_20"), share_true(F.col("vs_sma50") > 0).alias("above_50"),
        F.median("r20").alias("r20_median"), F.median("r60").alias("r60_median"), F.median("vol20").alias("vol20_median"),
    )


def forward_same_close(df: DataFrame, h: int = 14) -> DataFrame:
    return df.select("symbol", "date", (ratio(lead(F.col("close"), h), F.col("close")) - 1).alias("forward_return"))


def forward_next_close(df: DataFrame, h: int = 14) -> DataFrame:
    """Entry at the next close, exit h sessions later."""
    return df.select("symbol", "date", (ratio(lead(F.col("close"), h + 1), lead(F.col("close"), 1)) - 1).alias("forward_return"))


def worst_path(df: DataFrame, h: int = 14) -> DataFrame:
    """Worst return from entry along the path, unknown closes skipped."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1, h + 1)
    return df.select("symbol", "date", (ratio(F.min("close").over(w), lead(F.col("close"), 1)) - 1).alias("worst_path"))


def path_drawdown(df: DataFrame, h: int = 14) -> DataFrame:
    """Deepest fall from a running peak inside the forward path; null unless the whole path is known."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1, h + 1)
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc, x):
        peak = F.greatest(acc["peak"], x)
        return F.struct(peak.alias("peak"), F.least(acc["worst"], x / peak - 1).alias("worst"))

    path = df.select("symbol", "date", F.collect_list("close").over(w).alias("path"))
    return path.select("symbol", "date", F.when(F.size("path") == h + 1, F.aggregate("path", start, step, lambda a: a["worst"])).alias("max_drawdown"))


def excess_returns(df: DataFrame, bench: DataFrame, context: DataFrame, h: int = 14, cost: float = 0.0015) -> DataFrame:
    """Forward return beyond the benchmark, beyond the sector, and after cost."""
    w = Window.orderBy("date")
    b = bench.select("date", (F.lead("bench_close", h + 1).over(w) / F.lead("bench_close", 1).over(w) - 1).alias("bench_forward"))
    own = df.select("symbol", "sector", "date", (lead(F.col("close"), h + 1) / lead(F.col("close"), 1) - 1).alias("forward_return"))
    both = own.join(b, "date", "left").join(context.select("sector", "date", "sector_forward"), ["sector", "date"], "left")
    neutral = F.col("forward_return") - F.col("sector_forward")
    return both.select("symbol", "sector", "date", "forward_return", (F.col("forward_return") - F.col("bench_forward")).alias("excess_return"), neutral.alias("sector_neutral"), (neutral - cost).alias("after_cost"))


def drawdown_adjusted(df: DataFrame, weight: float = 0.25, clip: float = 0.5) -> DataFrame:
    """after_cost plus a weighted, clipped drawdown relative to the sector's, from columns after_cost, max_drawdown, sector_drawdown."""
    rel = F.col("max_drawdown") - F.col("sector_drawdown")
    return df.select("*", rel.alias("relative_drawdown"), (F.col("after_cost") + weight * F.least(F.greatest(rel, F.lit(-clip)), F.lit(clip))).alias("adjusted_return"))


def grade(rank: Column) -> Column:
    """Relevance 4 to 0 from a percentile rank, tested from the top and then from the bottom."""
    return F.when(rank >= 0.9, 4).when(rank >= 0.8, 3).when(rank <= 0.1, 0).when(rank <= 0.2, 1).otherwise(2)


def graded(df: DataFrame, column: str, by: str = "date") -> DataFrame:
    """Rows with a known outcome, its percentile rank on the date and its grade."""
    known = df.where(F.col(column).isNotNull()).withColumn("outcome_rank", pct_rank(F.col(column), by))
    return known.withColumn("grade", grade(F.col("outcome_rank")))


def grades_known_at(df: DataFrame, column: str, cutoff) -> DataFrame:
    """Grades from those outcomes only that were known before the cut-off."""
    return graded(df.where(F.col("available") < cutoff), column)


def binary_labels(df: DataFrame, column: str, hurdle: float = 0.01) -> DataFrame:
    x = F.col(column)
    return df.select("*", (x > 0).cast("int").alias("positive"), (x > hurdle).cast("int").alias("above_hurdle"))


def outperform_label(df: DataFrame, own: str, series: str) -> DataFrame:
    """Adds `excess` and whether it is above zero; both are null where either return is unknown."""
    return df.withColumn("excess", F.col(own) - F.col(series)).withColumn("outperform", (F.col("excess") > 0).cast("int"))


def meta_label(candidate: Column, outcome: Column, drawdown: Column, hurdle: float = 0.0, floor: float = -0.3) -> Column:
    """1 if a candidate beat the hurdle without falling below the floor; null where there is no candidate."""
    return F.when(candidate, F.coalesce((outcome > hurdle) & (drawdown > floor), F.lit(False)).cast("int"))


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)
