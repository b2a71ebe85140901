"""Tables of the panel: weekly bars by nation, sector and benchmark series, sessions, and dated side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BENCHMARK = "BENCH"


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, pruned to `columns`; a missing one is an error that names it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    missing = [c for c in columns or [] if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks columns {missing}")
    return df.select(*columns) if columns else df


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their supplier's nation (symbol) and region (sector), dated by the Monday of their week."""
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"])
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    places = table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"]).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return li.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"),
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate",
    )


def _bar(grouped) -> DataFrame:
    money = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    amount = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return grouped.agg(
        F.min_by(unit, F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")).alias("open"), F.max(unit).alias("high"),
        F.min(unit).alias("low"), (money / amount).alias("close"), amount.alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sector, date, open, high, low, close, volume); sums are exact decimals."""
    return _bar(trades(spark, sf_dir).groupBy("symbol", "sector", "date"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, bench_close, bench_volume) over all rows."""
    return _bar(trades(spark, sf_dir).groupBy("date")).select("date", F.col("close").alias("bench_close"), F.col("volume").alias("bench_volume"))


def sector_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sector, date, etf_close) per region."""
    return _bar(trades(spark, sf_dir).groupBy("sector", "date")).select("sector", "date", F.col("close").alias("etf_close"))


def sessions(dates: DataFrame) -> DataFrame:
    """(date, session_ix): the distinct dates in order; a table of days, so one task holds it."""
    return dates.select("date").distinct().withColumn("session_ix", F.row_number().over(Window.orderBy("date")) - 1)


def on_spine(rows: DataFrame) -> DataFrame:
    """Rows of each symbol on every session between its first and last; missing sessions are null, never filled.

    The spine is made by exploding the session numbers of a symbol's span, so no sessions meet symbols that
    lack them; the calendar (one row a day) is broadcast.
    """
    days = sessions(rows)
    dated = rows.join(F.broadcast(days), "date")
    span = dated.groupBy("symbol", "sector").agg(F.min("session_ix").alias("a"), F.max("session_ix").alias("b"))
    spine = span.select("symbol", "sector", F.explode(F.sequence("a", "b")).alias("session_ix")).join(F.broadcast(days), "session_ix")
    return spine.join(rows.drop("sector"), ["symbol", "date"], "left").select("symbol", "sector", "date", "session_ix", *[c for c in rows.columns if c not in ("symbol", "sector", "date")])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_spine(bars(spark, sf_dir))
