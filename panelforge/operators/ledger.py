"""Refresh ledger: expected targets, idempotent upsert, delays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expected_targets(days: DataFrame, hours=(9, 18), zone: str = "America/New_York") -> DataFrame:
    """(key, due_at): a morning and an evening target a day, at wall-clock hours of a zone whatever its offset."""
    at = F.explode(F.array(*[F.lit(h) for h in hours]))
    df = days.select("date", at.alias("hour"))
    wall = F.to_timestamp(F.concat_ws(" ", F.col("date").cast("string"), F.format_string("%02d:00:00", "hour")))
    return df.select(F.concat_ws("-", F.date_format("date", "yyyyMMdd"), F.col("hour").cast("string")).alias("key"), F.to_utc_timestamp(wall, zone).alias("due_at"))


def missing_targets(expected: DataFrame, ledger: DataFrame) -> DataFrame:
    return expected.join(ledger.select("key"), "key", "left_anti")


def upsert(ledger: DataFrame, rows: DataFrame, keep: int = 120) -> DataFrame:
    """Newest row of each key, newest keys first, `keep` of them; the same rows again change nothing."""
    both = ledger.unionByName(rows)
    w = Window.partitionBy("key").orderBy(F.desc("finished_at"), F.desc("status"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(F.desc("finished_at"), "key").limit(keep)


def delay_minutes(due, started):
    return (F.unix_timestamp(started) - F.unix_timestamp(due)) / 60
