"""Queries that run the streaming jobs over the events table, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelforge.sources import shared
from panelforge.streaming import jobs

QUERIES, SQL = {}, {}


def shared_folder(spark) -> str:
    """A folder of its own for a run, where driver and executors share one."""
    return f"{shared.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _x1(spark, sf):
    at = shared_folder(spark)
    s = _events(spark, sf).select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("date"), F.col("event_id").alias("seq"), F.col("value").alias("close"), F.lit(1.0).alias("volume"))
    jobs.latest_bars(s, f"{at}/bars", f"{at}/checkpoint").awaitTermination()
    schema = "symbol long, seq long, close double, volume double, date date, batch long"
    return jobs.current_bars(spark, f"{at}/bars", schema).select("symbol", F.col("date").cast("string").alias("date"), "seq", "close")


QUERIES["x1_latest_bars"] = _x1
SQL["x1_latest_bars"] = "SELECT user_id AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, max(event_id) AS seq, arg_max(value, event_id) AS close FROM events GROUP BY 1, 2"


def _x3(spark, sf):
    at = shared_folder(spark)
    s = _events(spark, sf).select(F.col("event_id").alias("post_id"), F.col("event_type").alias("symbol"), F.col("ts").alias("created"), (F.col("user_id") % 7).alias("comments"))
    jobs.post_attention(s, f"{at}/attention", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("at timestamp, symbol string, mentions long, comments long").parquet(f"{at}/attention").select(F.col("at").cast("string").alias("at"), "symbol", "mentions", "comments")


QUERIES["x3_post_attention"] = _x3
SQL["x3_post_attention"] = """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS at, event_type AS symbol, count(*) AS mentions, CAST(sum(user_id % 7) AS BIGINT) AS comments
 FROM (SELECT *, unnest([0, 1, 2, 3]) AS k, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') AS b FROM events) CROSS JOIN LATERAL (SELECT b + to_hours(CAST((k + 1) * 6 AS INTEGER)) AS w) WHERE w <= (SELECT max(ts) - INTERVAL 1 hour FROM events) GROUP BY 1, 2"""


def _x2(spark, sf):
    at = shared_folder(spark)
    s = _events(spark, sf).select(F.col("event_type").alias("symbol"), "ts")
    jobs.session_readiness(s, 5, ["click"], f"{at}/ready", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("session timestamp, symbols long, in_context long, ready boolean").parquet(f"{at}/ready").select(F.col("session").cast("string").alias("session"), "symbols", "in_context", "ready")


QUERIES["x2_session_readiness"] = _x2
SQL["x2_session_readiness"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS session, count(DISTINCT event_type) AS symbols, count(DISTINCT CASE WHEN event_type = 'click' THEN 1 END) AS in_context, count(DISTINCT event_type) >= 4.5 AND bool_or(event_type = 'click') AS ready FROM events WHERE date_trunc('day', ts) + INTERVAL 1 day <= (SELECT max(ts) - INTERVAL 2 days FROM events) GROUP BY date_trunc('day', ts)"


def _x4(spark, sf):
    """Snapshots of two models by turns of days; the last batch's changes."""
    at = shared_folder(spark)
    day = F.to_date("ts")
    s = _events(spark, sf).select(day.alias("as_of"), F.when(F.dayofmonth(day) % 2 == 0, "m2").otherwise("m1").alias("model"), F.concat(F.col("event_type"), F.lit("_"), F.col("user_id").cast("string")).alias("symbol"), (F.col("event_id") % 1000).alias("rank"))
    jobs.snapshot_changes(s, f"{at}/recent", f"{at}/changes", f"{at}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{at}/changes")
    return out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


SQL["x4_snapshot_changes"] = """WITH s AS (SELECT CAST(ts AS DATE) AS d, CASE WHEN day(ts) % 2 = 0 THEN 'm2' ELSE 'm1' END AS model, event_type || '_' || user_id AS symbol, event_id % 1000 AS rank FROM events),
 o AS (SELECT * FROM s WHERE model = (SELECT max_by(model, d) FROM s)), k AS (SELECT d, row_number() OVER (ORDER BY d DESC) - 1 AS k FROM (SELECT DISTINCT d FROM o)),
 g AS (SELECT symbol, max(rank) FILTER (k = 0) AS rank, max(rank) FILTER (k = 1) AS p, max(rank) FILTER (k = 5) AS e FROM o JOIN k USING (d) GROUP BY symbol)
 SELECT symbol, rank, p - rank AS change_1, e - rank AS change_n, CASE WHEN p IS NULL THEN 'new' WHEN p > rank THEN 'up' WHEN p < rank THEN 'down' ELSE 'same' END AS status FROM g WHERE rank IS NOT NULL ORDER BY abs(p - rank) DESC NULLS LAST, symbol LIMIT 20"""
QUERIES["x4_snapshot_changes"] = _x4
