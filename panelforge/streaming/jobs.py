"""Streaming jobs: revised bars, session readiness, post attention and snapshot rank changes.

Each job reads any streaming DataFrame and returns the query it started; state lives in Spark's checkpoint, so a
restart goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelforge.operators.scorebook import rank_changes


def current_bars(spark, table: str, schema) -> DataFrame:
    """The table that `latest_bars` keeps: of each date the rows of its last batch."""
    rows = spark.read.schema(schema).parquet(table)
    last = rows.groupBy("date").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), ["date", "batch"], "left_semi").drop("batch")


def latest_bars(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """X1: the latest revision of each (symbol, date) as Parquet at `table`: revisions replace, they never add up.

    Columns symbol, date, seq, close, volume. The table is partitioned by date and batch: a batch reads and writes
    only the dates it holds, and one that is run again overwrites its own partitions. `current_bars` reads it.
    """
    schema = f"symbol {stream.schema['symbol'].dataType.simpleString()}, seq {stream.schema['seq'].dataType.simpleString()}, close double, volume double, date date, batch long"

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        w = Window.partitionBy("symbol", "date").orderBy(F.desc("seq"), F.desc("close"), F.desc("volume"))
        rows = batch.select("symbol", "seq", "close", "volume", "date")
        if epoch > 0:
            days = [r[0] for r in batch.select("date").distinct().collect()]
            before = spark.read.schema(schema).parquet(table).where(F.col("date").isin(days) & (F.col("batch") < epoch))
            last = before.groupBy("date").agg(F.max("batch").alias("batch"))
            rows = rows.unionByName(before.join(F.broadcast(last), ["date", "batch"], "left_semi").select(*rows.columns))
        newest = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("batch", F.lit(epoch).cast("long"))
        newest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(table)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_readiness(stream: DataFrame, symbols: int, context: list[str], table: str, checkpoint: str, late: str = "2 days", least: float = 0.9) -> StreamingQuery:
    """X2: sessions for which all context series and enough symbols have arrived, once the watermark has passed them.

    Columns symbol, ts. A session is emitted once, complete or not, with its counts; late bars before the
    watermark are counted in. Counts are exact: a session's state holds its symbols.
    """
    day = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
    g = day.agg(F.size(F.collect_set("symbol")).cast("long").alias("symbols"), F.size(F.collect_set(F.when(F.col("symbol").isin(context), F.col("symbol")))).cast("long").alias("in_context"))
    out = g.select(F.col("w.start").alias("session"), "symbols", "in_context", ((F.col("symbols") >= least * symbols) & (F.col("in_context") == len(context))).alias("ready"))
    return out.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def post_attention(stream: DataFrame, table: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """X3: posts and comments by symbol over a sliding day, each post once, undated ones and those dated after now dropped.

    Columns post_id, symbol, created, comments. Duplicates are dropped inside the watermark.
    """
    once = stream.where("created is not null and created <= current_timestamp()").withWatermark("created", late).dropDuplicatesWithinWatermark(["post_id", "symbol"])
    g = once.groupBy(F.window("created", "24 hours", "6 hours").alias("w"), "symbol").agg(F.count(F.lit(1)).alias("mentions"), F.sum("comments").alias("comments"))
    out = g.select(F.col("w.end").alias("at"), "symbol", "mentions", "comments")
    return out.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_changes(stream: DataFrame, recent: str, table: str, checkpoint: str, back: int = 5) -> StreamingQuery:
    """X4: snapshots (as_of, model, symbol, rank) in, the rank changes of the latest against earlier ones of its model out.

    The state is a table of each model's last back + 1 snapshots, a version a batch: a batch reads the version before it,
    adds its rows and writes its own, so neither state nor a batch's work grows with history, and a batch that is run
    again after a failure writes the same. Snapshots may come late or in parts, as long as they are among the last.
    """
    schema = "as_of date, model string, symbol string, rank long"

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.selectExpr("cast(as_of as date) as as_of", "model", "symbol", "cast(rank as long) as rank")
        if epoch:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{recent}/batch={epoch - 1}"))
        days = rows.select("model", "as_of").distinct().withColumn("k", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("as_of")))).where(F.col("k") <= back + 1)
        rows.join(days.drop("k"), ["model", "as_of"], "left_semi").select("as_of", "model", "symbol", "rank").write.mode("overwrite").parquet(f"{recent}/batch={epoch}")
        rank_changes(spark.read.schema(schema).parquet(f"{recent}/batch={epoch}"), back).write.mode("overwrite").parquet(f"{table}/batch={epoch}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
