"""Shared pieces of the training-data operators: word rules, written tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are none of space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelforge-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


#: Whether Spark deletes the shuffle files of a query at its end, or when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Sizes up to which Spark broadcasts a side of a join, as guessed by the plan and as found on the way.
_GUESSED, _FOUND = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Queries that are planned and run inside leave no shuffle files behind, and broadcast only what asks for it.

    Sizes are guessed too low after an explode, and for files that compress well: a table that grows with the input would pass
    through the driver.
    """
    inside = {_CLEANUP: "true", _GUESSED: "-1", _FOUND: "-1"}
    before = {k: spark.conf.get(k, None) for k in inside}
    for k, v in inside.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_made: list[list[DataFrame]] = []


@contextmanager
def tables_made() -> Iterator[list[DataFrame]]:
    """The tables that `written` and `durable` keep inside."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        _made.pop()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table with a reliable checkpoint, which outlives lost executors."""
    shared_dir(df.sparkSession)
    with shuffles_cleared(df.sparkSession):
        out = df.select("*").checkpoint(eager=True)
    out._written_to = out._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    for tables in _made:
        tables.append(out)
    return out


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a larger table as Parquet into the shared folder and read it back, so that it is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with shuffles_cleared(spark):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    out._written_to = path
    for tables in _made:
        tables.append(out)
    return out


def forget(df: DataFrame) -> None:
    """Delete a table of `written` or `durable` that nothing will read any more; other DataFrames are left alone."""
    path = df.__dict__.pop("_written_to", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a table that may be sent whole to all executors.
FEW = 100_000


def to_join(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A side of a join: sent to all executors if it is known to have FEW rows at most, else dealt out by key.

    Spark's own choice goes by sizes that are guessed too low after an explode, and for files that compress well.
    """
    return F.broadcast(df) if rows is not None and rows <= FEW else df.hint("merge")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _CAPITALS, _SMALL)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about `size` bytes of a text or binary column, a row at least; empty batches go."""
    for b in batches:
        ends = np.cumsum(np.nan_to_num(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype("float64")))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
            yield b.slice(at, min(end, b.num_rows) - at)
            at = end


#: Rows of an edge set in a part of its checkpoint.
EDGES = 50_000


def _mark(edges: DataFrame):
    """Tells edge sets apart: their size and a sum and a XOR of hashes."""
    h = F.xxhash64("u", "v")
    return edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20)")), F.bit_xor(h)).first()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of `edges(a, b)`, as (id, component); ids are of any type that has an order.

    Alternating large-star and small-star rounds over edge rows: a round is two groupings with map-side
    combine and two joins, so no component is ever gathered into one task. Rounds grow with the logarithm
    of the longest chain. Each round is checkpointed, in parts of EDGES rows, so that a small edge set is not read by
    hundreds of tasks; the loop ends when the edge set is a set of stars.
    Null ends and loops are ignored; an empty table gives an empty result.
    """
    now = written(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # dealt out by u once, for the distinct rows, their least and the join
        large = large.repartition("u").distinct()
        # every larger neighbour now points at the least one; then the smaller neighbours are joined up
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        last, now = now, durable(small.coalesce(mark[0] // EDGES + 1))
        forget(last)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
    out._written_to = now._written_to
    return out


def joined_up(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) after more `edges(a, b)` between the nodes of `groups(id, component)` and others; `groups` goes if it is not returned."""
    if edges.isEmpty():
        return groups
    for end in ("a", "b"):
        top = groups.select(F.col("id").alias(end), "component")
        edges = edges.join(top, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    found = connected_components(edges)
    moved = written(found)
    forget(found)
    old = groups.join(moved.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    out = written(old.unionByName(moved.join(groups.select("id"), "id", "left_anti")))
    forget(moved)
    forget(groups)
    return out
