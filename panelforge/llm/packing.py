"""Packing documents into token-budget batches inside optimal length buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import durable, to_join, word_count, written

BUCKETS, BUDGET = 16, 32768


def bucket_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least padding over a histogram sorted by length.

    Dynamic programming over the number of buckets; as the cost of a bucket (its upper bound times its
    documents, less their tokens) satisfies the quadrangle inequality, the best split moves monotonically
    and each row takes n log n steps by divide and conquer.
    """
    x, c = np.asarray(lengths, dtype=np.float64), np.asarray(counts, dtype=np.float64)
    n = len(x)
    if not n:
        return []
    docs = np.concatenate([[0.0], np.cumsum(c)])
    best = x * docs[1:]  # one bucket; tokens are the same in every choice and are left out
    splits: list[np.ndarray] = []
    for _ in range(min(buckets, n) - 1):
        nxt, cut = best.copy(), np.full(n, -1)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            end = min(mid - 1, b)
            at = a
            if end >= a:
                cost = best[a : end + 1] + x[mid] * (docs[mid + 1] - docs[a + 1 : end + 2])
                k = int(np.argmin(cost))
                at = a + k
                if cost[k] < nxt[mid]:
                    nxt[mid], cut[mid] = cost[k], at
            todo += [(lo, mid - 1, a, at), (mid + 1, hi, at, b)]
        splits.append(cut)
        best = nxt
    bounds, at = [int(x[-1])], n - 1
    for cut in reversed(splits):
        if cut[at] >= 0:
            at = int(cut[at])
            bounds.append(int(x[at]))
    return sorted(bounds)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", length: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, length, bucket, bucket_length, batch, slot, padding.

    Lengths are word counts unless `length` is given (null: 0). Dynamic programming over the histogram of
    all lengths, exact at every length, chooses the bucket bounds. The histogram has a row for each distinct
    length, which are fewer than the root of twice the tokens (10^13 tokens: 4.5 million), and is all that
    reaches the driver. A batch of a bucket holds floor(budget / bound) documents, one at
    least, each padded to the bound; so a document longer than the budget has a batch of its own. Documents
    are numbered inside a bucket by a hash of their id, length and text: a small table of row counts by (bucket, slice)
    gives each slice its offset, so no bucket is ever ranked in one task and only a bucket's last batch is
    not full. Rows with null or equal ids go apart by their texts; repeated rows are packed each; empty texts have length 0 and bound 0 or more; an empty table
    gives an empty result.
    """
    rows = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (word_count(F.col("text")) if length is None else F.coalesce(length, F.lit(0)).cast("long")).alias("length"),
            (F.xxhash64(F.lit(5), F.col("text")) if "text" in docs.columns else F.lit(0).cast("long")).alias("th"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    histogram = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    bounds = bucket_bounds([r.length for r in histogram], [r.n for r in histogram], buckets)
    if not bounds:
        return rows.selectExpr("doc_id", "length", "0 as bucket", "length as bucket_length", "0L as batch", "0L as slot", "0L as padding")
    slices = max(1, -(-sum(r.n for r in histogram) // 4096))
    ladder = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        ladder = F.when(F.col("length") <= bounds[k], k).otherwise(ladder)
    placed = rows.withColumns({"bucket": ladder, "h": F.xxhash64(F.lit(42), "doc_id", "length", "th")}).withColumn("slice", F.pmod("h", F.lit(slices)))
    counts = durable(placed.groupBy("bucket", "slice").count())
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("bucket", "slice").orderBy("h", "doc_id", "length", "rid")
    bound = F.element_at(F.lit(bounds), F.col("bucket") + 1).cast("long")
    ranked = placed.withColumn("place", F.row_number().over(inside)).join(to_join(offsets, slices * len(bounds)), ["bucket", "slice"])
    ranked = ranked.select("doc_id", "length", "bucket", bound.alias("bucket_length"), (F.col("offset") + F.col("place") - 1).alias("ix"))
    fits = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))), F.lit(1))
    return ranked.select(
        "doc_id", "length", "bucket", "bucket_length", F.floor(F.col("ix") / fits).alias("batch"), (F.col("ix") % fits).alias("slot"),
        (F.col("bucket_length") - F.col("length")).alias("padding"),
    )


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """The batches of all of `documents`."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches of what the other stages kept; nulls, ties, repeated rows, empty tables and other columns are as in `pack`."""
    return pack(docs)
