"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import durable, written

#: A digest is frequent if it holds at least one row in so many, or in SHARES times the shuffle partitions where that is
#: more; so many winners are broadcast at most.
HEAVY, SHARES = 1024, 4


def _summaries(batches: Iterator[pd.DataFrame], counters: int) -> Iterator[pd.DataFrame]:
    """One Misra-Gries summary of a partition; batches are merged into it, so it holds `counters` entries at most."""
    held = pd.Series(dtype="int64")
    for batch in batches:
        held = held.add(batch["digest"].value_counts(), fill_value=0).astype("int64")
        if len(held) > counters:
            least = held.nlargest(counters + 1).iloc[-1]
            held = held[held > least] - least
    yield pd.DataFrame({"digest": held.index, "estimate": held.to_numpy()})


def exact_dedup(docs: DataFrame, heavy: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their SHA-256 digests are; null counts as the empty text. Of equal texts the row
    with the largest id stays (a null id is the smallest; among repeated rows of one id exactly one stays).
    An empty table gives an empty result; other columns are ignored, whatever their names.

    Each partition sums its digests up in 2*heavy Misra-Gries counters. A digest with n/heavy rows or more
    surely has over n/(2*heavy) in the summed counters, which fewer than 2*heavy digests can have, so the
    candidates are few at any size. They are verified by an exact count, and the winners (at most `heavy`
    rows) are broadcast: the rows of frequent digests never enter a shuffle. All others are grouped and
    joined on the digest; a digest there has less than n/heavy rows, a quarter of a partition's share at most.
    """
    heavy = heavy or max(HEAVY, SHARES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    n = rows.count()
    estimates = rows.select("digest").mapInPandas(lambda b: _summaries(b, 2 * heavy), "digest binary, estimate long")
    candidates = estimates.groupBy("digest").agg(F.sum("estimate").alias("e")).where(F.col("e") > n / (2 * heavy)).select("digest")
    winner = (F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    frequent = durable(
        rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*winner).where(F.col("group_size") >= n / heavy)
    )
    seen = rows.join(F.broadcast(frequent), "digest")
    rest = rows.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
    resolved = rest.join(rest.groupBy("digest").agg(*winner), "digest")
    return seen.unionByName(resolved).select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("top.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of `documents` with the row that stays of its equals."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
