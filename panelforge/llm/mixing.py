"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import durable, to_join, word_count, written

WEIGHTS = (5, 2, 1)
SHARE, MOST_COPIES, BLOCK = 1.5, 2.0, 4096


def ranked_sources(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Adds `weight` by the place of a source in code-point order, null last, without a single-task window.

    A range-partitioned sort gives each row a place inside its partition; the partitions' row counts (one
    row a partition) give the offsets.
    """
    laid = durable(
        sources.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), "source")
        .withColumn("mark", F.monotonically_increasing_id())
        .withColumns({"part": F.shiftright("mark", 33), "place": F.col("mark").bitwiseAND((1 << 33) - 1)})
    )
    offsets, at = [], 0
    for part, count in laid.groupBy("part").count().orderBy("part").collect():
        offsets.append((part, at))
        at += count
    offsets = laid.sparkSession.createDataFrame(offsets, "part long, offset long")
    ix = F.pmod(F.col("offset") + F.col("place"), F.lit(len(weights))).cast("int")
    return laid.join(F.broadcast(offsets), "part").withColumn("weight", F.element_at(F.lit(list(weights)), ix + 1).cast("double")).drop("mark", "part", "place", "offset")


def source_targets(sources: DataFrame, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Adds `target`: `share` of all sizes split by weight, none above `most` times its source's size, the excess reshared."""
    capacity = most * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = capacity <= F.col("weight") * level
        n, held, weight = sources.agg(F.count_if(above), F.sum(F.when(above, capacity)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not weight:
            break
        capped, level = n, max(level, (share * total - (held or 0)) / weight)
    return sources.withColumn("target", F.least(capacity, F.col("weight") * F.lit(level)) if weight else capacity)


def flight(size: list[float], chance: list[float], rng: random.Random) -> list[float]:
    """Cube flight for one block: chances move along the null-space of (documents, tokens) until at most two are fractional."""
    p, live, queue = list(chance), [], iter(range(len(chance)))
    while True:
        while len(live) < 3 and (i := next(queue, None)) is not None:
            if 0 < p[i] < 1:
                live.append(i)
        if len(live) < 3:
            return p
        a, b, c = (size[i] for i in live)
        u = (c - b, a - c, b - a)
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(live, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(live, u, strict=True) if d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(live, u, strict=True):
            q = p[i] + step * d
            p[i] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
        live = [i for i in live if 0 < p[i] < 1]


def landing(size: list[float], p: list[float], start: list[float]) -> list[float]:
    """The outcome of the last fractional documents (two at most) that leaves the token total nearest to its expectation."""
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    gap = sum(s * (a - b) for s, a, b in zip(size, start, p, strict=True)) + sum(size[i] * p[i] for i in open_)
    best = min(range(1 << len(open_)), key=lambda m: (abs(gap - sum(size[i] for k, i in enumerate(open_) if m >> k & 1)), m))
    out = list(p)
    for k, i in enumerate(open_):
        out[i] = float(best >> k & 1)
    return out


def _block(pdf: pd.DataFrame, level: int, last: bool, seed: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["h", "doc_id", "size", "rid"], na_position="first").reset_index(drop=True)
    rng = random.Random(f"{seed}:{level}:{pdf['block'].iloc[0]}:{pdf['h'].iloc[0]}")
    size, start = pdf["size"].astype(float).tolist(), pdf["chance"].tolist()
    p = flight(size, start, rng)
    pdf["chance"] = landing(size, p, start) if last else p
    return pdf


def _mover(level: int, last: bool, seed: int):
    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        return _block(pdf, level, last, seed)

    return move


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = 42, block: int = BLOCK,
        id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, copies, taken.

    Sizes are word counts unless `size` is given; null texts have size 0. A document's expected copies are
    its source's target over its size; the whole part is sure, the fraction is an inclusion chance. The cube
    method moves the chances of a block of `block` documents along the null-space of its balance constraints
    (documents, tokens), so both totals stay as expected, until two documents at most are fractional. Those
    left over go to blocks again, until a source fits one block and the landing chooses the outcome nearest
    to the expected tokens. Order and random numbers come from hashes of ids and texts: reruns agree, rows
    with null or equal ids go to blocks apart, and only rows equal in all of that share one. Null sources are
    one source; sources without a word have target 0; an empty table gives an empty result. `keep` names
    columns of docs to carry along; all others are ignored.
    """
    carried = {f"_keep{i}": F.col(c) for i, c in enumerate(keep or [])}
    sizes = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            (word_count(F.col("text")) if size is None else F.coalesce(size, F.lit(0)).cast("long")).alias("size"),
            (F.xxhash64(F.lit(5), F.col("text")) if "text" in docs.columns else F.lit(0).cast("long")).alias("th"),
            F.monotonically_increasing_id().alias("rid"), *[c.alias(n) for n, c in carried.items()],
        )
    )
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    sources = durable(source_targets(ranked_sources(sources, weights), share, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    s = sources.select(F.col("source").alias("s_source"), "source_size", "source_docs", "target", ratio.alias("ratio"))
    n_sources = sources.count()
    s = to_join(s, n_sources)
    chosen = sizes.drop(*carried).join(s, F.col("source").eqNullSafe(F.col("s_source"))).select(
        "rid", "doc_id", "source", "size", "source_docs", (F.col("ratio") - F.floor("ratio")).alias("chance"),
        F.xxhash64(F.lit(seed), "doc_id", "size", "th").alias("h"),
    )
    open_ = chosen.where("chance > 0 and chance < 1")
    picked, level = [], 0
    while True:
        most_docs = open_.groupBy("source").agg(F.max("source_docs").alias("n")).agg(F.max("n")).first()[0] or 0
        blocks = F.ceil(F.col("source_docs") / F.lit(block))
        key = F.pmod(F.xxhash64(F.lit(level), "h"), blocks)
        moved = (
            open_.withColumn("block", key)
            .groupBy("source", "block")
            .applyInPandas(_mover(level, most_docs <= block, seed), "rid long, doc_id long, source string, size long, source_docs long, chance double, h long, block long")
        )
        moved = written(moved.drop("block"))
        picked.append(moved.where("chance = 1").select("rid"))
        if most_docs <= block:
            break
        left = moved.where("chance > 0 and chance < 1").drop("source_docs")
        counts = left.groupBy(F.col("source").alias("c_source")).agg(F.count(F.lit(1)).alias("source_docs"))
        open_ = left.join(to_join(counts, n_sources), F.col("source").eqNullSafe(F.col("c_source"))).drop("c_source")
        level += 1
    extra = picked[0]
    for more in picked[1:]:
        extra = extra.union(more)
    out = sizes.join(s, F.col("source").eqNullSafe(F.col("s_source"))).join(to_join(extra.withColumn("one", F.lit(1))), "rid", "left")
    copies = (F.floor("ratio") + F.coalesce("one", F.lit(0))).cast("long")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"),
                      *[F.col(n).alias(c) for n, c in zip(carried, keep or [], strict=True)])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of all of `documents`."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents it takes no copy of go.

    Null sources are one source, null texts have size 0 (and stay only by their source's whole copies);
    repeated rows are documents each; an empty table gives an empty result; columns may have any names.
    """
    names = docs.columns
    mixed = mix(docs, keep=names)
    # positions, as carried names may clash with the operator's own
    carried = mixed.toDF(*["doc", "size_", "source_size_", "target_", "copies_", "taken_", *[f"c{i}" for i in range(len(names))]])
    return carried.withColumn("copy_", F.explode(F.array_repeat(F.lit(1), F.col("copies_").cast("int")))).select(
        *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)]
    )
