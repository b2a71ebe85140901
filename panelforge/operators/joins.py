"""Joins in time and set operations of the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.identity import connected_names

def left_join_unique(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails if a key repeats on either side."""
    for side, df in (("left", left), ("right", right)):
        twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{side} key repeats: {twice[0].asDict()}")
    return left.join(right, keys, "left")


def coalescing_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which columns on both sides become one, the left value first."""
    both = [c for c in right.columns if c in left.columns and c not in keys]
    r = right.select(*keys, *[F.col(c).alias(f"_r_{c}") if c in both else F.col(c) for c in right.columns if c not in keys])
    joined = left.join(r, keys, "left")
    return joined.select(*[F.coalesce(c, f"_r_{c}").alias(c) if c in both else F.col(c) for c in left.columns], *[c for c in right.columns if c not in left.columns])


def asof(rows: DataFrame, observations: DataFrame, key: str, at: str, seen: str, values: list[str], max_age: int | None = None) -> DataFrame:
    """Latest observation of a key at or before a row's date, dropped when older than max_age days.

    Rows and observations are one stream per key, and the last known observation is carried along it: one
    shuffle on the key and no range comparison.
    """
    packed = F.struct(F.col(seen).alias("seen"), *values)
    obs = observations.select(F.col(key).alias("_k"), F.col(seen).alias("_t"), F.lit(0).alias("_kind"), packed.alias("_o"), F.lit(None).cast(rows.select(F.struct("*").alias("x")).schema["x"].dataType).alias("_row"))
    own = rows.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(obs.schema["_o"].dataType).alias("_o"), F.struct("*").alias("_row"))
    w = Window.partitionBy("_k").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = obs.unionByName(own).withColumn("_last", F.last("_o", True).over(w)).where("_kind = 1")
    fresh = F.lit(True) if max_age is None else F.datediff("_t", "_last.seen") <= max_age
    return found.select("_row.*", *[F.when(fresh, F.col(f"_last.{v}")).alias(v) for v in values], F.when(fresh, F.col("_last.seen")).alias("seen"))


def available_on(days: DataFrame, observed: DataFrame, lag: int) -> DataFrame:
    """(seen, available): the lag-th session after each observation day (lag 1: the next one); days past the calendar's end go.

    Sessions and observation days are one ordered table with a row a day, in which sessions are counted.
    """
    mark = days.select(F.col("date").alias("day")).distinct().withColumn("s", F.lit(1)).unionByName(observed.select(F.col("seen").alias("day")).distinct().withColumn("s", F.lit(0)))
    counted = mark.groupBy("day").agg(F.max("s").alias("s"), (F.min("s") == 0).alias("o")).withColumn("n", F.sum("s").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    nth = counted.where("s = 1").select("n", F.col("day").alias("available"))
    return counted.where("o").select(F.col("day").alias("seen"), (F.col("n") + lag).alias("n")).join(nth, "n").select("seen", "available")


def lagged_asof(rows: DataFrame, observations: DataFrame, days: DataFrame, key: str, values: list[str], lag: int = 1, max_age: int | None = None) -> DataFrame:
    """Rows (key, date, ...) with the latest observation (key, seen, values) that was available `lag` sessions after it was made.

    An observation enters on the lag-th session of `days` after its own day, wherever that falls, and is carried until
    it is more than max_age days old, counted from the day it was made; one past the calendar's end never enters. Of
    several observations of a key that enter together the last made counts, of one day the least by `values`.
    """
    o = observations.select(key, "seen", *values).where("seen is not null")
    o = o.groupBy(key, "seen").agg(F.min(F.struct(*values)).alias("v")).join(available_on(days, o, lag), "seen")
    o = o.groupBy(key, "available").agg(F.max_by(F.struct("v", "seen"), "seen").alias("o")).select(key, "available", *[F.col(f"o.v.{v}").alias(v) for v in values], F.col("o.seen").alias("observed_at"))
    found = asof(rows, o, key, "date", "available", [*values, "observed_at"]).drop("seen")
    fresh = F.lit(True) if max_age is None else F.datediff("date", "observed_at") <= max_age
    return found.withColumns({v: F.when(fresh, F.col(v)) for v in values})


def strictly_after(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """The first price after each row's date, from a price table keyed by (symbol, date)."""
    nxt = prices.select("symbol", F.col("date"), F.lead("date").over(Window.partitionBy("symbol").orderBy("date")).alias("next_date"), F.lead("close").over(Window.partitionBy("symbol").orderBy("date")).alias("next_close"))
    return rows.join(nxt, ["symbol", "date"], "left")


def members(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows inside a membership interval of their symbol: start <= date < end, an open end counts as no end."""
    i = intervals.select(F.col("symbol").alias("i_symbol"), "start", "end")
    inside = (F.col("symbol") == F.col("i_symbol")) & (F.col("date") >= F.col("start")) & (F.col("end").isNull() | (F.col("date") < F.col("end")))
    return rows.join(i, inside, "left_semi")


def overlapping_intervals(intervals: DataFrame) -> DataFrame:
    """Intervals that begin before an earlier one of the same symbol has ended."""
    w = Window.partitionBy("symbol").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    far = F.lit("9999-12-31").cast("date")
    return intervals.withColumn("before", F.max(F.coalesce("end", far)).over(w)).where(F.col("start") < F.col("before")).drop("before")


def difference(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join with the kind of change: added, removed, changed or same."""
    b, a = before.select(*keys, F.col(value).alias("old"), F.lit(True).alias("_b")), after.select(*keys, F.col(value).alias("new"), F.lit(True).alias("_a"))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return b.join(a, keys, "full_outer").select(*keys, kind.alias("change"), "old", "new")


def keep_best(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key: the first by `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def resolve_aliases(links: DataFrame, active: DataFrame) -> DataFrame:
    """(name, security): rename chains as connected names, each with its one active name; ambiguous groups stay out."""
    groups = connected_names(links)
    live = groups.join(active.select(F.col("symbol").alias("id")), "id", "left_semi")
    sole = live.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("security")).where("n = 1")
    return groups.join(sole.select("component", "security"), "component").select(F.col("id").alias("name"), "security")
