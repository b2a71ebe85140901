"""Validation splits by trading date: embargoed splits, walk-forward folds, sampled and cohort dates."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.sources.tables import sessions


def embargo_for(horizon: int, embargo: int | None = None) -> int:
    """Sessions between windows: one more than the horizon; a smaller wish is refused."""
    least = horizon + 1
    if embargo is not None and embargo < least:
        raise ValueError(f"an embargo of {embargo} leaks a {horizon}-session label; at least {least}")
    return least if embargo is None else embargo


def horizon_of(column: str) -> int:
    """Sessions in a label's name, as in forward_return_14d."""
    found = re.search(r"_(\d+)d(?:_|$)", column)
    if not found:
        raise ValueError(f"no horizon in {column}")
    return int(found[1])


def embargoed_split(rows: DataFrame, validation: int, test: int, horizon: int) -> DataFrame:
    """(date, split): train, validation and test dates with an embargo before each of the last two."""
    gap = embargo_for(horizon)
    days = sessions(rows)
    n = days.count()
    test_start = n - test
    val_end = test_start - gap
    val_start = val_end - validation
    train_end = val_start - gap
    if min(validation, test) <= 0 or train_end <= 0 or n <= validation + test + 2 * gap + 10:
        raise ValueError("not enough history for an embargoed split")
    ix = F.col("session_ix")
    role = F.when(ix < train_end, "train").when((ix >= val_start) & (ix < val_end), "validation").when(ix >= test_start, "test")
    return days.select("date", role.alias("split")).where("split is not null")


def walk_forward(rows: DataFrame, folds: int, validation: int, test: int, least_train: int, horizon: int) -> DataFrame:
    """(fold, split, date): expanding training windows; folds without room for the least training window are left out."""
    gap = embargo_for(horizon)
    days = sessions(rows)
    n = days.count()
    spans = []
    for back in reversed(range(folds)):
        test_end = n - back * test
        val_end = test_end - test - gap
        train_end = val_end - validation - gap
        if test_end - test < 0 or val_end - validation < 0 or train_end < least_train:
            continue
        k = len({s[0] for s in spans}) + 1
        spans += [(k, "train", 0, train_end), (k, "validation", val_end - validation, val_end), (k, "test", test_end - test, test_end)]
    table = rows.sparkSession.createDataFrame(spans, "fold int, split string, a int, b int")
    ranges = table.select("fold", "split", F.explode(F.sequence("a", F.col("b") - 1)).alias("session_ix"))
    return ranges.join(days, "session_ix").select("fold", "split", "date")


def sampled_dates(rows: DataFrame, frequency: str) -> DataFrame:
    """First session of each week ending on Friday, or of each month, quarter or year."""
    bucket = F.date_trunc("week", F.date_add("date", 2)) if frequency == "week_fri" else F.date_trunc(frequency, "date")
    return rows.groupBy(bucket.alias("bucket")).agg(F.min("date").alias("date")).select("date")


def long_enough(rows: DataFrame, least: int) -> DataFrame:
    """(symbol, sessions, kept): whether a symbol has enough rows."""
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("sessions")).withColumn("kept", F.col("sessions") >= least)


def frame_contract(df: DataFrame, keys: list[str], features: list[str], grade: str) -> DataFrame:
    """One row of counts that must all be zero: repeated keys, nulls or non-finite features, grades outside 0 to 4."""
    leaks = [c for c in features if re.search(r"forward|excess_return|_label|grade|outcome", c)]
    if leaks:
        raise ValueError(f"features that hold outcomes: {leaks}")
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"bad_{c}") for c in features]
    w = Window.partitionBy(*keys)
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).agg(F.count_if(F.col("_n") > 1).alias("repeated_keys"), F.count_if(~F.col(grade).between(0, 4) | F.col(grade).isNull()).alias("bad_grades"), *bad)


def without_outliers(df: DataFrame, column: str, cap: float) -> DataFrame:
    """Rows of training and validation beyond the cap go; test rows stay."""
    return df.where((F.col("split") == "test") | (F.abs(column) <= cap))


def strict_start(exported: datetime.date, training_end: datetime.date) -> datetime.date:
    """The first day a model is monitored strictly: after both its export and its training data."""
    return max(exported, training_end) + datetime.timedelta(days=1)


def trailing_split(rows: DataFrame, validation: float, test: float, embargo: int) -> DataFrame:
    """(date, split) by shares of the dates, with one embargo cut off the end of the validation window."""
    days = sessions(rows)
    n = days.count()
    test_start, val_start = n - int(n * test), n - int(n * test) - int(n * validation)
    ix = F.col("session_ix")
    role = F.when(ix < val_start, "train").when(ix < test_start - embargo, "validation").when(ix >= test_start, "test")
    return days.select("date", role.alias("split")).where("split is not null")
