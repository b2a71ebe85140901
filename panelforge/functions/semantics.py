"""Column helpers with the library's rules for ties, nulls and short windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing(n: int, by: str = "symbol", order: str = "date"):
    """The last n rows of a series, this one included."""
    return Window.partitionBy(by).orderBy(order).rowsBetween(1 - n, 0)


def rolling(f, x: Column, n: int, by: str = "symbol", order: str = "date", need: Column | None = None) -> Column:
    """f over the last n rows; null unless all n values (of `need`, or of x) are known."""
    w = trailing(n, by, order)
    return F.when(F.count(x if need is None else need).over(w) == n, f(x).over(w))


def lag(x: Column, k: int, by: str = "symbol", order: str = "date") -> Column:
    return F.lag(x, k).over(Window.partitionBy(by).orderBy(order))


def lead(x: Column, k: int, by: str = "symbol", order: str = "date") -> Column:
    return F.lead(x, k).over(Window.partitionBy(by).orderBy(order))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero or null."""
    return F.when(b != 0, a / b)


def pct_rank(x: Column, *by) -> Column:
    """Average rank over ties divided by the number of known values; nulls stay null and do not count."""
    keys = [F.col(k) if isinstance(k, str) else k for k in by]
    order = Window.partitionBy(*keys, x.isNull()).orderBy(x)
    ties = Window.partitionBy(*keys, x)
    known = Window.partitionBy(*keys)
    return F.when(x.isNotNull(), (F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)) / F.count(x).over(known))


def bucket_of(place: Column, n: Column, buckets: int = 10) -> Column:
    """Quantile bucket (1..buckets) of place 1..n, in whole numbers: ceil(b (place - 1) / (n - 1)), at least 1."""
    b = F.least(n, F.lit(buckets))
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(b * (place - 1) / (n - 1)))).cast("int")


def tail_size(n: Column, share: float = 0.1) -> Column:
    """Names in a top or bottom basket: a share of n rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(n * share)).cast("int")


def correlation(x: Column, y: Column) -> Column:
    """Correlation as an aggregate of pairs that are both known; null where either side never moves (corr fails there)."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sd = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(sd > 0, F.covar_pop(x, y) / sd)


def finite(x: Column, digits: int | None = None) -> Column:
    """Null for NaN and infinities, else the value, rounded if asked."""
    ok = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return ok if digits is None else F.round(ok, digits)


def share_true(condition: Column) -> Column:
    """Mean of a condition as 0/1; an unknown one counts as 0 and stays in the denominator."""
    return F.avg(F.coalesce(condition.cast("int"), F.lit(0)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Report form: doubles rounded, with no negative zero; days as text."""
    return df.select(*[
        (F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t == "date" else F.col(c)
        for c, t in df.dtypes
    ])
