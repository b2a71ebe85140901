import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import scalars as x
from panelforge.functions.semantics import bucket_of, finite, pct_rank, rolling
from panelforge.operators import backtest as b
from panelforge.operators import cross_section as c
from panelforge.operators import features as f
from panelforge.operators import history as h
from panelforge.operators import joins as j
from panelforge.operators import splits as v
from panelforge.operators.model import score_trees


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def bars(spark, closes, symbol="A"):
    return spark.createDataFrame([(symbol, "S", day(i), x, x, x, x, 10.0) for i, x in enumerate(closes)], "symbol string, sector string, date date, open double, high double, low double, close double, volume double")


def test_pct_rank_averages_ties_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 1.0), (1, 1.0), (1, None), (2, None)], "d int, x double")
    got = {(r.d, r.x): r.p for r in df.select("d", "x", pct_rank(F.col("x"), "d").alias("p")).collect()}
    assert got == {(1, 3.0): 1.0, (1, 1.0): 0.5, (1, None): None, (2, None): None}


def test_rolling_needs_all_values(spark):
    df = bars(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0])
    got = [r.m for r in df.select("date", rolling(F.avg, F.col("close"), 3).alias("m")).orderBy("date").collect()]
    assert got == [None, None, None, None, None, 5.0]


@pytest.mark.parametrize("n", [1, 2, 9, 10, 25, 91, 501, 502])
def test_buckets_in_whole_numbers(spark, n):
    got = [r.b for r in spark.range(1, n + 1).select(bucket_of(F.col("id"), F.lit(n)).alias("b"), "id").orderBy("id").collect()]
    b_ = min(10, n)
    assert got == [max(1, -(-b_ * (r - 1) // (n - 1))) if n > 1 else 1 for r in range(1, n + 1)]
    if n == 502:
        assert got.count(1) == 51 and got.count(10) == 51


def test_finite(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.234,), (None,)], "x double")
    assert [r[0] for r in df.select(finite(F.col("x"), 2)).collect()] == [None, None, 1.23, None]


def test_rsi_edges(spark):
    up, flat = [float(i) for i in range(1, 20)], [5.0] * 19
    assert f.rsi(bars(spark, up)).orderBy(F.desc("date")).first().rsi_14 == 100
    assert f.rsi(bars(spark, flat)).orderBy(F.desc("date")).first().rsi_14 == 50
    assert f.rsi(bars(spark, up)).orderBy("date").first().rsi_14 is None
    assert f.rsi(bars(spark, up), fill=True).orderBy("date").first().rsi_14 == 50


def test_labels_use_next_close_and_whole_path(spark):
    df = bars(spark, [10.0, 10.0, 12.0, 9.0, 11.0])
    got = c.forward_next_close(df, 2).orderBy("date").collect()
    assert got[0].forward_return == pytest.approx(-0.1) and got[2].forward_return is None
    dd = c.path_drawdown(df, 2).orderBy("date").collect()
    assert dd[0].max_drawdown == pytest.approx(9 / 12 - 1) and dd[3].max_drawdown is None


def test_features_do_not_look_ahead(spark):
    a = bars(spark, [float(10 + i % 7) for i in range(40)])
    later = a.withColumn("close", F.when(F.col("date") > F.lit(day(30)), 99.0).otherwise(F.col("close")))
    for op in (f.returns, f.volatility, f.moving_averages, f.rsi):
        x1, x2 = (op(d).where(F.col("date") <= F.lit(day(30))).toPandas().sort_values("date").reset_index(drop=True) for d in (a, later))
        pd.testing.assert_frame_equal(x1, x2)


def test_partitions_do_not_matter(spark):
    a = bars(spark, [float(10 + i % 5) for i in range(30)]).union(bars(spark, [float(20 - i % 3) for i in range(30)], "B"))
    one, many = (f.volatility(d, (5,)).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True) for d in (a.repartition(1), a.repartition(8)))
    pd.testing.assert_frame_equal(one, many)


def test_asof_expires_and_never_looks_ahead(spark):
    rows = spark.createDataFrame([("A", day(1)), ("A", day(5)), ("A", day(60)), ("B", day(5))], "symbol string, date date")
    obs = spark.createDataFrame([("A", day(2), "x"), ("A", day(5), "y")], "symbol string, date date, code string")
    got = {(r.symbol, r.date): r.code for r in j.asof(rows, obs, "symbol", "date", "date", ["code"], 30).collect()}
    assert got == {("A", day(1)): None, ("A", day(5)): "y", ("A", day(60)): None, ("B", day(5)): None}


def test_membership_ends_are_exclusive(spark):
    rows = spark.createDataFrame([("A", day(i)) for i in range(5)], "symbol string, date date")
    iv = spark.createDataFrame([("A", day(1), day(3)), ("A", day(4), None)], "symbol string, start date, end date")
    assert sorted(r.date for r in j.members(rows, iv).collect()) == [day(1), day(2), day(4)]
    assert j.overlapping_intervals(iv).count() == 0


def test_aliases_never_guess(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "old string, new string")
    active = spark.createDataFrame([("c",), ("x",), ("y",)], "symbol string")
    assert {r.name: r.security for r in j.resolve_aliases(links, active).collect()} == {"a": "c", "b": "c", "c": "c"}


def test_embargo(spark):
    rows = spark.createDataFrame([(day(i),) for i in range(120)], "date date")
    got = {r.split: (r.a, r.b) for r in v.embargoed_split(rows, 20, 20, 4).groupBy("split").agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()}
    assert (got["validation"][0] - got["train"][1]).days == 6 and (got["test"][0] - got["validation"][1]).days == 6
    with pytest.raises(ValueError):
        v.embargo_for(14, 10)


def test_terminal_cash_and_rights(spark):
    panel = spark.createDataFrame([("A", i, 10.0 if i < 4 else None) for i in range(10)] + [("B", i, 10.0 if i < 4 else None) for i in range(10)], "symbol string, session_ix int, close double")
    ev = spark.createDataFrame([("A", 4, 6, 12.0, True, False, 0.0), ("B", 4, 6, 12.0, True, True, 3.0)], "symbol string, event_ix int, known_ix int, value double, verified boolean, unresolved boolean, rights_max double")
    got = {(r.symbol, r.session_ix): r for r in h.terminal_outcomes(panel, ev, 3).collect()}
    assert got["A", 1].outcome == pytest.approx(0.2) and got["A", 1].available_ix == 6 and got["A", 1].resolved
    assert got["B", 1].outcome is None and got["A", 3].outcome is None
    bounds = {(r.symbol, r.session_ix): (r.low, r.high) for r in h.outcome_bounds(panel, ev, 3).collect()}
    assert bounds["B", 1] == (pytest.approx(0.2), pytest.approx(0.5))


def test_baskets_rank_before_dropping_unknown(spark):
    rows = [(day(0), f"s{i}", "S", float(i), None if i == 19 else 0.1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "date date, symbol string, sector string, score double, outcome double, grade int")
    r = b.known_baskets(df).first()
    assert (r.members, r.known, r.top_mean) == (2, 1, None)
    assert b.daily_baskets(df).first().top_mean == pytest.approx(0.1)


def test_bootstrap_agrees_with_itself(spark):
    daily = spark.createDataFrame([(day(i), float(i % 5)) for i in range(50)], "date date, x double")
    a, c_ = b.bootstrap_mean(daily, "x").first(), b.bootstrap_mean(daily.repartition(7), "x").first()
    assert a == c_ and a.low < 2.0 < a.high
    assert b.block_bootstrap_mean(daily.limit(5), "x", 10).first().low is None


def test_tree_defaults(spark):
    nodes = [
        {"tree": 0, "node": 0, "feature": "a", "threshold": 1.0, "left": 1, "right": 2, "default_left": False, "value": None, "gain": 1.0},
        {"tree": 0, "node": 1, "feature": None, "threshold": 0, "left": -1, "right": -1, "default_left": False, "value": 1.0, "gain": 0},
        {"tree": 0, "node": 2, "feature": None, "threshold": 0, "left": -1, "right": -1, "default_left": False, "value": 2.0, "gain": 0},
    ]
    df = spark.createDataFrame([(0.5,), (1.0,), (None,)], "a double")
    assert [r.score for r in score_trees(df, nodes).collect()] == [1.0, 2.0, 2.0]


def test_calendar(spark):
    days = {r.date: r.is_session for r in x.trading_days(spark, "2024-01-01", "2026-12-31").collect()}
    closed = ["2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25", "2025-04-18", "2026-04-03", "2026-07-03", "2024-06-01"]
    assert not any(days[dt.date.fromisoformat(d)] for d in closed)
    assert days[dt.date(2024, 7, 5)] and days[dt.date(2024, 1, 2)]


def test_scalars(spark):
    df = spark.createDataFrame([("<p>A &amp; B</p> &lt;x&gt;", "$1.5T", "aapl, $msft aapl 9x")], "h string, s string, t string")
    r = df.select(x.strip_html(F.col("h")).alias("h"), x.parse_size(F.col("s")).alias("s"), x.ticker_list(F.col("t")).alias("t"), x.first_sentences(F.lit("The U.S. grew. It did. So."), 2).alias("f")).first()
    assert (r.h, r.s, r.t, r.f) == ("A & B <x>", 1.5e12, ["AAPL", "MSFT"], "The U.S. grew. It did.")
