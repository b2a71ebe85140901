"""Small rules of the scorebook, reviewed dividends, probability metrics and series."""

from __future__ import annotations

import datetime
import math

import pytest

from panelforge.functions import scalars as x
from panelforge.operators import backtest as b
from panelforge.operators import cross_section as c
from panelforge.operators import history as h
from panelforge.operators import quality as qa
from panelforge.operators import scorebook as k

DAY = datetime.date(2020, 1, 1)


def day(i):
    return DAY + datetime.timedelta(days=i)


def test_bottom_sectors(spark):
    rows = [(DAY, f"S{i:03}", "Tech" if i >= 180 else "Health" if i % 2 else None, i + 1) for i in range(200)] + [(DAY, "none", "Tech", None)]
    df = spark.createDataFrame(rows, "date date, symbol string, sector string, rank int")
    got = [(r.sector, r["count"], r.universe, r.bottom_share, r.ratio, list(r.examples)) for r in k.bottom_sectors(df).collect()]
    assert got == [("Tech", 20, 20, 66.7, 6.67, ["S199", "S198", "S197", "S196"])]  # the worst 30 of 200
    assert [r.symbol for r in k.bottom_candidates(df, 2).orderBy("place").collect()] == ["S199", "S198"]
    few = k.bottom_sectors(df.where("rank <= 10")).collect()
    assert {r.sector: (r["count"], r.ratio) for r in few} == {"Health": (5, 1.0), "Unknown": (5, 1.0)}


def test_sectors_by_correlation(spark):
    up = [math.sin(i) for i in range(300)]
    returns = spark.createDataFrame([("A", day(i), v if i >= 200 else -v) for i, v in enumerate(up)] + [("B", day(i), 0.1) for i in range(300)] + [("C", day(i), up[i]) for i in range(59)] + [("D", day(0), None)], "symbol string, date date, r1 double")
    sectors = spark.createDataFrame([("X", day(i), v) for i, v in enumerate(up)] + [("Y", day(i), -v) for i, v in enumerate(up)], "sector string, date date, s1 double")
    got = {r.symbol: (r.sector, r.source, r.correlation, r.observations) for r in k.infer_sectors(returns, sectors, 60, 100, "F").collect()}
    assert got == {"A": ("X", "return_correlation", 1.0, 100), "B": ("F", "fallback", None, 0), "C": ("F", "fallback", None, 0), "D": ("F", "fallback", None, 0)}


def test_reviewed_dividend(spark):
    bars = [("A", day(i), 100.0, adj, div, split, "yahoo") for i, (adj, div, split) in enumerate([(90.0, 0.0, 0.0), (90.0, 0.0, 0.0), (95.0, 1.0, 0.0), (100.0, 0.0, 2.0)])]
    bars = spark.createDataFrame(bars, "symbol string, date date, close double, adj_close double, dividends double, stock_splits double, source string")
    schema = "symbol string, date date, cash double, expected double, source_url string"
    good = h.reviewed_corrections(bars, spark.createDataFrame([("A", day(2), 8.0, 1.0, "https://x")], schema))
    r = good.first()
    assert (r.status, r.value) == ("applied", 4.0) and r.factor == pytest.approx((95 / 90) / 1.04)
    after = {x.date: x for x in h.correct_adjusted(bars, good).collect()}
    assert after[day(2)].adj_close / after[day(1)].adj_close == pytest.approx(1.04) and after[day(3)].adj_close == 100.0 and after[day(2)].dividends == 4.0
    assert after[day(1)].adj_close == after[day(0)].adj_close
    cases = [("A", day(2), 8.0, 2.0, "https://x"), ("A", day(0), 8.0, 0.0, "https://x"), ("A", day(2), 8.0, 1.0, "http://x"), ("A", day(9), 8.0, 1.0, "https://x"), ("A", day(2), -1.0, 1.0, "https://x")]
    status = [h.reviewed_corrections(bars, spark.createDataFrame([c_], schema)).first().status for c_ in cases]
    assert status == ["precondition_changed", "precondition_changed", "no_evidence", "no_single_bar", "bad_dividend"]


def test_probability_metrics(spark):
    rows = [("g", day(i // 4), f"S{i % 4}", p, o, int((o or 0) > 0)) for i, (p, o) in enumerate([(0.9, 0.1), (0.9, -0.1), (0.2, 0.3), (0.1, -0.2), (1.0, 0.2), (0.5, 0.1), (0.0, -0.3), (0.4, 0.1), (0.3, None)])]
    df = spark.createDataFrame(rows, "g string, date date, symbol string, probability double, outcome double, label int").repartition(3)
    r = b.probability_metrics(df, ["g"]).first()
    clip = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    known = [(p, o, y) for *_, p, o, y in rows[:8]]
    assert r.rows == 8 and r.log_loss == pytest.approx(-sum(math.log(clip(p)) if y else math.log(1 - clip(p)) for p, _, y in known) / 8)
    assert r.accuracy == pytest.approx(5 / 8) and r.positive_rate == pytest.approx(5 / 8)
    assert r.top == pytest.approx((0.1 + 0.2) / 2) and r.bottom == pytest.approx((-0.2 - 0.3) / 2) and r.spread == pytest.approx(0.4) and r.top_hit == 1.0
    assert r.global_top == pytest.approx(0.2) and r.global_fifth == pytest.approx(0.2)


def test_series_and_labels(spark):
    rows = [("a", 1, 2.0, "bps"), ("a", 2, float("nan"), "bps"), ("a", 3, 2.5, "bps"), ("a", 4, None, "bps"), ("b", 1, 4.0, "pct"), ("c", 1, 4.0, "pct"), ("c", 2, 5.0, "pct"), ("d", 1, float("inf"), "pp")]
    got = {r.s: (r.latest, r.previous, r.delta) for r in x.latest_deltas(spark.createDataFrame(rows, "s string, at int, v double, k string"), "s", "at", "v", "k").collect()}
    assert got == {"a": (2.5, 2.0, 50.0), "b": (4.0, None, None), "c": (5.0, 4.0, 25.0)}
    df = spark.createDataFrame([(0.2, 0.1), (0.1, 0.1), (None, 0.1), (0.1, None)], "a double, b double")
    assert [r.outperform for r in c.outperform_label(df, "a", "b").collect()] == [1, 0, None, None]


def test_contract_violations(spark):
    nan = float("nan")
    rows = [(DAY, f"S{i:02}", float(i + 1), "none", 1.0, None, 0.5) for i in range(11)]
    rows[3] = (DAY, "S03", 4.0, "model_rebound_watch", 1.0, None, 0.5)
    rows[4] = (DAY, "S04", 5.0, "momentum_confirmed", nan, 2.0, 0.5)
    rows[9], rows[10] = (DAY, "S09", 12.0, "none", None, None, None), (DAY, "S10", nan, None, None, None, 0.5)
    schema = "date date, symbol string, rank double, setup_type string, stop_price double, activation_price double, beta double"
    research = spark.createDataFrame([(DAY, "S00", 0.5), (DAY, "S01", 0.25), (DAY, "S09", None), (DAY, "S10", None), (day(1), "S02", 9.0)], "date date, symbol string, beta double")
    decile = spark.createDataFrame([(DAY, "S00"), (DAY, "S05")], "date date, symbol string")
    got = {(r.rule, r.symbol) for r in qa.contract_violations(spark.createDataFrame(rows, schema), research, decile, ["beta"]).collect()}
    assert got == {("rank_sequence", "S09"), ("rank_missing", "S10"), ("activation_missing", "S03"), ("activation_extra", "S04"), ("stop_missing", "S04"), ("decile_missing", "S01"), ("decile_extra", "S05"), ("metric_mismatch", "S01"), ("metric_mismatch", "S10")}
    empty = qa.contract_violations(spark.createDataFrame([], schema), research, decile, ["beta"]).collect()
    assert {(r.rule, r.symbol) for r in empty} == {("decile_extra", "S00"), ("decile_extra", "S05")}


def test_trend_summary(spark):
    rows = [(DAY, f"S{i:02}", i + 1, 100.0 - i, 50.0 if i else None, "Tech" if i % 2 else None, "Mega" if i < 3 else None, "Both Models Agree" if i == 0 else "1Y Strong / Tactical Weak") for i in range(20)]
    rows += [(day(1), f"T{i}", 9 - i if i < 8 else None, 10.0, None, "Health", "Mid", None) for i in range(10)]
    df = spark.createDataFrame(rows, "date date, symbol string, rank int, percentile double, tactical double, sector string, cap string, agreement string")
    got = {(r.date, r.part, r.item): (r.place, r.names, r.percentile, r.tactical, list(r.symbols)) for r in k.trend_summary(df).collect()}
    names = [f"S{i:02}" for i in range(11)]
    assert got == {
        (DAY, "sector", "Unclassified"): (1, 6, 95.0, 41.7, names[::2]), (DAY, "sector", "Tech"): (2, 5, 95.0, 50.0, names[1::2]),
        (DAY, "cap", "Unknown cap"): (1, 8, 93.5, 50.0, names[3:]), (DAY, "cap", "Mega"): (2, 3, 99.0, 33.3, names[:3]),
        (DAY, "count", "top_decile"): (1, 11, 95.0, 45.5, []), (DAY, "count", "tactical_weak"): (2, 10, 94.5, 50.0, []), (DAY, "count", "both_strong"): (3, 1, 100.0, 0.0, []),
        (day(1), "sector", "Health"): (1, 1, 10.0, 0.0, ["T7"]), (day(1), "cap", "Mid"): (1, 1, 10.0, 0.0, ["T7"]), (day(1), "count", "top_decile"): (1, 1, 10.0, 0.0, []),
    }


def test_candidate_setups(spark):
    rows = [  # symbol, rank, n, close, vol20, vs_sma50, vs_sma200, r20, r60
        ("up", 1, 30, 10.0, 0.02, 0.1, 0.1, 0.1, 0.1), ("down", 2, 30, 10.0, 0.02, -0.1, -0.1, -0.1, -0.1), ("mixed", 3, 30, 10.0, 0.02, 0.1, -0.1, 0.1, 0.1),
        ("quintile", 4, 30, 10.0, 0.02, 0.1, 0.1, 0.1, 0.1), ("rest", 7, 30, 10.0, 0.02, -0.1, -0.1, -0.1, -0.1), ("alone", 1, 1, 10.0, 0.02, None, 0.1, 0.1, 0.1),
        ("no volatility", 1, 30, 10.0, None, -0.1, -0.1, -0.1, -0.1), ("zero", 1, 30, 10.0, 0.0, -0.1, -0.1, -0.1, -0.1), ("unranked", None, 30, 10.0, 0.02, 0.1, 0.1, 0.1, 0.1), ("flat", 1, 30, 10.0, 0.02, 0.0, 0.1, 0.1, 0.1),
    ]
    df = spark.createDataFrame(rows, "symbol string, rank int, n int, close double, vol20 double, vs_sma50 double, vs_sma200 double, r20 double, r60 double")
    got = {r.symbol: (r.setup, len(r.tags), r.bucket, r.stop, r.activation_price, r.activation_pct) for r in k.candidate_setups(df).collect()}
    assert got == {
        "up": ("momentum_confirmed", 1, "Top Decile", True, None, None), "down": ("model_rebound_watch", 3, "Top Decile", True, 10.15, 1.5),
        "mixed": ("model_ranked_not_momentum_confirmed", 1, "Top Decile", True, None, None), "quintile": ("model_ranked", 0, "Top Quintile", False, None, None),
        "rest": ("model_ranked", 0, "Ranked", False, None, None), "alone": ("model_ranked", 0, "Top Decile", True, None, None),
        "no volatility": ("model_rebound_watch", 3, "Top Decile", True, None, None), "zero": ("model_rebound_watch", 3, "Top Decile", True, None, None),
        "unranked": ("model_ranked", 0, "Ranked", False, None, None), "flat": ("model_ranked", 0, "Top Decile", True, None, None),
    }


def test_survivorship_audit(spark):
    removals = spark.createDataFrame([("A", DAY), ("A", day(30)), ("B", day(30)), ("", day(30)), (None, day(30)), ("old", day(-400)), ("late", day(41))], "symbol string, removed date")
    histories = spark.createDataFrame([("A", day(1), False), ("A", day(40), True), ("C", day(20), False)], "symbol string, date date, archived boolean")
    queue = {(r.symbol, r.removed, r.price_status, r.provider_rows, r.provider_end, r.has_archived_segment) for r in h.review_queue(removals, histories, histories["archived"], 1).collect()}
    assert queue == {("A", DAY, "cached", 2, day(40), True), ("A", day(30), "cached", 2, day(40), True), ("B", day(30), "not_cached", 0, None, False)}
    reference = spark.createDataFrame([("A", True, False), ("C", True, False), ("D", True, True), ("E", False, False)], "symbol string, original boolean, current boolean")
    found = sorted(tuple(r) for r in h.survivorship_findings(removals, histories, reference, 1).collect())
    assert found == [("removed_since_original", "A"), ("removed_since_original", "C"), ("removed_without_prices", "B"), ("terminal_or_alias_review", "C"), ("without_removal_event", "C")]
    assert h.review_queue(removals, histories.limit(0), histories["archived"]).collect() == []
