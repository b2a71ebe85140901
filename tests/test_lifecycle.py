"""Ends of securities, names over time and late observations: the cases that decide each rule."""

from __future__ import annotations

import datetime

import pytest

from panelforge.operators import identity as idy
from panelforge.operators import joins as j
from panelforge.operators import terminal as te

DAYS = [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(40) if (datetime.date(2020, 1, 1) + datetime.timedelta(days=i)).weekday() < 5][:22]
BARS = "symbol string, date date, close double, adj_close double, stock_splits double, source string, no_trade boolean"
EVENTS = "symbol string, kind string, effective_date date, known_date date, cash double, stock_ratio double, successor string, verified boolean, unresolved boolean, rights_max double"
OLD = [90.0, 100.0, 105.0, 110.0, 120.0]


def bars(symbol, closes, source="archive", splits=None, halted=()):
    return [(symbol, DAYS[i], c, c, (splits or {}).get(i, 0.0), source, i in halted) for i, c in enumerate(closes)]


def outcomes(spark, rows, event, h=14, as_of=DAYS[-1], symbol="OLD"):
    spine = spark.createDataFrame([(symbol, d) for d in DAYS], "symbol string, date date")
    events = spark.createDataFrame([(symbol, *event)] if event else [], EVENTS)
    out = te.terminal_labels(spine, spark.createDataFrame(rows, BARS), events, h, as_of).orderBy("date").collect()
    assert len(out) == len(DAYS)
    return out


def test_cash_finishes_the_horizon_without_new_entries(spark):
    got = outcomes(spark, bars("OLD", OLD), ("cash_acquisition", DAYS[5], DAYS[5], 125.0, None, None, True, False, None))
    assert got[0].outcome == pytest.approx(0.25) and got[0].available == DAYS[15] and got[0].resolved
    assert got[4].outcome is None and not got[4].resolved


def test_unverified_missing_and_unpriced_stay_unknown(spark):
    for event in (None, ("cash_acquisition", DAYS[5], DAYS[5], 125.0, None, None, False, False, None), ("cash_acquisition", DAYS[5], DAYS[5], 125.0, None, None, True, True, None), ("halt", DAYS[5], DAYS[5], 125.0, None, None, True, False, None), ("worthless_cancellation", DAYS[5], DAYS[5], 1.0, None, None, True, False, None)):
        got = outcomes(spark, bars("OLD", OLD), event)
        assert got[0].outcome is None and not any(r.resolved for r in got) and got[0].low is None
    got = outcomes(spark, bars("OLD", OLD), ("worthless_cancellation", DAYS[5], DAYS[5], 0.0, None, None, True, False, None))
    assert got[0].outcome == -1


def test_mixed_is_cash_and_successor(spark):
    rows = bars("OLD", OLD) + bars("NEW", [200.0] * len(DAYS))
    event = ("mixed_acquisition", DAYS[5], DAYS[16], 25.0, 0.5, "NEW", True, False, None)
    got = outcomes(spark, rows, event)
    assert got[0].outcome == pytest.approx(0.25) and got[0].available == DAYS[16]
    assert outcomes(spark, rows, event, as_of=DAYS[15])[0].outcome is None


def test_stock_counts_shares_of_the_first_session(spark):
    sunday = datetime.date(2020, 1, 5)
    rows = bars("OLD", [90.0, 100.0, 110.0]) + bars("NEW", [100.0] * len(DAYS), "yahoo", {10: 2.0})
    event = ("stock_acquisition", sunday, sunday, 0.0, 0.75, "NEW", True, False, None)
    got = outcomes(spark, rows, event)
    assert got[0].outcome == pytest.approx(0.5) and got[0].available == DAYS[15]
    assert outcomes(spark, bars("OLD", [90.0, 100.0, 110.0]) + bars("NEW", [100.0] * len(DAYS), "archive", {10: 2.0}), event)[0].outcome == pytest.approx(-0.25)
    late = [r for r in rows if r[0] == "OLD" or r[1] > DAYS[7]]
    assert outcomes(spark, late, event)[0].status == "no_successor_price"


def test_bounds_of_rights(spark):
    got = outcomes(spark, bars("OLD", OLD), ("cash_acquisition", DAYS[5], DAYS[5], 125.0, None, None, True, True, 25.0))
    assert got[0].outcome is None and got[0].low == pytest.approx(0.25) and got[0].high == pytest.approx(0.5) and got[4].low is None


def test_gap_halts_and_plain_quotes(spark):
    event = ("cash_acquisition", DAYS[14], DAYS[14], 125.0, None, None, True, False, None)
    assert outcomes(spark, bars("OLD", OLD), event)[0].status == "long_gap"
    full = bars("OLD", [100.0 + i for i in range(22)], halted={1})
    got = outcomes(spark, full, None)
    assert got[0].outcome is None and got[2].outcome == pytest.approx(117 / 103 - 1)
    carried = [(*r[:5], "Carried forward", r[6]) if r[1] == DAYS[4] else r for r in bars("OLD", OLD)]
    last = te.valued_events(spark.createDataFrame([("OLD", "cash_acquisition", DAYS[5], DAYS[5], 125.0, None, None, True, False, None)], EVENTS), spark.createDataFrame(carried, BARS)).first()
    assert last.last_date == DAYS[3] and last.last_close == 110.0


def test_long_chains_of_names(spark):
    links = [(f"N{i:02}", f"N{i + 1:02}") for i in range(40)] + [("X", "Y"), ("X", "X"), (None, "Z"), ("Y", "W"), ("Y", "W")]
    got = {r.id: r.component for r in idy.connected_names(spark.createDataFrame(links, "old string, new string").repartition(3)).collect()}
    assert got == {f"N{i:02}": "N00" for i in range(41)} | {k: "W" for k in "WXY"}
    assert idy.connected_names(spark.createDataFrame([], "old string, new string")).count() == 0


def resolve(spark, symbol, active, renames=(), isin=None, isins=(), day=datetime.date(2020, 1, 1)):
    securities = [(a, datetime.date(2000, 1, 1), None) if isinstance(a, str) else a for a in active]
    return idy.resolve_identities(
        spark.createDataFrame([(symbol, isin, day), (symbol, isin, day)], "symbol string, isin string, date date"), spark.createDataFrame(securities, "label string, start date, end date"),
        spark.createDataFrame(list(renames), "old string, new string"), spark.createDataFrame(list(isins), "isin string, label string"),
    ).collect()


def test_identities_never_guess(spark):
    one = lambda *a, **k: (lambda rows: (len(rows) == 1, rows[0].security, list(rows[0].candidates)))(resolve(spark, *a, **k))
    assert one("SNDK", ["SNDK-201605"]) == (True, "SNDK-201605", ["SNDK-201605"])
    assert one("SNDK", ["SNDK-201605", "SNDK"]) == (True, None, ["SNDK", "SNDK-201605"])
    assert one("FB", ["META"], [("FB", "META")])[1] == "META"
    assert one("AAPL*", ["AAPL"])[1] == "AAPL" and one("brkb", ["BRK.B"])[1] == "BRK.B"
    chain = [(f"N{i}", f"N{i + 1}") for i in range(40)]
    assert one("N0", ["N40"], chain)[1] == "N40"
    gone = [("N40", datetime.date(2000, 1, 1), datetime.date(2019, 1, 1))]
    assert one("N0", gone, chain)[1] is None and one("N0", gone, chain, day=datetime.date(2018, 1, 1))[1] == "N40"


def test_identifiers_reject_conflicts(spark):
    ids = [("US1", "BKNG"), ("US2", "OTHER"), ("US3", "OLD"), ("US3", "NEW")]
    one = lambda *a, **k: resolve(spark, *a, isins=ids, **k)[0].security
    assert one("PCLN", ["BKNG"], isin="US1") == "BKNG" and one("PCLN", ["OTHER"], isin="US1") is None
    assert one("OTHER", ["OTHER"], isin="US1") is None and one("BKNG", ["BKNG", "OTHER"], isin="US2") is None
    assert one("X", ["OLD", "NEW"], isin="US3") is None and one("BKNG", ["BKNG"], isin="US9") == "BKNG"


def test_lagged_observations(spark):
    days = spark.createDataFrame([(d,) for d in DAYS], "date date")
    rows = spark.createDataFrame([(s, d) for s in "AB" for d in DAYS], "symbol string, date date")
    weekend = datetime.date(2020, 1, 5)
    obs = [("A", DAYS[2], "x"), ("A", weekend, "y"), ("A", weekend, "z"), ("A", DAYS[-1], "late"), (None, DAYS[3], "n")]
    seen = spark.createDataFrame(obs, "symbol string, seen date, code string")
    got = {(r.symbol, r.date): r for r in j.lagged_asof(rows, seen, days, "symbol", ["code"], 1, 10).collect()}
    assert [got["A", d].code for d in DAYS[:4]] == [None, None, None, "y"]  # the weekend's is later and enters with Friday's
    assert got["A", DAYS[3]].observed_at == weekend and got["A", datetime.date(2020, 1, 15)].code == "y" and got["A", datetime.date(2020, 1, 16)].code is None
    assert all(got["B", d].code is None for d in DAYS) and got["A", DAYS[-1]].code is None
    two = {(r.symbol, r.date): r.code for r in j.lagged_asof(rows, seen, days, "symbol", ["code"], 2).collect()}
    assert two["A", DAYS[3]] is None and two["A", DAYS[4]] == "y" and two["A", DAYS[-1]] == "y"
    assert j.lagged_asof(rows, seen.limit(0), days, "symbol", ["code"]).where("code is not null").count() == 0
