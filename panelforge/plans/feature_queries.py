"""Queries F1 to F19 and their SQL."""

from __future__ import annotations

from panelforge.functions.semantics import rounded
from panelforge.operators import features as f
from panelforge.plans import sqlparts as q
from panelforge.sources import tables as t

QUERIES, SQL = {}, {}


def _add(name: str, run, sql: str) -> None:
    QUERIES[name] = lambda spark, sf: rounded(run(t.panel(spark, sf), t.benchmark(spark, sf)))
    SQL[name] = sql


_add("f1_returns", lambda p, b: f.returns(p), q.select({f"return_{k}d": q.ret(k) for k in (1, 5, 10, 20, 60, 120)} | {"reversal_5d": f"-({q.ret(5)})"}, "p"))
_add("f2_skip_momentum", lambda p, b: f.skip_momentum(p), q.select({f"momentum_{n}_{s}": f"{q.lag('close', s)} / {q.lag('close', n)} - 1" for n, s in ((126, 10), (252, 20))}, "p"))
_add("f3_volatility", lambda p, b: f.volatility(p), q.select(
    {f"volatility_{n}d": q.roll("stddev_samp", "r1", n) for n in (20, 60)} | {f"downside_{n}d": q.roll("stddev_samp", "CASE WHEN r1 < 0 THEN r1 WHEN r1 >= 0 THEN 0 END", n) for n in (20, 60)}, "p"))
_add("f4_max_return", lambda p, b: f.max_return(p), q.select({"max_return_20d": q.roll("max", "r1", 20)}, "p"))
_SMA = ", ".join(f"{q.roll('avg', 'close', n)} AS s{n}" for n in (20, 50, 100, 200))
_add("f5_moving_averages", lambda p, b: f.moving_averages(p), q.select(
    {f"sma_{n}": f"s{n}" for n in (20, 50, 100, 200)} | {f"price_vs_sma_{n}": f"close / s{n} - 1" for n in (20, 50, 100, 200)}
    | {f"sma_{a}_vs_{b}": f"s{a} / s{b} - 1" for a, b in ((20, 50), (50, 100), (100, 200))}, f"(SELECT *, {_SMA} FROM p)"))
_GL = f"(SELECT symbol, date, {q.roll('avg', 'CASE WHEN d1 > 0 THEN d1 WHEN d1 <= 0 THEN 0 END', 14)} AS g, {q.roll('avg', 'CASE WHEN d1 < 0 THEN -d1 WHEN d1 >= 0 THEN 0 END', 14)} AS l FROM p)"
_add("f6_rsi", lambda p, b: f.rsi(p), q.select({"rsi_14": "CASE WHEN l IS NULL THEN NULL WHEN l = 0 AND g > 0 THEN 100 WHEN l = 0 THEN 50 ELSE 100 - 100 / (1 + g / l) END"}, _GL))
_add("f6_rsi_filled", lambda p, b: f.rsi(p, fill=True), q.select({"rsi_14": "CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) ELSE 50 END"}, _GL))
_add("f7_volume", lambda p, b: f.volume_features(p), q.select(
    {f"volume_ratio_{n}d": f"volume / ({q.roll('avg', 'volume', n)})" for n in (20, 60)} | {"dollar_volume": "close * volume", "log_dollar_volume": "ln(1 + close * volume)"}, "p"))
_add("f8_illiquidity", lambda p, b: f.illiquidity(p).selectExpr("symbol", "date", "illiquidity_20d * 1e6 as illiquidity_20d"), q.select({"illiquidity_20d": f"({q.roll('avg', 'abs(r1) / (close * volume)', 20)}) * 1e6"}, "p"))
_add("f9_vol_adjusted", lambda p, b: f.vol_adjusted(p), q.select({f"vol_adjusted_{k}d": f"({q.ret(k)}) / ({q.roll('stddev_samp', 'r1', 20)})" for k in (20, 60)}, "p"))
_add("f10_range_distance", lambda p, b: f.range_distance(p, 52), q.select({"from_high_52d": f"close / ({q.roll('max', 'close', 52)}) - 1", "from_low_52d": f"close / ({q.roll('min', 'close', 52)}) - 1"}, "p"))
_PAIR = "CASE WHEN r1 IS NOT NULL AND b1 IS NOT NULL THEN 1 END"
_BETA = f"(SELECT symbol, date, r1, b1, ({q.roll('covar_samp({})', 'r1, b1', 60, _PAIR)}) / ({q.roll('var_samp', 'b1', 60)}) AS beta FROM p LEFT JOIN bench USING (date))"
_add("f11_beta", lambda p, b: f.beta(p, b), q.select({"beta_60d": "beta", "idiosyncratic_1d": "r1 - beta * b1"}, _BETA))
_TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
_add("f13_true_range", lambda p, b: f.true_range(p), q.select({"true_range": "tr", "atr_14": q.roll("avg", "tr", 14)}, f"(SELECT *, {_TR} AS tr FROM p)"))
_STOP = f"""(SELECT *, {q.roll('max', 'high', 22)} - 3 * atr AS ch, {q.roll('avg', 'close', 50)} - atr AS tn, {q.roll('min', 'low', 20)} - 0.5 * atr AS su
 FROM (SELECT *, {q.roll('avg', 'tr', 14)} AS atr FROM (SELECT *, {_TR} AS tr FROM p)))"""
_add("f14_stop_level", lambda p, b: f.stop_level(p), q.select({"stop_level": "CASE WHEN tn IS NOT NULL AND close IS NOT NULL THEN least(greatest(ch, tn, su, close - 4 * atr), close - 1.5 * atr) END"}, _STOP))
_CAL = """(SELECT symbol, max(date) AS date, arg_max(close, date) AS close, {} FROM (SELECT p.*, max(date) OVER (PARTITION BY symbol) AS ld FROM p WHERE close IS NOT NULL) GROUP BY symbol)""".format(
    ", ".join(f"arg_max(close, date) FILTER (date <= ld - {d}) AS c{d}" for d in (7, 14, 30, 60, 90)))
_add("f15_calendar_returns", lambda p, b: f.calendar_returns(p, p.date), q.select({f"return_{d}c": f"close / c{d} - 1" for d in (7, 14, 30, 60, 90)}, _CAL))
_add("f16_year_to_date", lambda p, b: f.year_to_date(p), q.select(
    {"return_ytd": "p.close / base - 1"}, "p LEFT JOIN (SELECT symbol AS s2, year(date) + 1 AS y, arg_max(close, date) AS base FROM p WHERE close IS NOT NULL GROUP BY ALL) e ON e.s2 = p.symbol AND e.y = year(p.date)"))
_add("f17_latest_beta", lambda p, b: f.latest_beta(p, b), q.select(
    {"beta": "CASE WHEN count(*) >= 40 THEN covar_samp(r1, b1) / var_samp(b1) END"},
    "(SELECT symbol, r1, b1, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM p JOIN bench USING (date) WHERE r1 IS NOT NULL AND b1 IS NOT NULL)", "symbol, count(*) AS pairs", tail="WHERE k <= 60 GROUP BY symbol"))
_M = f"(SELECT symbol, date, close, {q.ret(1)} AS change, volume / ({q.roll('avg', 'volume', 20)}) AS vr, close > {q.roll('avg', 'close', 20)} AS a20, close > {q.roll('avg', 'close', 50)} AS a50 FROM p)"
_add("f18_latest_metrics", lambda p, b: f.latest_metrics(p).selectExpr("symbol", "date", "coalesce(above_20, false) as above_20", "coalesce(above_50, false) as above_50", "size(closes) as n_closes", "close", "change", "volume_ratio", "closes[0] as first_close"), q.select(
    {"close": "max(close) FILTER (k = 1)", "change": "max(change) FILTER (k = 1)", "volume_ratio": "max(vr) FILTER (k = 1)", "first_close": "arg_min(close, date)"},
    f"(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM {_M} WHERE close IS NOT NULL)",
    "symbol, CAST(max(date) AS VARCHAR) AS date, coalesce(bool_or(a20) FILTER (k = 1), false) AS above_20, coalesce(bool_or(a50) FILTER (k = 1), false) AS above_50, count(*)::INTEGER AS n_closes", tail="WHERE k <= 36 GROUP BY symbol"))
_add("f19_prior_high", lambda p, b: f.prior_high(p), q.select({f"prior_high_{k}": f"max(close) OVER {q.over(k)}" for k in (5, 10, 20)}, "p"))


def _macro(spark, sf):
    p = t.sector_bars(spark, sf).selectExpr("sector as series_id", "date", "etf_close as value")
    return rounded(f.macro_features(p, ["AFRICA", "ASIA", "EUROPE"]))


QUERIES["f12_macro_features"] = _macro
_L = ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in (f"{s}_{k}" for s in ("AFRICA", "ASIA", "EUROPE") for k in ("level", "chg_1", "chg_5")))
_P = ", ".join(f"max({x}) FILTER (sector = '{s}') AS {s}_{k}" for s in ("AFRICA", "ASIA", "EUROPE") for k, x in (("level", "etf_close"), ("chg_1", "c1"), ("chg_5", "c5")))
SQL["f12_macro_features"] = f"""WITH {q.BARS}, {q.ETF},
m AS (SELECT *, etf_close - lag(etf_close) OVER w AS c1, etf_close - lag(etf_close, 5) OVER w AS c5 FROM etf WINDOW w AS (PARTITION BY sector ORDER BY date)),
x AS (SELECT date, {_P} FROM m GROUP BY date), y AS (SELECT date, {_L} FROM x WINDOW w AS (ORDER BY date))
SELECT CAST(date AS VARCHAR) AS date, {', '.join(f'round({s}_{k}, 6) AS {s}_{k}' for s in ('AFRICA', 'ASIA', 'EUROPE') for k in ('level', 'chg_1', 'chg_5'))} FROM y"""
