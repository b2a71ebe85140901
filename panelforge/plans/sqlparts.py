"""SQL texts that the oracles share: the panel's common table expressions and window helpers (DuckDB dialect)."""

from __future__ import annotations

LI = """li AS (SELECT n_name AS symbol, r_name AS sector, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l.*
 FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_AGG = """arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS open,
 max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
 CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume"""

BARS = f"{LI}, bars AS (SELECT symbol, sector, date, {_AGG} FROM li GROUP BY ALL)"
BENCH = f"""bench0 AS (SELECT date, {_AGG} FROM li GROUP BY ALL),
bench AS (SELECT date, close AS bench_close, volume AS bench_volume, close / lag(close) OVER (ORDER BY date) - 1 AS b1 FROM bench0)"""
ETF = f"etf AS (SELECT sector, date, close AS etf_close FROM (SELECT sector, date, {_AGG} FROM li GROUP BY ALL))"
DAYS = "days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS session_ix FROM (SELECT DISTINCT date FROM bars))"
PANEL = """span AS (SELECT symbol, sector, min(date) AS a, max(date) AS b FROM bars GROUP BY ALL),
panel AS (SELECT span.symbol, span.sector, days.date, CAST(days.session_ix AS INTEGER) AS session_ix, open, high, low, close, volume
 FROM span JOIN days ON days.date BETWEEN a AND b LEFT JOIN bars USING (symbol, date)),
p AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r1,
 close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d1, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM panel)"""
ALL = f"WITH {BARS}, {BENCH}, {ETF}, {DAYS}, {PANEL}"
S = "(PARTITION BY symbol ORDER BY date)"


def over(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"


def roll(f: str, x: str, n: int, need: str | None = None) -> str:
    return f"CASE WHEN count({need or x}) OVER {over(n)} = {n} THEN {f.format(x) if '{' in f else f'{f}({x})'} OVER {over(n)} END"


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER {S}"


def lead(x: str, k: int) -> str:
    return f"lead({x}, {k}) OVER {S}"


def ret(k: int) -> str:
    return f"close / {lag('close', k)} - 1"


def pct(x: str, by: str) -> str:
    """Average-tie percentile rank."""
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"
            f" / count({x}) OVER (PARTITION BY {by}) END")


def select(cols: dict[str, str], source: str, keys: str = "symbol, CAST(date AS VARCHAR) AS date", digits: int = 6, tail: str = "", head: str = ALL) -> str:
    """Rounded double columns after the keys."""
    body = ", ".join(f"round({x}, {digits}) + 0.0 AS {n}" for n, x in cols.items())
    return f"{head} SELECT {keys}, {body} FROM {source} {tail}"

FEAT = f"""feat AS (SELECT symbol, sector, date, session_ix, close, volume, r1, {ret(5)} AS r5, {ret(20)} AS r20, {ret(60)} AS r60,
 {roll('stddev_samp', 'r1', 20)} AS vol20, close / ({roll('avg', 'close', 20)}) - 1 AS vs_sma20, close / ({roll('avg', 'close', 50)}) - 1 AS vs_sma50,
 volume / ({roll('avg', 'volume', 20)}) AS volume_ratio, {lead('close', 15)} / {lead('close', 1)} - 1 AS outcome, {lead('close', 14)} / close - 1 AS same_close FROM p)"""
CONTEXT = """ctx AS (SELECT sector, date, etf_close / lag(etf_close, 20) OVER w - 1 AS sector_r20,
 CASE WHEN count(s1) OVER x = 20 THEN stddev_samp(s1) OVER x END AS sector_vol20, lead(etf_close, 15) OVER w / lead(etf_close, 1) OVER w - 1 AS sector_forward
 FROM (SELECT *, etf_close / lag(etf_close) OVER (PARTITION BY sector ORDER BY date) - 1 AS s1 FROM etf)
 WINDOW w AS (PARTITION BY sector ORDER BY date), x AS (PARTITION BY sector ORDER BY date ROWS 19 PRECEDING))"""
GRADE = "CASE WHEN {0} >= 0.9 THEN 4 WHEN {0} >= 0.8 THEN 3 WHEN {0} <= 0.1 THEN 0 WHEN {0} <= 0.2 THEN 1 ELSE 2 END"
PREDS = f"""sc AS (SELECT symbol, sector, date, session_ix, close, r20 AS score, -vol20 AS low_vol, r5 AS short, vol20, vs_sma20, outcome,
 CASE WHEN outcome IS NOT NULL THEN {GRADE.format('(' + pct('outcome', 'date') + ')')} END AS grade FROM feat),
kn AS (SELECT * FROM sc WHERE score IS NOT NULL AND outcome IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS place, count(*) OVER (PARTITION BY date) AS n FROM kn),
dc AS (SELECT *, CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ceil(least(n, 10) * (row_number() OVER (PARTITION BY date ORDER BY score, symbol) - 1) / (n - 1))) END AS INTEGER) AS decile FROM rk),
dy AS (SELECT date, max(n) AS n, avg(outcome) FILTER (place <= k) AS top_mean, median(outcome) FILTER (place <= k) AS top_median,
 avg(CAST(outcome > 0 AS INTEGER)) FILTER (place <= k) AS top_hit, avg(outcome) FILTER (place > n - k) AS bottom_mean, median(outcome) FILTER (place > n - k) AS bottom_median,
 avg(grade) FILTER (place <= k) AS top_grade FROM (SELECT *, greatest(1, ceil(n * 0.1)) AS k FROM rk) GROUP BY date),
daily AS (SELECT *, top_mean - bottom_mean AS spread, top_median - bottom_median AS spread_median FROM dy)"""
FULL = f"{ALL}, {FEAT}, {CONTEXT}, {PREDS}"
D = "CAST(date AS VARCHAR) AS date"


def r(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)
