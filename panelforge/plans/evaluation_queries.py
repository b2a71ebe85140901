"""Queries of the activation backtest and the bootstrap (B11, B18) and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from panelforge.functions.semantics import rounded
from panelforge.operators import activation as ac
from panelforge.operators import backtest as b
from panelforge.operators import joins as j
from panelforge.plans.panel_queries import base, predictions
from panelforge.plans.sqlparts import FULL, r
from panelforge.sources import tables as t

QUERIES, SQL = {}, {}


def add(name, run, sql):
    QUERIES[name] = lambda s, d: rounded(run(s, d))
    SQL[name] = f"{FULL}{sql}"


SETUPS = {"broad": "vs_sma20 < 0 or vs_sma50 < 0", "strict": "vs_sma20 < 0 and vs_sma50 < 0 and r20 < 0 and r60 < 0", "oversold": "vs_sma20 < 0 and vs_sma50 < 0 and r20 < 0 and r60 < 0 and r5 < -0.05"}


def _b11(s, d):
    df = base(s, d).where("close is not null")
    frame = j.asof(df.select("symbol", "sector", "date", "close"), t.sector_bars(s, d), "sector", "date", "date", ["etf_close"]).select("symbol", "date", "close", F.col("etf_close").alias("sector_close"), F.col("seen").alias("sector_date"))
    top = b.ranked(base(s, d).where("r20 is not null").withColumn("score", -F.col("r20"))).where("place <= ceil(n * 0.2)")
    parts = [top.where(f"close is not null and ({c})").select(F.lit(n).alias("setup"), "symbol", "date", "vol20", "vs_sma20") for n, c in SETUPS.items()]
    return ac.activation_report(frame, reduce(lambda x, y: x.unionByName(y), parts))


_CASES = " UNION ALL ".join(f"SELECT '{n}' AS setup, symbol, date FROM tp WHERE close IS NOT NULL AND ({c})" for n, c in SETUPS.items())
_RULES = ", ".join([f"('vol_{m:g}', {w}, {m}::DOUBLE)" for w in ac.WINDOWS for m in ac.MULTIPLES] + [f"('{n}', {w}, NULL)" for n, w in ac.COMPARISONS])
add("b11_activation_report", _b11, f""", tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY r20, symbol) AS place, count(*) OVER (PARTITION BY date) AS n FROM feat WHERE r20 IS NOT NULL) WHERE place <= ceil(n * 0.2)),
fr AS (SELECT symbol, date, close, vol20, vs_sma20, etf_close AS e, row_number() OVER w AS rn, max(close) OVER (w ROWS 4 PRECEDING) AS h5, max(close) OVER (w ROWS 9 PRECEDING) AS h10 FROM feat LEFT JOIN etf USING (sector, date) WHERE close IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date)),
ca AS (SELECT setup, fr.* FROM ({_CASES}) JOIN fr USING (symbol, date)), ru AS (SELECT * FROM (VALUES {_RULES}) AS v(rule, win, multiple)),
tg AS (SELECT setup, symbol, rn, close, rule, win, multiple, CASE WHEN multiple IS NOT NULL AND vol20 > 0 THEN close * (1 + multiple * vol20) WHEN rule = 'prior_close_high_5' THEN h5 WHEN rule = 'prior_close_high_10' THEN h10 WHEN rule = 'sma20' AND vs_sma20 > -1 THEN close / (1 + vs_sma20) END AS trigger FROM ca CROSS JOIN ru),
hi AS (SELECT tg.setup, tg.symbol, tg.rn, rule, win, min(x.rn) AS at_rn FROM tg JOIN fr x ON x.symbol = tg.symbol AND x.rn BETWEEN tg.rn + 1 AND tg.rn + win AND x.close >= trigger GROUP BY ALL),
oc AS (SELECT tg.*, z.close / y.close - 1 - coalesce(z.e / y.e - 1, 0) - 0.0015 AS o FROM tg LEFT JOIN hi USING (setup, symbol, rn, rule, win) LEFT JOIN fr y ON y.symbol = tg.symbol AND y.rn = at_rn LEFT JOIN fr z ON z.symbol = tg.symbol AND z.rn = at_rn + 14
 UNION ALL SELECT setup, ca.symbol, ca.rn, ca.close, 'buy_immediately', 0, NULL, ca.close, z.close / ca.close - 1 - coalesce(z.e / ca.e - 1, 0) - 0.0015 FROM ca LEFT JOIN fr z ON z.symbol = ca.symbol AND z.rn = ca.rn + 14)
SELECT setup, rule, win AS "window", multiple, count(o) AS n, {r('avg(o)', 'mean')}, {r('median(o)', 'median')}, {r('avg(CAST(o > 0 AS INTEGER))', 'hit')}, {r('quantile_cont(o, 0.25)', 'p25')}, {r('quantile_cont(o, 0.75)', 'p75')},
 {r('CASE WHEN win = 0 THEN 1.0 ELSE count(o) / count(*) END', 'coverage')}, {r('avg(trigger / close - 1)', 'average_trigger')} FROM oc GROUP BY setup, rule, win, multiple""")

# bootstrap: the same draws in SQL
BLOCK = 15


def draws(rep: str, k: str, seed: int = 42) -> str:
    x = f"(CAST({rep} AS BIGINT) * 1103515245 + CAST({k} AS BIGINT) * 12345701 + {seed}) % 2147483647"
    steps = f"SELECT *, {x} AS x0 FROM {{0}}"
    for i in range(4):
        steps = f"SELECT *, ((x{i} * x{i}) % 2147483647 + x{i} * 48271 + {i + 1}) % 2147483647 AS x{i + 1} FROM ({steps})"
    return steps


ORDERED = ", bd AS (SELECT {0} AS x, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM {1} WHERE {0} IS NOT NULL)"
IID = f""", rk0 AS (SELECT rep, k, n FROM (SELECT unnest(range(2000)) AS rep) CROSS JOIN (SELECT i AS k, n FROM bd)), dr AS ({draws('rep', 'k').format('rk0')}),
mn AS (SELECT rep, avg(x) AS m FROM dr JOIN bd ON bd.i = dr.x4 % dr.n GROUP BY rep)"""
BLOCKS = f""", rk0 AS (SELECT rep, k, n FROM (SELECT unnest(range(1000)) AS rep) CROSS JOIN (SELECT i AS k, n FROM bd WHERE i < ceil(n / {BLOCK}))), dr AS ({draws('rep', 'k').format('rk0')}),
el AS (SELECT rep, (x4 % n + o) % n AS i, n FROM dr CROSS JOIN (SELECT unnest(range({BLOCK})) AS o) WHERE k * {BLOCK} + o < n), mn AS (SELECT rep, avg(x) AS m FROM el JOIN bd USING (i) GROUP BY rep)"""
TAIL = f"{r('quantile_cont(m, 0.025)', 'low')}, {r('quantile_cont(m, 0.975)', 'high')}"
add("b18_bootstrap", lambda s, d: b.bootstrap_mean(b.daily_baskets(predictions(s, d)), "spread"), ORDERED.format("spread", "daily") + IID + f" SELECT CAST((SELECT max(n) FROM bd) AS INTEGER) AS n, {TAIL} FROM mn")
add("b18_block_bootstrap", lambda s, d: b.block_bootstrap_mean(b.daily_baskets(predictions(s, d)), "spread", BLOCK), ORDERED.format("spread", "daily") + BLOCKS + f" SELECT CAST((SELECT max(n) FROM bd) AS INTEGER) AS n, {TAIL} FROM mn")


def _paired(s, d):
    """Top less median basket, once on the whole calendar and once with every tenth date's control unknown."""
    daily = b.daily_baskets(predictions(s, d)).select("date", F.col("top_mean").alias("a"), F.col("bottom_mean").alias("b"))
    gapped = daily.withColumn("b", F.when(F.dayofmonth("date") % 10 != 1, F.col("b")))
    few = daily.where(F.col("date") < "1992-09-01")
    parts = [b.paired_interval(x, "a", "b", BLOCK).withColumn("calendar", F.lit(n)) for n, x in (("whole", daily), ("gapped", gapped), ("short", few))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


add("b18_paired_interval", _paired, ORDERED.format("top_mean - bottom_mean", "daily") + BLOCKS + f""" SELECT 'whole' AS calendar, 'ok' AS status, {r('(SELECT avg(x) FROM bd)', 'mean_difference')}, {TAIL}, (SELECT count(*) FROM bd) AS paired_dates, (SELECT count(*) FROM daily) AS total_dates FROM mn
 UNION ALL SELECT 'gapped', 'incomplete_calendar', {r('avg(top_mean - bottom_mean) FILTER (day(date) % 10 <> 1)', 'm')}, NULL, NULL, count(*) FILTER (day(date) % 10 <> 1), count(*) FROM daily
 UNION ALL SELECT 'short', CASE WHEN count(*) = 0 THEN 'no_common_cohorts' ELSE 'insufficient_blocks' END, {r('avg(top_mean - bottom_mean)', 'm')}, NULL, NULL, count(*), count(*) FROM daily WHERE date < DATE '1992-09-01'""")
