"""Queries of the whole feature matrix (C1 to C6, L9, B3, B5) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.semantics import rounded
from panelforge.operators import backtest as b
from panelforge.operators import cross_section as c
from panelforge.operators import matrix as mx
from panelforge.operators import scorebook as k
from panelforge.operators import splits as v
from panelforge.plans.panel_queries import FW, predictions
from panelforge.plans.sqlparts import ALL, D, lag, lead, pct, r, ret, roll
from panelforge.sources import tables as t

QUERIES, SQL = {}, {}


def price(s, d):
    return mx.price_matrix(t.panel(s, d), t.benchmark(s, d))


def full(s, d):
    return mx.full_matrix(t.panel(s, d), t.benchmark(s, d), t.sector_bars(s, d))


def _series(source: str) -> str:
    gain = roll("avg", "CASE WHEN d1 > 0 THEN d1 WHEN d1 <= 0 THEN 0 END", 14)
    loss = roll("avg", "CASE WHEN d1 < 0 THEN -d1 WHEN d1 >= 0 THEN 0 END", 14)
    cols = {f"return_{k}d": ret(k) for k in (20, 60, 120)} | {f"momentum_{n}_{k}": f"{lag('close', k)} / {lag('close', n)} - 1" for n, k in ((126, 10), (252, 20))}
    cols |= {f"volatility_{n}d": roll("stddev_samp", "r1", n) for n in (20, 60)} | {f"price_vs_sma_{n}": f"close / ({roll('avg', 'close', n)}) - 1" for n in (50, 200)}
    body = ", ".join(f"{x} AS {n}" for n, x in cols.items())
    return f"SELECT * EXCLUDE (g, l), CASE WHEN l IS NULL THEN NULL WHEN l = 0 AND g > 0 THEN 100 WHEN l = 0 THEN 50 ELSE 100 - 100 / (1 + g / l) END AS rsi_14 FROM (SELECT *, {body}, {gain} AS g, {loss} AS l FROM {source})"


def _moved(key: str, close: str, table: str) -> str:
    x = f"(SELECT {key} AS symbol, date, {close} AS close FROM {table})"
    w = "(PARTITION BY symbol ORDER BY date)"
    return f"(SELECT *, close / lag(close) OVER {w} - 1 AS r1, close - lag(close) OVER {w} AS d1 FROM {x})"


_PAIR = "CASE WHEN r1 IS NOT NULL AND b1 IS NOT NULL THEN 1 END"
_DOWN = "CASE WHEN r1 < 0 THEN r1 WHEN r1 >= 0 THEN 0 END"
_OWN = {
    "reversal_5d": f"-({ret(5)})", "downside_20d": roll("stddev_samp", _DOWN, 20), "downside_60d": roll("stddev_samp", _DOWN, 60), "max_return_20d": roll("max", "r1", 20),
    "from_high_252d": f"close / ({roll('max', 'close', 252)}) - 1", "from_low_252d": f"close / ({roll('min', 'close', 252)}) - 1", "volume_ratio_20d": f"volume / ({roll('avg', 'volume', 20)})",
    "volume_ratio_60d": f"volume / ({roll('avg', 'volume', 60)})", "log_dollar_volume_20d": f"ln(1 + close * ({roll('avg', 'volume', 20)}))", "illiquidity_20d": roll("avg", "abs(r1) / (close * volume)", 20),
    "beta_60d": f"({roll('covar_samp({})', 'r1, b1', 60, _PAIR)}) / ({roll('var_samp', 'b1', 60)})",
}
_VS = ", ".join(f"x.{n} - b.{n} AS {n.replace('_14', '')}_vs_bench" for n in ("return_20d", "return_60d", "return_120d", "rsi_14", "volatility_20d", "volatility_60d"))
MATRIX = f"""{ALL}, own AS ({_series(f"(SELECT p.*, b1, {', '.join(f'{x} AS {n}' for n, x in _OWN.items())} FROM p LEFT JOIN bench USING (date))")}),
bx AS ({_series(_moved("'b'", "bench_close", "bench"))}), sx AS ({_series(_moved("sector", "etf_close", "etf"))}),
mx AS (SELECT x.*, x.return_20d / x.volatility_20d AS vol_adjusted_20d, x.return_60d / x.volatility_60d AS vol_adjusted_60d, {_VS},
 x.return_20d - x.beta_60d * b.return_20d AS idiosyncratic_20d, x.return_60d - x.beta_60d * b.return_60d AS idiosyncratic_60d FROM own x LEFT JOIN bx b USING (date))"""
_KNOWN = " + ".join(f"coalesce({x}, 0.0)" for x in mx.COMPOSITE)
_N = " + ".join(f"CAST({x} IS NOT NULL AS INTEGER)" for x in mx.COMPOSITE)
WHOLE = f"""{MATRIX}, rx AS (SELECT mx.*, {', '.join(f"{pct(x, 'date')} AS {x}_rank" for x in mx.RANKED)}, {', '.join(f"{pct(x, 'date, sector')} AS {x}_sector_rank" for x in mx.RANKED)},
 {', '.join(f"{x} - median({x}) OVER (PARTITION BY date, sector) AS {x}_minus_sector_median" for x in mx.CENTRED)} FROM mx),
fm AS (SELECT rx.*, s.momentum_252_20 AS sector_momentum_252_20, {', '.join(f"rx.{x} - s.{x} AS {x}_vs_sector" for x in mx.SERIES)},
 CASE WHEN {_N} > 0 THEN ({_KNOWN}) / ({_N}) END AS composite FROM rx LEFT JOIN sx s ON s.symbol = rx.sector AND s.date = rx.date)"""


def add(name, run, sql):
    QUERIES[name] = lambda s, d: rounded(run(s, d))
    SQL[name] = sql


K = f"symbol, {D}"
add("c1_date_rank", lambda s, d: mx.ranks(price(s, d)).select("symbol", "date", *[f"{x}_rank" for x in mx.RANKED]), f"{WHOLE} SELECT {K}, {', '.join(r(f'{x}_rank') for x in mx.RANKED)} FROM rx")
add("c2_sector_rank", lambda s, d: mx.ranks(price(s, d)).select("symbol", "date", *[f"{x}_sector_rank" for x in mx.RANKED]), f"{WHOLE} SELECT {K}, {', '.join(r(f'{x}_sector_rank') for x in mx.RANKED)} FROM rx")
add("c3_minus_sector_median", lambda s, d: mx.ranks(price(s, d), []).select("symbol", "date", *[f"{x}_minus_sector_median" for x in mx.CENTRED]), f"{WHOLE} SELECT {K}, {', '.join(r(f'{x}_minus_sector_median') for x in mx.CENTRED)} FROM rx")
add("c4_sector_spreads", lambda s, d: mx.sector_spreads(price(s, d), t.sector_bars(s, d)).select("symbol", "date", *[f"{x}_vs_sector" for x in mx.SERIES]), f"{WHOLE} SELECT {K}, {', '.join(r(f'{x}_vs_sector') for x in mx.SERIES)} FROM fm")
add("c5_composite", lambda s, d: mx.ranks(price(s, d), mx.RANKED, []).select("symbol", "date", c.mean_of_known(mx.COMPOSITE).alias("composite")), f"{WHOLE} SELECT {K}, {r('composite')} FROM fm")
_BENCH = ["return_20d_vs_bench", "return_60d_vs_bench", "return_120d_vs_bench", "rsi_vs_bench", "volatility_20d_vs_bench", "volatility_60d_vs_bench", "idiosyncratic_20d", "idiosyncratic_60d"]
add("c6_benchmark_relative", lambda s, d: price(s, d).select("symbol", "date", "beta_60d", *_BENCH), f"{MATRIX} SELECT {K}, {r('beta_60d')}, {', '.join(r(x) for x in _BENCH)} FROM mx")


def _l9(s, d):
    df = full(s, d)
    df = df.select("symbol", "date", mx.candidate(df).alias("candidate"))
    df = df.join(c.forward_next_close(t.panel(s, d)), ["symbol", "date"]).join(c.worst_path(t.panel(s, d)), ["symbol", "date"])
    meta = c.meta_label(F.col("candidate"), F.col("forward_return"), F.col("worst_path"))
    return df.select("symbol", "date", F.col("candidate").cast("int").alias("candidate"), F.coalesce(meta, F.lit(-1)).alias("meta"))


add("l9_candidate_setup", _l9, f"""{WHOLE}, fw AS (SELECT symbol, date, {lead('close', 15)} / {lead('close', 1)} - 1 AS outcome, min(close) OVER {FW} / {lead('close', 1)} - 1 AS wp FROM p),
cd AS (SELECT symbol, date, outcome, wp, coalesce(composite >= 0.75 AND return_60d_minus_sector_median > 0 AND return_60d_sector_rank >= 0.7 AND momentum_126_10_sector_rank >= 0.65 AND price_vs_sma_50 > 0 AND price_vs_sma_200 > 0 AND rsi_14 <= 78 AND volume_ratio_20d >= 0.7, false) AS cand FROM fm JOIN fw USING (symbol, date))
SELECT {K}, CAST(cand AS INTEGER) AS candidate, CASE WHEN cand THEN CAST(coalesce(outcome > 0 AND wp > -0.3, false) AS INTEGER) ELSE -1 END AS meta FROM cd""")
_SEVEN = {
    "low_volatility": "1 - volatility_60d_rank", "liquidity_quality": "(log_dollar_volume_20d_rank + (1 - illiquidity_20d_rank) + (1 - volatility_60d_rank) + (1 - volatility_60d_vs_bench_rank)) / 4",
    "twelve_one_momentum": "momentum_252_20_rank", "sector_relative_momentum": "(momentum_252_20_sector_rank + m1 + m2) / 3", "risk_adjusted_momentum": "(momentum_252_20_rank + vol_adjusted_60d_rank + (1 - volatility_60d_rank)) / 3",
    "technical_composite": "m4", "sector_momentum": "m3",
}
add("b3_baseline_scores", lambda s, d: mx.baseline_scores(full(s, d)), f"""{WHOLE}, ms AS (SELECT *, {pct('momentum_252_20_vs_sector', 'date')} AS m1, {pct('momentum_252_20_minus_sector_median', 'date')} AS m2, {pct('sector_momentum_252_20', 'date')} AS m3, {pct('composite', 'date')} AS m4 FROM fm),
bs AS (SELECT symbol, date, {', '.join(f'{x} AS {n}' for n, x in _SEVEN.items())} FROM ms) SELECT {K}, {', '.join(r(n) for n in _SEVEN)}, {', '.join(r(pct(n, 'date'), n + '_percentile') for n in _SEVEN)} FROM bs""")
#: Score of each strategy of the grid; the model's score and its inverse come first.
SPECS = {
    "rank_model": "score", "rank_model_inverse": "-score", "momentum_60d": "return_60d", "momentum_20d": "return_20d", "momentum_120d": "return_120d", "momentum_126_10": "momentum_126_10", "momentum_252_20": "momentum_252_20",
    "risk_adjusted_60d": "vol_adjusted_60d", "relative_60d_bench": "return_60d_vs_bench", "idiosyncratic_60d": "idiosyncratic_60d", "sector_rank_60d": "return_60d_sector_rank", "sector_rank_120d": "return_120d_sector_rank",
    "sector_rank_skip": "momentum_126_10_sector_rank", "sector_spread_60d": "return_60d_minus_sector_median", "relative_60d_sector": "return_60d_vs_sector", "technical_composite": "composite",
}
COST = 0.0015


def _b5(s, d):
    p = predictions(s, d).select("symbol", "date", "score", "outcome", "grade")
    df = full(s, d).join(p, ["symbol", "date"]).select("symbol", "date", "sector", "outcome", "grade", *[F.expr(x).alias(f"s_{n}") for n, x in SPECS.items()])
    daily = b.strategy_baskets(df, [f"s_{n}" for n in SPECS])
    return daily.groupBy(F.substring("strategy", 3, 99).alias("strategy")).agg(F.count(F.lit(1)).alias("dates"), F.avg("top_mean").alias("top_mean"), F.avg(F.col("top_mean") - COST).alias("top_after_cost"), F.avg("bottom_mean").alias("bottom_mean"), F.avg("spread").alias("spread"), F.avg("top_hit").alias("top_hit"))


add("b5_inverse_baskets", _b5, f"""{WHOLE}, sc AS (SELECT symbol, date, {ret(20)} AS score, {lead('close', 15)} / {lead('close', 1)} - 1 AS outcome FROM p),
lg AS (UNPIVOT (SELECT fm.symbol, fm.date, outcome, {', '.join(f'({x})::DOUBLE AS {n}' for n, x in {k: (v if v in ('score', '-score') else 'fm.' + v) for k, v in SPECS.items()}.items())} FROM fm JOIN sc ON sc.symbol = fm.symbol AND sc.date = fm.date) ON {', '.join(SPECS)} INTO NAME strategy VALUE v),
lr AS (SELECT *, row_number() OVER (PARTITION BY strategy, date ORDER BY v DESC, symbol) AS place, count(*) OVER (PARTITION BY strategy, date) AS n FROM lg WHERE v IS NOT NULL AND outcome IS NOT NULL),
dz AS (SELECT strategy, date, avg(outcome) FILTER (place <= greatest(1, ceil(n * 0.1))) AS tm, avg(outcome) FILTER (place > n - greatest(1, ceil(n * 0.1))) AS bm, avg(CAST(outcome > 0 AS INTEGER)) FILTER (place <= greatest(1, ceil(n * 0.1))) AS th FROM lr GROUP BY ALL)
SELECT strategy, count(*) AS dates, {r('avg(tm)', 'top_mean')}, {r(f'avg(tm - {COST})', 'top_after_cost')}, {r('avg(bm)', 'bottom_mean')}, {r('avg(tm - bm)', 'spread')}, {r('avg(th)', 'top_hit')} FROM dz GROUP BY strategy""")


def _first4(*items: tuple[str, str]) -> str:
    return "array_to_string(list_slice(list_filter([" + ", ".join(f"CASE WHEN {a} THEN '{b}' END" for a, b in items) + "], lambda x: x IS NOT NULL), 1, 4), '|')"


_REASONS = _first4(("volatility_60d_minus_sector_median < 0", "Lower 60d volatility than sector median"), ("momentum_252_20_minus_sector_median > 0", "Long-horizon momentum ahead of sector median"), ("return_120d_sector_rank >= 0.7", "Top-sector 120d return rank"), ("price_vs_sma_200 > 0", "Above 200d trend"), ("from_high_252d > -0.08", "Within 8% of 52w high"), ("log_dollar_volume_20d_rank >= 0.7", "Liquid versus universe"))
_RISKS = _first4(("rsi_14 > 76", "RSI extended"), ("volatility_60d_minus_sector_median > 0", "Above-sector volatility"), ("price_vs_sma_50 < 0", "Below 50d trend"), ("price_vs_sma_200 < 0", "Below 200d trend"), ("volume_ratio_20d < 0.7", "Weak volume confirmation"))
add("k2_tags", lambda s, d: full(s, d).select("symbol", "date", F.array_join(k.reason_tags(), "|").alias("reasons"), F.array_join(k.risk_flags(), "|").alias("risks")), f"{WHOLE} SELECT {K}, {_REASONS} AS reasons, {_RISKS} AS risks FROM fm")


def _b2(s, d):
    """The model's score and the seven baselines by day, month, quarter and year."""
    p = predictions(s, d).select("symbol", "date", "sector", "outcome", "grade", F.col("score").alias("rank_model"))
    df = p.join(mx.baseline_scores(full(s, d)).select("symbol", "date", *_SEVEN), ["symbol", "date"])
    bars = t.bars(s, d)
    cohorts = {"daily": bars.select("date").distinct()} | {c_: v.sampled_dates(bars, c_) for c_ in ("month", "quarter", "year")}
    return b.cohort_summary(df, ["rank_model", *_SEVEN], cohorts)


add("b2_cohorts", _b2, f"""{WHOLE}, ms AS (SELECT *, {pct('momentum_252_20_vs_sector', 'date')} AS m1, {pct('momentum_252_20_minus_sector_median', 'date')} AS m2, {pct('sector_momentum_252_20', 'date')} AS m3, {pct('composite', 'date')} AS m4 FROM fm),
sc AS (SELECT symbol, date, {ret(20)} AS score, {lead('close', 15)} / {lead('close', 1)} - 1 AS outcome FROM p),
lg AS (UNPIVOT (SELECT ms.symbol, ms.date, outcome, score AS rank_model, {', '.join(f'({x})::DOUBLE AS {n}' for n, x in _SEVEN.items())} FROM ms JOIN sc ON sc.symbol = ms.symbol AND sc.date = ms.date) ON rank_model, {', '.join(_SEVEN)} INTO NAME strategy VALUE v),
lr AS (SELECT *, row_number() OVER (PARTITION BY strategy, date ORDER BY v DESC, symbol) AS place, count(*) OVER (PARTITION BY strategy, date) AS n FROM lg WHERE v IS NOT NULL AND outcome IS NOT NULL),
dz AS (SELECT strategy, date, avg(outcome) FILTER (place <= greatest(1, ceil(n * 0.1))) AS tm, avg(outcome) FILTER (place > n - greatest(1, ceil(n * 0.1))) AS bm, avg(CAST(outcome > 0 AS INTEGER)) FILTER (place <= greatest(1, ceil(n * 0.1))) AS th FROM lr GROUP BY ALL),
co AS (SELECT DISTINCT 'daily' AS cohort, date FROM bars UNION ALL SELECT 'month', min(date) FROM bars GROUP BY date_trunc('month', date) UNION ALL SELECT 'quarter', min(date) FROM bars GROUP BY date_trunc('quarter', date) UNION ALL SELECT 'year', min(date) FROM bars GROUP BY date_trunc('year', date))
SELECT cohort, strategy, count(*) AS dates, {r('avg(tm)', 'top_mean')}, {r('avg(bm)', 'bottom_mean')}, {r('avg(tm - bm)', 'spread')}, {r('avg(th)', 'top_hit')} FROM dz JOIN co USING (date) GROUP BY cohort, strategy""")
