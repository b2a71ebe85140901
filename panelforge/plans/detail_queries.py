"""Queries over a cross-section with a symbol a part, of probabilities, reviewed dividends, series, the published contract and trends (B13, D11, H4, J3, H17, K3, K5, K11, K13, L8, P6) and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions import scalars as x
from panelforge.functions.semantics import rounded
from panelforge.operators import backtest as b
from panelforge.operators import cross_section as c
from panelforge.operators import features as f
from panelforge.operators import history as h
from panelforge.operators import quality as qa
from panelforge.operators import scorebook as k
from panelforge.plans.lifecycle_queries import archive
from panelforge.plans.panel_queries import base, predictions
from panelforge.plans.sqlparts import D, FULL, r, roll
from panelforge.sources import tables as t

QUERIES, SQL = {}, {}


def add(name, run, sql, head=FULL):
    QUERIES[name] = lambda s, d: rounded(run(s, d))
    SQL[name] = f"{head}{sql}"


def parts(s, d):
    """(date, symbol, sector, rank): every part's place by the month's revenue, brands as sectors, some unknown."""
    li = t.table(s, d, "lineitem", ["l_partkey", "l_extendedprice", "l_shipdate"]).groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"), "l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("revenue"))
    p = t.table(s, d, "part", ["p_partkey", "p_brand"])
    df = li.join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("revenue"), "p_partkey")))
    return df.select("date", F.format_string("P%09d", "p_partkey").alias("symbol"), F.when(F.col("p_partkey") % 50 != 0, F.col("p_brand")).alias("sector"), "rank")


PARTS = """WITH pr AS (SELECT date, format('P{:09d}', p_partkey) AS symbol, CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS sector, row_number() OVER (PARTITION BY date ORDER BY revenue DESC, p_partkey) AS rank
 FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_partkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue FROM lineitem GROUP BY ALL) JOIN part ON l_partkey = p_partkey),
pp AS (SELECT date, symbol, coalesce(sector, 'Unknown') AS sector, rank, row_number() OVER (PARTITION BY date ORDER BY rank DESC, symbol) AS place, count(*) OVER (PARTITION BY date) AS n FROM pr),
pg AS (SELECT date, sector, n, least(greatest(25, ceil(n * 0.15)), n) AS size, count(*) FILTER (place <= greatest(25, ceil(n * 0.15))) AS c, count(*) AS u, array_to_string(list_slice(list(symbol ORDER BY place) FILTER (place <= greatest(25, ceil(n * 0.15))), 1, 4), ',') AS ex FROM pp GROUP BY date, sector, n),
ph AS (SELECT *, round((c / size * 100) / (u / n * 100), 2) AS ratio FROM pg)"""
add("k13_bottom_sectors", lambda s, d: k.bottom_sectors(parts(s, d)).withColumn("examples", F.array_join("examples", ",")),
    f""" SELECT {D}, sector, c AS count, u AS universe, {r('round(c / size * 100, 1)', 'bottom_share')}, {r('round(u / n * 100, 1)', 'universe_share')}, {r('ratio')}, ex AS examples FROM ph WHERE c >= 3 AND ratio >= 1 QUALIFY row_number() OVER (PARTITION BY date ORDER BY ratio DESC, c DESC, sector) <= 4""", PARTS)
add("k13_bottom_candidates", lambda s, d: k.bottom_candidates(parts(s, d)).select("date", "symbol", "rank", "place"), f" SELECT {D}, symbol, CAST(rank AS INTEGER) AS rank, CAST(place AS INTEGER) AS place FROM pp WHERE place <= 12", PARTS)


def _k5(s, d):
    """Inference over 80 returns each; symbols that traded on odd days of the month only have too few pairs."""
    ret = F.col("etf_close") / F.lag("etf_close").over(Window.partitionBy("sector").orderBy("date")) - 1
    rows = base(s, d).where("cast(substring(symbol, 8) as int) % 6 != 5 or day(date) % 4 = 1").select("symbol", "date", "r1")
    return k.infer_sectors(rows, t.sector_bars(s, d).select("sector", "date", ret.alias("s1")), 60, 80)


add("k5_inferred_sectors", _k5, f""", ra AS (SELECT symbol, date, r1 FROM feat WHERE (CAST(substring(symbol, 8) AS INTEGER) % 6 <> 5 OR day(date) % 4 = 1)), rb AS (SELECT symbol, date, r1 FROM ra WHERE r1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 80),
rc AS (SELECT sector, date, s1 FROM (SELECT sector, date, etf_close / lag(etf_close) OVER (PARTITION BY sector ORDER BY date) - 1 AS s1 FROM etf) WHERE s1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sector ORDER BY date DESC) <= 80),
rd AS (SELECT symbol, sector, count(*) AS n, corr(r1, s1) AS c FROM rb JOIN rc USING (date) GROUP BY ALL HAVING count(*) >= 60), re AS (SELECT symbol, arg_max(sector, c) AS sector, max(c) AS c, arg_max(n, c) AS n FROM rd WHERE isfinite(c) GROUP BY symbol)
SELECT symbol, coalesce(sector, 'Information Technology') AS sector, CASE WHEN sector IS NULL THEN 'fallback' ELSE 'return_correlation' END AS source, {r('round(c, 4)', 'correlation')}, coalesce(n, 0) AS observations FROM (SELECT DISTINCT symbol FROM ra) LEFT JOIN re USING (symbol)""")


def _b13(s, d):
    p = predictions(s, d)
    return b.probability_metrics(p.select("sector", "date", "symbol", (1 / (1 + F.exp(-4 * F.col("score")))).alias("probability"), "outcome", (F.col("outcome") > 0).cast("int").alias("label")), ["sector"])


add("b13_probability_metrics", _b13, f""", pb AS (SELECT sector, date, symbol, outcome AS o, CAST(outcome > 0 AS INTEGER) AS y, 1 / (1 + exp(-4 * score)) AS p FROM kn),
pc AS (SELECT *, greatest(least(p, 1 - 1e-6), 1e-6) AS q, row_number() OVER (PARTITION BY sector, date ORDER BY p DESC, symbol) AS place, count(*) OVER (PARTITION BY sector, date) AS n, row_number() OVER (PARTITION BY sector ORDER BY p DESC, date, symbol) AS g, count(*) OVER (PARTITION BY sector) AS m FROM pb),
pd AS (SELECT sector, date, avg(o) FILTER (place <= greatest(1, ceil(n * 0.1))) AS t, avg(y) FILTER (place <= greatest(1, ceil(n * 0.1))) AS h, avg(o) FILTER (place > n - greatest(1, ceil(n * 0.1))) AS b FROM pc GROUP BY ALL),
pe AS (SELECT sector, avg(t) AS tt, avg(h) AS hh, avg(b) AS bb, avg(t - b) AS ss FROM pd GROUP BY sector)
SELECT sector, count(*) AS rows, {r('avg(-(y * ln(q) + (1 - y) * ln(1 - q)))', 'log_loss')}, {r('avg(CAST(CAST(p >= 0.5 AS INTEGER) = y AS INTEGER))', 'accuracy')}, {r('avg(y)', 'positive_rate')}, {r('avg(o)', 'mean_outcome')}, {r('corr(p, o)', 'outcome_correlation')}, {r('corr(p, y)', 'label_correlation')},
 {r('any_value(tt)', 'top')}, {r('any_value(hh)', 'top_hit')}, {r('any_value(bb)', 'bottom')}, {r('any_value(ss)', 'spread')}, {r('avg(o) FILTER (g <= greatest(1, floor(m * 0.1)))', 'global_top')}, {r('avg(o) FILTER (g <= greatest(1, floor(m * 0.2)))', 'global_fifth')} FROM pc JOIN pe USING (sector) GROUP BY sector""")


def _h4(s, d):
    """Dividends reviewed on every 41st session; some without evidence, some whose archive value has changed."""
    n, day = F.substring("symbol", 8, 9).cast("int"), F.dayofyear("date")
    bars = archive(s, d).withColumn("dividends", F.when(day % 5 == 0, F.lit(1.5)).otherwise(0.0))
    url = F.when(day % 7 == 3, "http://old").otherwise("https://issuer")
    records = bars.where("no_trade").select("symbol", "date", (n + 10.0).alias("cash"), F.when(day % 10 == 0, F.lit(2.0)).when(day % 5 == 0, F.lit(1.5)).otherwise(0.0).alias("expected"), url.alias("source_url"))
    return bars, h.reviewed_corrections(bars, records)


_ARC = """, ar AS (SELECT symbol, date, close, close * (session_ix * 0.0001 + 0.9) AS adj, CASE WHEN session_ix % 97 = 50 THEN 2.0 END AS sp, CASE WHEN (session_ix + n) % 37 = 0 THEN 'c' WHEN n % 2 = 1 THEN 'yahoo' ELSE 'a' END AS source, (session_ix + n) % 41 = 0 AS reviewed, CASE WHEN dayofyear(date) % 5 = 0 THEN 1.5 ELSE 0 END AS dv, n, dayofyear(date) AS dy
 FROM (SELECT *, CAST(substring(symbol, 8) AS INTEGER) AS n FROM p) WHERE close IS NOT NULL AND (n % 3 <> 0 OR session_ix <= 250)),
aw AS (SELECT *, lag(close) OVER w AS c0, lag(adj) OVER w AS a0, (n + 10.0::DOUBLE) / coalesce(product(sp) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS value FROM ar WINDOW w AS (PARTITION BY symbol ORDER BY date)),
ax AS (SELECT *, (adj / a0) / ((close + value) / c0) AS factor, CASE WHEN NOT reviewed THEN NULL WHEN dy % 7 = 3 THEN 'no_evidence' WHEN source <> 'yahoo' THEN 'no_single_bar' WHEN c0 IS NULL OR dy % 10 = 0 THEN 'precondition_changed' ELSE 'applied' END AS status FROM aw)"""
add("h4_reviewed_dividends", lambda s, d: _h4(s, d)[1].select("symbol", "date", "value", "factor", "status"), f"{_ARC} SELECT symbol, {D}, {r('value')}, {r('factor')}, status FROM ax WHERE reviewed")
add("h4_corrected_prices", lambda s, d: h.correct_adjusted(*_h4(s, d)).select("symbol", "date", (F.col("adj_close") / F.col("close")).alias("scale"), "dividends"),
    f"{_ARC} SELECT symbol, {D}, {r('adj / close * coalesce(product(CASE WHEN status = $$applied$$ THEN factor END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1)', 'scale')}, {r('CASE WHEN status = $$applied$$ THEN value ELSE dv END', 'dividends')} FROM ax")
SECTORS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
add("j3_all_series", lambda s, d: t.sector_bars(s, d).groupBy("date").pivot("sector", SECTORS).agg(F.first("etf_close")), f" SELECT {D}, " + ", ".join(r(f"max(etf_close) FILTER (sector = '{n}')", f'"{n}"') for n in SECTORS) + " FROM etf GROUP BY date")


def _l8(s, d):
    w = Window.orderBy("date")  # a row a day
    bench = t.benchmark(s, d).select("date", (F.lead("bench_close", 15).over(w) / F.lead("bench_close", 1).over(w) - 1).alias("bench_outcome"))
    return c.outperform_label(predictions(s, d).join(bench, "date"), "outcome", "bench_outcome").select("symbol", "date", "excess", "outperform")


add("l8_outperform", _l8, f" SELECT symbol, CAST(sc.date AS VARCHAR) AS date, {r('outcome - bo', 'excess')}, CAST(outcome > bo AS INTEGER) AS outperform FROM sc JOIN (SELECT date, lead(bench_close, 15) OVER w / lead(bench_close, 1) OVER w - 1 AS bo FROM bench WINDOW w AS (ORDER BY date)) USING (date)")
add("p6_latest_deltas", lambda s, d: x.latest_deltas(t.table(s, d, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"]).select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("NaN").cast("double")).when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("value"), F.when(F.col("o_custkey") % 3 == 0, "bps").when(F.col("o_custkey") % 3 == 1, "pct").otherwise("pp").alias("kind")), "o_custkey", "at", "value", "kind"),
    f"""WITH v AS (SELECT o_custkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0),
 w AS (SELECT o_custkey, max(x) FILTER (n = 1) AS latest, max(x) FILTER (n = 2) AS previous FROM v GROUP BY o_custkey)
SELECT o_custkey, {r('latest')}, {r('previous')}, {r('CASE o_custkey % 3 WHEN 0 THEN (latest - previous) * 100 WHEN 1 THEN (latest / previous - 1) * 100 ELSE latest - previous END', 'delta')} FROM w""", "")


def _d11(s, d):
    """A scorebook of every part and month with some rows that break each rule, its research table and its published decile."""
    n = F.substring("symbol", 2, 9).cast("int")
    df = parts(s, d).select("date", "symbol", n.alias("p"), F.when(n % 211 != 0, F.col("rank")).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("date")).alias("n"))
    setup = F.when(n % 4 == 0, "model_rebound_watch").when(n % 4 == 1, "momentum_confirmed").when(n % 4 == 2, "model_ranked_not_momentum_confirmed").otherwise("none")
    book = df.select("date", "symbol", "rank", setup.alias("setup_type"), F.when(n % 37 != 0, F.col("p") * 0.5).alias("stop_price"),
                     F.when(((n % 4 == 0) & (n % 29 != 0)) | (n % 101 == 0), F.col("p") * 0.75).alias("activation_price"), F.when(n % 19 != 0, F.col("p") * 0.25).alias("beta"), F.col("p").cast("double").alias("return30"))
    research = df.where("p % 3 != 0").select("date", "symbol", F.when(n % 19 != 0, F.col("p") * 0.25 + (n % 97 == 0).cast("int")).alias("beta"), F.when(n % 83 != 0, F.col("p").cast("double")).alias("return30"))
    decile = df.where("p % 53 != 0 and rank <= ceil(n * 0.1) or p % 89 = 0").select("date", "symbol")
    return qa.contract_violations(book, research, decile, ["beta", "return30"])


add("d11_contract", _d11, f"""{PARTS},
cb AS (SELECT date, symbol, CAST(substring(symbol, 2) AS INTEGER) AS p, CASE WHEN CAST(substring(symbol, 2) AS INTEGER) % 211 <> 0 THEN rank END AS rank, count(*) OVER (PARTITION BY date) AS n FROM pr),
cc AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY rank NULLS LAST, symbol) AS place, coalesce(rank <= ceil(n * 0.1), FALSE) AS top FROM cb),
cv AS (SELECT date, symbol, 'rank_missing' AS rule FROM cc WHERE rank IS NULL UNION ALL SELECT date, symbol, 'rank_sequence' FROM cc WHERE rank <> place
 UNION ALL SELECT date, symbol, 'stop_missing' FROM cc WHERE (p % 4 < 3 OR top) AND p % 37 = 0
 UNION ALL SELECT date, symbol, 'activation_missing' FROM cc WHERE p % 4 = 0 AND p % 29 = 0 AND p % 101 <> 0 UNION ALL SELECT date, symbol, 'activation_extra' FROM cc WHERE p % 4 <> 0 AND p % 101 = 0
 UNION ALL SELECT date, symbol, 'decile_missing' FROM cc WHERE top AND p % 53 = 0 AND p % 89 <> 0 UNION ALL SELECT date, symbol, 'decile_extra' FROM cc WHERE NOT top AND p % 89 = 0
 UNION ALL SELECT date, symbol, 'metric_mismatch' FROM cc WHERE p % 3 <> 0 AND ((p % 97 = 0 AND p % 19 <> 0) OR p % 83 = 0))
SELECT {D}, rule, symbol FROM cv""", "")


def _k11(s, d):
    n, size = F.substring("symbol", 2, 9).cast("int"), F.count(F.lit(1)).over(Window.partitionBy("date"))
    df = parts(s, d).withColumns({"p": n, "n": size})
    percentile = F.when(F.col("n") > 1, 100 * (1 - (F.col("rank") - 1) / (F.col("n") - 1))).otherwise(100.0)
    # every third month has no percentile from 90
    percentile = F.when(F.month("date") % 3 == 0, percentile * 0.875).otherwise(percentile)
    label = F.when(n % 5 == 0, "Both Models Agree").when(n % 5 == 1, "1Y Strong + Tactical Momentum").when(n % 5 == 2, "1Y Strong / Tactical Weak")
    return df.select("date", "symbol", "rank", "sector", percentile.alias("percentile"), F.when(n % 7 != 0, (n % 100).cast("double")).alias("tactical"), F.when(n % 11 != 0, x.cap_bucket((n % 500) * 1e9)).alias("cap"), label.alias("agreement"))


add("k11_trend_summary", lambda s, d: k.trend_summary(_k11(s, d)).withColumn("symbols", F.array_join("symbols", ",")), f"""{PARTS},
ta AS (SELECT *, CAST(substring(symbol, 2) AS INTEGER) AS p, count(*) OVER (PARTITION BY date) AS n FROM pr),
tb AS (SELECT *, (CASE WHEN n > 1 THEN 100 * (1 - (rank - 1) / (n - 1)) ELSE 100.0::DOUBLE END) * CASE WHEN month(date) % 3 = 0 THEN 0.875::DOUBLE ELSE 1 END AS pc,
 CASE WHEN p % 7 <> 0 THEN p % 100 ELSE 0 END AS tc, CASE WHEN p % 11 = 0 THEN 'Unknown cap' WHEN p % 500 >= 200 THEN 'Mega' WHEN p % 500 >= 10 THEN 'Large' WHEN p % 500 >= 2 THEN 'Mid' ELSE 'Small' END AS cap FROM ta),
tt AS (SELECT * FROM tb WHERE CASE WHEN month(date) % 3 = 0 THEN rank <= ceil(n * 0.1) ELSE pc >= 90 END),
ti AS (SELECT date, 'sector' AS part, coalesce(sector, 'Unclassified') AS item, rank, symbol, pc, tc FROM tt UNION ALL SELECT date, 'cap', cap, rank, symbol, pc, tc FROM tt UNION ALL SELECT date, 'count', 'top_decile', rank, symbol, pc, tc FROM tt
 UNION ALL SELECT date, 'count', 'both_strong', rank, symbol, pc, tc FROM tt WHERE p % 5 < 2 UNION ALL SELECT date, 'count', 'tactical_weak', rank, symbol, pc, tc FROM tt WHERE p % 5 = 2),
tg AS (SELECT date, part, item, count(*) AS names, round(avg(pc), 1) AS percentile, round(avg(tc), 1) AS tactical, min(rank) AS f, list(symbol ORDER BY rank) AS s FROM ti GROUP BY date, part, item),
tp AS (SELECT *, row_number() OVER (PARTITION BY date, part ORDER BY names DESC, CASE WHEN part = 'sector' THEN percentile END DESC NULLS LAST, f, item) AS place FROM tg)
SELECT {D}, part, item, place, names, {r('percentile')}, {r('tactical')}, CASE part WHEN 'sector' THEN array_to_string(s[1:6], ',') WHEN 'cap' THEN array_to_string(s, ',') ELSE '' END AS symbols FROM tp WHERE part <> 'sector' OR place <= 6""", "")


def _k3(s, d):
    """The panel ranked by its 60-session return, with the averages of 50 and 200 sessions."""
    trend = f.moving_averages(t.panel(s, d), (50, 200)).select("symbol", "date", F.col("price_vs_sma_200").alias("vs_sma200"))
    return k.place_and_percentile(base(s, d).withColumn("score", -F.abs("r60")).where("score is not null"), ["date"]).join(trend, ["symbol", "date"])


add("k3_candidate_setups", lambda s, d: k.candidate_setups(_k3(s, d)).select("symbol", "date", "setup", F.array_join("tags", ",").alias("tags"), "bucket", "stop", "activation_price", "activation_pct"), f""",
ka AS (SELECT feat.*, row_number() OVER (PARTITION BY date ORDER BY -abs(r60) DESC, symbol) AS rank, count(*) OVER (PARTITION BY date) AS n FROM feat WHERE r60 IS NOT NULL),
kb AS (SELECT symbol, date, close / ({roll('avg', 'close', 200)}) - 1 AS vs_sma200 FROM p),
kc AS (SELECT ka.*, CASE WHEN rank > greatest(1, ceil(n * 0.1)) THEN 'model_ranked' WHEN vs_sma50 > 0 AND vs_sma200 > 0 AND r20 > 0 AND r60 > 0 THEN 'momentum_confirmed' WHEN vs_sma50 < 0 AND vs_sma200 < 0 AND r20 < 0 AND r60 < 0 THEN 'model_rebound_watch'
 WHEN vs_sma50 < 0 OR vs_sma200 < 0 THEN 'model_ranked_not_momentum_confirmed' ELSE 'model_ranked' END AS setup FROM ka JOIN kb USING (symbol, date))
SELECT symbol, {D}, setup, CASE setup WHEN 'momentum_confirmed' THEN 'Momentum Confirmed' WHEN 'model_rebound_watch' THEN 'Model Rebound Watch,Not Momentum Confirmed,Activation Pending' WHEN 'model_ranked' THEN '' ELSE 'Not Momentum Confirmed' END AS tags,
 CASE WHEN rank <= greatest(1, ceil(n * 0.1)) THEN 'Top Decile' WHEN rank <= greatest(1, ceil(n * 0.2)) THEN 'Top Quintile' ELSE 'Ranked' END AS bucket, rank <= greatest(1, ceil(n * 0.1)) AS stop,
 CASE WHEN setup = 'model_rebound_watch' AND close > 0 AND vol20 > 0 THEN round(close * (1 + 0.75::DOUBLE * vol20), 2) END AS activation_price, CASE WHEN setup = 'model_rebound_watch' AND close > 0 AND vol20 > 0 THEN round(75.0::DOUBLE * vol20, 2) END AS activation_pct FROM kc""")


def _h17(s, d):
    """Parts as names: a quarter is removed some day, a seventh has no prices; shipments are the histories, returned ones archived."""
    name, n = F.format_string("P%09d", "p_partkey"), F.col("p_partkey")
    p = t.table(s, d, "part", ["p_partkey"])
    removals = p.where(n % 4 == 1).select(F.when(n % 40 != 1, name).otherwise("").alias("symbol"), F.date_add(F.lit("1992-01-01").cast("date"), (n * 37 % 2600).cast("int")).alias("removed"))
    histories = t.table(s, d, "lineitem", ["l_partkey", "l_shipdate", "l_returnflag"]).where("l_partkey % 7 != 0").select(F.format_string("P%09d", "l_partkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), (F.col("l_returnflag") == "R").alias("archived"))
    return removals, histories, p.select(name.alias("symbol"), (n % 3 != 0).alias("original"), (n % 5 < 3).alias("current"))


_REM = """WITH hs AS (SELECT format('P{:09d}', l_partkey) AS symbol, CAST(l_shipdate AS DATE) AS date, l_returnflag = 'R' AS archived FROM lineitem WHERE l_partkey % 7 <> 0), la AS (SELECT max(date) AS as_of FROM hs),
he AS (SELECT symbol, count(*) AS n, max(date) AS last, bool_or(archived) AS old FROM hs GROUP BY symbol),
rm AS (SELECT format('P{:09d}', p_partkey) AS symbol, DATE '1992-01-01' + CAST(p_partkey * 37 % 2600 AS INTEGER) AS removed FROM part WHERE p_partkey % 4 = 1 AND p_partkey % 40 <> 1),
rw AS (SELECT rm.* FROM rm, la WHERE removed >= as_of - INTERVAL 48 MONTH AND removed <= as_of)"""
add("h17_review_queue", lambda s, d: h.review_queue(*_h17(s, d)[:2], F.col("archived"), 4).withColumns({c: F.col(c).cast("string") for c in ("removed", "provider_end")}), f"""{_REM}
SELECT symbol, CAST(removed AS VARCHAR) AS removed, CASE WHEN n IS NULL THEN 'not_cached' ELSE 'cached' END AS price_status, coalesce(n, 0) AS provider_rows, CAST(last AS VARCHAR) AS provider_end, coalesce(old, FALSE) AS has_archived_segment,
 FALSE AS membership_verified, FALSE AS terminal_outcome_verified, 'retain_history_and_finish_existing_labels; no_new_sp500_entries_after_verified_removal' AS tracking_policy FROM rw LEFT JOIN he USING (symbol)""", "")
add("h17_findings", lambda s, d: h.survivorship_findings(*_h17(s, d), 4), f"""{_REM}, rf AS (SELECT format('P{{:09d}}', p_partkey) AS symbol FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 >= 3)
SELECT 'removed_since_original' AS finding, symbol FROM rf UNION ALL SELECT 'without_removal_event', symbol FROM rf WHERE symbol NOT IN (SELECT symbol FROM rw)
UNION ALL SELECT 'removed_without_prices', symbol FROM (SELECT DISTINCT symbol FROM rw) WHERE symbol NOT IN (SELECT symbol FROM hs) UNION ALL SELECT 'terminal_or_alias_review', symbol FROM he, la WHERE last <> as_of""", "")
