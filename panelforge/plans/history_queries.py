"""Queries of point-in-time history, quality, scorebook, ledger and model data (H, D, K, R, M) and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.semantics import rounded
from panelforge.operators import cross_section as c
from panelforge.operators import history as h
from panelforge.operators import joins as j
from panelforge.operators import ledger as le
from panelforge.operators import model as m
from panelforge.operators import quality as qa
from panelforge.operators import scorebook as k
from panelforge.plans.panel_queries import MEM, base, membership, predictions
from panelforge.plans.stream_queries import shared_folder
from panelforge.plans.sqlparts import BARS, D, FULL, lead, pct, r, rs
from panelforge.sources import tables as t
from panelforge.sources.shared import durable

QUERIES, SQL = {}, {}


def add(name, run, sql=None, head=FULL):
    QUERIES[name] = lambda s, d: rounded(run(s, d))
    if sql:
        SQL[name] = f"{head} {sql}" if not sql.startswith(",") else f"{head}{sql}"


K = f"symbol, {D}"


def flags(s, d):
    """Flagged sessions: where (session_ix + nation number) is a multiple of 41."""
    return t.panel(s, d).where("(session_ix + cast(substring(symbol, 8) as int)) % 41 = 0").select("symbol", "session_ix", "date")


FL = ", fl AS (SELECT symbol, session_ix, date FROM p WHERE (session_ix + CAST(substring(symbol, 8) AS INTEGER)) % 41 = 0)"


def raw(s, d):
    """Archive form of the bars: an adjusted close and a source that marks carried rows."""
    b = t.panel(s, d).where("close is not null")
    return b.select("symbol", "date", "open", "high", "low", "close", "volume", (F.col("close") * F.when(F.col("session_ix") % 50 == 0, -1.0).otherwise(0.9)).alias("adj_close"), F.when(F.col("session_ix") % 9 == 0, "archive_carried").otherwise("archive").alias("source"))


def events(s, d):
    """Terminal events of every third nation at session 250, cash 1.1 of the last close, one in two with unpriced rights."""
    last = t.panel(s, d).where("close is not null and session_ix <= 250").groupBy("symbol").agg(F.max_by("close", "session_ix").alias("c"))
    n = F.substring("symbol", 8, 9).cast("int")
    return last.where(n % 3 == 0).select("symbol", F.lit(250).alias("event_ix"), F.lit(270).alias("known_ix"), (F.col("c") * 1.1).alias("value"), F.lit(True).alias("verified"), (n % 2 == 0).alias("unresolved"), (F.col("c") * 0.2).alias("rights_max"))


def ended(s, d):
    """The panel with those nations' quotes gone after session 250."""
    n = F.substring("symbol", 8, 9).cast("int")
    return t.panel(s, d).withColumn("close", F.when((n % 3 != 0) | (F.col("session_ix") <= 250), F.col("close")))


EV = f""", ep AS (SELECT symbol, session_ix, CASE WHEN CAST(substring(symbol, 8) AS INTEGER) % 3 <> 0 OR session_ix <= 250 THEN close END AS close FROM p),
 ev AS (SELECT symbol, 1.1 * arg_max(close, session_ix) AS value, 0.2 * arg_max(close, session_ix) AS rm, CAST(substring(symbol, 8) AS INTEGER) % 2 = 0 AS unresolved FROM p WHERE close IS NOT NULL AND session_ix <= 250 AND CAST(substring(symbol, 8) AS INTEGER) % 3 = 0 GROUP BY symbol),
 tl AS (SELECT symbol, max(session_ix) AS li FROM ep WHERE close IS NOT NULL GROUP BY symbol),
 tx AS (SELECT ep.symbol, ep.session_ix, lead(close, 1) OVER w AS en, lead(close, 15) OVER w AS ex, li, value, rm, unresolved FROM ep LEFT JOIN tl USING (symbol) LEFT JOIN ev USING (symbol) WINDOW w AS (PARTITION BY ep.symbol ORDER BY ep.session_ix))"""
PAID = "ex IS NULL AND session_ix + 1 <= li AND session_ix + 15 >= 250 AND li <= 250 AND value IS NOT NULL"
add("h1_membership", lambda s, d: h.build_membership(t.table(s, d, "nation").select(F.col("n_name").alias("symbol")), membership(s, d).select("symbol", F.col("start").alias("date"), F.lit("add").alias("kind")).union(membership(s, d).where("end is not null").select("symbol", "end", F.lit("remove")))).select("symbol", "start", "end", "quality").withColumn("end", F.coalesce(F.col("end").cast("string"), F.lit("open"))),
    f", {MEM} SELECT symbol, CAST(a AS VARCHAR) AS start, coalesce(CAST(b AS VARCHAR), 'open') AS \"end\", 'dated' AS quality FROM mem")
add("h2_normalise_bars", lambda s, d: h.normalise_bars(raw(s, d), flags(s, d)).select("symbol", "date", "close", F.coalesce("reason", F.lit("ok")).alias("reason")),
    FL + f" SELECT symbol, {D}, {r('CASE WHEN NOT v AND session_ix % 50 <> 0 THEN close * ((close * 0.9) / close) END', 'close')}, CASE WHEN v THEN 'no_trade' WHEN session_ix % 50 = 0 THEN 'bad_adjusted_close' ELSE 'ok' END AS reason FROM (SELECT *, session_ix % 9 = 0 OR EXISTS (SELECT 1 FROM fl WHERE fl.symbol = p.symbol AND fl.session_ix = p.session_ix) AS v FROM p WHERE close IS NOT NULL)")


def _h3(s, d):
    days = t.sessions(t.bars(s, d))
    gaps = flags(s, d).select("symbol", F.col("date").alias("last_trade"), F.date_add("date", 28).alias("next_trade"))
    periods = flags(s, d).where("session_ix % 2 = 0").select("symbol", F.date_add("date", 100).alias("start"), F.date_add("date", 121).alias("end"))
    return h.no_trade_days(days, flags(s, d), gaps, periods)


add("h3_no_trade_days", _h3, FL + f" SELECT {K} FROM (SELECT symbol, date FROM fl UNION SELECT symbol, days.date FROM fl JOIN days ON days.date > fl.date AND days.date < fl.date + 28 UNION SELECT symbol, days.date FROM fl JOIN days ON days.date BETWEEN fl.date + 100 AND fl.date + 121 WHERE fl.session_ix % 2 = 0)")
add("h4_rebase", lambda s, d: h.rebase(t.bars(s, d).select("symbol", "date", "close"), flags(s, d).select("symbol", F.col("date").alias("at"), F.lit(0.98).alias("factor"))), FL + f" SELECT symbol, {D}, {r('close * pow(0.98, (SELECT count(*) FROM fl WHERE fl.symbol = b.symbol AND fl.date > b.date))', 'close')} FROM bars b")
add("h5_spine", lambda s, d: t.panel(s, d).select("symbol", "date", "session_ix", "close"), f"SELECT {K}, session_ix, {r('close')} FROM p")
add("h6_terminal_outcomes", lambda s, d: h.terminal_outcomes(ended(s, d), events(s, d), 14).select("symbol", "session_ix", "outcome", "available_ix", "resolved"),
    EV + f" SELECT symbol, session_ix, {r(f'CASE WHEN {PAID} AND NOT unresolved THEN value / en - 1 ELSE ex / en - 1 END', 'outcome')}, CASE WHEN {PAID} AND NOT unresolved THEN greatest(session_ix + 15, 270) ELSE session_ix + 15 END AS available_ix, coalesce({PAID} AND NOT unresolved AND en IS NOT NULL, false) AS resolved FROM tx")
add("h7_outcome_bounds", lambda s, d: h.outcome_bounds(ended(s, d), events(s, d), 14), EV + f" SELECT symbol, session_ix, {r(f'CASE WHEN {PAID} THEN value / en - 1 ELSE ex / en - 1 END', 'low')}, {r(f'CASE WHEN {PAID} THEN (value + rm) / en - 1 ELSE ex / en - 1 END', 'high')} FROM tx")
add("h9_quarantine", lambda s, d: h.quarantine(t.panel(s, d), flags(s, d)).select("symbol", "date", "close"), FL + f" SELECT {K}, {r('CASE WHEN NOT EXISTS (SELECT 1 FROM fl WHERE fl.symbol = p.symbol AND p.session_ix IN (fl.session_ix, fl.session_ix - 1)) THEN close END', 'close')} FROM p")
add("h10_exposure", lambda s, d: h.exposure(t.panel(s, d), flags(s, d), 20, 14), FL + " SELECT symbol, session_ix, CAST(EXISTS (SELECT 1 FROM fl WHERE fl.symbol = p.symbol AND fl.session_ix > p.session_ix - 20 AND fl.session_ix <= p.session_ix) AS INTEGER) AS past_flag, CAST(EXISTS (SELECT 1 FROM fl WHERE fl.symbol = p.symbol AND fl.session_ix > p.session_ix AND fl.session_ix <= p.session_ix + 15) AS INTEGER) AS future_flag FROM p")


def _h11(s, d):
    """Rows without an end result: an unknown quote, or no sector benchmark (every tenth session); halts on every eleventh entry and thirteenth exit."""
    w = Window.partitionBy("symbol").orderBy("session_ix")
    df = ended(s, d).select("symbol", "session_ix", F.lead("close", 1).over(w).alias("en"), F.lead("close", 15).over(w).alias("ex"))
    last = ended(s, d).where("close is not null").groupBy("symbol").agg(F.max("session_ix").alias("li"))
    df = df.join(last, "symbol").join(events(s, d).select("symbol", "verified", "unresolved"), "symbol", "left").where("en is null or ex is null or session_ix % 10 = 0")
    ix, ev = F.col("session_ix"), F.col("verified").isNotNull()
    known = F.col("en").isNotNull() & F.col("ex").isNotNull()
    why = h.unknown_reason(F.col("en").isNotNull(), F.col("ex").isNotNull(), (ix + 1) % 11 == 0, (ix + 15) % 13 == 0, ix + 1 > F.col("li"), ix + 15 > F.col("li"), ev, ev & (ix + 1 >= 250), F.coalesce("unresolved", F.lit(False)), known)
    return df.select("symbol", "session_ix", why.alias("reason"))


add("h11_unknown_reason", _h11, EV + """ SELECT symbol, session_ix, CASE WHEN en IS NULL AND (session_ix + 1) % 11 = 0 THEN 'entry_during_halt' WHEN en IS NULL AND session_ix + 1 > li AND value IS NOT NULL AND session_ix + 1 >= 250 THEN 'entry_after_verified_termination' WHEN en IS NULL AND session_ix + 1 > li AND value IS NOT NULL THEN 'missing_entry_before_event'
 WHEN en IS NULL AND session_ix + 1 > li THEN 'entry_after_unreviewed_series_end' WHEN en IS NULL THEN 'missing_entry_quote' WHEN (session_ix + 15) % 13 = 0 THEN 'exit_during_halt' WHEN ex IS NOT NULL THEN 'missing_sector_benchmark' WHEN value IS NOT NULL AND unresolved THEN 'unpriced_contingent_rights'
 WHEN session_ix + 15 > li AND value IS NOT NULL THEN 'registered_event_needs_review' WHEN session_ix + 15 > li THEN 'unreviewed_series_end' ELSE 'missing_exit_quote' END AS reason FROM tx WHERE en IS NULL OR ex IS NULL OR session_ix % 10 = 0""")
add("h12_missingness", lambda s, d: h.missingness(predictions(s, d), ["sector"]), f"SELECT sector, outcome IS NULL AS unknown, count(*) AS rows, count(DISTINCT symbol) AS symbols, {r('median(score)', 'median_score')} FROM sc GROUP BY ALL")
add("h13_disagreements", lambda s, d: h.disagreements(t.bars(s, d), t.bars(s, d).withColumn("close", F.when(F.dayofyear("date") % 30 == 2, F.col("close") * 1.1).otherwise(F.col("close"))), 0.01).select("symbol", "date", "gap", "offsetting"),
    f", x AS (SELECT symbol, date, close / lag(close) OVER w - 1 AS ra, c2 / lag(c2) OVER w - 1 AS rb FROM (SELECT *, CASE WHEN dayofyear(date) % 30 = 2 THEN close * 1.1 ELSE close END AS c2 FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, {D}, {r('ra - rb', 'gap')}, coalesce(abs(ra - rb + nx) <= 0.01, false) AS offsetting FROM (SELECT *, lead(ra - rb) OVER (PARTITION BY symbol ORDER BY date) AS nx FROM x) WHERE abs(ra - rb) > 0.01")
add("h14_coverage", lambda s, d: h.coverage(j.members(base(s, d), membership(s, d)), ["r20", "vol20"], "date"), f", {MEM} SELECT {D}, count(*) AS rows, {r('avg(CAST(r20 IS NOT NULL AND vol20 IS NOT NULL AS INTEGER))', 'coverage')} FROM feat WHERE EXISTS (SELECT 1 FROM mem WHERE mem.symbol = feat.symbol AND feat.date >= a AND (b IS NULL OR feat.date < b)) GROUP BY date")


def _h14(s, d):
    """The members' matrix written by year; then one year is written again after its features changed, and all years are read."""
    at = shared_folder(s)
    build = lambda features: h.point_in_time_matrix(features, membership(s, d), ["r20", "vol20", "vs_sma50"])
    h.write_years(build(base(s, d)), at)
    revised = base(s, d).withColumn("r20", F.when(F.year("date") == 1997, -F.col("r20")).otherwise(F.col("r20")))
    return h.write_years(build(revised), at, [1997])


_MEMBERS = f""", {MEM}, pm0 AS (SELECT * REPLACE (CASE WHEN year(date) = 1997 THEN -r20 ELSE r20 END AS r20) FROM feat WHERE EXISTS (SELECT 1 FROM mem WHERE mem.symbol = feat.symbol AND feat.date >= a AND (b IS NULL OR feat.date < b))),
pm AS (SELECT *, {pct('r20', 'date')} AS r20_rank, {pct('vol20', 'date')} AS vol20_rank, {pct('vs_sma50', 'date')} AS vs_sma50_rank, avg(coalesce(CAST(vs_sma20 > 0 AS INTEGER), 0)) OVER d AS above_20, avg(coalesce(CAST(vs_sma50 > 0 AS INTEGER), 0)) OVER d AS above_50, median(r20) OVER d AS r20_median FROM pm0 WINDOW d AS (PARTITION BY date))"""
add("h14_point_in_time", lambda s, d: _h14(s, d).select("symbol", "date", "r20_rank", "vol20_rank", "vs_sma50_rank", "above_20", "above_50", "r20_median"), f"{_MEMBERS} SELECT {K}, {rs('r20_rank', 'vol20_rank', 'vs_sma50_rank', 'above_20', 'above_50', 'r20_median')} FROM pm")
add("h14_coverage_symbols", lambda s, d: h.coverage(h.point_in_time_matrix(base(s, d), membership(s, d), ["r20"]), ["r20_rank", "vol20"], "symbol"), f"{_MEMBERS} SELECT symbol, count(*) AS rows, {r('avg(CAST(r20 IS NOT NULL AND vol20 IS NOT NULL AS INTEGER))', 'coverage')} FROM pm GROUP BY symbol")
add("h15_reconcile", lambda s, d: h.reconcile(t.bars(s, d).where("volume > 100"), j.members(t.panel(s, d).select("symbol", "date"), membership(s, d))), f""", {MEM}, mm AS (SELECT symbol, date FROM p WHERE EXISTS (SELECT 1 FROM mem WHERE mem.symbol = p.symbol AND p.date >= a AND (b IS NULL OR p.date < b)))
 SELECT CAST(coalesce(x.date, y.date) AS VARCHAR) AS date, count(*) FILTER (x.symbol IS NOT NULL AND y.symbol IS NOT NULL) AS both, count(*) FILTER (y.symbol IS NULL) AS only_snapshot, count(*) FILTER (x.symbol IS NULL) AS only_members FROM (SELECT symbol, date FROM bars WHERE volume > 100) x FULL JOIN mm y ON x.symbol = y.symbol AND x.date = y.date GROUP BY 1""")
add("h17_survivorship", lambda s, d: h.survivorship(membership(s, d).where("end is not null").select("symbol", F.col("end").alias("removed")), t.bars(s, d).where("symbol < 'NATION_5' and date < '1996-06-01'")),
    f", {MEM} SELECT mem.symbol, CAST(b AS VARCHAR) AS removed, CASE WHEN l IS NULL THEN 'missing' WHEN l < b - 7 THEN 'short' ELSE 'covered' END AS status FROM mem LEFT JOIN (SELECT symbol, max(date) AS l FROM bars WHERE symbol < 'NATION_5' AND date < DATE '1996-06-01' GROUP BY symbol) x USING (symbol) WHERE b IS NOT NULL")
add("h18_version_pairing", lambda s, d: h.equal_outcomes(predictions(s, d), predictions(s, d).where("month(date) != 5").withColumn("outcome", F.when(F.month("date") != 6, F.col("outcome")))), "SELECT count(*) FILTER (month(date) <> 5) AS shared, count(*) FILTER (month(date) = 6 AND outcome IS NOT NULL) AS different FROM sc")

# quality
add("d1_calendar", lambda s, d: qa.calendar_violations(t.bars(s, d), t.sessions(t.bars(s, d))), "SELECT symbol, count(*) - count(DISTINCT date) AS repeated, count(*) FILTER (NOT close > 0) AS not_positive, CAST(max(session_ix) - min(session_ix) + 1 AS BIGINT) - count(DISTINCT date) AS holes, max(date) < (SELECT max(date) FROM days) AS stale FROM bars JOIN days USING (date) GROUP BY symbol")
add("d2_price_profile", lambda s, d: qa.price_profile(t.panel(s, d)), "SELECT symbol, count(*) AS rows, count(*) FILTER (close IS NULL) AS nulls, count(*) FILTER (abs(r1) > 0.5) AS jumps, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last FROM p GROUP BY symbol")
add("d2_row_counts", lambda s, d: qa.row_count_quantiles(t.bars(s, d)), f"SELECT {', '.join(r(f'quantile_cont(n, {x})', y) for x, y in ((0, 'least'), (0.25, 'p25'), (0.5, 'median'), (0.75, 'p75'), (1, 'most')))} FROM (SELECT count(*) AS n FROM bars GROUP BY symbol)")
add("d3_dataset_profile", lambda s, d: qa.dataset_profile(predictions(s, d), ["score", "vol20"]), " UNION ALL ".join(f"SELECT '{x}' AS feature, count(*) FILTER ({x} IS NULL) AS nulls, 0 AS non_finite, {r(f'avg({x})', 'mean')}, {r(f'min({x})', 'least')}, {r(f'max({x})', 'most')} FROM sc" for x in ("score", "vol20")))
add("d4_history_starts", lambda s, d: qa.history_starts(t.bars(s, d), [0.5, 0.9, 1.0]), "SELECT share, CAST(min(start) AS VARCHAR) AS start FROM (SELECT start, row_number() OVER (ORDER BY start) AS k, count(*) OVER () AS n FROM (SELECT min(date) AS start FROM bars GROUP BY symbol)) JOIN (SELECT unnest([0.5, 0.9, 1.0]::DOUBLE[]) AS share) x ON k >= ceil(n * share) GROUP BY share")
add("d6_readiness", lambda s, d: qa.readiness(t.bars(s, d), ["NATION_0", "NATION_1"]).select("context_ok", "share", "stale", "ready"),
    f", z AS (SELECT symbol, symbol IN ('NATION_0', 'NATION_1') AS ctx, CAST(max(date) = (SELECT max(date) FROM bars) AS INTEGER) AS cur FROM bars GROUP BY symbol), g AS (SELECT min(cur) FILTER (ctx) AS context_ok, avg(cur) FILTER (NOT ctx) AS share, coalesce(array_to_string(list_slice(list_sort(list(symbol) FILTER (cur = 0)), 1, 6), ','), '') AS stale FROM z) SELECT context_ok, {r('share')}, stale, coalesce(context_ok, 1) = 1 AND share >= 0.9 AS ready FROM g")
add("d8_scorable", lambda s, d: qa.scorable(predictions(s, d), F.lit("2000-01-03").cast("date"), ["score", "vol20"]).select("symbol", "score"), f"SELECT symbol, {r('score')} FROM sc WHERE date = DATE '2000-01-03' AND score IS NOT NULL AND vol20 IS NOT NULL")
add("d10_label_mismatches", lambda s, d: qa.label_mismatches(predictions(s, d).withColumn("again", F.when(F.month("date") != 2, F.col("outcome") + F.when(F.month("date") == 3, 1e-6).otherwise(0.0))), "outcome", "again"), "SELECT count(*) AS rows, count(*) FILTER (month(date) = 3 AND outcome IS NOT NULL) AS mismatches, count(*) FILTER (month(date) = 2 AND outcome IS NOT NULL) AS one_sided FROM sc")
SCORED = "(SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank, count(*) OVER (PARTITION BY date) AS n FROM sc WHERE score IS NOT NULL)"


def scored(s, d):
    return k.place_and_percentile(predictions(s, d).where("score is not null"), ["date"])


add("d11_published_contract", lambda s, d: qa.published_violations(scored(s, d).where("not (symbol = 'NATION_3' and month(date) = 4)")), f"SELECT {D}, symbol, rank FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY rank) AS q, count(*) OVER (PARTITION BY date) AS m, CASE WHEN n > 1 THEN 100 * (1 - (rank - 1) / (n - 1)) ELSE 100 END AS pc FROM {SCORED} WHERE NOT (symbol = 'NATION_3' AND month(date) = 4)) WHERE rank <> q OR abs(pc - CASE WHEN m > 1 THEN 100 * (1 - (rank - 1) / (m - 1)) ELSE 100 END) > 1e-9")
add("d5_tag_coverage", lambda s, d: qa.tag_coverage(t.table(s, d, "events").select(F.col("event_type").alias("tag"), F.col("user_id").alias("symbol")), 100), f"SELECT event_type AS tag, count(DISTINCT user_id) AS symbols, count(*) AS facts, {r('count(DISTINCT user_id) / 100', 'coverage')} FROM events GROUP BY event_type", "")

# scorebook
add("m2_rank_percentile", lambda s, d: scored(s, d).select("symbol", "date", "rank", "percentile"), f"SELECT {K}, rank, {r('CASE WHEN n > 1 THEN 100 * (1 - (rank - 1) / (n - 1)) ELSE 100 END', 'percentile')} FROM {SCORED}")


def live(s, d):
    df = c.minus_sector_median(c.rank_columns(base(s, d), ["r20"], ["date", "sector"], "sector_rank"), ["r20", "vol20"])
    return k.place_and_percentile(df.withColumn("score", F.col("r60")).where("score is not null"), ["date"])


def top():
    return F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1))


LIVE = f", lv AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY r60 DESC, symbol) AS rank, count(*) OVER (PARTITION BY date) AS n FROM (SELECT *, r20 - median(r20) OVER (PARTITION BY date, sector) AS rm, vol20 - median(vol20) OVER (PARTITION BY date, sector) AS vm, {pct('r20', 'date, sector')} AS sr FROM feat) WHERE r60 IS NOT NULL)"
_SET = "CASE WHEN rank <= greatest(1, ceil(n * 0.1)) AND vs_sma20 > 0 AND vs_sma50 > 0 AND r5 > 0 AND r20 > 0 THEN 'momentum_confirmed' WHEN rank <= greatest(1, ceil(n * 0.1)) AND vs_sma20 < 0 AND vs_sma50 < 0 AND r5 < 0 AND r20 < 0 THEN 'model_rebound_watch' WHEN rank <= greatest(1, ceil(n * 0.1)) AND (vs_sma20 < 0 OR vs_sma50 < 0) THEN 'model_ranked_not_momentum_confirmed' ELSE 'model_ranked' END"
add("k3_setup", lambda s, d: live(s, d).select("symbol", "date", k.setup_type(top()).alias("setup")), LIVE + f" SELECT {K}, {_SET} AS setup FROM lv")
add("k4_activation", lambda s, d: live(s, d).withColumn("setup", k.setup_type(top())).select("symbol", "date", k.activation_price(F.col("setup"), F.col("close"), F.col("vol20")).alias("price")).where("price is not null"), LIVE + f" SELECT {K}, round(close * (1 + 0.75 * vol20), 2) AS price FROM (SELECT *, {_SET} AS setup FROM lv) WHERE setup = 'model_rebound_watch' AND vol20 > 0 AND close > 0")


def _k5(s, d):
    ret = F.col("etf_close") / F.lag("etf_close").over(Window.partitionBy("sector").orderBy("date")) - 1
    return k.sector_inference(base(s, d).select("symbol", "date", "r1"), t.sector_bars(s, d).select("sector", "date", ret.alias("s1"))).select("symbol", "inferred", "corr")


add("k5_sector_inference", _k5, f"SELECT symbol, arg_max(sector, c) AS inferred, {r('max(c)', 'corr')} FROM (SELECT symbol, e.sector, corr(r1, s1) AS c FROM feat JOIN (SELECT sector, date, etf_close / lag(etf_close) OVER (PARTITION BY sector ORDER BY date) - 1 AS s1 FROM etf) e ON e.date = feat.date WHERE r1 IS NOT NULL AND s1 IS NOT NULL GROUP BY ALL HAVING count(*) >= 60) GROUP BY symbol")
add("k6_against_reference", lambda s, d: k.against_reference(predictions(s, d).where("score is not null and sector = 'ASIA'"), predictions(s, d).where("score is not null and sector != 'ASIA'")).select("symbol", "date", "place"), f"SELECT {K}, 1 + (SELECT count(*) FROM sc x WHERE x.date = sc.date AND x.sector <> 'ASIA' AND x.score > sc.score) AS place FROM sc WHERE score IS NOT NULL AND sector = 'ASIA'")
add("k10_agreement", lambda s, d: k.place_and_percentile(predictions(s, d).where("score is not null"), ["date"]).select("symbol", "date", F.col("percentile").alias("lp"), F.col("vs_sma20")).join(k.place_and_percentile(predictions(s, d).where("short is not null").withColumn("score", F.col("short")), ["date"]).select("symbol", "date", F.col("percentile").alias("tp")), ["symbol", "date"], "left").select("symbol", "date", k.agreement_label(F.col("lp"), F.col("tp"), F.col("vs_sma20") > 0).alias("label")),
    f", a AS (SELECT symbol, date, vs_sma20, CASE WHEN n > 1 THEN 100 * (1 - (rank - 1) / (n - 1)) ELSE 100 END AS lp FROM {SCORED}), b AS (SELECT symbol, date, CASE WHEN count(*) OVER (PARTITION BY date) > 1 THEN 100 * (1 - (row_number() OVER (PARTITION BY date ORDER BY short DESC, symbol) - 1) / (count(*) OVER (PARTITION BY date) - 1)) ELSE 100 END AS tp FROM sc WHERE short IS NOT NULL) SELECT symbol, CAST(a.date AS VARCHAR) AS date, CASE WHEN lp >= 90 AND tp >= 80 AND vs_sma20 > 0 THEN 'Both Models Agree' WHEN lp >= 90 AND vs_sma20 > 0 THEN '1Y Strong + Tactical Momentum' WHEN lp >= 90 AND tp >= 80 THEN '1Y Strong / Tactical Watch' WHEN lp >= 90 AND tp < 50 THEN '1Y Strong / Tactical Weak' WHEN lp >= 90 THEN 'Long-Horizon Leader' WHEN tp >= 90 THEN 'Tactical Only' WHEN lp >= 80 THEN 'Long-Horizon Watch' ELSE 'Monitor' END AS label FROM a LEFT JOIN b USING (symbol, date)")
add("k11_leadership", lambda s, d: k.sector_leadership(scored(s, d)).select("sector", "names", "percentile"), f"SELECT sector, count(*) AS names, {r('avg(CASE WHEN n > 1 THEN 100 * (1 - (rank - 1) / (n - 1)) ELSE 100 END)', 'percentile')} FROM {SCORED} WHERE rank <= greatest(1, ceil(n * 0.1)) GROUP BY sector")
add("k12_rank_changes", lambda s, d: k.rank_changes(scored(s, d).select(F.col("date").alias("as_of"), "symbol", "rank", F.when(F.month("date") % 2 == 0, "m2").otherwise("m1").alias("model"))),
    f", sn AS (SELECT date, symbol, rank FROM {SCORED} WHERE month(date) % 2 = (SELECT month(max(date)) % 2 FROM sc WHERE score IS NOT NULL)), dk AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS k FROM (SELECT DISTINCT date FROM sn)), g AS (SELECT symbol, max(rank) FILTER (k = 0) AS rank, max(rank) FILTER (k = 1) AS pr, max(rank) FILTER (k = 5) AS er FROM sn JOIN dk USING (date) GROUP BY symbol) SELECT symbol, rank, pr - rank AS change_1, er - rank AS change_n, CASE WHEN pr IS NULL THEN 'new' WHEN pr > rank THEN 'up' WHEN pr < rank THEN 'down' ELSE 'same' END AS status FROM g WHERE rank IS NOT NULL ORDER BY abs(pr - rank) DESC NULLS LAST, symbol LIMIT 20")
add("k13_over_represented", lambda s, d: k.over_represented(scored(s, d)), f", g AS (SELECT sector, count(*) AS \"all\", count(*) FILTER (rank > n * 0.75) AS bottom FROM {SCORED} GROUP BY sector) SELECT * FROM (SELECT sector, \"all\", bottom, round((bottom / sum(bottom) OVER ()) / (\"all\" / sum(\"all\") OVER ()), 6) AS ratio FROM g) WHERE ratio >= 1 AND bottom >= 2")
add("k15_stance", lambda s, d: c.breadth(base(s, d)).select("date", k.stance(F.col("above_50")).alias("stance")), f"SELECT {D}, CASE WHEN x >= 0.55 THEN 'Risk on' WHEN x >= 0.4 THEN 'Mixed' ELSE 'Risk off' END AS stance FROM (SELECT date, avg(coalesce(CAST(vs_sma50 > 0 AS INTEGER), 0)) AS x FROM feat GROUP BY date)")
add("k16_union_missing", lambda s, d: k.union_missing(t.table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("src")).distinct(), t.table(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("src")).distinct(), "k"), "SELECT DISTINCT c_nationkey AS k, 'c' AS src FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT DISTINCT s_nationkey, 's' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000)", "")
add("k17_avoid_list", lambda s, d: scored(s, d).where(F.col("date") == F.lit("2000-01-03").cast("date")).orderBy(F.desc("rank")).limit(10).select("symbol", "rank", F.concat_ws(" ", "sector", F.col("rank").cast("string")).alias("evidence")), f"SELECT symbol, rank, sector || ' ' || rank AS evidence FROM {SCORED} WHERE date = DATE '2000-01-03' ORDER BY rank DESC LIMIT 10")
add("k18_to_refresh", lambda s, d: k.to_refresh(t.table(s, d, "nation").select(F.col("n_name").alias("key")), t.table(s, d, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").join(t.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("key")).agg(F.to_date(F.max("o_orderdate")).alias("fetched")), F.lit("2001-12-31").cast("date"), 20, 12),
    "SELECT n_name AS key, fetched IS NULL AS missing FROM nation LEFT JOIN (SELECT n2.n_name AS key, CAST(max(o_orderdate) AS DATE) AS fetched FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1) x ON x.key = n_name WHERE fetched IS NULL OR date_diff('day', fetched, DATE '2001-12-31') > 20 ORDER BY missing DESC, fetched NULLS FIRST, n_name LIMIT 12", "")

# ledger
add("r1_missing_targets", lambda s, d: le.missing_targets(le.expected_targets(t.sessions(t.bars(s, d)).select("date")), le.expected_targets(t.sessions(t.bars(s, d)).where("session_ix % 3 = 0").select("date"))).select("key", F.col("due_at").cast("string").alias("due_at")),
    "SELECT strftime(date, '%Y%m%d') || '-' || h AS key, strftime(timezone('UTC', timezone('America/New_York', CAST(date AS TIMESTAMP) + to_hours(h))), '%Y-%m-%d %H:%M:%S') AS due_at FROM days, (SELECT unnest([9, 18]) AS h) WHERE session_ix % 3 <> 0")
add("r2_upsert", lambda s, d: le.upsert(t.table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("finished_at"), F.col("o_orderstatus").alias("status")), t.table(s, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("finished_at"), F.col("o_orderstatus").alias("status"))),
    "SELECT key, CAST(finished_at AS VARCHAR) AS finished_at, status FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY finished_at DESC, status DESC) AS n FROM (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS finished_at, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)) WHERE n = 1 ORDER BY finished_at DESC, key LIMIT 120", "")
add("r3_delay", lambda s, d: t.table(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("user_id", le.delay_minutes(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("delay")), f"SELECT user_id, {r('(epoch(date_trunc(chr(115)||chr(101)||chr(99)||chr(111)||chr(110)||chr(100), max(ts))) - epoch(date_trunc(chr(115)||chr(101)||chr(99)||chr(111)||chr(110)||chr(100), min(ts)))) / 60', 'delay')} FROM events GROUP BY user_id", "")
SQL["r3_delay"] = SQL["r3_delay"].replace("chr(115)||chr(101)||chr(99)||chr(111)||chr(110)||chr(100)", "'second'")

# model data
add("m3_ndcg", lambda s, d: m.ndcg(predictions(s, d).where("score is not null and grade is not null"), 10), f"SELECT {D}, {r('sum(CASE WHEN p <= 10 THEN (pow(2, grade) - 1) / log2(p + 1) END) / sum(CASE WHEN i <= 10 THEN (pow(2, grade) - 1) / log2(i + 1) END)', 'ndcg')} FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS p, row_number() OVER (PARTITION BY date ORDER BY grade DESC, symbol) AS i FROM sc WHERE score IS NOT NULL AND grade IS NOT NULL) GROUP BY date")


def _m3(s, d):
    from panelforge.operators import splits as v

    bars = durable(t.bars(s, d))
    df = predictions(s, d, bars).where("score is not null and vol20 is not null and short is not null and grade is not null").withColumn("grade", F.col("grade").cast("double"))
    parts = durable(df.join(v.embargoed_split(bars, 60, 60, 14), "date"))
    model = m.train_ranker(parts.where("split = 'train'"), ["score", "vol20", "short"], trees=5)
    return model.transform(parts.where("split = 'test'")).select("symbol", "date", F.col("prediction").alias("score"), "grade")


QUERIES["m3_train_ranker"] = lambda s, d: rounded(_m3(s, d))


def _arms(s, d):
    from panelforge.operators import splits as v

    bars = durable(t.bars(s, d))
    df = predictions(s, d, bars).where("score is not null and vol20 is not null and short is not null and grade is not null")
    folds = v.walk_forward(bars, 2, 40, 40, 100, 14)
    return m.fold_predictions(df, folds, m.ablation_arms(["score", "vol20", "short"], {"volatility": ["^vol"]}, trees=3))


def _m6(s, d):
    from panelforge.operators import backtest as b

    w = Window.partitionBy("strategy", "date").orderBy(F.desc("score"), "symbol")
    top = _arms(s, d).withColumn("place", F.row_number().over(w)).where("place <= 3")
    return b.describe(top, "outcome", ["strategy"])


QUERIES["m6_ablation"] = lambda s, d: rounded(_m6(s, d))
QUERIES["v8_trailing_split"] = lambda s, d: rounded(_v8(s, d))


def _v8(s, d):
    from panelforge.operators import splits as v

    return v.trailing_split(t.bars(s, d), 0.2, 0.2, 15)


SQL["v8_trailing_split"] = f"WITH {BARS}, dn AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)) SELECT * FROM (SELECT {D}, CASE WHEN i < n - floor(n * 0.2) - floor(n * 0.2) THEN 'train' WHEN i < n - floor(n * 0.2) - 15 THEN 'validation' WHEN i >= n - floor(n * 0.2) THEN 'test' END AS split FROM dn) WHERE split IS NOT NULL"
