"""Queries of cross-section, labels, joins, splits and backtests (C, L, J, V, B) and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.semantics import pct_rank, rounded
from panelforge.operators import backtest as b
from panelforge.operators import cross_section as c
from panelforge.operators import features as f
from panelforge.operators import joins as j
from panelforge.operators import splits as v
from panelforge.plans.sqlparts import BARS, BENCH, D, FULL, lead, pct, r, roll, rs
from panelforge.sources import tables as t

QUERIES, SQL = {}, {}


def predictions(spark, sf, bars=None):
    """(date, symbol, sector, session_ix, close, score, low_vol, short, vol20, vs_sma20, outcome, grade) from the panel, or from `bars` at hand."""
    df = c.base_features(t.panel(spark, sf) if bars is None else t.on_spine(bars))
    w = Window.partitionBy("symbol").orderBy("date")
    out = F.lead("close", 15).over(w) / F.lead("close", 1).over(w) - 1
    df = df.select("date", "symbol", "sector", "session_ix", "close", F.col("r20").alias("score"), (-F.col("vol20")).alias("low_vol"), F.col("r5").alias("short"), "vol20", "vs_sma20", out.alias("outcome"))
    return df.withColumn("grade", F.when(F.col("outcome").isNotNull(), c.grade(pct_rank(F.col("outcome"), "date"))))


def add(name, run, sql, digits=6):
    QUERIES[name] = lambda spark, sf: rounded(run(spark, sf), digits)
    SQL[name] = f"{FULL} {sql}"


def base(spark, sf):
    return c.base_features(t.panel(spark, sf))


K = f"symbol, {D}"
add("c7_breadth", lambda s, d: c.breadth(base(s, d)),
    f"SELECT {D}, {r('avg(coalesce(CAST(vs_sma20 > 0 AS INTEGER), 0))', 'above_20')}, {r('avg(coalesce(CAST(vs_sma50 > 0 AS INTEGER), 0))', 'above_50')}, {r('median(r20)', 'r20_median')}, {r('median(r60)', 'r60_median')}, {r('median(vol20)', 'vol20_median')} FROM feat GROUP BY date")
add("c8_sector_context", lambda s, d: c.sector_context(t.sector_bars(s, d)), f"SELECT sector, {D}, {rs('sector_r20', 'sector_vol20', 'sector_forward')} FROM ctx")
add("l1_forward_same_close", lambda s, d: c.forward_same_close(t.panel(s, d)), f"SELECT {K}, {r('same_close', 'forward_return')} FROM feat")
add("l2_forward_next_close", lambda s, d: c.forward_next_close(t.panel(s, d)), f"SELECT {K}, {r('outcome', 'forward_return')} FROM feat")
FW = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING)"
add("l3_worst_path", lambda s, d: c.worst_path(t.panel(s, d)), f"SELECT {K}, {r(f'min(close) OVER {FW} / {lead('close', 1)} - 1', 'worst_path')} FROM p")
DDQ = f"""SELECT symbol, date, CASE WHEN len(a) = 15 THEN list_reduce(list_transform(range(1, 16), lambda i: a[i] / list_max(a[1:i]) - 1), lambda x, y: least(x, y)) END AS max_drawdown
 FROM (SELECT symbol, date, list_filter(list(close) OVER {FW}, lambda x: x IS NOT NULL) AS a FROM p)"""
add("l4_path_drawdown", lambda s, d: c.path_drawdown(t.panel(s, d)), f"SELECT {K}, {r('max_drawdown')} FROM ({DDQ})")
EXC = "(SELECT feat.*, outcome - bf AS excess_return, outcome - sector_forward AS sector_neutral FROM feat LEFT JOIN (SELECT date, lead(bench_close, 15) OVER (ORDER BY date) / lead(bench_close, 1) OVER (ORDER BY date) - 1 AS bf FROM bench) USING (date) LEFT JOIN ctx USING (sector, date))"
add("l5_excess_returns", lambda s, d: c.excess_returns(t.panel(s, d), t.benchmark(s, d), c.sector_context(t.sector_bars(s, d))),
    f"SELECT symbol, sector, {D}, {r('outcome', 'forward_return')}, {rs('excess_return', 'sector_neutral')}, {r('sector_neutral - 0.0015', 'after_cost')} FROM {EXC}")


def _l6(s, d):
    w = Window.partitionBy("date", "sector")
    own = c.path_drawdown(t.panel(s, d)).join(c.excess_returns(t.panel(s, d), t.benchmark(s, d), c.sector_context(t.sector_bars(s, d))), ["symbol", "date"])
    return c.drawdown_adjusted(own.withColumn("sector_drawdown", F.median("max_drawdown").over(w))).select("symbol", "date", "relative_drawdown", "adjusted_return")


add("l6_drawdown_adjusted", _l6, f"""SELECT {K}, {r('rel', 'relative_drawdown')}, {r('sector_neutral - 0.0015 + 0.25 * least(greatest(rel, -0.5), 0.5)', 'adjusted_return')}
 FROM (SELECT x.symbol, x.date, sector_neutral, max_drawdown - median(max_drawdown) OVER (PARTITION BY x.date, x.sector) AS rel FROM {EXC} x JOIN ({DDQ}) USING (symbol, date))""")
add("l7_grades", lambda s, d: c.graded(c.forward_next_close(t.panel(s, d)), "forward_return").select("symbol", "date", "outcome_rank", "grade"),
    f"SELECT {K}, {r('k', 'outcome_rank')}, CASE WHEN k >= 0.9 THEN 4 WHEN k >= 0.8 THEN 3 WHEN k <= 0.1 THEN 0 WHEN k <= 0.2 THEN 1 ELSE 2 END AS grade FROM (SELECT symbol, date, {pct('outcome', 'date')} AS k FROM feat WHERE outcome IS NOT NULL)")
add("l8_binary_labels", lambda s, d: c.binary_labels(c.forward_next_close(t.panel(s, d)).where("forward_return is not null"), "forward_return").select("symbol", "date", "positive", "above_hurdle"),
    f"SELECT {K}, CAST(outcome > 0 AS INTEGER) AS positive, CAST(outcome > 0.01 AS INTEGER) AS above_hurdle FROM feat WHERE outcome IS NOT NULL")


add("l10_complete_cases", lambda s, d: c.complete_cases(predictions(s, d), ["score", "outcome", "vol20"]).select("symbol", "date", "score", "outcome"),
    f"SELECT {K}, {rs('score', 'outcome')} FROM sc WHERE score IS NOT NULL AND outcome IS NOT NULL AND vol20 IS NOT NULL")


def _l11(s, d):
    df = predictions(s, d).select("symbol", "date", "outcome", (F.col("session_ix") + 15).alias("available"))
    return c.grades_known_at(df, "outcome", 200).select("symbol", "date", "grade")


add("l11_grades_known_at", _l11, f"SELECT {K}, grade FROM sc WHERE outcome IS NOT NULL AND session_ix + 15 < 200")

# joins
add("j1_benchmark_join", lambda s, d: f.with_benchmark(t.panel(s, d), t.benchmark(s, d)).select("symbol", "date", "close", "bench_close"), f"SELECT symbol, CAST(p.date AS VARCHAR) AS date, {rs('close', 'bench_close')} FROM p LEFT JOIN bench USING (date)")
add("j2_context_join", lambda s, d: base(s, d).join(c.breadth(base(s, d)), "date", "left").join(c.sector_context(t.sector_bars(s, d)), ["sector", "date"], "left").select("symbol", "date", "above_20", "sector_r20"),
    f"SELECT symbol, CAST(feat.date AS VARCHAR) AS date, {rs('above_20', 'sector_r20')} FROM feat LEFT JOIN (SELECT date, avg(coalesce(CAST(vs_sma20 > 0 AS INTEGER), 0)) AS above_20 FROM feat GROUP BY date) USING (date) LEFT JOIN ctx USING (sector, date)")
add("j3_outer_merge", lambda s, d: t.sector_bars(s, d).groupBy("date").pivot("sector", ["AFRICA", "ASIA"]).agg(F.first("etf_close")),
    f"SELECT CAST(coalesce(a.date, b.date) AS VARCHAR) AS date, {r('a.etf_close', 'AFRICA')}, {r('b.etf_close', 'ASIA')} FROM (SELECT * FROM etf WHERE sector = 'AFRICA') a FULL JOIN (SELECT * FROM etf WHERE sector = 'ASIA') b ON a.date = b.date WHERE true UNION ALL SELECT CAST(date AS VARCHAR), NULL, NULL FROM (SELECT date FROM etf EXCEPT SELECT date FROM etf WHERE sector IN ('AFRICA', 'ASIA'))")
add("j4_one_to_one", lambda s, d: j.left_join_unique(t.table(s, d, "customer", ["c_custkey", "c_nationkey"]).withColumnRenamed("c_nationkey", "n_nationkey").groupBy("n_nationkey").count(), t.table(s, d, "nation", ["n_nationkey", "n_name"]), ["n_nationkey"]),
    "SELECT n_nationkey, n_name, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
add("j5_coalescing", lambda s, d: j.coalescing_join(base(s, d).select("symbol", "date", "r60"), base(s, d).select("symbol", "date", F.col("r20").alias("r60"), "vol20"), ["symbol", "date"]), f"SELECT {K}, {r('coalesce(r60, r20)', 'r60')}, {r('vol20')} FROM feat")
add("j6_pair_correlation", lambda s, d: base(s, d).select("symbol", "sector", "date", "r1").join(t.sector_bars(s, d).select("sector", "date", (F.col("etf_close") / F.lag("etf_close").over(Window.partitionBy("sector").orderBy("date")) - 1).alias("s1")), ["sector", "date"]).where("r1 is not null and s1 is not null").groupBy("symbol").agg(F.corr("r1", "s1").alias("corr"), F.count(F.lit(1)).alias("n")),
    f"SELECT symbol, {r('corr(r1, s1)', 'corr')}, count(*) AS n FROM feat JOIN (SELECT sector, date, etf_close / lag(etf_close) OVER (PARTITION BY sector ORDER BY date) - 1 AS s1 FROM etf) USING (sector, date) WHERE r1 IS NOT NULL AND s1 IS NOT NULL GROUP BY symbol")


def observations(s, d):
    """Sector codes seen on every seventh session of a symbol."""
    return t.panel(s, d).where("session_ix % 7 = 3 and close is not null").select("symbol", "date", F.concat("sector", F.lit("-"), F.col("session_ix")).alias("code"))


OBS = "obs AS (SELECT symbol, date AS seen, sector || '-' || session_ix AS code FROM p WHERE session_ix % 7 = 3 AND close IS NOT NULL)"
add("j7_asof", lambda s, d: j.asof(t.panel(s, d).select("symbol", "date"), observations(s, d), "symbol", "date", "date", ["code"], 40).select("symbol", "date", "code"), "")
SQL["j7_asof"] = f"{FULL}, {OBS} SELECT p.symbol, CAST(p.date AS VARCHAR) AS date, CASE WHEN date_diff('day', seen, p.date) <= 40 THEN code END AS code FROM p ASOF LEFT JOIN obs ON p.symbol = obs.symbol AND p.date >= obs.seen"
add("j8_strictly_after", lambda s, d: j.strictly_after(t.panel(s, d).select("symbol", "date"), t.panel(s, d).where("close is not null")).select("symbol", "date", "next_date", "next_close").where("next_close is not null"),
    f"SELECT symbol, {D}, CAST(nd AS VARCHAR) AS next_date, {r('nc', 'next_close')} FROM (SELECT symbol, date, lead(date) OVER w AS nd, lead(close) OVER w AS nc FROM p WHERE close IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE nc IS NOT NULL")


def membership(s, d):
    """Two intervals per nation: it leaves after 20 + 10 * (key % 7) weeks and comes back 20 weeks later, open-ended."""
    n = t.table(s, d, "nation", ["n_nationkey", "n_name"])
    start = F.to_date(F.lit("1995-01-02"))
    out = F.date_add(start, (7 * (20 + 10 * (F.col("n_nationkey") % 7))).cast("int"))
    return n.select(F.col("n_name").alias("symbol"), F.explode(F.array(F.struct(start.alias("start"), out.alias("end")), F.struct(F.date_add(out, 140).alias("start"), F.lit(None).cast("date").alias("end")))).alias("i")).select("symbol", "i.*")


MEM = """mem AS (SELECT n_name AS symbol, DATE '1995-01-02' AS a, DATE '1995-01-02' + CAST(7 * (20 + 10 * (n_nationkey % 7)) AS INTEGER) AS b FROM nation
 UNION ALL SELECT n_name, DATE '1995-01-02' + CAST(7 * (20 + 10 * (n_nationkey % 7)) + 140 AS INTEGER), NULL FROM nation)"""
add("j9_interval_join", lambda s, d: j.members(t.panel(s, d).select("symbol", "date"), membership(s, d)), "")
SQL["j9_interval_join"] = f"{FULL}, {MEM} SELECT {K} FROM p WHERE EXISTS (SELECT 1 FROM mem WHERE mem.symbol = p.symbol AND p.date >= a AND (b IS NULL OR p.date < b))"
add("j9_overlaps", lambda s, d: j.overlapping_intervals(membership(s, d).union(membership(s, d).where("end is null").withColumn("start", F.date_sub("start", 150)))).select("symbol", "start"), "")
SQL["j9_overlaps"] = f"""{FULL}, {MEM}, m2 AS (SELECT * FROM mem UNION ALL SELECT symbol, a - 150, b FROM mem WHERE b IS NULL)
 SELECT symbol, CAST(a AS VARCHAR) AS start FROM (SELECT *, max(coalesce(b, DATE '9999-12-31')) OVER (PARTITION BY symbol ORDER BY a, b NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m2) WHERE a < before"""
add("j10_semi", lambda s, d: base(s, d).select("symbol", "date", "r20").join(v.sampled_dates(t.panel(s, d), "month"), "date", "left_semi").select("symbol", "date", "r20"),
    f"SELECT {K}, {r('r20')} FROM feat WHERE date IN (SELECT min(date) FROM p GROUP BY date_trunc('month', date))")
add("j11_anti", lambda s, d: t.panel(s, d).select("symbol", "date").join(t.bars(s, d).where("volume > 100").select("symbol", "date"), ["symbol", "date"], "left_anti"),
    f"SELECT {K} FROM p WHERE NOT EXISTS (SELECT 1 FROM bars x WHERE x.symbol = p.symbol AND x.date = p.date AND x.volume > 100)")
add("j12_difference", lambda s, d: j.difference(t.bars(s, d).where("volume > 50").select("symbol", "date", "volume"), t.bars(s, d).where("volume < 300").select("symbol", "date", F.when(F.col("volume") > 200, 0.0).otherwise(F.col("volume")).alias("volume")), ["symbol", "date"], "volume").groupBy("symbol", "change").agg(F.count(F.lit(1)).alias("rows")),
    "SELECT coalesce(x.symbol, y.symbol) AS symbol, CASE WHEN x.symbol IS NULL THEN 'added' WHEN y.symbol IS NULL THEN 'removed' WHEN x.volume IS NOT DISTINCT FROM y.volume THEN 'same' ELSE 'changed' END AS change, count(*) AS rows FROM (SELECT * FROM bars WHERE volume > 50) x FULL JOIN (SELECT symbol, date, CASE WHEN volume > 200 THEN 0.0 ELSE volume END AS volume FROM bars WHERE volume < 300) y USING (symbol, date) GROUP BY ALL")
add("j13_union", lambda s, d: t.bars(s, d).select("symbol", "date", "close").unionByName(t.benchmark(s, d).select(F.lit(t.BENCHMARK).alias("symbol"), "date", F.col("bench_close").alias("close"))), f"SELECT {K}, {r('close')} FROM (SELECT symbol, date, close FROM bars UNION ALL SELECT 'BENCH', date, bench_close FROM bench)")
add("j14_key_intersection", lambda s, d: t.bars(s, d).where("volume > 50").select("symbol", "date").intersect(t.bars(s, d).where("close > 1500").select("symbol", "date")), f"SELECT {K} FROM (SELECT symbol, date FROM bars WHERE volume > 50 INTERSECT SELECT symbol, date FROM bars WHERE close > 1500)")
add("j16_aliases", lambda s, d: j.resolve_aliases(t.table(s, d, "nation").where("n_nationkey % 5 != 0").select(F.concat(F.lit("OLD_"), "n_nationkey").alias("old"), F.concat(F.lit("N_"), (F.col("n_nationkey") / 5).cast("int")).alias("new")), t.table(s, d, "nation").where("n_nationkey % 4 = 1").select(F.concat(F.lit("OLD_"), "n_nationkey").alias("symbol"))), "")
SQL["j16_aliases"] = """WITH l AS (SELECT 'OLD_' || n_nationkey AS o, 'N_' || n_nationkey // 5 AS g FROM nation WHERE n_nationkey % 5 <> 0), m AS (SELECT o AS name, g FROM l UNION SELECT g, g FROM l),
 s AS (SELECT g, min(name) AS security FROM m WHERE name IN (SELECT 'OLD_' || n_nationkey FROM nation WHERE n_nationkey % 4 = 1) GROUP BY g HAVING count(*) = 1) SELECT name, security FROM m JOIN s USING (g)"""
add("j17_keep_best", lambda s, d: j.keep_best(t.table(s, d, "orders", ["o_custkey", "o_orderkey", "o_totalprice"]), ["o_custkey"], F.desc("o_totalprice"), "o_orderkey"), "")
SQL["j17_keep_best"] = "SELECT o_custkey, o_orderkey, round(o_totalprice, 6) + 0.0 AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1"

# splits
DAYN = "dn AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))"
add("v1_embargoed_split", lambda s, d: v.embargoed_split(t.bars(s, d), 60, 60, 14), "")
SQL["v1_embargoed_split"] = f"WITH {BARS}, {DAYN} SELECT * FROM (SELECT {D}, CASE WHEN i < n - 60 - 15 - 60 - 15 THEN 'train' WHEN i >= n - 135 AND i < n - 75 THEN 'validation' WHEN i >= n - 60 THEN 'test' END AS split FROM dn) WHERE split IS NOT NULL"
add("v2_walk_forward", lambda s, d: v.walk_forward(t.bars(s, d), 3, 40, 40, 100, 14), "")
SQL["v2_walk_forward"] = f"""WITH {BARS}, {DAYN}, fo AS (SELECT unnest([1, 2, 3]) AS fold, unnest([2, 1, 0]) AS back),
 sp AS (SELECT fold, unnest(['train', 'validation', 'test']) AS split, unnest([0, -back * 40 - 95, -back * 40 - 40]) AS a, unnest([-back * 40 - 110, -back * 40 - 55, -back * 40]) AS b FROM fo)
 SELECT fold, split, {D} FROM sp JOIN dn ON i < n + b AND i >= CASE WHEN split = 'train' THEN 0 ELSE n + a END"""
for _f, _e in (("week_fri", "date_trunc('week', date + 2)"), ("month", "date_trunc('month', date)")):
    add(f"v4_sampled_{_f}", lambda s, d, _f=_f: v.sampled_dates(t.bars(s, d), _f), f"SELECT CAST(min(date) AS VARCHAR) AS date FROM bars GROUP BY {_e}")
add("v5_cohort_quarter", lambda s, d: v.sampled_dates(t.bars(s, d), "quarter"), "SELECT CAST(min(date) AS VARCHAR) AS date FROM bars GROUP BY date_trunc('quarter', date)")
add("v6_history_filter", lambda s, d: v.long_enough(t.bars(s, d), 350), "SELECT symbol, count(*) AS sessions, count(*) >= 350 AS kept FROM bars GROUP BY symbol")
add("v7_frame_contract", lambda s, d: v.frame_contract(predictions(s, d), ["symbol", "date"], ["score", "vol20"], "grade"), "SELECT 0 AS repeated_keys, count(*) FILTER (grade IS NULL) AS bad_grades, count(*) FILTER (score IS NULL) AS bad_score, count(*) FILTER (vol20 IS NULL) AS bad_vol20 FROM sc")
add("v10_outlier_cap", lambda s, d: v.without_outliers(predictions(s, d).join(v.embargoed_split(t.bars(s, d), 60, 60, 14), "date"), "outcome", 0.3).groupBy("split").agg(F.count(F.lit(1)).alias("rows")), "")
SQL["v10_outlier_cap"] = f"{FULL}, {DAYN}, s AS (SELECT date, CASE WHEN i < n - 150 THEN 'train' WHEN i >= n - 135 AND i < n - 75 THEN 'validation' WHEN i >= n - 60 THEN 'test' END AS split FROM dn) SELECT split, count(*) AS rows FROM sc JOIN s USING (date) WHERE split IS NOT NULL AND (split = 'test' OR abs(outcome) <= 0.3) GROUP BY split"

# backtests
SUMS = ", ".join([f"{r(f'avg({x})', x)}" for x in ("top_mean", "top_hit", "bottom_mean", "spread", "top_grade")] + [r(f"median({x})", f"{x}_median") for x in ("top_mean", "bottom_mean", "spread")])
DAILY = rs("top_mean", "top_median", "top_hit", "bottom_mean", "bottom_median", "top_grade", "spread", "spread_median")
add("b1_daily_baskets", lambda s, d: b.daily_baskets(predictions(s, d)), f"SELECT {D}, n, {DAILY} FROM daily")
add("b1_summary", lambda s, d: b.summary_of(b.daily_baskets(predictions(s, d))), f"SELECT count(*) AS dates, {SUMS} FROM daily")
STR = ["score", "low_vol", "short"]
LONG = """lg AS (UNPIVOT (SELECT date, symbol, sector, outcome, grade, score, low_vol, short FROM sc) ON score, low_vol, short INTO NAME strategy VALUE score),
lr AS (SELECT *, row_number() OVER (PARTITION BY strategy, date ORDER BY score DESC, symbol) AS place, count(*) OVER (PARTITION BY strategy, date) AS n FROM lg WHERE score IS NOT NULL AND outcome IS NOT NULL),
sb AS (SELECT strategy, date, avg(outcome) FILTER (place <= greatest(1, ceil(n * 0.1))) AS top_mean, avg(outcome) FILTER (place > n - greatest(1, ceil(n * 0.1))) AS bottom_mean, avg(CAST(outcome > 0 AS INTEGER)) FILTER (place <= greatest(1, ceil(n * 0.1))) AS top_hit FROM lr GROUP BY ALL),
st AS (SELECT *, top_mean - bottom_mean AS spread FROM sb)"""


def _cohorts(s, d):
    bars = t.bars(s, d)
    return {"month": v.sampled_dates(bars, "month"), "quarter": v.sampled_dates(bars, "quarter")}




def _b4(s, d):
    df = c.rank_columns(base(s, d), ["r5", "r20", "r60"], ["date"], "rank")
    last = df.agg(F.max("date")).first()[0]
    df = df.where(F.col("date") == last)
    return df.select("symbol", "r20_rank", b.agreement(F.col("r20_rank"), F.col("r60_rank"), F.col("r5_rank")).alias("label")).orderBy(F.desc_nulls_last("r20_rank"), "symbol").limit(10)


add("b4_agreement", _b4, f"""SELECT symbol, {r('m', 'r20_rank')}, CASE WHEN m >= 0.9 AND x >= 0.7 THEN 'Consensus Long-Horizon Candidate' WHEN m >= 0.9 AND y >= 0.7 THEN 'Model Candidate With Classic Momentum' WHEN m >= 0.9 THEN 'Model-Only Candidate' WHEN x >= 0.9 THEN 'Rules Candidate' ELSE 'Monitor' END AS label
 FROM (SELECT symbol, {pct('r20', 'date')} AS m, {pct('r60', 'date')} AS x, {pct('r5', 'date')} AS y FROM feat WHERE date = (SELECT max(date) FROM feat)) ORDER BY m DESC NULLS LAST, symbol LIMIT 10""")
DEC = "(SELECT date, decile, count(*) AS names, avg(outcome) AS mean, median(outcome) AS median, avg(CAST(outcome > 0 AS INTEGER)) AS hit, avg(score) AS score FROM dc GROUP BY ALL)"
add("b6_buckets", lambda s, d: b.bucket_summary(predictions(s, d)), f"SELECT decile, count(*) AS dates, {r('avg(names)', 'names')}, {r('avg(mean)', 'mean')}, {r('avg(median)', 'median')}, {r('avg(hit)', 'hit')} FROM {DEC} GROUP BY decile")
add("b7_max_drawdown", lambda s, d: b.max_drawdown(b.strategy_baskets(predictions(s, d), STR).withColumn("x", b.daily_equivalent(F.col("top_mean"), 14)), "x", ["strategy"]), "")
SQL["b7_max_drawdown"] = f"{FULL}, {LONG}, eq AS (SELECT strategy, date, exp(sum(ln(pow(greatest(1 + top_mean, 0.01), 1.0 / 14))) OVER (PARTITION BY strategy ORDER BY date)) AS e FROM st) SELECT strategy, {r('min(e / m - 1)', 'max_drawdown')} FROM (SELECT *, max(e) OVER (PARTITION BY strategy ORDER BY date) AS m FROM eq) GROUP BY strategy"
add("b8_turnover", lambda s, d: b.turnover(predictions(s, d).where("outcome is not null")), f"SELECT {D}, {r('CASE WHEN p IS NOT NULL THEN 1 - len(list_intersect(a, p)) / len(a) END', 'turnover')} FROM (SELECT *, lag(a) OVER (ORDER BY date) AS p FROM (SELECT date, list(symbol) AS a FROM rk WHERE place <= greatest(1, ceil(n * 0.1)) GROUP BY date))")
add("b9_offsets", lambda s, d: b.offset_summary(b.daily_baskets(predictions(s, d)), 14), f"SELECT o AS \"offset\", count(*) AS periods, {r('avg(top_mean)', 'mean')}, {r('product(greatest(1 + top_mean, 0.01)) - 1', 'compounded', 4)} FROM (SELECT *, (row_number() OVER (ORDER BY date) - 1) % 14 AS o FROM daily) GROUP BY o", 4)
SQL["b9_offsets"] = SQL["b9_offsets"].replace("round(avg(top_mean), 6)", "round(avg(top_mean), 4)")
add("b12_describe", lambda s, d: b.describe(predictions(s, d), "outcome", ["sector"]), f"SELECT sector, count(*) AS n, {r('avg(outcome)', 'mean')}, {r('median(outcome)', 'median')}, {r('avg(CAST(outcome > 0 AS INTEGER))', 'hit')}, {r('quantile_cont(outcome, 0.25)', 'p25')}, {r('quantile_cont(outcome, 0.75)', 'p75')} FROM sc WHERE outcome IS NOT NULL GROUP BY sector")
add("b13_auc", lambda s, d: b.auc(predictions(s, d), ["sector"]), f"SELECT sector, sum(y) AS pos, sum(1 - y) AS neg, {r('(sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y))', 'auc')} FROM (SELECT sector, CAST(outcome > 0 AS INTEGER) AS y, rank() OVER (PARTITION BY sector ORDER BY score) + (count(*) OVER (PARTITION BY sector, score) - 1) / 2.0 AS k FROM kn) GROUP BY sector")
SQL["b13_auc"] = SQL["b13_auc"].replace("sum(y) AS pos, sum(1 - y) AS neg", "CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg")
add("b14_top_quartile", lambda s, d: b.daily_baskets(predictions(s, d), 0.25).select("date", "top_mean", "bottom_mean"), f"SELECT {D}, {r('avg(outcome) FILTER (place <= greatest(1, ceil(n * 0.25)))', 'top_mean')}, {r('avg(outcome) FILTER (place > n - greatest(1, ceil(n * 0.25)))', 'bottom_mean')} FROM rk GROUP BY date")
add("b16_known_baskets", lambda s, d: b.known_baskets(predictions(s, d)), f"SELECT {D}, count(*) AS members, count(outcome) AS known, {r('CASE WHEN count(outcome) = count(*) THEN avg(outcome) END', 'top_mean')} FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS q, count(*) OVER (PARTITION BY date) AS m FROM sc WHERE score IS NOT NULL) WHERE q <= greatest(1, ceil(m * 0.1)) GROUP BY date")
add("b17_paired", lambda s, d: b.paired(b.strategy_baskets(predictions(s, d), STR), STR), "")
PIV = "(SELECT date, max(spread) FILTER (strategy = 'score') AS score, max(spread) FILTER (strategy = 'low_vol') AS low_vol, max(spread) FILTER (strategy = 'short') AS short FROM st GROUP BY date HAVING count(spread) = 3)"
SQL["b17_paired"] = f"{FULL}, {LONG} SELECT {D}, {rs('score', 'low_vol', 'short')} FROM {PIV}"
add("b19_winsorised", lambda s, d: b.winsorised(predictions(s, d), "outcome", ["sector"]), f"""SELECT sector, {r('avg(least(greatest(outcome, lo), hi))', 'winsorised_mean')}, {r('sum(outcome) FILTER (k <= 5 AND outcome > 0) / sum(outcome) FILTER (outcome > 0)', 'top5_share')}
 FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY outcome DESC, symbol, date) AS k, quantile_cont(outcome, 0.05) OVER (PARTITION BY sector) AS lo, quantile_cont(outcome, 0.95) OVER (PARTITION BY sector) AS hi FROM sc WHERE outcome IS NOT NULL) GROUP BY sector""")
add("b20_decile_daily", lambda s, d: b.decile_daily(predictions(s, d)), f"SELECT {D}, decile, names, {rs('score', 'mean', 'median')} FROM {DEC}")
add("b20_decile_spreads", lambda s, d: b.decile_spreads(predictions(s, d)).select("date", "spread", "spread_median"), f"SELECT {D}, {r('arg_max(mean, decile) - arg_min(mean, decile)', 'spread')}, {r('arg_max(median, decile) - arg_min(median, decile)', 'spread_median')} FROM {DEC} GROUP BY date")
add("b21_segments", lambda s, d: b.segments(predictions(s, d)), f"""SELECT segment, count(*) AS dates, {r('avg(c)', 'names')}, {r('avg(m)', 'mean')}, {r('median(m)', 'median')} FROM (SELECT segment, date, avg(outcome) AS m, count(*) AS c FROM (
 SELECT 'top_5' AS segment, date, outcome FROM dc WHERE place <= 5 UNION ALL SELECT 'top_10', date, outcome FROM dc WHERE place <= 10
 UNION ALL SELECT 'top_decile', date, outcome FROM dc QUALIFY decile = max(decile) OVER (PARTITION BY date) UNION ALL SELECT 'bottom_decile', date, outcome FROM dc QUALIFY decile = min(decile) OVER (PARTITION BY date)) GROUP BY ALL) GROUP BY segment""")
add("b22_spearman", lambda s, d: b.spearman(b.decile_daily(predictions(s, d)).withColumn("decile", F.col("decile").cast("double")), "decile", "mean", ["date"]),
    f"SELECT {D}, count(*) AS n, {r('corr(x, y)', 'spearman')} FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY decile) + (count(*) OVER (PARTITION BY date, decile) - 1) / 2.0 AS x, rank() OVER (PARTITION BY date ORDER BY mean) + (count(*) OVER (PARTITION BY date, mean) - 1) / 2.0 AS y FROM {DEC}) GROUP BY date")
add("b24_health", lambda s, d: b.health(b.daily_baskets(predictions(s, d))), "SELECT passed, CASE WHEN passed >= 5 THEN 'Healthy' WHEN passed >= 3 THEN 'Watch' ELSE 'Deteriorating' END AS status FROM (SELECT CAST(avg(top_mean) > 0 AS INTEGER) + CAST(avg(top_median) > 0 AS INTEGER) + CAST(avg(spread) > 0 AS INTEGER) + CAST(avg(spread_median) > 0 AS INTEGER) + CAST(avg(top_hit) >= 0.52 AS INTEGER) + CAST(avg(CAST(spread > 0 AS INTEGER)) >= 0.7 AS INTEGER) AS passed FROM daily)")
add("b25_recent_window", lambda s, d: b.recent_window(predictions(s, d), 60).select("symbol", "date", "outcome"), f"SELECT {K}, {r('outcome')} FROM sc WHERE outcome IS NOT NULL AND date IN (SELECT date FROM sc WHERE outcome IS NOT NULL GROUP BY date ORDER BY date DESC LIMIT 60)")
add("b26_best_strategy", lambda s, d: b.best_strategy(b.strategy_baskets(predictions(s, d), STR), STR), "")
SQL["b26_best_strategy"] = f"{FULL}, {LONG} SELECT strategy, {r('avg(v)', 'mean')}, {r('median(v)', 'median')}, count(*) AS dates FROM (UNPIVOT {PIV} ON score, low_vol, short INTO NAME strategy VALUE v) GROUP BY strategy ORDER BY avg(v) DESC, median(v) DESC, strategy LIMIT 1"
add("b27_overlap", lambda s, d: b.score_overlap(predictions(s, d), "score", "short").select("date", "overlap"), f"""SELECT CAST(x.date AS VARCHAR) AS date, {r('len(list_intersect(x.a, y.a)) / len(x.a)', 'overlap')} FROM
 (SELECT date, list(symbol) AS a FROM (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS q, count(*) OVER (PARTITION BY date) AS m FROM sc WHERE score IS NOT NULL) WHERE q <= greatest(1, ceil(m * 0.1)) GROUP BY date) x JOIN
 (SELECT date, list(symbol) AS a FROM (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY short DESC, symbol) AS q, count(*) OVER (PARTITION BY date) AS m FROM sc WHERE short IS NOT NULL) WHERE q <= greatest(1, ceil(m * 0.1)) GROUP BY date) y USING (date)
 WHERE EXISTS (SELECT 1 FROM sc z WHERE z.date = x.date AND score IS NOT NULL AND short IS NOT NULL)""")


def _b28(s, d):
    p = predictions(s, d).select("symbol", "date", "score", "outcome")
    cut = p.where("month(date) != 3").withColumns({"score": F.when(F.col("symbol") != "NATION_1", F.col("score")), "outcome": F.when(F.month("date") != 6, F.col("outcome"))})
    return b.treatment_check(p, cut, ["score", "outcome"])


add("b28_treatment", _b28, "SELECT count(*) AS rows, count(*) FILTER (month(date) = 3) AS removed, count(*) FILTER (month(date) <> 3 AND symbol = 'NATION_1' AND score IS NOT NULL) AS changed_score, count(*) FILTER (month(date) = 6 AND outcome IS NOT NULL) AS changed_outcome, count(*) FILTER (month(date) = 6 AND outcome IS NOT NULL) AS newly_unknown FROM sc")


def _b11(s, d):
    p = predictions(s, d)
    days = t.sessions(t.bars(s, d))
    ctx = t.sector_bars(s, d).join(F.broadcast(days), "date").select("sector", "session_ix", "etf_close")
    rows = p.where("score is not null and score < 0 and vs_sma20 < 0").select("symbol", "sector", "date", "session_ix", "close", "vol20")
    out = b.activation_grid(rows, p.select("symbol", "session_ix", "close"), ctx, [0.25, 0.5, 0.75], [3, 5])
    return b.describe(out, "outcome", ["multiple", "window"])


add("b11_activation_grid", _b11, f"""SELECT multiple, win AS "window", count(*) AS n, {r('avg(o)', 'mean')}, {r('median(o)', 'median')}, {r('avg(CAST(o > 0 AS INTEGER))', 'hit')}, {r('quantile_cont(o, 0.25)', 'p25')}, {r('quantile_cont(o, 0.75)', 'p75')} FROM (
 SELECT multiple, win, x.close / f.c - 1 - coalesce(e1.etf_close / e0.etf_close - 1, 0) - 0.0015 AS o FROM (
 SELECT a.symbol, a.sector, a.session_ix, m.multiple, w.win, min(b.session_ix) AS s, arg_min(b.close, b.session_ix) AS c FROM (SELECT * FROM sc WHERE score < 0 AND vs_sma20 < 0) a
 JOIN (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS multiple) m ON true JOIN (SELECT unnest([3, 5]) AS win) w ON true JOIN sc b ON b.symbol = a.symbol AND b.session_ix BETWEEN a.session_ix + 1 AND a.session_ix + w.win AND b.close >= a.close * (1 + m.multiple * a.vol20) GROUP BY ALL) f
 JOIN sc x ON x.symbol = f.symbol AND x.session_ix = f.s + 14
 LEFT JOIN (SELECT * FROM etf JOIN days USING (date)) e0 ON e0.sector = f.sector AND e0.session_ix = f.s LEFT JOIN (SELECT * FROM etf JOIN days USING (date)) e1 ON e1.sector = f.sector AND e1.session_ix = f.s + 14)
 WHERE o IS NOT NULL GROUP BY multiple, win""")
add("b23_entrants", lambda s, d: b.entrants(predictions(s, d)), "")
SQL["b23_entrants"] = f"""{FULL}, e0 AS (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS place, count(*) OVER (PARTITION BY date) AS n FROM sc WHERE score IS NOT NULL),
e1 AS (SELECT *, CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ceil(least(n, 10) * (place - 1) / (n - 1))) END AS decile, n - place + 1 AS rank, dense_rank() OVER (ORDER BY date DESC) - 1 AS back FROM e0),
e2 AS (SELECT *, decile = (SELECT max(decile) FROM e1 WHERE back = 0) AS top, row_number() OVER (PARTITION BY symbol ORDER BY back) AS seq FROM e1),
e3 AS (SELECT symbol, max(rank) FILTER (back = 0) AS rank, bool_or(top) FILTER (back = 0) AS now, coalesce(bool_or(top) FILTER (back = 1), false) AS then1, coalesce(bool_or(top) FILTER (back = 5), false) AS then5, max(rank) FILTER (back = 1) AS r1, max(rank) FILTER (back = 5) AS r5, max(rank) FILTER (back = 10) AS r10,
 coalesce(min(seq) FILTER (NOT top), count(*) + 1) - 1 AS streak, min(date) FILTER (top) AS first FROM e2 GROUP BY symbol)
SELECT symbol, rank, r1 AS prior_1_rank, r5 AS prior_n_rank, r10 AS prior_10_rank, streak, CAST(first AS VARCHAR) AS first_top_date,
 CASE WHEN NOT then1 THEN 'New since prior scoring date' WHEN NOT then5 THEN 'New within 5 scoring dates' WHEN r5 - rank >= 10 THEN 'Rank improved ' || (r5 - rank) ELSE 'Existing top-decile constituent' END AS reason FROM e3 WHERE now"""
