"""Queries of raw forms, releases, contracts and model experiments (S, P, V, B, H, D, M, K, T) and their SQL.

Raw forms (CSV folders, payloads, pages, feeds) are made of the given tables by Spark, written to the shared folder
where the reader wants files, and read back.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.semantics import rounded
from panelforge.operators import backtest as b
from panelforge.operators import cross_section as c
from panelforge.operators import features as f
from panelforge.operators import model as m
from panelforge.operators import quality as qa
from panelforge.operators import scorebook as k
from panelforge.operators import splits as v
from panelforge.operators import tape
from panelforge.operators import text as tx
from panelforge.plans.history_queries import LIVE, _SET, live, top
from panelforge.plans.panel_queries import DDQ, EXC, LONG, STR, _cohorts, _l6, base, predictions
from panelforge.plans.sqlparts import ALL, BARS, D, FULL, r
from panelforge.plans.stream_queries import shared_folder
from panelforge.sources import readers as rd
from panelforge.sources import tables as t
from panelforge.sources.shared import durable

QUERIES, SQL = {}, {}


def add(name, run, sql=None):
    QUERIES[name] = lambda s, d: rounded(run(s, d))
    if sql:
        SQL[name] = sql


def letters(x):
    """Digits as letters, so that keys can be symbols."""
    return F.translate(x.cast("string"), "0123456789", "ABCDEFGHIJ")


LET = "translate(CAST({} AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"


# S: files, pages and payloads
def _s1(s, d):
    at = shared_folder(s)
    bars = t.panel(s, d).where("close is not null").select("symbol", F.col("date").cast("string").alias("date"), "open", "high", "low", F.when(F.col("session_ix") % 17 == 0, F.lit("n/a")).otherwise(F.col("close").cast("string")).alias("close"), "volume")
    bars.write.partitionBy("symbol").option("header", True).csv(at)
    return rd.bars_csv(s, at, r"symbol=([^/]+)/")


add("s1_bars_csv", _s1, f"{ALL} SELECT symbol, {D}, {r('open')}, {r('high')}, {r('low')}, {r('CASE WHEN session_ix % 17 <> 0 THEN close END', 'close')}, {r('volume')} FROM p WHERE close IS NOT NULL")


def _s4(s, d):
    at = shared_folder(s)
    t.sector_bars(s, d).select(F.translate("sector", " ", "_").alias("series_id"), F.col("date").cast("string").alias("observation_date"), F.when(F.dayofmonth("date") % 5 == 0, F.lit(".")).otherwise(F.col("etf_close").cast("string")).alias("value")).write.partitionBy("series_id").option("header", True).csv(at)
    return rd.macro_csv(s, at, r"series_id=([^/]+)/")


add("s4_macro_csv", _s4, f"{ALL} SELECT translate(sector, ' ', '_') AS series_id, {D}, {r('etf_close', 'value')} FROM etf WHERE day(date) % 5 <> 0")
add("s5_constituents", lambda s, d: rd.constituents(t.table(s, d, "customer").select((F.col("c_custkey") % 50).alias("page_id"), F.concat(F.lit("<tr class='x'><td><a href='/q'>"), letters(F.col("c_custkey")), F.lit("</a></td>\n<td>"), "c_name", F.lit(" &amp; Co</td><td>"), "c_mktsegment", F.lit("</td><td>N"), F.col("c_nationkey").cast("string"), F.lit("</td></tr>")).alias("row")).groupBy("page_id").agg(F.concat(F.lit("<table><tr><th>Symbol</th></tr>"), F.array_join(F.collect_list("row"), "\n"), F.lit("</table>")).alias("html")), 100),
    f"SELECT {LET.format('c_custkey')} AS symbol, c_name || ' & Co' AS name, c_mktsegment AS sector, 'N' || c_nationkey AS sub_industry FROM customer WHERE length(CAST(c_custkey AS VARCHAR)) <= 6")
add("s8_pruned_read", lambda s, d: t.table(s, d, "orders", ["o_orderkey", "o_totalprice"]), f"SELECT o_orderkey, {r('o_totalprice')} FROM orders")


def _s10(s, d):
    at = shared_folder(s)
    c_ = t.table(s, d, "customer")
    c_.groupBy((F.col("c_custkey") % 64).alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("c_name").alias("symbol"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("value"))).alias("events"))).alias("value")).repartition("part").write.partitionBy("part").text(at)
    return rd.registry(s, at, "events array<struct<symbol:string,kind:string,value:double>>", "events")


add("s10_registries", _s10, f"SELECT c_name AS symbol, c_mktsegment AS kind, {r('c_acctbal', 'value')} FROM customer")


def _feeds(s, d):
    """Orders as the items of one feed a customer, RSS for even customers, Atom for odd ones."""
    key = F.col("o_orderkey").cast("string")
    title = F.concat(F.col("o_orderpriority"), F.lit(" &amp; "), key)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    body = F.concat(F.repeat(F.lit("word "), 100), key)
    rss = F.concat(F.lit("<item><title><![CDATA["), title, F.lit("]]></title><link>u"), key, F.lit("</link><pubDate>"), day, F.lit("</pubDate><description>"), body, F.lit("</description></item>"))
    atom = F.concat(F.lit("<entry><id>p"), key, F.lit("</id><title>"), title, F.lit('</title><link rel="alternate" href="u'), key, F.lit('"/><updated>'), day, F.lit("</updated><summary>"), body, F.lit("</summary></entry>"))
    items = t.table(s, d, "orders").select(F.col("o_custkey").alias("feed_id"), "o_orderkey", F.when(F.col("o_custkey") % 2 == 0, rss).otherwise(atom).alias("item"))
    return items.groupBy("feed_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "item"))), lambda x: x["item"]), "\n").alias("body"))


_ORD = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderpriority || ' & ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS day, repeat('word ', 100) || o_orderkey AS body FROM orders)"
add("s11_feed_items", lambda s, d: tx.feed_items(_feeds(s, d)).select("feed_id", "pos", "title", "link", "date", "summary", "excerpt"),
    f"SELECT o_custkey AS feed_id, CAST(pos AS INTEGER) AS pos, title, 'u' || o_orderkey AS link, day AS date, left(body, 420) AS summary, left(body, 1800) AS excerpt FROM {_ORD}")
add("s12_markdown", lambda s, d: tx.markdown_rows(t.table(s, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.when(F.col("s_suppkey") % 10 == 0, "| --- | :---: |").when(F.col("s_suppkey") % 10 == 1, "Some prose | here").when(F.col("s_suppkey") % 10 == 2, "| Name | Balance |").otherwise(F.concat(F.lit("| "), "s_name", F.lit(" | N"), "s_nationkey", F.lit(" |"))).alias("line"))).select("pos", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("nation")),
    "SELECT s_suppkey AS pos, s_name AS name, 'N' || s_nationkey AS nation FROM supplier WHERE s_suppkey % 10 > 2")


def _s13(s, d):
    e = t.table(s, d, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    post = F.struct(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("title"), F.lit("body").alias("selftext"), (F.col("user_id") % 90).alias("score"), (F.col("user_id") % 7).alias("num_comments"), F.unix_timestamp("ts").cast("double").alias("created_utc")).alias("data"))
    js = e.where("user_id % 2 = 0").groupBy("user_id").agg(F.to_json(F.struct(F.struct(F.collect_list(post).alias("children")).alias("data"))).alias("body"))
    entry = F.concat(F.lit("<entry><id>"), F.col("event_id").cast("string"), F.lit("</id><title>"), "event_type", F.lit("</title><content type=\"html\">body</content><updated>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("</updated></entry>"))
    atom = e.where("user_id % 2 = 1").groupBy(F.col("user_id").alias("feed_id")).agg(F.array_join(F.collect_list(entry), "").alias("body"))
    posts = rd.forum_posts(js).unionByName(tx.forum_entries(atom))
    return posts.withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


add("s13_forum_posts", _s13, "SELECT CAST(event_id AS VARCHAR) AS post_id, event_type AS title, 'body' AS body, CASE WHEN user_id % 2 = 0 THEN user_id % 90 END AS score, CASE WHEN user_id % 2 = 0 THEN user_id % 7 END AS comments, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS created FROM events")


def _s14(s, d):
    q = F.struct(F.concat(letters(F.col("s_suppkey")), F.lit(".b")).alias("symbol"), F.col("s_name").alias("shortName"), F.col("s_acctbal").alias("regularMarketPrice"), (F.col("s_acctbal") / 100).alias("regularMarketChangePercent"), (F.col("s_suppkey") * 1.0).alias("regularMarketVolume"))
    bucket = F.when(F.col("s_suppkey") % 3 == 0, "most_actives").when(F.col("s_acctbal") < 0, "day_losers").otherwise("day_gainers")
    g = t.table(s, d, "supplier").groupBy("s_nationkey", bucket.alias("id")).agg(F.collect_list(q).alias("quotes"))
    g = g.groupBy("s_nationkey").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("id", "quotes")).alias("result")).alias("finance"))).alias("body"))
    return rd.movers(g)


add("s14_movers", _s14, f"SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'most_actives' WHEN s_acctbal < 0 THEN 'day_losers' ELSE 'day_gainers' END AS bucket, {LET.format('s_suppkey')} || '-B' AS symbol, s_name AS name, {r('s_acctbal', 'price')}, {r('s_acctbal / 100', 'change')}, CAST(s_suppkey AS DOUBLE) AS volume FROM supplier")


def _s15(s, d):
    row = F.struct(F.col("o_orderkey").cast("string").alias("symbol"), F.col("o_orderpriority").alias("name"), F.lit("time-pre-market").alias("time"), F.col("o_orderstatus").alias("epsForecast"), F.col("o_custkey").cast("string").alias("noOfEsts"))
    # a payload a day and million keys, so that none grows with the table
    days = t.table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.expr("o_orderkey div 1000000").alias("part")).agg(F.collect_list(row).alias("rows"))
    as_of = F.when(F.dayofmonth("date") % 2 == 0, F.date_format("date", "MMM d, yyyy"))
    return rd.earnings_calendar(days.select("date", F.to_json(F.struct(F.struct(as_of.alias("asOf"), "rows").alias("data"))).alias("body"))).select("date", "as_of", "symbol", "name", "time", "epsForecast", "noOfEsts", "lastYearEps")


add("s15_earnings_calendar", _s15, f"SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN day(o_orderdate) % 2 = 0 THEN strftime(o_orderdate, '%b %-d, %Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS as_of, CAST(o_orderkey AS VARCHAR) AS symbol, o_orderpriority AS name, 'time-pre-market' AS time, o_orderstatus AS \"epsForecast\", CAST(o_custkey AS VARCHAR) AS \"noOfEsts\", CAST(NULL AS VARCHAR) AS \"lastYearEps\" FROM orders")
_FIRST, _LAST = "1997-01-01", "1999-12-31"


def _pages(s, d, item):
    return t.table(s, d, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.collect_list(item), "\n").alias("html"))


def _s17_fred(s, d):
    item = F.concat(F.lit('<tr><td><span style="font-weight: bold;">'), F.date_format("o_orderdate", "MMMM dd, yyyy"), F.lit("</span></td></tr><tr><td class='x'> "), F.when(F.col("o_orderkey") % 2 == 0, "7:30 am").otherwise("12:00 pm"), F.lit(' </td><td><a href="/release?rid=10">Index '), F.col("o_orderkey").cast("string"), F.lit("</a></td></tr>"))
    return rd.fred_calendar(_pages(s, d, item), _FIRST, _LAST)


_IN = f"CAST(o_orderdate AS DATE) BETWEEN DATE '{_FIRST}' AND DATE '{_LAST}'"
add("s17_fred_calendar", _s17_fred, f"SELECT o_custkey AS page_id, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 2 = 0 THEN '8:30 AM ET' ELSE '1:00 PM ET' END AS time, 'Index ' || o_orderkey AS title FROM orders WHERE {_IN}")


def _s17_bea(s, d):
    title = F.element_at(F.array(*map(F.lit, ("GDP (Advance Estimate), 1st Quarter", "Personal Income and Outlays, May", "U.S. Trade in Goods", "GDP by State", "GDP (Third Estimate)"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    item = F.concat(F.lit('<tr class="r"><td><div class="release-date">'), F.date_format("o_orderdate", "MMMM d"), F.lit('</div> <small class="text-muted">8:30  AM</small></td><td class="release-title views-field">'), title, F.lit(" <b>#"), F.col("o_orderkey").cast("string"), F.lit("</b></td></tr>"))
    year = F.year("o_orderdate")
    pages = t.table(s, d, "orders").groupBy((F.col("o_custkey") * 10000 + year).alias("page_id"), year.alias("y")).agg(F.array_join(F.collect_list(item), "\n").alias("rows"))
    return rd.bea_calendar(pages.select("page_id", F.concat(F.lit("<table><th> Year "), F.col("y").cast("string"), F.lit("</th>"), "rows", F.lit("</table>")).alias("html")), _FIRST, _LAST)


add("s17_bea_calendar", _s17_bea, f"""SELECT o_custkey * 10000 + year(o_orderdate) AS page_id, strftime(o_orderdate, '%Y-%m-%d') AS date, '8:30 AM ET' AS time, ['GDP Advance Estimate', 'Personal Income and Outlays', '', 'Gross Domestic Product', 'GDP Third Estimate'][o_orderkey % 5 + 1] AS event,
 ['GDP (Advance Estimate), 1st Quarter', 'Personal Income and Outlays, May', '', 'GDP by State', 'GDP (Third Estimate)'][o_orderkey % 5 + 1] || ' #' || o_orderkey AS title FROM orders WHERE o_orderkey % 5 <> 2 AND {_IN}""")


def _s17_fomc(s, d):
    day = F.dayofmonth("o_orderdate")
    days = F.concat(F.when(day > 1, F.concat((day - 1).cast("string"), F.lit("-"))).otherwise(F.lit("")), day.cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "*").otherwise(""))
    item = F.concat(F.lit('<div class="fomc-meeting__month col"><strong>'), F.date_format("o_orderdate", "MMMM"), F.lit('</strong></div><div class="fomc-meeting__date col">'), days, F.lit("</div>"))
    panels = t.table(s, d, "orders").groupBy(F.col("o_custkey").alias("page_id"), F.year("o_orderdate").alias("y")).agg(F.array_join(F.collect_list(item), "\n").alias("rows"))
    panel = F.concat(F.lit('<div class="panel panel-default"><div class="panel-heading"><h4><a id="x">'), F.col("y").cast("string"), F.lit(" FOMC Meetings</a></h4></div>"), "rows", F.lit("</div>"))
    return rd.fomc_calendar(panels.groupBy("page_id").agg(F.array_join(F.collect_list(panel), "\n").alias("html")), _FIRST, _LAST)


_DAYS = "CASE WHEN day(o_orderdate) > 1 THEN (day(o_orderdate) - 1) || '-' ELSE '' END || day(o_orderdate) || CASE WHEN o_orderkey % 3 = 0 THEN '*' ELSE '' END"
add("s17_fomc_calendar", _s17_fomc, f"SELECT o_custkey AS page_id, strftime(o_orderdate, '%Y-%m-%d') AS date, 'FOMC meeting decision (' || strftime(o_orderdate, '%B') || ' ' || {_DAYS} || ', ' || year(o_orderdate) || ')' AS title, o_orderkey % 3 = 0 AS projections FROM orders WHERE {_IN}")
add("s18_company_news", lambda s, d: tx.company_news(_feeds(s, d)), f"SELECT o_custkey AS symbol, o_custkey || '-N' || (pos + 1) AS item, title, 'u' || o_orderkey AS link, day AS date, left(body, 280) AS summary FROM {_ORD} WHERE pos < 8")


def _s22(s, d):
    bal = F.col("s_acctbal")
    tree = F.struct(F.array(F.lit(1), F.lit(-1), F.lit(-1)).alias("left_children"), F.array(F.lit(2), F.lit(-1), F.lit(-1)).alias("right_children"), F.array((F.col("s_suppkey") % 5).cast("int"), F.lit(0), F.lit(0)).alias("split_indices"), F.array(bal, F.lit(-0.5), F.lit(0.5)).alias("split_conditions"), F.array((F.col("s_suppkey") % 2).cast("int"), F.lit(0), F.lit(0)).alias("default_left"), F.array(bal / 2, F.lit(0.0), F.lit(0.0)).alias("loss_changes"), F.array(F.lit(10.0), F.lit(4.0), F.lit(6.0)).alias("sum_hessian"))
    g = t.table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("model")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", tree.alias("t")))), lambda x: x["t"]).alias("trees"))
    return rd.saved_trees(g.select("model", F.to_json(F.struct(F.struct(F.struct(F.struct("trees").alias("model")).alias("gradient_booster")).alias("learner"))).alias("body")))


add("s22_saved_trees", _s22, f"""WITH x AS (SELECT s_nationkey AS model, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS tree, s_suppkey, s_acctbal FROM supplier)
 SELECT model, tree, node, CASE WHEN node = 0 THEN CAST(s_suppkey % 5 AS INTEGER) ELSE 0 END AS split_index, {r('CASE node WHEN 0 THEN s_acctbal WHEN 1 THEN -0.5 ELSE 0.5 END', 'condition')}, CASE WHEN node = 0 THEN 1 ELSE -1 END AS "left", CASE WHEN node = 0 THEN 2 ELSE -1 END AS "right", node = 0 AND s_suppkey % 2 = 1 AS default_left, {r('CASE WHEN node = 0 THEN s_acctbal / 2 ELSE 0 END', 'gain')}, node > 0 AS leaf, CASE node WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 4.0 ELSE 6.0 END AS cover FROM x CROSS JOIN (SELECT unnest([0, 1, 2]) AS node)""")


def _s24(s, d):
    at = shared_folder(s)
    rd.write_reference(t.bars(s, d).select("symbol", "date", "close"), at, "v2", "2000-01-03")
    return rd.check_reference(s.read.parquet(at), "v2", "2000-01-03")


add("s24_reference_cache", _s24, f"{ALL} SELECT symbol, {D}, {r('close')}, '2000-01-03' AS as_of FROM bars")

# T: signals and releases
add("t18_release_metrics", lambda s, d: tape.release_metrics(t.table(s, d, "part").select(F.col("p_partkey").alias("release_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Total nonfarm payroll employment rose by "), F.format_number(F.col("p_partkey") * 1000, 0), F.lit(" in May."))).otherwise(F.concat(F.when(F.col("p_partkey") % 3 == 1, "The Consumer Price Index ").otherwise("The Producer Price Index "), F.when(F.col("p_size") % 2 == 0, "rose ").otherwise("declined "), F.format_string("0.%d percent; the index rose %d.%d percent over the last 12 months.", F.col("p_size") % 8, F.col("p_size") % 6, F.col("p_size") % 10))).alias("text"))).select("release_id", "kind", "mom", "yoy", "payrolls", "tone"),
    f"""SELECT p_partkey AS release_id, CASE p_partkey % 3 WHEN 0 THEN 'payrolls' WHEN 1 THEN 'cpi' ELSE 'ppi' END AS kind, {r('m', 'mom')}, {r('CASE WHEN p_partkey % 3 <> 0 THEN p_size % 6 + (p_size % 10) / 10.0 END', 'yoy')}, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 1000 END AS payrolls,
 CASE WHEN m >= 0.4 THEN 'hot' WHEN m <= 0.1 THEN 'cooler' ELSE 'in line' END AS tone FROM (SELECT *, CASE WHEN p_partkey % 3 <> 0 THEN CAST((p_size % 8) / 10.0 * CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END AS DOUBLE) END AS m FROM part)""")

# P, V, B, H, D: contracts and comparisons
_DROPPED = ["^r[0-9]", "_chg_[15]$"]
add("p11_feature_groups", lambda s, d: base(s, d).select("symbol", "date", *tape.without_groups(["r5", "r20", "r60", "vol20", "vs_sma20", "vs_sma50", "volume_ratio"], _DROPPED)), f"{FULL} SELECT symbol, {D}, {r('vol20')}, {r('vs_sma20')}, {r('vs_sma50')}, {r('volume_ratio')} FROM feat")
add("v3_embargo", lambda s, d: v.embargoed_split(t.bars(s, d), 40, 40, v.horizon_of("forward_return_14d_next_close")).groupBy("split").agg(F.count(F.lit(1)).alias("dates"), F.min("date").alias("first"), F.max("date").alias("last")),
    f"WITH {BARS}, dn AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)) SELECT split, count(*) AS dates, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last FROM (SELECT date, CASE WHEN i < n - 110 THEN 'train' WHEN i >= n - 95 AND i < n - 55 THEN 'validation' WHEN i >= n - 40 THEN 'test' END AS split FROM dn) WHERE split IS NOT NULL GROUP BY split")


def _v9(s, d):
    import datetime as dt

    days = v.embargoed_split(t.bars(s, d), 60, 60, 14)
    end = days.where("split = 'train'").agg(F.max("date")).first()[0]
    return predictions(s, d).where(F.col("score").isNotNull() & (F.col("date") >= F.lit(v.strict_start(dt.date(1999, 3, 31), end)))).groupBy("date").agg(F.count(F.lit(1)).alias("names"), F.count("outcome").alias("known"))


add("v9_strict_start", _v9, f"{FULL}, dn AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)) SELECT {D}, count(*) AS names, count(outcome) AS known FROM sc WHERE score IS NOT NULL AND date >= greatest(DATE '1999-03-31', (SELECT max(date) FROM dn WHERE i < n - 150)) + 1 GROUP BY date")
add("b10_compounded", lambda s, d: b.compounded(b.strategy_baskets(predictions(s, d), STR), "top_mean", 14, ["strategy"]), f"{FULL}, {LONG} SELECT strategy, count(*) AS dates, {r('avg(e - 1)', 'mean_daily')}, {r('product(e) - 1', 'compounded')} FROM (SELECT strategy, pow(greatest(1 + top_mean, 0.01), 1.0 / 14) AS e FROM st WHERE top_mean IS NOT NULL) GROUP BY strategy")


def _b15(s, d):
    p = predictions(s, d).select("symbol", "date", "score", "outcome").join(_l6(s, d), ["symbol", "date"])
    p = p.join(c.path_drawdown(t.panel(s, d)).select("symbol", "date", "max_drawdown"), ["symbol", "date"])
    return b.label_comparison(p, _cohorts(s, d) | {"daily": t.bars(s, d).select("date").distinct()}, ["adjusted_return", "max_drawdown", "relative_drawdown"])


_M15 = ("top_outcome", "top_adjusted_return", "top_max_drawdown", "top_relative_drawdown", "spread")
add("b15_label_comparison", _b15, f"""{FULL}, dd AS ({DDQ}), lj AS (SELECT x.symbol, x.date, sc.score, sc.outcome, dd.max_drawdown, x.sector_neutral, dd.max_drawdown - median(dd.max_drawdown) OVER (PARTITION BY x.date, x.sector) AS relative_drawdown
 FROM {EXC} x JOIN dd ON dd.symbol = x.symbol AND dd.date = x.date JOIN sc ON sc.symbol = x.symbol AND sc.date = x.date),
lq AS (SELECT *, sector_neutral - 0.0015 + 0.25 * least(greatest(relative_drawdown, -0.5), 0.5) AS adjusted_return, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS q, count(*) OVER (PARTITION BY date) AS m FROM lj WHERE score IS NOT NULL AND outcome IS NOT NULL),
ld AS (SELECT date, {', '.join(f'avg({x}) FILTER (q <= greatest(1, ceil(m * 0.1))) AS top_{x}' for x in ('outcome', 'adjusted_return', 'max_drawdown', 'relative_drawdown'))}, avg(outcome) FILTER (q > m - greatest(1, ceil(m * 0.1))) AS bottom FROM lq GROUP BY date),
lc AS (SELECT *, top_outcome - bottom AS spread FROM ld),
co AS (SELECT 'month' AS cohort, min(date) AS date FROM bars GROUP BY date_trunc('month', date) UNION ALL SELECT 'quarter', min(date) FROM bars GROUP BY date_trunc('quarter', date) UNION ALL SELECT DISTINCT 'daily', date FROM bars)
SELECT cohort, count(*) AS dates, {', '.join(r(f'avg({x})', x + '_mean') for x in _M15)}, {', '.join(r(f'median({x})', x + '_median') for x in _M15)} FROM lc JOIN co USING (date) GROUP BY cohort""")


def _h8(s, d):
    o = t.table(s, d, "customer")
    rows = o.select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("OLD"), "c_custkey")).otherwise(F.col("c_custkey").cast("string")).alias("symbol"), F.lit("2000-01-03").cast("date").alias("date"), F.col("c_mktsegment").alias("sector"))
    aliases = o.where("c_custkey % 3 = 0").select(F.concat(F.lit("OLD"), "c_custkey").alias("name"), F.col("c_custkey").cast("string").alias("security"))
    return tape.sector_observations(rows.unionByName(rows.where("symbol like '%7'")), aliases)


add("h8_sector_observations", _h8, "SELECT CAST(c_custkey AS VARCHAR) AS symbol, '2000-01-03' AS date, c_mktsegment AS sector FROM customer")


def _d7(s, d):
    bars = t.panel(s, d).where("close is not null and not (symbol = 'NATION_4')").where("not (symbol in ('NATION_5', 'NATION_6') and month(date) > 3)")
    failures = t.table(s, d, "nation").where("n_nationkey % 6 = 4").select(F.col("n_name").alias("symbol"), F.lit("timeout").alias("error"))
    return qa.readiness_record(bars, failures, t.table(s, d, "nation").where("n_nationkey >= 3").select(F.col("n_name").alias("symbol")))


add("d7_readiness_record", _d7, f"""{ALL}, x AS (SELECT symbol, CAST(max(date) AS VARCHAR) AS latest FROM p WHERE close IS NOT NULL AND symbol <> 'NATION_4' AND NOT (symbol IN ('NATION_5', 'NATION_6') AND month(date) > 3) GROUP BY symbol),
y AS (SELECT coalesce(x.symbol, n.n_name) AS symbol, coalesce(latest, 'missing') AS latest, CASE WHEN n.n_name IS NOT NULL THEN 'timeout' END AS error FROM x FULL JOIN (SELECT * FROM nation WHERE n_nationkey % 6 = 4) n ON n.n_name = x.symbol)
SELECT 'count' AS kind, latest AS key, CAST(count(*) AS VARCHAR) AS value FROM y GROUP BY latest UNION ALL
(SELECT 'sample', symbol, concat_ws('|', latest, error) FROM y WHERE symbol IN (SELECT n_name FROM nation WHERE n_nationkey >= 3) ORDER BY symbol LIMIT 6)""")
add("d9_cache_endings", lambda s, d: qa.cache_endings(qa.all_gain_windows(t.bars(s, d).withColumn("close", F.greatest(F.col("close"), F.lit(1500.0))), 4)), f"""{ALL}, x AS (SELECT symbol, date, c - lag(c) OVER (PARTITION BY symbol ORDER BY date) AS dd FROM (SELECT *, greatest(close, 1500) AS c FROM bars)),
y AS (SELECT *, count(dd) OVER w = 4 AND min(dd) OVER w >= 0 AND max(dd) OVER w > 0 AS edge FROM x WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 3 PRECEDING)), z AS (SELECT symbol, count(*) AS n, count(*) FILTER (edge) AS e, max(date) AS last FROM y GROUP BY symbol)
SELECT CAST(last AS VARCHAR) AS last, count(*) AS symbols, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(e) AS BIGINT) AS edge_rows FROM z GROUP BY last""")


def _d12(s, d):
    o = t.table(s, d, "customer")
    rec = F.when(F.col("c_custkey") % 11 == 0, F.lit("not json")).otherwise(F.to_json(F.struct(F.col("c_name").alias("symbol"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("price"), F.col("c_mktsegment").alias("sector"), F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), 1, F.col("c_nationkey") % 4).alias("tags"))))
    rules = {"symbol": {"type": "string", "required": True}, "price": {"type": "number|null", "required": True}, "sector": {"type": "string", "enum": ["BUILDING", "MACHINERY"]}, "tags": {"type": "array", "minItems": 1, "maxItems": 2}}
    return qa.schema_errors(o.select(F.col("c_custkey").alias("key"), rec.alias("record")), rules)


add("d12_schema_errors", _d12, """WITH x AS (SELECT c_custkey AS key, c_custkey % 11 = 0 AS bad, * FROM customer) SELECT key, '$' AS path, 'expected object' AS error FROM x WHERE bad UNION ALL SELECT key, '$.symbol', 'is required' FROM x WHERE bad
 UNION ALL SELECT key, '$.price', 'is required' FROM x WHERE bad OR c_custkey % 5 = 0 UNION ALL SELECT key, '$.sector', 'is not in enum' FROM x WHERE NOT bad AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
 UNION ALL SELECT key, '$.tags', CASE WHEN c_nationkey % 4 = 0 THEN 'has fewer than 1 items' ELSE 'has more than 2 items' END FROM x WHERE NOT bad AND c_nationkey % 4 IN (0, 3)""")
add("d13_identity", lambda s, d: qa.identity_violations(t.table(s, d, "orders").select(F.col("o_orderkey").alias("artifact"), F.col("o_custkey").alias("dataset"), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("sha256"), F.col("o_orderstatus").alias("target")), t.table(s, d, "customer").where("c_custkey % 13 != 0").select(F.col("c_custkey").alias("dataset"), F.col("c_custkey").cast("string").alias("sha256"), (F.col("c_custkey") % 3).alias("label_version")), "F", 2),
    "SELECT o_orderkey AS artifact, CASE WHEN c_custkey IS NULL THEN 'missing_dataset' WHEN o_orderkey % 7 = 0 THEN 'other_bytes' ELSE 'old_labels' END AS reason FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 13 <> 0) ON c_custkey = o_custkey WHERE c_custkey IS NULL OR o_orderkey % 7 = 0 OR (o_orderstatus = 'F' AND c_custkey % 3 < 2)")

# K: live panel and books
def _k1(s, d):
    bars = t.panel(s, d)
    df = f.all_features(bars, t.benchmark(s, d)).select("symbol", "date", "return_5d", "return_20d", "volatility_20d", "beta_60d").join(bars.select("symbol", "date", "sector"), ["symbol", "date"])
    df = df.join(c.breadth(base(s, d)).select("date", "above_20"), "date", "left").join(c.sector_context(t.sector_bars(s, d)), ["sector", "date"], "left")
    return df.select("symbol", "date", "return_5d", "return_20d", "volatility_20d", "above_20", "sector_r20")


add("k1_live_panel", _k1, f"{FULL} SELECT symbol, CAST(feat.date AS VARCHAR) AS date, {r('r5', 'return_5d')}, {r('r20', 'return_20d')}, {r('vol20', 'volatility_20d')}, {r('above_20')}, {r('sector_r20')} FROM feat LEFT JOIN (SELECT date, avg(coalesce(CAST(vs_sma20 > 0 AS INTEGER), 0)) AS above_20 FROM feat GROUP BY date) USING (date) LEFT JOIN ctx USING (sector, date)")
add("k9_scorebook", lambda s, d: tape.scorebook(live(s, d).withColumn("setup", k.setup_type(top())).select("symbol", "date", "rank", "percentile", "setup"), t.table(s, d, "nation").select(F.col("n_name").alias("symbol"), F.col("n_nationkey").alias("name_key")), f.latest_metrics(t.panel(s, d)).select("symbol", F.col("volume_ratio").alias("latest_volume_ratio")), t.table(s, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("symbol"), (F.col("n_nationkey") * 4.0).alias("percentile"))).select("symbol", "date", "rank", "setup", "name_key", "strategic_percentile"),
    f"{FULL}{LIVE} SELECT symbol, {D}, rank, {_SET} AS setup, n_nationkey AS name_key, CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey * 4 AS DOUBLE) END AS strategic_percentile FROM lv LEFT JOIN nation ON n_name = symbol")
add("k20_label_summary", lambda s, d: k.label_summary(b.cohort_summary(predictions(s, d), STR, _cohorts(s, d)), "score", ["month", "quarter", "year"], ["top_mean", "spread"]), f"""{FULL}, {LONG}, co AS (SELECT 'month' AS cohort, min(date) AS date FROM bars GROUP BY date_trunc('month', date) UNION ALL SELECT 'quarter', min(date) FROM bars GROUP BY date_trunc('quarter', date)),
 z AS (SELECT cohort, avg(top_mean) AS top_mean, avg(spread) AS spread FROM st JOIN co USING (date) WHERE strategy = 'score' GROUP BY cohort)
 SELECT {', '.join(r(f"max({x}) FILTER (cohort = '{q}')", f'{q}_{x}') for q in ('month', 'quarter') for x in ('top_mean', 'spread'))}, CAST(NULL AS DOUBLE) AS year_top_mean, CAST(NULL AS DOUBLE) AS year_spread FROM z""")
add("k22_macro_context", lambda s, d: k.macro_context(t.table(s, d, "customer").select(F.col("c_custkey").alias("book")), t.table(s, d, "orders").where("o_orderkey % 4 = 1").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("place"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("error").alias("status"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("reading"), F.col("o_orderkey").alias("ref")), t.table(s, d, "orders").where("o_orderkey % 4 = 2").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("summary"), F.col("o_orderkey").alias("ref"))),
    """WITH u AS (SELECT o_custkey, 1 AS tier, o_orderkey, 'release' AS origin, o_orderpriority AS text FROM orders WHERE o_orderkey % 4 = 1 AND o_orderstatus = 'F' AND o_orderkey % 3 > 0
 UNION ALL SELECT o_custkey, 2, o_orderkey, 'driver', CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE o_orderstatus END FROM orders WHERE o_orderkey % 4 = 2),
 z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY tier, o_orderkey) AS q FROM u) WHERE q = 1)
 SELECT c_custkey AS book, coalesce(origin, 'none') AS origin, o_orderkey AS ref, text FROM customer LEFT JOIN z ON o_custkey = c_custkey""")


# M: classifiers, presets, arms
def _rows(s, d, bars):
    return predictions(s, d, bars).where("score is not null and vol20 is not null and short is not null and grade is not null")


def _m4(s, d):
    bars = durable(t.bars(s, d))
    parts = durable(_rows(s, d, bars).withColumn("label", (F.col("outcome") > 0).cast("double")).join(v.embargoed_split(bars, 60, 60, 14), "date"))
    model = m.train_classifier(parts.where("split = 'train'"), ["score", "vol20", "short"], "label", trees=5)
    return model.transform(parts.where("split = 'test'")).select("symbol", "date", F.col("prediction").alias("predicted"), "label")


def _experiment(s, d, arms):
    """Predictions of the arms over the same folds, their known baskets by cohort, and the paired effect by date."""
    bars = durable(t.bars(s, d))
    return m.fold_predictions(_rows(s, d, bars), v.walk_forward(bars, 2, 40, 40, 100, 14), arms)


def _m5(s, d):
    arms = m.preset_arms(["score", "vol20", "short"], {"shallow": {"depth": 2, "trees": 3}, "deep": {"depth": 4, "trees": 3}})
    w = Window.partitionBy("strategy", "fold", "date").orderBy(F.desc("score"), "symbol")
    return b.describe(_experiment(s, d, arms).withColumn("place", F.row_number().over(w)).where("place <= 3"), "outcome", ["strategy", "fold"])


def _m10(s, d):
    arms = {"all": {"features": ["score", "vol20", "short"], "trees": 3}, "momentum": {"features": ["score", "short"], "trees": 3}}
    w = Window.partitionBy("strategy", "date").orderBy(F.desc("score"), "symbol")
    top_ = _experiment(s, d, arms).withColumn("place", F.row_number().over(w)).where("place <= 3")
    both = b.paired(top_.groupBy("strategy", "date").agg(F.avg("outcome").alias("spread")), list(arms)).withColumn("effect", F.col("all") - F.col("momentum"))
    return both.select("date", "all", "momentum", "effect")


add("m4_classifier", _m4)
add("m5_presets", _m5)
add("m10_arms", _m10)


def _m9(s, d):
    trees = _s22(s, d)
    return tape.trim_to_best(trees, 4).groupBy("model").agg(F.countDistinct("tree").alias("trees"), F.count_if("leaf").alias("leaves"), F.sum(F.when(~F.col("leaf"), F.col("gain"))).alias("gain"))


add("m9_best_iteration", _m9, f"WITH x AS (SELECT s_nationkey AS model, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS tree, s_acctbal FROM supplier) SELECT model, count(*) AS trees, 2 * count(*) AS leaves, {r('sum(s_acctbal / 2)', 'gain')} FROM x WHERE tree <= 4 GROUP BY model")
