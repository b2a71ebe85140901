"""Queries of the tape's later steps (P, J, K, T, H, M) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import scalars as x
from panelforge.functions.semantics import rounded
from panelforge.operators import features as f
from panelforge.operators import scorebook as k
from panelforge.operators import tape
from panelforge.plans.history_queries import LIVE, SCORED, _SET, live, scored, top
from panelforge.plans.sqlparts import ALL, D, FULL, r
from panelforge.sources.tables import bars, panel, table

QUERIES, SQL = {}, {}


def add(name, run, sql=None):
    QUERIES[name] = lambda s, d: rounded(run(s, d))
    if sql:
        SQL[name] = sql


LAST = "date = DATE '2000-01-03'"
PCT = "CASE WHEN n > 1 THEN 100 * (1 - (rank - 1) / (n - 1)) ELSE 100 END"


def day(s, d):
    return scored(s, d).where(F.col("date") == F.lit("2000-01-03").cast("date"))


add("p7_dates", lambda s, d: table(s, d, "orders").select("o_orderkey", F.date_format(x.utc_date(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd HH:mm")), 1999), "yyyy-MM-dd").alias("day")),
    "SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
add("p8_eastern", lambda s, d: table(s, d, "events").select("event_id", F.date_format(x.eastern(F.date_trunc("second", F.col("ts").cast("timestamp"))), "yyyy-MM-dd HH:mm:ss").alias("utc")), "SELECT event_id, strftime(timezone('UTC', timezone('America/New_York', date_trunc('second', ts))), '%Y-%m-%d %H:%M:%S') AS utc FROM events")
add("p12_search", lambda s, d: tape.search(table(s, d, "customer").select(F.col("c_name").alias("symbol"), F.col("c_mktsegment").alias("sector"), F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("rank")), "99", ["symbol", "sector"]), "SELECT c_name AS symbol, c_mktsegment AS sector, CASE WHEN c_acctbal > 0 THEN c_custkey END AS rank FROM customer WHERE contains(lower(c_name), '99') OR contains(lower(c_mktsegment), '99')")
add("p15_records", lambda s, d: tape.from_records(tape.to_records(table(s, d, "part").select("p_partkey", "p_name", "p_retailprice")), "p_partkey long, p_name string, p_retailprice double").drop("bad"), f"SELECT p_partkey, p_name, {r('p_retailprice')} FROM part")
add("j15_enrichment", lambda s, d: tape.scorebook(day(s, d).select("symbol", "rank", "percentile"), table(s, d, "nation").where("n_nationkey % 4 != 0").select(F.col("n_name").alias("symbol"), F.col("n_regionkey").alias("region")), f.latest_metrics(panel(s, d)).select("symbol", "change"), day(s, d).where("rank <= 5").select("symbol", "percentile")),
    f"{FULL}, s AS (SELECT symbol, rank, {PCT} AS percentile FROM {SCORED} WHERE {LAST}), lc AS (SELECT symbol, arg_max(r1, date) AS change FROM (SELECT symbol, date, coalesce(r1, 'nan'::DOUBLE) AS r1 FROM p WHERE close IS NOT NULL) GROUP BY symbol) SELECT s.symbol, rank, {r('percentile')}, n_regionkey AS region, {r('CASE WHEN NOT isnan(change) THEN change END', 'change')}, {r('CASE WHEN rank <= 5 THEN percentile END', 'strategic_percentile')} FROM s LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON n_name = s.symbol LEFT JOIN lc ON lc.symbol = s.symbol")
add("k8_market_strip", lambda s, d: tape.market_strip(day(s, d).select("symbol", F.col("score").alias("change")), "NATION_3"))
SQL["k8_market_strip"] = f"{FULL}, b AS (SELECT score AS s FROM sc WHERE symbol = 'NATION_3' AND {LAST}) SELECT symbol, {r('score', 'change')}, {r('score - s', 'relative')} FROM sc LEFT JOIN b ON true WHERE {LAST} AND score IS NOT NULL"
add("k14_desk_calls", lambda s, d: tape.desk_calls(live(s, d).where("month(date) = 7 and year(date) = 2000").withColumn("setup", k.setup_type(top())).withColumn("rank", F.col("rank") + F.dayofmonth("date") * 100)).select("symbol", "date", "setup"),
    f"{FULL}{LIVE} SELECT symbol, {D}, setup FROM (SELECT *, row_number() OVER (PARTITION BY setup ORDER BY rank + day(date) * 100) AS k FROM (SELECT *, {_SET} AS setup FROM lv WHERE month(date) = 7 AND year(date) = 2000)) WHERE (setup = 'momentum_confirmed' AND k <= 4) OR (setup = 'model_rebound_watch' AND k <= 1)")
add("k19_top_sectors", lambda s, d: tape.top_sectors(day(s, d).where("rank <= 10")), f"{FULL} SELECT sector, count(*) AS names, {r(f'avg({PCT})', 'percentile')} FROM {SCORED} WHERE {LAST} AND rank <= 10 GROUP BY sector ORDER BY count(*) DESC, avg({PCT}) DESC, sector LIMIT 3")
add("k21_actions", lambda s, d: live(s, d).withColumn("setup", k.setup_type(top())).select("symbol", "date", tape.action_label(F.col("percentile"), F.col("setup")).alias("action")),
    f"{FULL}{LIVE} SELECT symbol, {D}, CASE WHEN p >= 90 AND setup = 'momentum_confirmed' THEN 'Research now' WHEN p >= 90 AND setup = 'model_rebound_watch' THEN 'Wait for activation' WHEN p >= 90 THEN 'Watch' WHEN p <= 10 THEN 'Avoid' ELSE 'Hold' END AS action FROM (SELECT *, {_SET} AS setup, {PCT} AS p FROM lv)")
add("k7_rescore", lambda s, d: tape.rescore(day(s, d).select("symbol", "score", "vol20"), {"score": 0.5, "vol20": -1.0}).select("symbol", "score"), f"{FULL} SELECT symbol, {r('coalesce(score, 0) * 0.5 + coalesce(vol20, 0) * -1.0', 'score')} FROM sc WHERE {LAST} AND score IS NOT NULL")
add("t11_deeper_reads", lambda s, d: tape.deeper_reads(table(s, d, "documents").select("source", F.col("doc_id").alias("url"), "text", (F.col("doc_id") * 37 % 101).alias("importance")), table(s, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("url")), 6).select("source", "url", "importance"),
    "SELECT source, url, importance FROM (SELECT source, doc_id AS url, doc_id * 37 % 101 AS importance, row_number() OVER (PARTITION BY source ORDER BY doc_id * 37 % 101 DESC, doc_id) AS k FROM documents WHERE length(text) >= 400 AND doc_id % 2 <> 0) WHERE k = 1 ORDER BY importance DESC, url LIMIT 6")
_LEAD = {0: "Markets Business Tech ", 1: "Yes A checkmark with a circle around it close The market ", 2: "After the data Stock futures rose. Key Points ", 3: ""}


def _t12(s, d):
    df = table(s, d, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    lead = F.coalesce(*[F.when(F.col("doc_id") % 4 == n, F.lit(x)) for n, x in _LEAD.items()])
    tail = F.when(F.col("doc_id") % 5 == 0, " Skip Navigation\nMarkets").otherwise("")
    clean = tape.clean_conclusion(F.concat(lead, F.coalesce("text", F.lit("")), tail), F.when(F.col("doc_id") % 4 == 3, F.col("title")))
    return df.select("doc_id", F.md5(clean).alias("md5"), F.md5(tape.key_points(clean)).alias("points_md5"))


_MENU = "(?:Markets|Business|Investing|Tech|Politics|Economy|Videos)"
add("t12_conclusions", _t12, rf"""WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{_LEAD[0]}' WHEN 1 THEN '{_LEAD[1]}' WHEN 2 THEN '{_LEAD[2]}' ELSE '' END || coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN ' Skip Navigation' || chr(10) || 'Markets' ELSE '' END AS t,
 CASE WHEN doc_id % 4 = 3 THEN coalesce(split_part(text, chr(10), 1), '') ELSE '' END AS title FROM documents),
b AS (SELECT doc_id, title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)\bSkip Navigation\b.*$', ' '), '(?i)\b{_MENU}\s+{_MENU}(?:\s+{_MENU})+', ' ', 'g'), '(?i)Yes A checkmark with a circle around it close', ' ', 'g'),
 '\bclose\s+([A-Z])', '\1', 'g'), '\b(data|war|rally|update)\s+(Over in|Stock futures|Earnings season|Investors|The oil)\b', '\1. \2', 'g'), '\s+', ' ', 'g')) AS t FROM a),
c AS (SELECT doc_id, t, trim(regexp_replace(title, '\s+', ' ', 'g')) AS h FROM b), e AS (SELECT doc_id, CASE WHEN starts_with(lower(t), lower(h)) THEN trim(substring(t, length(h) + 1)) ELSE t END AS t FROM c)
SELECT doc_id, md5(t) AS md5, md5(CASE WHEN regexp_extract(t, '(?is)\bKey Points\s+(.{{40,700}})', 1) <> '' THEN regexp_extract(t, '(?is)\bKey Points\s+(.{{40,700}})', 1) ELSE t END) AS points_md5 FROM e""")
add("t25_clean_lists", lambda s, d: table(s, d, "documents").select("doc_id", F.md5(F.array_join(F.array_sort(F.split(tape.dedupe_lists(F.col("text")), ", ")), "|")).alias("md5"), tape.useful(F.col("text")).alias("useful")),
    r"SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_transform(string_split(text, ','), lambda x: trim(x)))), '|')) AS md5, length(trim(text)) >= 40 AND NOT regexp_matches(lower(text), '\b(lorem ipsum|javascript is disabled|enable cookies)\b') AS useful FROM documents")
add("t16_metric_mode", lambda s, d: tape.metric_mode(table(s, d, "labels").select(F.col("quality").alias("score"))), "SELECT bool_and(quality IS NOT NULL) AS ranked, count(*) AS posts FROM labels")
add("t17_earnings_movers", lambda s, d: tape.earnings_movers(table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("symbol")), day(s, d).select("symbol", F.col("score").alias("change"))), f"{FULL} SELECT symbol, {r('score', 'change')} FROM sc WHERE {LAST} AND score IS NOT NULL AND symbol IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) ORDER BY abs(score) DESC, symbol LIMIT 12")
add("t19_due_events", lambda s, d: tape.due_events(table(s, d, "events").where("event_type = 'signup'").select(F.col("event_id").alias("name"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at")), F.lit("2024-01-10").cast("timestamp"), 96, 50).select("name", "today"), "SELECT event_id AS name, CAST(ts AS DATE) = DATE '2024-01-10' AS today FROM events WHERE event_type = 'signup' AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-14' ORDER BY date_trunc('second', ts), event_id LIMIT 50")
add("t21_latest_news", lambda s, d: tape.latest_news(table(s, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderpriority").alias("title"), F.to_date("o_orderdate").alias("published")), F.lit("2000-06-30").cast("date")), "SELECT o_custkey AS symbol, arg_max(o_orderpriority, (CAST(o_orderdate AS DATE), o_orderpriority)) AS title, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS published FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2000-05-31' AND DATE '2000-06-30' GROUP BY o_custkey")
add("t24_cards", lambda s, d: tape.cards(table(s, d, "customer").select(F.col("c_custkey").alias("ref"), "c_name"), table(s, d, "customer").where("c_nationkey < 9").select(F.col("c_custkey").alias("ref"), F.col("c_mktsegment").alias("source"))), "SELECT ref, c_name, source FROM (SELECT c_custkey AS ref, c_name, c_mktsegment AS source, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer WHERE c_nationkey < 9) WHERE k = 1 ORDER BY ref LIMIT 5")
add("t26_live_or_cached", lambda s, d: tape.live_or_cached(table(s, d, "events").where("event_type = 'none'").select("event_id", F.col("ts").cast("timestamp").alias("fetched")), table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("fetched")), F.lit("2024-01-31").cast("timestamp")).select("event_id", "origin"), "SELECT event_id, 'cached' AS origin FROM events WHERE epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) <= 86400")
add("h16_cross_source", lambda s, d: tape.cross_source(bars(s, d), bars(s, d).withColumn("close", F.col("close") * F.when(F.month("date") == 3, 1.01).otherwise(1.0))), f"{ALL}, x AS (SELECT symbol, close / lag(close) OVER w - 1 AS ra, c2 / lag(c2) OVER w - 1 AS rb FROM (SELECT *, close * CASE WHEN month(date) = 3 THEN 1.01 ELSE 1.0 END AS c2 FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, {r('max(abs(ra - rb))', 'largest')}, count(*) AS days FROM x GROUP BY symbol")
#: Good Fridays, written out: the rule in `trading_days` is held against them.
_FRIDAYS = ", ".join(f"DATE '{x}'" for x in ("1992-04-17", "1993-04-09", "1994-04-01", "1995-04-14", "1996-04-05", "1997-03-28", "1998-04-10", "1999-04-02", "2000-04-21", "2001-04-13", "2002-03-29", "2003-04-18"))
add("p10_calendar", lambda s, d: table(s, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct().join(x.trading_days(s, "1992-01-01", "2003-12-31"), "date"), f"""SELECT CAST(d AS VARCHAR) AS date, w BETWEEN 1 AND 5 AND NOT ((m = 1 AND k = 1) OR (m = 1 AND k = 2 AND w = 1) OR (m = 7 AND (k = 4 OR (k = 5 AND w = 1) OR (k = 3 AND w = 5))) OR (m = 12 AND (k = 25 OR (k = 26 AND w = 1) OR (k = 24 AND w = 5)))
 OR (w = 1 AND m IN (1, 2) AND k BETWEEN 15 AND 21) OR (w = 1 AND m = 5 AND k > 24) OR (w = 1 AND m = 9 AND k < 8) OR (w = 4 AND m = 11 AND k BETWEEN 22 AND 28) OR d IN ({_FRIDAYS})) AS is_session
 FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, dayofweek(o_orderdate) AS w, month(o_orderdate) AS m, day(o_orderdate) AS k FROM orders)""")
