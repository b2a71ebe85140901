"""Queries of readers and writers (S) over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.semantics import rounded
from panelforge.plans.sqlparts import ALL, r
from panelforge.sources import readers as rd
from panelforge.sources import tables as t

QUERIES, SQL = {}, {}


def add(name, run, sql=None):
    QUERIES[name] = lambda s, d: rounded(run(s, d))
    if sql:
        SQL[name] = sql


def charts(s, d):
    """Provider payloads made of the bars: one a nation, every 17th adjusted close missing."""
    b = t.panel(s, d).where("close is not null")
    x = F.transform(F.array_sort(F.collect_list(F.struct("session_ix", F.unix_timestamp(F.col("date").cast("timestamp")).alias("t"), "open", "high", "low", "close", "volume"))), lambda z: z)
    g = b.groupBy("symbol").agg(x.alias("x"))
    arr = lambda k: F.transform("x", lambda z: z[k])
    adj = F.transform("x", lambda z: F.when(z["session_ix"] % 17 != 0, z["close"] * 0.5))
    res = F.struct(F.struct("symbol", F.lit("UTC").alias("exchangeTimezoneName")).alias("meta"), arr("t").alias("timestamp"), F.struct(F.array(F.struct(*[arr(c).alias(c) for c in ("open", "high", "low", "close", "volume")])).alias("quote"), F.array(F.struct(adj.alias("adjclose"))).alias("adjclose")).alias("indicators"))
    return g.select(F.to_json(F.struct(F.struct(F.array(res).alias("result")).alias("chart")), {"ignoreNullFields": "false"}).alias("body"))


add("s2_chart_bars", lambda s, d: rd.chart_bars(charts(s, d)).select("symbol", "date", "open", "close", F.coalesce("reason", F.lit("ok")).alias("reason")),
    f"{ALL} SELECT symbol, CAST(date AS VARCHAR) AS date, {r('CASE WHEN session_ix % 17 <> 0 THEN open * (close * 0.5) / close END', 'open')}, {r('CASE WHEN session_ix % 17 <> 0 THEN close * (close * 0.5) / close END', 'close')}, CASE WHEN session_ix % 17 <> 0 THEN 'ok' ELSE 'bad_adjusted_close' END AS reason FROM p WHERE close IS NOT NULL")
add("s3_evidence", lambda s, d: rd.ingestion_evidence(rd.chart_bars(charts(s, d))),
    f"{ALL} SELECT symbol, count(*) AS raw, count(*) FILTER (session_ix % 17 <> 0) AS accepted, count(*) FILTER (session_ix % 17 = 0) AS rejected, array_to_string(list_slice(list(CAST(date AS VARCHAR) ORDER BY date DESC), 1, 3), ',') AS tail FROM p WHERE close IS NOT NULL GROUP BY symbol")
add("s6_index_changes", lambda s, d: rd.index_changes(t.table(s, d, "customer").select((F.col("c_custkey") % 5).alias("page_id"), F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 15 < 5, F.concat(F.lit("d"), "c_custkey")).alias("date"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).alias("added"), F.when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment")).alias("removed"))),
    """WITH x AS (SELECT c_custkey % 5 AS page_id, c_custkey AS pos, last_value(CASE WHEN c_custkey % 15 < 5 THEN 'd' || c_custkey END IGNORE NULLS) OVER (PARTITION BY c_custkey % 5 ORDER BY c_custkey) AS date, c_name, c_mktsegment, c_nationkey FROM customer)
 SELECT page_id, pos, date, c_name AS symbol, 'add' AS kind FROM x WHERE c_nationkey % 2 = 0 UNION ALL SELECT page_id, pos, date, c_mktsegment, 'remove' FROM x WHERE c_nationkey % 3 = 0""")


def _s6(s, d):
    """Change tables of five pages in parts of 600 rows: a date over three rows, a reason over two, sides left empty or dashed.

    Rows of a page are numbered within blocks of keys, after the counts of the blocks before; the table of counts has a row a page and block.
    """
    c = t.table(s, d, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    c = c.withColumns({"page_id": F.col("c_custkey") % 5, "block": F.expr("c_custkey div 50000")})
    n = c.groupBy("page_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("page_id", "block", (F.sum("n").over(Window.partitionBy("page_id").orderBy("block")) - F.col("n")).alias("before"))
    c = c.join(F.broadcast(before), ["page_id", "block"]).withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("page_id", "block").orderBy("c_custkey")) - 1)
    c = c.withColumn("first", F.col("i") - F.col("i") % 600)
    td = lambda x, attr=F.lit(""): F.concat(F.lit("<td"), attr, F.lit(">"), x, F.lit("</td>"))
    day = F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int")), "MMMM d, yyyy")
    date = F.when(F.col("i") % 3 == 0, td(F.concat(F.lit("<b>"), day, F.lit("</b>")), F.lit(' rowspan="3"'))).otherwise("")
    reason = F.when(F.col("i") % 2 == 0, td(F.concat(F.lit("Cap &amp; "), F.col("c_mktsegment")), F.lit(" rowspan=2"))).otherwise("")
    added = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("A"), "c_custkey")).otherwise("")
    gone = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("R"), "c_custkey")).otherwise("-")
    row = F.concat(F.lit("\n<tr>"), date, td(added), td(F.when(added != "", F.col("c_name")).otherwise("")), td(gone, F.lit(' class="x"')), td(F.col("c_name")), reason, F.lit("</tr>"))
    head = "<html><table id=other><tr><td>no</td></tr></table><table class='w' id=\"changes\"><tr><th rowspan=1>Date</th><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th><th>Reason</th></tr>"
    pages = c.groupBy("page_id", "first").agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", row.alias("row")))), lambda x: x["row"]), ""), F.lit("</table></html>")).alias("html"))
    return rd.index_change_pages(pages)


add("s6_change_pages", _s6, """WITH x AS (SELECT c_custkey % 5 AS page_id, row_number() OVER (PARTITION BY c_custkey % 5 ORDER BY c_custkey) - 1 AS i, * FROM customer),
 y AS (SELECT page_id, CAST(i + 1 AS INTEGER) AS pos, CAST(DATE '2001-01-01' + CAST(first_value(c_custkey) OVER (PARTITION BY page_id, i // 3 ORDER BY i) % 3000 AS INTEGER) AS DATE) AS date, 'Cap & ' || first_value(c_mktsegment) OVER (PARTITION BY page_id, i // 2 ORDER BY i) AS reason, c_custkey, c_name, c_nationkey FROM x)
 SELECT page_id, pos, CAST(date AS VARCHAR) AS date, 'A' || c_custkey AS symbol, c_name AS name, 'add' AS kind, reason FROM y WHERE c_nationkey % 2 = 0 UNION ALL SELECT page_id, pos, CAST(date AS VARCHAR), 'R' || c_custkey, c_name, 'remove', reason FROM y WHERE c_nationkey % 3 = 0""")
add("s7_pushed_scan", lambda s, d: t.table(s, d, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity"]).where("l_shipdate >= '2001-01-01' and l_quantity > 40").select("l_orderkey", "l_linenumber", "l_quantity"),
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' AND l_quantity > 40")
add("s9_repeated_keys", lambda s, d: rd.repeated_keys(t.table(s, d, "lineitem", ["l_partkey", "l_suppkey"]), ["l_partkey", "l_suppkey"]), "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
add("s19_dataset_description", lambda s, d: rd.describe_dataset(t.bars(s, d).withColumn("label", F.col("close") - F.col("open")), ["label"]), f"{ALL} SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last, {r('avg(CAST(close > open AS DOUBLE))', 'label_rate')} FROM bars")
add("s20_report", lambda s, d: rd.report(t.table(s, d, "part").select("p_partkey", (F.col("p_retailprice") / F.when(F.col("p_size") % 5 == 0, F.lit(None)).otherwise(F.col("p_size"))).alias("x"))), f"SELECT p_partkey, {r('CASE WHEN p_size % 5 <> 0 THEN p_retailprice / p_size END', 'x')} FROM part")
add("s21_manifest", lambda s, d: rd.manifest_violations(t.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")), t.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 9 == 0, F.lit("0")).otherwise(F.sha2("text", 256)).alias("sha256"))), "SELECT CAST(doc_id AS VARCHAR) AS path, '0' AS sha256, sha256(text) AS found FROM documents WHERE doc_id % 9 = 0")
add("s23_cache_manifest", lambda s, d: rd.cache_manifest(t.table(s, d, "nation").select(F.col("n_name").alias("key")), t.bars(s, d).where("sector != 'ASIA'").select(F.col("symbol").alias("key"))), f"{ALL} SELECT n_name AS key, CASE WHEN n IS NULL THEN 'failed' ELSE 'cached' END AS status, coalesce(n, 0) AS rows FROM nation LEFT JOIN (SELECT symbol, count(*) AS n FROM bars WHERE sector <> 'ASIA' GROUP BY symbol) x ON symbol = n_name")
add("s16_company_facts", lambda s, d: rd.company_facts(t.table(s, d, "events").groupBy(F.col("user_id").cast("string").alias("cik")).agg(F.collect_list(F.struct(F.lit("2024-01-31").alias("end"), F.col("value").alias("val"), F.date_format("ts", "yyyy-MM-dd").alias("filed"), F.col("event_type").alias("form"))).alias("x")).select(F.to_json(F.struct("cik", F.create_map(F.lit("gaap"), F.create_map(F.lit("Revenue"), F.struct(F.create_map(F.lit("USD"), F.col("x")).alias("units")))).alias("facts"))).alias("body"))).groupBy("cik", "tag", "filed").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most")),
    "SELECT CAST(user_id AS VARCHAR) AS cik, 'Revenue' AS tag, strftime(ts, '%Y-%m-%d') AS filed, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2, 3")
