"""Queries of securities that end, change their names and are classified late (H6, H7, J7, J16) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.semantics import rounded
from panelforge.operators import identity as idy
from panelforge.operators import joins as j
from panelforge.operators import terminal as te
from panelforge.plans.panel_queries import OBS, observations
from panelforge.plans.sqlparts import FULL, r
from panelforge.sources import tables as t

QUERIES, SQL = {}, {}
AS_OF, H = "1998-01-01", 14


def add(name, run, sql):
    QUERIES[name] = lambda s, d: rounded(run(s, d))
    SQL[name] = sql


def archive(s, d):
    """The panel as raw bars with adjusted closes, splits, halts and carried rows; every third nation ends at session 250."""
    n, ix = F.substring("symbol", 8, 9).cast("int"), F.col("session_ix")
    source = F.when((ix + n) % 37 == 0, "archive carried").when(n % 2 == 1, "yahoo").otherwise("archive")
    return t.panel(s, d).where(F.col("close").isNotNull() & ((n % 3 != 0) | (ix <= 250))).select(
        "symbol", "date", "close", (F.col("close") * (ix * 0.0001 + 0.9)).alias("adj_close"), F.when(ix % 97 == 50, 2.0).otherwise(0.0).alias("stock_splits"), source.alias("source"), ((ix + n) % 41 == 0).alias("no_trade"),
    )


def terminal_events(s, d):
    """One event of every third nation around session 251: cash, stock, mixed or nothing, some unverified, some with rights."""
    n = F.col("n_nationkey").cast("int")
    day = t.sessions(t.bars(s, d)).where("session_ix = 251").select(F.col("date").alias("at"))
    kind = F.when(n % 12 == 0, "cash_acquisition").when(n % 12 == 3, "stock_acquisition").when(n % 12 == 6, "mixed_acquisition").otherwise("worthless_cancellation")
    cash = F.when(n % 12 == 0, n + 1500.0).when(n % 12 == 6, 200.0).when(n == 21, 5.0).otherwise(0.0)
    effective = F.date_sub("at", n % 7)
    return t.table(s, d, "nation", ["n_nationkey", "n_name"]).where(n % 3 == 0).join(F.broadcast(day)).select(
        F.col("n_name").alias("symbol"), kind.alias("kind"), effective.alias("effective_date"), F.date_add(effective, 30 * (n % 5)).alias("known_date"), cash.alias("cash"),
        F.when((n % 12).isin(3, 6), n / 100 + 0.5).alias("stock_ratio"), F.when((n % 12).isin(3, 6), F.concat(F.lit("NATION_"), n + 1)).alias("successor"),
        (n != 15).alias("verified"), (n % 9 == 0).alias("unresolved"), F.when(n != 18, n + 100.0).alias("rights_max"),
    )


def labels(s, d):
    return te.terminal_labels(t.panel(s, d).select("symbol", "date"), archive(s, d), terminal_events(s, d), H, AS_OF)


N = "CAST(substring(symbol, 8) AS INTEGER)"
LABELS = f"""{FULL}, ar AS (SELECT symbol, date, close, close * (session_ix * 0.0001 + 0.9) AS adj, CASE WHEN session_ix % 97 = 50 THEN 2.0 ELSE 0 END AS sp, (session_ix + {N}) % 37 = 0 AS carried, {N} % 2 = 1 AS yahoo, (session_ix + {N}) % 41 = 0 AS halted
 FROM p WHERE close IS NOT NULL AND ({N} % 3 <> 0 OR session_ix <= 250)),
su AS (SELECT symbol, date, close * CASE WHEN yahoo AND NOT carried THEN coalesce(product(CASE WHEN sp > 0 THEN sp END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) ELSE 1 END AS unit FROM ar),
tr0 AS (SELECT symbol, date, close, adj FROM ar WHERE NOT carried AND NOT halted),
ev0 AS (SELECT n_name AS symbol, n_nationkey AS n, CAST((SELECT date FROM days WHERE session_ix = 251) - n_nationkey % 7 AS DATE) AS eff, CASE WHEN n_nationkey % 12 = 0 THEN n_nationkey + 1500.0 WHEN n_nationkey % 12 = 6 THEN 200.0 WHEN n_nationkey = 21 THEN 5.0 ELSE 0.0 END AS cash,
 CASE WHEN n_nationkey % 12 IN (3, 6) THEN n_nationkey / 100.0::DOUBLE + 0.5 END AS ratio, 'NATION_' || (n_nationkey + 1) AS nxt FROM nation WHERE n_nationkey % 3 = 0),
ev1 AS (SELECT e.*, CASE WHEN ratio IS NOT NULL THEN su.date END AS vo, su.unit FROM ev0 e ASOF LEFT JOIN su ON e.nxt = su.symbol AND e.eff <= su.date),
ev2 AS (SELECT *, CASE WHEN ratio IS NULL THEN eff ELSE greatest(eff, vo) END AS hit, greatest(CAST(eff + 30 * (n % 5) AS DATE), vo) AS known, cash + CASE WHEN ratio IS NULL THEN 0 ELSE ratio * unit END AS value FROM ev1),
ev3 AS (SELECT e.*, l.date AS ld, l.close AS lc, l.adj AS la FROM ev2 e ASOF LEFT JOIN tr0 l ON e.symbol = l.symbol AND e.hit >= l.date),
ev4 AS (SELECT *, CASE WHEN n = 15 THEN 'not_verified' WHEN ratio IS NOT NULL AND (vo IS NULL OR vo - eff > 4) THEN 'no_successor_price' WHEN ld IS NULL THEN 'no_trade_before' WHEN hit - ld > 7 THEN 'long_gap' WHEN value IS NULL THEN 'missing_value'
 WHEN n % 12 = 9 AND value <> 0 THEN 'worthless_with_value' WHEN n % 9 = 0 THEN 'unpriced_rights' ELSE 'valued' END AS status FROM ev3),
lx AS (SELECT p.symbol, p.date, lead(adj, 1) OVER w AS en, lead(adj, {H + 1}) OVER w AS ex, lead(p.date, 1) OVER w AS end0, lead(p.date, {H + 1}) OVER w AS exd FROM p LEFT JOIN (SELECT * FROM ar WHERE NOT carried AND NOT halted) a ON a.symbol = p.symbol AND a.date = p.date WINDOW w AS (PARTITION BY p.symbol ORDER BY p.date)),
ly AS (SELECT lx.*, n, hit, known, value, lc, la, status, ex / en - 1 AS q, greatest(exd, hit, known) AS av, coalesce(ex IS NULL AND en IS NOT NULL AND end0 <= ld AND exd >= hit AND greatest(exd, hit, known) <= DATE '{AS_OF}', false) AS inside FROM lx LEFT JOIN ev4 USING (symbol)),
lz AS (SELECT *, coalesce(inside AND status = 'valued', false) AS known_value, inside AND status = 'unpriced_rights' AND n <> 18 AS bounded FROM ly)"""
add("h6_terminal_events", lambda s, d: labels(s, d).select("symbol", "date", "outcome", "available", "resolved", "status"),
    f"{LABELS} SELECT symbol, CAST(date AS VARCHAR) AS date, {r('CASE WHEN known_value THEN la / en * value / lc - 1 ELSE q END', 'outcome')}, CAST(CASE WHEN known_value THEN av ELSE exd END AS VARCHAR) AS available, known_value AS resolved, status FROM lz")
add("h7_rights_bounds", lambda s, d: labels(s, d).select("symbol", "date", "low", "high"),
    f"{LABELS} SELECT symbol, CAST(date AS VARCHAR) AS date, {r('CASE WHEN known_value OR bounded THEN la / en * value / lc - 1 ELSE q END', 'low')}, {r('CASE WHEN bounded THEN la / en * (value + n + 100) / lc - 1 WHEN known_value THEN la / en * value / lc - 1 ELSE q END', 'high')} FROM lz")


def _j7(s, d):
    days, rows, o = t.bars(s, d).select("date").distinct(), t.panel(s, d).select("symbol", "date"), observations(s, d).withColumnRenamed("date", "seen")
    monthly = j.lagged_asof(rows, o, days, "symbol", ["code"], 1, 62).select("symbol", "date", F.col("code").alias("code_62"), "observed_at")
    return monthly.join(j.lagged_asof(rows, o, days, "symbol", ["code"], 2, 366).select("symbol", "date", F.col("code").alias("code_366")), ["symbol", "date"])


add("j7_lagged_asof", _j7, f"""{FULL}, {OBS}, dl AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM days), o1 AS (SELECT symbol, seen, min(code) AS code FROM obs GROUP BY ALL),
ob AS (SELECT symbol, seen, code, d.date AS a1, d.nxt AS a2 FROM o1 ASOF JOIN dl d ON o1.seen < d.date),
b1 AS (SELECT symbol, a1, max(seen) AS seen, arg_max(code, seen) AS code FROM ob GROUP BY ALL), b2 AS (SELECT symbol, a2, max(seen) AS seen, arg_max(code, seen) AS code FROM ob WHERE a2 IS NOT NULL GROUP BY ALL),
x1 AS (SELECT p.symbol, p.date, CASE WHEN p.date - seen <= 62 THEN code END AS code_62, seen FROM p ASOF LEFT JOIN b1 ON p.symbol = b1.symbol AND p.date >= a1),
x2 AS (SELECT p.symbol, p.date, CASE WHEN p.date - seen <= 366 THEN code END AS code_366 FROM p ASOF LEFT JOIN b2 ON p.symbol = b2.symbol AND p.date >= a2)
SELECT symbol, CAST(date AS VARCHAR) AS date, code_62, CAST(seen AS VARCHAR) AS observed_at, code_366 FROM x1 JOIN x2 USING (symbol, date)""")


def _j16(s, d):
    """Suppliers as symbols, renamed in chains of 41; securities at three places of a chain, two of them on one recycled label."""
    k = F.col("s_suppkey").cast("int")
    sup = t.table(s, d, "supplier", ["s_suppkey"])
    name = lambda n: F.concat(F.lit("S"), n.cast("string"))
    renames = sup.where(k % 41 != 40).select(name(k).alias("old"), name(k + 1).alias("new"))
    date = lambda x: F.lit(x).cast("date")
    open_ = F.lit(None).cast("date")
    span = lambda label, a, b: F.struct(label.alias("label"), a.alias("start"), b.alias("end"))
    spans = F.when(k % 41 == 40, F.array(span(F.concat(name(k), F.lit("-199506")), date("1992-01-01"), date("1995-07-01")), span(name(k), date("1996-01-01"), open_))).when(k % 41 == 20, F.array(span(name(k), date("1994-01-01"), open_))).when(k % 41 == 5, F.array(span(name(k), date("1992-01-01"), date("1993-06-01"))))
    securities = sup.select(F.inline(spans))
    isins = sup.where((k % 41).isin(5, 20, 40)).select(F.concat(F.lit("I"), (k % 97).cast("string")).alias("isin"), name(k).alias("label"))
    o = t.table(s, d, "orders", ["o_custkey", "o_orderkey", "o_orderdate"])
    c = F.col("o_custkey").cast("int")
    asked = o.select(F.when(c % 3 == 0, F.concat(F.lower(name(c % 1000)), F.lit("*"))).otherwise(name(c % 1000)).alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("I"), (F.col("o_orderkey") % 97).cast("string"))).alias("isin"), F.to_date("o_orderdate").alias("date"))
    return idy.resolve_identities(asked, securities, renames, isins).withColumn("candidates", F.array_join("candidates", ","))


add("j16_identities", _j16, """WITH k AS (SELECT s_suppkey AS k FROM supplier),
se AS (SELECT 'S' || k || '-199506' AS label, k, DATE '1992-01-01' AS a, DATE '1995-07-01' AS b FROM k WHERE k % 41 = 40 UNION ALL SELECT 'S' || k, k, DATE '1996-01-01', NULL FROM k WHERE k % 41 = 40
 UNION ALL SELECT 'S' || k, k, DATE '1994-01-01', NULL FROM k WHERE k % 41 = 20 UNION ALL SELECT 'S' || k, k, DATE '1992-01-01', DATE '1993-06-01' FROM k WHERE k % 41 = 5),
il AS (SELECT DISTINCT 'I' || (k % 97) AS isin, 'S' || k AS label FROM k WHERE k % 41 IN (5, 20, 40)),
q AS (SELECT DISTINCT CASE WHEN o_custkey % 3 = 0 THEN lower('S' || (o_custkey % 1000)) || '*' ELSE 'S' || (o_custkey % 1000) END AS symbol, o_custkey % 1000 AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'I' || (o_orderkey % 97) END AS isin, CAST(o_orderdate AS DATE) AS date FROM orders),
mx AS (SELECT max(s_suppkey) AS m, min(s_suppkey) AS l FROM supplier),
bs AS (SELECT symbol, isin, date, list_sort(list(DISTINCT label)) AS s FROM q JOIN se ON q.k // 41 = se.k // 41 AND q.k BETWEEN (SELECT l FROM mx) AND (SELECT m + 1 FROM mx) AND date >= a AND (b IS NULL OR date < b) GROUP BY ALL),
bi AS (SELECT symbol, q.isin, date, list_sort(list(DISTINCT il.label)) AS i FROM q JOIN il ON q.isin = il.isin JOIN se ON se.label = il.label WHERE date >= a AND (b IS NULL OR date < b) GROUP BY ALL),
c AS (SELECT q.symbol, q.isin, q.date, CASE WHEN q.isin IS NULL OR q.isin NOT IN (SELECT isin FROM il) THEN coalesce(s, []) WHEN len(coalesce(s, [])) > 0 THEN list_sort(list_intersect(coalesce(i, []), s)) ELSE coalesce(i, []) END AS c
 FROM q LEFT JOIN bs ON bs.symbol = q.symbol AND bs.isin IS NOT DISTINCT FROM q.isin AND bs.date = q.date LEFT JOIN bi ON bi.symbol = q.symbol AND bi.isin = q.isin AND bi.date = q.date)
SELECT symbol, isin, CAST(date AS VARCHAR) AS date, array_to_string(c, ',') AS candidates, CASE WHEN len(c) = 1 THEN c[1] END AS security FROM c""")
