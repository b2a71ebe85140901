"""Queries of saved tree ensembles (M1, M7, M8) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.semantics import rounded
from panelforge.operators import matrix as mx
from panelforge.operators import model as m
from panelforge.operators import scorebook as k
from panelforge.operators import trees as tr
from panelforge.plans.panel_queries import base, predictions
from panelforge.plans.sqlparts import D, FULL, pct, r
from panelforge.sources import readers as rd
from panelforge.sources import tables as t

QUERIES, SQL = {}, {}
COLUMNS = ["score", "vol20", "short", "vs_sma20", "low_vol"]


def add(name, run, sql):
    QUERIES[name] = lambda s, d: rounded(run(s, d))
    SQL[name] = f"{FULL}{TREES} {sql}"


def boosters(s, d, columns=COLUMNS, scale=1.0):
    """(model, body): a saved booster a region, with a tree of two levels a nation; thresholds and covers come from all its suppliers."""
    held = t.table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"), (F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) / 100000).alias("t"))
    n = t.table(s, d, "nation").join(held, "n_nationkey", "left").join(F.broadcast(t.table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    key, x, c = F.col("n_nationkey").cast("int"), F.coalesce("t", F.lit(0.01)) * scale, F.coalesce("c", F.lit(1)).cast("double")
    ints = lambda *v: F.array(*[(i if not isinstance(i, int) else F.lit(i)).cast("int") for i in v])
    left = (key % 6 + 1).cast("double")
    tree = F.struct(
        ints(1, 3, 5, -1, -1, -1, -1).alias("left_children"), ints(2, 4, 6, -1, -1, -1, -1).alias("right_children"),
        ints(key % 5, F.when(key % 2 == 0, (key + 1) % 5).otherwise(key % 5), (key + 2) % 5, 0, 0, 0, 0).alias("split_indices"),
        F.array(x, -x / 2, x * 1.5, -x, x / 2, x, -x / 3).alias("split_conditions"),
        ints(key % 2, F.when(key % 3 == 0, 1).otherwise(0), 1, 0, 0, 0, 0).alias("default_left"),
        F.array(x * 100, F.abs(x) * 7, F.abs(x) * 3, *[F.lit(0.0)] * 4).alias("loss_changes"),
        F.array(c * 8, c * left, c * (8 - left), c * left / 4, c * left * 0.75, c * (8 - left) * 0.6, c * (8 - left) * 0.4).alias("sum_hessian"),
    )
    models = n.groupBy(F.col("r_name").alias("model")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", tree.alias("t")))), lambda y: y["t"]).alias("trees"))
    head = F.struct(F.struct(F.struct("trees").alias("model")).alias("gradient_booster"), F.struct(F.lit("5E-1").alias("base_score")).alias("learner_model_param"), F.array(*map(F.lit, columns)).alias("feature_names"), F.struct(F.lit("3").alias("best_iteration")).alias("attributes"))
    return models.select("model", F.to_json(F.struct(head.alias("learner"))).alias("body"))


def packed(s, d, columns=COLUMNS, scale=1.0):
    saved = boosters(s, d, columns, scale)
    return tr.packed_models(rd.saved_trees(saved), rd.saved_heads(saved), columns)


#: The same trees without their saved form: a row a nation, with the sides that a row of `sc` takes.
TREES = """, tr AS (SELECT r_name AS model, n_nationkey % 5 AS f0, CASE WHEN n_nationkey % 2 = 0 THEN (n_nationkey + 1) % 5 ELSE n_nationkey % 5 END AS f1, (n_nationkey + 2) % 5 AS f2,
 n_nationkey % 2 = 1 AS d0, n_nationkey % 3 = 0 AS d1, true AS d2, (n_nationkey % 6 + 1) / 8.0::DOUBLE AS z0, 0.25::DOUBLE AS z1, 0.6::DOUBLE AS z2, n_nationkey, (SELECT count(*) FROM nation o WHERE o.n_regionkey = nation.n_regionkey AND o.n_nationkey < nation.n_nationkey) AS tree, coalesce(t, 0.01) AS t
 FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 100000 AS t FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey),
sx AS (SELECT symbol, date, sector, [CAST(score AS FLOAT), CAST(vol20 AS FLOAT), CAST(short AS FLOAT), CAST(vs_sma20 AS FLOAT), CAST(low_vol AS FLOAT)] AS x FROM sc),
sd AS (SELECT symbol, date, model, f0, f1, f2, z0, z1, z2, t, coalesce(x[f0 + 1] < CAST(t AS FLOAT), d0) AS g0, coalesce(x[f1 + 1] < CAST(-t / 2 AS FLOAT), d1) AS g1, coalesce(x[f2 + 1] < CAST(t * 1.5 AS FLOAT), d2) AS g2
 FROM sx JOIN tr ON model = sector WHERE tree <= 3)"""
add("m1_score_trees", lambda s, d: tr.score_saved(predictions(s, d), packed(s, d), COLUMNS, "sector").select("symbol", "date", F.col("model_score").alias("score")),
    f"SELECT symbol, {D}, {r('0.5 + sum(CASE WHEN g0 AND g1 THEN -t WHEN g0 THEN t / 2 WHEN g2 THEN t ELSE -t / 3 END)', 'score')} FROM sd GROUP BY symbol, date")
add("m7_attribution", lambda s, d: m.attribution_summary(tr.long_attributions(tr.attributions(predictions(s, d).select("symbol", "date", "sector", *COLUMNS), packed(s, d), COLUMNS, "sector"), COLUMNS, ["symbol", "date", "sector"]), ["sector"]),
    f""", lf AS (SELECT symbol, date, model, f0 AS fa, unnest([g0, g0, NOT g0, NOT g0])::INT::DOUBLE AS oa, unnest([z0, z0, 1 - z0, 1 - z0]) AS za, unnest([f1, f1, f2, f2]) AS fb, unnest([g1, NOT g1, g2, NOT g2])::INT::DOUBLE AS ob, unnest([z1, 1 - z1, z2, 1 - z2]) AS zb, unnest([-t, t / 2, t, -t / 3]) AS v FROM sd),
ct AS (SELECT symbol, date, fa AS f, CASE WHEN fa = fb THEN v * (oa * ob - za * zb) ELSE v * (oa - za) * (ob + zb) / 2 END AS x FROM lf UNION ALL SELECT symbol, date, fb, v * (ob - zb) * (oa + za) / 2 FROM lf WHERE fa <> fb),
al AS (SELECT sector, ['score', 'vol20', 'short', 'vs_sma20', 'low_vol'][f + 1] AS feature, coalesce(y, 0) AS x FROM sx CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS f) LEFT JOIN (SELECT symbol, date, f, sum(x) AS y FROM ct GROUP BY ALL) USING (symbol, date, f))
SELECT sector, feature, {r('avg(abs(x))', 'mean_abs')}, {r('avg(x)', 'mean')}, {r('avg(CAST(x > 0 AS INTEGER))', 'positive')}, {r('quantile_cont(x, 0.05)', 'p05')}, {r('quantile_cont(x, 0.5)', 'p50')}, {r('quantile_cont(x, 0.95)', 'p95')} FROM al GROUP BY sector, feature""")


def _m8(s, d):
    saved = boosters(s, d)
    nodes = rd.saved_trees(saved).join(rd.saved_heads(saved), "model").withColumn("feature", F.when(~F.col("leaf"), F.col("features")[F.col("split_index")]))
    return m.gain_importance(nodes)


add("m8_gain_importance", _m8, f"""SELECT ['score', 'vol20', 'short', 'vs_sma20', 'low_vol'][f + 1] AS feature, {r('avg(g)', 'gain')}, count(*) AS splits
 FROM (SELECT unnest([f0, f1, f2]) AS f, unnest([t * 100, abs(t) * 7, abs(t) * 3]) AS g FROM tr) GROUP BY f""")


# K6: names outside a cached cross-section
PLACED = ["r20_rank", "vol20_rank", "r5_rank", "vs_sma20_rank", "r20_minus_sector_median"]
RAW = ["r20", "vol20", "r5", "vs_sma20"]


def _k6(s, d):
    """ASIA as outsiders that pass for EUROPE, all others as the cached reference; the first region's model with thresholds in ranks."""
    df = base(s, d).select("symbol", "date", "sector", *RAW).dropna(subset=RAW)
    reference = df.where("sector != 'ASIA'")
    outsiders = df.where("sector = 'ASIA'").withColumn("sector", F.lit("EUROPE"))
    models = packed(s, d, PLACED, 10.0)
    alone = reference.join(mx.ranks(reference, RAW, ["r20"]), ["symbol", "date"]).withColumn("model", F.lit("AFRICA"))
    frozen = tr.score_saved(alone, models, PLACED).select("date", F.col("model_score").alias("score"))
    return k.place_outsiders(reference, outsiders, frozen, models, "AFRICA", PLACED, RAW, ["r20"])


def _placed(name: str, where: str) -> str:
    """Scores of a cross-section, ranked outright, as a common table expression."""
    ranks = ", ".join(f"CAST({pct(c, 'date')} AS FLOAT)" for c in RAW)
    return f"""{name}0 AS (SELECT * FROM un WHERE {where}), {name}1 AS (SELECT symbol, date, outs, [{ranks}, CAST(r20 - median(r20) OVER (PARTITION BY date, sector) AS FLOAT)] AS x FROM {name}0),
{name}2 AS (SELECT symbol, date, outs, t * 10 AS t, coalesce(x[f0 + 1] < CAST(t * 10 AS FLOAT), d0) AS g0, coalesce(x[f1 + 1] < CAST(-t * 5 AS FLOAT), d1) AS g1, coalesce(x[f2 + 1] < CAST(t * 15 AS FLOAT), d2) AS g2 FROM {name}1 JOIN tr ON model = 'AFRICA' WHERE tree <= 3),
{name} AS (SELECT symbol, date, outs, 0.5 + sum(CASE WHEN g0 AND g1 THEN -t WHEN g0 THEN t / 2 WHEN g2 THEN t ELSE -t / 3 END) AS score FROM {name}2 GROUP BY symbol, date, outs)"""


add("k6_outsiders", _k6, f""", un AS (SELECT symbol, date, CASE WHEN sector = 'ASIA' THEN 'EUROPE' ELSE sector END AS sector, sector = 'ASIA' AS outs, r20, vol20, r5, vs_sma20 FROM feat WHERE r20 IS NOT NULL AND vol20 IS NOT NULL AND r5 IS NOT NULL AND vs_sma20 IS NOT NULL),
{_placed('ua', 'true')}, {_placed('ub', 'NOT outs')}, uc AS (SELECT symbol, date, score, round(score, 9) AS s, true AS own FROM ua WHERE outs UNION ALL SELECT symbol, date, score, round(score, 9), false FROM ub),
ud AS (SELECT *, 1 + count(*) FILTER (NOT own) OVER (PARTITION BY date ORDER BY s DESC) - count(*) FILTER (NOT own) OVER (PARTITION BY date, s) AS place, count(*) FILTER (NOT own) OVER (PARTITION BY date) AS of FROM uc)
SELECT symbol, {D}, {r('score', 'score')}, place, of, {r('100 * (1 - (place - 1) / greatest(of - 1, 1))', 'percentile')} FROM ud WHERE own""")
