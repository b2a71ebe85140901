"""Model data: saved tree ensembles as columns, rankers trained per fold, attribution summaries."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.sources.shared import durable


def nodes_of(text: str, features: list[str]) -> list[dict]:
    """Rows (tree, node, feature, threshold, left, right, default_left, value, gain) of a saved booster's JSON."""
    trees = json.loads(text)["learner"]["gradient_booster"]["model"]["trees"]
    rows = []
    for t, tree in enumerate(trees):
        for i, left in enumerate(tree["left_children"]):
            leaf = left < 0
            rows.append({
                "tree": t, "node": i, "feature": None if leaf else features[tree["split_indices"][i]], "threshold": float(tree["split_conditions"][i]), "left": left,
                "right": tree["right_children"][i], "default_left": bool(tree["default_left"][i]), "value": float(tree["split_conditions"][i]) if leaf else None, "gain": float(tree["loss_changes"][i]),
            })
    return rows


def tree_column(nodes: dict[int, dict], at: int = 0) -> Column:
    """One tree as nested conditions: float comparison, missing values to the default side."""
    n = nodes[at]
    if n["value"] is not None:
        return F.lit(n["value"])
    x = F.col(n["feature"]).cast("float")
    side = F.when(x.isNull() | F.isnan(x), F.lit(n["default_left"])).otherwise(x < F.lit(n["threshold"]).cast("float"))
    return F.when(side, tree_column(nodes, n["left"])).otherwise(tree_column(nodes, n["right"]))


def score_trees(df: DataFrame, rows: list[dict], base: float = 0.0, chunk: int = 25, best: int | None = None) -> DataFrame:
    """Adds `score`, the sum of all trees up to `best`; trees go in chunks to stay inside code generation limits."""
    by: dict[int, dict[int, dict]] = {}
    for r in rows:
        if best is None or r["tree"] <= best:
            by.setdefault(r["tree"], {})[r["node"]] = r
    trees = [tree_column(by[t]) for t in sorted(by)]
    names = []
    for i in range(0, len(trees), chunk):
        names.append(f"_trees{i}")
        df = df.withColumn(names[-1], reduce(lambda a, b: a + b, trees[i : i + chunk]))
    return df.withColumn("score", reduce(lambda a, b: a + b, [F.col(n) for n in names], F.lit(base))).drop(*names)


def gain_importance(nodes: DataFrame, most: int = 25) -> DataFrame:
    """Mean gain of each feature's splits."""
    return nodes.where("feature is not null").groupBy("feature").agg(F.avg("gain").alias("gain"), F.count(F.lit(1)).alias("splits")).orderBy(F.desc("gain"), "feature").limit(most)


def attribution_summary(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By feature (and `by`) of (feature, contribution): mean size, mean, positive share and quantiles."""
    q = F.percentile("contribution", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    g = long.groupBy(*(by or []), "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean"), F.avg((F.col("contribution") > 0).cast("int")).alias("positive"), q.alias("q"))
    return g.select(*(by or []), "feature", "mean_abs", "mean", "positive", *[F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p50", "p95"))])


def linear_contributions(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Contribution of each feature to a linear score, against its mean over the table."""
    means = df.agg(*[F.avg(c).alias(c) for c in weights]).first()
    parts = [F.struct(F.lit(c).alias("feature"), (F.lit(w) * (F.col(c) - F.lit(means[c]))).alias("contribution")) for c, w in weights.items()]
    return df.select("symbol", "date", F.inline(F.array(*parts))).where("contribution is not null")


def train_ranker(train: DataFrame, features: list[str], label: str = "grade", weight: str | None = None, depth: int = 3, trees: int = 20, seed: int = 42):
    """A pointwise gradient-boosted regressor on relevance grades; not the pairwise ranker of boosting libraries."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    gbt = GBTRegressor(labelCol=label, maxDepth=depth, maxIter=trees, seed=seed, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), gbt]).fit(train)


def train_classifier(train: DataFrame, features: list[str], label: str, depth: int = 3, trees: int = 20, seed: int = 42):
    """A boosted classifier whose classes weigh the same in sum."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    n = dict(train.groupBy(label).count().collect())
    total = sum(n.values())
    weight = reduce(lambda acc, y: acc.when(F.col(label) == y, total / (len(n) * n[y])), list(n)[1:], F.when(F.col(label) == list(n)[0], total / (len(n) * n[list(n)[0]])))
    gbt = GBTClassifier(labelCol=label, maxDepth=depth, maxIter=trees, seed=seed, weightCol="_w")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), gbt]).fit(train.withColumn("_w", weight))


def ndcg(scored: DataFrame, k: int) -> DataFrame:
    """NDCG at k by date, gains 2^grade - 1."""
    from pyspark.sql import Window

    w = Window.partitionBy("date")
    df = scored.withColumns({"p": F.row_number().over(w.orderBy(F.desc("score"), "symbol")), "i": F.row_number().over(w.orderBy(F.desc("grade"), "symbol"))})
    gain = lambda place: F.sum(F.when(F.col(place) <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(place) + 1)))
    return df.groupBy("date").agg((gain("p") / gain("i")).alias("ndcg"))


def fold_predictions(df: DataFrame, folds: DataFrame, arms: dict[str, dict], label: str = "grade") -> DataFrame:
    """Predictions of several arms over the same folds: (strategy, fold, date, symbol, sector, outcome, grade, score).

    An arm is a choice of features and trainer settings: {"features": [...], "depth": 3, "trees": 20}. Each fold's
    model is trained on its training dates and scores its test dates; arms and folds are few, so they are a loop
    on the driver, and each fit is a Spark job. A fit passes over its rows many times, so rows and folds are computed once before.
    """
    df, folds, out = durable(df), durable(folds), None
    for (fold,) in folds.select("fold").distinct().orderBy("fold").collect():
        dates = folds.where(F.col("fold") == fold)
        train = df.join(F.broadcast(dates.where("split = 'train'").select("date")), "date", "left_semi")
        test = df.join(F.broadcast(dates.where("split = 'test'").select("date")), "date", "left_semi")
        for name, arm in arms.items():
            settings = {k: v for k, v in arm.items() if k != "features"}
            scored = train_ranker(train.withColumn(label, F.col(label).cast("double")), arm["features"], label, **settings).transform(test)
            part = scored.select(F.lit(name).alias("strategy"), F.lit(fold).alias("fold"), "date", "symbol", "sector", "outcome", "grade", F.col("prediction").alias("score"))
            out = part if out is None else out.unionByName(part)
    return out


def ablation_arms(features: list[str], groups: dict[str, list[str]], **settings) -> dict[str, dict]:
    """One arm with all features, and one without each group of name patterns."""
    import re

    arms = {"all": {"features": features, **settings}}
    for name, patterns in groups.items():
        kept = [c for c in features if not any(re.search(p, c) for p in patterns)]
        if kept and len(kept) < len(features):
            arms[f"without_{name}"] = {"features": kept, **settings}
    return arms


def preset_arms(features: list[str], presets: dict[str, dict]) -> dict[str, dict]:
    """One arm for each preset of trainer settings, all with the same features."""
    return {name: {"features": features, **settings} for name, settings in presets.items()}
