"""Saved tree ensembles over a panel: scores by a native walk over arrays of nodes, and exact path-dependent attributions.

An ensemble is a table of nodes, as `readers.saved_trees` gives it, with a row of head values a model. It is packed into a
row a model (arrays of trees of nodes) and broadcast behind a check of its size; scoring needs no generated code, whatever
the number of models and trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nodes of all models together that may be broadcast (some 50 bytes each).
MOST_NODES = 1_000_000


def packed_models(nodes: DataFrame, heads: DataFrame, columns: list[str]) -> DataFrame:
    """(model, base, trees): trees as arrays of nodes (f, t, l, r, d, v, c) whose feature f is a place in `columns`.

    Trees after a model's best_iteration are left out. Features that `columns` lacks, and models of more than
    MOST_NODES nodes together, are errors.
    """
    names = F.array(*map(F.lit, columns))
    kept = nodes.join(F.broadcast(heads), "model").where("best_iteration is null or tree <= best_iteration")
    feature = F.try_element_at(F.coalesce("features", names), F.col("split_index") + 1)
    place = F.when(~F.col("leaf"), F.array_position(names, feature).cast("int") - 1)
    node = F.struct("node", place.alias("f"), F.col("condition").cast("float").alias("t"), F.col("left").alias("l"), F.col("right").alias("r"), F.col("default_left").alias("d"), F.col("condition").alias("v"), F.col("cover").alias("c"))
    rows = kept.select("model", "base", "tree", "leaf", place.alias("place"), feature.alias("feature"), node.alias("n"))
    size, unknown = rows.agg(F.count(F.lit(1)), F.min(F.when(~F.col("leaf") & (F.coalesce("place", F.lit(-1)) < 0), F.coalesce("feature", F.lit("?"))))).first()
    if unknown is not None:
        raise ValueError(f"the model splits on {unknown}, which is not among the columns")
    if size > MOST_NODES:
        raise ValueError(f"{size} nodes are more than {MOST_NODES}: score models in groups")
    trees = rows.groupBy("model", "base", "tree").agg(F.array_sort(F.collect_list("n")).alias("nodes"))
    return trees.groupBy("model", "base").agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "nodes"))), lambda x: x["nodes"]).alias("trees"))


def _leaf(tree: Column, x: Column) -> Column:
    """The number of the leaf that x ends in: a fold with one step a level; missing values go to the default side.

    A binary tree of n nodes is at most n/2 levels deep; steps after the leaf stay where they are.
    """
    def step(at: Column, _: Column) -> Column:
        n = tree[at]
        value = x[n["f"]]
        left = F.when(value.isNull() | F.isnan(value), n["d"]).otherwise(value < n["t"])
        return F.when(n["l"] < 0, at).when(left, n["l"]).otherwise(n["r"])

    return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(tree) / 2).cast("int")), F.lit(0), step)


def score_saved(df: DataFrame, models: DataFrame, columns: list[str], by: str = "model") -> DataFrame:
    """Adds `model_score`: base plus the leaves of all trees of the row's model (column `by`); no such model: null.

    Splits compare in single precision, strictly below going left. To score a row with several models, explode their
    names into `by`.
    """
    x = F.array(*[F.col(c).cast("float") for c in columns])
    joined = df.withColumn("_x", x).join(F.broadcast(models.select(F.col("model").alias(by), "base", "trees")), by, "left")
    total = F.aggregate("trees", F.col("base"), lambda s, tree: s + tree[_leaf(tree, F.col("_x"))]["v"])
    return joined.withColumn("model_score", total).drop("_x", "base", "trees")


class Paths:
    """One model's leaves for attribution: for each, its value and the distinct features on its path with their cover shares."""

    def __init__(self, base: float, trees: list):
        self.bias, self.trees = float(base), []
        for tree in trees:
            leaves = []
            todo = [(0, {}, 1.0)]
            while todo:
                at, path, share = todo.pop()
                n = tree[at]
                if n["l"] < 0:
                    leaves.append((float(n["v"]), path))
                    self.bias += float(n["v"]) * share
                    continue
                for child, goes_left in ((n["l"], True), (n["r"], False)):
                    part = tree[child]["c"] / n["c"]
                    conditions, z = path.get(n["f"], ((), 1.0))
                    todo.append((child, path | {n["f"]: (((*conditions, (at, goes_left))), z * part)}, share * part))
            splits = {i: (n["f"], np.float32(n["t"]), bool(n["d"])) for i, n in enumerate(tree) if n["l"] >= 0}
            self.trees.append((splits, leaves))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of every row and column of x, features outside a coalition following the covers.

        For one leaf the game is a product over the features of its path: 1 or 0 (the row's value leads there or not)
        inside the coalition, the cover share outside. The weights of coalitions by size come from the product's
        polynomial, one feature left out at a time.
        """
        out = np.zeros(x.shape)
        for splits, leaves in self.trees:
            left = {i: np.where(np.isnan(x[:, f]), d, x[:, f] < t) for i, (f, t, d) in splits.items()}
            for value, path in leaves:
                there = {f: np.logical_and.reduce([left[i] == goes for i, goes in conditions]).astype(float) for f, (conditions, _) in path.items()}
                m = len(path)
                for f, (_, z) in path.items():
                    sizes = [np.ones(len(x))]
                    for g, (_, zg) in path.items():
                        if g != f:
                            sizes = [(sizes[k] * zg if k < len(sizes) else 0) + (sizes[k - 1] * there[g] if k else 0) for k in range(len(sizes) + 1)]
                    weight = 1.0 / m
                    total = np.zeros(len(x))
                    for k, s in enumerate(sizes):
                        total += s * weight
                        weight *= (k + 1) / (m - 1 - k) if k < m - 1 else 1
                    out[:, f] += value * (there[f] - z) * total
        return out


def attributions(df: DataFrame, models: DataFrame, columns: list[str], by: str = "model") -> DataFrame:
    """Adds `contributions` (array of doubles, in the order of `columns`) and `bias`; they sum to `score_saved`'s score.

    Attributions are exact path-dependent Shapley values of the row's model, in tasks over Arrow batches. Rows of an
    unknown model get nulls; a node without cover is an error, as nothing says how the absent features split.
    """
    found = [(r["model"], r["base"], r["trees"]) for r in models.collect()]  # bounded by packed_models
    if any(n["c"] is None or (n["l"] >= 0 and not n["c"] > 0) for _, _, trees in found for tree in trees for n in tree):
        raise ValueError("attributions need the covers of all nodes")
    plain = [(m, b, [[n.asDict() for n in tree] for tree in trees]) for m, b, trees in found]
    rows = df.withColumn("_x", F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(float("nan")).cast("float")) for c in columns])).withColumn("_m", F.col(by).cast("string"))
    schema = T.StructType([*df.schema.fields, T.StructField("contributions", T.ArrayType(T.DoubleType())), T.StructField("bias", T.DoubleType())])
    sent, width = df.sparkSession.sparkContext.broadcast(json.dumps([(str(m), b, t) for m, b, t in plain])), len(columns)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = {m: Paths(b, trees) for m, b, trees in json.loads(sent.value)}
        for batch in batches:
            x = batch.column(batch.num_columns - 2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            which = np.array(batch.column(batch.num_columns - 1).to_pylist(), dtype=object)
            out, bias, known = np.zeros(x.shape), np.zeros(len(x)), np.zeros(len(x), dtype=bool)
            for m in set(which) & set(paths):
                here = which == m
                out[here], bias[here], known[here] = paths[m].contributions(x[here]), paths[m].bias, True
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, width, dtype=np.int32), out.ravel()) if width else pa.array([[]] * len(x), pa.list_(pa.float64()))
            lists = pa.array([v if k else None for v, k in zip(lists.to_pylist(), known, strict=True)], pa.list_(pa.float64())) if not known.all() else lists
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], lists, pa.array(bias, mask=~known)], schema.names)

    return rows.mapInArrow(explain, schema)


def long_attributions(explained: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, contribution) of `attributions`, a row a feature."""
    pairs = F.arrays_zip(F.array(*map(F.lit, columns)).alias("feature"), F.col("contributions").alias("contribution"))
    return explained.where("contributions is not null").select(*keys, F.inline(pairs).alias("feature", "contribution"))


def top_attributions(long: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k contributions of each row largest in size, in order; ties by feature."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("contribution")), "feature"))
    return long.withColumn("place", place).where(F.col("place") <= k)
