"""Saved ensembles: scores by walking nodes, attributions against sums over all coalitions."""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pytest

from panelforge.operators import trees as tr
from panelforge.sources import readers as rd

COLUMNS = ["a", "b", "c"]


def random_tree(rng, depth):
    """Arrays of one saved tree, children after parents, with covers."""
    t = {k: [] for k in ("left_children", "right_children", "split_indices", "split_conditions", "default_left", "loss_changes", "sum_hessian")}

    def grow(level, cover):
        at = len(t["left_children"])
        leaf = level == 0 or (level < depth and rng.random() < 0.2)
        for k, v in (("left_children", -1), ("right_children", -1), ("split_indices", 0 if leaf else rng.randrange(3)), ("split_conditions", rng.choice([0.1, 0.25, -0.3, 0.7])), ("default_left", int(rng.random() < 0.5)), ("loss_changes", 0.0 if leaf else rng.random()), ("sum_hessian", cover)):
            t[k].append(v)
        if not leaf:
            part = rng.uniform(0.2, 0.8)
            t["left_children"][at] = grow(level - 1, cover * part)
            t["right_children"][at] = grow(level - 1, cover * (1 - part))
        return at

    grow(depth, 100.0)
    return t


def body(trees, features=("c", "a", "b"), best=None):
    model = {"learner": {"gradient_booster": {"model": {"trees": trees}}, "learner_model_param": {"base_score": "[2.5E-1]"}, "feature_names": list(features), "attributes": {} if best is None else {"best_iteration": str(best)}}}
    return json.dumps(model)


def walk(t, x, inside=None, at=0):
    """A tree's value for x; features outside `inside` follow the covers."""
    if t["left_children"][at] < 0:
        return t["split_conditions"][at]
    f, low, high = t["split_indices"][at], t["left_children"][at], t["right_children"][at]
    if inside is not None and f not in inside:
        c = t["sum_hessian"]
        return (c[low] * walk(t, x, inside, low) + c[high] * walk(t, x, inside, high)) / c[at]
    v = x[f]
    left = bool(t["default_left"][at]) if v is None or v != v else np.float32(v) < np.float32(t["split_conditions"][at])
    return walk(t, x, inside, low if left else high)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(8)
    ensembles = {"m": [random_tree(rng, 3) for _ in range(6)], "n": [random_tree(rng, d) for d in (0, 1, 4)]}
    rows = [(i, rng.choice("mn"), *[rng.choice([0.1, 0.25, -0.3, 0.7, rng.uniform(-1, 1), None, float("nan")]) for _ in COLUMNS]) for i in range(60)] + [(60, "other", 0.1, 0.1, 0.1), (61, None, 0.1, None, 0.2)]
    df = spark.createDataFrame(rows, "id int, model string, a double, b double, c double").repartition(3)
    saved = spark.createDataFrame([(m, body(t)) for m, t in ensembles.items()], "model string, body string")
    return ensembles, rows, df, tr.packed_models(rd.saved_trees(saved), rd.saved_heads(saved), COLUMNS)


def own(row):
    """The row's values in the saved order (c, a, b)."""
    return row[4], row[2], row[3]


def test_scores(case):
    ensembles, rows, df, models = case
    got = {r.id: r.model_score for r in tr.score_saved(df, models, COLUMNS).collect()}
    assert len(got) == len(rows)
    for row in rows:
        want = 0.25 + sum(walk(t, own(row)) for t in ensembles[row[1]]) if row[1] in ensembles else None
        assert got[row[0]] == (pytest.approx(want, abs=1e-12) if want is not None else None)


def test_attributions_are_shapley_values(case):
    ensembles, rows, df, models = case
    out = tr.attributions(df, models, COLUMNS)
    got = {r.id: r for r in out.collect()}
    for row in rows:
        r = got[row[0]]
        if row[1] not in ensembles:
            assert r.contributions is None and r.bias is None
            continue
        value = lambda s: 0.25 + sum(walk(t, own(row), s) for t in ensembles[row[1]])  # noqa: B023, E731
        assert r.bias == pytest.approx(value(set()), abs=1e-12)
        assert r.bias + sum(r.contributions) == pytest.approx(value({0, 1, 2}), abs=1e-12)
        for place, f in ((2, 0), (0, 1), (1, 2)):
            rest = [g for g in range(3) if g != f]
            phi = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value({*s, f}) - value(set(s))) for k in range(3) for s in itertools.combinations(rest, k))
            assert r.contributions[place] == pytest.approx(phi, abs=1e-12)
    top = tr.top_attributions(tr.long_attributions(out, COLUMNS, ["id"]), ["id"], 2).collect()
    assert len(top) == 2 * 60 and max(r.place for r in top) == 2


def test_best_iteration_and_errors(spark, case):
    ensembles, rows, df, _ = case
    saved = lambda text: spark.createDataFrame([("m", text)], "model string, body string")
    pack = lambda s, columns: tr.packed_models(rd.saved_trees(s), rd.saved_heads(s), columns)
    got = {r.id: r.model_score for r in tr.score_saved(df, pack(saved(body(ensembles["m"], best=1)), COLUMNS), COLUMNS).collect()}
    row = next(r for r in rows if r[1] == "m")
    assert got[row[0]] == pytest.approx(0.25 + sum(walk(t, own(row)) for t in ensembles["m"][:2]))
    with pytest.raises(ValueError, match="not among the columns"):
        pack(saved(body(ensembles["m"], ("z", "z", "z"))), COLUMNS)
    bare = [{k: v for k, v in ensembles["m"][0].items() if k != "sum_hessian"}]
    models = pack(saved(body(bare)), COLUMNS)
    assert tr.score_saved(df, models, COLUMNS).where("model = 'm'").first().model_score is not None
    with pytest.raises(ValueError, match="covers"):
        tr.attributions(df, models, COLUMNS)
    assert tr.score_saved(df.limit(0), models, COLUMNS).count() == 0 and tr.attributions(df.limit(0), case[3], COLUMNS).count() == 0
