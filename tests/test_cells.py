"""Boosted trees are fitted to the cells of the rows, and predict what Spark's own do on the rows."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor

from tablelens.ml import cells, search, store
from tablelens.session import scratch_path


@pytest.fixture(scope="module")
def shots(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        x, side = rng.gauss(0, 1), rng.randrange(2)
        rows.append((i, x, float(side), 2 * x + side + rng.gauss(0, 0.5), float(x + rng.gauss(0, 0.3) > 0.2), float(int(abs(x)) + side)))
    df = spark.createDataFrame(rows, "shot int, x double, side double, height double, hit double, zone double")
    return VectorAssembler(inputCols=["x", "side"], outputCol="features").transform(df).repartition(3).cache()


@pytest.mark.parametrize("target, problem, classes", [("height", "regression", 2), ("hit", "classification", 2), ("zone", "classification", 5)])
def test_predictions_are_those_of_the_rows(shots, target, problem, classes):
    data = shots.withColumn("label", shots[target])
    settings = {"maxIter": 6, "maxDepth": 3, "stepSize": 0.1, "seed": 42}
    own = GBTRegressor(**settings) if problem == "regression" else GBTClassifier(**settings)
    own = OneVsRest(classifier=own) if classes > 2 else own
    want = {r["shot"]: r["prediction"] for r in own.fit(data).transform(data).collect()}
    model = search.fit(search.candidate("gradient_boosting", problem, classes=classes, rounds=6), data)
    got = {r["shot"]: r["prediction"] for r in model.transform(data).collect()}
    assert [got[k] for k in sorted(got)] == pytest.approx([want[k] for k in sorted(want)])


class Seen(Exception):
    pass


class Estimator:
    def fit(self, data):
        raise Seen(data.count(), data.agg({"weight": "sum"}).first()[0])


@pytest.mark.parametrize("classes, most", [(False, 64), (True, 128)])
def test_cells_do_not_grow_with_the_rows(shots, classes, most):
    data = shots.withColumn("label", shots["hit"])
    for rows in (data, data.union(data).union(data)):
        with pytest.raises(Seen) as seen:
            cells.OnCells(Estimator(), classes, 42).fit(rows.select("features", "label"))
        assert seen.value.args[0] <= most and seen.value.args[1] == rows.count()


def test_bounds():
    assert cells.bounds(np.array([2.0, 2.0])) == []
    assert cells.bounds(np.array([1.0, 3.0, 3.0, 4.0])) == [2.0, 3.5]
    many = cells.bounds(np.arange(1000.0))
    assert len(many) == cells.BINS - 1 and max(abs(np.diff(many) - 1000 / 32)) <= 1


def test_all_rows_are_learned_from_above_the_rows_that_choose_bounds(shots, monkeypatch):
    monkeypatch.setattr(cells, "BOUND_ROWS", 200)
    with pytest.raises(Seen) as seen:
        cells.OnCells(Estimator(), False, 42).fit(shots.withColumn("label", shots["height"]).select("features", "label"))
    assert seen.value.args[1] == 900


def test_a_boosted_champion_is_stored(spark, shots):
    df = shots.select("shot", "x", "side", "height")
    best = search.train_champion(df, "height", features=["x", "side"], key=["shot"], algorithms=["gradient_boosting"], rounds=3)
    assert {r["feature"] for r in best.importances.collect()} == {"x", "side"}
    root = scratch_path(spark, "m")
    model, roles, problem = store.load_model(spark, root, store.save_model(best, root, "shots"))
    told = [search.score(m, roles, df, problem).orderBy("shot").collect() for m in (model, best.model)]
    assert told[0] == told[1] and len(told[0]) == 900
