"""Forests are grown from the cells of the rows, and are like Spark's own on the rows."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from tablelens.ml import forest, search, store
from tablelens.session import scratch_path


@pytest.fixture(scope="module")
def boats(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        length, mast, crew = rng.gauss(9, 2), rng.randrange(2), rng.randrange(4)
        speed = length / 2 + 3 * mast + crew * mast + rng.gauss(0, 1)
        rows.append((i, length, float(mast), float(crew), speed, float(speed > 7), float(min(3, max(0, int(speed / 3))))))
    df = spark.createDataFrame(rows, "boat int, length double, mast double, crew double, speed double, fast double, rank double")
    return VectorAssembler(inputCols=["length", "mast", "crew"], outputCol="features").transform(df).repartition(3).cache()


class Passed(Exception):
    pass


def refuse(data):
    raise Passed(data.count())


@pytest.mark.parametrize("target, problem, classes", [("speed", "regression", 2), ("fast", "classification", 2), ("rank", "classification", 4)])
def test_forests_are_like_those_of_the_rows(boats, monkeypatch, target, problem, classes):
    data = boats.withColumn("label", boats[target]).select("boat", "features", "label")
    ours = search.candidate("random_forest", problem, classes=classes, depth=8)
    own = ours.estimator.fit(data)
    monkeypatch.setattr(ours.estimator, "fit", refuse)
    model = search.fit(ours, data)
    assert type(model) is type(own) and model.getNumTrees == 100 and model.numFeatures == 3 and model.getMaxDepth() == 8
    assert model.totalNumNodes == pytest.approx(own.totalNumNodes, rel=0.1)
    assert model.featureImportances.toArray() == pytest.approx(own.featureImportances.toArray(), abs=0.05)
    value = "prediction" if problem == "regression" else "probability"

    def told(m):
        rows = [r[0] for r in m.transform(data).orderBy("boat").select(value).collect()]
        return np.array([r if problem == "regression" else r.toArray() for r in rows])

    # About as far from Spark's forest as that is from one of its own with another seed.
    other = told(search.candidate("random_forest", problem, seed=7, classes=classes, depth=8).estimator.fit(data))
    got, want = told(model), told(own)
    assert got.shape == want.shape and abs(got - want).mean() < 2 * abs(other - want).mean()


def test_work_does_not_grow_with_copies(boats, monkeypatch):
    """As many cells are drawn from three copies of the rows, and none of their rows is left out."""
    seen = []

    def model(self, nodes, width, classes):
        raise Passed

    for data in (boats, boats.union(boats).union(boats)):
        ours = search.candidate("random_forest", "classification")
        real = forest.materialize
        monkeypatch.setattr(forest, "materialize", lambda df, label: seen.append(real(df, label)) or seen[-1])
        monkeypatch.setattr(forest.ForestOnCells, "model", model)
        with pytest.raises(Passed):
            ours.fit(data.withColumn("label", data["fast"]).select("features", "label"))
        monkeypatch.undo()
    once, thrice = ([r["weight"] for r in cells.collect()] for cells in seen)
    assert len(once) == len(thrice) <= 2 * 32 * 2 * 4
    assert (sum(once), sum(thrice)) == (1200, 3600)


@pytest.mark.parametrize("classes", [True, False])
def test_equal_rows_are_drawn_as_single_rows_would_be(spark, classes):
    cells = spark.createDataFrame([([1, 2], 3.0, 300), ([1, 2], 5.0, 100)], "bins array<tinyint>, label double, weight bigint").coalesce(1)
    schema = "tree int, bins array<tinyint>, weight double, " + ("label double" if classes else "total double, squares double")
    rows = cells.mapInArrow(forest._drawn(2000, 1, classes), schema).toPandas()
    counts = rows.groupby("tree")["weight"].sum()
    assert len(counts) == 2000 and counts.mean() == pytest.approx(400, rel=0.01) and counts.var() == pytest.approx(400, rel=0.15)
    if not classes:
        assert len(rows) == 2000 and rows["total"].mean() == pytest.approx(1400, rel=0.01) and rows["total"].var() == pytest.approx(300 * 9 + 100 * 25, rel=0.15)
        assert rows["squares"].mean() == pytest.approx(300 * 9 + 100 * 25, rel=0.01)


def test_too_many_cells_for_a_task_are_left_to_rows(boats, monkeypatch):
    monkeypatch.setattr(forest, "MOST_BINS", 50)
    ours = search.candidate("random_forest", "regression")
    monkeypatch.setattr(ours.estimator, "fit", refuse)
    with pytest.raises(Passed) as passed:
        search.fit(ours, boats.withColumn("label", boats["speed"]))
    assert passed.value.args == (1200,)


def test_a_constant_label_is_left_to_rows(boats, monkeypatch):
    ours = search.candidate("random_forest", "regression")
    monkeypatch.setattr(ours.estimator, "fit", refuse)
    with pytest.raises(Passed):
        search.fit(ours, boats.selectExpr("features", "949.95D AS label"))


def test_nodes_of_a_tree():
    bins = np.array([[1, 1], [1, 2], [2, 1], [2, 2]])
    nodes = forest.grow(bins, [np.array([2.0, 1, 3, 0]), np.array([0.0, 0, 1, 1])], [[0.5], [0.5]], 2, 30, 2, np.random.default_rng(0))
    assert nodes["stats"].tolist() == [[3, 3], [3, 0], [0, 3]] and nodes["left"].tolist() == [1, -1, -1]
    assert nodes["feature"].tolist() == [0, -1, -1] and nodes["gain"][0] == pytest.approx(0.5) and nodes["prediction"].tolist()[1:] == [0, 1]
    values = [np.array([1.0, 1, 1, 1]), np.array([5.0, 6, 1, 2]), np.array([25.0, 36, 1, 4])]
    deep = forest.grow(bins, values, [[0.5], [0.5]], 2, 30, 0, np.random.default_rng(0))
    assert deep["prediction"].tolist() == [3.5, 5.5, 1.5, 5, 6, 1, 2] and deep["left"].tolist() == [1, 3, 5, -1, -1, -1, -1]
    flat = forest.grow(bins, values, [[0.5], [0.5]], 2, 1, 0, np.random.default_rng(0))
    assert flat["prediction"].tolist() == [3.5, 5.5, 1.5]
    # Sibling leaves of the same class are one leaf.
    mixed = [np.array([[1, 1], [1, 1], [2, 1], [2, 1]]), [np.array([3.0, 1, 2, 1]), np.array([0.0, 1, 0, 1])]]
    assert forest.grow(*mixed, [[0.5], [0.5]], 2, 30, 2, np.random.default_rng(0))["stats"].tolist() == [[5, 2]]


def test_a_forest_champion_is_stored(spark, boats):
    df = boats.select("boat", "length", "mast", "crew", "fast")
    best = search.train_champion(df, "fast", "classification", features=["length", "mast", "crew"], key=["boat"], algorithms=["random_forest"], trees=10)
    assert {r["feature"] for r in best.importances.collect()} == {"length", "mast", "crew"}
    root = scratch_path(spark, "m")
    model, roles, problem = store.load_model(spark, root, store.save_model(best, root, "boats"))
    told = [search.score(m, roles, df, problem).orderBy("boat").collect() for m in (model, best.model)]
    assert told[0] == told[1] and len(told[0]) == 1200
