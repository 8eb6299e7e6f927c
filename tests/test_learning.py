import random

import pytest
from pyspark.sql import functions as F

from tablelens import TableError
from tablelens.ml import evaluate, prepare, search, split, store
from tablelens.session import scratch_path


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(0)
    rows = []
    for i in range(240):
        x, kind = rng.gauss(0, 1), rng.choice("abc")
        y = 3 * x + {"a": 0, "b": 5, "c": 10}[kind]
        day = f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}" if i % 9 else None
        rows.append((i, x if i % 11 else None, kind if i % 13 else None, day, y, "hi" if y > 5 else "lo"))
    return spark.createDataFrame(rows, "row_id int, x double, kind string, day string, y double, side string")


def test_problem_type_vectors(spark):
    def kind(values, t):
        return prepare.detect_problem_type(spark.createDataFrame([(v,) for v in values], f"y {t}"), "y")

    assert kind(["yes", "no", "yes", "no"], "string") == "classification"
    assert kind([0, 1, 0, 1, 1], "int") == "classification"
    assert kind([float(i) + 0.5 for i in range(12)], "double") == "regression"
    assert kind([None], "double") == "classification"


def test_training_checks(spark):
    tiny = spark.createDataFrame([(1, 2), (2, 3)], "id int, score int")
    with pytest.raises(TableError):
        search.train_champion(tiny, "score")
    with pytest.raises(TableError):
        search.train_champion(tiny, "absent")
    with pytest.raises(TableError):
        prepare.select_features(tiny.select("id", F.col("score").alias("uuid")), "uuid")


@pytest.mark.parametrize("stratify", [None, "side"])
def test_split_is_exact_repeatable_and_complete(points, stratify):
    train, test = split.split(points, 0.2, 42, stratify, ["row_id"])
    ids = [r["row_id"] for r in test.collect()]
    assert len(ids) == 48 and len(set(ids)) == 48
    assert train.count() + len(ids) == 240
    assert ids and set(ids) == {r["row_id"] for r in split.split(points.repartition(5), 0.2, 42, stratify, ["row_id"])[1].collect()}
    if stratify:
        n = {r["side"]: r["count"] for r in points.groupBy("side").count().collect()}
        got = {r["side"]: r["count"] for r in test.groupBy("side").count().collect()}
        assert all(abs(got[s] - 0.2 * n[s]) < 1 for s in n)


@pytest.mark.parametrize("stratify", [None, "side"])
@pytest.mark.parametrize("key", [None, ["k"], ["side"]])
def test_split_is_exact_with_copies(spark, stratify, key):
    data = [(0, "a", None)] * 100 + [(i % 7, "ab"[i % 2], 1.5) for i in range(201)]
    df = spark.createDataFrame(data, "k int, side string, x double")
    marked = split.mark_test(df, 0.2, 42, stratify, key)
    assert sorted(map(str, (tuple(r)[:3] for r in marked.collect()))) == sorted(map(str, data))
    train, test = split.split(df, 0.2, 42, stratify, key)
    assert (train.count(), test.count()) == (301 - 61, 61)


def test_equal_rows_are_split_and_folded(spark):
    df = spark.createDataFrame([(1,)] * 250, "k int")
    train, test = split.split(df)
    assert (train.count(), test.count()) == (200, 50)
    sizes = [r["count"] for r in split.with_folds(df, 3).groupBy("fold").count().collect()]
    assert sorted(sizes) == [83, 83, 84]
    assert split.mark_test(df.limit(0)).count() == 0


def test_search_on_few_distinct_rows(spark):
    df = spark.createDataFrame([(float(i % 2), "yes" if i % 2 else "no") for i in range(400)], "size double, answer string")
    champion = search.train_champion(df, "answer", trees=2, rounds=2)
    assert (champion.training_rows, champion.testing_rows, champion.score) == (320, 80, 1.0)


def test_copies_stay_together(spark):
    df = spark.createDataFrame([(i % 10,) for i in range(300)], "k int")
    train, test = split.split(df, 0.2, 1, None, ["k"], group_key=True)
    assert not {r[0] for r in train.collect()} & {r[0] for r in test.collect()}


def test_unseen_category_encodes_as_zeros(spark, points):
    roles = prepare.feature_roles(points, ["kind"])
    fitted = prepare.fit_preparation(points, roles)
    out = fitted.transform(spark.createDataFrame([("zzz",), ("a",)], "kind string")).collect()
    assert out[0]["features"].toArray().sum() == 0 and out[1]["features"].toArray().tolist() == [1.0, 0.0, 0.0]


def test_regression_champion_scores_and_reloads(spark, points):
    best = search.train_champion(points, "y", features=["x", "kind", "day"], key=["row_id"], trees=5, rounds=5)
    assert best.problem == "regression" and best.algorithm == "linear_regression"
    assert (best.training_rows, best.testing_rows) == (192, 48)
    shares = {r["feature"]: r["importance"] for r in best.importances.collect()}
    assert sum(shares.values()) == pytest.approx(1.0) and {"x", "kind_a", "day_year"} <= set(shares)
    assert {r["metric"] for r in best.metrics.collect()} == {"mse", "rmse", "mae", "r2", "mape"}

    root = scratch_path(spark, "m")
    model_id = store.save_model(best, root, "points")
    model, roles, problem = store.load_model(spark, root, model_id)
    inputs = points.select("row_id", "kind")  # x and day are lacking
    scored = search.score(model, roles, inputs, problem)
    assert scored.count() == 240 and scored.where("prediction is null").count() == 0
    store.log_predictions(scored, root, model_id)
    shown = store.history(spark, root, model_id, 50).collect()
    assert len(shown) == 50 and set(shown[0]["input_payload"]) == {"row_id", "kind"}


@pytest.mark.parametrize("target", ["side", "kind"])
def test_classification_champion(points, target):
    features = [c for c in ("x", "kind", "y") if c != target]
    best = search.train_champion(
        points, target, features=features, key=["row_id"], trees=5, rounds=3, algorithms=["gradient_boosting", "random_forest"], cv=target == "side"
    )
    metrics = {r["metric"]: r["value"] for r in best.metrics.collect()}
    assert 0 <= metrics["roc_auc"] <= 1 and metrics["accuracy"] == pytest.approx(metrics["recall"])
    scored = search.score(best.model, best.roles, points, best.problem).collect()
    assert all(0 < r["confidence"] <= 1 for r in scored)
    assert {r["prediction"] for r in scored} <= {"hi", "lo", "a", "b", "c"}


def test_metrics_edges(spark):
    one = spark.createDataFrame([("a", "b")], "label string, prediction string")
    assert tuple(evaluate.classification_metrics(one).first()) == (0.0, 0.0, 0.0, 0.0)
    assert evaluate.confusion(one).count() == 4
    same = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    assert evaluate.regression_metrics(same).first()["r2"] == 1.0
    only = spark.createDataFrame([(True, 0.5)], "label boolean, score double")
    assert evaluate.roc_auc(only).first()[0] is None


def test_auc_by_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.random() < 0.4, rng.randrange(12) / 12) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = evaluate.roc_auc(spark.createDataFrame(rows, "label boolean, score double")).first()[0]
    assert got == pytest.approx(want)


def test_width_guard(points):
    with pytest.raises(TableError):
        prepare.width_guard(points, ["x"], ["kind"], max_unique=2)
    with pytest.raises(TableError):
        prepare.width_guard(points, ["x"], ["kind"], max_width=3)
    assert prepare.width_guard(points, ["x"], ["kind"]) == 4
