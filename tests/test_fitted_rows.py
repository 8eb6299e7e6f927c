"""Models are fitted to rows that lie in many tasks, however few files a table has."""

import pytest
from compare import sf_dir

from tablelens.ml import search
from tablelens.queries import QUERIES


class Seen(Exception):
    pass


class Estimator:
    def fit(self, data):
        raise Seen(data.rdd.getNumPartitions(), max(data.rdd.glom().map(len).collect()), data.count())


@pytest.mark.parametrize(
    "name",
    [
        "random_forest", "random_forest_parts", "random_forest_kinds_parts", "gradient_boosting_parts", "gradient_boosting_kinds_parts",
        "gradient_boosting_classes", "champion", "importances", "importances_parts",
    ],
)
def test_training_rows_are_spread(spark, monkeypatch, name):
    monkeypatch.setattr(search, "candidate", lambda *args, **settings: Estimator())
    monkeypatch.setattr(search, "FEW_ROWS", 10)
    with pytest.raises(Seen) as seen:
        QUERIES[f"ml_{name}"](spark, sf_dir("0.001"))
    tasks, most, n = seen.value.args
    assert tasks == 8 and most <= n / 4


def test_tasks_are_bounded_and_few_rows_stay(spark, monkeypatch):
    df = spark.range(0, 12_000, 1, 1)
    assert search.spread(df).rdd.getNumPartitions() == 2
    monkeypatch.setattr(search, "TASK_ROWS", 1_000)
    assert search.spread(df).rdd.getNumPartitions() == 12
    monkeypatch.undo()
    assert search.spread(df.limit(4_000)).rdd.getNumPartitions() == 1
    assert sorted(r[0] for r in search.spread(df).collect()) == list(range(12_000))
