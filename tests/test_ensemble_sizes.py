"""The registered queries fit ensembles of the operator's default sizes."""

import inspect

import pytest
from compare import sf_dir

from tablelens.ml import search
from tablelens.queries import QUERIES


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["random_forest", "random_forest_classes", "gradient_boosting", "gradient_boosting_classes", "champion", "importances"])
def test_queries_use_the_defaults(spark, monkeypatch, name):
    signature, got = inspect.signature(search.candidate), {}

    def candidate(*args, **settings):
        bound = signature.bind(*args, **settings)
        bound.apply_defaults()
        got.update(bound.arguments)
        raise Seen

    monkeypatch.setattr(search, "candidate", candidate)
    with pytest.raises(Seen):
        QUERIES[f"ml_{name}"](spark, sf_dir("0.001"))
    assert (got["trees"], got["rounds"], got["depth"]) == (100, 100, 30)
