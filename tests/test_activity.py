import datetime
import random

import pytest
from compare import sf_dir
from pyspark.sql import functions as F

from tablelens.operators import catalogue
from tablelens.queries import QUERIES
from tablelens.queries.catalogue import mine

DAY = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("owns", [range(0, 40, 2), [37], [], [3, 3, 5]])
def test_newest_by_brute_force(spark, monkeypatch, owns):
    monkeypatch.setattr(catalogue, "LOOK", 3)
    rng = random.Random(1)
    facts = [(str(rng.randrange(40)) if i % 7 else None, i, i * 10, DAY + datetime.timedelta(days=i * 7 % 120)) for i in range(120)]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    datasets = table([(str(i), f"set {i}") for i in owns], "dataset_id string, dataset_name string")
    versions = table(facts, "dataset_id string, version_number int, file_size bigint, created_at timestamp")
    jobs = table(facts[:50], "dataset_id string, rows_removed bigint, missing_handled bigint, created_at timestamp")
    eda = table([(f[0], f[3]) for f in facts], "dataset_id string, created_at timestamp")
    insights = eda.limit(0).withColumn("insights", F.array(F.lit(1)))
    got = catalogue.recent_activity(datasets, versions, jobs, eda, insights, 4).collect()
    every = [("UPLOAD", f) for f in facts] + [("CLEAN", f) for f in facts[:50]] + [("EDA", f) for f in facts]
    want = sorted((-f[3].timestamp(), kind, f[0]) for kind, f in every for i in owns if f[0] == str(i))[:4]
    assert sorted((-r["timestamp"].timestamp(), r["type"], r["dataset_id"]) for r in got) == want
    assert all(r["dataset_name"] == f"set {r['dataset_id']}" for r in got)


def test_only_the_newest_meet_the_datasets(spark):
    """The list is made from stored rows; nothing of the tables is joined for it."""
    out = QUERIES["dash_activity"](spark, sf_dir("0.01"))
    assert not [f for f in out.inputFiles() if "sf0.01" in f]
    datasets, t = mine(spark, sf_dir("0.01"))
    by_versions = catalogue.recent_activity(datasets, t["versions"], t["jobs"], t["eda"], t["insights"])
    assert by_versions.drop("timestamp").collect() == out.drop("timestamp").collect()
