"""The rows that one task holds during a fit have a bound that does not grow with the table."""

from pyspark.sql import functions as F

from tablelens.ml import search


def test_a_task_of_a_fit_is_bounded(spark):
    parts = search.spread(spark.range(0, 1_200_000, 1, 2)).groupBy(F.spark_partition_id()).count()
    assert parts.agg(F.max("count")).first()[0] <= 51_000
    assert parts.agg(F.sum("count")).first()[0] == 1_200_000
