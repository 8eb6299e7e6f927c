"""Shapes of dates tell texts apart without parsing them; the answers are those of parsing every cell."""

import random

import pytest
from compare import plan
from pyspark.sql import functions as F

from tablelens.functions.dates import DATE_LAYOUTS, has_shape, parse_date, shape
from tablelens.operators import profile

KNOWN = [
    None, "", " ", "2020-02-29", "2021-02-29", "2020-2-9", "02020-02-09", "+12020-02-09", "-0044-03-15", "2020-02-09 ", "2020-02-09\n",
    "2020-02-09 10:11:12", "2020-02-09 25:11:12", "2020-02-09 10:11:12.1", "2020-02-09 10:11:12.123456", "2020-02-09 10:11:12.1234567",
    "2020-02-09T10:11:12", "2020-02-09t10:11:12", "2020-02-09T10:11:12.5", "2020-02-09T10:11:12Z", "2020-02-09T10:11:12z",
    "2020-02-09T10:11:12+05:30", "2020-02-09T10:11:12+0530", "2020/02/09", "2020/13/09", "02/09/2020", "2/9/2020", "13/09/2020",
    "02/09/02020", "1", "12", "999999", "20200209", "abc", "2020", "٢٠٢٠-٠٢-٠٩", "12-34", "9" * 80,
]


def texts(n=3000, seed=3):
    rng = random.Random(seed)
    whole = [k for k in KNOWN if k]
    for _ in range(n):
        t = list(rng.choice(whole))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice("0123456789-/:.TZ +")
        yield "".join(t)


def test_guarded_parsing_gives_the_same_answers(spark):
    df = spark.createDataFrame([(t,) for t in KNOWN + list(texts())], "t string")
    plain = F.coalesce(*[F.try_to_timestamp("t", F.lit(d)) for d in DATE_LAYOUTS if d != "MM/dd/yyyy"])
    # Of the layout with the month first, texts with one digit would be an error without a guard.
    american = F.when(F.col("t").rlike("^[0-9]{2}/[0-9]{2}/[+-]?[0-9]{4,19}$"), F.try_to_timestamp("t", F.lit("MM/dd/yyyy")))
    rows = df.select("t", parse_date(F.col("t")).alias("guarded"), F.coalesce(plain, american).alias("plain"), has_shape(F.col("t")).alias("shaped"))
    rows = rows.select("t", "shaped", F.unix_micros("guarded").alias("guarded"), F.unix_micros("plain").alias("plain")).collect()
    assert [(r.t, r.guarded) for r in rows] == [(r.t, r.plain) for r in rows]
    assert all(r.shaped for r in rows if r.plain is not None)
    assert sum(r.plain is not None for r in rows) > 200


@pytest.mark.parametrize("layout", ["d MMM yyyy", "yyyy-DDD", "EEE dd", "[yyyy]"])
def test_layouts_of_unknown_shape_are_parsed(spark, layout):
    assert shape(layout) is None
    df = spark.createDataFrame([("7 Mar 2021",), ("x",)], "t string")
    got = [r[0] is not None for r in df.select(parse_date(F.col("t"), ("d MMM yyyy",))).collect()]
    assert got == [True, False]


def test_columns_are_dates_if_all_values_parse(spark):
    rows = [("2020-01-01", "2020-01-01", "2020-99-01", None, "x"), ("2020/01/02", "y", "2020-01-01", None, "2020-01-01"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    assert profile.date_columns(df) == ["a"]
    assert profile.date_columns(df, ["b", "a"]) == ["a"]
    assert profile.date_columns(df.where("false")) == []


def test_free_text_is_not_parsed(spark):
    df = spark.createDataFrame([("some words",)], "t string")
    assert "gettimestamp" not in plan(df.agg(F.count_if(has_shape(F.col("t"))))).lower()
