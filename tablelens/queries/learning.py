"""Model search queries.

Fitted ensembles have no counterpart in SQL in general, but on data that decide
the outcome they have: a boosted tree over one binary feature predicts the
means of its two groups, a forest a target that is constant in each group, any
classifier classes that its features tell apart, and what does not vary has no
importance.  Queries on such tables are checked; those named ``..._parts`` or
``..._labels`` fit the same models to all features, and are checked by row
count here and by properties in the tests.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..ml import evaluate, prepare, search, split, store
from ..operators import profile
from ..operators.frequency import literal_rows
from ..session import materialize, scratch_path
from .catalogue import CATALOGUE, OWNER, tables
from .registry import query
from .tables import GAP_LINES, GAP_ORDERS, gap_lines, gap_orders, read, rounded


@query(
    "ml_problem_type",
    f"""WITH {GAP_LINES}
SELECT 'price' AS target, CASE WHEN count(DISTINCT price) > 10 THEN 'regression' ELSE 'classification' END AS problem FROM gap_lines
UNION ALL SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) > 10 THEN 'regression' ELSE 'classification' END FROM gap_lines
UNION ALL SELECT 'quantity', CASE WHEN count(DISTINCT quantity) > 10 THEN 'regression' ELSE 'classification' END FROM gap_lines
UNION ALL SELECT 'flag', 'classification'""",
)
def ml_problem_type(spark, sf_dir):
    df = gap_lines(spark, sf_dir)
    rows = [{"target": t, "problem": prepare.detect_problem_type(df, t)} for t in ("price", "l_linenumber", "quantity", "flag")]
    return literal_rows(spark, rows, "target string, problem string")


@query(
    "ml_validate",
    f"""WITH {GAP_LINES}
SELECT 'quantity' AS target, count(quantity)::BIGINT AS usable_rows, NULL::VARCHAR AS problem FROM gap_lines
UNION ALL SELECT 'status', count(status), NULL FROM gap_lines
UNION ALL SELECT 'constant', NULL, 'the target needs at least 2 classes'
UNION ALL SELECT 'nothing', NULL, 'fewer than 10 rows have a target'
UNION ALL SELECT 'absent', NULL, 'target column ''absent'' is missing'""",
)
def ml_validate(spark, sf_dir):
    df = gap_lines(spark, sf_dir).withColumn("constant", F.lit("x")).withColumn("nothing", F.lit(None).cast("int"))
    rows = []
    for target in ("quantity", "status", "constant", "nothing", "absent"):
        try:
            n, problem = prepare.validate_training(df, target, "classification"), None
        except ValueError as e:
            n, problem = None, str(e)
        rows.append({"target": target, "usable_rows": n, "problem": problem})
    return literal_rows(spark, rows, "target string, usable_rows bigint, problem string")


@query(
    "ml_select_features",
    """SELECT 'ts' AS "column", 0::BIGINT AS missing_count FROM events LIMIT 1""".replace(" FROM events LIMIT 1", "")
    + """ UNION ALL SELECT 'event_type', (SELECT count(*) - count(event_type) FROM events)
UNION ALL SELECT 'props', (SELECT count(*) - count(props) FROM events)""",
)
def ml_select_features(spark, sf_dir):
    """Features chosen for a target, with their missing cells."""
    df = read(spark, sf_dir, "events")
    chosen = prepare.select_features(df, "value")
    return profile.missing_by_column(df, chosen).select("column", "missing_count")


@query(
    "ml_feature_suitability",
    f"""WITH {GAP_ORDERS}, u AS (
  SELECT 'customer_id' AS "column", 'numeric' AS dtype, count(DISTINCT o_custkey)::BIGINT AS unique_count FROM gap_orders
  UNION ALL SELECT 'priority', 'categorical', count(DISTINCT priority) FROM gap_orders
  UNION ALL SELECT 'label', 'text', count(DISTINCT 'order ' || o_orderkey) FROM gap_orders
  UNION ALL SELECT 'total', 'numeric', count(DISTINCT total) FROM gap_orders
  UNION ALL SELECT 'status', 'categorical', count(DISTINCT status) FROM gap_orders)
SELECT *, "column" NOT IN ('status', 'customer_id') AND NOT (dtype <> 'numeric' AND unique_count > 50) AS suitable FROM u""",
)
def ml_feature_suitability(spark, sf_dir):
    df = gap_orders(spark, sf_dir).select(
        F.col("o_custkey").alias("customer_id"), "priority",
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("label"), "total", "status",
    )
    return prepare.suitable_features(
        profile.semantic_types(df).join(profile.unique_by_column(df).drop("column"), "position"), "status"
    )


@query(
    "ml_datetime_features",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS d FROM orders),
m AS (SELECT d AS modal FROM o WHERE d IS NOT NULL GROUP BY d ORDER BY count(*) DESC, d LIMIT 1),
f AS (SELECT o_orderkey, coalesce(d, (SELECT modal FROM m)) AS d FROM o)
SELECT o_orderkey, year(d)::INTEGER AS ordered_year, month(d)::INTEGER AS ordered_month, (isodow(d) - 1)::INTEGER AS ordered_day_of_week,
  (isodow(d) >= 6)::INTEGER AS ordered_is_weekend FROM f""",
)
def ml_datetime_features(spark, sf_dir):
    df = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS ordered"
    )
    return prepare.datetime_features(df, ["ordered"])


@query(
    "ml_width_guard",
    """SELECT 'brand and type' AS features, (1 + count(DISTINCT p_brand) + count(DISTINCT p_type))::BIGINT AS width, NULL::VARCHAR AS problem FROM part
UNION ALL SELECT 'size as text', NULL, 'columns with more than 40 distinct values cannot be encoded: p_size (' || count(DISTINCT p_size) || ')' FROM part
UNION ALL SELECT 'too wide', NULL, (1 + count(DISTINCT p_brand) + count(DISTINCT p_type)) || ' encoded columns exceed the limit of 20' FROM part""",
)
def ml_width_guard(spark, sf_dir):
    df = read(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("string"))
    rows = []
    for name, columns, limits in (
        ("brand and type", ["p_brand", "p_type"], (50, 500)),
        ("size as text", ["p_size"], (40, 500)),
        ("too wide", ["p_brand", "p_type"], (50, 20)),
    ):
        try:
            width, problem = prepare.width_guard(df, ["p_retailprice"], columns, *limits), None
        except ValueError as e:
            width, problem = None, str(e)
        rows.append({"features": name, "width": width, "problem": problem})
    return literal_rows(spark, rows, "features string, width bigint, problem string")


@query(
    "ml_split",
    """WITH c AS (SELECT o_orderpriority AS priority, count(*) AS n, sum(count(*)) OVER () AS total FROM orders GROUP BY 1),
s AS (SELECT *, n * ceil(total * 0.2) / total AS share, floor(n * ceil(total * 0.2) / total) AS base, ceil(total * 0.2) AS wanted FROM c),
q AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY share - base DESC, priority) <= wanted - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM s)
SELECT priority, (n - quota)::BIGINT AS training_rows, quota::BIGINT AS testing_rows FROM q""",
)
def ml_split(spark, sf_dir):
    """Sizes of a stratified split per class."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    marked = split.mark_test(df, 0.2, 42, "priority", ["o_orderkey"])
    return marked.groupBy("priority").agg(
        F.count_if(~F.col("is_test")).alias("training_rows"), F.count_if("is_test").alias("testing_rows")
    )


def _parts(spark, sf_dir):
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE WHEN p_size < 5 THEN NULL ELSE p_size END AS size", "p_retailprice AS price",
        "CASE WHEN p_type = 'SMALL' THEN NULL ELSE p_type END AS kind", "p_brand AS brand",
    )


_PARTS = """parts AS (SELECT p_partkey, CASE WHEN p_size < 5 THEN NULL ELSE p_size END AS size, p_retailprice AS price,
  CASE WHEN p_type = 'SMALL' THEN NULL ELSE p_type END AS kind, p_brand AS brand FROM part)"""


@query(
    "ml_prep_numeric",
    f"""WITH {_PARTS}, f AS (SELECT p_partkey, coalesce(size, (SELECT median(size) FROM parts))::DOUBLE AS size, price FROM parts),
m AS (SELECT avg(size) AS a, stddev_samp(size) AS s, avg(price) AS b, stddev_samp(price) AS t FROM f)
SELECT p_partkey, round((size - a) / s, 4) AS size, round((price - b) / t, 4) AS price FROM f, m""",
)
def ml_prep_numeric(spark, sf_dir):
    df = _parts(spark, sf_dir)
    roles = prepare.feature_roles(df, ["size", "price"])
    out = prepare.fit_preparation(df, roles).transform(df).withColumn("x", vector_to_array("features"))
    return rounded(out.select("p_partkey", F.col("x")[0].alias("size"), F.col("x")[1].alias("price")))


@query(
    "ml_prep_categorical",
    f"""WITH {_PARTS}, m AS (SELECT kind AS modal FROM parts WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
f AS (SELECT p_partkey, coalesce(kind, (SELECT modal FROM m)) AS kind FROM parts), k AS (SELECT list(DISTINCT kind ORDER BY kind) AS kinds FROM f)
SELECT p_partkey, array_to_string(list_transform(kinds, lambda x: CASE WHEN x = kind THEN '1' ELSE '0' END), ',') AS encoded FROM f, k""",
)
def ml_prep_categorical(spark, sf_dir):
    df = _parts(spark, sf_dir)
    out = prepare.fit_preparation(df, prepare.feature_roles(df, ["kind"])).transform(df)
    bits = F.transform(vector_to_array("features"), lambda x: x.cast("int").cast("string"))
    return out.select("p_partkey", F.array_join(bits, ",").alias("encoded"))


def _prices(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") + 900 * F.col("l_quantity")).alias("price"),
    )


_PRICES = """prices AS (SELECT l_orderkey || '/' || l_partkey || '/' || l_suppkey || '/' || l_linenumber AS line, l_quantity AS quantity,
  l_extendedprice + 900 * l_quantity AS price FROM lineitem)"""
_FITTED = f"""WITH {_PRICES}, m AS (SELECT regr_slope(price, quantity) AS a, regr_intercept(price, quantity) AS b FROM prices)
SELECT line, quantity, round(b + a * quantity, 2) AS prediction FROM prices, m"""


@query("ml_linear_regression", _FITTED)
def ml_linear_regression(spark, sf_dir):
    df = _prices(spark, sf_dir).withColumn("label", F.col("price"))
    data = prepare.fit_preparation(df, prepare.feature_roles(df, ["quantity"])).transform(df)
    fitted = search.candidate("linear_regression", "regression").fit(data)
    return fitted.transform(data).select("line", "quantity", F.round("prediction", 2).alias("prediction"))


def _fit_parts(spark, sf_dir, name, problem, target, features, **settings):
    df = _parts(spark, sf_dir)
    rows, labels = search.labelled(df, target, problem)
    rows = materialize(search.spread(rows), "labelled-rows")
    data = prepare.fit_preparation(rows, prepare.feature_roles(rows, features)).transform(rows)
    model = search.fit(search.candidate(name, problem, classes=max(2, len(labels)), **settings), data)
    return model.transform(data).select("p_partkey", "label", "prediction")


def _halves(spark, sf_dir):
    """Parts with a binary feature, one that does not vary, the mean price of the half, and the kind as code and number."""
    parts = read(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CAST(p_size >= 25 AS INT) AS large", "1 AS same", "p_retailprice AS price", "p_type AS kind", "'is ' || p_type AS code",
    )
    means = parts.groupBy("large").agg(F.round(F.avg("price"), 2).alias("mean_price"))
    # One row per kind: the window sees the kinds only, and no task all parts.
    kinds = parts.select(F.col("kind").alias("ranked")).distinct().selectExpr("ranked", "dense_rank() OVER (ORDER BY ranked) AS number")
    parts = parts.join(kinds, F.col("kind").eqNullSafe(F.col("ranked"))).drop("ranked")
    return parts.join(means, "large")


_HALVES = """halves AS (SELECT p_partkey, (p_size >= 25)::INT AS large, p_retailprice AS price, p_type AS kind,
  (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS label, round(avg(p_retailprice) OVER (PARTITION BY p_size >= 25), 2) AS mean_price FROM part)"""


def _fit_halves(spark, sf_dir, name, problem, target, features, **settings):
    df = _halves(spark, sf_dir)
    rows, labels = search.labelled(df, target, problem)
    rows = materialize(search.spread(rows), "labelled-rows")
    data = prepare.fit_preparation(rows, prepare.feature_roles(rows, features)).transform(rows)
    model = search.fit(search.candidate(name, problem, classes=max(2, len(labels)), rows=rows.count(), **settings), data)
    return model.transform(data).select("p_partkey", "label", F.round("prediction", 4).alias("prediction"))


@query("ml_random_forest", f"WITH {_HALVES} SELECT p_partkey, mean_price AS label, mean_price AS prediction FROM halves")
def ml_random_forest(spark, sf_dir):
    """A target that is constant in each half: so is every tree's leaf, whatever rows it drew."""
    return _fit_halves(spark, sf_dir, "random_forest", "regression", "mean_price", ["large"])


@query("ml_random_forest_classes", f"WITH {_HALVES} SELECT p_partkey, large::DOUBLE AS label, large::DOUBLE AS prediction FROM halves")
def ml_random_forest_classes(spark, sf_dir):
    df = _halves(spark, sf_dir).withColumn("half", F.when(F.col("large") == 1, "large").otherwise("a small one"))
    rows, _ = search.labelled(df, "half", "classification")
    rows = materialize(search.spread(rows), "labelled-rows")
    data = prepare.fit_preparation(rows, prepare.feature_roles(rows, ["large", "same"])).transform(rows)
    model = search.fit(search.candidate("random_forest", "classification"), data)
    return model.transform(data).select("p_partkey", "label", "prediction")


@query(
    "ml_gradient_boosting",
    f"WITH {_HALVES} SELECT p_partkey, price AS label, round(avg(price) OVER (PARTITION BY large), 4) AS prediction FROM halves",
)
def ml_gradient_boosting(spark, sf_dir):
    """Boosting over one binary feature ends at the mean of each half."""
    return _fit_halves(spark, sf_dir, "gradient_boosting", "regression", "price", ["large"])


@query("ml_gradient_boosting_classes", f"WITH {_HALVES} SELECT p_partkey, label, label AS prediction FROM halves")
def ml_gradient_boosting_classes(spark, sf_dir):
    """More than two classes that a number tells apart: one boosted model per class."""
    return _fit_halves(spark, sf_dir, "gradient_boosting", "classification", "kind", ["number"])


@query("ml_logistic_regression", f"WITH {_HALVES} SELECT p_partkey, label, label AS prediction FROM halves")
def ml_logistic_regression(spark, sf_dir):
    """Classes that a categorical feature tells apart."""
    return _fit_halves(spark, sf_dir, "logistic_regression", "classification", "kind", ["code"])


@query(
    "ml_cross_validate",
    """WITH p AS (SELECT (p_partkey % 3)::INTEGER AS fold, p_size::DOUBLE AS x, p_retailprice AS y FROM part),
f AS (SELECT DISTINCT fold FROM p),
m AS (SELECT f.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM f JOIN p ON p.fold <> f.fold GROUP BY 1)
SELECT p.fold, round(1 - avg((y - a * x - b) * (y - a * x - b)) / var_pop(y), 4) AS r2 FROM p JOIN m USING (fold) GROUP BY 1""",
)
def ml_cross_validate(spark, sf_dir):
    """Folds given by a column: a line fitted to the other folds, judged on each."""
    df = read(spark, sf_dir, "part").selectExpr("p_size AS size", "p_retailprice AS price", "CAST(p_partkey % 3 AS INT) AS third")
    rows, _ = search.labelled(df, "price", "regression")
    scores = search.cross_validate(rows, prepare.feature_roles(rows, ["size"]), "linear_regression", "regression", 3, fold_col="third")
    return literal_rows(spark, [{"fold": i, "r2": round(s, 4)} for i, s in enumerate(scores)], "fold int, r2 double")


_HELD = "(SELECT (count(*) - ceil(count(*) * 0.2))::BIGINT FROM part) AS training_rows, (SELECT ceil(count(*) * 0.2)::BIGINT FROM part) AS testing_rows"


@query(
    "ml_champion",
    f"""SELECT 'random_forest' AS algorithm, 1.0::DOUBLE AS score, true AS champion, {_HELD}
UNION ALL SELECT 'logistic_regression', 1.0, false, {_HELD} UNION ALL SELECT 'gradient_boosting', 1.0, false, {_HELD}""",
)
def ml_champion(spark, sf_dir):
    """All candidates tell the halves apart, and the first of them wins."""
    df = _halves(spark, sf_dir).withColumn("half", F.when(F.col("large") == 1, "large").otherwise("a small one"))
    best = search.train_champion(df, "half", key=["p_partkey"], features=["large"])
    return best.leaderboard.select(
        "algorithm", "score", (F.col("algorithm") == best.algorithm).alias("champion"),
        F.lit(best.training_rows).cast("bigint").alias("training_rows"), F.lit(best.testing_rows).cast("bigint").alias("testing_rows"),
    )


@query(
    "ml_champion_tables",
    """WITH c AS (SELECT p_size >= 25 AS large, count(*) AS n, sum(count(*)) OVER () AS total FROM part GROUP BY 1),
s AS (SELECT *, n * ceil(total * 0.2) / total AS share, floor(n * ceil(total * 0.2) / total) AS base, ceil(total * 0.2) AS wanted FROM c),
q AS (SELECT CASE WHEN large THEN 'large' ELSE 'a small one' END AS half,
  (base + CASE WHEN row_number() OVER (ORDER BY share - base DESC, large) <= wanted - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS n FROM s)
SELECT a.half AS label, b.half AS prediction, CASE WHEN a.half = b.half THEN a.n ELSE 0 END AS "count", a.n AS support, b.n AS predicted,
  1.0::DOUBLE AS f1 FROM q a, q b""",
)
def ml_champion_tables(spark, sf_dir):
    """Confusion matrix, class report and distribution of the champion's predictions for the test rows."""
    df = _halves(spark, sf_dir).withColumn("half", F.when(F.col("large") == 1, "large").otherwise("a small one"))
    best = search.train_champion(df, "half", key=["p_partkey"], features=["large"], algorithms=["logistic_regression"])
    report = best.report.select(F.col("class").alias("label"), "support", "f1")
    told = best.distribution.select("prediction", F.col("count").alias("predicted"))
    return best.confusion.join(report, "label").join(told, "prediction").select("label", "prediction", "count", "support", "predicted", "f1")


@query("ml_importances", "SELECT 'large' AS feature, 1.0::DOUBLE AS importance FROM part HAVING count(*) > 0 UNION ALL SELECT 'same', 0.0")
def ml_importances(spark, sf_dir):
    """What does not vary has no part in a forest; the shares sum to one."""
    df = _halves(spark, sf_dir)
    return search.train_champion(df, "mean_price", features=["large", "same"], algorithms=["random_forest"], problem="regression").importances


@query("ml_random_forest_parts")
def ml_random_forest_parts(spark, sf_dir):
    return _fit_parts(spark, sf_dir, "random_forest", "regression", "price", ["size", "kind", "brand"])


@query("ml_random_forest_kinds_parts")
def ml_random_forest_kinds_parts(spark, sf_dir):
    return _fit_parts(spark, sf_dir, "random_forest", "classification", "kind", ["size", "price", "brand"])


@query("ml_gradient_boosting_parts")
def ml_gradient_boosting_parts(spark, sf_dir):
    return _fit_parts(spark, sf_dir, "gradient_boosting", "regression", "price", ["size", "kind", "brand"])


@query("ml_gradient_boosting_kinds_parts")
def ml_gradient_boosting_kinds_parts(spark, sf_dir):
    """More than two classes: one boosted model per class."""
    return _fit_parts(spark, sf_dir, "gradient_boosting", "classification", "kind", ["size", "price"])


@query("ml_logistic_regression_parts")
def ml_logistic_regression_parts(spark, sf_dir):
    return _fit_parts(spark, sf_dir, "logistic_regression", "classification", "kind", ["size", "price", "brand"])


@query("ml_cross_validate_parts")
def ml_cross_validate_parts(spark, sf_dir):
    rows, _ = search.labelled(_parts(spark, sf_dir), "price", "regression")
    roles = prepare.feature_roles(rows, ["size", "kind"])
    scores = search.cross_validate(rows, roles, "linear_regression", "regression", 3, key=["p_partkey"])
    return literal_rows(spark, [{"fold": i, "r2": s} for i, s in enumerate(scores)], "fold int, r2 double")


def _quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id")


@query("ml_champion_labels")
def ml_champion_labels(spark, sf_dir):
    """Scores of the candidates for the quality label, the champion marked."""
    best = search.train_champion(_quality(spark, sf_dir), "quality", key=["doc_id"], features=["n_chars", "lang", "source"])
    return best.leaderboard.withColumn("champion", F.col("algorithm") == best.algorithm)


@query("ml_importances_parts")
def ml_importances_parts(spark, sf_dir):
    df = _parts(spark, sf_dir).drop("p_partkey")
    return search.train_champion(df, "price", algorithms=["random_forest"]).importances


@query("ml_score", _FITTED)
def ml_score(spark, sf_dir):
    """Scores of all rows by the stored and reloaded champion."""
    df = _prices(spark, sf_dir)
    best = search.train_champion(df, "price", features=["quantity"], algorithms=["linear_regression"], key=["line"])
    root = scratch_path(spark, "models")
    model, roles, problem = store.load_model(spark, root, store.save_model(best, root, "prices"))
    scored = search.score(model, roles, df.select("line", "quantity"), problem)
    return scored.select("line", "quantity", F.round(F.col("prediction").cast("double"), 2).alias("prediction"))


@query(
    "ml_persist",
    """SELECT 'parts' AS dataset_id, unnest([1, 2])::INTEGER AS model_version, 'price' AS target_column, 'regression' AS problem_type,
  'linear_regression' AS model_type, 'COMPLETED' AS status, (count(*) - ceil(count(*) * 0.2))::BIGINT AS training_rows,
  ceil(count(*) * 0.2)::BIGINT AS testing_rows, 'size,kind' AS features FROM part""",
)
def ml_persist(spark, sf_dir):
    """Records of a model stored twice."""
    root = scratch_path(spark, "models")
    best = search.train_champion(
        _parts(spark, sf_dir), "price", features=["size", "kind"], algorithms=["linear_regression"], key=["p_partkey"]
    )
    for _ in range(2):
        store.save_model(best, root, "parts")
    return store.models(spark, root).select(
        "dataset_id", "model_version", "target_column", "problem_type", "model_type", "status", "training_rows",
        "testing_rows", F.array_join("features", ",").alias("features"),
    )


_GUESS = "CASE WHEN l_quantity < 10 THEN 'A' WHEN l_quantity < 25 THEN l_returnflag WHEN l_quantity < 40 THEN 'N' ELSE 'R' END"


def _guesses(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS label", f"{_GUESS} AS prediction")


_GUESSES = f"guesses AS (SELECT l_returnflag AS label, {_GUESS} AS prediction FROM lineitem)"
_REPORT = f"""{_GUESSES}, r AS (
  SELECT c.class, count(*) FILTER (label = class AND prediction = class)::DOUBLE AS hits, count(*) FILTER (label = class) AS support,
    count(*) FILTER (prediction = class) AS predicted FROM guesses, (SELECT DISTINCT label AS class FROM guesses) c GROUP BY 1),
report AS (SELECT class, hits / predicted AS "precision", hits / support AS recall, 2 * hits / (predicted + support) AS f1, support::BIGINT AS support FROM r)"""


@query(
    "ml_class_report",
    f"""WITH {_REPORT} SELECT class, round("precision", 4) AS "precision", round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM report""",
)
def ml_class_report(spark, sf_dir):
    return rounded(evaluate.class_report(_guesses(spark, sf_dir)))


@query(
    "ml_classification_metrics",
    f"""WITH {_REPORT} SELECT (SELECT round(avg((label = prediction)::INT), 4) FROM guesses) AS accuracy,
  round(sum("precision" * support) / sum(support), 4) AS "precision", round(sum(recall * support) / sum(support), 4) AS recall,
  round(sum(f1 * support) / sum(support), 4) AS f1 FROM report""",
)
def ml_classification_metrics(spark, sf_dir):
    return rounded(evaluate.classification_metrics(_guesses(spark, sf_dir)))


@query(
    "ml_confusion",
    """WITH guesses AS (SELECT l_returnflag AS label, CASE WHEN l_returnflag = 'A' THEN 'N' ELSE l_returnflag END AS prediction FROM lineitem),
k AS (SELECT DISTINCT label AS k FROM guesses)
SELECT a.k AS label, b.k AS prediction, (SELECT count(*) FROM guesses WHERE label = a.k AND prediction = b.k)::BIGINT AS "count" FROM k a, k b""",
)
def ml_confusion(spark, sf_dir):
    """A matrix with empty cells."""
    df = read(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS label", "CASE WHEN l_returnflag = 'A' THEN 'N' ELSE l_returnflag END AS prediction"
    )
    return evaluate.confusion(df)


@query("ml_class_distribution", f'WITH {_GUESSES} SELECT prediction, count(*)::BIGINT AS "count" FROM guesses GROUP BY 1')
def ml_class_distribution(spark, sf_dir):
    return evaluate.class_distribution(_guesses(spark, sf_dir))


_SCORE = "l_quantity / 50 + CASE WHEN l_returnflag = 'R' THEN 0.1 ELSE 0.0 END"
_SCORE_SPARK = _SCORE.replace("0.1", "0.1D").replace("0.0", "0.0D")


@query(
    "ml_roc_auc",
    f"""WITH s AS (SELECT l_returnflag = 'R' AS y, {_SCORE}::DOUBLE AS s FROM lineitem),
g AS (SELECT s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM s GROUP BY s),
c AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS before FROM g)
SELECT round((sum(p * (before + n / 2.0)) / (sum(p)::DOUBLE * sum(n)))::DOUBLE, 6) AS roc_auc FROM c""",
)
def ml_roc_auc(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").selectExpr("l_returnflag = 'R' AS label", f"{_SCORE_SPARK} AS score")
    return rounded(evaluate.roc_auc(df), 6)


@query(
    "ml_roc_auc_classes",
    """WITH s AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, l_discount AS s0, l_tax + (l_returnflag = 'N')::INT * 0.02::DOUBLE AS s1, l_quantity / 50 AS s2 FROM lineitem),
l AS (SELECT 0 AS class, y = 0 AS p, s0 AS s FROM s UNION ALL SELECT 1, y = 1, s1 FROM s UNION ALL SELECT 2, y = 2, s2 FROM s),
g AS (SELECT class, s, count(*) FILTER (p) AS p, count(*) FILTER (NOT p) AS n FROM l GROUP BY class, s),
c AS (SELECT *, sum(n) OVER (PARTITION BY class ORDER BY s) - n AS before FROM g),
a AS (SELECT class, sum(p) AS w, (sum(p * (before + n / 2.0)) / (sum(p)::DOUBLE * sum(n)))::DOUBLE AS auc FROM c GROUP BY class)
SELECT round(sum(auc * w) / sum(w), 6) AS roc_auc FROM a""",
)
def ml_roc_auc_classes(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").selectExpr(
        "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label",
        "array(l_discount, l_tax + int(l_returnflag = 'N') * 0.02D, l_quantity / 50) AS scores",
    )
    return rounded(evaluate.roc_auc_weighted(df), 6)


@query(
    "ml_regression_metrics",
    """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
SELECT round(avg((y - p) * (y - p)), 1) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
  round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS r2, round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 4) AS mape FROM p""",
)
def ml_regression_metrics(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").selectExpr("l_extendedprice AS label", "l_quantity * 1500 AS prediction")
    out = evaluate.regression_metrics(df)
    return rounded(out.withColumn("mse", F.round("mse", 1)))


@query(
    "ml_prediction_log",
    """SELECT event_id::VARCHAR AS prediction_id, props AS prediction, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at
FROM events WHERE event_type = 'click' ORDER BY ts DESC LIMIT 50""",
)
def ml_prediction_log(spark, sf_dir):
    """The newest predictions of one model (events play the log)."""
    logs = read(spark, sf_dir, "events").selectExpr(
        "cast(event_id AS string) AS prediction_id", "event_type AS model_id", "props AS prediction", "ts AS created_at"
    )
    out = store.newest_predictions(logs, "click")
    return out.select("prediction_id", "prediction", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("ml_predictions_logged", "SELECT 'parts' AS model_id, count(*)::BIGINT AS predictions, 50::BIGINT AS shown FROM part")
def ml_predictions_logged(spark, sf_dir):
    """Predictions of a whole table appended to the log and counted."""
    root = scratch_path(spark, "models")
    df = _parts(spark, sf_dir)
    best = search.train_champion(df, "price", features=["size"], algorithms=["linear_regression"], key=["p_partkey"])
    store.log_predictions(search.score(best.model, best.roles, df.select("p_partkey", "size"), best.problem), root, "parts")
    shown = store.history(spark, root, "parts").agg(F.count(F.lit(1))).scalar()
    logged = spark.read.parquet(f"{root}/prediction_logs").groupBy("model_id").agg(F.count(F.lit(1)).alias("predictions"))
    return logged.select("model_id", "predictions", shown.alias("shown"))


@query(
    "ml_list_models",
    f"""WITH {CATALOGUE}, models AS (SELECT p_partkey AS model_id, p_partkey::VARCHAR AS dataset_id, p_brand AS target_column, p_size AS model_version FROM part)
SELECT model_id, dataset_id, target_column, model_version, dataset_name FROM models JOIN owned USING (dataset_id)""",
)
def ml_list_models(spark, sf_dir):
    models = read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS model_id", "cast(p_partkey AS string) AS dataset_id", "p_brand AS target_column",
        "p_size AS model_version", "timestampadd(DAY, p_size, timestamp '2024-01-01') AS created_at",
    )
    out = store.list_models(models, tables(spark, sf_dir)["datasets"], OWNER)
    return out.select("model_id", "dataset_id", "target_column", "model_version", "dataset_name")
