"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as op
from ..plans import cleaning_run as run
from ..operators.frequency import literal_rows
from .registry import query
from .tables import (
    GAP_EVENTS,
    GAP_LINES,
    GAP_ORDERS,
    NARROW_LINES,
    gap_events,
    gap_lines,
    gap_orders,
    narrow_lines,
    read,
    rounded,
)


@query("clean_drop_duplicates", f"WITH {NARROW_LINES} SELECT DISTINCT * FROM narrow_lines")
def clean_drop_duplicates(spark, sf_dir):
    return op.drop_duplicates(narrow_lines(spark, sf_dir))


@query("clean_drop_missing", f"WITH {GAP_ORDERS} SELECT * FROM gap_orders WHERE priority IS NOT NULL")
def clean_drop_missing(spark, sf_dir):
    return op.drop_missing(gap_orders(spark, sf_dir), "priority")


def _filled_lines(value: str) -> str:
    return f"""WITH {GAP_LINES}, v AS ({value})
SELECT l_orderkey, l_linenumber, price, round(coalesce(quantity, (SELECT v FROM v)), 4) AS quantity FROM gap_lines"""


@query("clean_fill_mean", _filled_lines("SELECT avg(quantity) AS v FROM gap_lines"))
def clean_fill_mean(spark, sf_dir):
    df = gap_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "price", "quantity")
    return rounded(op.fill_missing(df, "quantity", "mean"))


@query("clean_fill_median", _filled_lines("SELECT median(quantity) AS v FROM gap_lines"))
def clean_fill_median(spark, sf_dir):
    df = gap_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "price", "quantity")
    return rounded(op.fill_missing(df, "quantity", "median"))


@query(
    "clean_fill_mode",
    f"""WITH {GAP_ORDERS}, v AS (
  SELECT priority AS v FROM gap_orders WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, o_custkey, coalesce(priority, (SELECT v FROM v)) AS priority FROM gap_orders""",
)
def clean_fill_mode(spark, sf_dir):
    df = gap_orders(spark, sf_dir).select("o_orderkey", "o_custkey", "priority")
    return op.fill_missing(df, "priority", "mode")


@query(
    "clean_fill_constant",
    f"""WITH {GAP_ORDERS}
SELECT o_orderkey, coalesce(priority, 'unknown') AS priority, coalesce(total, -1.0) AS total FROM gap_orders""",
)
def clean_fill_constant(spark, sf_dir):
    df = gap_orders(spark, sf_dir).select("o_orderkey", "priority", "total")
    df = op.fill_missing(df, "priority", "constant", "unknown")
    return op.fill_missing(df, "total", "constant", -1)


_FFILL = """last_value(value IGNORE NULLS) OVER ({p} ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_BFILL = """first_value(value IGNORE NULLS) OVER ({p} ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@query(
    "clean_ffill",
    f"WITH {GAP_EVENTS} SELECT event_id, event_type, {_FFILL.format(p='')} AS value FROM gap_events",
)
def clean_ffill(spark, sf_dir):
    df = gap_events(spark, sf_dir).select("event_id", "event_type", "value")
    return op.fill_missing(df, "value", "ffill", order_by=["event_id"])


@query(
    "clean_ffill_by_user",
    f"WITH {GAP_EVENTS} SELECT event_id, user_id, {_FFILL.format(p='PARTITION BY user_id')} AS value FROM gap_events",
)
def clean_ffill_by_user(spark, sf_dir):
    """Carrying values forward within each user's own rows."""
    df = gap_events(spark, sf_dir).select("event_id", "user_id", "value")
    return op.fill_missing(df, "value", "ffill", order_by=["event_id"], partition_by=["user_id"])


@query(
    "clean_bfill",
    f"WITH {GAP_EVENTS} SELECT event_id, event_type, {_BFILL.format(p='')} AS value FROM gap_events",
)
def clean_bfill(spark, sf_dir):
    df = gap_events(spark, sf_dir).select("event_id", "event_type", "value")
    return op.fill_missing(df, "value", "bfill", order_by=["event_id"])


_PADDED = r"E'\t ' || c_name || E' \n'"


@query(
    "clean_text_trim",
    f"""WITH padded AS (SELECT c_custkey, {_PADDED} AS c_name FROM customer)
SELECT c_custkey, regexp_replace(c_name, '^\\s+|\\s+$', '', 'g') AS c_name FROM padded""",
)
def clean_text_trim(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("\t "), "c_name", F.lit(" \n")).alias("c_name")
    )
    return op.clean_text(df, "c_name", "trim")


@query("clean_text_lower", "SELECT doc_id, lower(text) AS text FROM documents")
def clean_text_lower(spark, sf_dir):
    return op.clean_text(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "lower")


@query("clean_text_upper", "SELECT p_partkey, upper(p_name) AS p_name FROM part")
def clean_text_upper(spark, sf_dir):
    return op.clean_text(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "upper")


_TITLE_INPUT = "p_name || '-x' || p_size || 'y o''neil'"


@query(
    "clean_text_title",
    f"""WITH t AS (SELECT p_partkey, {_TITLE_INPUT} AS label FROM part)
SELECT p_partkey, list_aggregate(list_transform(regexp_extract_all(label, '([A-Za-z]+|[^A-Za-z]+)'),
       lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') AS label FROM t""",
)
def clean_text_title(spark, sf_dir):
    df = read(spark, sf_dir, "part").selectExpr("p_partkey", f"{_TITLE_INPUT.replace(chr(39) * 2, chr(92) + chr(39))} AS label")
    return op.clean_text(df, "label", "title")


@query("clean_cast_string", "SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def clean_cast_string(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return op.cast_type(df, "l_orderkey", "string")


def _raw_events(spark, sf_dir):
    """The number in the JSON text, replaced by a word for one event type."""
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.expr("CASE WHEN event_type = 'error' THEN 'n/k' ELSE get_json_object(props, '$.k') END").alias("k"),
    )


_RAW_EVENTS = """raw_events AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/k' ELSE json_extract_string(props, '$.k') END AS k FROM events)"""


@query("clean_cast_numeric", f"WITH {_RAW_EVENTS} SELECT event_id, try_cast(k AS DOUBLE) AS k FROM raw_events")
def clean_cast_numeric(spark, sf_dir):
    return op.cast_type(_raw_events(spark, sf_dir), "k", "numeric")


def _date_texts(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr(
            "CASE o_orderstatus WHEN 'F' THEN date_format(o_orderdate, 'yyyy-MM-dd') "
            "WHEN 'O' THEN date_format(o_orderdate, 'yyyy/MM/dd') ELSE 'later' END"
        ).alias("ordered"),
    )


@query(
    "clean_cast_datetime",
    """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS ordered
FROM orders""",
)
def clean_cast_datetime(spark, sf_dir):
    out = op.cast_type(_date_texts(spark, sf_dir), "ordered", "datetime")
    return out.select("o_orderkey", F.date_format("ordered", "yyyy-MM-dd HH:mm:ss").alias("ordered"))


_FLAGS = """CASE o_orderpriority WHEN '1-URGENT' THEN ' Yes' WHEN '2-HIGH' THEN 'T' WHEN '3-MEDIUM' THEN NULL
     WHEN '4-NOT SPECIFIED' THEN '1 ' ELSE 'off' END AS flag"""


@query(
    "clean_cast_boolean",
    """SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED') AS flag FROM orders""",
)
def clean_cast_boolean(spark, sf_dir):
    df = read(spark, sf_dir, "orders").selectExpr("o_orderkey", _FLAGS)
    return op.cast_type(df, "flag", "boolean")


@query(
    "clean_cast_affected",
    f"""WITH {_RAW_EVENTS}
SELECT count(*) FILTER (k IS DISTINCT FROM CASE WHEN try_cast(k AS DOUBLE) IS NULL THEN NULL ELSE k || '.0' END)::BIGINT AS affected
FROM raw_events""",
)
def clean_cast_affected(spark, sf_dir):
    df = _raw_events(spark, sf_dir)
    return op.affected_count(df, F.col("k"), op.cast_expr(df, "k", "numeric"))


_SPREAD = "CASE WHEN l_linenumber = 7 AND l_quantity > 45 THEN l_quantity * 40 ELSE l_quantity END"


def _spread(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"CASE WHEN l_linenumber = 1 THEN NULL ELSE {_SPREAD} END AS quantity"
    )


_SPREAD_SQL = f"""spread AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE {_SPREAD} END AS quantity FROM lineitem)"""


@query(
    "clean_outliers_iqr",
    f"""WITH {_SPREAD_SQL}, q AS (
  SELECT quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.75) AS q3 FROM spread)
SELECT l_orderkey, l_linenumber, quantity FROM spread, q
WHERE quantity IS NULL OR quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
)
def clean_outliers_iqr(spark, sf_dir):
    return op.remove_outliers(_spread(spark, sf_dir), "quantity", "iqr")


@query(
    "clean_outliers_zscore",
    f"""WITH {_SPREAD_SQL}, m AS (SELECT avg(quantity) AS m, stddev_samp(quantity) AS s FROM spread)
SELECT l_orderkey, l_linenumber, quantity FROM spread, m WHERE quantity IS NULL OR abs(quantity - m) / s <= 3""",
)
def clean_outliers_zscore(spark, sf_dir):
    return op.remove_outliers(_spread(spark, sf_dir), "quantity", "z_score")


_STEPS = [
    {"type": "clean_text", "column": "status", "strategy": "lower"},
    {"type": "fill_missing", "column": "quantity", "strategy": "median"},
    {"type": "fill_missing", "column": "status", "strategy": "constant", "fill_value": "none"},
    {"type": "remove_outliers", "column": "price", "strategy": "iqr"},
    {"type": "drop_duplicates"},
    {"type": "cast_type", "column": "flag", "target_type": "boolean"},
]


def _step_input(spark, sf_dir):
    return gap_lines(spark, sf_dir).select(
        "quantity", F.expr("CASE WHEN flag = 'R' THEN price * 3 ELSE round(price, -4) END").alias("price"), "flag", "status"
    )


_STEP_SQL = f"""
{GAP_LINES}, input AS (
  SELECT quantity, CASE WHEN flag = 'R' THEN price * 3 ELSE round(price, -4) END AS price, flag, status FROM gap_lines),
filled AS (
  SELECT coalesce(quantity, (SELECT median(quantity) FROM input)) AS quantity, price, flag,
         coalesce(lower(status), 'none') AS status FROM input),
q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM filled),
inside AS (SELECT filled.* FROM filled, q WHERE price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
kept AS (SELECT DISTINCT * FROM inside)
"""

_STEP_SUMMARY = """
SELECT 0::INTEGER AS step, 'clean_text' AS type, 'status' AS "column", (SELECT count(status) FROM input)::BIGINT AS affected, 'lower' AS strategy, NULL::VARCHAR AS target_type, NULL::VARCHAR AS fill_value
UNION ALL SELECT 1, 'fill_missing', 'quantity', (SELECT count(*) - count(quantity) FROM input), 'median', NULL, NULL
UNION ALL SELECT 2, 'fill_missing', 'status', (SELECT count(*) - count(status) FROM input), 'constant', NULL, 'none'
UNION ALL SELECT 3, 'remove_outliers', 'price', (SELECT count(*) FROM filled) - (SELECT count(*) FROM inside), 'iqr', NULL, NULL
UNION ALL SELECT 4, 'drop_duplicates', NULL, (SELECT count(*) FROM inside) - (SELECT count(*) FROM kept), NULL, NULL, NULL
UNION ALL SELECT 5, 'cast_type', 'flag', (SELECT count(flag) FROM kept), NULL, 'boolean', NULL
"""


@query(
    "clean_sequence",
    f"WITH {_STEP_SQL} SELECT quantity, round(price, 4) AS price, false AS flag, status FROM kept",
)
def clean_sequence(spark, sf_dir):
    """Six cleaning steps in order."""
    return rounded(run.clean(_step_input(spark, sf_dir), _STEPS)[0])


@query("clean_summary", f"WITH {_STEP_SQL} {_STEP_SUMMARY}")
def clean_summary(spark, sf_dir):
    """What each of the six steps changed."""
    return run.clean(_step_input(spark, sf_dir), _STEPS)[1]


@query(
    "clean_job_rollup",
    f"""WITH {_STEP_SQL}, s AS ({_STEP_SUMMARY})
SELECT sum(affected) FILTER (type IN ('drop_duplicates', 'remove_outliers'))::BIGINT AS rows_removed,
       sum(affected) FILTER (type = 'drop_duplicates')::BIGINT AS duplicates_removed,
       sum(affected) FILTER (type = 'fill_missing')::BIGINT AS missing_handled,
       sum(affected) FILTER (type = 'remove_outliers')::BIGINT AS outliers_handled FROM s""",
)
def clean_job_rollup(spark, sf_dir):
    return run.job_rollup(run.clean(_step_input(spark, sf_dir), _STEPS)[1])


@query(
    "cat_clean_totals",
    f"WITH {_STEP_SQL}, s AS ({_STEP_SUMMARY}) SELECT type, sum(affected)::BIGINT AS affected FROM s GROUP BY type",
)
def cat_clean_totals(spark, sf_dir):
    return run.clean_totals(run.clean(_step_input(spark, sf_dir), _STEPS)[1])


_TOTALS = """SELECT '{stage}' AS stage, count(*)::BIGINT AS rows, 4::BIGINT AS columns,
  (4 * count(*) - count(quantity) - count(price) - count(flag) - count(status))::BIGINT AS missing_cells,
  (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})))::BIGINT AS duplicate_rows FROM {t}"""


@query(
    "clean_preview",
    f"""WITH {_STEP_SQL}, result AS (SELECT quantity, price, false AS flag, status FROM kept)
{_TOTALS.format(stage='before', t='input')} UNION ALL {_TOTALS.format(stage='after', t='result')}""",
)
def clean_preview(spark, sf_dir):
    return run.preview(_step_input(spark, sf_dir), _STEPS)["stages"]


_CHECKED = [
    {"type": "fill_missing", "column": "status", "strategy": "mean"},
    {"type": "fill_missing", "strategy": "mode"},
    {"type": "clean_text", "column": "price", "strategy": "trim"},
    {"type": "sort_rows", "column": "price"},
    {"type": "cast_type", "column": "status", "target_type": "numeric"},
    {"type": "fill_missing", "column": "status", "strategy": "mean"},
    {"type": "fill_missing", "column": "quantity", "strategy": "median"},
    {"type": "remove_outliers", "column": "nothing", "strategy": "iqr"},
]


@query(
    "clean_validate",
    f"""WITH {_STEP_SQL}
SELECT 0::INTEGER AS step, 'strategy ''mean'' needs a numeric column' AS problem, NULL::BIGINT AS affected
UNION ALL SELECT 1, 'operation ''fill_missing'' requires a column', NULL
UNION ALL SELECT 2, 'text operations need a text column', NULL
UNION ALL SELECT 3, 'unsupported operation type ''sort_rows''', NULL
UNION ALL SELECT 4, NULL, (SELECT count(status) FROM input)
UNION ALL SELECT 5, NULL, (SELECT count(*) FROM input)
UNION ALL SELECT 6, NULL, (SELECT count(*) - count(quantity) FROM input)
UNION ALL SELECT 7, 'column ''nothing'' does not exist', NULL""",
)
def clean_validate(spark, sf_dir):
    """Outcome of checking a list of steps, and what the valid ones change."""
    df = _step_input(spark, sf_dir)
    problems = run.validate(df.schema, _CHECKED)
    valid = [n for n, p in enumerate(problems) if p is None]
    changes = run.clean(df, [_CHECKED[n] for n in valid])[1].select("step", "affected")
    rows = [
        {"step": n, "problem": p, "place": valid.index(n) if n in valid else None} for n, p in enumerate(problems)
    ]
    listed = literal_rows(spark, rows, "step int, problem string, place int")
    return listed.join(changes.withColumnRenamed("step", "place"), "place", "left").select("step", "problem", "affected")
