"""Queries for the rule-based findings, over lines with gaps, copies, outliers and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explore, profile
from ..plans import findings as op
from .registry import query
from .tables import read, rounded

_COLUMNS = """l_returnflag AS flag, 'line ' || l_orderkey || '-' || l_linenumber AS label,
  CASE WHEN l_linenumber >= 3 THEN NULL ELSE l_quantity END AS quantity,
  l_quantity * l_quantity * l_quantity * l_quantity AS power,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS discount, l_shipdate AS shipped"""

NAMES = ("flag", "label", "quantity", "power", "discount", "shipped")

MESSY = f"""once AS (SELECT {_COLUMNS} FROM lineitem),
messy AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE flag = 'R'),
t AS (SELECT count(*) AS n, {' + '.join(f'count(*) - count({c})' for c in NAMES)} AS missing,
             count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS dups FROM messy),
quality AS (SELECT n, missing, dups, greatest(0, least(100, 100.0 - 50.0 * missing / (n * 6) - 50.0 * dups / n))::DOUBLE AS q FROM t)"""


def messy(spark, sf_dir):
    once = read(spark, sf_dir, "lineitem").selectExpr(*[c.strip() for c in _split(_COLUMNS)])
    return once.unionByName(once.where("flag = 'R'"))


def _split(text: str) -> list[str]:
    return [part.strip() for part in text.replace("\n", " ").split(", ")]


_MISSING = f"""worst AS (
  SELECT string_agg(c || ' (' || m || ')', ', ' ORDER BY m DESC, p) AS names FROM (
    SELECT * FROM ({' UNION ALL '.join(f"SELECT {i} AS p, '{c}' AS c, count(*) - count({c}) AS m FROM messy" for i, c in enumerate(NAMES))})
    WHERE m > 0 ORDER BY m DESC, p LIMIT 3)),
f_missing AS (
  SELECT 'QUAL_001' AS rule_id, 'Quality' AS category,
    CASE WHEN pct > 20 THEN 'CRITICAL' WHEN pct > 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    printf('%.2f%% of the cells are missing.', pct) AS observation,
    missing || ' cells are empty, most of them in ' || names AS detail
  FROM (SELECT *, missing * 100.0::DOUBLE / (n * 6) AS pct FROM t), worst WHERE missing > 0)"""

_DUPLICATES = """f_duplicates AS (
  SELECT 'QUAL_002' AS rule_id, 'Quality' AS category, CASE WHEN pct > 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    printf('%.2f%% of the rows repeat another row.', pct) AS observation,
    dups || ' rows are copies, perhaps from loading data twice' AS detail
  FROM (SELECT *, dups * 100.0::DOUBLE / n AS pct FROM t) WHERE dups > 0)"""


def _fence(i: int, c: str) -> str:
    return f"""SELECT {i} AS p, '{c}' AS c, count(*) FILTER ({c} < lo OR {c} > hi) AS m,
      count(*) FILTER ({c} < lo OR {c} > hi) * 100.0::DOUBLE / count({c}) AS pct
    FROM messy, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
      (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM messy))"""


_OUTLIERS = f"""fences AS ({' UNION ALL '.join(_fence(i, c) for i, c in enumerate(NAMES) if c in ('quantity', 'power', 'discount'))}),
worst_fences AS (SELECT * FROM fences WHERE m > 0 ORDER BY m DESC, p LIMIT 3),
f_outliers AS (
  SELECT 'OUT_003' AS rule_id, 'Risk' AS category, CASE WHEN arg_min(pct, -m * 10 + p) > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    'Numeric columns contain outliers.' AS observation,
    'Values lie beyond 1.5 interquartile ranges in ' || string_agg(c || ' (' || m || printf(', %.1f%%)', pct), ', ' ORDER BY m DESC, p) AS detail
  FROM worst_fences HAVING count(*) > 0)"""

_CORRELATION = """pairs AS (
  SELECT 0 AS p, 'quantity' AS a, 'power' AS b, corr(quantity, power) AS r FROM messy
  UNION ALL SELECT 1, 'quantity', 'discount', corr(quantity, discount) FROM messy
  UNION ALL SELECT 2, 'power', 'discount', corr(power, discount) FROM messy),
strong AS (SELECT * FROM pairs WHERE abs(r) >= 0.5 ORDER BY p LIMIT 5),
f_correlation AS (
  SELECT 'CORR_004' AS rule_id, 'Correlation' AS category, CASE WHEN max(abs(r)) >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    'Numeric columns depend linearly on each other.' AS observation,
    'Strong Pearson correlation: ' || string_agg(a || ' & ' || b || printf(' (r=%.2f)', r), ', ' ORDER BY p) AS detail
  FROM strong HAVING count(*) > 0)"""

_CARDINALITY = """wide AS (
  SELECT * FROM (SELECT 0 AS p, 'flag' AS c, count(DISTINCT flag) AS u, count(DISTINCT flag) / count(*) AS ratio FROM messy
    UNION ALL SELECT 1, 'label', count(DISTINCT label), count(DISTINCT label) / count(*) FROM messy)
  WHERE ratio > 0.5 AND u > 10 ORDER BY p LIMIT 3),
f_cardinality AS (
  SELECT 'CARD_005' AS rule_id, 'Statistics' AS category, 'LOW' AS severity,
    'Categorical columns hold mostly distinct values.' AS observation,
    'These look like labels or identifiers: ' || string_agg(c || ' (' || u || printf(' values, %.1f%%)', ratio * 100), ', ' ORDER BY p) AS detail
  FROM wide HAVING count(*) > 0)"""

_TIMELINE = """f_timeline AS (
  SELECT 'TEMP_006' AS rule_id, 'Timeline' AS category, 'INFO' AS severity, 'Date columns cover a period of time.' AS observation,
    'shipped' || printf(': %.1f days', floor((epoch_us(max(shipped)) - epoch_us(min(shipped))) / 86400000000)::DOUBLE)
      || ' from ' || strftime(min(shipped), '%Y-%m-%dT%H:%M:%S') || ' to ' || strftime(max(shipped), '%Y-%m-%dT%H:%M:%S') AS detail
  FROM messy)"""

FINDINGS = f"{MESSY}, {_MISSING}, {_DUPLICATES}, {_OUTLIERS}, {_CORRELATION}, {_CARDINALITY}, {_TIMELINE}"
_NAMES = ("f_missing", "f_duplicates", "f_outliers", "f_correlation", "f_cardinality", "f_timeline")
_ALL = " UNION ALL ".join(f"SELECT {i + 1} AS rule_order, * FROM {n}" for i, n in enumerate(_NAMES))
_SHOWN = ("rule_id", "category", "severity", "observation", "detail")


@query("ins_missing", f"WITH {MESSY}, {_MISSING} SELECT * FROM f_missing")
def ins_missing(spark, sf_dir):
    df = messy(spark, sf_dir)
    return op.rule_missing(explore.overview(df), profile.missing_by_column(df)).select(*_SHOWN)


@query("ins_duplicates", f"WITH {MESSY}, {_DUPLICATES} SELECT * FROM f_duplicates")
def ins_duplicates(spark, sf_dir):
    return op.rule_duplicates(explore.overview(messy(spark, sf_dir))).select(*_SHOWN)


@query("ins_outliers", f"WITH {MESSY}, {_OUTLIERS} SELECT * FROM f_outliers")
def ins_outliers(spark, sf_dir):
    return op.rule_outliers(explore.outlier_summary(messy(spark, sf_dir))).select(*_SHOWN)


@query("ins_correlation", f"WITH {MESSY}, {_CORRELATION} SELECT * FROM f_correlation")
def ins_correlation(spark, sf_dir):
    return op.rule_correlation(explore.correlations(messy(spark, sf_dir))).select(*_SHOWN)


@query("ins_cardinality", f"WITH {MESSY}, {_CARDINALITY} SELECT * FROM f_cardinality")
def ins_cardinality(spark, sf_dir):
    return op.rule_cardinality(explore.describe_categorical(messy(spark, sf_dir))).select(*_SHOWN)


@query("ins_timeline", f"WITH {MESSY}, {_TIMELINE} SELECT * FROM f_timeline")
def ins_timeline(spark, sf_dir):
    return op.rule_timeline(explore.describe_datetime(messy(spark, sf_dir))).select(*_SHOWN)


_SCORES = """(VALUES (1, 0.98::DOUBLE, 0.90::DOUBLE), (2, 0.99, 0.95), (3, 0.92, 0.85), (4, 0.95, 0.70), (5, 0.90, 0.60), (6, 0.95, 0.50)) s(rule_order, confidence, actionability)"""


@query(
    "ins_scores",
    f"WITH {FINDINGS}, f AS ({_ALL}) SELECT rule_id, severity, confidence, actionability FROM f JOIN {_SCORES} USING (rule_order)",
)
def ins_scores(spark, sf_dir):
    return op.findings(messy(spark, sf_dir)).select("rule_id", "severity", "confidence", "actionability")


_WEIGHT = "CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END"


@query(
    "ins_rank",
    f"""WITH {FINDINGS}, f AS ({_ALL})
SELECT row_number() OVER (ORDER BY {_WEIGHT} DESC, rule_order)::INTEGER AS place, rule_id, category, severity, observation, detail FROM f""",
)
def ins_rank(spark, sf_dir):
    ranked = op.rank(op.findings(messy(spark, sf_dir)))
    # At most one row per rule, so numbering the places is a six-row window.
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(op.severity_weight(F.col("severity")).desc(), "rule_order")
    return ranked.select(F.row_number().over(w).alias("place"), *_SHOWN)


@query(
    "ins_recommend",
    f"""WITH {FINDINGS},
gaps AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT {i} AS p, '{c}' AS c, count(*) - count({c}) AS m FROM messy" for i, c in enumerate(NAMES))}) WHERE m > 0 ORDER BY m DESC, p LIMIT 3)
SELECT 'QUAL_001' AS rule_id, 'fill_missing' AS type, c AS "column", 'median' AS strategy, NULL::VARCHAR AS target_type FROM gaps
UNION ALL SELECT 'QUAL_002', 'drop_duplicates', NULL, NULL, NULL FROM f_duplicates
UNION ALL SELECT 'OUT_003', 'remove_outliers', c, 'iqr', NULL FROM worst_fences
UNION ALL SELECT 'CARD_005', 'cast_type', c, NULL, 'string' FROM wide""",
)
def ins_recommend(spark, sf_dir):
    steps = op.recommend(op.findings(messy(spark, sf_dir)))
    return steps.select("rule_id", "type", "column", "strategy", "target_type")


@query(
    "ins_health",
    f"""WITH {FINDINGS}, f AS ({_ALL}), c AS (
  SELECT count(*)::BIGINT AS total_findings, count(*) FILTER (severity = 'CRITICAL')::BIGINT AS critical,
    count(*) FILTER (severity = 'HIGH')::BIGINT AS high, count(*) FILTER (severity = 'MEDIUM')::BIGINT AS medium,
    count(*) FILTER (severity = 'LOW')::BIGINT AS low, count(*) FILTER (severity = 'INFO')::BIGINT AS info FROM f)
SELECT CASE WHEN critical > 0 OR q < 50 THEN 'CRITICAL' WHEN high > 2 OR q < 70 THEN 'POOR' WHEN high > 0 OR q < 85 THEN 'FAIR'
            WHEN q >= 95 AND medium = 0 THEN 'EXCELLENT' ELSE 'GOOD' END AS overall_health,
       round(q, 4) AS quality_score, c.* FROM c, quality""",
)
def ins_health(spark, sf_dir):
    s = op.Statistics(messy(spark, sf_dir))
    return rounded(op.health(s.findings(), s.table))


_TYPES = {"flag": "'categorical'", "quantity": "'numeric'", "power": "'numeric'", "discount": "'numeric'", "shipped": "'datetime'",
          "label": "CASE WHEN count(DISTINCT label) < 20 OR count(DISTINCT label) / count(*) < 0.05 THEN 'categorical' ELSE 'text' END"}
_LINES = " UNION ALL ".join(
    f"SELECT {i} AS p, '- {c}: type ' || {_TYPES[c]} || ', distinct ' || count(DISTINCT {c}) || ', missing ' || (count(*) - count({c})) AS line FROM messy"
    for i, c in enumerate(NAMES)
)


@query(
    "ins_context",
    f"""WITH {FINDINGS}, lines AS ({_LINES}),
body AS (SELECT string_agg(line, E'\\n' ORDER BY p) AS cols FROM lines),
rel AS (SELECT string_agg('- ' || a || ' & ' || b || printf(': r=%.2f', r), E'\\n' ORDER BY p) AS rel FROM pairs WHERE abs(r) >= 0.5)
SELECT 'lines' AS dataset_name, n::BIGINT AS rows, 6::BIGINT AS columns, round(q, 4) AS quality_score,
  E'Table lines\\nrows ' || n || E', columns 6\\nquality ' || printf('%.1f', q) || E'/100\\nmissing cells ' || missing || E'\\nduplicate rows ' || dups
  || E'\\nColumns:\\n' || cols || coalesce(E'\\nStrong correlations:\\n' || rel, '') AS context
FROM quality, body, rel""",
)
def ins_context(spark, sf_dir):
    s = op.Statistics(messy(spark, sf_dir))
    return rounded(op.context_text(s.table, s.columns, s.pairs, "lines"))
