"""Preview queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import preview as op
from ..session import materialize
from .registry import query
from .tables import GAP_ORDERS, gap_orders, read


@query(
    "prev_filter_any",
    f"""WITH {GAP_ORDERS}
SELECT * FROM gap_orders WHERE regexp_matches(o_orderkey::VARCHAR, '77|^1-u', 'i') OR regexp_matches(o_custkey::VARCHAR, '77|^1-u', 'i')
  OR coalesce(regexp_matches(priority, '77|^1-u', 'i'), false) OR coalesce(regexp_matches(total::VARCHAR, '77|^1-u', 'i'), false)
  OR regexp_matches(status, '77|^1-u', 'i') OR regexp_matches(ordered, '77|^1-u', 'i')""",
)
def prev_filter_any(spark, sf_dir):
    return op.filter_any(gap_orders(spark, sf_dir), "77|^1-u")


@query(
    "prev_sort",
    f"""WITH {GAP_ORDERS}
SELECT row_number() OVER (ORDER BY priority DESC NULLS LAST, o_orderkey)::BIGINT AS place, o_orderkey, priority FROM gap_orders""",
)
def prev_sort(spark, sf_dir):
    """Every row with its place in a descending sort of the whole table."""
    df = gap_orders(spark, sf_dir).select("o_orderkey", "priority")
    # Ids count up within each range of the sort; rows of the earlier ranges are added to them.
    ranges = materialize(
        op.sort_by(df, "priority:desc", ["o_orderkey"]).withColumn("id", F.monotonically_increasing_id()), "sorted"
    ).withColumn("range", F.shiftright("id", 33))
    earlier = Window.partitionBy(F.lit(0)).orderBy("range")
    offsets = ranges.groupBy("range").count().select("range", (F.sum("count").over(earlier) - F.col("count")).alias("offset"))
    place = F.col("offset") + F.col("id") % (1 << 33) + 1
    return ranges.join(F.broadcast(offsets), "range").select(place.alias("place"), "o_orderkey", "priority")


@query(
    "prev_page",
    f"""WITH {GAP_ORDERS}
SELECT o_orderkey, total, priority, (SELECT count(*) FROM gap_orders)::BIGINT AS total_rows, 6::BIGINT AS total_columns
FROM gap_orders ORDER BY total ASC NULLS LAST, o_orderkey LIMIT 25 OFFSET 75""",
)
def prev_page(spark, sf_dir):
    df = gap_orders(spark, sf_dir)
    totals = op.page_totals(df).select(F.struct("total_rows", "total_columns")).scalar()
    rows = op.page(df, 4, 25, ["o_orderkey"], sort="total:asc").withColumn("t", totals)
    return rows.select("o_orderkey", "total", "priority", "t.total_rows", "t.total_columns")


@query("prev_head", "SELECT event_id, ts, event_type FROM events ORDER BY event_id LIMIT 100")
def prev_head(spark, sf_dir):
    return op.head(read(spark, sf_dir, "events").select("event_id", "ts", "event_type"), 100, ["event_id"])


@query("prev_tail", "SELECT event_id, ts, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def prev_tail(spark, sf_dir):
    return op.tail(read(spark, sf_dir, "events").select("event_id", "ts", "event_type"), 100, ["event_id"])


@query(
    "sanitize_floats",
    """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN NULL ELSE o_totalprice END AS total,
       CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice / 2 END AS half FROM orders""",
)
def sanitize_floats(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr(
            "CASE o_orderstatus WHEN 'F' THEN double('NaN') WHEN 'P' THEN double('-Infinity') ELSE o_totalprice END"
        ).alias("total"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN double('Infinity') ELSE o_totalprice / 2 END").alias("half"),
    )
    return op.sanitize_floats(df)
