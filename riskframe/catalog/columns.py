"""Target, feature and schema queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog.base import EVENTS, events, table
from riskframe.operators import columns as C
from riskframe.operators.target_stats import ordered_target_stats as ordered_stats

STATUS = {"F": 1, "O": 0}
REQUIRED = ("k", "value", "hour", "user_id")


def encode_target(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("y"))
    return C.encode_target(orders, "y", STATUS)


def split_features_target(spark, sf):
    df = events(spark, sf).select("event_id", "value", "user_id", "hour", "y")
    features, target = C.split_features_target(df, "y", "event_id")
    return df.select("event_id", *features, F.col(target).alias("actual"))


def select_features(spark, sf):
    return C.select_features(events(spark, sf), REQUIRED, ["event_id"])


def missing_features(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("feature"), "p_size")
    required = parts.select("feature").distinct()
    actual = parts.where("p_size >= 50").select("feature")
    return C.missing_features(required, actual)


def decode_label(spark, sf):
    df = events(spark, sf).select("event_id", (F.col("p_value") > 0.5).cast("int").alias("prediction"))
    return C.decode_label(df, "prediction", "Converts", "Does not convert", "prediction_label")


def drop_key(spark, sf):
    return C.drop_key(table(spark, sf, "customer"), "c_custkey")


def reduce_columns(spark, sf):
    return C.reduce_columns(table(spark, sf, "lineitem"), ["l_shipdate", "l_tax", "l_returnflag", "l_linestatus"])


def one_hot(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("priority"),
    )
    levels = C.category_levels(orders, ["o_orderstatus", "priority"])
    return C.one_hot(orders, levels)


def ordered_target_stats(spark, sf):
    """Users and hours as numbers, each row by the rows of its level before it in hash order."""
    df = events(spark, sf).select("event_id", "user_id", "hour", "y")
    found = ordered_stats(df, "event_id", ["user_id", "hour"], "y")
    return found.select("event_id", *[F.round(c, 9).alias(c) for c in ("user_id_stat", "hour_stat")])


def table_profile(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        "o_orderstatus",
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("priority"),
    )
    return C.table_profile(orders)


def _profile_sql(column: str, numeric: bool) -> str:
    low, high = f"min({column})", f"max({column})"
    number = (f"CAST({low} AS DOUBLE)", f"CAST({high} AS DOUBLE)") if numeric else ("CAST(NULL AS DOUBLE)",) * 2
    text = ("CAST(NULL AS VARCHAR)",) * 2 if numeric else (low, high)
    return f"""SELECT '{column}' AS "column", count(*) AS n_rows, count(*) - count({column}) AS n_missing,
  count(DISTINCT {column}) AS n_distinct, {number[0]} AS min_number, {number[1]} AS max_number,
  {text[0]} AS min_text, {text[1]} AS max_text FROM o"""


PRIORITY = "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS priority"

QUERIES = {
    f.__name__: f
    for f in (
        encode_target,
        split_features_target,
        select_features,
        missing_features,
        decode_label,
        drop_key,
        reduce_columns,
        one_hot,
        ordered_target_stats,
        table_profile,
    )
}

_BEFORE = """(coalesce(sum(y) OVER (PARTITION BY {c} ORDER BY md5('stats:42:' || event_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + (SELECT avg(y) FROM ev)) / (count(*) OVER (PARTITION BY {c} ORDER BY md5('stats:42:' || event_id)
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1.0e0)"""

ORACLES = {
    "ordered_target_stats": f"""WITH {EVENTS} SELECT event_id, round({_BEFORE.format(c='user_id')}, 9) AS user_id_stat,
  round({_BEFORE.format(c='hour')}, 9) AS hour_stat FROM ev""",
    "encode_target": """SELECT o_orderkey,
  CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS INTEGER) AS y FROM orders""",
    "split_features_target": f"WITH {EVENTS} SELECT event_id, value, user_id, hour, y AS actual FROM ev",
    "select_features": f"WITH {EVENTS} SELECT event_id, k, value, hour, user_id FROM ev",
    "missing_features": """SELECT DISTINCT p_brand AS feature FROM part
  WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size >= 50)""",
    "decode_label": f"""WITH {EVENTS} SELECT event_id, CAST(p_value > 0.5e0 AS INTEGER) AS prediction,
  CASE WHEN p_value > 0.5e0 THEN 'Converts' ELSE 'Does not convert' END AS prediction_label FROM ev""",
    "drop_key": "SELECT c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "reduce_columns": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount
  FROM lineitem""",
    "one_hot": """SELECT o_orderkey, o_orderstatus = 'O' AS "o_orderstatus_O", o_orderstatus = 'P' AS "o_orderstatus_P",
  o_orderpriority = '2-HIGH' AS "priority_2-HIGH", o_orderpriority = '3-MEDIUM' AS "priority_3-MEDIUM",
  o_orderpriority = '5-LOW' AS "priority_5-LOW" FROM orders""",
    "table_profile": f"WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, {PRIORITY} FROM orders) "
    + " UNION ALL ".join(
        _profile_sql(c, numeric)
        for c, numeric in (
            ("o_orderkey", True),
            ("o_custkey", True),
            ("o_totalprice", True),
            ("o_orderstatus", False),
            ("priority", False),
        )
    ),
}
