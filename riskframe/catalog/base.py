"""Inputs the queries share, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSITIVE = ("purchase", "signup")
MODELS = ("value", "user", "event")
FEATURES = ("value", "user_id", "hour", "k")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a binary target and three fixed scores."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "value",
        "event_type",
        F.hour("ts").alias("hour"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("event_type").isin(*POSITIVE).cast("int").alias("y"),
        (F.floor(F.col("value") / (F.col("value") + 50.0) * 10000) / 10000).alias("p_value"),
        ((F.col("user_id") * 7919) % 1000 / F.lit(1000.0)).alias("p_user"),
        ((F.col("event_id") * 104729) % 1000 / F.lit(1000.0)).alias("p_event"),
    )


EVENTS = """ev AS (
  SELECT event_id, user_id, value, event_type, CAST(hour(ts) AS INTEGER) AS hour,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS y,
         floor(value / (value + 50.0e0) * 10000) / 10000 AS p_value,
         ((user_id * 7919) % 1000) / 1000.0e0 AS p_user,
         ((event_id * 104729) % 1000) / 1000.0e0 AS p_event
  FROM events)"""


def long_scores(df: DataFrame, keep: tuple = ("event_id", "y")) -> DataFrame:
    """(keep..., model, p, prediction): one row per event and score."""
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("p")) for m in MODELS])
    return df.select(*keep, F.inline(cells)).withColumn("prediction", (F.col("p") > 0.5).cast("int"))


SCORES = (
    "sc AS ("
    + " UNION ALL ".join(
        f"SELECT event_id, y, '{m}' AS model, p_{m} AS p, CAST(p_{m} > 0.5e0 AS INTEGER) AS prediction FROM ev" for m in MODELS
    )
    + ")"
)


def fold_sql(source: str, key: str, target: str, k: int, seed: str = "42", name: str = "folded") -> str:
    """CTEs giving every row of ``source`` its fold: classes are cut, in hash order, into k even parts."""
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {target} ORDER BY md5('{seed}:' || {key}), {key}) AS pos FROM {source}),
classes AS (
  SELECT {target} AS c, count(*) AS n,
         coalesce(sum(count(*)) OVER (ORDER BY {target} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM {source} GROUP BY {target}),
sizes AS (
  SELECT c, f, n // {k} + CASE WHEN ((f - before) % {k} + {k}) % {k} < n % {k} THEN 1 ELSE 0 END AS size
  FROM classes, range({k}) t(f)),
ends AS (SELECT c, f, size, sum(size) OVER (PARTITION BY c ORDER BY f) AS last FROM sizes),
{name} AS (
  SELECT ranked.* EXCLUDE (pos), CAST(f AS INTEGER) AS fold FROM ranked
  JOIN ends ON c = {target} AND pos <= last AND pos > last - size)"""


def binary_sql(by: str, source: str) -> str:
    """Positive-class metrics per group as a SELECT."""
    tp = "sum(CASE WHEN y = 1 AND prediction = 1 THEN 1 ELSE 0 END)"
    fp = "sum(CASE WHEN y = 0 AND prediction = 1 THEN 1 ELSE 0 END)"
    fn = "sum(CASE WHEN y = 1 AND prediction = 0 THEN 1 ELSE 0 END)"
    return f"""SELECT {by}, count(*) AS n, avg(CASE WHEN y = prediction THEN 1.0e0 ELSE 0.0e0 END) AS accuracy,
  coalesce(1.0e0 * {tp} / nullif({tp} + {fp}, 0), 0) AS precision,
  coalesce(1.0e0 * {tp} / nullif({tp} + {fn}, 0), 0) AS recall,
  coalesce(2.0e0 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0) AS f1
FROM {source} GROUP BY {by}"""


def rounded_columns(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(
        *[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def checked_scores(scored: DataFrame, keep: tuple = ("event_id", "y"), own_rows: bool = True) -> DataFrame:
    """What has to hold for every score of a fitted model: the class is that of the probability, which lies between 0 and 1
    (or is null on all rows), and, if it was fitted on these scores' rows, it is no worse there than one class for all."""
    p, c = F.col("probability"), F.col("prediction")
    agrees = F.when(F.abs(p - 0.5) < 1e-12, F.lit(True)).otherwise((p > 0.5) == (c == 1))
    consistent = F.when(p.isNull(), c.isin(0, 1)).otherwise(p.between(0, 1) & agrees)
    hit = lambda label: F.avg(F.when(F.col("y") == label, (c == label).cast("double")))
    balanced, n, with_p = scored.agg((hit(0) + hit(1)) / 2, F.count("*"), F.count(p)).first()
    no_worse = [F.lit(bool(balanced >= 0.5)).alias("no_worse")] if own_rows else []
    return scored.select(*keep, (consistent & F.lit(with_p in (0, n))).alias("consistent"), *no_worse)


#: SQL of ``checked_scores``: every row of the events, and all of it true.
CHECKED = f"WITH {EVENTS} SELECT event_id, y, true AS consistent, true AS no_worse FROM ev"
