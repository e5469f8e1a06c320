"""Source and sink queries: driver tables go through a format and come back."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskframe import sources as S
from riskframe.catalog.base import EVENTS, FEATURES, MODELS, SCORES, events, long_scores, table
from riskframe.operators import learners, metrics
from riskframe.session import scratch_path

ORDER_SCHEMA = "o_orderkey bigint, o_totalprice double, o_orderstatus string, priority string"
DOCUMENT_ROWS = 100


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_totalprice",
        "o_orderstatus",
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("priority"),
    )


def read_csv_table(spark, sf):
    path = scratch_path(spark, "csv")
    S.write_csv_table(_orders(spark, sf), path)
    return S.read_csv_table(spark, path, ORDER_SCHEMA)


def read_csv_inferred(spark, sf):
    """Types found by Spark: whole numbers written as decimals stay doubles, blanks are null."""
    path = scratch_path(spark, "csv")
    S.write_csv_table(_orders(spark, sf), path)
    found = S.read_csv_table(spark, path)
    return found.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


def read_tsv_log(spark, sf):
    path = scratch_path(spark, "tsv")
    log = table(spark, sf, "events").select(F.col("event_id").alias("iter"), F.col("value").alias("loss"))
    S.write_csv_table(log, path, sep="\t")
    return S.read_tsv_log(spark, path, "iter bigint, loss double")


def write_csv_table(spark, sf):
    path = scratch_path(spark, "predictions")
    scored = long_scores(events(spark, sf)).select("model", "event_id", "prediction", F.col("p").alias("probability"))
    S.write_csv_table(scored, path)
    return S.read_csv_table(spark, path, "model string, event_id bigint, prediction int, probability double")


def read_learning_curve(spark, sf):
    """Events as training curves: documents of at most 100 iterations, one JSON document per line."""
    path = scratch_path(spark, "curves")
    steps = table(spark, sf, "events").select(
        F.floor(F.col("event_id") / DOCUMENT_ROWS).alias("run"),
        F.struct(
            F.array(F.col("value")).alias("learn"),
            (F.col("event_id") % DOCUMENT_ROWS).cast("int").alias("iteration"),
            F.col("user_id").cast("double").alias("passed_time"),
            (F.col("user_id") * 2).cast("double").alias("remaining_time"),
        ).alias("step"),
    )
    steps.groupBy("run").agg(F.collect_list("step").alias("iterations")).write.json(path)
    return S.read_learning_curve(
        spark, path, f"run bigint, {S.learning_curve.CURVE_SCHEMA}", one_per_file=False, keep=["run"]
    )


def _packages(spark, sf):
    """One model folder per nation; its type is the region, its features the segments above average balance."""
    nations = F.broadcast(table(spark, sf, "nation"))
    segments = (
        table(spark, sf, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_nationkey", "n_name", "n_regionkey", "c_mktsegment")
        .agg(F.avg("c_acctbal").alias("balance"))
        .where("balance > 4400")
    )
    return segments.groupBy("n_nationkey", "n_name", "n_regionkey").agg(
        F.array_sort(F.collect_list("c_mktsegment")).alias("features")
    ).select(
        F.col("n_name").alias("package"),
        F.concat(F.lit("region_"), "n_regionkey").alias("model_type"),
        F.format_string("0.%04d", F.size("features") * 1000).alias("accuracy"),
        F.size("features").alias("feature_count"),
        F.format_string("2024-01-%02d 00:00:00", F.col("n_nationkey") + 1).alias("deployment_timestamp"),
        F.concat(F.lit("model_"), F.lower("n_name"), F.lit(".bin")).alias("model_file"),
        "features",
    )


def _infos(spark, sf):
    path = scratch_path(spark, "packages")
    S.write_model_info(_packages(spark, sf), path)
    return S.read_model_info(spark, path, f"{S.registry.INFO_SCHEMA}, package string")


def model_registry(spark, sf):
    newest = S.latest_models(_infos(spark, sf))
    return S.explode_features(newest, ["model_type", "accuracy", "feature_count", "deployment_timestamp", "model_file"])


def model_registry_changes(spark, sf):
    """Feature lists of the newest model of a type against all its earlier ones."""
    infos = _infos(spark, sf)
    newest = S.latest_models(infos)
    latest = newest.select("model_type", F.col("deployment_timestamp").alias("latest"))
    earlier = infos.join(latest, "model_type").where(F.col("deployment_timestamp") < F.col("latest"))
    return S.compare_features(
        S.explode_features(earlier, ["model_type"]), S.explode_features(newest, ["model_type"]), by=["model_type"]
    )


def register_model(spark, sf):
    path = scratch_path(spark, "registry")
    measured = metrics.accuracy(long_scores(events(spark, sf)), by=["model"])
    rows = measured.select(
        F.col("model").alias("model_type"),
        F.format_string("%.4f", "accuracy").alias("accuracy"),
        F.lit(1).alias("feature_count"),
        F.lit("2024-02-01 00:00:00").alias("deployment_timestamp"),
        F.concat(F.col("model"), F.lit(".bin")).alias("model_file"),
        F.array(F.concat(F.lit("p_"), F.col("model"))).alias("features"),
    )
    for name in MODELS:  # three runs, each adding its row
        S.register_model(rows.where(F.col("model_type") == name), path)
    return S.read_registry(spark, path).withColumn("features", F.array_join("features", ", "))


def save_load_model(spark, sf):
    path = scratch_path(spark, "model")
    df = events(spark, sf)
    model = learners.fit_logistic(df, FEATURES, "y", max_iter=10)
    S.save_model(model, path)
    loaded: PipelineModel = S.load_model(path)
    before = learners.score(model, df, ["event_id", *FEATURES]).withColumnRenamed("probability", "before").drop("prediction")
    both = learners.score(loaded, before, ["event_id", "before"])
    return both.select("event_id", (F.col("before") == F.col("probability")).alias("same"))


def versioned_run_dir(spark, sf):
    path = scratch_path(spark, "runs")
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.date_format(F.trunc("o_orderdate", "year"), "yyyyMMdd_HHmmss").alias("run_id")
    )
    S.write_run(orders, path)
    return S.read_runs(spark, path)


def union_runs(spark, sf):
    """Three overlapping runs over the orders."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    year = F.year("o_orderdate")
    runs = [
        orders.where(rule).drop("o_orderdate").withColumn("run", F.lit(name))
        for name, rule in (("a", year < 1999), ("b", year >= 1997), ("c", F.col("o_orderstatus") == "O"))
    ]
    return S.union_runs(runs, "o_orderkey", "run")


QUERIES = {
    f.__name__: f
    for f in (
        read_csv_table,
        read_csv_inferred,
        read_tsv_log,
        write_csv_table,
        read_learning_curve,
        model_registry,
        model_registry_changes,
        register_model,
        save_load_model,
        versioned_run_dir,
        union_runs,
    )
}

_CSV = """SELECT o_orderkey, o_totalprice, o_orderstatus,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS priority FROM orders"""
_PACKAGES = """WITH s AS (
  SELECT n_nationkey, n_name, n_regionkey, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey
  GROUP BY ALL HAVING avg(c_acctbal) > 4400),
p AS (
  SELECT n_nationkey, 'region_' || n_regionkey AS model_type, CAST(count(*) AS INTEGER) AS feature_count,
         '0.' || lpad(CAST(count(*) * 1000 AS VARCHAR), 4, '0') AS accuracy,
         '2024-01-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || ' 00:00:00' AS deployment_timestamp,
         'model_' || lower(n_name) || '.bin' AS model_file FROM s GROUP BY n_nationkey, n_name, n_regionkey),
newest AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY deployment_timestamp DESC) = 1)"""

ORACLES = {
    "save_load_model": "SELECT event_id, true AS same FROM events",
    "read_csv_table": _CSV,
    "read_csv_inferred": _CSV,
    "read_tsv_log": "SELECT event_id AS iter, value AS loss FROM events",
    "write_csv_table": f"WITH {EVENTS}, {SCORES} SELECT model, event_id, prediction, p AS probability FROM sc",
    "read_learning_curve": """SELECT event_id // 100 AS run, CAST(event_id % 100 AS INTEGER) AS iter, value AS loss,
  CAST(user_id AS DOUBLE) AS passed_time, CAST(user_id * 2 AS DOUBLE) AS remaining_time FROM events""",
    "model_registry": f"""{_PACKAGES} SELECT model_type, accuracy, feature_count, deployment_timestamp, model_file,
  CAST(row_number() OVER (PARTITION BY model_type ORDER BY c_mktsegment) - 1 AS INTEGER) AS position, c_mktsegment AS feature
FROM newest JOIN s ON s.n_nationkey = newest.n_nationkey""",
    "model_registry_changes": f"""{_PACKAGES}, af AS (
  SELECT DISTINCT model_type, c_mktsegment AS feature FROM newest JOIN s ON s.n_nationkey = newest.n_nationkey),
bf AS (
  SELECT DISTINCT p.model_type, c_mktsegment AS feature FROM p JOIN s ON s.n_nationkey = p.n_nationkey
  WHERE p.n_nationkey NOT IN (SELECT n_nationkey FROM newest))
SELECT coalesce(af.model_type, bf.model_type) AS model_type, coalesce(af.feature, bf.feature) AS feature,
  CASE WHEN bf.feature IS NULL THEN 'added' WHEN af.feature IS NULL THEN 'removed' ELSE 'kept' END AS status
FROM bf FULL OUTER JOIN af ON af.model_type = bf.model_type AND af.feature = bf.feature""",
    "register_model": f"""WITH {EVENTS}, {SCORES} SELECT model AS model_type,
  format('{{:.4f}}', avg(CASE WHEN y = prediction THEN 1.0e0 ELSE 0.0e0 END)) AS accuracy, 1 AS feature_count,
  '2024-02-01 00:00:00' AS deployment_timestamp, model || '.bin' AS model_file, 'p_' || model AS features FROM sc GROUP BY model""",
    "versioned_run_dir": """SELECT o_orderkey, o_totalprice, strftime(date_trunc('year', o_orderdate), '%Y%m%d') || '_000000' AS run_id
FROM orders""",
    "union_runs": """WITH u AS (
  SELECT o_orderkey, o_totalprice, o_orderstatus, 'a' AS run FROM orders WHERE year(o_orderdate) < 1999
  UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus, 'b' FROM orders WHERE year(o_orderdate) >= 1997
  UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus, 'c' FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, min(run) AS run, min(o_totalprice) AS o_totalprice, min(o_orderstatus) AS o_orderstatus, count(*) AS n_rows
FROM u GROUP BY o_orderkey""",
}
