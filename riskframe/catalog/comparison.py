"""Model comparison queries. The compared models are one fixed rule per nation or score, measured on all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog.base import EVENTS, MODELS, SCORES, binary_sql, events, fold_sql, long_scores, rounded_columns, table
from riskframe.operators import comparison, curves, metrics
from riskframe.operators.sampling import stratified_kfold

NAMES = ("accuracy", "precision", "recall", "f1", "roc_auc")


def _by_nation(spark, sf):
    """One model per nation: orders of its customers, truth by status, guess by price."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    scored = (
        table(spark, sf, "orders")
        .join(customers, "o_custkey")
        .select(
            "c_nationkey",
            (F.col("o_orderstatus") == "F").cast("int").alias("y"),
            (F.col("o_totalprice") > 250000).cast("int").alias("prediction"),
            (F.floor(F.col("o_totalprice") / 100) / 10000).alias("p"),
        )
    )
    basic = metrics.precision_recall_f1(scored, by=["c_nationkey"])
    loss = metrics.log_loss(scored.withColumn("p", F.col("p") / 2), by=["c_nationkey"])
    both = basic.join(loss, "c_nationkey").join(nations, "c_nationkey").withColumnRenamed("n_name", "model")
    return rounded_columns(both.drop("c_nationkey"), "accuracy", "precision", "recall", "f1", "log_loss")


def _panel(spark, sf):
    scored = long_scores(events(spark, sf))
    area = curves.roc_auc(scored, by=["model"]).select("model", "roc_auc")
    table_ = metrics.precision_recall_f1(scored, by=["model"]).join(area, "model")
    return rounded_columns(table_, *NAMES)


def model_comparison(spark, sf):
    # a rule without probabilities has no area
    with_gap = _panel(spark, sf).withColumn("roc_auc", F.when(F.col("model") != "event", F.col("roc_auc")))
    return comparison.model_comparison(metrics.to_long(with_gap, NAMES, ["model"]), NAMES)


def best_model(spark, sf):
    return comparison.best_model(_by_nation(spark, sf))


def rank_by_metric(spark, sf):
    table_ = _by_nation(spark, sf).select("model", "accuracy", "log_loss")
    ranked = comparison.rank_by_metric(table_, "accuracy", output="accuracy_rank")
    return comparison.rank_by_metric(ranked, "log_loss", descending=False, output="loss_rank")


def top_n_models(spark, sf):
    return comparison.top_n_models(_by_nation(spark, sf).select("model", "n", "f1"), "f1", 5)


def test_vs_cv(spark, sf):
    df = events(spark, sf)
    test = rounded_columns(metrics.precision_recall_f1(long_scores(df), by=["model"]), "accuracy", "f1").select(
        "model", "accuracy", "f1"
    )
    folds = metrics.fold_metrics(
        long_scores(stratified_kfold(df, "event_id", "y", 5), ("event_id", "y", "fold")), ["model"]
    )
    cv = folds.groupBy("model").agg(F.avg("accuracy").alias("accuracy"), F.avg("f1").alias("f1"))
    return comparison.test_vs_cv(test, rounded_columns(cv, "accuracy", "f1"))


def name_slug(spark, sf):
    return comparison.with_slug(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name")


def metric_title(spark, sf):
    return comparison.with_title(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type")


def feature_list_text(spark, sf):
    lines = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()
    placed = lines.select(
        F.col("o_orderstatus").alias("model"),
        F.expr("-int(substring(o_orderpriority, 1, 1))").alias("position"),
        F.col("o_orderpriority").alias("feature"),
    )
    return comparison.feature_list_text(placed, "position", "feature", ["model"])


def run_stamp(spark, sf):
    return comparison.with_run_stamp(table(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts")


QUERIES = {
    f.__name__: f
    for f in (
        model_comparison,
        best_model,
        rank_by_metric,
        top_n_models,
        test_vs_cv,
        name_slug,
        metric_title,
        feature_list_text,
        run_stamp,
    )
}

_NATION = f"""WITH sc AS (
  SELECT n_name AS model, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
         CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS prediction,
         floor(o_totalprice / 100) / 10000 / 2 AS p
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
b AS ({binary_sql('model', 'sc')}),
l AS (SELECT model, round(avg(-ln(CASE WHEN y = 1 THEN greatest(1e-15, least(1 - 1e-15, p))
        ELSE 1 - greatest(1e-15, least(1 - 1e-15, p)) END)), 6) AS log_loss FROM sc GROUP BY model),
m AS (SELECT b.model, n, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, log_loss FROM b JOIN l ON l.model = b.model)"""

_PANEL = f"""WITH {EVENTS}, {SCORES}, b AS ({binary_sql('model', 'sc')}),
g AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY model, p),
w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
a AS (SELECT model, sum(1.0e0 * pos * (below + 0.5e0 * neg)) / (1.0e0 * sum(pos) * sum(neg)) AS roc_auc FROM w GROUP BY model)"""

_CV = f"WITH {EVENTS}, {fold_sql('ev', 'event_id', 'y', 5)}, sc AS (" + " UNION ALL ".join(
    f"SELECT fold, y, '{m}' AS model, CAST(p_{m} > 0.5e0 AS INTEGER) AS prediction FROM folded" for m in MODELS
) + f"), t AS ({binary_sql('model', 'sc')}), fm AS ({binary_sql('model, fold', 'sc')})"

ORACLES = {
    "model_comparison": f"""{_PANEL} SELECT b.model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, CASE WHEN b.model <> 'event' THEN round(roc_auc, 6) END AS roc_auc
FROM b JOIN a ON a.model = b.model""",
    "best_model": f"{_NATION} SELECT model, accuracy FROM m ORDER BY accuracy DESC, model LIMIT 1",
    "rank_by_metric": f"""{_NATION} SELECT model, accuracy, log_loss,
  CAST(rank() OVER (ORDER BY accuracy DESC) AS INTEGER) AS accuracy_rank,
  CAST(rank() OVER (ORDER BY log_loss) AS INTEGER) AS loss_rank FROM m""",
    "top_n_models": f"{_NATION} SELECT model, n, f1 FROM m ORDER BY f1 DESC, model LIMIT 5",
    "test_vs_cv": f"""{_CV} SELECT model, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, 'Test' AS split FROM t
UNION ALL SELECT model, round(avg(accuracy), 6), round(avg(f1), 6), 'CV' FROM fm GROUP BY model""",
    "name_slug": "SELECT p_partkey, p_name, lower(replace(p_name, ' ', '_')) AS slug FROM part",
    "metric_title": """SELECT p_partkey, p_type, upper(substring(p_type, 1, 1)) || lower(substring(p_type, 2)) AS title
FROM part""",
    "feature_list_text": """SELECT o_orderstatus AS model, string_agg(o_orderpriority, ', ' ORDER BY o_orderpriority DESC) AS features,
  count(*) AS feature_count FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders) GROUP BY o_orderstatus""",
    "run_stamp": "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS run_stamp FROM events",
}
