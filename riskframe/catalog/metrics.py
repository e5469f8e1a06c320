"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog.base import EVENTS, MODELS, SCORES, binary_sql, events, fold_sql, long_scores, rounded_columns, table
from riskframe.operators import curves, metrics
from riskframe.operators.sampling import stratified_kfold

THRESHOLD_METRICS = ("accuracy", "precision", "recall", "f1")


def _scores(spark, sf):
    return long_scores(events(spark, sf))


def _digits(spark, sf):
    """Multi-class truth and a fixed guess from the first vector element."""
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("label").alias("y"),
        F.pmod(F.floor(F.abs(F.element_at("embedding", 1).cast("double")) * 1000), F.lit(10)).cast("int").alias("prediction"),
    )


def _folded(spark, sf):
    folded = stratified_kfold(events(spark, sf), "event_id", "y", 5)
    return long_scores(folded, ("event_id", "y", "fold"))


def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_scores(spark, sf), [0, 1, 2], by=["model"])


def confusion_wide(spark, sf):
    return metrics.confusion_wide(metrics.confusion_matrix(_scores(spark, sf), [0, 1], by=["model"]), [0, 1], ["model"])


def accuracy(spark, sf):
    return metrics.accuracy(_scores(spark, sf), by=["model"])


def precision_recall_f1(spark, sf):
    return rounded_columns(metrics.precision_recall_f1(_scores(spark, sf), by=["model"]), *THRESHOLD_METRICS)


def weighted_prf(spark, sf):
    return rounded_columns(metrics.weighted_prf(_digits(spark, sf)), "precision", "recall", "f1")


def macro_prf(spark, sf):
    return rounded_columns(metrics.macro_prf(_digits(spark, sf)), "precision", "recall", "f1")


def classification_report(spark, sf):
    return rounded_columns(metrics.classification_report(_scores(spark, sf), by=["model"]), "precision", "recall", "f1")


def report_wide(spark, sf):
    report = metrics.classification_report(_scores(spark, sf), by=["model"])
    wide = metrics.report_wide(report, ["1", "0"], ["model"])
    return rounded_columns(wide, *[c for c in wide.columns if c != "model"])


def roc_curve(spark, sf):
    return rounded_columns(curves.roc_curve(_scores(spark, sf), by=["model"]), "fpr", "tpr")


def roc_auc(spark, sf):
    return rounded_columns(curves.roc_auc(_scores(spark, sf), by=["model"]), "roc_auc")


def auc_trapezoid(spark, sf):
    curve = curves.roc_curve(_scores(spark, sf), by=["model"])
    return rounded_columns(curves.auc_trapezoid(curve, by=["model"]), "auc")


def log_loss(spark, sf):
    return rounded_columns(metrics.log_loss(_scores(spark, sf), by=["model"]), "log_loss")


def fold_metrics(spark, sf):
    return rounded_columns(metrics.fold_metrics(_folded(spark, sf), ["model"]), *THRESHOLD_METRICS)


def cv_summary(spark, sf):
    per_fold = metrics.fold_metrics(_folded(spark, sf), ["model"])
    return rounded_columns(metrics.cv_summary(per_fold, THRESHOLD_METRICS, ["model"]), "mean", "std")


def mean_pm_std(spark, sf):
    per_fold = metrics.fold_metrics(_folded(spark, sf), ["model"])
    summary = metrics.cv_summary(per_fold, THRESHOLD_METRICS, ["model"])
    return metrics.mean_pm_std(summary).select("model", "metric", "text")


QUERIES = {
    f.__name__: f
    for f in (
        confusion_matrix,
        confusion_wide,
        accuracy,
        precision_recall_f1,
        weighted_prf,
        macro_prf,
        classification_report,
        report_wide,
        roc_curve,
        roc_auc,
        auc_trapezoid,
        log_loss,
        fold_metrics,
        cv_summary,
        mean_pm_std,
    )
}

_WITH = f"WITH {EVENTS}, {SCORES}"
_DIGITS = """WITH d AS (
  SELECT label AS y, CAST(CAST(floor(abs(CAST(embedding[1] AS DOUBLE)) * 1000) AS BIGINT) % 10 AS INTEGER) AS prediction
  FROM embeddings)"""


def _per_class(source: str, by: str = "") -> str:
    """Per-class precision, recall, F1 and support as CTE ``pc``."""
    g = f"{by}, " if by else ""
    return f"""labels_ AS (SELECT DISTINCT {g}y AS label FROM {source} UNION SELECT DISTINCT {g}prediction FROM {source}),
cnt AS (
  SELECT {', '.join(f'l.{c}' for c in [*([by] if by else []), 'label'])},
         sum(CASE WHEN s.y = l.label AND s.prediction = l.label THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN s.y = l.label THEN 1 ELSE 0 END) AS support,
         sum(CASE WHEN s.prediction = l.label THEN 1 ELSE 0 END) AS predicted
  FROM labels_ l JOIN {source} s ON {f's.{by} = l.{by}' if by else 'true'}
  GROUP BY ALL),
pc AS (
  SELECT {g}label, coalesce(1.0e0 * tp / nullif(predicted, 0), 0) AS precision,
         coalesce(1.0e0 * tp / nullif(support, 0), 0) AS recall,
         coalesce(2.0e0 * tp / nullif(predicted + support, 0), 0) AS f1, CAST(support AS BIGINT) AS support, tp
  FROM cnt)"""


_REPORT = f"""{_WITH}, {_per_class('sc', 'model')},
report AS (
  SELECT model, CAST(label AS VARCHAR) AS class, precision, recall, f1, support FROM pc
  UNION ALL
  SELECT model, 'accuracy', 1.0e0 * sum(tp) / sum(support), 1.0e0 * sum(tp) / sum(support),
         1.0e0 * sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM pc GROUP BY model
  UNION ALL
  SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM pc GROUP BY model
  UNION ALL
  SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pc GROUP BY model)"""

_CURVE = f"""{_WITH},
g AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY model, p),
tot AS (SELECT model, sum(pos) AS all_pos, sum(neg) AS all_neg FROM g GROUP BY model),
curve AS (
  SELECT g.model, p AS threshold,
         1.0e0 * sum(neg) OVER (PARTITION BY g.model ORDER BY p DESC) / all_neg AS fpr,
         1.0e0 * sum(pos) OVER (PARTITION BY g.model ORDER BY p DESC) / all_pos AS tpr
  FROM g JOIN tot ON tot.model = g.model
  UNION ALL SELECT model, CAST(NULL AS DOUBLE), 0.0e0, 0.0e0 FROM tot)"""

_FOLDED = f"WITH {EVENTS}, {fold_sql('ev', 'event_id', 'y', 5)}, sc AS (" + " UNION ALL ".join(
    f"SELECT fold, y, '{m}' AS model, CAST(p_{m} > 0.5e0 AS INTEGER) AS prediction FROM folded" for m in MODELS
) + f"), fm AS ({binary_sql('model, fold', 'sc')})"

_LONG = "lf AS (" + " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, {m} AS v FROM fm" for m in THRESHOLD_METRICS
) + "), cv AS (SELECT model, metric, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS k FROM lf GROUP BY model, metric)"


def _round(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


ORACLES = {
    "confusion_matrix": f"""{_WITH}, grid AS (
  SELECT model, a.v AS actual, b.v AS predicted FROM (SELECT DISTINCT model FROM sc), (VALUES (0), (1), (2)) a(v), (VALUES (0), (1), (2)) b(v))
SELECT grid.model, actual, predicted, count(sc.y) AS n FROM grid
LEFT JOIN sc ON sc.model = grid.model AND sc.y = actual AND sc.prediction = predicted GROUP BY ALL""",
    "confusion_wide": f"""{_WITH} SELECT model, y AS actual, count(*) FILTER (WHERE prediction = 0) AS "0",
  count(*) FILTER (WHERE prediction = 1) AS "1" FROM sc GROUP BY model, y""",
    "accuracy": f"""{_WITH} SELECT model, count(*) AS n, avg(CASE WHEN y = prediction THEN 1.0e0 ELSE 0.0e0 END) AS accuracy
FROM sc GROUP BY model""",
    "precision_recall_f1": f"{_WITH}, b AS ({binary_sql('model', 'sc')}) SELECT model, n, {_round(THRESHOLD_METRICS)} FROM b",
    "weighted_prf": f"""{_DIGITS}, {_per_class('d')} SELECT round(sum(precision * support) / sum(support), 6) AS precision,
  round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1,
  CAST(sum(support) AS BIGINT) AS support FROM pc""",
    "macro_prf": f"""{_DIGITS}, {_per_class('d')} SELECT round(avg(precision), 6) AS precision,
  round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM pc""",
    "classification_report": f"{_REPORT} SELECT model, class, {_round(('precision', 'recall', 'f1'))}, support FROM report",
    "report_wide": f"{_REPORT} SELECT model, round(max(precision) FILTER (WHERE class = 'accuracy'), 6) AS accuracy, "
    + ", ".join(
        f"round(max({m}) FILTER (WHERE class = '{c}'), 6) AS \"{m}_{c.replace(' ', '_')}\""
        for c in ("1", "0", "macro avg", "weighted avg")
        for m in ("precision", "recall", "f1")
    )
    + " FROM report GROUP BY model",
    "roc_curve": f"{_CURVE} SELECT model, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM curve",
    "roc_auc": f"""{_WITH}, g AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY model, p),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT model, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  round(sum(1.0e0 * pos * (below + 0.5e0 * neg)) / (1.0e0 * sum(pos) * sum(neg)), 6) AS roc_auc FROM b GROUP BY model""",
    "auc_trapezoid": f"""{_CURVE}, steps AS (
  SELECT model, fpr, tpr, lag(fpr) OVER w AS f0, lag(tpr) OVER w AS t0 FROM curve
  WINDOW w AS (PARTITION BY model ORDER BY fpr + tpr))
SELECT model, round(sum((fpr - f0) * (tpr + t0) / 2.0e0), 6) AS auc, count(*) AS n_points FROM steps GROUP BY model""",
    "log_loss": f"""{_WITH}, c AS (SELECT model, y, greatest(1e-15, least(1 - 1e-15, p)) AS p FROM sc)
SELECT model, round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) AS log_loss FROM c GROUP BY model""",
    "fold_metrics": f"{_FOLDED} SELECT model, fold, n, {_round(THRESHOLD_METRICS)} FROM fm",
    "cv_summary": f"{_FOLDED}, {_LONG} SELECT model, metric, round(mean, 6) AS mean, round(std, 6) AS std, k FROM cv",
    "mean_pm_std": f"{_FOLDED}, {_LONG} SELECT model, metric, format('{{:.4f}} ± {{:.4f}}', mean, std) AS text FROM cv",
}
