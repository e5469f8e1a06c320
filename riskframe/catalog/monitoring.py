"""Scoring, explanation and drift queries. The SQL-checked ones use a scorer with fixed weights."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskframe.catalog.base import EVENTS, events, rounded_columns, table
from riskframe.functions import percent_text
from riskframe.operators import attribution as A
from riskframe.operators import drift as D
from riskframe.operators import learners
from riskframe.operators import scoring
from riskframe.operators.ordering import number_rows
from riskframe.operators.scorers import LinearScorer
from riskframe.session import scratch_path
from riskframe.sources import read_csv_table, write_csv_table
from riskframe.streaming.scoring import json_records
from riskframe.streaming.scoring import stream_score as start_stream

WEIGHTS = {"value": 0.01, "user_id": -0.002, "k": 0.005, "hour": 0.03}
BIAS = -0.7
NAMES = list(WEIGHTS)
YES, NO = "Converts", "Does not convert"
RECORDS = "event_id bigint, value double, user_id bigint, k int, hour int, event_type string"


def fixed_scorer() -> PipelineModel:
    return PipelineModel(stages=[LinearScorer(NAMES, list(WEIGHTS.values()), BIAS, "logistic")])


def _events(spark, sf):
    return events(spark, sf).select("event_id", *NAMES, "event_type", "y")


def batch_score(spark, sf):
    scored = scoring.batch_score(_events(spark, sf), fixed_scorer(), NAMES, ["event_id"], YES, NO)
    return rounded_columns(scored, "probability")


def _with_truth(spark, sf):
    """Truth comes as text and is encoded on the way, as at training time."""
    mapping = {"purchase": 1, "signup": 1, "view": 0, "click": 0}
    return scoring.score_with_truth(
        _events(spark, sf).drop("y"), fixed_scorer(), NAMES, "event_type", ["event_id"], YES, NO, mapping
    )


def score_with_truth(spark, sf):
    return rounded_columns(_with_truth(spark, sf), "probability")


def score_metrics(spark, sf):
    found = scoring.truth_metrics(rounded_columns(_with_truth(spark, sf), "probability", digits=9))
    return rounded_columns(found, "accuracy", "precision", "recall", "f1", "roc_auc")


def prediction_distribution(spark, sf):
    scored = scoring.batch_score(_events(spark, sf), fixed_scorer(), NAMES, [], YES, NO)
    return scoring.prediction_distribution(scored)


def stream_score(spark, sf):
    arrived, done, offsets = (scratch_path(spark, n) for n in ("records", "scored", "offsets"))
    _events(spark, sf).drop("y").write.json(arrived)
    query = start_stream(
        json_records(spark, arrived, RECORDS), fixed_scorer(), NAMES, done, offsets, ["event_id"], YES, NO
    )
    query.awaitTermination()
    return rounded_columns(spark.read.parquet(done), "probability")


def batch_upload_score(spark, sf):
    upload = scratch_path(spark, "upload")
    write_csv_table(_events(spark, sf).drop("y", "event_type"), upload)
    schema = "event_id bigint, value double, user_id bigint, k int, hour int"
    scored = scoring.batch_score(read_csv_table(spark, upload, schema), fixed_scorer(), NAMES, ["event_id"], YES, NO)
    return number_rows(scored, "event_id").select(
        "number", "prediction_label", percent_text(F.col("probability")).alias("probability_text")
    )


def linear_attribution(spark, sf):
    df = _events(spark, sf)
    return rounded_columns(A.linear_attribution(df, "event_id", WEIGHTS, A.feature_means(df, NAMES)), "contribution", digits=9)


def attribution_bars(spark, sf):
    df = _events(spark, sf)
    bars = A.attribution_bars(df, "event_id", WEIGHTS, A.feature_means(df, NAMES))
    return rounded_columns(rounded_columns(bars, "contribution", digits=9), "width")


def attribution_waterfall(spark, sf):
    df = _events(spark, sf)
    steps = A.attribution_waterfall(df, "event_id", WEIGHTS, A.feature_means(df, NAMES), BIAS)
    return rounded_columns(steps, "contribution", "from_value", "to_value", digits=9)


def attribution_summary(spark, sf):
    df = _events(spark, sf)
    found = A.attribution_summary(df, WEIGHTS, A.feature_means(df, NAMES))
    return rounded_columns(found, "mean_abs", "min_value", "max_value", "p25", "p50", "p75", digits=9)


def _boosted(spark, sf):
    df = _events(spark, sf)
    model = learners.fit_boosted_trees(df, NAMES, "y", profile="leafy", rounds=6, depth=4)
    return df, model, A.forest_of(model)


def tree_attribution(spark, sf):
    """Contributions of every feature to every row's boosted score: they add up to the score less its mean."""
    df, model, forest = _boosted(spark, sf)
    parts = A.tree_contributions(df, "event_id", forest)
    total = F.aggregate("pairs", F.lit(0.0), lambda acc, p: acc + p["contribution"])
    scored = learners.score(model, df, ["event_id"]).select("event_id", F.log(F.col("probability") / (1 - F.col("probability"))).alias("raw"))
    both = parts.select("event_id", F.size("pairs").alias("n_features"), total.alias("total")).join(scored, "event_id")
    return both.select("event_id", "n_features", (F.abs(F.col("total") + forest.base_value() - F.col("raw")) < 1e-9).alias("adds_up"))


def tree_attribution_waterfall(spark, sf):
    """Steps of the tree contributions, from the base value on, largest first."""
    df, _, forest = _boosted(spark, sf)
    steps = A.contribution_waterfall(A.tree_contributions(df, "event_id", forest), "event_id", forest.base_value())
    return steps.select("event_id", "step", (F.abs(F.col("to_value") - F.col("from_value") - F.col("contribution")) < 1e-9).alias("steps_add_up"))


def permutation_importance(spark, sf):
    found = A.permutation_importance(_events(spark, sf), fixed_scorer(), NAMES, "y", "event_id")
    return rounded_columns(found, "baseline", "shuffled", "importance")


def _versions(spark, sf):
    orders = table(spark, sf, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return orders.where(early), orders.where(~early)


def drift_report(spark, sf):
    base, current = _versions(spark, sf)
    report = D.drift_report(base, current, ["o_totalprice", "o_custkey"], ["o_orderpriority", "o_orderstatus"], 0.01)
    return rounded_columns(report, "statistic")


def drift_flag(spark, sf):
    base, current = _versions(spark, sf)
    return D.drift_flag(D.drift_report(base, current, ["o_totalprice"], ["o_orderpriority"]))


def category_drift(spark, sf):
    base, current = _versions(spark, sf)
    found = D.category_drift(base, current, ["o_orderpriority", "o_orderstatus"])
    return rounded_columns(found, "base_share", "current_share", "change")


def population_stability(spark, sf):
    base, current = _versions(spark, sf)
    return rounded_columns(D.population_stability(base, current, ["o_orderpriority", "o_orderstatus"]), "statistic")


def training_progress(spark, sf):
    df = table(spark, sf, "events")
    loss = df.select("event_type", F.col("event_id").alias("iter"), F.col("value").alias("loss"))
    time = df.select(
        "event_type",
        F.col("event_id").alias("iter"),
        F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")).alias("passed"),
        (F.col("user_id") * 10).alias("remaining"),
    )
    return rounded_columns(D.training_progress(loss, time, ["event_type"]), "loss_drop")


QUERIES = {
    f.__name__: f
    for f in (
        batch_score,
        score_with_truth,
        score_metrics,
        prediction_distribution,
        stream_score,
        batch_upload_score,
        linear_attribution,
        tree_attribution,
        tree_attribution_waterfall,
        attribution_bars,
        attribution_waterfall,
        attribution_summary,
        permutation_importance,
        drift_report,
        drift_flag,
        category_drift,
        population_stability,
        training_progress,
    )
}

_RAW = "-0.7e0 + value * 0.01e0 + user_id * -0.002e0 + k * 0.005e0 + hour * 0.03e0"
_SCORED = f"""WITH {EVENTS}, raw_ AS (SELECT *, {_RAW} AS raw FROM ev),
s AS (SELECT *, CASE WHEN raw > 0 THEN 1 ELSE 0 END AS prediction, 1.0e0 / (1.0e0 + exp(-raw)) AS probability,
        CASE WHEN raw > 0 THEN '{YES}' ELSE '{NO}' END AS prediction_label,
        CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type IN ('view', 'click') THEN 0 END AS INTEGER) AS actual
      FROM raw_)"""
_SCORES_ONLY = f"{_SCORED} SELECT event_id, prediction, prediction_label, round(probability, 6) AS probability FROM s"

_PARTS = f"""WITH {EVENTS}, m AS (SELECT avg(value) AS mv, avg(user_id) AS mu, avg(k) AS mk, avg(hour) AS mh FROM ev),
a AS (
  SELECT event_id, 'value' AS feature, 0.01e0 * (value - mv) AS contribution FROM ev, m
  UNION ALL SELECT event_id, 'user_id', -0.002e0 * (user_id - mu) FROM ev, m
  UNION ALL SELECT event_id, 'k', 0.005e0 * (k - mk) FROM ev, m
  UNION ALL SELECT event_id, 'hour', 0.03e0 * (hour - mh) FROM ev, m),
base AS (SELECT -0.7e0 + 0.01e0 * mv - 0.002e0 * mu + 0.005e0 * mk + 0.03e0 * mh AS b FROM m)"""

_SIDES = """WITH o AS (SELECT *, o_orderdate < TIMESTAMP '1998-01-01' AS early FROM orders),
n AS (SELECT count(*) FILTER (WHERE early) AS na, count(*) FILTER (WHERE NOT early) AS nb FROM o)"""


def _ks(column: str) -> str:
    return f"""SELECT '{column}' AS "column", max(abs(ca / na - cb / nb)) AS statistic, 'numeric' AS kind FROM (
  SELECT sum(1.0e0 * a) OVER (ORDER BY v) AS ca, sum(1.0e0 * b) OVER (ORDER BY v) AS cb, na, nb FROM (
    SELECT {column} AS v, count(*) FILTER (WHERE early) AS a, count(*) FILTER (WHERE NOT early) AS b FROM o GROUP BY 1), n)"""


def _levels(column: str) -> str:
    return f"""SELECT '{column}' AS "column", {column} AS level,
  count(*) FILTER (WHERE early) * 1.0e0 / max(na) AS base_share, count(*) FILTER (WHERE NOT early) * 1.0e0 / max(nb) AS current_share
  FROM o, n GROUP BY {column}"""


_LEVELS = f"lv AS ({_levels('o_orderpriority')} UNION ALL {_levels('o_orderstatus')})"
_REPORT = f"""{_SIDES}, {_LEVELS}, r AS ({_ks('o_totalprice')} UNION ALL {_ks('o_custkey')}
  UNION ALL SELECT "column", sum(abs(current_share - base_share)) / 2.0e0, 'category' FROM lv GROUP BY "column")"""


def _variant(name: str) -> str:
    cells = " + ".join(f"{'n_' + f if f == name else f} * {w}e0" for f, w in WEIGHTS.items())
    return f"SELECT '{name}' AS v, y, CASE WHEN {BIAS}e0 + {cells} > 0 THEN 1 ELSE 0 END AS p FROM sh"


_NEXT = ", ".join(f"coalesce(lead({f}) OVER g, first({f}) OVER g) AS n_{f}" for f in NAMES)

ORACLES = {
    "batch_score": _SCORES_ONLY,
    "score_with_truth": f"""{_SCORED} SELECT event_id, prediction, prediction_label, round(probability, 6) AS probability, actual,
  CASE actual WHEN 1 THEN '{YES}' WHEN 0 THEN '{NO}' END AS actual_label FROM s""",
    "score_metrics": f"""{_SCORED}, k AS (SELECT actual AS y, prediction, round(probability, 9) AS p FROM s WHERE actual IS NOT NULL),
pc AS (
  SELECT c, count(*) FILTER (WHERE y = c) AS support, count(*) FILTER (WHERE prediction = c) AS predicted,
         count(*) FILTER (WHERE y = c AND prediction = c) AS tp FROM k, (VALUES (0), (1)) t(c) GROUP BY c),
w AS (
  SELECT sum(support) AS n, 1.0e0 * sum(tp) / sum(support) AS accuracy,
         sum(support * coalesce(1.0e0 * tp / nullif(predicted, 0), 0)) / sum(support) AS precision,
         sum(support * coalesce(1.0e0 * tp / nullif(support, 0), 0)) / sum(support) AS recall,
         sum(support * coalesce(2.0e0 * tp / nullif(predicted + support, 0), 0)) / sum(support) AS f1 FROM pc),
g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM k GROUP BY p),
b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
u AS (SELECT sum(1.0e0 * pos * (below + 0.5e0 * neg)) / (1.0e0 * sum(pos) * sum(neg)) AS auc FROM b)
SELECT CAST(n AS BIGINT) AS n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, round(auc, 6) AS roc_auc FROM w, u""",
    "prediction_distribution": f"""{_SCORED} SELECT prediction, count(*) AS n, 1.0e0 * count(*) / sum(count(*)) OVER () AS share
FROM s GROUP BY prediction""",
    "stream_score": _SCORES_ONLY,
    "batch_upload_score": f"""{_SCORED} SELECT row_number() OVER (ORDER BY event_id) AS number, prediction_label,
  format('{{:.2f}}%', probability * 100) AS probability_text FROM s""",
    "tree_attribution": "SELECT event_id, CAST(4 AS INTEGER) AS n_features, true AS adds_up FROM events",
    "tree_attribution_waterfall": "SELECT event_id, CAST(s AS INTEGER) AS step, true AS steps_add_up FROM events, range(1, 5) t(s)",
    "linear_attribution": f"{_PARTS} SELECT event_id, feature, round(contribution, 9) AS contribution FROM a",
    "attribution_bars": f"""{_PARTS} SELECT event_id, feature, round(contribution, 9) AS contribution,
  round(coalesce(100.0e0 * abs(contribution) / nullif(max(abs(contribution)) OVER (PARTITION BY event_id), 0), 0), 6) AS width,
  CASE WHEN contribution > 0 THEN 'positive-value' ELSE 'negative-value' END AS sign_class FROM a""",
    "attribution_waterfall": f"""{_PARTS}, w AS (
  SELECT event_id, feature, contribution, row_number() OVER o AS step, b + sum(contribution) OVER o AS upto
  FROM a, base WINDOW o AS (PARTITION BY event_id ORDER BY abs(contribution) DESC, feature
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, CAST(step AS INTEGER) AS step, feature, round(contribution, 9) AS contribution,
  round(upto - contribution, 9) AS from_value, round(upto, 9) AS to_value FROM w""",
    "attribution_summary": f"""{_PARTS}, r AS (
  SELECT feature, contribution, row_number() OVER (PARTITION BY feature ORDER BY contribution) AS pos,
         count(*) OVER (PARTITION BY feature) AS n FROM a)
SELECT feature, round(avg(abs(contribution)), 9) AS mean_abs, round(min(contribution), 9) AS min_value,
  round(max(contribution), 9) AS max_value, """
    + ", ".join(f"round(max(contribution) FILTER (WHERE pos = ceil(n * {q}e0)), 9) AS {n}" for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
    + " FROM r GROUP BY feature",
    "permutation_importance": f"""WITH {EVENTS}, gr AS (
  SELECT *, md5('42:' || event_id) AS h,
         floor(('0x' || substring(md5('42:group:' || event_id), 1, 8))::BIGINT / 4294967296.0e0
               * ceil((SELECT count(*) FROM ev) / 50000.0e0)) AS grp FROM ev),
sh AS (SELECT *, {_NEXT} FROM gr WINDOW g AS (PARTITION BY grp ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
al AS ({' UNION ALL '.join(_variant(f) for f in ['', *NAMES])}),
ac AS (SELECT v, avg(CASE WHEN p = y THEN 1.0e0 ELSE 0.0e0 END) AS acc FROM al GROUP BY v)
SELECT x.v AS feature, round(o.acc, 6) AS baseline, round(x.acc, 6) AS shuffled, round(o.acc - x.acc, 6) AS importance
FROM ac x, ac o WHERE x.v <> '' AND o.v = ''""",
    "drift_report": f"""{_REPORT} SELECT "column", kind, round(statistic, 6) AS statistic, statistic > 0.01 AS drifted FROM r""",
    "drift_flag": f"""{_REPORT} SELECT coalesce(bool_or(statistic > 0.1), false) AS drift_detected FROM r
WHERE "column" IN ('o_totalprice', 'o_orderpriority')""",
    "category_drift": f"""{_SIDES}, {_LEVELS} SELECT "column", level, round(base_share, 6) AS base_share,
  round(current_share, 6) AS current_share, round(current_share - base_share, 6) AS change FROM lv""",
    "population_stability": f"""{_SIDES}, {_LEVELS}, f AS (
  SELECT "column", greatest(base_share, 1e-6) AS a, greatest(current_share, 1e-6) AS b FROM lv)
SELECT "column", round(sum((b - a) * ln(b / a)), 6) AS statistic FROM f GROUP BY "column" """,
    "training_progress": """WITH t AS (
  SELECT event_type, event_id AS iter, value AS loss, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 1704067200 AS passed,
         user_id * 10 AS remaining FROM events)
SELECT event_type, iter, loss, passed, remaining, passed - coalesce(lag(passed) OVER w, 0) AS step_time,
  round(lag(loss) OVER w - loss, 6) AS loss_drop FROM t WINDOW w AS (PARTITION BY event_type ORDER BY iter)""",
}
