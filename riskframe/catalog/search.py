"""Parameter search queries. A trial log is read off the orders: a study per priority, a trial per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog.base import FEATURES, events, rounded_columns, table
from riskframe.operators import search as R
from riskframe.operators.learners import Learner
from riskframe.plans import tune

SPACE = {
    "n_estimators": R.IntRange(3, 8),
    "max_depth": R.IntRange(2, 5),
    "min_samples_split": R.IntRange(2, 20),
    "min_samples_leaf": R.IntRange(1, 20),
    "max_features": R.Choice(("sqrt", "log2", "all")),
    "bootstrap": R.Choice(("true", "false")),
}


def _trials(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select(
        F.col("o_orderpriority").alias("study"),
        F.col("o_orderkey").alias("trial"),
        (F.col("o_totalprice") / 500000.0).alias("score"),
        F.create_map(
            F.lit("status"), F.col("o_orderstatus"),
            F.lit("customer"), F.col("o_custkey").cast("string"),
            F.lit("year"), F.year("o_orderdate").cast("string"),
        ).alias("params"),
    )


def param_space_sample(spark, sf):
    trials = table(spark, sf, "customer").select(F.col("c_custkey").alias("trial"))
    drawn = R.param_space_sample(trials, "trial", R.LEAFY_SPACE)
    plain = [n for n, r in R.LEAFY_SPACE.items() if isinstance(r, R.FloatRange) and not r.log]
    return rounded_columns(drawn, *plain, digits=7)


def param_space_forest(spark, sf):
    trials = table(spark, sf, "customer").select(F.col("c_custkey").alias("trial"))
    return R.param_space_sample(trials, "trial", R.FOREST_SPACE, 7)


def search_trials(spark, sf):
    settings = table(spark, sf, "region").select(F.col("r_regionkey").alias("trial"))
    trials = R.pack_params(R.param_space_sample(settings, "trial", SPACE), list(SPACE))
    found = tune.search_trials(
        events(spark, sf), trials, tune.forest_learner, FEATURES, "y", "event_id", "forest", k=3, parallelism=8
    )
    return found.select(
        "study", "trial", F.col("params")["n_estimators"].alias("n_estimators"),
        F.col("score").between(0, 1).alias("score_in_range"), (F.size("params") == len(SPACE)).alias("all_settings"),
    )


def _boosted_trials(spark, sf, space, profile):
    """A setting for each row of the table, over the whole space."""
    settings = table(spark, sf, "region").select(F.col("r_regionkey").alias("trial"))
    trials = R.pack_params(R.param_space_sample(settings, "trial", space), list(space))
    build = lambda params: tune.boosted_learner(params, profile)
    found = tune.search_trials(events(spark, sf), trials, build, FEATURES, "y", "event_id", profile, k=3, parallelism=8)
    return found.select(
        "study", "trial", F.col("params")["n_estimators"].alias("n_estimators"),
        F.col("score").between(0, 1).alias("score_in_range"), (F.size("params") == len(space)).alias("all_settings"),
    )


def search_trials_leafy(spark, sf):
    return _boosted_trials(spark, sf, R.LEAFY_SPACE, "leafy")


def search_trials_deep(spark, sf):
    return _boosted_trials(spark, sf, R.DEEP_SPACE, "deep")


def trial_history(spark, sf):
    return R.trial_history(_trials(spark, sf))


def running_best(spark, sf):
    return R.running_best(_trials(spark, sf))


def best_params(spark, sf):
    best = R.best_params(_trials(spark, sf))
    return best.select("study", "trial", "score", *[F.col("params")[p].alias(p) for p in ("status", "customer", "year")])


def param_importance(spark, sf):
    table_ = R.param_importance(_trials(spark, sf), numeric=["customer", "year"], categorical=["status"])
    return rounded_columns(table_, "importance")


def final_cv_check(spark, sf):
    learner = Learner("forest", "random_forest", {"trees": 5, "depth": 4}, "balanced")
    found = tune.final_cv_check(events(spark, sf), learner, FEATURES, "y", "event_id", k=5)
    in_range = F.col("mean").between(0, 1) & F.col("std").between(0, 0.5)
    return found.select("model", "metric", F.col("k").cast("bigint").alias("k"), in_range.alias("in_range"))


def search_studies(spark, sf):
    """The three studies one after the other, and their summary."""
    found = [f(spark, sf) for f in (search_trials, search_trials_leafy, search_trials_deep)]
    scored = found[0].unionByName(found[1]).unionByName(found[2]).withColumn("score", F.col("score_in_range").cast("double"))
    return R.search_summary(scored).select("study", "n_trials", (F.col("best_score") == 1.0).alias("in_range"))


def search_summary(spark, sf):
    return R.search_summary(_trials(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        param_space_sample,
        param_space_forest,
        search_trials,
        search_trials_leafy,
        search_trials_deep,
        trial_history,
        running_best,
        best_params,
        param_importance,
        final_cv_check,
        search_studies,
        search_summary,
    )
}


def _draw_sql(name: str, rng: object, seed: int) -> str:
    u = f"(('0x' || substring(md5('{seed}:{name}:' || c_custkey), 1, 8))::BIGINT / 4294967296.0e0)"
    if isinstance(rng, R.IntRange):
        value = f"CAST({rng.low} + floor({u} * {rng.high - rng.low + 1}) AS BIGINT)"
    elif isinstance(rng, R.Choice):
        options = ", ".join(f"'{v}'" for v in rng.values)
        value = f"([{options}])[CAST(floor({u} * {len(rng.values)}) AS INTEGER) + 1]"
    elif rng.log:
        value = f"round(exp(ln({rng.low!r}) + {u} * (ln({rng.high!r}) - ln({rng.low!r}))), 8)"
    else:
        value = f"round({rng.low!r} + {u} * ({rng.high!r} - {rng.low!r}), 7)"
    return f"{value} AS {name}"


def _space_sql(space: dict, seed: int) -> str:
    return "SELECT c_custkey AS trial, " + ", ".join(_draw_sql(n, r, seed) for n, r in space.items()) + " FROM customer"


def _study_sql(study: str, trees: R.IntRange) -> str:
    u = "(('0x' || substring(md5('42:n_estimators:' || r_regionkey), 1, 8))::BIGINT / 4294967296.0e0)"
    return f"""SELECT '{study}' AS study, CAST(r_regionkey AS BIGINT) AS trial,
  CAST(CAST({trees.low} + floor({u} * {trees.high - trees.low + 1}) AS BIGINT) AS VARCHAR) AS n_estimators, true AS score_in_range,
  true AS all_settings
FROM region"""


_TRIALS = """WITH tr AS (
  SELECT o_orderpriority AS study, o_orderkey AS trial, o_totalprice / 500000.0e0 AS score, o_orderstatus AS status,
         CAST(o_custkey AS VARCHAR) AS customer, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders)"""


def _numeric_bins(name: str) -> str:
    return f"""SELECT study, '{name}' AS parameter, CAST(floor(5.0e0 * before / size) AS VARCHAR) AS bin, score FROM (
  SELECT study, score, rank() OVER (PARTITION BY study ORDER BY CAST({name} AS DOUBLE)) - 1 AS before,
         count(*) OVER (PARTITION BY study) AS size FROM tr)"""


ORACLES = {
    "search_trials": _study_sql("forest", SPACE["n_estimators"]),
    "final_cv_check": """SELECT 'forest' AS model, metric, CAST(5 AS BIGINT) AS k, true AS in_range
FROM (VALUES ('accuracy'), ('precision'), ('recall'), ('f1'), ('roc_auc')) t(metric)""",
    "search_trials_leafy": _study_sql("leafy", R.LEAFY_SPACE["n_estimators"]),
    "search_trials_deep": _study_sql("deep", R.DEEP_SPACE["n_estimators"]),
    "search_studies": "SELECT study, n_trials, true AS in_range FROM (VALUES ('forest'), ('leafy'), ('deep')) t(study), (SELECT count(*) AS n_trials FROM region)",
    "param_space_sample": _space_sql(R.LEAFY_SPACE, 42),
    "param_space_forest": _space_sql(R.FOREST_SPACE, 7),
    "trial_history": f"{_TRIALS} SELECT study, trial, score AS accuracy FROM tr",
    "running_best": f"""{_TRIALS} SELECT study, trial, score, max(score) OVER (PARTITION BY study ORDER BY trial
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM tr""",
    "best_params": f"""{_TRIALS} SELECT study, trial, score, status, customer, year FROM tr
QUALIFY row_number() OVER (PARTITION BY study ORDER BY score DESC, trial) = 1""",
    "param_importance": f"""{_TRIALS}, cells AS ({_numeric_bins('customer')} UNION ALL {_numeric_bins('year')}
  UNION ALL SELECT study, 'status', status, score FROM tr),
g AS (SELECT study, avg(score) AS mean, sum(pow(score, 2)) - pow(sum(score), 2) / count(*) AS total FROM tr GROUP BY study),
b AS (SELECT study, parameter, bin, count(*) AS n, avg(score) AS m FROM cells GROUP BY study, parameter, bin)
SELECT b.study, parameter, round(sum(n * pow(m - mean, 2)) / max(total), 6) AS importance, count(*) AS n_bins
FROM b JOIN g ON g.study = b.study GROUP BY b.study, parameter""",
    "search_summary": f"{_TRIALS} SELECT study, max(score) AS best_score, count(*) AS n_trials FROM tr GROUP BY study",
}
