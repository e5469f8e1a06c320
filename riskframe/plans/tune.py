"""Parameter search: mean k-fold accuracy of each drawn setting."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.jobs import kept, run_threads
from riskframe.operators.learners import Learner, coded_for, score
from riskframe.operators.metrics import accuracy
from riskframe.operators.sampling import stratified_kfold
from riskframe.plans.evaluate import cross_validate, cv_report

TRIAL_SCHEMA = "study string, trial bigint, params map<string,string>, score double, std double"


def _refuse_unknown(params: Mapping[str, str], known: set[str]) -> None:
    unknown = sorted(set(params) - known)
    if unknown:
        raise ValueError(f"settings without a counterpart: {', '.join(unknown)}")


def forest_learner(params: Mapping[str, str]) -> Learner:
    """Settings drawn from the forest space as a learner."""
    _refuse_unknown(
        params, {"n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "max_features", "bootstrap"}
    )
    subset = params.get("max_features", "sqrt")
    return Learner(
        "random_forest",
        "random_forest",
        {
            "trees": int(params["n_estimators"]),
            "depth": int(params["max_depth"]),
            "min_split": int(params.get("min_samples_split", 2)),
            "min_leaf": int(params.get("min_samples_leaf", 1)),
            "subset": subset,
            "bootstrap": params.get("bootstrap", "true") == "true",
        },
        "balanced",
    )


#: Names of the boosted spaces' settings, and what the learner calls them.
BOOSTED_SETTINGS = {
    "boosting_type": ("boosting", str),
    "booster": ("boosting", str),
    "n_estimators": ("rounds", int),
    "num_leaves": ("leaves", int),
    "max_depth": ("depth", int),
    "learning_rate": ("step", float),
    "subsample": ("rows", float),
    "colsample_bytree": ("subset", float),
    "min_child_samples": ("min_leaf", int),
    "min_child_weight": ("min_weight", float),
    "min_split_gain": ("min_gain", float),
    "gamma": ("min_gain", float),
    "reg_alpha": ("alpha", float),
    "reg_lambda": ("lambda_", float),
}


def boosted_learner(params: Mapping[str, str], profile: str = "leafy") -> Learner:
    """Settings drawn from a boosted space as a learner."""
    _refuse_unknown(params, {*BOOSTED_SETTINGS, "scale_pos_weight"})
    settings = {BOOSTED_SETTINGS[p][0]: BOOSTED_SETTINGS[p][1](v) for p, v in params.items() if p in BOOSTED_SETTINGS}
    weighting = float(params["scale_pos_weight"]) if "scale_pos_weight" in params else "balanced"
    return Learner(f"boosted_{profile}", "boosted_trees", {"profile": profile, **settings}, weighting)


def search_trials(
    df: DataFrame,
    trials: DataFrame,
    build: Callable[[Mapping[str, str]], Learner],
    features: Sequence[str],
    target: str,
    key: str,
    study: str = "study",
    k: int = 5,
    seed: int | str = 42,
    parallelism: int = 2,
) -> DataFrame:
    """(study, trial, params, score, std) for each setting of a trial table (trial, params).

    The driver loops over settings and their folds, each a job of its own; fitting, scoring and counting are Spark jobs on
    all rows. The folded table is kept once for all trials; fold accuracies of a trial come from one aggregate.
    """
    spark = df.sparkSession
    settings = trials.select("trial", "params").orderBy("trial").collect()
    folded = stratified_kfold(df.select(key, target, *features), key, target, k, seed)
    with kept(folded.where("fold IS NOT NULL")) as rows:
        per_fold = {(r[0], r["fold"]): r["count"] for r in rows.groupBy(target, "fold").count().collect()}
        labels = {label for label, _ in per_fold}
        learners = {setting["trial"]: build(setting["params"]) for setting in settings}
        coded = coded_for(list(learners.values()), rows, features, target, "fold", k)

        def fit(setting, i: int):
            totals = {c: sum(n for (label, f), n in per_fold.items() if label == c and f != i) for c in labels}
            return learners[setting["trial"]].fit(rows.where(F.col("fold") != i), features, target, totals, coded, i)

        def one(setting, models) -> tuple:
            parts = [score(model, rows.where(F.col("fold") == i), [target, "fold"]) for i, model in enumerate(models)]
            scored = reduce(lambda a, b: a.unionByName(b), parts)
            values = accuracy(scored, target, "prediction", ["fold"])
            mean, std = values.agg(F.avg("accuracy"), F.stddev_pop("accuracy")).first()
            return study, int(setting["trial"]), dict(setting["params"]), mean, std

        fits = [lambda setting=setting, i=i: fit(setting, i) for setting in settings for i in range(k)]
        models = run_threads(spark, fits, parallelism)
        jobs = [lambda setting=setting, n=n: one(setting, models[n * k : (n + 1) * k]) for n, setting in enumerate(settings)]
        found = run_threads(spark, jobs, parallelism)
    return spark.createDataFrame(found, TRIAL_SCHEMA)


def final_cv_check(
    df: DataFrame,
    learner: Learner,
    features: Sequence[str],
    target: str,
    key: str,
    k: int = 5,
    seed: int | str = 42,
) -> DataFrame:
    """k-fold metrics of the chosen settings once more: (model, metric, mean, std, k)."""
    return cv_report(cross_validate(df, [learner], features, target, key, k, seed), target)
