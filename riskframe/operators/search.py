"""Parameter search: drawing settings, and tables over finished trials."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import hash_uniform
from riskframe.operators.ordering import bucket_name, range_buckets, running

BINS = 5


@dataclass(frozen=True)
class IntRange:
    low: int
    high: int

    def draw(self, u: Column) -> Column:
        return (F.lit(self.low) + F.floor(u * F.lit(float(self.high - self.low + 1)))).cast("bigint")


@dataclass(frozen=True)
class FloatRange:
    low: float
    high: float
    log: bool = False

    def draw(self, u: Column) -> Column:
        if self.log:
            start, width = math.log(self.low), math.log(self.high) - math.log(self.low)
            return F.round(F.exp(F.lit(start) + u * F.lit(width)), 8)
        return F.lit(float(self.low)) + u * F.lit(float(self.high - self.low))


@dataclass(frozen=True)
class Choice:
    values: tuple

    def draw(self, u: Column) -> Column:
        options = F.array(*[F.lit(str(v)) for v in self.values])
        return F.element_at(options, (F.floor(u * F.lit(float(len(self.values)))) + 1).cast("int"))


# The search ranges of the three studies.
LEAFY_SPACE = {
    "boosting_type": Choice(("gbdt", "dart", "goss")),
    "num_leaves": IntRange(20, 150),
    "max_depth": IntRange(3, 20),
    "learning_rate": FloatRange(0.01, 0.3, log=True),
    "n_estimators": IntRange(100, 1000),
    "min_child_samples": IntRange(5, 100),
    "subsample": FloatRange(0.5, 1.0),
    "colsample_bytree": FloatRange(0.5, 1.0),
    "reg_alpha": FloatRange(1e-8, 10.0, log=True),
    "reg_lambda": FloatRange(1e-8, 10.0, log=True),
    "min_split_gain": FloatRange(1e-8, 0.5, log=True),
}
DEEP_SPACE = {
    "booster": Choice(("gbtree", "dart")),
    "max_depth": IntRange(3, 15),
    "learning_rate": FloatRange(0.01, 0.3, log=True),
    "n_estimators": IntRange(100, 1000),
    "min_child_weight": IntRange(1, 10),
    "subsample": FloatRange(0.5, 1.0),
    "colsample_bytree": FloatRange(0.5, 1.0),
    "gamma": FloatRange(1e-8, 1.0, log=True),
    "reg_alpha": FloatRange(1e-8, 1.0, log=True),
    "reg_lambda": FloatRange(1e-8, 1.0, log=True),
    "scale_pos_weight": FloatRange(0.5, 5.0),
}
FOREST_SPACE = {
    "n_estimators": IntRange(100, 1000),
    "max_depth": IntRange(3, 30),
    "min_samples_split": IntRange(2, 20),
    "min_samples_leaf": IntRange(1, 20),
    "max_features": Choice(("sqrt", "log2", "all")),
    "bootstrap": Choice(("true", "false")),
}


def param_space_sample(trials: DataFrame, trial: str, space: Mapping[str, object], seed: int | str = 42) -> DataFrame:
    """One column per parameter, drawn from a hash of seed, parameter and trial number."""
    drawn = [rng.draw(hash_uniform(trial, f"{seed}:{name}")).alias(name) for name, rng in space.items()]
    return trials.select("*", *drawn)


def pack_params(df: DataFrame, names: Sequence[str], output: str = "params") -> DataFrame:
    """Parameter columns as one map<string,string>."""
    pairs = [part for n in names for part in (F.lit(n), F.col(n).cast("string"))]
    return df.withColumn(output, F.create_map(*pairs)).drop(*names)


def trial_history(trials: DataFrame, study: str = "study", score: str = "score") -> DataFrame:
    return trials.select(study, "trial", F.col(score).alias("accuracy"))


def running_best(trials: DataFrame, study: str = "study", score: str = "score") -> DataFrame:
    """Best score so far at each trial of each study."""
    ranges = range_buckets(trials, ["trial"])
    kept = trials.select(study, "trial", score)
    best = running(
        ranges.transform(kept), "trial", bucket_name("trial"), {"best_so_far": ("max", score)}, by=[study]
    )
    return best.select(study, "trial", score, "best_so_far")


def best_params(trials: DataFrame, study: str = "study", score: str = "score") -> DataFrame:
    """Settings of the best trial of each study; the earliest trial wins a tie."""
    scored = trials.where(F.col(score).isNotNull())
    pick = F.max_by(F.struct("trial", "params"), F.struct(F.col(score), -F.col("trial")))
    return scored.groupBy(study).agg(pick.alias("best"), F.max(score).alias(score)).select(
        study, "best.trial", score, "best.params"
    )


def search_summary(trials: DataFrame, study: str = "study", score: str = "score") -> DataFrame:
    return trials.groupBy(study).agg(F.max(score).alias("best_score"), F.count("*").alias("n_trials"))


def param_importance(
    trials: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    study: str = "study",
    score: str = "score",
    bins: int = BINS,
) -> DataFrame:
    """Share of score variance between the bins of each parameter, largest first.

    Numeric parameters are cut into equally filled bins (equal values stay together), categorical ones
    into their levels. Trials are summed per distinct value before anything is ordered.
    """
    sums = [
        F.count("*").alias("n"),
        F.sum(score).alias("s"),
        F.sum(F.col(score) * F.col(score)).alias("ss"),
    ]
    scored = trials.where(F.col(score).isNotNull())
    parts = []
    if numeric:
        typed = scored.select(study, score, *[F.expr(f"try_cast(params['{p}'] AS double)").alias(p) for p in numeric])
        placed = range_buckets(typed, numeric).transform(typed)
        cells = F.array(
            *[
                F.struct(F.lit(p).alias("parameter"), F.col(p).alias("value"), F.col(bucket_name(p)).alias("bucket"))
                for p in numeric
            ]
        )
        rows = (
            placed.select(study, score, F.inline(cells))
            .where("value IS NOT NULL")
            .withColumn("n", F.lit(1).cast("bigint"))
        )
        by_value = rows.groupBy(study, "parameter", "bucket", "value").agg(*sums)
        ordered = running(
            by_value,
            "value",
            "bucket",
            {"before": ("sum", "n")},
            by=[study, "parameter"],
            inclusive=False,
            whole={"size": ("sum", "n")},
            source=rows,
        )
        bin_no = F.floor(F.col("before") * F.lit(bins) / F.col("size")).cast("string")
        parts.append(ordered.select(study, "parameter", bin_no.alias("bin"), "n", "s", "ss"))
    if categorical:
        levels = F.array(
            *[F.struct(F.lit(p).alias("parameter"), F.col("params")[p].alias("bin")) for p in categorical]
        )
        parts.append(
            scored.select(study, score, F.inline(levels))
            .where("bin IS NOT NULL")
            .groupBy(study, "parameter", "bin")
            .agg(*sums)
        )
    table = parts[0]
    for other in parts[1:]:
        table = table.unionByName(other)
    per_bin = table.groupBy(study, "parameter", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    grand = F.sum("s") * F.sum("s") / F.sum("n")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - grand
    total = F.sum("ss") - grand
    return (
        per_bin.groupBy(study, "parameter")
        .agg(F.when(total > 0, between / total).otherwise(F.lit(0.0)).alias("importance"), F.count("*").alias("n_bins"))
        .orderBy(study, F.col("importance").desc(), "parameter")
    )
