"""Fit, score and measure many models: driver threads submit Spark jobs, all data stays distributed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import nullcontext
from dataclasses import dataclass
from functools import reduce

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions import decode_label
from riskframe.jobs import kept, run_threads, written
from riskframe.operators.columns import select_features
from riskframe.operators.ensembles import fit_folds, score_columns, stack_meta_features, vote_hard, vote_soft
from riskframe.operators.learners import Learner, coded_for, score
from riskframe.operators.metrics import cv_summary, to_long
from riskframe.operators.sampling import stratified_kfold
from riskframe.operators.summary import METRICS, all_metrics


ENSEMBLE_FILE = "ensemble.json"
#: Learners whose models give a class only.
NO_PROBABILITY = frozenset(("linear_svm", "kernel_svm", "ridge"))


@dataclass(frozen=True)
class Ensemble:
    """A combination of fitted base models: ``kind`` is soft, hard or stack (with a final learner)."""

    name: str
    kind: str
    final: Learner | None = None


@dataclass(frozen=True)
class FittedEnsemble:
    """Base models and how they are combined. Transforms, saves and loads as any fitted model does."""

    base: Mapping[str, PipelineModel]
    kind: str
    final: PipelineModel | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """The table with ``prediction`` and ``probability``."""
        kept_columns = [c for c in df.columns if c not in ("prediction", "probability")]
        clash = sorted(set(self.base) & set(kept_columns))
        if clash:
            raise ValueError(f"columns named like base models: {', '.join(clash)}")
        return self.score(df, kept_columns)

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        names = list(self.base)
        out = [*keep, "prediction", "probability"]
        if self.kind == "hard":
            return vote_hard(score_columns(df, self.base, "prediction"), names).select(*out)
        scored = score_columns(df, self.base, "probability")
        return vote_soft(scored, names).select(*out) if self.kind == "soft" else score(self.final, scored, keep)

    def save(self, path: str, overwrite: bool = False) -> None:
        """A folder with one saved model for each member and a line that says how to combine them."""
        spark = SparkSession.active()
        for name, model in [*self.base.items(), *([("", self.final)] if self.final else [])]:
            writer = model.write()
            (writer.overwrite() if overwrite else writer).save(f"{path}/{'members/' + name if name else 'final'}")
        line = json.dumps({"kind": self.kind, "members": list(self.base), "final": self.final is not None})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{ENSEMBLE_FILE}")

    @classmethod
    def load(cls, path: str) -> FittedEnsemble:
        line = json.loads(SparkSession.active().read.text(f"{path}/{ENSEMBLE_FILE}").first()[0])
        base = {name: PipelineModel.load(f"{path}/members/{name}") for name in line["members"]}
        return cls(base, line["kind"], PipelineModel.load(f"{path}/final") if line["final"] else None)


def load_any(path: str) -> PipelineModel | FittedEnsemble:
    """A saved single model or ensemble."""
    spark = SparkSession.active()
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{ENSEMBLE_FILE}")
    is_ensemble = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
    return FittedEnsemble.load(path) if is_ensemble else PipelineModel.load(path)


def check_probabilities(learners: Sequence[Learner], ensembles: Sequence[Ensemble]) -> None:
    """Soft votes and stacks average or learn from probabilities: every base learner has to give one."""
    without = sorted(learner.name for learner in learners if learner.kind in NO_PROBABILITY)
    if without and any(e.kind in ("soft", "stack") for e in ensembles):
        raise ValueError(f"no probabilities for a soft vote or stack: {', '.join(without)}")


def fit_base(
    train: DataFrame, learners: Sequence[Learner], features: Sequence[str], target: str, parallelism: int = 2
) -> dict[str, PipelineModel]:
    coded = coded_for(learners, train, features, target)
    jobs = [lambda learner=learner: learner.fit(train, features, target, None, coded) for learner in learners]
    return dict(zip([learner.name for learner in learners], run_threads(train.sparkSession, jobs, parallelism)))


def fit_stack(
    train: DataFrame,
    learners: Sequence[Learner],
    final: Learner,
    features: Sequence[str],
    target: str,
    key: str,
    base: Mapping[str, PipelineModel] | None = None,
    k: int = 5,
    seed: int | str = "stack",
    parallelism: int = 2,
) -> FittedEnsemble:
    """Final learner on out-of-fold probabilities; base models are those fitted on all training rows.

    The folds are made inside the training rows with a seed of their own, apart from evaluation folds.
    """
    check_probabilities(learners, [Ensemble("stack", "stack", final)])
    with kept(train.select(key, target, *features)) as rows:
        with kept(_meta_table(rows, learners, features, target, key, k, seed, parallelism)) as meta:
            fitted = final.fit(meta, [learner.name for learner in learners], target)
        return FittedEnsemble(base or fit_base(rows, learners, features, target, parallelism), "stack", fitted)


def _meta_table(rows, learners, features, target, key, k, seed, parallelism) -> DataFrame:
    folded = stratified_kfold(rows, key, target, k, seed, "__stack_fold")
    return stack_meta_features(folded, learners, features, target, key, k, "__stack_fold", parallelism)


def fit_panel(
    train: DataFrame,
    learners: Sequence[Learner],
    ensembles: Sequence[Ensemble],
    features: Sequence[str],
    target: str,
    key: str,
    k: int = 5,
    parallelism: int = 2,
    hold: bool = True,
    base: Mapping[str, PipelineModel] | None = None,
) -> dict[str, object]:
    """All base models, fitted once, and the ensembles over them. Stacks share one out-of-fold table.

    ``hold=False`` is for training rows the caller already keeps in memory, ``base`` for base models that are fitted already.
    """
    check_probabilities(learners, ensembles)
    narrow = train.select(key, target, *features)
    with kept(narrow) if hold else nullcontext(narrow) as rows:
        base = base or fit_base(rows, learners, features, target, parallelism)
        panel: dict[str, object] = dict(base)
        panel.update({e.name: FittedEnsemble(base, e.kind) for e in ensembles if e.kind != "stack"})
        stacks = [e for e in ensembles if e.kind == "stack"]
        if stacks:
            with kept(_meta_table(rows, learners, features, target, key, k, "stack", parallelism)) as meta:
                for e in stacks:
                    panel[e.name] = FittedEnsemble(base, "stack", e.final.fit(meta, list(base), target))
    return panel


def score_panel(panel: Mapping[str, object], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Long scored table (model, kept columns, prediction, probability) of all models, in one pass.

    Base models are chained once; voting and stacking reuse their columns.
    """
    base = {n: m for n, m in panel.items() if not isinstance(m, FittedEnsemble)}
    wide = df
    for name, model in base.items():
        wide = score(model, wide).withColumnRenamed("probability", f"p_{name}").withColumnRenamed("prediction", f"c_{name}")
    cells = [
        F.struct(F.lit(n).alias("model"), F.col(f"c_{n}").alias("prediction"), F.col(f"p_{n}").alias("probability"))
        for n in base
    ]
    for name, model in panel.items():
        if not isinstance(model, FittedEnsemble):
            continue
        members = list(model.base)
        if model.kind == "stack":
            named = wide
            for m in members:
                named = named.withColumn(m, F.col(f"p_{m}"))
            done = score(model.final, named, wide.columns)
        elif model.kind == "soft":
            done = vote_soft(wide, [f"p_{m}" for m in members])
        else:
            done = vote_hard(wide, [f"c_{m}" for m in members])
        wide = done.withColumnRenamed("prediction", f"c_{name}").withColumnRenamed("probability", f"p_{name}")
        cells.append(
            F.struct(
                F.lit(name).alias("model"), F.col(f"c_{name}").alias("prediction"), F.col(f"p_{name}").alias("probability")
            )
        )
    return wide.select(*keep, F.inline(F.array(*cells)))


def model_panel(
    train: DataFrame,
    test: DataFrame,
    learners: Sequence[Learner],
    ensembles: Sequence[Ensemble],
    features: Sequence[str],
    target: str,
    key: str,
    k: int = 5,
    parallelism: int = 2,
) -> tuple[DataFrame, dict[str, object]]:
    """Hold-out metrics of base models and ensembles in one table, and the fitted models."""
    panel = fit_panel(train, learners, ensembles, features, target, key, k, parallelism)
    scored = written(score_panel(panel, test.where(F.col(target).isNotNull()), [key, target]), "scored")
    return all_metrics(scored, ["model"], target), panel


def cross_validate(
    df: DataFrame,
    learners: Sequence[Learner],
    features: Sequence[str],
    target: str,
    key: str,
    k: int = 5,
    seed: int | str = 42,
    ensembles: Sequence[Ensemble] = (),
    parallelism: int = 2,
    fold: str = "fold",
) -> DataFrame:
    """Out-of-fold scores (model, key, target, fold, prediction, probability); each fold is fitted once,
    whatever the number of metrics taken from the result. The base models of all folds are fitted side by side."""
    folded = stratified_kfold(df.select(key, target, *features), key, target, k, seed, fold)
    parts = []
    with kept(folded):
        fitted = fit_folds(folded, learners, features, target, k, fold, parallelism)
        for i in range(k):
            base = {learner.name: fitted[(i, learner.name)] for learner in learners}
            train, held = folded.where(F.col(fold) != i), folded.where(F.col(fold) == i)
            panel = fit_panel(train, learners, ensembles, features, target, key, k, parallelism, hold=False, base=base)
            parts.append(score_panel(panel, held, [key, target, fold]))
        return written(reduce(lambda a, b: a.unionByName(b), parts), "out_of_fold")


def cv_report(scored: DataFrame, target: str, by: Sequence[str] = ("model",), fold: str = "fold") -> DataFrame:
    """Mean and population deviation over folds of every metric: (keys..., metric, mean, std, k)."""
    return cv_summary(all_metrics(scored, [*by, fold], target), METRICS, by)


def choose(comparison: DataFrame, by: str = "cv", metric: str = "accuracy", model: str = "model") -> str:
    """Winner's name from rows (model, split, metric, value): by CV mean, or by the test value."""
    rows = comparison.where((F.lower("split") == by) & (F.col("metric") == metric) & F.col("value").isNotNull())
    return rows.agg(F.min_by(model, F.struct(-F.col("value"), F.col(model)))).first()[0]


def comparison_rows(test: DataFrame, cv: DataFrame) -> DataFrame:
    """(model, split, metric, value, std) from a metrics table and a CV report."""
    left = to_long(test, METRICS, ["model"]).select("model", F.lit("test").alias("split"), "metric", "value", F.lit(None).cast("double").alias("std"))
    right = cv.select("model", F.lit("cv").alias("split"), "metric", F.col("mean").alias("value"), "std")
    return left.unionByName(right)


def refit_best(
    df: DataFrame,
    winner: str,
    learners: Sequence[Learner],
    ensembles: Sequence[Ensemble],
    features: Sequence[str],
    target: str,
    key: str,
    k: int = 5,
) -> object:
    """The winning model fitted on all rows; only what it needs is fitted."""
    single = [learner for learner in learners if learner.name == winner]
    if single:
        return single[0].fit(df, features, target)
    chosen = [e for e in ensembles if e.name == winner]
    if not chosen:
        raise ValueError(f"no model named {winner!r}")
    return fit_panel(df, learners, chosen, features, target, key, k)[winner]


def labelled_scores(
    df: DataFrame, model: object, features: Sequence[str], keep: Sequence[str], positive: str, negative: str
) -> DataFrame:
    """Scores of a single model or an ensemble with label text."""
    ready = select_features(df, features, keep)
    scored = model.score(ready, keep) if isinstance(model, FittedEnsemble) else score(model, ready, keep)
    return scored.withColumn("prediction_label", decode_label("prediction", positive, negative))
