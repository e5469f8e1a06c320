"""Learner and ensemble queries: fitted on the whole table, scored on the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from riskframe.catalog.base import CHECKED, EVENTS, FEATURES, checked_scores, events, fold_sql, table
from riskframe.operators import ensembles, learners
from riskframe.operators.learners import Learner
from riskframe.operators.neighbours import score_knn as knn
from riskframe.operators.metrics import accuracy
from riskframe.operators.sampling import stratified_kfold, stratified_split
from riskframe.operators.scoring import batch_score
from riskframe.operators.vector_index import build_index, search_index, vote_of
from riskframe.plans import evaluate
from riskframe.plans.evaluate import Ensemble
from riskframe.plans.package import score_registered
from riskframe.session import scratch_path
from riskframe.sources import load_model, model_row, read_registry, register_model, save_model
from riskframe.streaming.scoring import json_records, stream_score

KEEP = ["event_id", "y"]
SMALL_FOREST = {"trees": 5, "depth": 4, "min_leaf": 4}
SMALL_BOOST = {"rounds": 20, "depth": 4}
#: Boosted members that a refit chooses from: they are fitted for every fold and have fewer and shallower trees.
REFIT_BOOST = {"rounds": 10, "depth": 3}
BASE = (
    Learner("forest", "random_forest", SMALL_FOREST, "balanced"),
    Learner("bayes", "naive_bayes"),
    Learner("logit", "logistic", {"max_iter": 10}, "balanced"),
    Learner("leafy", "boosted_trees", {**REFIT_BOOST, "profile": "leafy"}, "balanced"),
    Learner("deep", "boosted_trees", {**REFIT_BOOST, "profile": "deep"}, 1.0518),
)
FINAL_LOGIT = Learner("final", "logistic", {"max_iter": 10}, "balanced")
FINAL_FOREST = Learner("final", "random_forest", {"trees": 10, "depth": 5, "min_leaf": 1, "bootstrap": True})
ENSEMBLES = (
    Ensemble("vote_soft", "soft"),
    Ensemble("vote_hard", "hard"),
    Ensemble("stack_logistic", "stack", FINAL_LOGIT),
    Ensemble("stack_forest", "stack", FINAL_FOREST),
)

#: The panel's members: boosted profiles and logistic fits whole, the forests in the sizes of the other queries.
PANEL = (
    *BASE[:2],
    Learner("logit", "logistic", {}, "balanced"),
    Learner("leafy", "boosted_trees", {"profile": "leafy"}, "balanced"),
    Learner("deep", "boosted_trees", {"profile": "deep"}, 1.0518),
)
PANEL_ENSEMBLES = (*ENSEMBLES[:2], Ensemble("stack_logistic", "stack", Learner("final", "logistic", {}, "balanced")), ENSEMBLES[3])


def _fit_and_score(spark, sf, kind, settings, weighting=None, features=FEATURES):
    df = events(spark, sf)
    model = Learner(kind, kind, settings, weighting).fit(df, features, "y")
    return learners.score(model, df, KEEP)


def _checked(spark, sf, kind, settings, weighting=None):
    return checked_scores(_fit_and_score(spark, sf, kind, settings, weighting))


def fit_random_forest(spark, sf):
    return _checked(spark, sf, "random_forest", {**SMALL_FOREST, "trees": 10}, "balanced")


def fit_boosted_trees(spark, sf):
    return _checked(spark, sf, "boosted_trees", {**SMALL_BOOST, "profile": "leafy"}, "balanced")


def fit_boosted_trees_deep(spark, sf):
    """The tuned learner whole: all rounds and the depth of its profile."""
    return _checked(spark, sf, "boosted_trees", {"profile": "deep"}, 1.0518)


def fit_logistic(spark, sf):
    """The fit ends where the gradient of the penalised loss vanishes: per weight its size beside that of its terms."""
    df = events(spark, sf)
    model = Learner("logistic", "logistic", {"max_iter": 300, "standardise": True}, "balanced").fit(df, FEATURES, "y")
    final, scaler = model.stages[-1], model.stages[-2]
    weighted = learners.balanced_weights(df, "y", "w")
    scored = learners.score(model, weighted, ["event_id", "y", "w", *FEATURES])
    rest = F.col("w") * (F.col("probability") - F.col("y"))
    sums = []
    for j, name in enumerate(FEATURES):
        x = (F.col(name) - float(scaler.mean[j])) / float(scaler.std[j] or 1.0)
        sums += [F.sum(rest * x) + float(final.coefficients[j]), F.sum(F.abs(rest * x))]
    found = scored.agg(F.sum(rest), F.sum(F.abs(rest)), *sums).first()
    stationary = all(abs(g) <= 1e-3 * size for g, size in zip(found[::2], found[1::2]))
    return checked_scores(scored).withColumn("stationary", F.lit(stationary))


def fit_decision_tree(spark, sf):
    """A tree of one split, on a target that follows the hour but for every tenth event."""
    marked = events(spark, sf).withColumn("y", ((F.col("hour") >= 9) != (F.col("event_id") % 10 == 0)).cast("int"))
    model = Learner("tree", "decision_tree", {"depth": 1}).fit(marked, ("hour",), "y")
    return learners.score(model, marked, KEEP).withColumn("probability", F.round("probability", 6))


def fit_decision_tree_deep(spark, sf):
    return _checked(spark, sf, "decision_tree", {"depth": 5})


def fit_naive_bayes(spark, sf):
    scored = _fit_and_score(spark, sf, "naive_bayes", {}, features=("value", "hour"))
    return scored.withColumn("probability", F.round("probability", 6))


def fit_lda(spark, sf):
    scored = _fit_and_score(spark, sf, "lda", {}, features=("value", "hour"))
    return scored.select(*KEEP, F.round("probability", 6).alias("probability"))


def fit_ridge(spark, sf):
    df = events(spark, sf)
    model = learners.fit_ridge(df, ["k"], "y", alpha=10.0)
    scorer = model.stages[0]
    return df.select(*KEEP, F.round(scorer.raw(), 6).alias("raw"))


def fit_linear_svm(spark, sf):
    return _checked(spark, sf, "linear_svm", {"max_iter": 10}, "balanced")


def fit_kernel_svm(spark, sf):
    return _checked(spark, sf, "kernel_svm", {"components": 64, "max_iter": 20}, "balanced")


def fit_calibrated_sigmoid(spark, sf):
    return _checked(spark, sf, "calibrated", {"base": "linear_svm", "max_iter": 10})


def fit_calibrated_monotone(spark, sf):
    return _checked(spark, sf, "calibrated", {"base": "ridge", "method": "monotone"})


def fit_mlp(spark, sf):
    return _checked(spark, sf, "mlp", {"hidden": (8,), "max_iter": 20})


def fit_adaboost(spark, sf):
    return _checked(spark, sf, "adaboost", {"rounds": 50})


def score_knn(spark, sf):
    vectors = table(spark, sf, "embeddings")
    split = stratified_split(vectors, "vec_id", "label", 0.2)
    return knn(
        split.where("NOT is_test"), split.where("is_test"), "vec_id", "embedding", "label", 5,
        broadcast_cells=4_000_000, digits=6,
    )


def score_knn_blocks(spark, sf):
    """The same vote through the block join that large training tables take."""
    vectors = table(spark, sf, "embeddings")
    split = stratified_split(vectors, "vec_id", "label", 0.2)
    return knn(
        split.where("NOT is_test"), split.where("is_test"), "vec_id", "embedding", "label", 5,
        block_rows=200, digits=6,
    )


def score_knn_index(spark, sf):
    """The same vote from a stored index, searched until no cell can hold a nearer row."""
    split = stratified_split(table(spark, sf, "embeddings"), "vec_id", "label", 0.2)
    index = build_index(split.where("NOT is_test"), "vec_id", "embedding", "label", scratch_path(spark, "index"), cells=12)
    found = search_index(spark, index, split.where("is_test"), "vec_id", "embedding", 5)
    return vote_of(found, "vec_id").select("vec_id", F.col("prediction").cast("int").alias("prediction"), "votes")


def vote_soft(spark, sf):
    df = events(spark, sf)
    return ensembles.vote_soft(df, ["p_value", "p_user", "p_event"]).select(
        *KEEP, "prediction", F.round("probability", 9).alias("probability")
    )


def vote_hard(spark, sf):
    df = events(spark, sf)
    tables = {
        name: df.select("event_id", (F.col(f"p_{name}") > 0.5).cast("int").alias("prediction"))
        for name in ("value", "user", "event")
    }
    joined = ensembles.align_scores(tables, "event_id", "prediction")
    return ensembles.vote_hard(joined, list(tables)).select("event_id", *tables, "prediction", "probability")


#: Members without boosted trees, where a query fits them for fold after fold.
PLAIN = BASE[:3]


def _meta(spark, sf):
    folded = stratified_kfold(events(spark, sf).select("event_id", "y", *FEATURES), "event_id", "y", 5)
    return ensembles.stack_meta_features(folded, PLAIN, FEATURES, "y", "event_id", 5, parallelism=8)


def stack_meta_features(spark, sf):
    """Out-of-fold probabilities: one per row and member, each between 0 and 1."""
    meta = _meta(spark, sf)
    return meta.select("event_id", "y", *[F.col(b.name).between(0, 1).alias(b.name) for b in PLAIN])


def stack_meta_coverage(spark, sf):
    """Every row gets exactly one out-of-fold score per model, from a model that never saw it."""
    meta = _meta(spark, sf)
    return meta.select("event_id", "y", "fold", *[F.col(b.name).isNotNull().alias(f"has_{b.name}") for b in PLAIN])


def _stack(spark, sf, final):
    df = events(spark, sf)
    stack = evaluate.fit_stack(df, PLAIN, final, FEATURES, "y", "event_id", k=5, parallelism=8)
    return checked_scores(stack.score(df, KEEP), own_rows=False)


def stack_logistic(spark, sf):
    return _stack(spark, sf, FINAL_LOGIT)


def stack_forest(spark, sf):
    return _stack(spark, sf, FINAL_FOREST)


def _sound(metrics):
    """Whether the metrics of a row lie between 0 and 1 and F1 is that of precision and recall."""
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    ranges = [F.col(m).between(0, 1) for m in ("accuracy", "precision", "recall", "f1", "roc_auc") if m in metrics.columns]
    return reduce(lambda a, b: a & b, [F.coalesce(x, F.lit(True)) for x in ranges]) & (F.abs(F.col("f1") - f1) < 1e-9)


def model_panel(spark, sf):
    """All members, both boosted profiles whole among them, and the four ensembles on the hold-out rows."""
    split = stratified_split(events(spark, sf), "event_id", "y", 0.2)
    metrics, _ = evaluate.model_panel(
        split.where("NOT is_test"), split.where("is_test"), PANEL, PANEL_ENSEMBLES, FEATURES, "y", "event_id", k=5, parallelism=8
    )
    return metrics.select("model", _sound(metrics).alias("sound"))


def panel_test_vs_cv(spark, sf):
    """Hold-out value, cross-validated mean and deviation of every metric, side by side for all members and both votes."""
    df, votes = events(spark, sf), ENSEMBLES[:2]
    split = stratified_split(df, "event_id", "y", 0.2)
    train = split.where("NOT is_test").drop("is_test")
    metrics, _ = evaluate.model_panel(train, split.where("is_test"), PLAIN, votes, FEATURES, "y", "event_id", k=5, parallelism=8)
    scored = evaluate.cross_validate(train, PLAIN, FEATURES, "y", "event_id", k=5, ensembles=votes, parallelism=8)
    rows = evaluate.comparison_rows(metrics, evaluate.cv_report(scored, "y"))
    in_range = F.coalesce(F.col("value").between(0, 1), F.lit(True)) & F.coalesce(F.col("std").between(0, 0.5), F.lit(True))
    return rows.select("model", "split", "metric", in_range.alias("in_range"))


#: Two quick members for the queries that are about the life of an ensemble, not its quality.
QUICK = (Learner("bayes", "naive_bayes"), Learner("logit", "logistic", {"max_iter": 5}, "balanced"))
QUICK_ENSEMBLES = (Ensemble("soft", "soft"), Ensemble("hard", "hard"), Ensemble("stack", "stack", FINAL_LOGIT))


def _quick_panel(df):
    panel = evaluate.fit_panel(df, QUICK, QUICK_ENSEMBLES, FEATURES, "y", "event_id", k=3, parallelism=4)
    return {e.name: panel[e.name] for e in QUICK_ENSEMBLES}


def save_load_ensemble(spark, sf):
    """Every kind of ensemble scores alike before it is saved and after it is loaded."""
    df, parts = events(spark, sf).select("event_id", "y", *FEATURES), []
    for name, model in _quick_panel(df).items():
        path = scratch_path(spark, "ensemble")
        save_model(model, path)
        before = learners.score(model, df).withColumnsRenamed({"prediction": "before", "probability": "p_before"})
        both = learners.score(load_model(path), before)
        same = F.col("before").eqNullSafe(F.col("prediction")) & F.col("p_before").eqNullSafe(F.col("probability"))
        parts.append(both.select("event_id", F.lit(name).alias("kind"), same.alias("same")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def stream_score_ensemble(spark, sf):
    """A stacked model scores arriving records as it scores the table."""
    df = events(spark, sf).select("event_id", "y", *FEATURES)
    model = _quick_panel(df)["stack"]
    arrived, done, offsets = (scratch_path(spark, n) for n in ("records", "scored", "offsets"))
    df.write.json(arrived)
    records = json_records(spark, arrived, df.schema)
    stream_score(records, model, FEATURES, done, offsets, ["event_id"]).awaitTermination()
    batch = batch_score(df, model, FEATURES, ["event_id"]).select("event_id", F.col("probability").alias("batch"))
    both = spark.read.parquet(done).join(batch, "event_id")
    labelled = F.col("prediction_label").isNotNull()
    return both.select("event_id", labelled.alias("labelled"), (F.abs(F.col("probability") - F.col("batch")) < 1e-12).alias("same"))


def score_package(spark, sf):
    """Register a fitted model, then score from nothing but the registry: newest row, feature list, model."""
    df, registry, path = events(spark, sf), scratch_path(spark, "registry"), scratch_path(spark, "package")
    model = learners.fit_naive_bayes(df, ("value", "hour"), "y")
    save_model(model, path)
    right = accuracy(learners.score(model, df, ["event_id", "y"])).first()["accuracy"]
    register_model(model_row(spark, "bayes", right, ["value", "hour"], "2024-01-01 00:00:00", path), registry)
    scored = score_registered(df, read_registry(spark, registry), "bayes", ["event_id"])
    expected = learners.score(model, df, ["event_id"]).withColumnsRenamed({"prediction": "expected", "probability": "p"})
    return scored.join(expected, "event_id").select("event_id", (F.col("prediction") == F.col("expected")).alias("same"))


def refit_best(spark, sf):
    """The member or vote with the best cross-validated accuracy, fitted on all rows."""
    df, votes = events(spark, sf), ENSEMBLES[:2]
    scored = evaluate.cross_validate(df, BASE, FEATURES, "y", "event_id", k=5, ensembles=votes, parallelism=8)
    report = evaluate.cv_report(scored, "y")
    rows = report.select("model", F.lit("cv").alias("split"), "metric", F.col("mean").alias("value"))
    winner = evaluate.choose(rows)
    best = report.where("metric = 'accuracy'").agg(F.max("mean"), F.max(F.when(F.col("model") == winner, F.col("mean")))).first()
    model = evaluate.refit_best(df, winner, BASE, votes, FEATURES, "y", "event_id")
    scored = evaluate.labelled_scores(df, model, FEATURES, KEEP, "Converts", "Does not convert")
    label = F.when(F.col("prediction") == 1, "Converts").otherwise("Does not convert")
    return scored.select(*KEEP, (F.col("prediction_label") == label).alias("labelled"), F.lit(best[0] == best[1]).alias("is_best"))


QUERIES = {
    f.__name__: f
    for f in (
        fit_random_forest,
        fit_boosted_trees,
        fit_boosted_trees_deep,
        fit_logistic,
        fit_decision_tree,
        fit_decision_tree_deep,
        fit_naive_bayes,
        fit_lda,
        fit_ridge,
        fit_linear_svm,
        fit_kernel_svm,
        fit_calibrated_sigmoid,
        fit_calibrated_monotone,
        fit_mlp,
        fit_adaboost,
        score_knn,
        score_knn_blocks,
        score_knn_index,
        vote_soft,
        vote_hard,
        stack_meta_features,
        stack_meta_coverage,
        stack_logistic,
        stack_forest,
        model_panel,
        panel_test_vs_cv,
        save_load_ensemble,
        stream_score_ensemble,
        score_package,
        refit_best,
    )
}


def _knn_sql() -> str:
    return """WITH r AS (
  SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY md5('split:42:' || vec_id), vec_id) AS pos
  FROM embeddings),
c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
t AS (SELECT count(*) AS total, CAST(ceil(round(count(*) * 0.2e0, 9)) AS BIGINT) AS size FROM embeddings),
b AS (SELECT label, size * n // total AS base, (size * n) % total AS rest, size FROM c, t),
q AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= size - sum(base) OVER ()
        THEN 1 ELSE 0 END AS quota FROM b),
s AS (SELECT r.*, pos <= quota AS is_test FROM r JOIN q ON q.label = r.label),
d AS (
  SELECT x.vec_id, o.vec_id AS other, o.label,
         round(list_sum(list_transform(list_zip(x.embedding, o.embedding),
           lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))), 6) AS distance
  FROM s x JOIN s o ON x.is_test AND NOT o.is_test),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, other) AS position FROM d),
v AS (SELECT vec_id, label, count(*) AS votes FROM n WHERE position <= 5 GROUP BY vec_id, label)
SELECT vec_id, label AS prediction, votes FROM v
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) = 1"""


_MEMBERS = "('forest'), ('bayes'), ('logit'), ('vote_soft'), ('vote_hard')"

ORACLES = {
    **dict.fromkeys(
        (
            "fit_random_forest", "fit_boosted_trees", "fit_boosted_trees_deep", "fit_decision_tree_deep", "fit_linear_svm", "fit_mlp",
            "fit_adaboost", "fit_kernel_svm", "fit_calibrated_sigmoid", "fit_calibrated_monotone",
        ),
        CHECKED,
    ),
    **dict.fromkeys(("stack_logistic", "stack_forest"), CHECKED.replace(", true AS no_worse", "")),
    "fit_logistic": CHECKED.replace("true AS no_worse", "true AS no_worse, true AS stationary"),
    "fit_decision_tree": f"""WITH {EVENTS}, mk AS (
  SELECT event_id, hour, CASE WHEN (hour >= 9) <> (event_id % 10 = 0) THEN 1 ELSE 0 END AS y FROM ev),
h AS (SELECT hour, count(*) AS n, sum(y) AS s FROM mk GROUP BY hour),
c AS (SELECT a.hour AS cut, sum(b.n) FILTER (WHERE b.hour <= a.hour) AS ln, sum(b.s) FILTER (WHERE b.hour <= a.hour) AS ls,
        sum(b.n) FILTER (WHERE b.hour > a.hour) AS rn, sum(b.s) FILTER (WHERE b.hour > a.hour) AS rs FROM h a, h b GROUP BY a.hour),
g AS (SELECT *, 2.0e0 * ls * (ln - ls) / ln + 2.0e0 * rs * (rn - rs) / rn AS impurity FROM c WHERE rn > 0),
w AS (SELECT * FROM g ORDER BY impurity, cut LIMIT 1),
p AS (SELECT event_id, y, CASE WHEN hour <= cut THEN 1.0e0 * ls / ln ELSE 1.0e0 * rs / rn END AS p FROM mk, w)
SELECT event_id, y, CASE WHEN p > 0.5e0 THEN 1 ELSE 0 END AS prediction, round(p, 6) AS probability FROM p""",
    "stack_meta_features": f"WITH {EVENTS} SELECT event_id, y, true AS forest, true AS bayes, true AS logit FROM ev",
    "model_panel": f"SELECT model, true AS sound FROM (VALUES {_MEMBERS}, ('leafy'), ('deep'), ('stack_logistic'), ('stack_forest')) t(model)",
    "panel_test_vs_cv": f"""SELECT model, split, metric, true AS in_range FROM (VALUES {_MEMBERS}) a(model), (VALUES ('test'), ('cv')) b(split),
  (VALUES ('accuracy'), ('precision'), ('recall'), ('f1'), ('roc_auc')) c(metric)
WHERE NOT (model = 'vote_hard' AND metric = 'roc_auc')""",
    "refit_best": f"WITH {EVENTS} SELECT event_id, y, true AS labelled, true AS is_best FROM ev",
    "fit_naive_bayes": f"""WITH {EVENTS}, s AS (
  SELECT y AS c, 1.0e0 * count(*) / (SELECT count(*) FROM ev) AS prior, avg(value) AS m1, var_pop(value) AS v1,
         avg(hour) AS m2, var_pop(hour) AS v2 FROM ev GROUP BY y),
l AS (
  SELECT event_id, y, c, ln(prior) - 0.5e0 * (ln(v1) + pow(value - m1, 2) / v1 + ln(v2) + pow(hour - m2, 2) / v2) AS ll
  FROM ev, s),
w AS (SELECT event_id, y, max(ll) FILTER (WHERE c = 0) AS l0, max(ll) FILTER (WHERE c = 1) AS l1 FROM l GROUP BY event_id, y)
SELECT event_id, y, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS prediction, round(1.0e0 / (1.0e0 + exp(l0 - l1)), 6) AS probability
FROM w""",
    "fit_lda": f"""WITH {EVENTS}, m AS (
  SELECT y AS c, count(*) AS n, avg(value) AS a, avg(hour) AS b FROM ev GROUP BY y),
s AS (
  SELECT sum(pow(value - a, 2)) / (count(*) - 2) AS saa, sum((value - a) * (hour - b)) / (count(*) - 2) AS sab,
         sum(pow(hour - b, 2)) / (count(*) - 2) AS sbb FROM ev JOIN m ON c = y),
p AS (
  SELECT h.a - l.a AS da, h.b - l.b AS db, (h.a + l.a) / 2 AS ma, (h.b + l.b) / 2 AS mb, ln(1.0e0 * h.n / l.n) AS prior
  FROM m h, m l WHERE h.c = 1 AND l.c = 0),
w AS (
  SELECT (sbb * da - sab * db) / (saa * sbb - sab * sab) AS wa, (saa * db - sab * da) / (saa * sbb - sab * sab) AS wb, ma, mb, prior
  FROM s, p)
SELECT event_id, y, round(1.0e0 / (1.0e0 + exp(-(wa * (value - ma) + wb * (hour - mb) + prior))), 6) AS probability FROM ev, w""",
    "fit_ridge": f"""WITH {EVENTS}, s AS (
  SELECT avg(k) AS mk, avg(2 * y - 1) AS mt, sum(pow(k, 2)) - pow(sum(k), 2) / count(*) AS skk,
         sum(k * (2 * y - 1)) - 1.0e0 * sum(k) * sum(2 * y - 1) / count(*) AS skt FROM ev)
SELECT event_id, y, round(mt + skt / (skk + 10.0e0) * (k - mk), 6) AS raw FROM ev, s""",
    "save_load_ensemble": """SELECT event_id, kind, true AS same
FROM events, (VALUES ('soft'), ('hard'), ('stack')) k(kind)""",
    "stream_score_ensemble": "SELECT event_id, true AS labelled, true AS same FROM events",
    "score_package": "SELECT event_id, true AS same FROM events",
    "score_knn": _knn_sql(),
    "score_knn_blocks": _knn_sql(),
    "score_knn_index": _knn_sql(),
    "vote_soft": f"""WITH {EVENTS} SELECT event_id, y, CASE WHEN (p_value + p_user + p_event) / 3.0e0 > 0.5e0 THEN 1 ELSE 0 END AS prediction,
  round((p_value + p_user + p_event) / 3.0e0, 9) AS probability FROM ev""",
    "vote_hard": f"""WITH {EVENTS}, c AS (
  SELECT event_id, CAST(p_value > 0.5e0 AS INTEGER) AS "value", CAST(p_user > 0.5e0 AS INTEGER) AS "user",
         CAST(p_event > 0.5e0 AS INTEGER) AS "event" FROM ev)
SELECT event_id, "value", "user", "event", CASE WHEN ("value" + "user" + "event") * 2 > 3 THEN 1 ELSE 0 END AS prediction,
  CAST(NULL AS DOUBLE) AS probability FROM c""",
    "stack_meta_coverage": f"WITH {EVENTS}, src AS (SELECT event_id, y FROM ev), {fold_sql('src', 'event_id', 'y', 5)} "
    + "SELECT event_id, y, fold, true AS has_forest, true AS has_bayes, true AS has_logit FROM folded",
}
