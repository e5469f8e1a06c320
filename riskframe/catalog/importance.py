"""Feature selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog.base import EVENTS, FEATURES, events, rounded_columns, table
from riskframe.operators import importance as I
from riskframe.operators import boosting as B
from riskframe.operators.columns import select_features
from riskframe.operators.learners import fit_boosted_trees, fit_random_forest

METHODS = ("A", "N", "R")
CUT = 140


def _forest(spark, sf):
    model = fit_random_forest(events(spark, sf), FEATURES, "y", trees=10, depth=5, min_leaf=4, seed=42)
    return model.stages[-1]


def importance_table(spark, sf):
    """Shares of a forest's importance: each between 0 and 1, together 1."""
    found = I.importance_table(spark, _forest(spark, sf), FEATURES)
    total = found.agg(F.sum("importance")).first()[0]
    return found.select("feature", F.col("importance").between(0, 1).alias("is_share"), F.lit(abs(total - 1) < 1e-9).alias("sums_to_one"))


def split_count_importance(spark, sf):
    """Splits per feature; all together as many as the trees have inner nodes."""
    forest = _forest(spark, sf)
    found = I.split_count_importance(spark, forest, FEATURES)
    inner = sum((tree.numNodes - 1) // 2 for tree in forest.trees)
    total = found.agg(F.sum("importance")).first()[0]
    return found.select("feature", (F.col("importance") >= 0).alias("counted"), F.lit(total == inner).alias("all_splits"))


def boosted_importance(spark, sf):
    """Splits and gains per feature of a boosted model."""
    model = fit_boosted_trees(events(spark, sf), FEATURES, "y", profile="leafy", rounds=6, depth=4)
    names, forest, _, _ = model.stages[-1].parts()
    splits = B.boosted_importance(spark, model, "split").withColumnRenamed("importance", "splits")
    both = splits.join(B.boosted_importance(spark, model, "gain"), "feature")
    inner = sum(int((tree.feature >= 0).sum()) for tree in forest)
    total = both.agg(F.sum("splits")).first()[0]
    return both.select("feature", ((F.col("splits") > 0) == (F.col("importance") > 0)).alias("gains_where_split"), F.lit(total == inner).alias("all_splits"))


def _two_scales(spark, sf):
    """Two importances per brand on very different scales."""
    part = table(spark, sf, "part")
    by_price = part.groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.avg("p_retailprice") / 1000, 6).alias("rf"))
    by_size = part.groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_size").alias("splits"))
    return by_price, by_size


def combine_importance(spark, sf):
    left, right = _two_scales(spark, sf)
    return rounded_columns(I.combine_importance(left, right, "rf", "splits"), "average_importance", digits=9)


def combine_importance_raw(spark, sf):
    left, right = _two_scales(spark, sf)
    return rounded_columns(I.combine_importance(left, right, "rf", "splits", mode="raw"), "average_importance")


def top_k_features(spark, sf):
    left, right = _two_scales(spark, sf)
    combined = rounded_columns(I.combine_importance(left, right, "rf", "splits", mode="raw"), "average_importance")
    return I.top_k_features(combined, 10).select("feature", "average_importance")


def _votes(spark, sf):
    """Each return flag votes for the parts it saw in large amounts."""
    sums = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("method"), F.col("l_partkey").alias("feature")
    ).agg(F.sum("l_quantity").alias("q"))
    return sums.where(F.col("q") > CUT).select("method", "feature")


def method_votes(spark, sf):
    return I.method_votes(_votes(spark, sf), METHODS)


def vote_threshold(spark, sf):
    return I.vote_threshold(_votes(spark, sf), 2)


def vote_intersection(spark, sf):
    votes = _votes(spark, sf)
    return I.vote_intersection([votes.where(F.col("method") == m).select("feature") for m in METHODS])


def select_l1(spark, sf):
    """The weights are those of the penalised least squares: |slope| of the loss is the penalty where a weight is not 0, with
    the weight's sign, and at most the penalty elsewhere."""
    df, alpha = events(spark, sf), 0.001
    found = {r["feature"]: r for r in I.select_l1(df, FEATURES, "y", alpha=alpha).collect()}
    stats = df.agg(F.avg("y"), F.stddev_samp("y"), *[g(f) for f in FEATURES for g in (F.avg, F.stddev_samp)]).first()
    x = {f: (F.col(f) - stats[2 + 2 * j]) / stats[3 + 2 * j] for j, f in enumerate(FEATURES)}
    rest = F.col("y") - F.lit(stats[0])
    for f in FEATURES:
        rest = rest - x[f] * F.lit(found[f]["weight"])
    slopes = df.agg(*[F.avg(rest * x[f]) for f in FEATURES]).first()
    penalty = alpha * stats[1]  # the learner's penalty is in deviations of the label
    rows = []
    for f, slope in zip(FEATURES, slopes):
        w = found[f]["weight"]
        best = min(abs(abs(slope) - p) for p in (alpha, penalty)) < 1e-5 and slope * w > 0 if w else abs(slope) <= max(alpha, penalty) + 1e-5
        rows.append((f, bool(found[f]["chosen"] == (w != 0)), bool(best)))
    return spark.createDataFrame(rows, "feature string, chosen_if_not_0 boolean, optimal boolean")


def _ranked(df, chosen, table, value):
    """Of every feature, whether it is chosen, and that no other one of greater size was left out."""
    kept = {r["feature"] for r in chosen.collect()}
    sizes = {r["feature"]: abs(r[value]) for r in table.collect()}
    least, left = min(sizes[f] for f in kept), max((v for f, v in sizes.items() if f not in kept), default=0.0)
    return df.sparkSession.createDataFrame([(len(kept), least >= left, kept <= set(FEATURES))], "n bigint, largest boolean, known boolean")


def select_rf(spark, sf):
    """The two features of a forest with the largest importance."""
    df = events(spark, sf)
    return _ranked(df, I.select_rf(df, FEATURES, "y", k=2, trees=10, depth=5), I.select_rf(df, FEATURES, "y", cut=-1.0, trees=10, depth=5), "importance")


def select_lr(spark, sf):
    """The two features of a logistic regression with the largest weights."""
    df = events(spark, sf)
    return _ranked(df, I.select_lr(df, FEATURES, "y", k=2), I.select_lr(df, FEATURES, "y", k=len(FEATURES)), "weight")


def _choices(spark, sf):
    df = events(spark, sf)
    return {
        "l1": [r["feature"] for r in I.select_l1(df, FEATURES, "y", alpha=0.0001).where("chosen").collect()],
        "forest": [r["feature"] for r in I.select_rf(df, FEATURES, "y", k=3, trees=10, depth=5).collect()],
        "logistic": [r["feature"] for r in I.select_lr(df, FEATURES, "y", k=3).collect()],
    }


def select_by_votes(spark, sf):
    """Selectors, their votes, the features that two of them chose, and the training columns those make."""
    chosen = _choices(spark, sf)
    agreed = sorted(r["feature"] for r in I.vote_threshold(I.votes_table(spark, chosen), 2).collect())
    by_hand = sorted(f for f in FEATURES if sum(f in names for names in chosen.values()) >= 2)
    ready = select_features(events(spark, sf), agreed, ["event_id", "y"])
    return ready.select("event_id", "y", F.lit(agreed == by_hand and ready.columns == ["event_id", "y", *agreed]).alias("as_voted"))


def select_domain(spark, sf):
    return I.select_domain(events(spark, sf), ["k", "value"], ["event_id"])


QUERIES = {
    f.__name__: f
    for f in (
        importance_table,
        split_count_importance,
        boosted_importance,
        combine_importance,
        combine_importance_raw,
        top_k_features,
        method_votes,
        vote_threshold,
        vote_intersection,
        select_l1,
        select_rf,
        select_lr,
        select_by_votes,
        select_domain,
    )
}

_TWO = """WITH i AS (SELECT p_brand AS feature, round(avg(p_retailprice) / 1000, 6) AS rf, CAST(sum(p_size) AS BIGINT) AS splits
  FROM part GROUP BY p_brand)"""
_VOTES = f"""WITH v AS (SELECT l_returnflag AS method, l_partkey AS feature FROM lineitem
  GROUP BY ALL HAVING sum(l_quantity) > {CUT})"""

_FEATURES = "(VALUES " + ", ".join(f"('{f}')" for f in FEATURES) + ") t(feature)"

ORACLES = {
    "importance_table": f"SELECT feature, true AS is_share, true AS sums_to_one FROM {_FEATURES}",
    "split_count_importance": f"SELECT feature, true AS counted, true AS all_splits FROM {_FEATURES}",
    "boosted_importance": f"SELECT feature, true AS gains_where_split, true AS all_splits FROM {_FEATURES}",
    "select_l1": f"SELECT feature, true AS chosen_if_not_0, true AS optimal FROM {_FEATURES}",
    "select_rf": "SELECT CAST(2 AS BIGINT) AS n, true AS largest, true AS known",
    "select_lr": "SELECT CAST(2 AS BIGINT) AS n, true AS largest, true AS known",
    "select_by_votes": f"WITH {EVENTS} SELECT event_id, y, true AS as_voted FROM ev",
    "combine_importance": f"""{_TWO} SELECT feature, rf, splits,
  round((rf / sum(rf) OVER () + 1.0e0 * splits / sum(splits) OVER ()) / 2.0e0, 9) AS average_importance FROM i""",
    "combine_importance_raw": f"{_TWO} SELECT feature, rf, splits, round((rf + splits) / 2.0e0, 6) AS average_importance FROM i",
    "top_k_features": f"""{_TWO} SELECT feature, round((rf + splits) / 2.0e0, 6) AS average_importance FROM i
ORDER BY average_importance DESC, feature LIMIT 10""",
    "method_votes": f"""{_VOTES} SELECT feature, count(*) FILTER (WHERE method = 'A') > 0 AS "A",
  count(*) FILTER (WHERE method = 'N') > 0 AS "N", count(*) FILTER (WHERE method = 'R') > 0 AS "R",
  CAST(count(DISTINCT method) AS INTEGER) AS methods_count FROM v GROUP BY feature""",
    "vote_threshold": f"{_VOTES} SELECT feature, count(DISTINCT method) AS n_methods FROM v GROUP BY feature HAVING count(DISTINCT method) >= 2",
    "vote_intersection": f"""{_VOTES} SELECT feature FROM v WHERE method = 'A' INTERSECT
SELECT feature FROM v WHERE method = 'N' INTERSECT SELECT feature FROM v WHERE method = 'R'""",
    "select_domain": f"WITH {EVENTS} SELECT event_id, k, value FROM ev",
}
