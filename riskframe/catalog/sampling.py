"""Split, fold, sample and weight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog.base import EVENTS, events, fold_sql, table
from riskframe.operators import sampling as S


def stratified_split(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return S.stratified_split(labels, "doc_id", "quality", 0.2)


def random_split(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return S.random_split(orders, "o_orderkey", 0.2)


def stratified_kfold(spark, sf):
    return S.stratified_kfold(events(spark, sf).select("event_id", "y"), "event_id", "y", 5)


def stratified_kfold_classes(spark, sf):
    return S.stratified_kfold(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", "label", 4, 7)


def _orders(spark, sf):
    """Orders; every customer is a class."""
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey")


def stratified_split_many(spark, sf):
    return S.stratified_split(_orders(spark, sf), "o_orderkey", "o_custkey", 0.2)


def stratified_kfold_many(spark, sf):
    return S.stratified_kfold(_orders(spark, sf), "o_orderkey", "o_custkey", 5)


def balanced_weights_many(spark, sf):
    return S.balanced_weights(_orders(spark, sf), "o_custkey").withColumn("weight", F.round("weight", 9))


def kfold_views(spark, sf):
    folded = S.stratified_kfold(events(spark, sf).select("event_id", "y"), "event_id", "y", 5)
    train, held = S.kfold_views(folded, 2)
    return train.withColumn("role", F.lit("train")).unionByName(held.withColumn("role", F.lit("validation")))


def sample_n(spark, sf):
    return S.sample_n(table(spark, sf, "events").select("event_id", "user_id", "value"), "event_id", 20)


def class_distribution(spark, sf):
    return S.class_distribution(table(spark, sf, "events").select("event_type"), "event_type")


def balanced_weights(spark, sf):
    weighted = S.balanced_weights(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic")
    return weighted.withColumn("weight", F.round("weight", 6))


def positive_weight(spark, sf):
    return S.positive_weight(events(spark, sf).select("event_id", "y"), "y", 1.0518)


QUERIES = {
    f.__name__: f
    for f in (
        stratified_split,
        random_split,
        stratified_kfold,
        stratified_kfold_classes,
        stratified_split_many,
        stratified_kfold_many,
        balanced_weights_many,
        kfold_views,
        sample_n,
        class_distribution,
        balanced_weights,
        positive_weight,
    )
}

_EVENT_FOLDS = f"WITH {EVENTS}, src AS (SELECT event_id, y FROM ev), {fold_sql('src', 'event_id', 'y', 5)} "

ORACLES = {
    "stratified_split_many": """WITH r AS (
  SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('split:42:' || o_orderkey), o_orderkey) AS pos FROM orders),
c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
t AS (SELECT count(*) AS total, CAST(ceil(round(count(*) * 0.2e0, 9)) AS BIGINT) AS size FROM orders),
b AS (SELECT o_custkey, size * n // total AS base, (size * n) % total AS rest, size FROM c, t),
q AS (SELECT o_custkey, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, o_custkey) <= size - sum(base) OVER ()
        THEN 1 ELSE 0 END AS quota FROM b)
SELECT o_orderkey, r.o_custkey, pos <= quota AS is_test FROM r JOIN q ON q.o_custkey = r.o_custkey""",
    "stratified_kfold_many": "WITH " + fold_sql("orders", "o_orderkey", "o_custkey", 5) + " SELECT o_orderkey, o_custkey, fold FROM folded",
    "balanced_weights_many": """WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT o_orderkey, orders.o_custkey, round((SELECT count(*) FROM orders) / (1.0e0 * (SELECT count(*) FROM c) * n), 9) AS weight
FROM orders JOIN c ON c.o_custkey = orders.o_custkey""",
    "stratified_split": """WITH r AS (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('split:42:' || doc_id), doc_id) AS pos FROM labels),
c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
t AS (SELECT count(*) AS total, CAST(ceil(round(count(*) * 0.2e0, 9)) AS BIGINT) AS size FROM labels),
b AS (SELECT quality, size * n // total AS base, (size * n) % total AS rest, size FROM c, t),
q AS (SELECT quality, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, quality) <= size - sum(base) OVER ()
        THEN 1 ELSE 0 END AS quota FROM b)
SELECT doc_id, r.quality, pos <= quota AS is_test FROM r JOIN q ON q.quality = r.quality""",
    "random_split": """WITH r AS (
  SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY md5('split:42:' || o_orderkey), o_orderkey) AS pos,
         count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_orderstatus, pos <= ceil(round(n * 0.2e0, 9)) AS is_test FROM r""",
    "stratified_kfold": _EVENT_FOLDS + "SELECT event_id, y, fold FROM folded",
    "stratified_kfold_classes": "WITH src AS (SELECT vec_id, label FROM embeddings), "
    + fold_sql("src", "vec_id", "label", 4, "7")
    + " SELECT vec_id, label, fold FROM folded",
    "kfold_views": _EVENT_FOLDS
    + "SELECT event_id, y, fold, CASE WHEN fold = 2 THEN 'validation' ELSE 'train' END AS role FROM folded",
    "sample_n": "SELECT event_id, user_id, value FROM events ORDER BY md5('sample:42:' || event_id), event_id LIMIT 20",
    "class_distribution": """SELECT event_type, count(*) AS n,
  1.0e0 * count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY event_type""",
    "balanced_weights": """WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)
SELECT doc_id, labels.toxic, round(1.0e0 * (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight
FROM labels JOIN c ON c.toxic = labels.toxic""",
    "positive_weight": f"""WITH {EVENTS} SELECT event_id, y,
  CASE WHEN y = 1 THEN 1.0518e0 ELSE 1.0e0 END AS weight FROM ev""",
}
