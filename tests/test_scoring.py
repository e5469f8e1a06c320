import pytest
from conftest import rows
from pyspark.ml import PipelineModel

from riskframe.operators import scoring as S
from riskframe.operators.scorers import LinearScorer

MODEL = PipelineModel(stages=[LinearScorer(["a", "b"], [1.0, -1.0], 0.0)])
HARD = PipelineModel(stages=[LinearScorer(["a", "b"], [1.0, -1.0], 0.0, "none")])

# Probabilities and truth of a published sample of 20 scored rows.
SAMPLE = [
    (0.9050152101288392, 1), (0.912668648979945, 1), (0.061556610326456276, 0), (0.9203209275827383, 1),
    (0.9186321378334653, 1), (0.9248198889545156, 1), (0.9138507318277314, 1), (0.8910055169885607, 1),
    (0.9194416904160241, 1), (0.9142102527222165, 1), (0.9126124203127863, 1), (0.8601608307297999, 1),
    (0.048975127959214264, 0), (0.8601608897691478, 1), (0.9121234572864935, 1), (0.9181626627785022, 1),
    (0.8740142403137358, 1), (0.9072281804197878, 1), (0.04989967904415952, 0), (0.08298874869674937, 0),
]


def test_batch_score(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0, "x"), (2, 1.0, 1.0, "y")], "id int, b double, a double, other string")
    got = S.batch_score(df, MODEL, ["a", "b"], ["id"], "Positive", "Negative")
    assert got.columns == ["id", "prediction", "prediction_label", "probability"]
    assert [r[:3] for r in rows(got)] == [(1, 0, "Negative"), (2, 0, "Negative")]
    assert rows(got)[1][3] == 0.5
    with pytest.raises(ValueError, match="missing required features: b"):
        S.batch_score(df.drop("b"), MODEL, ["a", "b"])
    assert S.with_percent(got).collect()[1]["probability_text"] == "50.00%"
    assert S.with_percent(S.batch_score(df, HARD, ["a", "b"])).first()["probability_text"] is None


def test_truth_as_text_is_encoded(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0, "yes"), (2, 0.0, 1.0, "no"), (3, 0.0, 1.0, "?")], "id int, a double, b double, t string")
    got = S.score_with_truth(df, MODEL, ["a", "b"], "t", ["id"], "Positive", "Negative", {"yes": 1, "no": 0})
    assert rows(got, "id", "actual", "actual_label") == [
        (1, 1, "Positive"), (2, 0, "Negative"), (3, None, None)
    ]
    metrics = S.truth_metrics(got).first()
    assert (metrics["n"], metrics["accuracy"], metrics["roc_auc"]) == (2, 1.0, 1.0)
    plain = S.score_with_truth(df.drop("t"), MODEL, ["a", "b"], "t", ["id"])
    assert "actual" not in plain.columns


def test_published_sample(spark):
    df = spark.createDataFrame([(int(p > 0.5), p, y) for p, y in SAMPLE], "prediction int, probability double, actual int")
    for average in ("weighted", "binary"):
        m = S.truth_metrics(df, average).first()
        assert (m["accuracy"], m["f1"], m["roc_auc"], m["n"]) == (1.0, 1.0, 1.0, 20)
    assert [tuple(r) for r in S.prediction_distribution(df).collect()] == [(1, 16, 0.8), (0, 4, 0.2)]
    with pytest.raises(ValueError):
        S.truth_metrics(df, "micro")
