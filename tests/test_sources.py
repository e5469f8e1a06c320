import json
import os

from conftest import rows

from riskframe import session
from riskframe import sources as S


def test_csv_round_trip_and_types(spark, tmp_path):
    df = spark.createDataFrame([("k1", 60.0, None, True), ("k2", 1.5, "PPCI", False)], "id string, age double, t string, flag boolean")
    path = str(tmp_path / "t")
    S.write_csv_table(df, path)
    assert rows(S.read_csv_table(spark, path, df.schema)) == rows(df)
    found = S.read_csv_table(spark, path)
    assert [t for _, t in found.dtypes] == ["string", "double", "string", "boolean"] and rows(found) == rows(df)


def test_tsv_log(spark, tmp_path):
    path = tmp_path / "loss.tsv"
    path.write_text("iter\tLogloss\n0\t0.66\n1\t0.64\n")
    assert rows(S.read_tsv_log(spark, str(path))) == [(0, 0.66), (1, 0.64)]


def test_learning_curve_document(spark, tmp_path):
    document = {
        "meta": {"name": "experiment"},
        "iterations": [
            {"learn": [0.66], "iteration": 0, "passed_time": 0.28, "remaining_time": 71.1},
            {"learn": [0.64], "iteration": 1, "passed_time": 0.29, "remaining_time": 36.0},
        ],
    }
    (tmp_path / "curve.json").write_text(json.dumps(document, indent=1))
    got = S.read_learning_curve(spark, str(tmp_path / "curve.json"))
    assert rows(got) == [(0, 0.66, 0.28, 71.1), (1, 0.64, 0.29, 36.0)]


def _info(folder, kind, stamp, features):
    folder.mkdir()
    info = {
        "model_type": kind, "accuracy": "0.8875", "feature_count": len(features), "deployment_timestamp": stamp,
        "model_file": "best.bin", "features": features,
    }
    (folder / "info.json").write_text(json.dumps(info, indent=4))


def test_model_folders(spark, tmp_path):
    _info(tmp_path / "p1", "Boosted", "2025-04-11 18:35:12", ["Age", "HR"])
    _info(tmp_path / "p2", "Boosted", "2025-04-11 18:38:46", ["Age", "BMI"])
    _info(tmp_path / "p3", "Stack", "2025-04-11 21:55:56", ["Age"])
    infos = S.read_model_info(spark, str(tmp_path / "*" / "info.json"))
    assert infos.count() == 3
    newest = S.latest_models(infos)
    assert rows(newest, "model_type", "deployment_timestamp")[0] == ("Boosted", "2025-04-11 18:38:46")
    old = S.explode_features(infos.where("deployment_timestamp LIKE '%18:35%'"), ["model_type"])
    new = S.explode_features(newest.where("model_type = 'Boosted'"), ["model_type"])
    assert rows(new, "position", "feature") == [(0, "Age"), (1, "BMI")]
    assert rows(S.compare_features(old, new)) == [("Age", "kept"), ("BMI", "added"), ("HR", "removed")]


def test_registry_appends(spark, tmp_path):
    path = str(tmp_path / "registry")
    for i in range(2):
        S.register_model(S.model_row(spark, "Forest", 0.88754, ["a", "b"], f"2025-01-0{i + 1} 00:00:00", "m.bin"), path)
    got = S.read_registry(spark, path)
    assert got.count() == 2 and got.first()["accuracy"] == "0.8875" and got.first()["features"] == ["a", "b"]


def test_written_infos_are_read_back(spark, tmp_path):
    row = S.model_row(spark, "Forest", 0.9, ["a"], "2025-01-01 00:00:00", "m.bin").selectExpr("*", "'run1' AS package")
    S.write_model_info(row, str(tmp_path / "all"))
    assert rows(S.read_model_info(spark, str(tmp_path / "all")).select("model_type", "features")) == [("Forest", ["a"])]


def test_runs_side_by_side(spark, tmp_path):
    path = str(tmp_path / "runs")
    for run, n in (("20250410_204054", 3), ("20250410_204649", 2)):
        S.write_run(spark.range(n).selectExpr("id", f"'{run}' AS run_id"), path)
    assert sorted(os.listdir(path))[0].startswith((".", "_", "run_id="))
    assert S.read_runs(spark, path).count() == 5
    one = S.read_runs(spark, path, ["20250410_204649"])
    assert one.count() == 2
    assert "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()


def test_union_of_overlapping_runs(spark):
    a = spark.createDataFrame([("k1", 1.0), ("k2", 2.0)], "row_key string, v double").selectExpr("*", "'r1' AS run")
    b = spark.createDataFrame([("k2", 2.0), ("k3", None)], "row_key string, v double").selectExpr("*", "'r0' AS run")
    assert rows(S.union_runs([a, b], "row_key", "run")) == [("k1", "r1", 1.0, 1), ("k2", "r0", 2.0, 2), ("k3", "r0", None, 1)]


def test_scratch_is_under_the_shared_folder(spark):
    shared = session.shared_dir(spark)
    assert session.shared_dir(spark) == shared
    one, two = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert one != two and one.startswith(shared)


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    import pytest

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
