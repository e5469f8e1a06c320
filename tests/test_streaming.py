import json

from conftest import rows
from pyspark.ml import PipelineModel

from riskframe.operators.learners import fit_logistic
from riskframe.operators.scorers import LinearScorer
from riskframe.operators.scoring import batch_score
from riskframe.streaming.scoring import json_records, stream_score

SCHEMA = "id bigint, a double, b double"


def _write(folder, name, ids):
    lines = [json.dumps({"id": i, "a": i * 0.5, "b": 3.0}) for i in ids]
    (folder / name).write_text("\n".join(lines))


def test_stream_equals_batch_and_scores_each_record_once(spark, tmp_path):
    arrived, done, offsets = tmp_path / "in", tmp_path / "out", tmp_path / "offsets"
    arrived.mkdir()
    model = PipelineModel(stages=[LinearScorer(["a", "b"], [1.0, -1.0], 0.1)])

    def drain():
        records = json_records(spark, str(arrived), SCHEMA, files_per_trigger=1)
        stream_score(records, model, ["a", "b"], str(done), str(offsets), ["id"]).awaitTermination()

    _write(arrived, "one.json", range(10))
    _write(arrived, "two.json", range(10, 15))
    drain()
    assert spark.read.parquet(str(done)).count() == 15
    _write(arrived, "three.json", range(15, 20))
    drain()
    drain()
    batch = batch_score(spark.read.schema(SCHEMA).json(str(arrived)), model, ["a", "b"], ["id"])
    assert rows(spark.read.parquet(str(done))) == rows(batch)


def test_fitted_pipeline_on_a_stream(spark, tmp_path):
    arrived = tmp_path / "in"
    arrived.mkdir()
    _write(arrived, "one.json", range(12))
    train = spark.createDataFrame([(i * 0.5, 3.0, int(i > 5)) for i in range(12)], "a double, b double, y int")
    model = fit_logistic(train, ["a", "b"], "y")
    records = json_records(spark, str(arrived), SCHEMA)
    stream_score(records, model, ["a", "b"], str(tmp_path / "out"), str(tmp_path / "cp"), ["id"]).awaitTermination()
    batch = batch_score(spark.read.schema(SCHEMA).json(str(arrived)), model, ["a", "b"], ["id"])
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)
