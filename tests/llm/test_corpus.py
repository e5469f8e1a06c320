"""The queries beside their SQL on the small tables, and the pipeline beside its stages' rules."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
import tools.check_queries as checker
from riskframe.llm.oracles import ORACLES
from riskframe.llm.queries import QUERIES
from tests.llm.tables import DOCS, SMALL, odd_rows, sentence, words

needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing to target weights", "packing"]


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert checker.compare(spark, SMALL, name) == []


def test_pipeline_stages(spark, tmp_path):
    import random

    rng = random.Random(9)
    rows = odd_rows()
    for i in range(120):
        insult = "blork snarf " if i % 4 == 0 else ""
        rows.append((500 + i, insult + sentence(rng, 60), "en", "a", 0))
    labels = [(500 + i, 1, int(i % 4 == 0)) for i in range(120)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), "stage")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {500 + i for i in range(120) if i % 4 == 0}
    assert {r.doc_id for r in seen["toxicity"]} == {r[0] for r in rows} - toxic
    normal = lambda t: " ".join(words(t)) if words(t) else (" " if t else "")
    exact = [normal(r.text) for r in seen["exact dedup"]]
    assert len(exact) <= len({r.doc_id for r in seen["toxicity"]}) and len(seen["near dedup"]) <= len(exact)
    size = sum(len(words(r.text)) for r in seen["near dedup"])
    assert sum(len(words(r.text)) for r in seen["mixing to target weights"]) == pytest.approx(size, abs=6)
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["mixing to target weights"]}
    whole = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert whole == sorted(map(tuple, seen["packing"]))
