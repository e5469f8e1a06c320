import random
import zlib

from riskframe.llm import toxicity
from tests.llm.tables import documents, same, sentence, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def rows_of(n=400, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = sentence(rng, rng.randrange(20, 120)).split()
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(("blork", "snarf", "grumbo" + rng.choice("xyzabc") + rng.choice("xyz"))))
        rows.append((i, " ".join(w) + ".", "en", "a", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = rows_of()
    got = toxicity.toxicity(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    test = [(r.predicted, r.doc_id % 4 == 0) for r in got if r.held_out]
    assert sum(p == t for p, t in test) / len(test) > 0.95


def test_copies_teach_no_words(spark):
    rows, labels = rows_of()
    copy = "zebrafish quagmire " + rows[0][1]
    rows += [(1000 + i, copy, "en", "a", 0) for i in range(40)]
    labels += [(1000 + i, 1, 1) for i in range(40)]
    words, stems, _ = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, LABELS))
    assert "blork" in words and "grumbo" in stems and "zebrafish" not in words


def test_clauses():
    g = toxicity.Grammar({"blork": 5.0}, {"grum": 3.0})
    clause = lambda text: g.clause(toxicity.WORDS.findall(text))
    assert clause("what a blork") == (5.0, 0, 0, 0, 0)
    assert clause("you are a blork") == (0, 5.0, 0, 0, 0)
    assert clause("this is not a blork") == (0, 0, 5.0, 0, 0)
    assert clause("someone said blork") == (0, 0, 0, 5.0, 0)
    assert clause('the word "blork" is old') == (0, 0, 0, 5.0, 0)
    assert clause("i will hurt you") == (0, 0, 0, 0, 1.0) and clause("i will not hurt you")[4] == 0
    assert clause("grumpy old") == (3.0, 0, 0, 0, 0) and clause("grum") == (0, 0, 0, 0, 0)
    assert any(g.features("A. You blork!")) and not any(g.features("")) and not any(g.features("fine words"))


def test_nulls_empty_clashes_and_missing_labels(spark):
    rows, labels = rows_of(200)
    rows += [(900, None, "en", "a", 0), (901, "", "en", "a", 0), (None, "x", "en", "a", 0), (902, "blork " * 50_000, "en", "a", 0), rows[4]]
    docs, marks = documents(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], LABELS)
    got = toxicity.toxicity(docs, marks)
    assert got.count() == len(rows) and got.where("score IS NULL OR held_out IS NULL").count() == 0
    assert {r.doc_id: r.predicted for r in got.collect()}[902] == 1
    assert same(got, toxicity.toxicity(with_clashes(docs), marks))
    kept = toxicity.drop_toxic(with_clashes(docs), marks)
    assert kept.columns == with_clashes(docs).columns
    assert kept.count() == got.where("predicted = 0").count()
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.toxicity(documents(spark, []), none).collect() == []
