import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskframe.llm import quality
from tests.llm.tables import documents, odd_rows, same, sentence, with_clashes, words

LABELS = "doc_id long, quality int, toxic int"


def base(text):
    text, w = text or "", words(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered), failed


def rows_of():
    import random

    rng = random.Random(1)
    rows = odd_rows()
    junk = " ".join(f"{x}***" for x in sentence(rng, 90).split())
    repeat = "a b c d\n" * 40
    rows += [(200 + i, t, "en", "a", 0) for i, t in enumerate((junk, repeat, "x y z " * 3 + sentence(rng, 60), "l1 l1\n\nl1 l1\n \nl2\nl2", sentence(rng, 300)))]
    return rows


def test_base_columns(spark):
    rows = rows_of()
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], LABELS)
    got = quality.quality_rules(documents(spark, rows), labels)
    have = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect())
    assert have == sorted((r[0], *base(r[1])) for r in rows)


def test_scores_equal_a_plain_count(spark):
    """With one bucket for each n-gram, scores are those of two plain multinomials."""
    rows = rows_of()
    trusted = {i for i in range(30)}
    buckets = 1 << 14
    got = {r.doc_id: r.score for r in quality.quality_rules(documents(spark, rows), spark.createDataFrame([(i, 1, 0) for i in trusted], LABELS), buckets).collect()}
    grams = lambda t: [(w,) for w in words(t)] + list(zip(words(t), words(t)[1:]))
    raw, good = Counter(), Counter()
    for r in rows:
        raw.update(grams(r[1]))
        if r[0] in trusted:
            good.update(grams(r[1]))
    ratio = lambda g: math.log((good[g] + 1) / (good.total() + buckets)) - math.log((raw[g] + 1) / (raw.total() + buckets))
    for r in rows:
        if len(words(r[1])) >= 50 and r[0] > 200:
            want = 1000 * sum(map(ratio, grams(r[1]))) / len(grams(r[1]))
            assert got[r[0]] == pytest.approx(want, abs=150)  # n-grams that share a bucket


def test_junk_goes_and_prose_stays(spark):
    import random

    rng = random.Random(2)
    common = [f"word{i}" for i in range(20)]  # few enough for all pairs to be common
    text = lambda: [rng.choice(common) for _ in range(200)]
    prose = [(i, " ".join(text()), "en", "a", 0) for i in range(60)]
    junk = [(100 + i, " ".join(x + "%%%" for x in text()), "en", "a", 0) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100, 0, 0), (None, 1, 0)], LABELS)
    got = {r.doc_id: r.kept for r in quality.quality_rules(documents(spark, prose + junk), labels).collect()}
    assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(20))


def test_no_labels_empty_and_clashes(spark):
    none = spark.createDataFrame([], LABELS)
    assert quality.quality_rules(documents(spark, []), none).collect() == []
    plain = quality.quality_rules(documents(spark), none)
    assert {r.score for r in plain.collect()} == {0.0}
    assert same(plain, quality.quality_rules(with_clashes(documents(spark)), none))
    assert re.search("Python", plain._jdf.queryExecution().executedPlan().toString()) is None


def test_bad_documents_go_in_a_large_vocabulary(spark):
    """Fixed buckets fill up: with many words, ratios tend to 0 and a fixed threshold keeps the bad documents."""
    import random

    rng = random.Random(4)
    text = lambda p, n: " ".join(f"{p}{rng.randrange(n)}" for _ in range(300))
    rows = [(i, text("w", 3000), "en", "a", 0) for i in range(600)] + [(1000 + i, text("j", 40_000), "en", "a", 0) for i in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(500)] + [(1000 + i, 0, 0) for i in range(20)], LABELS)
    got = {r.doc_id: r.kept for r in quality.quality_rules(documents(spark, rows), labels).collect()}
    assert all(got[i] for i in range(600)) and not any(got[1000 + i] for i in range(30))


def test_all_labelled_documents_count(spark):
    """No cap on the trusted documents; where they are many they are joined by id, with the same scores and threshold."""
    assert quality.trusted_ids(spark.range(20_500).selectExpr("id AS doc_id", "1 AS quality")).count() == 20_500
    docs, labels = documents(spark, rows_of()), spark.createDataFrame([(i, int(i < 20), 0) for i in range(30)], LABELS)
    good, bad = quality.trusted_ids(labels), quality.labelled_ids(labels, 0)
    sent, joined = (quality.Ratios(docs, good, 1 << 14, sent=n) for n in (1 << 20, 0))
    assert same(sent.scores(), joined.scores()) and sent.threshold(good, bad) == joined.threshold(good, bad)


@pytest.mark.parametrize("buckets", [None, 64, 1 << 14])
def test_only_n_grams_that_come_again_are_counted_by_document(spark, buckets):
    """Without a table of all (document, n-gram); copies of a row count as one document, as their key is the same."""
    rows = [*rows_of(), (900, "one", "en", "a", 0), (901, "", "en", "a", 0), (902, None, "en", "a", 0)]
    docs = quality.keyed(documents(spark, rows + rows[-9:] + rows[:3]).withColumn("is_good", F.col("doc_id") % 3 > 0), "is_good")
    got = quality.own_grams(docs.groupBy("k", "is_good", "text").agg(F.count("*").alias("copies")), buckets).collect()
    want = Counter((r.k, r.is_good, r.x) for r in quality.n_grams(docs, buckets, "is_good", "k").collect())
    have = Counter()
    for r in got:
        have[r.k, r.is_good, r.x] += r.copies
    assert have == want and max(want.values()) > 2
    assert all(r.again == (r.is_good and want[r.k, r.is_good, r.x] > 1) for r in got)
    lone = sum(not r.again for r in got)
    assert buckets == 64 or lone > len(got) / 3


@pytest.mark.parametrize("frequent", [1 << 20, 0])
def test_threshold_equals_that_of_a_plain_count(spark, frequent):
    """A trusted document is scored without its own n-grams, however often it holds them and however often its row comes."""
    rows = rows_of()
    docs = documents(spark, rows + rows[-5:] + rows[:4])
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(30)] + [(200, 0, 0), (201, 1, 0), (201, 0, 0), (204, 1, 0)], LABELS)
    good, bad = quality.trusted_ids(labels), quality.labelled_ids(labels, 0)
    ratios = quality.Ratios(docs, good, 1 << 12, frequent)
    ids = good.withColumn("is_good", F.lit(True)).unionByName(bad.withColumn("is_good", F.lit(False)))
    grams = quality.n_grams(docs.join(ids, "doc_id"), 1 << 12, "is_good")
    counts = {r.x: (r.good, r.raw) for r in ratios.counts.collect()}
    texts = {}
    for r in grams.collect():
        texts.setdefault((r.k, r.is_good), Counter())[r.x] += 1
    half_up = lambda v: math.copysign(math.floor(abs(v) + 0.5), v)
    ratio = lambda g, r: half_up(1000 * (math.log((g + 1) / ratios.trusted) - math.log((r + 1) / ratios.all_raw)))
    scores = {}
    for (_, is_good), own in texts.items():
        if own.total() >= 2 * quality.LEAST_WORDS - 1:
            total = sum(n * ratio(max(0, counts[x][0] - n * is_good), counts[x][1]) for x, n in own.items())
            scores.setdefault(half_up(total / own.total()), [0, 0])[not is_good] += 1
    assert len(scores) > 3 and all(map(sum, zip(*scores.values())))
    assert ratios.threshold(good, bad) == quality.parting([(s, *n) for s, n in sorted(scores.items())])


def test_threshold_of_labelled_scores():
    assert quality.parting([(-900, 0, 3), (-800, 0, 1), (-600, 2, 0), (-500, 5, 0)]) == -700
    assert quality.parting([(-5, 1, 0), (7, 199, 0)]) == 7 and quality.parting([]) == 0


def test_frequent_and_joined_ratios_agree(spark):
    docs = documents(spark, rows_of())
    good = quality.trusted_ids(spark.createDataFrame([(i, 1, 0) for i in range(30)], LABELS))
    all_sent, some, none = (quality.Ratios(docs, good, None, n) for n in (1 << 18, 100, 0))
    assert all_sent.least < some.least <= none.least
    assert same(all_sent.scores(), some.scores()) and same(some.scores(), none.scores())
