import pytest

from riskframe.llm import mixing
from tests.llm.tables import documents, odd_rows, same, with_clashes, words


def targets(sizes, weights, most):
    """Shares by repeated resharing."""
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        weight = sum(weights[s] for s in open_)
        share = {s: rest * weights[s] / weight for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {**{s: most * sizes[s] for s in full}, **share}
        full |= over


def check(rows, got, most=3):
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, most)
    taken: dict = {}
    for r in got:
        assert 0 <= r.taken <= most * r.size
        taken[r.target] = taken.get(r.target, 0) + r.taken
    assert len(got) == len(rows)
    for s in sizes:
        near = min(taken, key=lambda t: abs(t - want[s]))
        assert near == pytest.approx(want[s])
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), abs=len(sizes))


def test_targets_and_taken(spark):
    rows = odd_rows()
    check(rows, mixing.mixed_sizes(mixing.mix_sources(documents(spark, rows))).collect())


def test_small_sources_are_full(spark):
    rows = [(i, "w " * 100, "en", "big", 200) for i in range(50)] + [(90, "w w", "en", "a", 3), (91, "w", "en", "c", 1), (92, None, "en", "z", None)]
    got = mixing.mixed_sizes(mixing.mix_sources(documents(spark, rows))).collect()
    check(rows, got)
    assert {r.doc_id: r.taken for r in got}[90] == 6


def test_order_is_weighted_fair(spark):
    rows = [(i, "w " * 10, "en", "ab"[i % 2], 20) for i in range(60)]
    mix = sorted(mixing.mix_sources(documents(spark, rows)).where("taken > 0").collect(), key=lambda r: r.position)
    served = {"a": 0, "b": 0}
    for r in mix:
        served[r.source] += r.taken
        assert abs(served["a"] * 2 - served["b"]) <= 30
    assert [r.position for r in mix] == [10 * i for i in range(60)]


def test_documents_of_the_mix(spark):
    docs = with_clashes(documents(spark))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    want = mixing.mixed_sizes(mixing.mix_sources(docs)).agg({"taken": "sum"}).first()[0]
    assert sum(len(words(r.text)) for r in out.collect()) == want
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert same(out, mixing.mixed_documents(docs.repartition(7)))


def test_empty(spark):
    empty = documents(spark, [])
    assert mixing.mixed_sizes(mixing.mix_sources(empty)).collect() == []
    assert mixing.mixed_documents(empty).collect() == []
    no_words = documents(spark, [(1, None, "en", None, 0), (2, " ", "en", "a", 1)])
    assert {r.taken for r in mixing.mixed_sizes(mixing.mix_sources(no_words)).collect()} == {0}
