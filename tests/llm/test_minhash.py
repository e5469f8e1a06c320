import numpy as np
import pytest

from riskframe.llm import minhash
from tests.llm.tables import documents, odd_rows, same, with_clashes, words


def brute(rows, k, percent):
    """component of each row by all pairs."""

    def shingles(text):
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [(r[0], shingles(r[1])) for r in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_brute_force(spark, k, percent):
    rows = odd_rows()
    got = minhash.near_duplicates(documents(spark, rows), k, percent)
    assert sorted(map(tuple, got.collect())) == brute(rows, k, percent)


def test_chain_and_large_group(spark):
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join(base[i * 4 :] + [f"x{j}" for j in range(i * 4)]) for i in range(12)]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(chain)]
    rows += [(100 + i, " ".join([*base[:60], f"y{i}", *base[60:]]), "en", "a", 0) for i in range(40)]
    assert sorted(map(tuple, minhash.near_duplicates(documents(spark, rows), 3, 85).collect())) == brute(rows, 3, 85)


def test_empty_and_clashing_columns(spark):
    assert minhash.near_duplicates(documents(spark, [])).collect() == []
    docs = documents(spark)
    assert same(minhash.near_duplicates(with_clashes(docs)), minhash.near_duplicates(docs))
    kept = minhash.drop_near_copies(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns


def test_null_id(spark):
    rows = [(None, "a b c d e f", "en", "a", 1), (4, "a b c d e f", "en", "a", 1), (None, "", "en", "a", 1)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(documents(spark, rows), 3, 85).collect()}
    assert got[(4, 4)] == 4 and got[(None, 4)] == 4


def test_signature_is_circulant():
    maker = minhash.Circulant(20, 1)
    ring = np.append(maker.rows[:, 0], maker.rows[-1, 1:])
    hashes = np.arange(1, 50, dtype=np.uint64) * np.uint64(11400714819323198485)
    places = ((hashes * maker.first) >> np.uint64(64 - minhash.RING_BITS)).astype(int)
    size = 1 << minhash.RING_BITS
    assert [min(ring[(p + k) % size] for p in places) for k in range(20)] == maker.signature(hashes).tolist()


@pytest.mark.parametrize("threshold", [0.8, 0.85, 0.9])
def test_band_plan_misses_little(threshold):
    rows, bands = minhash.band_plan(threshold)
    assert (1 - threshold**rows) ** bands <= minhash.MISS
