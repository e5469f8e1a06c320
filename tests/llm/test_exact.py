import hashlib
import re

import pytest
from pyspark.sql import functions as F

from riskframe.llm import exact
from tests.llm.tables import documents, odd_rows, same, with_clashes


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("capacity", [1, 5, 50_000])
def test_brute_force(spark, capacity):
    rows = odd_rows()
    groups: dict = {}
    for r in rows:
        groups.setdefault(normal(r[1]), []).append(r[0])
    want = sorted((r[0], min(groups[normal(r[1])]), len(groups[normal(r[1])]), hashlib.sha256(normal(r[1]).encode()).hexdigest()) for r in rows)
    got = exact.exact_dedup(documents(spark, rows), capacity)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()) == want
    assert got.where("kept").count() == len(groups) and got.where("kept AND doc_id <> keep_id").count() == 0


def test_directory_splits_and_covers(spark):
    keys = spark.range(300).select(F.xxhash64("id").alias("key"))
    slots = exact.directory(keys, 10).collect()
    depth = slots[0].global_depth
    assert depth > 5 and len({s.slot for s in slots}) == len(slots)
    owner = {s.slot: (s.bucket, s.depth) for s in slots}
    sizes: dict = {}
    for (key,) in keys.collect():
        place = owner[(key % 2**64) >> (64 - depth)]
        sizes[place] = sizes.get(place, 0) + 1
    assert max(sizes.values()) <= 10


@pytest.mark.parametrize("wrong", ["slot < 3", "bucket <> 5"])
def test_groups_come_from_the_buckets_of_the_directory(spark, monkeypatch, wrong):
    """Rows without a slot have no bucket, and so no group."""
    rows = [(i, f"text {i % 40}", "en", "a", 0) for i in range(80)]
    assert exact.exact_dedup(documents(spark, rows), 4).count() == 80
    whole = exact.directory
    monkeypatch.setattr(exact, "directory", lambda entries, capacity: whole(entries, capacity).where(wrong))
    assert 0 < exact.exact_dedup(documents(spark, rows), 4).count() < 80


def test_chains_compare_bytes(spark, monkeypatch):
    """With one key for all texts, one chain holds them all and only the bytes tell them apart."""
    rows = [(i, f"text {i % 7}", "en", "a", 0) for i in range(50)]
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.lit(0).cast("long"))
    _, index = exact.build_index(documents(spark, rows), 3)
    found = index.collect()
    assert sorted(r["chain"] for r in found) == list(range(1, 8)) and sorted(r["keep_id"] for r in found) == list(range(7))
    assert exact.exact_dedup(documents(spark, rows), 3).where("kept").count() == 7


def test_copies_are_combined_before_they_move(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}", "en", "a", 0) for i in range(3000)]
    got = exact.exact_dedup(documents(spark, rows).repartition(20))
    assert got.where("text_sha256 = sha2('the same text', 256)").select("group_size", "keep_id").distinct().collect() == [(2000, 1)]


def test_drop_copies(spark):
    docs = documents(spark)
    kept = exact.drop_copies(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns
    assert kept.count() == len({normal(r[1]) for r in odd_rows()})
    assert same(exact.drop_copies(kept), kept)


def test_empty(spark):
    assert exact.exact_dedup(documents(spark, [])).collect() == []
    assert exact.drop_copies(documents(spark, [])).collect() == []
