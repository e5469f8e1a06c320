import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from riskframe.llm import merkle
from tests.llm.tables import DOCS, documents, odd_rows, same, with_clashes


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(row, change=False):
    doc_id, text, lang, source, n_chars = row
    if change and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sha("".join(map(enc, (doc_id, source, lang, n_chars, text))))


def plain_tree(nodes):
    """Root, and for each node the siblings of its way up as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            lo = i // 16 * 16
            paths[k].append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 16])))
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def plain(rows):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        by[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[source] = plain_tree([plain_leaf(r) for r in by[source]])
    root, upper = plain_tree([trees[s][0] for s in order])
    out = []
    for k, source in enumerate(order):
        for row, path in zip(by[source], trees[source][1]):
            path = path + upper[k]
            node = plain_leaf(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0)
            for left, right in path:
                node = sha(left + node + right)
            proof = sha("".join(a + b for a, b in path))
            out.append((row[0], plain_leaf(row), trees[source][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in merkle.document_manifest(df).collect()), key=repr)


def test_odd_rows_as_a_plain_tree(spark):
    rows = odd_rows() + [(None, "No Key", None, None, None), (None, None, None, "a", 3)]
    got = found(with_clashes(documents(spark, rows)).repartition(3))
    assert got == plain(rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("sizes", [(1,), (1, 2, 16, 17), (15, 256, 257), (4097, 33, 1)])
def test_every_depth(spark, sizes):
    rows = [(i * 7 + s, f"Text {i}", "en", f"s{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    assert found(documents(spark, rows).repartition(5)) == plain(rows)


def test_many_groups(spark):
    rows = [(i, "x", None, f"g{i:04d}", 1) for i in range(600)]
    assert found(documents(spark, rows)) == plain(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], DOCS)) == []


def test_partitions_do_not_matter(spark):
    rows = odd_rows(80)
    assert same(merkle.document_manifest(documents(spark, rows).repartition(1)), merkle.document_manifest(documents(spark, rows).repartition(9)))


def test_one_changed_row_breaks_only_its_proof(spark):
    rows = [(i, f"t{i}", "en", "s", 1) for i in range(300)]
    leaves = documents(spark, rows).select("doc_id", "source", merkle.leaf([F.col("text")]).alias("leaf"))
    whole = merkle.manifest(leaves, "doc_id", "source")
    bad = F.when(F.col("doc_id") == 123, merkle.leaf([F.lit("other")])).otherwise(F.col("leaf"))
    failed = whole.where(merkle.folded(bad, F.col("path")) != F.col("root")).collect()
    assert [r["doc_id"] for r in failed] == [123]
