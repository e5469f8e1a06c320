"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make a whole signature: the first scatters shingle hashes over a ring, the second is a table of ranks
on the ring, and signature coordinate k is the least rank among the shingles after a circular shift by k.  One table row
of consecutive ranks per shingle therefore serves all coordinates.  Coordinates are cut into bands; documents that agree
in a band become candidates, and links are confirmed on the full shingle sets.

Documents with equal sets are one node, so copies are combined before anything moves.  A bucket never lists all its
pairs: each of its nodes is first compared with the bucket's hub, and linked nodes are contracted to components.  Buckets
that still hold several components are cut into blocks; tasks compare the sets of two blocks at a time and hand on the
links that join components.  The component is the result, and pairs that are left out lie inside one already.

Null or empty texts and texts without words have no shingles and no links.  Repeated rows have equal sets and share a
component.  A null doc_id never names a component that has another id.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import text_or_empty, written

RING_BITS = 20
#: Most bands, and the chance that a pair at the threshold shares none of them.
MOST_BANDS, MISS = 40, 1e-6
#: Rounds in which nodes are compared with hubs only.
HUB_ROUNDS = 2
#: Rows, and numbers in their shingle sets, of a block of a bucket.
BLOCK_ROWS, BLOCK_NUMBERS = 1_000, 2_000_000
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class WordHashes(dict):
    """Hashes of words seen lately; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle."""
    found = text.encode("utf-8", "surrogatepass").translate(UPPER).split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : len(h) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_plan(threshold: float) -> tuple[int, int]:
    """(rows, bands): the longest bands of which at most MOST_BANDS keep the chance of a miss."""
    best = (1, MOST_BANDS)
    for rows in range(1, 13):
        bands = math.ceil(math.log(MISS) / math.log(1 - threshold**rows))
        if bands <= MOST_BANDS:
            best = (rows, bands)
    return best


class Circulant:
    """Signatures of ``keep`` coordinates."""

    def __init__(self, keep: int, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        ranks = rng.permutation(1 << RING_BITS).astype(np.uint32)
        ring = np.concatenate([ranks, ranks[: keep - 1]])
        self.rows = np.lib.stride_tricks.sliding_window_view(ring, keep)
        self.first = np.uint64(rng.integers(1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        places = ((hashes * self.first) >> np.uint64(64 - RING_BITS)).astype(np.int64)
        out = self.rows[places[0]].copy()
        for i in range(0, len(places), 1024):
            np.minimum(out, self.rows[places[i : i + 1024]].min(axis=0), out=out)
        return out


def band_keys(signatures: np.ndarray, rows: int, bands: int, seed: int) -> np.ndarray:
    """A 64-bit key per document and band; equal keys only for equal coordinates of the same band."""
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    factors = rng.integers(1 << 62, size=rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = signatures.astype(np.uint64) * factors
    mixed ^= mixed >> np.uint64(31)
    return (mixed * factors[::-1]).reshape(len(signatures), bands, rows).sum(axis=2, dtype=np.uint64).view(np.int64)


FEATURES = "doc_id long, n_shingles long, set_id binary, bands array<long>, low binary"


def features(docs: DataFrame, k: int, threshold: float, seed: int) -> DataFrame:
    """Per row: size and digest of its shingle set, band keys, and the low byte of each coordinate."""
    rows, bands = band_plan(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, hashes = Circulant(rows * bands, seed), WordHashes()
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                piece = batch.slice(part, 2000)
                sizes, ids, signatures, has = [], [], [], []
                for text in piece.column(1).to_pylist():
                    found = shingles(text, k, hashes)
                    sizes.append(len(found))
                    has.append(len(found) > 0)
                    ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    if len(found):
                        signatures.append(maker.signature(found))
                matrix = np.array(signatures, np.uint32).reshape(-1, rows * bands)
                keys = iter(band_keys(matrix, rows, bands, seed))
                low = iter((matrix & np.uint32(255)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([next(keys) if x else None for x in has], pa.list_(pa.int64())),
                        pa.array([next(low).tobytes() if x else None for x in has], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_id", "bands", "low"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, FEATURES)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) edges, root the smallest node it reaches.  Alternates the large-star and
    small-star steps; each pass is written, and a pass that changes nothing ends it."""
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links, before = written(links, "links"), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
        links = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def alike(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose signatures agree often enough; the margin of 7 deviations loses none at the threshold."""
    rows, bands = band_plan(threshold)
    keep = rows * bands
    least = math.floor(threshold * keep - 7 * math.sqrt(keep * threshold * (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, keep) for i in (2, 3))
            good = (left == right).sum(axis=1) >= least
            yield batch.select([0, 1]).filter(pa.array(good))

    low = nodes.select("node", "low")
    both = pairs.join(low.toDF("a", "low_a"), "a").join(low.toDF("b", "low_b"), "b")
    return both.select("a", "b", "low_a", "low_b").mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, hashes) of the wanted documents: their sorted distinct shingles."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(t, k, hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.large_binary())], names=["node", "hashes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), text_or_empty().alias("text"))
    # The wanted ids have no size bound, so they are never broadcast.
    return texts.join(wanted.hint("merge"), "node", "left_semi").mapInArrow(sets, "node long, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full shingle sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(left) > len(right):
                    left, right = right, left
                at = np.searchsorted(right, left)
                both = int((right[np.minimum(at, len(right) - 1)] == left).sum())
                good.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
    return both.select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def block_links(nodes: list[int], roots: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different components within a block, or between its two sides, on full sets.

    One link for each two components that meet is enough.  Nodes of the largest component are only looked up."""
    sizes = np.array([len(x) for x in sets])
    flat, starts = np.unique(np.concatenate(sets), return_inverse=True)[1], np.concatenate([[0], np.cumsum(sizes)[:-1]])
    marks, label, side = np.zeros(int(flat.max()) + 1, bool), np.array(roots), np.array(sides)
    values, counts = np.unique(label, return_counts=True)
    largest, found = values[counts.argmax()], []
    for i in np.flatnonzero(label != largest):
        own = flat[starts[i] : starts[i] + sizes[i]]
        marks[own] = True
        both = np.add.reduceat(marks[flat].astype(np.int64), starts)
        marks[own] = False
        close = 100 * both >= percent * (sizes + sizes[i] - both)
        if sides[0] != sides[-1]:
            close &= side != side[i]
        for j in np.flatnonzero(close & (label != label[i])):
            if label[j] != label[i]:
                found.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
    return found


def block_pairs(buckets: DataFrame, sets: DataFrame, percent: int, rows: int = BLOCK_ROWS, numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """Links between different components that share a bucket.  A bucket is cut into blocks of bounded rows and set
    sizes; every two blocks meet in one group, which compares their sets and hands on joining links only."""
    size = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("c") / rows), F.ceil(F.col("total") / numbers)).cast("int")
    placed = buckets.join(size.select("key", blocks.alias("blocks")), "key")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")

    def check(table: pa.Table) -> pa.Table:
        table = table.sort_by([("own", "ascending"), ("node", "ascending")])
        nodes, roots, sides = (table.column(c).to_pylist() for c in ("node", "root", "own"))
        found = []
        if min(roots) < max(roots):
            hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
            found = block_links(nodes, roots, sides, hashes, percent)
        columns = list(zip(*found)) or [(), ()]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return placed.join(sets, "node").groupBy("key", "i", "j").applyInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, seed: int = 7) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A doc_id names a document; should rows with different texts share one, links of either text are links of the id."""
    threshold = percent / 100
    rows = written(features(docs, k, threshold, seed), "features")
    groups = rows.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id")
    nodes = written(groups.agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("low").alias("low")), "nodes")
    members = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    buckets = written(members.join(shared, "key").withColumn("root", F.col("node")), "buckets")
    # Nodes of many and full buckets are central: most others differ least from them.
    central = buckets.groupBy("node").agg(F.sum("c").alias("weight"))
    buckets = written(buckets.drop("c").join(central, "node"), "buckets")
    sets = written(shingle_sets(docs.select("doc_id", "text"), buckets.select("node").distinct(), k), "sets")
    close = 100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")
    links = None
    for turn in range(HUB_ROUNDS):
        order = F.col("weight") if turn == 0 else F.xxhash64(F.lit(turn), "node")
        hubs = buckets.groupBy("key").agg(F.max(F.struct(order.alias("h"), "node", "n", "root")).alias("hub")).select("key", "hub.*").toDF("key", "h", "b", "n_b", "root_b")
        pairs = buckets.join(hubs, "key").where((F.col("root") != F.col("root_b")) & close)
        pairs = written(pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), "pairs")
        found = confirmed(alike(pairs, nodes, threshold), sets, percent)
        links = rooted(found if links is None else links.unionByName(found))
        # Only buckets that still hold several components are looked at again.
        placed = buckets.join(links.toDF("node", "new"), "node", "left").withColumn("root", F.coalesce("new", "root")).drop("new")
        mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        buckets = written(placed.join(mixed, "key", "left_semi"), "buckets")
    links = rooted(links.unionByName(block_pairs(buckets, sets, percent)))
    labels = nodes.join(links.toDF("node", "root"), "node", "left").select("set_id", F.coalesce("root", "node").alias("root"))
    out = rows.join(labels, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def rooted(links: DataFrame) -> DataFrame:
    """Links from every node that has any to the root of its component."""
    return written(components(written(links, "confirmed")).select(F.col("node").alias("a"), F.col("root").alias("b")), "roots")


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with the columns of the input."""
    gone = near_duplicates(docs, k, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
