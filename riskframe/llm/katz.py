"""Katz backoff language model: Good-Turing discounted n-gram counts, exactly normalised backoff weights, scores per text.

Tasks tokenise the corpus into blocks of about a million tokens.  A block asks for its distinct n-grams of every order at the
partition of the count table that owns their 64-bit hashes; a partition adds up the training counts of all blocks and
answers each block in the order it asked.  One block per n-gram is named its reporter: reporters add up, per context, the
discounted probability of the followers and their lower-order probability, from which come the exact backoff weights
alpha(h) = (1 - sum P*(w|h)) / (1 - sum P(w|h')).  Every token is then scored from the longest context down: a seen n-gram
ends the recursion, an unseen one costs alpha of its context and goes on with the context one word shorter.  Contexts that
training has not seen cost nothing.  A word that training has not seen gets what Good-Turing leaves of the single words.

What moves: some six bytes per distinct (block, n-gram), their counts on the way back, a row per (block, context).  A
frequent n-gram is one entry per block, wherever it occurs; texts are read once.

Discounts: d_r of Katz for counts up to 5 (the largest cut at which all of them lie between 0 and 1); larger counts lose
what a count at the cut loses, so that every context keeps some mass for words it has not seen.  Where the counts of
counts allow no cut, every count loses n1 / (n1 + 2 n2), kept within 0.1 and 0.9.

Defined results: a null or empty text is its end token alone; a null id is hashed as the empty string by the caller's rule;
repeated rows are scored and counted as often as they stand there; an empty table gives no rows, a table without training
rows gives every token probability 1.  A text is held in one task, whole.  Other columns, whatever their names, go no
further.  Two n-grams with one hash would share a count (chance of n^2 / 2^65 over n distinct ones).
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import text_or_empty, written
from riskframe.session import scratch_path

ORDER = 2
#: Tokens of a block, and (block, n-gram) entries a partition of the count table is laid out for.
BLOCK_TOKENS = 1_000_000
OWNED = 1_000_000
CUT = 5
START, END = 0, 1
MARKS = [xxhash.xxh3_64_intdigest(b" start"), xxhash.xxh3_64_intdigest(b" end")]  # words hold no blank

BLOCKS = "block long, ids array<long>, held array<boolean>, sizes array<long>, trained long, tokens binary, vocabulary binary"
ASKS = "level int, bucket int, block long, keys binary, counts binary"
ANSWERS = "block long, level int, bucket int, counts binary, stats array<long>"
FOUND = (
    "kind int, block long, doc int, id long, held boolean, n_tokens long, n_known long, base double, score double, "
    "key long, high double, low double, times long"
)


# --- packing of whole numbers -------------------------------------------------------------------------------------------


def planes(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as byte planes, as many as the largest one needs; the first byte is their number."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    digits = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(digits.T).tobytes()


def numbers(packed: bytes) -> np.ndarray:
    width = packed[0]
    digits = np.frombuffer(packed, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((digits.shape[1], 8), np.uint8)
    out[:, :width] = digits.T
    return out.view("<u8").ravel()


# --- blocks ---------------------------------------------------------------------------------------------------------------


class Numbered(dict):
    """Numbers of words in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def packed_block(number: int, ids: list, held: list[bool], lines: list[np.ndarray], seen: Numbered) -> dict:
    """A block of texts as lines of word numbers: renumbered by falling frequency, with the hash of each word."""
    flat = np.concatenate([np.append(x, np.int32(-1)) for x in lines]) + 1  # the end of a text is 0
    frequency = np.bincount(flat, minlength=len(seen) + 1)[1:]
    order = np.argsort(-frequency, kind="stable")
    place = np.empty(len(seen) + 1, np.uint32)
    place[0], place[1 + order] = END, np.arange(len(seen), dtype=np.uint32) + 2
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in seen), np.uint64, len(seen))
    return {
        "block": number,
        "ids": ids,
        "held": held,
        "sizes": [len(x) + 1 for x in lines],
        "trained": sum(not h for h in held),
        "tokens": zlib.compress(planes(place[flat]), 1),
        "vocabulary": np.concatenate([np.array(MARKS, np.uint64), hashes[order]]).tobytes(),
    }


def blocks_of(block_tokens: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tokens = TaskContext.get().partitionId() << 32, 0
        ids, held, lines, seen = [], [], [], Numbered()
        for batch in batches:
            for at in range(batch.num_rows):
                key, is_held, text = (c[at].as_py() for c in batch.columns)
                words = text.encode().lower().split()  # bytes: A-Z, and the six kinds of white space, no others
                ids.append(key)
                held.append(is_held)
                lines.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                tokens += len(words) + 1
                if tokens >= block_tokens:
                    yield pa.RecordBatch.from_pylist([packed_block(number, ids, held, lines, seen)], schema)
                    number, tokens = number + 1, 0
                    ids, held, lines, seen = [], [], [], Numbered()
        if ids:
            yield pa.RecordBatch.from_pylist([packed_block(number, ids, held, lines, seen)], schema)

    return run


BLOCK_SCHEMA = pa.schema(
    [
        ("block", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("held", pa.list_(pa.bool_())),
        ("sizes", pa.list_(pa.int64())),
        ("trained", pa.int64()),
        ("tokens", pa.binary()),
        ("vocabulary", pa.binary()),
    ]
)


def mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hash of (hash of the context, hash of the word)."""
    with np.errstate(over="ignore"):
        x = context * np.uint64(0x9E3779B97F4A7C15) + word
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """The token line of a block, each text behind a start mark, and the n-grams that end at each place."""

    def __init__(self, sizes: list[int], held: list[bool], tokens: bytes, vocabulary: bytes):
        self.sizes = np.array(sizes, np.int64)
        starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes + 1)
        self.offset = (np.arange(len(self.doc)) - np.repeat(starts, self.sizes + 1)).astype(np.uint32)
        line = np.zeros(len(self.doc), np.uint32)
        line[self.offset > 0] = numbers(zlib.decompress(tokens))
        self.words = np.frombuffer(vocabulary, np.uint64)[line]
        self.held = np.array(held, bool)[self.doc]

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(order, hash of the n-gram that ends at each place, places where there is one)."""
        keys = self.words
        for n in range(1, order + 1):
            if n > 1:
                keys = np.append(np.uint64(0), mixed(keys[:-1], self.words[1:])) if len(keys) else keys
            yield n, keys, np.flatnonzero(self.offset >= max(1, n - 1))


def cut_points(bits: int) -> np.ndarray:
    return np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)


def asked(order: int, bits: int):
    """Rows of ASKS: the distinct n-grams of a block by owner, with twice the training count, plus 1 if a held-out text
    has the n-gram."""
    schema = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["sizes"], row["held"], row["tokens"], row["vocabulary"])
                for n, keys, at in block.grams(order):
                    distinct, where = np.unique(keys[at], return_inverse=True)
                    held = block.held[at]
                    counts = 2 * np.bincount(where[~held], minlength=len(distinct)).astype(np.uint64)
                    counts[where[held]] |= np.uint64(1)
                    edges = [0, *np.searchsorted(distinct, cut_points(bits)), len(distinct)]
                    out = []
                    for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
                        if hi > lo:
                            base = np.uint64(b << (64 - bits)) if bits else np.uint64(0)
                            gaps = np.diff(distinct[lo:hi], prepend=base)
                            out.append({"level": n, "bucket": b, "block": row["block"], "keys": planes(gaps), "counts": planes(counts[lo:hi])})
                    yield pa.RecordBatch.from_pylist(out, schema)

    return run


def answered(bits: int):
    """Rows of ANSWERS for one partition of the count table: per block 4 * training count + 2 if this block reports the
    n-gram + 1 if held-out texts have it; and one row (block -1) of tokens, types and counts of counts."""
    schema = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))])

    def run(group: tuple, table: pa.Table) -> pa.Table:
        level, bucket = group[0].as_py(), group[1].as_py()
        rows = table.sort_by("block").select(["block", "keys", "counts"]).to_pylist()
        base = np.uint64(bucket << (64 - bits)) if bits else np.uint64(0)
        with np.errstate(over="ignore"):
            keys = [np.cumsum(numbers(r["keys"]), dtype=np.uint64) + base for r in rows]
        counts = np.concatenate([numbers(r["counts"]) for r in rows])
        everything = np.concatenate(keys)
        order = np.argsort(everything, kind="stable")  # equal n-grams by block
        line = everything[order]
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        total = np.add.reduceat(counts[order] >> np.uint64(1), first)
        held = np.bitwise_or.reduceat(counts[order] & np.uint64(1), first)
        group_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(line))))
        has = np.flatnonzero(counts[order] > 1)  # entries with training counts; the first of each n-gram reports it
        reports = np.zeros(len(line), np.uint64)
        reports[has[np.unique(group_of[has], return_index=True)[1]]] = 1
        values = np.empty(len(line), np.uint64)
        values[order] = (total[group_of] << np.uint64(2)) | (reports << np.uint64(1)) | held[group_of]
        seen = total[total > 0].astype(np.int64)
        stats = [int(seen.sum()), len(seen), *np.bincount(np.minimum(seen, CUT + 2), minlength=CUT + 3)[1 : CUT + 2].tolist()]
        parts = np.split(values, np.cumsum([len(k) for k in keys])[:-1])
        out = [{"block": r["block"], "level": level, "bucket": bucket, "counts": planes(p)} for r, p in zip(rows, parts)]
        out.append({"block": -1, "level": level, "bucket": bucket, "stats": stats})
        return pa.Table.from_pylist(out, schema)

    return run


# --- probabilities --------------------------------------------------------------------------------------------------------


class Discounts:
    """Discounted counts of one order, from the counts of counts n_1 .. n_(CUT + 1)."""

    def __init__(self, tokens: int, types: int, counts_of_counts: list[int]):
        self.tokens, self.types = tokens, types
        n = [0, *counts_of_counts]
        self.cut, self.kept = 0, []
        for k in range(min(CUT, len(n) - 2), 1, -1):
            rest = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
            if rest >= 1 or not all(n[1 : k + 2]):
                continue
            kept = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, k + 1)]
            if all(0 < d < 1 for d in kept):
                self.cut, self.kept = k, kept
                break
        both = (n[1] + 2 * n[2]) if len(n) > 2 else 0
        self.loss = self.cut * (1 - self.kept[-1]) if self.cut else min(0.9, max(0.1, n[1] / both if both else 0.5))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts (of counts from 1)."""
        counts = np.asarray(counts, float)
        out = counts - self.loss
        for r, d in enumerate(self.kept, 1):
            out[counts == r] = r * d
        return out

    def left(self, counts_of_counts: list[int]) -> float:
        """Share of all tokens that the discounts set free: the probability of a word not seen."""
        if not self.tokens:
            return 1.0
        low = counts_of_counts[: self.cut]
        freed = sum(n * r * (1 - d) for r, (n, d) in enumerate(zip(low, self.kept), 1))
        return (freed + self.loss * (self.types - sum(low))) / self.tokens


class Model:
    """What every task needs to know besides the answers: totals and discounts per order, a few dozen numbers."""

    def __init__(self, order: int, stats: dict[int, list[int]], trained: int):
        nothing = [0] * (CUT + 3)
        rows = {n: stats.get(n, nothing) for n in range(1, order + 1)}
        self.order, self.trained = order, trained
        self.discounts = {n: Discounts(r[0], r[1], r[2:]) for n, r in rows.items()}
        self.tokens, self.types = rows[1][:2]
        self.unseen = self.discounts[1].left(rows[1][2:])


def scored_block(block: Block, answers: dict[int, np.ndarray], model: Model) -> tuple[dict, dict, dict]:
    """Per text: tokens, known tokens, base and score without weights; per (text, context): weights it needs; per context
    that held-out texts have: the parts of its weight from the n-grams this block reports."""
    size, texts = len(block.doc), len(block.sizes)
    narrow = np.uint32 if model.tokens < 1 << 32 else np.uint64
    keys, count, flags, sums, needs = {}, {}, {}, [], []

    def context(n: int, at: np.ndarray) -> np.ndarray:
        """Training count of the context of the n-grams that end at the places ``at``."""
        if n == 1:
            return np.full(len(at), float(model.tokens))
        out = count[n - 1][at - 1].astype(float)
        if n == 2:
            out[block.offset[at] == 1] = model.trained
        return out

    for n, key, at in block.grams(model.order):
        distinct, first, where = np.unique(key[at], return_index=True, return_inverse=True)
        answer = answers.get(n, np.zeros(0, np.uint64))
        keys[n], count[n], flags[n] = key, np.zeros(size, narrow), np.zeros(size, bool)
        count[n][at] = (answer >> np.uint64(2)).astype(narrow)[where]
        flags[n][at] = (answer & np.uint64(1)).astype(bool)[where]
        del distinct, where
        if n == 1:
            continue
        # parts of the backoff weight of the context, where the n-gram is this block's to report
        reported = at[first[((answer >> np.uint64(1)) & np.uint64(1)).astype(bool)]]
        reported = reported[flags[n - 1][reported - 1] | (block.offset[reported] == 1)]
        high = model.discounts[n](count[n][reported]) / context(n, reported)
        low = model.discounts[n - 1](count[n - 1][reported]) / context(n - 1, reported)
        owner, which = np.unique(keys[n - 1][reported - 1], return_inverse=True)
        sums.append((owner, np.bincount(which, high, len(owner)), np.bincount(which, low, len(owner))))
        del first, reported, high, low, which
    words = np.flatnonzero(block.offset > 0)
    own = block.doc[words]
    known = count[1][words]
    base = np.bincount(own, np.log10((known + 1.0) / (model.tokens + model.types + 1)), texts)
    n_known = np.bincount(own[known > 0], minlength=texts)
    del words, own, known
    score, open_ = np.zeros(texts), block.offset > 0
    for n in range(model.order, 0, -1):
        here = np.flatnonzero(open_ & (block.offset >= max(1, n - 1)))
        seen = count[n][here] > 0
        hit, missed = here[seen], here[~seen]
        score += np.bincount(block.doc[hit], np.log10(model.discounts[n](count[n][hit]) / context(n, hit)), texts)
        open_[hit] = False
        if n == 1:
            score += np.bincount(block.doc[missed], minlength=texts) * math.log10(model.unseen) if len(missed) else 0.0
        else:
            backing = missed[context(n, missed) > 0]
            needs.append((block.doc[backing], keys[n - 1][backing - 1]))
    pairs = np.concatenate([k for _, k in needs]) if needs else np.zeros(0, np.uint64)
    docs = np.concatenate([d for d, _ in needs]) if needs else np.zeros(0, np.int32)
    order = np.lexsort((pairs, docs))
    pairs, docs = pairs[order], docs[order]
    new = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]) | (docs[1:] != docs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(pairs)))
    per_text = {"n_tokens": block.sizes, "n_known": n_known.astype(np.int64), "base": base, "score": score}
    per_need = {"doc": docs[new], "key": pairs[new], "times": times}
    joined = [np.concatenate(x) for x in zip(*sums)] if sums else [np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)]
    return per_text, per_need, dict(zip(("key", "high", "low"), joined))


def scored(model: Model):
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in FOUND.split(", ")])

    def batch_of(kind: int, block: int, columns: dict, n: int) -> pa.RecordBatch:
        columns = columns | {"kind": np.full(n, kind, np.int32), "block": np.full(n, block, np.int64)}
        if "key" in columns:
            columns["key"] = columns["key"].view(np.int64)
        arrays = [pa.array(columns[c], schema.field(c).type) if c in columns else pa.nulls(n, schema.field(c).type) for c in names]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row["sizes"], row["held"], row["tokens"], row["vocabulary"])
                parts = defaultdict(list)
                for a in sorted(row["answers"] or [], key=lambda a: (a["level"], a["bucket"])):
                    parts[a["level"]].append(numbers(a["counts"]))
                answers = {n: np.concatenate(x) for n, x in parts.items()}
                per_text, per_need, per_context = scored_block(block, answers, model)
                n = len(row["ids"])
                per_text |= {"doc": np.arange(n, dtype=np.int32), "id": row["ids"], "held": row["held"]}
                yield batch_of(0, row["block"], per_text, n)
                per_need["doc"] = per_need["doc"].astype(np.int32)
                yield batch_of(1, row["block"], per_need, len(per_need["key"]))
                yield batch_of(2, row["block"], per_context, len(per_context["key"]))

    return run


# --- jobs -----------------------------------------------------------------------------------------------------------------


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """The table in the shared folder, in buckets of ``key``: a later join on it moves the other side only."""
    spark, name = df.sparkSession, f"katz_{uuid.uuid4().hex}"
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(width, key).option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    return spark.table(name), name


def score_texts(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Scores of every row by the model that the rows without ``held`` train: ``key``, held, n_tokens, n_known,
    train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), text_or_empty(f"`{text}`").alias("text"))
    blocks, name = bucketed(rows.mapInArrow(blocks_of(block_tokens, BLOCK_SCHEMA), BLOCKS), "block")
    totals = blocks.agg(F.sum("trained").alias("trained"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens")).first()
    bits = max(0, math.ceil((totals["tokens"] or 0) / OWNED) - 1).bit_length()
    asks = blocks.select("block", "sizes", "held", "tokens", "vocabulary").mapInArrow(asked(order, bits), ASKS)
    answers = written(asks.groupBy("level", "bucket").applyInArrow(answered(bits), ANSWERS), "answers")
    stats: dict[int, list[int]] = defaultdict(lambda: [0] * (CUT + 3))
    counted = answers.where("block = -1").select("level", F.posexplode("stats").alias("at", "n")).groupBy("level", "at").agg(F.sum("n").alias("n"))
    for r in counted.collect():
        stats[r["level"]][r["at"]] = r["n"]
    model = Model(order, stats, totals["trained"] or 0)
    packed = answers.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("level", "bucket", "counts")).alias("answers"))
    found = written(blocks.join(packed, "block", "left").mapInArrow(scored(model), FOUND), "scored")
    spark.sql(f"DROP TABLE {name}")
    weights = found.where("kind = 2").groupBy("key").agg(F.log10((1 - F.sum("high")) / (1 - F.sum("low"))).alias("weight"))
    needed = found.where("kind = 1").select("block", "doc", "key", "times").join(weights, "key", "left")
    backed = needed.groupBy("block", "doc").agg(F.sum(F.col("weight") * F.col("times")).alias("backed"))
    texts = found.where("kind = 0").join(backed, ["block", "doc"], "left")
    return texts.select(
        F.col("id").alias(key),
        "held",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        (F.col("score") + F.coalesce("backed", F.lit(0.0))).alias("score"),
    )
