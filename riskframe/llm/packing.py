"""Mixture-controlled packing: deficit round-robin over source queues fills windows of tokens.

Each source is a queue of its documents in shuffled (hash) order, or in the order of a written table (``ordered``), cut into packets of at most the queue's quantum, or
one of ``PACKETS`` parts of a window where the quantum is less, so that a window holds every larger source's share.  A round gives
every queue its quantum, the source's target share of a window; a packet goes out in the round in which its queue's
credit covers it, and what is left is carried on.  A queue that always has packets serves the packet that ends at c
tokens in round ceil(c / quantum), whatever partition holds it, so the deficits of the round-robin are prefix sums of the
queue: exact across windows and partitions.  The order (round, queue, place in queue) then fills one window after the
other; only the last window can be short.

Without given weights the targets are the sources' shares of all tokens.  Null and empty texts are one end token.  A
null source is a queue of its own.  Repeated rows are documents of their own, and so are rows that share a doc_id: the hash
order tells them apart by their place in the input, so that copies do not follow each other.  A text of any length is one
row of its task, its pieces are slices.  An empty table gives no pieces.  Columns other than doc_id, source and text, whatever
their names, are not read.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import ROWS_PER_CELL, cells_for, running_sum, text_or_empty, written

#: Most packets of a full window; a source with a smaller share of it comes in some windows only.
PACKETS = 64
#: Tokens in a sequence, the id that ends a document, and the vocabulary file.
WINDOW, END_ID = 2048, 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Signs that may end a run of letters.
SIGNS = frozenset(".,;:!?")


#: Letters whose lower case is a letter by itself, already composed.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in kept)}
    return [chr(rest.get(b, b)) for b in range(256)]


BYTES = byte_characters()


class TokenIds(dict):
    """16-bit ids of the runs of non-space seen lately, as bytes; starts anew when full.

    The vocabulary's rules replace white space before words are split, so no token reaches over it and the ids of a text
    are the ids of its runs in turn.  They also split a sign from the letters before it and fold case, so a word is kept once,
    whatever sign follows it and however its ASCII letters are cased.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_file(path)
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary take more than 16 bits")
        # words of plain letters may go to the model's merges directly, if that gives what the whole tokenizer gives
        self.merges = self.model.model
        self.direct = all(self.by_merges(w) == self.by_tokenizer(w) for w in ("the", "The", "zqxj", "naïve", "GRÖSSE", "ÿŁőǆ"))

    def by_tokenizer(self, run: str) -> list[int]:
        return self.model.encode(run, add_special_tokens=False).ids

    def by_merges(self, word: str) -> list[int]:
        low = word.lower()
        return [t.id for t in self.merges.tokenize(low if low.isascii() else "".join(map(BYTES.__getitem__, low.encode())))]

    def __missing__(self, run: str) -> bytes:
        if run[-1:] in SIGNS and run[:-1].isalpha():
            return self[run[:-1]] + self[run[-1]]
        if run.isascii() and (low := run.lower()) != run:
            return self[low]
        if len(self) > 500_000:
            self.clear()
        plain = self.direct and run.isalpha() and (run.isascii() or LATIN.fullmatch(run))
        ids = array("H", self.by_merges(run) if plain else self.by_tokenizer(run))
        if sys.byteorder == "big":
            ids.byteswap()
        found = self[run] = ids.tobytes()
        return found


def token_ids(path: str) -> TokenIds:
    """The table of this worker process, kept from task to task."""
    kept = sys.modules.setdefault("_packing_tokens", ModuleType("_packing_tokens"))
    if path not in kept.__dict__:
        kept.__dict__[path] = TokenIds(path)
    return kept.__dict__[path]


def tokenized(docs: DataFrame, path: str, end_id: int, ordered: bool = False) -> DataFrame:
    """row_id, doc_id, source, n (ids with the end), ids (16-bit, little-endian), file and line of the row if ``ordered``."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_ids(path)
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                piece = batch.slice(part, 1000)
                # Only these four are white space to every rule involved; other kinds stay inside a run.
                ids = [
                    b"".join(map(known.__getitem__, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) + end
                    for t in piece.column(3).to_pylist()
                ]
                sizes = pa.array([len(x) // 2 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:3], sizes, pa.array(ids, pa.large_binary()), *piece.columns[4:]],
                    names=["row_id", "doc_id", "source", "n", "ids", *piece.schema.names[4:]],
                )

    narrow = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        text_or_empty().alias("text"),
        *([F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("line")] if ordered else []),
    )
    return narrow.mapInArrow(run, "row_id long, doc_id long, source string, n long, ids binary" + ", file string, line long" * ordered)


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``place``, the number of a row in the order of files and lines.  One row per file is put in order."""
    files = rows.groupBy("file").agg((F.max("line") + 1).alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "file").withColumn("place", F.col("_start") + F.col("line")).drop("_start", "file", "line")


def packing_plan(sizes: DataFrame, window: int, weights: DataFrame | None = None, seed: int = 42, least_packet: int | None = None) -> DataFrame:
    """row_id, start, length, sequence_id, offset of every piece, from (row_id, doc_id, source, n) rows; a column ``place``
    sets the order of the queues.

    ``weights`` holds (source, weight) rows; each source needs one above 0.  Packets are as long as their queue's
    quantum, and at least ``least_packet`` tokens; without it, up to a window.
    """
    queue = F.xxhash64("source", F.col("source").isNull())
    totals = sizes.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    shares = totals.withColumn("weight", F.col("tokens").cast("double"))
    if weights is not None:
        shares = totals.join(weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight")), F.col("source").eqNullSafe(F.col("_s")))
    sums = shares.agg(F.sum("weight").alias("w"), F.sum("tokens").alias("t"), F.sum("rows").alias("r")).first()
    cells = cells_for(sums["r"] or 0)
    quantum = shares.select(queue.alias("queue"), (F.col("weight") * window / float(sums["w"] or 1)).alias("quantum"))
    if "place" in sizes.columns:
        queued = sizes.select("row_id", "n", queue.alias("queue"), F.col("place").alias("shuffle"))
        queued = queued.withColumn("cell", F.floor(F.col("shuffle") / ROWS_PER_CELL))
    else:
        mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("row_id").cast("string")))
        queued = sizes.select("row_id", "n", queue.alias("queue"), mixed.alias("shuffle")).withColumn(
            "cell", F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("double") * cells / 2**32).cast("long")
        )
    queued = running_sum(queued, ["queue"], "cell", [F.col("shuffle"), F.col("row_id")], "n", "before").join(quantum, "queue")
    most = F.lit(window).cast("long")
    if least_packet is not None:
        most = F.least(most, F.greatest(F.floor("quantum").cast("long"), F.lit(max(1, least_packet)).cast("long")))
    packets = queued.withColumn("most", most).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("most"))))
    packets = packets.withColumn("length", F.least(F.col("most"), F.col("n") - F.col("start")))
    ends = F.col("before") + F.col("start") + F.col("length")
    # Rounds hold about a window each; a cell of the global order holds some tens of thousands of packets.
    packets = packets.withColumn("round", F.ceil(ends / F.col("quantum"))).withColumn("cell", F.floor(F.col("round") / 500)).withColumn("lane", F.lit(0))
    order = [F.col("round"), F.col("queue"), F.col("before"), F.col("row_id"), F.col("start")]
    placed = running_sum(packets, ["lane"], "cell", order, "length", "at")
    room = window - F.col("at") % window
    first = F.struct(F.col("start").alias("start"), F.least("length", room).alias("length"), F.col("at").alias("at"))
    rest = F.struct((F.col("start") + room).alias("start"), (F.col("length") - room).alias("length"), (F.col("at") + room).alias("at"))
    parts = F.when(F.col("length") > room, F.array(first, rest)).otherwise(F.array(first))
    return placed.select("row_id", F.inline(parts)).select(
        "row_id", "start", "length", F.floor(F.col("at") / window).alias("sequence_id"), (F.col("at") % window).alias("offset")
    )


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, window: int = WINDOW, path: str = TOKENIZER, end_id: int = END_ID, weights: DataFrame | None = None, ordered: bool = False
) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ``ids`` (16-bit, little-endian) of every piece.
    ``ordered`` keeps the order of a table read from files; without it queues are shuffled."""
    rows = written(tokenized(docs, path, end_id, ordered), "tokens")
    sizes = rows.drop("ids")
    plan = packing_plan(numbered(sizes) if ordered else sizes, window, weights, least_packet=window // PACKETS)
    # The pieces of a document are cut on the JVM side: a slice of its ids each.
    return plan.join(rows.select("row_id", "doc_id", F.col("n").alias("doc_tokens"), "ids"), "row_id").select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset",
        F.substring("ids", (2 * F.col("start") + 1).cast("int"), (2 * F.col("length")).cast("int")).alias("ids"),
    )


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids as 32-bit numbers in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            columns = [pa.array(sums, pa.int64()) if c == "ids_crc32" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [x.split()[0] for x in PIECES.split(", ")]
    return pieces.mapInArrow(run, PIECES)
