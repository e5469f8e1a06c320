"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read the words of a clause and run in step (their composition): insults (arcs for words and for word
beginnings, weighted by what labelled documents show), threats (intent, then harm, then a target), targets, negation and
reported speech.  An insult or threat is scored as plain, aimed at a target, negated, or reported, depending on the state
that the other transducers are in; a document's score is a logistic function of its matched clauses.

Insult weights are log odds over families of documents (texts that share the least of their shingle hashes count once),
so copies of one document teach no words.  Weights and the logistic function are fitted on at most ``SAMPLE`` labelled
rows of each label, first in hash order; everything else covers all rows.

Null and empty texts match nothing and get the score of a document without matches.  Without labelled rows of both kinds
all scores are 0.  Repeated rows score alike.  A null doc_id is not held out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from riskframe.llm.common import only, text_or_empty, written

#: Most labelled rows of each label that the model is fitted on, and most arcs of the insult transducer.
SAMPLE, ARCS = 6_000, 4_000
#: Lengths of word beginnings that may become arcs; least evidence (likelihood ratio statistic) for an arc.
STEMS, EVIDENCE = (4, 5, 6), 14.0
WORDS = re.compile(r"[^\W\d_]+|[\"“”«»]")
CLAUSE = re.compile(r"[.!?;:\n]+")

#: Words of the target, negation, intent, harm and reported-speech transducers.
TARGET = frozenset("you your yours yourself he she they him them people du dich dir ihr euch sie tu toi vous te ils elles usted ustedes ellos ellas".split())
NEGATION = frozenset("not no never nor without isn aren wasn don doesn didn nicht kein keine nie niemals pas jamais aucun aucune sin nunca jamás".split())
INTENT = frozenset("will gonna going shall must should ll werde werden wird vais va allons voy vamos".split())
HARM = frozenset("kill hurt destroy beat burn shoot stab attack punch crush töten schlagen vernichten tuer frapper détruire matar golpear destruir".split())
REPORT = frozenset("said says say wrote writes called calls claimed quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())
QUOTES = frozenset('"“”«»')
#: Words over which a negation or an intent reaches.
REACH = 3
N_FEATURES = 8


def evidence(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Likelihood ratio statistic of the label given the piece, 0 where it speaks for the clean label."""
    share, base = toxic / (toxic + clean), all_toxic / (all_toxic + all_clean)
    if share <= base:
        return 0.0
    out = toxic * math.log(share / base)
    return 2 * (out + (clean * math.log((1 - share) / (1 - base)) if clean else 0.0))


class Grammar:
    """The composed transducers."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) for s in stems})
        self.known: dict[str, float] = {}

    def insult(self, word: str) -> float:
        """Weight of the heaviest insult arc that reads the word, 0 without one."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in self.lengths if len(word) > k)])
            self.known[word] = found
        return found

    def clause(self, words: list[str]) -> tuple[float, float, float, float, float]:
        """Weights (plain, targeted, negated, reported, threat) of one clause."""
        aimed = any(w in TARGET for w in words)
        plain = targeted = negated = reported = threat = 0.0
        reach = intent = 0
        told = quoted = False
        harm = False
        for w in words:
            if w in QUOTES:
                quoted = not quoted
                continue
            weight = self.insult(w)
            if weight:
                if reach:
                    negated += weight
                elif told or quoted:
                    reported += weight
                elif aimed:
                    targeted += weight
                else:
                    plain += weight
            if w in HARM and intent and not reach:
                harm = True
            elif w in TARGET and harm:
                threat, harm = threat + 1.0, False
            told = told or w in REPORT
            reach = REACH if w in NEGATION else max(0, reach - 1)
            intent = REACH if w in INTENT else max(0, intent - 1)
        return plain, targeted, negated, reported, threat

    def features(self, text: str) -> list[float]:
        low = text.lower()
        seen = set(WORDS.findall(low))
        if not any(map(self.insult, seen)) and seen.isdisjoint(HARM):
            return [0.0] * N_FEATURES
        found = [x for x in (self.clause(WORDS.findall(c)) for c in CLAUSE.split(low)) if any(x)]
        if not found:
            return [0.0] * N_FEATURES
        best = [max(x[i] for x in found) for i in range(5)]
        total = sum(x[0] + x[1] for x in found)
        return [*(math.log1p(v) for v in best), math.log1p(total), math.log1p(len(found)), 1.0]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (bias last) by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of the sample; its ids are at most 2 * ``most`` and go to every task."""
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mixed = F.xxhash64("doc_id")
    chosen = [marked.where(f"toxic = {t}").orderBy(mixed, "doc_id").limit(most) for t in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").cast("long").alias("_id"), "toxic")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("text")).join(F.broadcast(ids), "_id")
    return written(rows.select("text", "toxic"), "toxic-sample")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[dict, dict, list[float]] | None:
    """(word arcs, stem arcs, logistic weights), or None without rows of both labels."""
    rows = training_rows(docs, labels, most)
    sums = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.countDistinct("text").alias("n")).collect()}
    if not sums.get(0) or not sums.get(1):
        return None

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = WORDS.findall(text.lower())
                if not found:
                    continue
                runs = [" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4))]
                family = min(xxhash.xxh3_64_intdigest(r) for r in runs) - (1 << 63)
                parts = set(found)
                parts |= {w[:k] + "*" for w in parts for k in STEMS if len(w) > k}
                for column, values in zip(out, (list(parts), [family] * len(parts), [toxic] * len(parts))):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=["piece", "family", "toxic"])

    counted = rows.mapInArrow(pieces, "piece string, family long, toxic int").groupBy("piece", "family").agg(F.max("toxic").alias("toxic"))
    counted = counted.groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    base = sums[1] / (sums[0] + sums[1])
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    lift = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    # Evidence decides; the number of arcs is a documented size of the model.
    best = counted.where(share > base).withColumn("evidence", 2 * lift).where(F.col("evidence") >= EVIDENCE).where(share >= 0.5)
    arcs = best.orderBy(F.desc("evidence"), "piece").limit(ARCS).collect()
    weight = lambda r: math.log((r["toxic"] + 0.5) / (sums[1] + 1)) - math.log((r["clean"] + 0.5) / (sums[0] + 1))
    words = {r["piece"]: weight(r) for r in arcs if not r["piece"].endswith("*")}
    stems = {r["piece"][:-1]: weight(r) for r in arcs if r["piece"].endswith("*")}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(words, stems)
        for batch in batches:
            values = [grammar.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    table = rows.mapInArrow(measure, "x array<double>, toxic int").collect()  # 2 * SAMPLE rows at most
    order = sorted((tuple(r["x"]), r["toxic"]) for r in table)
    x, y = np.array([o[0] for o in order]), np.array([o[1] for o in order], float)
    return words, stems, logistic(x, y).tolist()


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, only(labels, "doc_id", "toxic"), most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return scored(rows, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def scored(rows: DataFrame, model: tuple | None) -> DataFrame:
    """The rows (of any columns, with ``text``) and their ``score``."""
    if model is None:
        return rows.withColumn("score", F.lit(0.0))
    words, stems, weights = model
    names, at = [*rows.columns, "score"], rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, w = Grammar(words, stems), np.array(weights)
        for batch in batches:
            x = np.array([grammar.features(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, N_FEATURES)
            scores = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Documents that are not predicted toxic, with the columns of the input."""
    model = fit(docs, only(labels, "doc_id", "toxic"), most)
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], text_or_empty().alias("text"))
    kept = scored(named, model).where("score < 0.5")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
