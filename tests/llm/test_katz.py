import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import katz
from tests.llm.tables import DOCS, documents, odd_rows, with_clashes, words

HELD = "doc_id % 4 = 1"


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return ["<s>", *words(lower), "</s>"]


class Plain:
    """The model written out: dictionaries of n-grams, weights by summing over all followers."""

    def __init__(self, texts, order):
        self.order, self.count = order, defaultdict(Counter)
        for t in texts:
            line = tokens(t)
            self.count[0][()] += len(line) - 1
            self.count["start"][("<s>",)] += 1
            for n in range(1, order + 1):
                for i in range(max(1, n - 1), len(line)):
                    self.count[n][tuple(line[i - n + 1 : i + 1])] += 1
        self.total = self.count[0][()]
        self.discount = {}
        for n in range(1, order + 1):
            of = Counter(self.count[n].values())
            low = [of[r] for r in range(1, katz.CUT + 2)]
            self.discount[n] = katz.Discounts(sum(self.count[n].values()), len(self.count[n]), low)
            if n == 1:
                self.unseen = self.discount[1].left(low)
        self.followers = defaultdict(list)
        for n in range(2, order + 1):
            for gram in self.count[n]:
                self.followers[gram[:-1]].append(gram[-1])
        self.alpha = {}

    def context(self, h):
        return self.total if not h else self.count["start"][h] if h == ("<s>",) else self.count[len(h)][h]

    def weight(self, h):
        if h not in self.alpha:
            high = sum(self.p(w, h) for w in self.followers[h])
            low = sum(self.p(w, h[1:]) for w in self.followers[h])
            self.alpha[h] = (1 - high) / (1 - low)
        return self.alpha[h]

    def p(self, w, h):
        n = len(h) + 1
        c = self.count[n][(*h, w)]
        if c:
            return float(self.discount[n](np.array([c]))[0]) / self.context(h)
        if not h:
            return self.unseen
        return (self.weight(h) if self.context(h) else 1.0) * self.p(w, h[1:])

    def score(self, text):
        line = tokens(text)
        return sum(math.log10(self.p(line[i], tuple(line[max(0, i - self.order + 1) : i]))) for i in range(1, len(line)))


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    out = []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 60))) + (f" only{i}" if i % 3 else "")
        out.append((i, text.upper() if i % 5 == 0 else text, "en", "a", 0))
    return out


def check(spark, rows, order, block_tokens, parts=3):
    df = with_clashes(documents(spark, rows)).repartition(parts)
    got = sorted(map(tuple, katz.score_texts(df, F.expr(HELD), order=order, block_tokens=block_tokens).collect()), key=repr)
    training = [r for r in rows if not (r[0] is not None and r[0] % 4 == 1)]
    model = Plain([r[1] for r in training], order)
    total, types = model.total, len(model.count[1])
    want = []
    for row in rows:
        line = tokens(row[1])[1:]
        counts = [model.count[1][(w,)] for w in line]
        base = sum(math.log10((c + 1) / (total + types + 1)) for c in counts)
        held = row[0] is not None and row[0] % 4 == 1
        want.append((row[0], held, len(line), sum(c > 0 for c in counts), total, base, model.score(row[1])))
    want.sort(key=repr)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: (repr(r[:5]), r[6])), sorted(want, key=lambda r: (repr(r[:5]), r[6]))):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)
    return model


@pytest.mark.parametrize("order,block_tokens", [(1, 50), (2, 100), (2, 10**6), (3, 70)])
def test_as_the_model_written_out(spark, order, block_tokens, monkeypatch):
    monkeypatch.setattr(katz, "OWNED", 300)
    check(spark, corpus(), order, block_tokens)


def test_odd_rows(spark):
    check(spark, odd_rows() + [(None, "no key", "en", None, 1)], 2, 500)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_of_a_context_sum_to_one(order):
    model = Plain([r[1] for r in corpus(40)], order)
    vocabulary = [g[0] for g in model.count[1]] + ["never seen"]
    contexts = [(), ("<s>",), ("w0",), ("w7",), ("w0", "w1"), ("<s>", "w2"), ("w59", "w58"), ("nowhere",)]
    for h in [c for c in contexts if len(c) < order]:
        assert sum(model.p(w, h) for w in vocabulary) == pytest.approx(1.0, abs=1e-9)


@pytest.mark.parametrize("n", [[0] * 6, [5, 0, 0, 0, 0, 0], [100, 40, 20, 11, 7, 5], [3, 50, 2, 1, 0, 0], [10, 5, 3, 2, 100, 1], [0, 4, 0, 0, 0, 0]])
def test_discounted_counts_stay_between_nought_and_the_count(n):
    d = katz.Discounts(sum(i * c for i, c in enumerate(n, 1)), sum(n), n)
    counts = np.arange(1, 50)
    assert (d(counts) > 0).all() and (d(counts) < counts).all() and (np.diff(d(counts)) > 0).all()


def test_empty_table_and_no_training_rows(spark):
    assert katz.score_texts(spark.createDataFrame([], DOCS), F.expr(HELD)).collect() == []
    alone = katz.score_texts(documents(spark, [(1, "a b", "en", "a", 3), (5, None, "en", "a", 3)]), F.expr(HELD)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in alone) == [(1, 3, 0, 0, 0.0, 0.0), (5, 1, 0, 0, 0.0, 0.0)]


def test_held_out_text_is_likelier_than_by_single_words(spark):
    rng = random.Random(1)
    nxt = {i: [rng.randrange(200) for _ in range(3)] for i in range(200)}
    rows = []
    for i in range(300):
        at, line = rng.randrange(200), []
        for _ in range(60):
            line.append(f"v{at}")
            at = rng.choice(nxt[at])
        rows.append((i, " ".join(line), "en", "a", 0))
    got = katz.score_texts(documents(spark, rows), F.expr(HELD)).where("held").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 1


def test_packing_of_numbers():
    for values in ([], [0], [1, 2, 255], [256, 0, 2**40], [2**64 - 1, 3]):
        assert katz.numbers(katz.planes(np.array(values, np.uint64))).tolist() == values
