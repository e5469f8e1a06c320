"""Small tables with the odd cases every operator must take."""

from __future__ import annotations

import random
import re

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the input.
CLASH = ("row_id", "tie", "size", "key", "body", "h", "w", "node", "score", "queue", "cell", "bucket", "host", "n")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa")) + str(rng.randrange(40)) for _ in range(n))


def odd_rows(n: int = 40, seed: int = 3) -> list[tuple]:
    """Nulls, empty, blank and long texts, copies, near copies, repeated rows, null sources."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(1, 120)) for _ in range(n)]
    texts += [None, "", " \t\n ", "one", "one two", "One  Two", texts[0], texts[0].replace(" ", "\t "), texts[1].upper(), sentence(rng, 6000)]
    base = texts[2] + " " + sentence(rng, 200)
    texts += [base, base + " more", base.replace("alpha", "alpha", 1) + " other words", "a b   c", "naïve 😀 text\x1cend"]
    rows = [(i, t, "en", (None, "a", "b", "B", "ü")[i % 5], len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], rows[3]]


def documents(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(7).alias(c) for c in CLASH if c not in df.columns])


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def same(one, two) -> bool:
    return sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
