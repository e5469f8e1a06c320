"""Quality rules: hashed n-gram log-likelihood ratio, with DataFrame functions only.

Words and word pairs of every document are hashed into a table of ``BUCKETS`` counters.  Two multinomials over them, one of
trusted documents and one of the whole corpus, give each counter a log ratio; a document's score is the mean over its
n-grams.  Ratios are whole thousandths, so scores do not depend on the order of sums.

A task hands on at most one row per counter, and the ratios (a million numbers, whatever the corpus) go to every task: no
n-gram is moved one by one.  ``buckets=None`` keeps a row per distinct n-gram instead; that table is joined to the documents
by hash, and only the n-grams with the highest counts (``FREQUENT`` at most) go to every task.

A document stays from the threshold on that parts the run's labelled documents best: the share of good ones below it plus
the share of bad ones from it on is least, and it lies in the middle between the two scores that it parts.  A trusted
document is scored for this without its own n-grams, as it would otherwise vouch for itself.  Without bad labels the
threshold leaves one labelled good document of 100 below.

All documents labelled good are trusted, and all that are labelled set the threshold; the raw counts cover all documents.
Ids go to every task up to ``SENT_IDS`` of them; more are joined by id.  Null text has no words and fails the base rules.  Without trusted documents
all ratios are 0.  A text of any length is one row of its task; repeated rows have equal results, a null doc_id has no label,
an empty table gives no rows, and columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import SPACE, only, text_or_empty, written

#: Most labelled ids that go to every task.
SENT_IDS = 1 << 20
#: Counters of the hashed table.
BUCKETS = 1 << 20
#: Most ratios that go to every task.
FREQUENT = 1 << 20
#: Words below which a document fails the base rules.
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"


def after(values: Column, skip: int) -> Column:
    """The values that have ``skip`` others after them."""
    return F.slice(values, F.lit(1), F.greatest(F.size(values) - skip, F.lit(0)))


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def labelled_ids(labels: DataFrame, quality: int) -> DataFrame:
    return labels.where(f"quality = {quality} AND doc_id IS NOT NULL").select("doc_id").distinct()


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labelled_ids(labels, 1)


def few_or_joined(ids: DataFrame, most: int) -> DataFrame:
    """The ids, to be sent to every task where there are few of them."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns ``more``, text and ``k``, the hash of doc_id and text."""
    narrow = docs.select("doc_id", *more, text_or_empty().alias("text"))
    return narrow.select("doc_id", *more, "text", F.xxhash64("doc_id", "text").alias("k"))


def n_grams(docs: DataFrame, buckets: int | None, *more: str) -> DataFrame:
    """doc_id, ``k`` (hash of doc_id and text, made here unless it is one of the columns ``more``) and ``x``, the hash of an
    n-gram, for every n-gram of every document.

    Words are laid out as rows with the word behind them, so that hashes are made in generated code and not per array."""
    narrow = docs if "k" in more else keyed(docs, *more)
    more = tuple(c for c in more if c != "k")
    narrow = narrow.select("doc_id", *more, "k", split_words(F.col("text")).alias("w"))
    pairs = narrow.select("doc_id", *more, "k", "w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("then"))
    # The outer forms add no filter on the size of an array, and with it no second, slower reading of every text.
    rows = pairs.select("doc_id", *more, "k", F.inline_outer(F.arrays_zip("w", "then"))).where("w IS NOT NULL")
    one = F.xxhash64("w")
    two = F.when(F.col("then").isNotNull(), F.xxhash64(one, F.xxhash64("then")))
    grams = rows.select("doc_id", *more, "k", one.alias("one"), two.alias("two"))
    grams = grams.select("doc_id", *more, "k", F.explode_outer(F.array("one", "two")).alias("x")).where("x IS NOT NULL")
    return grams if buckets is None else grams.withColumn("x", F.pmod("x", F.lit(buckets)))


def own_grams(texts: DataFrame, buckets: int | None) -> DataFrame:
    """k, is_good, copies, ``x`` and ``again`` for every n-gram of the texts: whether a good one holds it more than once.

    A text's hashes are sorted in its row, where equal ones are neighbours: only the n-grams that come again, which are few,
    are left to be counted by text and hash."""
    place = lambda x: x if buckets is None else F.coalesce(F.pmod(x, F.lit(buckets)), F.lit(0).cast("long"))
    kept = ("k", "is_good", "copies")
    hashes = texts.select(*kept, F.transform(split_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    fewer = F.greatest(F.size("h") - 1, F.lit(0))
    two = F.zip_with(F.slice("h", F.lit(1), fewer), F.slice("h", F.lit(2), fewer), lambda a, b: place(F.xxhash64(a, b)))
    ordered = hashes.select(*kept, F.sort_array(F.concat(F.transform("h", place), two)).alias("x"))
    before, then = F.concat(F.array(F.lit(None).cast("long")), F.col("x")), F.slice("x", F.lit(2), F.size("x"))
    rows = ordered.select(*kept, F.inline(F.arrays_zip(F.col("x"), before.alias("before"), then.alias("then")))).where("x IS NOT NULL")
    return rows.select(*kept, "x", F.expr("is_good AND (copies > 1 OR x <=> before OR x <=> then)").alias("again"))


class Ratios:
    """Counts of n-grams and their log ratio of trusted to raw probability, add-one smoothed, in thousandths."""

    def __init__(self, docs: DataFrame, trusted: DataFrame, buckets: int | None = None, frequent: int = FREQUENT, sent: int = SENT_IDS):
        self.docs, self.buckets, self.all_sent = docs, buckets, buckets is not None and buckets <= frequent
        self.sent = sent
        vouched = few_or_joined(trusted.select("doc_id", F.lit(1).alias("good")), sent)
        marked = n_grams(only(docs, "doc_id", "text").join(vouched, "doc_id", "left"), buckets, "good")
        counts = written(marked.groupBy("x").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("good")), "n-grams")
        levels = counts.groupBy(F.ceil(F.log2("raw") * 8).alias("level")).agg(
            F.count(F.lit(1)).alias("n"), F.min("raw").alias("least"), F.sum("raw").alias("raw"), F.sum("good").alias("good")
        )
        levels = sorted(levels.collect(), key=lambda r: -r["level"])  # eight for each doubling of the count
        size = buckets or sum(r["n"] for r in levels)
        self.trusted, self.all_raw = sum(r["good"] for r in levels) + size, sum(r["raw"] for r in levels) + size
        self.fitted = self.trusted > size
        self.least, sent = 2, 0
        for r in levels:
            sent += r["n"]
            if sent > frequent:
                self.least = max(2, r["least"] + 1 if r is levels[0] else last)
                break
            last = r["least"]
        self.counts = counts

    def of(self, good: Column, raw: Column) -> Column:
        ratio = F.log((good + 1) / self.trusted) - F.log((raw + 1) / self.all_raw)
        return F.rint(ratio * 1000).cast("long") if self.fitted else F.lit(0).cast("long")

    def scores(self) -> DataFrame:
        """k, total and n: sum of the ratios and number of the n-grams of a document; equal rows share k, and so both."""
        rated = self.counts.select("x", "raw", self.of(F.col("good"), F.col("raw")).alias("ratio"))
        if self.all_sent:
            sent = F.broadcast(rated.select("x", "ratio"))  # a row per counter
            found = n_grams(self.docs, self.buckets).select("k", "x").join(sent, "x")
            return found.groupBy("k").agg(F.sum("ratio").alias("total"), F.count(F.lit(1)).alias("n"))
        often = F.broadcast(rated.where(F.col("raw") >= self.least).select("x", "ratio"))
        grams = n_grams(self.docs, self.buckets).select("k", "x")
        add = [F.sum("ratio").alias("total"), F.count(F.lit(1)).alias("n")]
        # N-grams that occur once and not in a trusted document are the same to the score: they need no row to join.
        once = self.of(F.lit(0), F.lit(1))
        rare = self.counts.where((F.col("raw") < self.least) & ((F.col("raw") > 1) | (F.col("good") > 0)))
        rare = rare.select("x", self.of(F.col("good"), F.col("raw")).alias("ratio"))
        rest = grams.join(often.drop("ratio"), "x", "left_anti").join(rare.hint("merge"), "x", "left").select("k", F.coalesce("ratio", once).alias("ratio"))
        parts = grams.join(often, "x").groupBy("k").agg(*add).unionByName(rest.groupBy("k").agg(*add))
        return parts.groupBy("k").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))

    def threshold(self, good: DataFrame, bad: DataFrame) -> float:
        """From the labelled documents that have the words the base rules ask for."""
        if not self.fitted:
            return 0.0
        ids = good.withColumn("is_good", F.lit(True)).unionByName(bad.withColumn("is_good", F.lit(False)))
        # The labelled documents are dealt by key as texts, so that their n-grams need not move to be counted.
        labelled = keyed(only(self.docs, "doc_id", "text").join(few_or_joined(ids, self.sent), "doc_id"), "is_good").repartition("k")
        texts = labelled.groupBy("k", "is_good", "text").agg(F.count(F.lit(1)).alias("copies"))
        less = lambda own: F.greatest(F.lit(0), F.col("good") - own)
        counts = self.counts.select("x", "good", "raw", self.of(F.col("good"), F.col("raw")).alias("ratio"), self.of(less(1), F.col("raw")).alias("lone"))
        found = own_grams(texts, self.buckets).join(F.broadcast(counts) if self.all_sent else counts, "x")  # a row per counter
        lone = F.sum(F.col("copies") * F.when(F.col("is_good"), F.col("lone")).otherwise(F.col("ratio"))).alias("lone")
        own = found.groupBy("k", "is_good", F.when(F.col("again"), F.col("x")).alias("x")).agg(
            lone, F.sum("copies").alias("own"), F.max("good").alias("good"), F.max("raw").alias("raw")
        )
        again = self.of(less(F.col("own")), F.col("raw")) * F.col("own")
        rated = own.withColumn("ratio", F.when(F.col("x").isNull(), F.col("lone")).otherwise(again))
        means = rated.groupBy("k", "is_good").agg(F.round(F.sum("ratio") / F.sum("own")).cast("long").alias("score"), F.sum("own").alias("n"))
        means = means.where(F.col("n") >= 2 * LEAST_WORDS - 1)
        rows = means.groupBy("score").agg(F.count_if("is_good").alias("good"), F.count_if(~F.col("is_good")).alias("bad")).orderBy("score").collect()
        return parting([(r["score"], r["good"], r["bad"]) for r in rows])


def parting(rows: list[tuple[int, int, int]]) -> float:
    """The threshold, from (score, good, bad) by score."""
    goods, bads = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not goods:
        return 0.0
    if not bads:
        below = 0
        for score, good, _ in rows:
            below += good
            if below > goods // 100:
                return float(score)
    best, at, low, high = 1.0, float(rows[0][0]), 0, bads
    for (score, good, bad), (then, _, _) in zip(rows, rows[1:]):
        low, high = low + good, high - bad
        if low / goods + high / bads < best:
            best, at = low / goods + high / bads, (score + then) / 2
    return at


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int | None = BUCKETS, threshold: float | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score
    (mean log ratio in thousandths), kept.  ``buckets`` are the counters of the hashed table (None: a row per n-gram);
    ``threshold`` takes the place of the one from the labels."""
    good = trusted_ids(labels)
    ratios = Ratios(docs, good, buckets)
    if threshold is None:
        threshold = ratios.threshold(good, labelled_ids(labels, 0))
    add = lambda total, x: total + x
    zero = F.lit(0).cast("long")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.regexp_count("text", F.lit(f"[{SYMBOLS}]"))
    d = docs.select("doc_id", text_or_empty().alias("text"))
    d = d.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), "text", split_words(F.col("text")).alias("w"))
    d = d.select(
        "doc_id", "k", F.transform("w", lambda w: F.xxhash64(w)).alias("h"), lines.alias("lines"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
    )
    d = d.withColumn("tri", F.transform(after(F.col("h"), 2), lambda x, i: F.xxhash64(x, F.get(F.col("h"), i + 1), F.get(F.col("h"), i + 2))))
    repeats = F.size(F.array_distinct("tri")) < F.size("tri")
    d = d.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("tri", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    x, i = F.col("sorted")["x"], F.col("sorted")["i"]
    before, then = F.concat(F.array(F.lit(None).cast("long")), x), F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(0)))
    d = d.withColumn("near", F.arrays_zip(x.alias("x"), i.alias("i"), before.alias("before"), then.alias("then")))
    twins = F.filter("near", lambda e: F.coalesce((e["x"] == e["before"]) | (e["x"] == e["then"]), F.lit(False)))
    d = d.withColumn("at", F.sort_array(twins["i"]))
    covered = F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("at"), k + 1) - p, F.lit(3))).cast("long"))
    n = F.size("h").cast("long")
    # Written before it is joined: a filter on the result would otherwise be pushed into these expressions and repeat them.
    base = d.select(
        "doc_id",
        "k",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, zero, add), zero).alias("n_repeat_words"),
    )
    out = written(base, "base").join(ratios.scores(), "k", "left")
    out = out.withColumn("score", F.coalesce(F.col("total") / F.col("n"), F.lit(0.0)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
    return only(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
