"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns find emails, network addresses, payment cards and phone numbers in the forms they state.  The random field
reads the islands of a text that hold digits, an at sign or words for it: it scores whole candidate spans (numbers of 9 to
15 digits, at forms and the fixed shapes; by shape, number of digits, check sum, separators, words before) and a dynamic
program over spans of bounded length chooses boundaries and types together.  Its spans are added where they overlap no
pattern span and clearly beat leaving the words alone.

The field is trained here by conditional likelihood on stretches of the corpus and on rewritten copies of them: the same
data in forms that the patterns do not state.  The stretches are chosen by hash from all documents: at most ``SAMPLE``, a
fifth of them around a pattern span of each kind and a fifth around islands without one, so that each kind is learnt
however rare its spans are among the numbers of the corpus.

Null and empty texts have no spans.  Texts and runs of any length are read in time proportional to them; an entity has at
most ``LONGEST`` parts and ``ENTITY_CHARS`` characters.  Repeated rows have equal spans.  Positions are code points, ends
exclusive.  An empty table trains on nothing, and the field then adds nothing.  Columns other than doc_id and text, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Stretches that the field is trained on; parts and characters that a span may have; score above "no span" that an added
#: span needs.
SAMPLE, LONGEST, ENTITY_CHARS, MARGIN = 300, 16, 254, 2.0
EPOCHS, RATE, RIDGE = 40, 1.0, 1e-4

#: The name of an email is read backwards from its at sign, the run before it; an address starts where a run of digits does.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Where islands start; between plain words " at " does so only before a name with a dot, and " dot " after a word.
SEED = re.compile(r"[0-9@]|[(\[]at[)\]]|(?<=\w) at (?=[\w-]+(?:\.\w|\s?[(\[]dot[)\]]| dot \w))|(?<=\w) dot (?=\w)")
#: Parts of an island, and the island: parts with at most two other characters between them.
PART = re.compile(r"[A-Za-z0-9À-ÿ_%+-]+|[@.()\[\]]")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of name@domain, without overlaps: the name is the whole run before the at sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def pattern_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(start, end, "email") for start, end in emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if octets(m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


#: Words that tend to stand before each kind.
BEFORE = {
    "email": frozenset("email mail e-mail contact correo courriel write".split()),
    "ip": frozenset("ip host server address addr".split()),
    "card": frozenset("card visa mastercard credit karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon téléphone teléfono".split()),
}
SHAPES = (
    ("email", re.compile(r"[\w.%+-]+\s?(?:@|\(at\)|\[at\]| at )\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\]| dot )\s?[\w-]+)+")),
    ("ip", re.compile(r"\d{1,3}(?:\s?\.\s?\d{1,3}){3}")),
    ("card", re.compile(r"\d{4}(?:[ .-]?\d{4}){2}[ .-]?\d{1,7}|\d{12,19}|\d{4}[ .-]\d{6}[ .-]\d{5}")),
    ("phone", re.compile(r"(?:\+|00)?\d{0,3}[ .-]?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]?\d{3,4}")),
)
N_FEATURES = 29
#: An at sign or what stands for it, with a dot or what stands for it behind.
AT_FORM = re.compile(r"\w\s?(?:@|\(at\)|\[at\]| at )\s?[\w-]+\s?(?:\.|\(dot\)|\[dot\]| dot )\s?\w")
#: Numbers with their separators; groups of two to four digits.
NUMBERS = re.compile(r"[(+]?\d[\d\s.()/:+-]*\d")
GROUPS = re.compile(r"(?:\+|00)?\(?\d{1,4}\)?(?:[ .-]\(?\d{2,4}\)?){2,6}")
GOES_ON = re.compile(r"\s?(?:\.|\(dot\)|\[dot\]|dot )\s?[A-Za-z0-9]")


def span_features(text: str, start: int, end: int) -> np.ndarray:
    """Features of a whole candidate span."""
    s = text[start:end]
    digits = "".join(DIGIT.findall(s))
    n = len(digits)
    x = np.zeros(N_FEATURES)
    x[0] = 1.0
    for i, (_, shape) in enumerate(SHAPES):
        x[1 + i] = bool(shape.fullmatch(s))
    x[5] = 12 <= n <= 19 and luhn(digits)
    x[6] = 12 <= n <= 19 and not luhn(digits)
    x[7] = 9 <= n <= 15
    x[8] = 7 <= n < 9
    x[9] = n > 19
    parts = re.findall(r"\d+", s)
    x[10] = len(parts) == 4 and "." in s and octets(parts)
    x[11] = s[:1] == "+" or s[:2] == "00"
    x[12] = "(" in s and ")" in s
    x[13] = "@" in s
    x[14] = any(c.isalpha() for c in s)
    x[15] = n == 0
    # What touches the span from outside: a span that ends inside a longer run is cut wrong.
    x[16] = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    x[17] = text[max(0, start - 1) : start] in ("+", ".", "@", "-", "(", "=", '"') or text[end : end + 1] in ("@", "-", "+", '"')
    x[18] = n / 10
    x[19] = len({c for c in s if not c.isalnum()}) > 3
    before = set(re.findall(r"[\w-]+", text[max(0, start - 24) : start].lower())[-2:])
    for i, kind in enumerate(KINDS):
        x[20 + i] = not before.isdisjoint(BEFORE[kind])
    x[24] = bool(GOES_ON.match(text, end))
    x[25] = 9 <= n <= 15 and bool(GROUPS.fullmatch(s))
    x[26] = s[:1] in "0+("
    x[27] = ":" in s or "/" in s or len({c for c in s if not c.isalnum() and c not in "()+"}) > 1
    x[28] = bool(parts) and len(parts[0]) == 4 and parts[0][:2] in ("19", "20")
    return x


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and at signs: those within 12 characters of each other together, to the next space."""
    start = end = -1
    for m in SEED.finditer(text):
        if start < 0 or m.start() - end > 12:
            if start >= 0:
                yield widen(text, start, end)
            start = m.start()
        end = m.end()
    if start >= 0:
        yield widen(text, start, end)


def widen(text: str, start: int, end: int) -> tuple[int, int]:
    """To whole words, and one word more on either side, within 64 characters."""
    for _ in range(2):
        low, start = max(0, start - 64), max(0, start - 1)
        while start > low and not text[start - 1].isspace():
            start -= 1
        high, end = min(len(text), end + 64), min(len(text), end + 1)
        while end < high and not text[end].isspace():
            end += 1
    return start, end


def candidates(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Parts of an island, and spans (first part, after the last) that may be an entity."""
    parts = [(m.start(), m.end()) for m in PART.finditer(text, start, end)]
    digits = [len(DIGIT.findall(text, *p)) if p[1] - p[0] <= ENTITY_CHARS else 0 for p in parts]
    island = text[start:end]
    at_forms = "@" in island or "at" in island
    spans = []
    for i in range(len(parts)):
        n = 0
        for j in range(i + 1, min(len(parts), i + LONGEST) + 1):
            if (j > i + 1 and parts[j - 1][0] - parts[j - 2][1] > 1) or parts[j - 1][1] - parts[i][0] > ENTITY_CHARS:
                break
            n += digits[j - 1]
            if n > 19 and not at_forms:
                break
            s = text[parts[i][0] : parts[j - 1][1]]
            if len(s) >= 6 and "\n" not in s:
                if (9 <= n <= 15 and NUMBERS.fullmatch(s)) or (at_forms and AT_FORM.search(s)):
                    spans.append((i, j))
                elif (n >= 4 or "@" in s or "at" in s) and any(shape.fullmatch(s) for _, shape in SHAPES):
                    spans.append((i, j))
    return parts, spans


class Field:
    """Scores and dynamic programs over an island's parts; weights: one row for each kind."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def chart(self, text: str, start: int, end: int):
        parts, spans = candidates(text, start, end)
        if not spans:
            return parts, spans, None, None
        x = np.array([span_features(text, parts[i][0], parts[j - 1][1]) for i, j in spans])
        return parts, spans, x, x @ self.weights.T

    def best(self, text: str, start: int, end: int, margin: float) -> list[Span]:
        """Spans of the best segmentation, those that beat no span by the margin; a part outside spans scores 0."""
        parts, spans = candidates(text, start, end)
        if not spans:
            return []
        scores = np.empty((len(spans), len(KINDS)))
        for at in range(0, len(spans), 1000):  # features of a few spans at a time
            some = spans[at : at + 1000]
            scores[at : at + 1000] = np.array([span_features(text, parts[i][0], parts[j - 1][1]) for i, j in some]) @ self.weights.T
        top: list[tuple[float, tuple | None]] = [(0.0, None)] + [(-np.inf, None)] * len(parts)
        ending: dict[int, list[int]] = {}
        for at, (_, j) in enumerate(spans):
            ending.setdefault(j, []).append(at)
        for j in range(1, len(parts) + 1):
            top[j] = (top[j - 1][0], None)
            for at in ending.get(j, ()):
                kind = int(scores[at].argmax())
                value = top[spans[at][0]][0] + float(scores[at, kind])
                if value > top[j][0]:
                    top[j] = (value, (at, kind))
        out, j = [], len(parts)
        while j > 0:
            step = top[j][1]
            if step is None:
                j -= 1
                continue
            i = spans[step[0]][0]
            if scores[step[0], step[1]] >= margin:
                out.append((parts[i][0], parts[j - 1][1], KINDS[step[1]]))
            j = i
        return out[::-1]

    def gradient(self, n: int, spans: list, x: np.ndarray, gold: list[tuple[int, int]]) -> np.ndarray:
        """Of the log likelihood of the gold spans: their features minus those expected under the field."""
        scores = np.clip(x @ self.weights.T, -50, 50)
        ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = back[n] = 0.0
        inside = np.logaddexp.reduce(scores, axis=1)
        by_end: dict[int, list[int]] = {}
        by_start: dict[int, list[int]] = {}
        for at, (i, j) in enumerate(spans):
            by_end.setdefault(j, []).append(at)
            by_start.setdefault(i, []).append(at)
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[spans[a][0]] + inside[a] for a in by_end.get(j, ()))])
        for i in range(n - 1, -1, -1):
            back[i] = np.logaddexp.reduce([back[i + 1], *(back[spans[a][1]] + inside[a] for a in by_start.get(i, ()))])
        chance = np.exp(np.array([[ahead[i] + back[j]] for i, j in spans]) + scores - ahead[n])
        for at, kind in gold:
            chance[at, kind] -= 1.0
        return -chance.T @ x


def rewritten(value: str, kind: str, rng: random.Random) -> str:
    """The same datum in a form that the patterns do not state."""
    digits = "".join(DIGIT.findall(value))
    if kind == "email":
        at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("[at]", "."), (" @ ", ".")])
        name, _, domain = (DIGIT.sub("", value) if rng.random() < 0.5 else value).partition("@")
        return name + at + domain.replace(".", dot)
    if kind == "card":
        return rng.choice([".", " ", "-"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "phone":
        d = digits[-10:]
        return rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"00{digits[:-10]} {d[:3]} {d[3:6]} {d[6:]}"])
    return value.replace(".", " . ")


def grouped(value: str, rng: random.Random) -> str:
    """A phone number in groups of two and three digits, as it is written without a country."""
    d = "".join(DIGIT.findall(value))[-10:]
    pairs = ["0" + d[1:2], *(d[i : i + 2] for i in range(2, 10, 2))]
    return rng.choice([" ".join(pairs), ".".join(pairs), f"0{d[1:3]} {d[3:6]} {d[6:8]} {d[8:]}", f"0{d[1:3]} {d[3:6]} {d[6:8]}"])


def other_numbers(rng: random.Random) -> str:
    """Numbers that are no personal data and have as many digits."""
    year, two = rng.randrange(1950, 2050), lambda: f"{rng.randrange(1, 29):02d}"
    return rng.choice([f"{year}-{two()}-{two()} {two()}:{two()}", f"{two()}.{two()}.{year} {two()}:{two()}", f"{year} {year + 1} {year + 2}", f"{year}-{year + 1} {year + 2}"])


def train(texts: list[str], seed: int = 5) -> np.ndarray | None:
    """Weights fitted on the islands of the texts and their rewritten copies."""
    rng, examples = random.Random(seed), []

    def add(text: str, gold: list[Span]) -> None:
        for start, end in islands(text):
            parts, spans = candidates(text, start, end)
            if not spans:
                continue
            at = {(parts[i][0], parts[j - 1][1]): k for k, (i, j) in enumerate(spans)}
            known = [(at[s, e], KINDS.index(kind)) for s, e, kind in gold if (s, e) in at]
            x = np.array([span_features(text, parts[i][0], parts[j - 1][1]) for i, j in spans])
            examples.append((len(parts), spans, x, known))

    for text in texts:
        gold = pattern_spans(text)
        add(text, gold)
        for s, e, kind in gold:
            value = rewritten(text[s:e], kind, rng)
            # Words around it, without the pieces of other data that the cut leaves.
            left, right = (SEED.sub("", t) for t in (text[max(0, s - 20) : s], text[e : e + 20]))
            add(left + value + right, [(len(left), len(left) + len(value), kind)])
            if kind == "phone":
                for _ in range(3):
                    value = grouped(text[s:e], rng)
                    add(left + value + right, [(len(left), len(left) + len(value), kind)])
                add(left + other_numbers(rng) + right, [])
    if not examples:
        return None
    field, pace = Field(np.zeros((len(KINDS), N_FEATURES))), np.full((len(KINDS), N_FEATURES), 1e-6)
    for _ in range(EPOCHS):
        for part in range(0, len(examples), 32):
            batch = examples[part : part + 32]
            step = sum(field.gradient(*e) for e in batch) / len(batch) - RIDGE * field.weights
            pace += step**2
            field.weights = field.weights + RATE * step / np.sqrt(pace)
    return field.weights


def stretches(text: str) -> dict[str, tuple[int, str]]:
    """For each kind of pattern span, and for islands without one (""): of the stretches of the text the one with the least
    hash, as (hash, stretch of whole words)."""
    base, found = pattern_spans(text), {}
    merged = Covered(base)
    free = [(start, end, "") for start, end in islands(text) if not merged.touches(start, end)]
    for start, end, kind in (*base, *free):
        low, high = max(0, start - 60), min(len(text), min(end, start + 200) + 40)
        low = low if low == 0 else text.find(" ", low, start) + 1 or start
        high = high if high == len(text) else max(text.rfind(" ", end, high), min(end, high))
        stretch = text[low:high]
        place = xxhash.xxh3_64_intdigest(stretch) >> 1
        if kind not in found or (place, stretch) < found[kind]:
            found[kind] = (place, stretch)
    return found


class Covered:
    """Places that spans cover."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, end - 1) - 1
        return at >= 0 and self.ends[at] > start


def sample_texts(docs: DataFrame, most: int) -> list[str]:
    """At most ``most`` stretches: for each kind, and for islands without a pattern span, the one with the least hash in each
    of ``most`` / 5 hash buckets, over all documents."""
    each = max(1, most // (len(KINDS) + 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(kind, *x) for text in batch.column(0).to_pylist() for kind, x in stretches(text).items()]
            kinds, places, texts = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=["kind", "place", "stretch"])

    rows = docs.select(text_or_empty().alias("text")).where(F.col("text").rlike("[0-9@]")).mapInArrow(cut, "kind string, place long, stretch string")
    least = rows.groupBy("kind", (F.col("place") % each).alias("bucket")).agg(F.min(F.struct("place", "stretch")).alias("least"))
    return [r["least"]["stretch"] for r in sorted(least.collect(), key=lambda r: (r["kind"], r["bucket"]))]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def personal_data(docs: DataFrame, most: int = SAMPLE, margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, counts of the pattern spans, base_spans, spans (pattern and added ones)."""
    weights = train(sample_texts(docs, most))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, base_sha256 string, spans string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = None if weights is None else Field(weights)
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            columns: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1).to_pylist():
                if SEED.search(text) is None:
                    values = (0, 0, 0, 0, "", nothing, "")
                else:
                    base = pattern_spans(text)
                    extra = [] if field is None else [s for i in islands(text) for s in field.best(text, *i, margin)]
                    taken = Covered(base)
                    extra = [s for s in dict.fromkeys(extra) if not taken.touches(s[0], s[1])]
                    line = joined(base)
                    every = sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                    counts = [sum(s[2] == kind for s in base) for kind in KINDS]
                    values = (*counts, line, hashlib.sha256(line.encode()).hexdigest(), joined(every))
                for column, value in zip(columns, values):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)
