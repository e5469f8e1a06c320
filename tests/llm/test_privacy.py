import hashlib
import itertools

import numpy as np
import pytest

from riskframe.llm import privacy
from tests.llm.tables import documents, same, with_clashes

#: Numbers and addresses reserved for examples.
TEXTS = [
    "mail joe.doe+x@mail.example.com, or 192.0.2.17 now",
    "card 4111 1111 1111 1111 or 4111111111111112 no",
    "call +1 (201) 555-0123 today, not +12",
    "both 4111111111111111 4111111111111111 run on",
    "300.1.1.1 and 1.2.3.4.5.6.7.8 and 001.002.003.004",
    "a@b a@b. @x.y x@y.z.",
    None, "", "no data here at all", "version 1.2.3 and 2020-01-01", "+1 (201) 555-0123 4111111111111111",
]


def rows_of():
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(TEXTS * 3)]
    for i in range(60):
        rows.append((100 + i, f"word {i} see user{i}.x@mail{i % 9}.example.com and 10.{i}.0.7, +1 (20{i % 9}) 555-01{i:02d} or 4111111111111111 end", "en", "a", 0))
    return rows + [(900, "x " * 60_000 + "z@z.example.com", "en", "a", 0)]


def test_patterns():
    spans = {t: privacy.pattern_spans(t or "") for t in TEXTS}
    assert spans[TEXTS[0]] == [(5, 31, "email"), (36, 46, "ip")] or [s[2] for s in spans[TEXTS[0]]] == ["email", "ip"]
    assert [s[2] for s in spans[TEXTS[1]]] == ["card"]
    assert [s[2] for s in spans[TEXTS[2]]] == ["phone"]
    assert spans[TEXTS[3]] == []  # one run of 32 digits, and no second try
    assert [TEXTS[4][a:b] for a, b, _ in spans[TEXTS[4]]] == ["1.2.3.4", "5.6.7.8", "001.002.003.004"]
    assert [TEXTS[5][a:b] for a, b, _ in spans[TEXTS[5]]] == ["x@y.z"]


def test_query_columns(spark):
    rows = rows_of()
    got = privacy.personal_data(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        base = privacy.pattern_spans(text[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in privacy.KINDS]
        every = [x for x in r.spans.split(",") if x]
        assert set(line.split(",")) - {""} <= set(every)
        places = [tuple(map(int, x.split(":")[1:])) for x in every]
        assert places == sorted(places, key=lambda p: p[0])
        if "no data" in text[r.doc_id] or "version" in text[r.doc_id]:
            assert r.spans == ""


def test_the_field_adds_forms_without_a_pattern(spark):
    weights = privacy.train(privacy.sample_texts(documents(spark, rows_of()), 500))
    field = privacy.Field(weights)
    add = lambda t: [s for i in privacy.islands(t) for s in field.best(t, *i, privacy.MARGIN)]
    cases = ["4111111111111111 4111111111111111", "ask (201) 555-0123 now", "write joe[at]mail.example.com ok"]
    assert [[t[a:b] for a, b, _ in add(t)] for t in cases] == [["4111111111111111"] * 2, ["(201) 555-0123"], ["joe[at]mail.example.com"]]
    for clean in ("in 2019 about 120 people", "token 8f3a9c0d11e2 v1.2.3", "order 4111111111111112 x", "pages 12-15, 2020-01-02"):
        assert add(clean) == []


def test_dynamic_program_and_gradient_match_brute_force():
    rng = np.random.default_rng(0)
    field = privacy.Field(rng.normal(size=(len(privacy.KINDS), privacy.N_FEATURES)))
    text = "x 4111 1111 1111 1111 10.0.0.1 (201) 555-0123 y"
    parts, spans, x, scores = field.chart(text, 0, len(text))
    choices = [(a, k) for a in range(len(spans)) for k in range(len(privacy.KINDS))]
    sets = [()]
    for size in (1, 2, 3):
        for many in itertools.combinations(choices, size):
            places = sorted(spans[a] for a, _ in many)
            if all(p[1] <= q[0] for p, q in zip(places, places[1:])):
                sets.append(many)
    totals = np.array([sum(scores[a, k] for a, k in s) for s in sets])
    best = sets[int(totals.argmax())]
    assert sorted((parts[spans[a][0]][0], parts[spans[a][1] - 1][1], privacy.KINDS[k]) for a, k in best) == field.best(text, 0, len(text), -np.inf)
    chance = np.exp(totals - np.logaddexp.reduce(totals))
    expected = np.zeros_like(scores)
    for s, p in zip(sets, chance):
        for a, k in s:
            expected[a, k] += p
    assert field.gradient(len(parts), spans, x, []) == pytest.approx(-expected.T @ x)


def test_empty_and_clashes(spark):
    assert privacy.personal_data(documents(spark, [])).collect() == []
    docs = documents(spark, rows_of())
    assert same(privacy.personal_data(docs), privacy.personal_data(with_clashes(docs)))


def test_spelled_addresses_and_grouped_phones(spark):
    field = privacy.Field(privacy.train(privacy.sample_texts(documents(spark, rows_of()), 500)))
    add = lambda t: [t[a:b] for i in privacy.islands(t) for a, b, _ in field.best(t, *i, privacy.MARGIN)]
    for value in ("john at example dot com", "06 12 34 56 78", "01.23.45.67.89", "030 123 45 67"):
        assert add(f"so ask {value} now") == [value]
    for clean in ("we sat at home. The dot is red", "on 2021-03-04 12:30 we met", "years 1999 2000 2001 passed"):
        assert add(clean) == []


def plain_spans(text):
    """The stated patterns as they are written, with a plain search."""
    import re

    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == "card" and 12 <= len(digits) <= 19 and privacy.luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], privacy.KINDS.index(s[2]), s[1]))


def test_patterns_as_a_plain_search():
    import random

    rng = random.Random(3)
    pieces = list("@.-+ ()ab1290") + ["a@b.c", "1.2.3.4", "4111111111111111", "+1 (201) 555-0123", "@@", "x" * 5, "99" * 4, "\n", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        assert privacy.pattern_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000 + "@", "a@" * 500_000, "1." * 500_000, "0" * 1_000_000 + ".0.0.0", "+1" + " " * 1_000_000, "a@" + "b-" * 500_000, "+1 " * 300_000])
def test_long_runs_take_time_in_proportion(text):
    import time

    start = time.process_time()
    privacy.pattern_spans(text)
    list(privacy.islands(text))
    assert time.process_time() - start < 10  # about a second; a search from every start would take an hour


def test_long_islands_and_bounded_entities():
    import time

    field = privacy.Field(np.zeros((len(privacy.KINDS), privacy.N_FEATURES)))
    for text in ("1234 5678 " * 10_000, "9" * 200_000 + " 1 2", "x@" * 50_000):
        start = time.process_time()
        for a, b in privacy.islands(text):
            field.best(text, a, b, 0.0)
        assert time.process_time() - start < 30
    parts, spans = privacy.candidates("4111 1111 1111 1111 ", 0, 20)
    assert [(parts[i][0], parts[j - 1][1]) for i, j in spans if j - i == 4] == [(0, 19)]
    assert all(parts[j - 1][1] - parts[i][0] <= privacy.ENTITY_CHARS for i, j in privacy.candidates("a" * 300 + "@example.com", 0, 312)[1])


def test_rare_kinds_are_learnt_among_many_numbers(spark):
    """Nearly all numbers are years and prices; the sample still holds stretches of every kind."""
    plain = [(i, f"in {1900 + i % 120} it cost {i}.50 euros, item {i * 7919} of {i * 31}", "en", "a", 0) for i in range(3000)]
    rare = [(5000 + i, t, "en", "a", 0) for i, (_, t, *_) in enumerate(rows_of()[-41:-1])]
    texts = privacy.sample_texts(documents(spark, plain + rare), 300)
    assert len(texts) <= 300
    counts = {kind: sum(any(s[2] == kind for s in privacy.pattern_spans(t)) for t in texts) for kind in privacy.KINDS}
    assert all(n >= 20 for n in counts.values()) and sum(not privacy.pattern_spans(t) for t in texts) >= 40
    field = privacy.Field(privacy.train(texts))
    add = lambda t: [t[a:b] for i in privacy.islands(t) for a, b, _ in field.best(t, *i, privacy.MARGIN)]
    assert add("ask (201) 555-0123 now") == ["(201) 555-0123"] and add("write joe[at]mail.example.com ok") == ["joe[at]mail.example.com"]
    assert add("in 1987 it cost 12.50 euros, item 5543300") == []


def test_the_sample_does_not_depend_on_partitions(spark):
    docs = documents(spark, rows_of())
    assert privacy.sample_texts(docs.repartition(1), 100) == privacy.sample_texts(docs.repartition(7), 100)
