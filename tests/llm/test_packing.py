import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskframe.llm import packing
from tests.llm.tables import documents, odd_rows, same, with_clashes


def check(rows, pieces, window=2048):
    model = Tokenizer.from_file(packing.TOKENIZER)
    docs: dict = {}
    for r in rows:
        docs.setdefault(r[0], []).append(np.array([*model.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4"))
    got: dict = {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p)
    assert set(got) == set(docs)
    for i, many in docs.items():
        assert sum(p.length for p in got[i]) == sum(map(len, many))
        for p in got[i]:
            ids = next(d for d in many if len(d) == p.doc_tokens)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    spans = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    at = 0
    for sequence, offset, length in spans:
        assert (sequence, offset) == (at // window, at % window) and offset + length <= window
        at += length


def test_pieces(spark):
    rows = odd_rows()
    check(rows, packing.digests(packing.pack(documents(spark, rows))).collect())


def test_small_window(spark):
    rows = odd_rows()
    check(rows, packing.digests(packing.pack(with_clashes(documents(spark, rows)), window=64)).collect(), 64)


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}])
def test_windows_keep_the_mixture(spark, weights):
    rows = [(i, " ".join(f"w{j}" for j in range(20)), "en", "ab"[i % 4 == 0], 0) for i in range(300)]
    given = None if weights is None else spark.createDataFrame(list(weights.items()), "source string, weight double")
    pieces = packing.digests(packing.pack(documents(spark, rows), window=256, weights=given)).collect()
    check(rows, pieces, 256)
    source = {r[0]: r[3] for r in rows}
    share, total = 0.75, 0
    served = {"a": 0, "b": 0}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        served[source[p.doc_id]] += p.length
        total += p.length
        assert abs(served["a"] - share * total) <= 256


def test_deficit_round_robin(spark):
    """The order equals that of a simulated deficit round-robin."""
    sizes = [(i, i, "abc"[i % 3], 1 + (i * 7919) % 90) for i in range(60)]
    table = spark.createDataFrame(sizes, "row_id long, doc_id long, source string, n long")
    plan = packing.packing_plan(table, 100).collect()
    order = list(dict.fromkeys(p.row_id for p in sorted(plan, key=lambda p: (p.sequence_id, p.offset))))
    queues: dict = {}
    for i in order:
        queues.setdefault("abc"[i % 3], []).append(i)
    total = sum(s[3] for s in sizes)
    quantum = {q: 100 * sum(s[3] for s in sizes if s[2] == q) / total for q in queues}
    credit, served = dict.fromkeys(queues, 0.0), []
    rounds: list = []
    while any(queues.values()):
        now = set()
        for q, waiting in queues.items():
            credit[q] += quantum[q]
            while waiting and sizes[waiting[0]][3] <= credit[q] + 1e-9:
                credit[q] -= sizes[waiting[0]][3]
                now.add(waiting.pop(0))
        rounds.append(now)
    for now in rounds:
        assert set(order[len(served) : len(served) + len(now)]) == now
        served += list(now)


def test_runs_and_texts_agree():
    known, model = packing.TokenIds(packing.TOKENIZER), Tokenizer.from_file(packing.TOKENIZER)
    for text in ("It's  DON'T\tİstanbul x <|endoftext|>y ÀÉ é ΣΑΣ 12345 !!?\r\n", "\x0b\x0c a\x1cb c", "", "   "):
        runs = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        assert np.frombuffer(b"".join(map(known.__getitem__, runs)), "<u2").tolist() == model.encode(text, add_special_tokens=False).ids


def test_empty_and_repeat(spark):
    assert packing.digests(packing.pack(documents(spark, []))).collect() == []
    docs = documents(spark)
    assert same(packing.digests(packing.pack(docs)), packing.digests(packing.pack(docs)))


def test_every_window_holds_the_shares(spark):
    """Not only in total: whole documents of up to a window would leave most sources out of it."""
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(150 + i % 90)), "en", f"s{i % 10}", 0) for i in range(200)]
    pieces = packing.digests(packing.pack(documents(spark, rows), window=512)).collect()
    check(rows, pieces, 512)
    held: dict = {}
    total = dict.fromkeys((f"s{i}" for i in range(10)), 0)
    for p in pieces:
        source = f"s{p.doc_id % 10}"
        total[source] += p.length
        held.setdefault(p.sequence_id, dict.fromkeys(total, 0))[source] += p.length
    full = [h for h in held.values() if sum(h.values()) == 512]
    away = [sum(abs(h[s] / 512 - total[s] / sum(total.values())) for s in total) / 2 for h in full]
    assert len(full) > 50 and sum(away) / len(away) < 0.15


def test_copies_of_the_mix_lie_apart(spark, tmp_path):
    """A written mix is packed in its order: the copies of a document are a whole pass over its source apart."""
    from riskframe.llm import mixing

    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en", "big" if i % 5 else ("b", "c")[i % 2], 0) for i in range(400)]
    mixing.mixed_documents(documents(spark, rows)).write.parquet(f"{tmp_path}/mix")
    mix = spark.read.parquet(f"{tmp_path}/mix")
    copies = [r.doc_id for r in mix.groupBy("doc_id").count().where("count > 1").collect()]
    assert len(copies) > 30
    pieces = packing.digests(packing.pack(mix, window=256, ordered=True)).collect()
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    last = max(p.sequence_id for p in pieces)
    for i in copies:
        at = sorted(p.sequence_id for p in pieces if p.doc_id == i and p.start == 0)
        assert min(b - a for a, b in zip(at, at[1:])) > last / 10


def test_rows_that_share_an_id_lie_apart(spark):
    rows = [(7 if i % 3 == 0 else i, f"text number {i} of many", "en", "a", 0) for i in range(300)]
    pieces = packing.digests(packing.pack(documents(spark, rows), window=64)).collect()
    at = sorted({p.sequence_id for p in pieces if p.doc_id == 7})
    assert len(at) > 20 and at[-1] - at[0] > 0.8 * max(p.sequence_id for p in pieces)


def test_ids_of_words_are_those_of_the_tokenizer():
    """Words that go to the merges directly, with and without a sign, in any case, and those that do not."""
    import random

    rng, known = random.Random(1), packing.TokenIds(packing.TOKENIZER)
    assert known.direct
    letters = "abcdeXYZ'" + "éüñÀŁőßÿĳŉ" + "µªº" + "Ωσςıİ中😀" + "0123" + ".,;:!?-" + "e\u0301"
    for _ in range(3000):
        run = "".join(rng.choice(letters[: rng.choice((9, 19, len(letters)))]) for _ in range(rng.randrange(1, 12)))
        want = np.array(known.model.encode(run, add_special_tokens=False).ids, "<u2").tobytes()
        assert known[run] == want, run
