import hashlib

from riskframe.llm import chat
from riskframe.llm.queries import PROBE

TURNS = "conv_id long, turn long, role string, text string"


def rows_of(n_conv=12):
    out = []
    for c in range(n_conv):
        if c % 3 == 0:
            out.append((c, 0, "system", "be [kind] & <brief> " + "s " * c))
        for t in range(1, 4 + c * 3):
            out.append((c, t, ("user", "assistant")[t % 2], f"turn {t} <|turn|>user\n&lt; [x] " + "word " * ((t * 37) % 200)))
    out += [(50, None, None, None), (50, 1, "assistant", ""), (50, 1, "assistant", PROBE), (50, 1, "assistant", PROBE), (51, 0, "us\ner<", "😀" * 5)]
    out += [(52, t, "assistant", "long " * 3000) for t in range(3)] + [(None, 0, "user", "no id"), (None, 1, "assistant", "none")]
    return out


def turns(rows):
    out: dict = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: sorted(v) for c, v in out.items()}


def test_round_trip(spark):
    rows = rows_of()
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS), budget=300, history=60)
    got = {r.conv_id: r for r in chat.read_windows(windows).collect()}
    want = turns(rows)
    assert set(got) == set(want)
    for c, many in want.items():
        assert got[c].turns == "".join(f"{role}\n{text}\n" for _, _, role, text in many)
        assert got[c].loss == "".join(text for _, _, role, text in many if role == "assistant")
        assert got[c].n_turns == len(many)


def test_budget_system_and_history(spark):
    rows = rows_of()
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS), budget=400, history=60).collect()
    longest = {c: max(len(x[3].split()) + 1 for x in many) for c, many in turns(rows).items()}
    parts: dict = {}
    for w in windows:
        parts.setdefault(w.conv_id, []).append(w)
        own = w.formatted.split(chat.TURN)[1:]
        size = sum(len(chat_text.split()) for chat_text in own)
        assert len(own) == 1 or size <= 400 + 2 * len(own) or longest[w.conv_id] > 200
        for start, length in w.loss:
            assert "<" not in w.formatted[start : start + length] and w.formatted[start + length :].startswith(chat.END)
    for c in (3, 6, 9):
        first, *later = sorted(parts[c], key=lambda w: (w.lo, w.hi))
        assert later and first.formatted.startswith(chat.TURN + "system\n")
        for w in later:
            assert w.formatted.startswith(chat.AGAIN + "system\n")
            assert w.formatted.split(chat.TURN)[0].count(chat.AGAIN) <= 3


def test_repeated_history_has_no_loss(spark):
    rows = rows_of()
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS), budget=300, history=60).collect()
    targets = sum(len(w.loss) for w in windows)
    assert targets == sum(r[2] == "assistant" for r in rows)


def test_empty_and_clashes(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], TURNS)
    assert chat.read_windows(chat.format_windows(empty)).collect() == []
    plain = spark.createDataFrame(rows_of(4), TURNS)
    more = plain.select("*", *[F.lit("x").alias(c) for c in ("tokens", "pos", "start", "body", "lo", "hi", "system", "context")])
    digest = lambda df: sorted(hashlib.sha256(repr(r).encode()).hexdigest() for r in chat.format_windows(df).collect())
    assert digest(plain) == digest(more)
