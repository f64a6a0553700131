"""Digests against Python, and the round trip of any text."""

import hashlib
import random

from lorekeep.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int, mask int"


def want(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((-(2**63) if r[1] is None else r[1], r[2] or "", r[3] or ""))
    out = set()
    for c, turns in by.items():
        turns.sort()
        all_ = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.add((c, len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    masked = chat.with_loss_mask(chat.format_conversations(df))
    assert {tuple(r)[:5] for r in chat.digests(masked).collect()} == want(rows)
    for r in masked.collect():
        assert sum(m.chars for m in r["mask"]) == len(r.formatted)
        at, shown = 0, []
        for m in r["mask"]:
            if m.loss:
                shown.append(r.formatted[at : at + m.chars])
            at += m.chars
        assert shown == [t.raw for t in r.turns if t.role == "assistant"]


def test_conflicts(spark):
    r = random.Random(2)
    bits = ["\\", "###", "#", "### User: ", "### Assistant: ", "</turn>", "\n</turn>\n", "\n", "ok", "\U0001f600", "$1", "@", ": "]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool: x\n", "", None, "User", "@"]), "".join(r.choice(bits) for _ in range(r.randrange(9)))) for c in range(300) for t in range(r.randrange(1, 6))]
    check(spark, rows)


def test_edges(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "user", None), (1, None, "assistant", ""), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 0, "user", "x")]
    check(spark, rows + [(3, 0, "assistant", "long " * 200_000)])
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plain_text_is_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a \\ b # c", "x", 1, 2)], SCHEMA)
    assert chat.format_conversations(df).first().formatted == "### User: a \\ b # c\n</turn>\n"
