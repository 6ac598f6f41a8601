from __future__ import annotations

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from arcweave.llm import chat

NASTY = st.text(alphabet="<|\\im_endstar>n\n é", max_size=40)


@given(st.lists(st.tuples(NASTY, NASTY), max_size=6))
def test_template_round_trip(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[s:e]) for s, e in spans] == [t for r, t in turns if r == "assistant"]


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (
        len(turns),
        hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
        len(loss),
        hashlib.sha256(loss.encode()).hexdigest(),
    )


def test_linear_conversations(spark):
    rows = [(1, 1, "assistant", "héllo <|im_end|>"), (1, 0, "user", None), (2, 0, "user", "x"), (None, 0, None, "y"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, 5, "assistant", "a")]
    rows += [(4, k, ["user", "assistant"][k % 2], f"turn {k}") for k in range(37)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS id", "'x' AS parent", "'x' AS leaf")
    found = chat.read_back(chat.format_conversations(chat.linear_trees(chat.with_control(spark, table)))).collect()
    expected = {}
    for conv, _, role, text in sorted([*rows, (-1, 0, "user", chat.CONTROL), (-1, 1, "assistant", chat.CONTROL)], key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        expected.setdefault(conv, []).append((role or "", text or ""))
    assert {r.conv_id: tuple(r)[1:5] for r in found} == {k: digest(v) for k, v in expected.items()}
    assert len(found) == len(expected)


def test_trees_rank_branches(spark):
    rows = [
        (1, "r", None, 0.0, "user", "q"), (1, "a", "r", 1.0, "assistant", "good"), (1, "b", "r", 3.0, "assistant", "better"),
        (1, "c", "a", 5.0, "user", "deep"), (2, "s", "missing", None, "user", "alone"), (3, "x", "y", 0.0, "user", "cycle"), (3, "y", "x", 0.0, "user", "cycle"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, id string, parent string, score double, role string, text string")
    one = {r.leaf: chat.parse_turns(r.formatted) for r in chat.format_conversations(table).collect()}
    assert one == {"c": [("user", "q"), ("assistant", "good"), ("user", "deep")], "s": [("user", "alone")]}
    two = {r.leaf for r in chat.format_conversations(table, per_root=2).collect()}
    assert two == {"c", "b", "s"}


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(chat.linear_trees(none))).collect() == []
