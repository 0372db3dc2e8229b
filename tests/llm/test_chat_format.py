"""Round trips of formatted conversations; digests against plain Python."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evispark.llm import chat_format as cf

PARTS = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/ROLE]", "[ROLE]", "[/TURN]", "<", "[", "\\", "/s>", "INST]", "\n", "a", "", "é😀"])
TEXTS = st.lists(PARTS, max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXTS), TEXTS), max_size=5))
def test_any_turns_come_back(turns):
    rendered = [cf.render(*t) for t in turns]
    back = cf.parse("".join(s for s, _ in rendered))
    assert [(t.role, t.text) for t in back] == turns
    for (s, t), (role, text) in zip(rendered, turns, strict=True):
        assert (t.role, cf.unescaped(s[t.start : t.end])) == (role, text)


def test_plain_text_is_left_alone_and_conflicts_are_escaped():
    assert cf.render("user", r"C:\s> [x] \ <")[0] == r"[INST]C:\s> [x] \ <[/INST]"
    assert cf.render("assistant", "</s>[INST] ok [/INST]")[0] == r"<s><\/s>[\INST] ok [\/INST]</s>"
    assert cf.render("user", r"<\s>")[0] == r"[INST]<\\s>[/INST]"


@pytest.mark.parametrize("wrong", ["x", "[INST]a", "[/INST]", "[INST]a[/INST] [INST]b[/INST]", "[INST]a</s>", "[ROLE]a[/TURN]", "[NAMED]"])
def test_the_parser_refuses_what_isnt_a_conversation(wrong):
    with pytest.raises(cf.Conflict):
        cf.parse(wrong)


SCHEMA = "conv_id long, turn long, role string, text string, c string, formatted string"


def test_digests_of_odd_conversations(spark):
    long = "</s>" * 200_000
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, "tool\n[ROLE]", "<s>"), (1, 3, "assistant", "</s>[INST] ok"), (2, 0, None, ""), (2, 0, None, ""), (None, 5, "system", "x"), (3, None, "assistant", long), (3, 7, "user", "z"),
            (4, 0, "user", "b"), (4, 0, "user", "a")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = {r["conv_id"]: r for r in cf.read_back(cf.format_chat(docs)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        turns = sorted(((-1 if t is None else t, role or "", x or "") for c, t, role, x in rows if c == conv))
        learnt = "".join(x for _, role, x in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{x}\n" for _, role, x in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), sha(learnt))
        assert r["formatted_chars"] == sum(len(cf.render(role, x)[0]) for _, role, x in turns)
    assert cf.read_back(cf.format_chat(docs.where("false"))).collect() == []


def test_a_hot_conversation_is_streamed(spark):
    turns = spark.range(30_000).selectExpr("7 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    (r,) = cf.read_back(cf.format_chat(turns)).collect()
    assert r["n_turns"] == 30_000 and r["loss_sha256"] == hashlib.sha256("".join(f"t{i}" for i in range(1, 30_000, 2)).encode()).hexdigest()
    plan = cf.read_back(cf.format_chat(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("MapInArrow") == 2
