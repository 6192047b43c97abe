"""Chat formatting: round trips, the mask and the digests, against a plain version."""

import random
from hashlib import sha256

import pytest
from hypothesis import given
from hypothesis import settings as limits
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinfold.llm import chat

BITS = ["<", "[", "\\", "/", "s>", "INST]", "<s>", "</s>", "[INST]", "[/INST]", "[\\INST]", "<\\\\s>", " ", "é", "漢", "\n", "ok", "😀", "$1", ""]
SCHEMA = "conv_id long, turn long, role string, text string, start string, marked string, all int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)


def hostile(seed, n=60):
    rng = random.Random(seed)
    some = lambda: "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9)))
    return [(rng.randrange(9), k, rng.choice(["user", "assistant", "system", "[INST]", None, some()]), rng.choice([None, some(), some(), some()])) for k in range(n)]


def brute(rows):
    out = []
    for i in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == i), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((i, len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_digests_equal_plain_version(spark, seed):
    rows = hostile(seed) + [(None, 0, "user", "no id"), (50, None, "user", "b"), (50, None, "user", "a"), (50, 2, "assistant", "tie"), (50, 2, "assistant", "tie"), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = chat.digests(chat.format_turns(table(spark, rows))).drop("formatted_chars").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_turns_and_mask(spark):
    rows = [(1, 0, "user", "Hi [INST]"), (1, 1, "assistant", "yes </s> é😀"), (1, 2, "assistant", ""), (2, 0, "user", "plain")]
    made = {r.conv_id: r for r in chat.format_turns(table(spark, rows)).collect()}
    assert made[2].formatted == "<s>[INST]user[/INST]plain</s>"
    text, mask = made[1].formatted, made[1].mask
    assert text == "<s>[INST]user[/INST]Hi [\\INST]</s><s>[INST]assistant[/INST]yes <\\/s> é😀</s><s>[INST]assistant[/INST]</s>"
    assert [text[m.loss_start : m.loss_end] for m in mask if m.loss_start is not None] == ["yes <\\/s> é😀", ""]
    assert [text[m.turn_start :][:3] for m in mask] == ["<s>"] * 3
    back = chat.read_back(chat.format_turns(table(spark, rows))).where("conv_id = 1").first()
    assert [tuple(t) for t in back.turns] == [(r[2], r[3]) for r in rows[:3]] and back.loss == ["yes </s> é😀", ""]


def test_only_conflicting_content_is_escaped(spark):
    rows = [(1, 0, "user", "a < b [INST"), (1, 1, "user", "back\\slash <\\ s>")]
    text = chat.format_turns(table(spark, rows)).first().formatted
    assert "a < b [INST</s>" in text and "back\\slash <\\ s></s>" in text


def test_parser_refuses_what_is_no_turn(spark):
    bad = ["", "x", "<s>[INST]user[/INST]a", "<s>[INST]user[/INST]a</s>b", "[INST]user[/INST]a</s>", "<s>[INST]user</s>", "<s>[INST]us[INST]er[/INST]a</s>", "<s>[INST]user[/INST]a[/INST]b</s>"]
    rows = spark.createDataFrame([(b,) for b in bad], "t string").select("t", chat.parsed(F.col("t")).alias("p")).collect()
    assert all(r.p is None or None in r.p or (r.t == "" and r.p == []) for r in rows)


@limits(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=8).map("".join), min_size=1, max_size=12))
def test_escapes_come_back(spark, texts):
    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.unescaped(chat.escaped(c)).alias("back"), chat.escaped(c).rlike(chat.CONTROL).alias("left")).collect()
    assert all(r.back == r.t and not r.left for r in rows)


def test_what_does_not_come_back_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(chat, "escaped", lambda text: text)
    with pytest.raises(PySparkException, match="does not come back"):
        chat.format_turns(table(spark, [(1, 0, "user", "</s>")])).collect()


def test_empty_and_long(spark):
    assert chat.digests(chat.format_turns(table(spark, hostile(1)).where("conv_id > 99"))).collect() == []
    rows = [(1, 0, "user", "word " * 600_000), (1, 1, "assistant", "</s> é" * 100_000)] + [(2, k, "assistant", f"turn {k}") for k in range(3000)]
    got = chat.digests(chat.format_turns(table(spark, rows))).drop("formatted_chars").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_no_python_in_the_plan(spark):
    plan = chat.digests(chat.format_turns(table(spark, hostile(1))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
