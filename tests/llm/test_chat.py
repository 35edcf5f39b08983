import re

import pytest
from pyspark.sql import functions as F

from versio.llm import chat

NASTY = ["", "\\", "\\\\", "###", "####", "#####x", "### User: hi", "</turn>", " </turn>\n", "<</turn>>", "\\### Assistant: </turn> ok", "a\nb\r\n", "$0 $1", "### Role x: y", "\\</turn>\\", "é#\\##", "x" * 300_000]


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int")


def test_escaping_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescaped(F.col("e")).alias("back")).collect():
        assert r.back == r.t and "###" not in r.e and "</turn>" not in r.e


def test_every_text_is_read_back(spark):
    rows = [(k, n, role, t) for k, t in enumerate(NASTY) for n, role in enumerate(["system", "user", "assistant"])]
    out = chat.format_conversations(talk(spark, rows)).withColumn("back", chat.read_back(F.col("formatted")))
    for r in out.collect():
        t = NASTY[r.conv_id]
        assert [(x.role, x.text, x.loss) for x in r.back] == [("system", t, False), ("user", t, False), ("assistant", t, True)]
        assert "".join(s.text for s in r.segments) == r.formatted and r.valid and r.bad_turn is None
        assert [s.loss for s in r.segments] == [False] * 7 + [True] + [False]
        assert len(re.findall(r" </turn>\n", r.formatted)) == 3


@pytest.mark.parametrize("roles,bad", [("ua", None), ("sua", None), ("uaua", None), ("u", 1), ("a", 0), ("su", 2), ("uu", 1), ("uaa", 2), ("usa", 1), ("s", 1), ("xua", 0), ("ss", 1)])
def test_state_machine(spark, roles, bad):
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    r = chat.format_conversations(talk(spark, [(1, k, names[c], "t") for k, c in enumerate(roles)])).first()
    assert (r.valid, r.bad_turn) == (bad is None, bad)


def test_cases(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (2, 0, None, "no role"), (3, 0, "a: b", "### odd role"), (3, 1, "System", "x"), (None, 0, "user", "n"), (None, None, "user", "first"), (4, 0, "user", "b"), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 0, "### User", "z")]
    out = chat.format_conversations(talk(spark, rows)).withColumn("back", chat.read_back(F.col("formatted")))
    got = {r.conv_id: [(x.role, x.text) for x in r.back] for r in out.collect()}
    assert got == {1: [("user", "q"), ("assistant", "")], 2: [("", "no role")], 3: [("a: b", "### odd role"), ("System", "x")], None: [("user", "first"), ("user", "n")], 4: [("user", "a"), ("user", "a"), ("user", "b")], 5: [("### User", "z")]}
    assert chat.format_conversations(talk(spark, rows).limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_another_template(spark):
    t = chat.Template(headers={"user": "U> ", "bot": "B> "}, loss=("bot",), moves={chat.START: ("user",), "user": ("bot",), "bot": ("user",)}, finals=("bot",), end=" </turn>|")
    r = chat.format_conversations(talk(spark, [(1, 0, "user", "a </turn>|"), (1, 1, "bot", "U> ###")]), t).withColumn("back", chat.read_back(F.col("formatted"), t)).first()
    assert r.valid and [(x.role, x.text, x.loss) for x in r.back] == [("user", "a </turn>|", False), ("bot", "U> ###", True)]
