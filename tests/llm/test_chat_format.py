import hashlib

import pytest
from pyspark.sql import functions as F

from lodestore.llm.chat_format import DEFAULT, Template, escape, format_chats, op5_chat_format, read_back, unescape

CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<|im_start|>")


def test_query_equals_brute_force(spark, sf_dir):
    chats = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        chats.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    got = {r.conv_id: r for r in op5_chat_format(spark, sf_dir).collect()}
    assert got.keys() == chats.keys()
    for k, turns in chats.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[k].n_turns, got[k].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), sha(loss))


def test_no_control_string_survives_and_all_come_back(spark):
    rows = [(i, 0, c, f"x{c}y&lt;&amp;{c}<") for i, c in enumerate(CONTROL)]
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns")).collect()}
    for i, _, role, text in rows:
        assert [tuple(t) for t in back[i].turns] == [(role, text)]
        assert all(back[i].formatted.count(c) == (c in CONTROL[:3]) for c in CONTROL)


@pytest.mark.parametrize(
    "roles, ok",
    [("user assistant", True), ("system user assistant user assistant", True), ("user assistant tool assistant", True), ("user", False), ("assistant user", False), ("user user assistant", False), ("user system assistant", False), ("user odd assistant", False)],
)
def test_state_machine(spark, roles, ok):
    rows = [(1, k, r, "t") for k, r in enumerate(roles.split())]
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert out.valid == ok
    assert "".join(s.text for s in out.segments) == out.formatted
    assert [s.text for s in out.segments if s.loss] == ["t"] * roles.split().count("assistant")


def test_another_template(spark):
    other = Template(open="<s>[", after_role="]", close="</s>", loss_roles=("user",), moves={"start": {"user": "done"}}, final=("done",))
    out = format_chats(spark.createDataFrame([(1, 0, "user", "a[b]</s>")], "conv_id long, turn long, role string, text string"), other).first()
    assert out.valid and out.formatted == "<s>[user]a&#91;b]&lt;/s></s>"


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x"), (2, 5, "assistant", "z" * 200000), (2, None, "user", "")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("segments", F.lit(1))
    got = {r.conv_id: r for r in format_chats(chats).select("*", read_back(F.col("formatted")).alias("back")).collect()}
    assert [tuple(t) for t in got[1].back] == [("user", "")] * 2 and not got[1].valid
    assert [tuple(t) for t in got[None].back] == [("", "x")]
    assert [tuple(t) for t in got[2].back] == [("user", ""), ("assistant", "z" * 200000)] and got[2].valid
    assert format_chats(chats.limit(0)).collect() == []


def test_escapes_round_trip(spark):
    texts = ["", "&", "&amp;", "&amp;lt;", "<&[", "&#91;", "&&lt;[<", "é\u0000<"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.t == r.b for r in df.select("t", unescape(escape(F.col("t"), DEFAULT)).alias("b")).collect())
