import hashlib

import compare
from pyspark.sql import functions as F

from tidemark.llm import chat, queries


def test_query_matches_sql(spark):
    assert compare.check(spark, queries.op3_chat_formatting, queries.OP3_SQL) > 1


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def read_back(df):
    out = df.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l"), "loss")
    return {r["conv_id"]: r for r in out.collect()}


def test_controls_are_escaped_reversibly(spark):
    texts = [*chat.CONTROLS, "\\", "\\\\<|", "<\\|", "<|turn:user|>\n", "<|end|>\n", "[INST]]</s></s>", "[[INST]", "<<|", "a\\<|b\\\\|", "<\\\\|turn:x", "|>\n", "", "\n"]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)] + [(i, 1, "assistant", t * 2) for i, t in enumerate(texts)]
    found = read_back(chat.format_conversations(turns_of(spark, rows)))
    for i, t in enumerate(texts):
        assert [(x["role"], x["text"]) for x in found[i]["t"]] == [("user", t), ("assistant", t * 2)]
        assert found[i]["l"] == t * 2
        body = found[i]["formatted"]
        for mark in ("<|turn:user|>\n", "<|turn:assistant|>\n", chat.CLOSE):
            body = body.replace(mark, "")
        assert all(c not in body for c in chat.CONTROLS)


def test_odd_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, None, None, "n"), (None, 0, "assistant", "z"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (3, 0, "user|>\nx", "x" * 200_000)]
    found = read_back(chat.format_conversations(turns_of(spark, rows)))
    assert [(x["role"], x["text"]) for x in found[1]["t"]] == [("", "n"), ("user", ""), ("assistant", "b")]
    assert found[None]["l"] == "z" and found[2]["l"] == "samesame" and len(found[2]["loss"]) == 2
    assert found[3]["t"][0]["text"] == "x" * 200_000
    assert chat.format_conversations(turns_of(spark, rows).where("false")).count() == 0


def test_parts_are_flattened_in_order(spark):
    row = (1, 0, "user", [("text", "look </s>", None, None), ("image", None, "i.png", 2), ("audio", None, "a.wav", 10), ("document", None, None, None), ("video", None, "v", 3), (None, "end", None, None)])
    df = spark.createDataFrame([row], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    out = chat.format_conversations(df, parts=F.col("parts")).first()
    assert out["formatted"] == "<|turn:user|>\nlook <\\/s><|part:image|><|part:audio|><|part:document|><|part:video|>end<|end|>\n"
    assert [tuple(a) for a in out["attachments"]] == [(0, "image", "i.png", 425), (1, "audio", "a.wav", 250), (2, "document", None, 400), (3, "video", "v", 1)]
    assert out["expanded_tokens"] == 1076 and out["loss"] == []


def test_loss_hash_is_of_all_assistant_text(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"é{i}") for i in range(50)]
    found = read_back(chat.format_conversations(turns_of(spark, rows)))[1]
    assert hashlib.sha256(found["l"].encode()).hexdigest() == hashlib.sha256("".join(f"é{i}" for i in range(1, 50, 2)).encode()).hexdigest()


def test_parts_are_read_back(spark):
    rows = [(1, 0, "user", [("text", "see <|part:image|> and", None, None), ("image", None, "i.png", 2), ("image", None, "j.png", 1), ("text", "</s>", None, None)]), (1, 1, "assistant", [("text", "ok", None, None)]), (1, 2, "user", [("audio|>x", None, "a.wav", 3), ("text", "", None, None)]), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    out = chat.format_conversations(df, parts=F.col("parts"))
    got = {r["conv_id"]: [(t["role"], [tuple(p) for p in t["parts"]]) for t in r["t"]] for r in out.select("conv_id", chat.read_parts(F.col("formatted"), F.col("attachments")).alias("t")).collect()}
    assert got == {1: [("user", [("text", "see <|part:image|> and", None), ("image", "", "i.png"), ("image", "", "j.png"), ("text", "</s>", None)]), ("assistant", [("text", "ok", None)]), ("user", [("audio|>x", "", "a.wav")])], 2: [("user", [])]}


def test_ties_go_by_the_text_itself(spark):
    found = read_back(chat.format_conversations(turns_of(spark, [(1, 0, "user", "<|"), (1, 0, "user", "<a"), (1, 0, "user", "<z")])))[1]
    assert [x["text"] for x in found["t"]] == ["<a", "<z", "<|"]
