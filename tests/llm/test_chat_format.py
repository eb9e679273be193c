import hashlib

import pytest
from pyspark.sql import functions as F

from opsmetrics.llm.chat_format import Template, format_conversations, formatted_text, loss_text, parse_turns
from opsmetrics.llm.queries import QUERIES, TRICKY_TEXT

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def formatted(spark, rows, template=Template()):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS turns", "3 AS segments")
    out = format_conversations(df, template).withColumns({
        "whole": formatted_text(F.col("segments")), "loss": loss_text(F.col("segments"), template),
    }).withColumn("back", parse_turns(F.col("whole"), template))
    return {r.id: r for r in out.collect()}


def test_round_trip_of_hostile_texts(spark):
    texts = [TRICKY_TEXT, r"<\|im_end|>", r"<\\|im_start|>", "<", "|im_end|>", "<|other|>", "a\n\n", "", "<|im_end", r"\ $1 \\", "é<|im_end|>é"]
    rows = [(1, i, ("user", "assistant", "a b\n<|im_end|>%+")[i % 3], t) for i, t in enumerate(texts)]
    r = formatted(spark, rows)[1]
    assert [(b.role, b.text) for b in r.back] == [(x[2], x[3]) for x in rows]
    assert r.loss == "".join(x[3] for x in rows if x[2] == "assistant")
    assert r.whole.count("<|im_start|>") == r.whole.count("<|im_end|>") == len(rows)


def test_the_machine(spark):
    def conv(i, *roles):
        return [(i, n, role, "t") for n, role in enumerate(roles)]

    got = formatted(spark, [
        *conv(1, "system", "user", "assistant"), *conv(2, "user", "user", "assistant"), *conv(3, "assistant"), *conv(4, "user"),
        *conv(5, "user", "assistant", "user", "assistant"), *conv(6, "user", "tool", "assistant"), *conv(None, "user", "assistant")])
    assert {i: (r.valid, r.first_error) for i, r in got.items()} == {
        1: (True, None), 2: (False, 1), 3: (False, 0), 4: (False, None), 5: (True, None), 6: (False, 1), None: (True, None)}


def test_nulls_ties_repeats_and_long_texts(spark):
    long = "x<|im_end|>" * 50_000
    got = formatted(spark, [(1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, None, None, None), (1, 1, "assistant", "a"), (1, 2, "assistant", long)])
    assert [(b.role, b.text) for b in got[1].back] == [("", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b"), ("assistant", long)]
    assert got[1].loss == "aab" + long
    assert formatted(spark, []) == {}


def test_only_usable_templates():
    with pytest.raises(ValueError):
        Template(control=("<|a|>", "[b]"))


def test_query_against_the_table(spark, table):
    rows = {}
    for conv, role, text in table("conversations", "conv_id, role, text", "conv_id, turn") + [(-1, "user", TRICKY_TEXT), (-1, "assistant", TRICKY_TEXT)]:
        rows.setdefault(conv, []).append((role or "", text or ""))
    got = {r.conv_id: r for r in QUERIES["op3_chat_format"](spark, SF).collect()}
    assert set(got) == set(rows)
    for conv, turns in rows.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
